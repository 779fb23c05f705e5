"""Documents to training tokens in five stages, each on all that the one before kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, extra ones included. An empty
table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablelens.llm.common import release, saved, table
from sablelens.llm.decontamination import decontaminated
from sablelens.llm.language_id import UNKNOWN, fit, predict
from sablelens.llm.mixing import mixed_documents
from sablelens.llm.near_duplicates import near_duplicates, without_near_duplicates
from sablelens.llm.token_files import read_token_files, write_token_files

#: A document goes if its n-grams are no evidence for any language; texts of a single short word have twice this.
LEAST_EVIDENCE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose letters say nothing for any learned language, go; null ids and repeated rows are rows like others."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text").alias("_text"))
    told = predict(rows, fit(docs), "_text", ["_row"])
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("evidence") >= LEAST_EVIDENCE)).select("_row.*")


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies stays; those without words are groups of their own."""
    return without_near_duplicates(near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; those without a text stay, and all do if the benchmark is empty."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, written shard by shard in its order; a document comes as often as it is drawn, one without words never."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, and from them a row per document; null ids come first, null texts have the end id alone."""
    return read_token_files(spark, write_token_files(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language_id),
    ("near_duplicate_join", near_duplicate_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The stages draw by hashes, link by shingles and encode by a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            release(before)
    return docs
