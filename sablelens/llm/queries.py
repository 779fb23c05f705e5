"""The registered query of every operator here, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sablelens.llm.common import table
from sablelens.llm.decontamination import contaminated
from sablelens.llm.exact_dedup import exact_duplicates
from sablelens.llm.html_text import main_text
from sablelens.llm.language_id import identify
from sablelens.llm.mixing import mix, taken_words
from sablelens.llm.near_duplicates import near_classes, near_duplicates
from sablelens.llm.pii import personal_data
from sablelens.llm.secrets import find_secrets
from sablelens.llm.token_counts import token_counts
from sablelens.llm.token_files import read_token_files, write_token_files


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(table(spark, sf_dir, "documents"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(near_duplicates(table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("identity")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_files": op3_token_files,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_counts": op5_token_counts,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_main_text": op7_main_text,
    "op8_decontamination": op8_decontamination,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {
    "op6_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256,
               CAST(greatest(1, (strlen(n.t) + 4095) // 4096) AS BIGINT) AS n_blocks
        FROM n JOIN g USING (t)
    """,
}
