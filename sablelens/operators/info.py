"""What a file is: format, byte order, pages and its plain texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablelens.operators.scan import TIFFS, text_of
from sablelens.sources import files as S
from sablelens.sources.ini import read_ini
from sablelens.sources.tiff import read_tags

#: The tags shown, and the most pages counted.
SHOWN, MOST_PAGES = ("Make", "Model", "Software"), 200


def data_size(data: DataFrame) -> DataFrame:
    """data_file_count, total_data_size of the Data*.dat files among a slide's (name, length)."""
    own = data.where(F.col("name").rlike(r"^Data.*\.dat$"))
    return own.agg(F.count("*").alias("data_file_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_data_size"))


def info(spark: SparkSession, path: str) -> dict:
    row = S.detected(S.list_files(S.walk(spark, path))).withColumn("format", S.handler()).first()
    if row is None:
        return {"error": "not a known file"}
    out = {"format": row["format"], "filename": row["name"], "file_size": row["length"]}
    one = spark.createDataFrame([(path, row["format"])], "path string, format string")
    if row["format"] in TIFFS:
        tags = read_tags(one)
        facts = tags.agg(F.first("error").alias("error"), F.first("byte_order").alias("order"), F.countDistinct("ifd_idx").alias("pages"), F.max("pointer_bytes").alias("wide"), F.count_if((F.col("ifd_idx") == 0) & (F.col("dir") == "main")).alias("first_ifd_tags")).first()
        if facts["error"]:
            return out | {"error": facts["error"]}
        out |= {"byte_order": "little-endian" if facts["order"] == "<" else "big-endian", "is_bigtiff": facts["wide"] == 8, "page_count": min(facts["pages"], MOST_PAGES), "first_ifd_tags": facts["first_ifd_tags"]}
        shown = tags.where((F.col("ifd_idx") == 0) & F.col("tag_name").isin(*SHOWN)).select("tag_name", text_of(F.col("raw")).alias("text"))
        out |= {r["tag_name"].lower(): r["text"] for r in shown.collect()}
    elif row["format"] == "mrxs":
        sections = read_ini(one).agg(F.countDistinct("section").alias("sections"), F.first("error").alias("error")).first()
        out |= {"sections": sections["sections"]} | ({"error": sections["error"]} if sections["error"] else {})
        out |= data_size(S.data_files(S.walk(spark, path.rsplit(".", 1)[0]), one)).first().asDict()
    return out
