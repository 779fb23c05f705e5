"""Batches of conversions: what would become of which file, and counts of what did. There is no codec here, so pixels aren't converted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Targets and their suffixes.
TARGETS = {"tiff": "tif", "png": "png", "jpeg": "jpg"}


def plan(files: DataFrame, output: str, target: str = "tiff") -> DataFrame:
    """path, output, target: the file that each slide (path, stem) becomes; slides of one stem are numbered in the order of their paths."""
    suffix = TARGETS[target]
    same = F.row_number().over(Window.partitionBy("stem").orderBy("path"))
    name = F.concat("stem", F.when(same > 1, F.concat(F.lit("-"), same)).otherwise(""), F.lit(f".{suffix}"))
    return files.select("path", F.concat(F.lit(output.rstrip("/") + "/"), name).alias("output"), F.lit(target).alias("target"))


def conversion_stats(results: DataFrame) -> DataFrame:
    """total, converted, errored: results have path and error."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("converted"), F.count_if(F.col("error").isNotNull()).alias("errored"))
