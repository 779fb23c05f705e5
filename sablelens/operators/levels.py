"""Plans of conversions: the levels a converted file would have. Pixels are not converted, as no codec is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sablelens.operators.scan import text_of

#: Microns in a centimetre, and the unit number of centimetres.
MICRONS, CENTIMETRES = 10_000.0, 3


def pyramid(tags: DataFrame) -> DataFrame:
    """path, level, width, height, downsample, pixels_per_cm of the main directories that look like one pyramid: same shape as the first, smaller."""
    value = lambda tag: F.max(F.when(F.col("tag_id") == tag, F.get("nums", F.lit(0))))
    mpp = F.max(F.when(F.col("tag_id") == 270, F.try_to_number(F.regexp_extract(text_of(F.col("raw")), r"MPP\s*=\s*([0-9]+\.?[0-9]*)", 1), F.lit("9999.999999")).cast("double")))
    sizes = tags.where("error IS NULL AND dir = 'main'").groupBy("path", "ifd_idx").agg(value(256).alias("width"), value(257).alias("height"), mpp.alias("mpp")).where("width > 0 AND height > 0")
    order = Window.partitionBy("path").orderBy(F.col("width").desc(), "ifd_idx")
    first = lambda c: F.first(c).over(order)
    shaped = sizes.withColumn("_w", first("width")).withColumn("_h", first("height")).withColumn("_mpp", F.max("mpp").over(Window.partitionBy("path")))
    same = F.abs(F.col("width") / F.col("height") - F.col("_w") / F.col("_h")) < 0.02 * F.col("_w") / F.col("_h")
    levels = shaped.where(same).withColumn("level", F.row_number().over(order) - 1)
    return levels.select("path", "level", F.col("width").cast("long"), F.col("height").cast("long"), (F.col("_w") / F.col("width")).alias("downsample"), (MICRONS / F.col("_mpp") / (F.col("_w") / F.col("width"))).alias("pixels_per_cm"))
