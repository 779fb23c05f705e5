"""Files scanned as they land in a folder, and event windows; beyond what a batch tool needs, but the same functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablelens.functions import fields as P
from sablelens.functions import rules as R
from sablelens.operators.scan import text_of
from sablelens.sources.tiff import read_tags

#: The binaryFile source's fixed schema.
BINARY = "path string, modificationTime timestamp, length long, content binary"


def landed(spark: SparkSession, folder: str, keep: str = "1 hour") -> DataFrame:
    """A stream of path, name, ext, format, length, landed_at of new files of known suffixes, each once."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("landed_at"), "length")
    named = stream.withColumn("path", F.regexp_replace("path", "^file:(//)?(?=/)", "")).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    known = named.withColumn("ext", P.extension(F.col("name"))).withColumn("format", P.format_of(F.col("name"))).where("format <> 'unknown'")
    return known.withWatermark("landed_at", keep).dropDuplicatesWithinWatermark(["path"])


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = True):
    """Start a query that hands the pattern hits in the tags of each batch of new files to handle(findings, batch)."""

    def each(batch: DataFrame, number: int) -> None:
        texts = read_tags(batch).where("dtype = 2").select("path", "tag_name", text_of(F.col("raw")).alias("text"))
        handle(R.scan_strings(texts, ["path", "tag_name"], "text"), number)

    writer = landed(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and values of events per type and tumbling or sliding window; works on tables and on streams."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    window = F.window("at", size, slide) if slide else F.window("at", size)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: runs of events with no longer pause than gap."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")
