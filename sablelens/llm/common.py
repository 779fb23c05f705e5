"""Shared plumbing: scratch tables in the cluster's shared folder, distributed prefix sums, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: one word of the contracts, a run of anything but space, TAB, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and everything is local."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    place = tempfile.mkdtemp(prefix="sablelens-")
    atexit.register(shutil.rmtree, place, True)
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a DataFrame over the files: lineage is cut, and lost executors lose nothing.

    The files go with release(), or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Removes the files of tables that saved() returned and that no DataFrame still in use is based on."""
    for df in frames:
        _remove(_WRITTEN.pop(df._saved_at), df._saved_at)


_WRITTEN: dict[str, SparkSession] = {}


@atexit.register
def _leave() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM has gone before
            return


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(df: DataFrame, order: list[str], values: dict[str, str], name: str) -> DataFrame:
    """Exclusive running sums over the total order of the columns `order`, for tables of any size.

    values maps new column names to the summed columns. Rows are range partitioned and saved, each
    partition is summed by itself, and only one total per partition meets in a single task. The order
    must be total but for rows that agree in everything summed. The result is saved.
    """
    parts = partitions(df.sparkSession)
    dealt = saved(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*(F.sum(v).alias(f"_t_{n}") for n, v in values.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values))
    summed = dealt.select("*", *(F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_l_{n}") for n, v in values.items()))
    joined = summed.join(bases, "_part")
    out = saved(joined.select(*df.columns, *((F.col(f"_l_{n}") + F.col(f"_b_{n}")).cast("long").alias(n) for n in values)), name)
    release(dealt)
    return out


def unit(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Python workers get at most so many rows and bytes at once, whatever the lengths of the texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
Batches = Iterator[pa.RecordBatch]


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session: the same for all operators, so that it doesn't matter which is built last. Lower bounds stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        # Values with units, as those that come with Spark, are larger.
        if not now.removesuffix("b").isdigit() or not 0 < int(now.removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, for mapInArrow, after which its worker gives free memory back: Spark keeps workers for later stages."""

    def kept(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # no glibc
                pass

    return kept


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Batches:
    """The batch in parts of some `most` bytes of that column, and a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
