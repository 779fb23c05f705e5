"""Tables that are kept while their sources change or are read many times."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Folders of what kept() has written, by the calls of in_parts() that are under way.
_WRITTEN: list[list[str]] = []


def kept(df: DataFrame) -> DataFrame:
    """df as it is now, written to the shared folder of spark.checkpoint.dir: lost executors neither lose it nor work it out anew.

    Where that is unset, which only a local master may leave so, a temporary folder stands in.
    """
    _folder(df.sparkSession)
    out = df.checkpoint()
    if _WRITTEN:
        _WRITTEN[-1].append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out


def stored(df: DataFrame) -> DataFrame:
    """The same as Parquet, of which each branch reads only the columns that it needs: for rows that feed many branches."""
    spark = df.sparkSession
    place = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    if _WRITTEN:
        _WRITTEN[-1].append(place)
    else:
        atexit.register(_remove, spark, place)
    return spark.read.schema(df.schema).parquet(place)


def in_parts(spark: SparkSession, parts: int, work: Callable[[int], DataFrame]) -> DataFrame:
    """The rows of work(0), ..., work(parts - 1), one after the other: what a part has kept goes as soon as its rows are written, so that
    the disk holds that of one part at a time."""
    place = f"{_folder(spark)}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, place)
    for k in range(parts):
        _WRITTEN.append([])
        try:
            rows = work(k)
            schema = rows.schema
            rows.write.option("compression", "zstd").parquet(f"{place}/{k}")
        finally:
            for path in _WRITTEN.pop():
                _remove(spark, path)
        del rows
        if k + 1 < parts:  # shuffle files go when the driver's JVM finds their tables gone
            gc.collect()
            spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(*(f"{place}/{k}" for k in range(parts)))


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Py4JError, AttributeError, OSError):  # at the driver's end the JVM may have gone before
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _folder(spark: SparkSession) -> str:
    """The folder of checkpoints, set to a temporary one where it may be."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sablelens-")
        atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
