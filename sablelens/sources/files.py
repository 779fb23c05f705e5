"""File discovery, format detection and companions, as DataFrames of paths."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sablelens.functions import fields as P
from sablelens.operators.durable import kept

#: Fixed value: suffixes that hold TIFF data whatever their vendor.
TIFF_SUFFIXES = ("tif", "tiff", "svs", "ndpi", "bif", "scn", "vms")


def open_file(path: str):
    """A seekable file by URI or plain path, in any store that Arrow knows."""
    store, place = store_of(path)
    return store.open_input_file(place)


def store_of(path: str):
    """The store of a URI or plain path, and the place in it. Plain paths are taken as they are, whatever they hold."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    if path.startswith("file://"):
        return pafs.LocalFileSystem(), path.removeprefix("file://")
    return pafs.FileSystem.from_uri(path)


#: Rows of a decoder that are handed to Spark at a time.
DECODED_ROWS = 10_000


def decoded(contents: DataFrame, key: str, content: str, rows_of: Callable[[str, io.BytesIO], list[tuple]], schema: str, with_format: bool = False) -> DataFrame:
    """Rows (of the schema, as DDL) that rows_of makes of a key and an open file, from files that are held in a binary column; key, as text, stands for their path.
    with_format: and the column format of contents, behind the others."""
    schema += ", format string" if with_format else ""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, raw, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = rows_of(k, io.BytesIO(raw))
                rows += [(*r, *more) for r in made] if more else made
                while len(rows) >= DECODED_ROWS:
                    yield batch_of(rows[:DECODED_ROWS])
                    del rows[:DECODED_ROWS]
            if rows:
                yield batch_of(rows)

    return contents.selectExpr(f"CAST(`{key}` AS STRING) AS key", f"`{content}` AS content", *["format"] * with_format).mapInArrow(run, schema)


ENTRIES = "path string, folder boolean, length long, modification_time timestamp, error string"


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies in each folder; one that can't be listed is a row with its error."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    for batch in batches:
        for root in batch["path"]:
            store, place = store_of(root)
            lead = root.removesuffix(place) if root.endswith(place) else root.split("://")[0] + "://"
            try:
                info = store.get_file_info(place)
                found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(place, recursive=False))
                rows = [(lead + i.path, i.type == pafs.FileType.Directory, None if i.size is None else int(i.size), i.mtime, None) for i in found]
            except OSError as why:
                rows = [(root, False, None, None, str(why))]
            for k in range(0, len(rows), 10_000):
                frame = pd.DataFrame(rows[k : k + 10_000], columns=names).astype({"length": object, "folder": bool})
                yield frame.assign(modification_time=pd.to_datetime(frame["modification_time"], utc=True))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """ENTRIES of all files below root, empty ones too, or of root if it is a file. Executors list the folders, level by level."""
    level, out = spark.createDataFrame([(root.removeprefix("file://").rstrip("/") or "/",)], "path string"), None
    while True:
        listed = kept(level.mapInPandas(_entries, ENTRIES))
        out = listed if out is None else out.unionByName(listed)
        level = listed.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism, "path")
        if level.isEmpty():
            return out.where("NOT folder").drop("folder")


def list_files(listing: DataFrame, format_filter: str | None = None) -> DataFrame:
    """path, dir, name, stem, ext, length, modification_time of the files of a listing (see walk) whose suffix is known, without reading any.

    format_filter is one of the formats; an unknown one filters nothing.
    """
    found = listing.where("error IS NULL").withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    out = found.withColumn("stem", P.stem(F.col("name"))).withColumn("ext", P.extension(F.col("name")))
    wanted = P.EXTENSIONS.get((format_filter or "").lower(), tuple(e for exts in P.EXTENSIONS.values() for e in exts))
    return out.where(F.col("ext").isin(*wanted)).select("path", "dir", "name", "stem", "ext", "length", "modification_time")


def _heads(size: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = []
            for path in batch["path"]:
                try:
                    with open_file(path) as f:
                        heads.append(f.read(size))
                except OSError:
                    heads.append(None)
            yield batch.assign(head=heads)

    return run


def with_contents(files: DataFrame) -> DataFrame:
    """files and all their bytes as `head`, null where a file can't be read; one file travels at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _heads(None)
        for batch in batches:
            yield from read(batch.iloc[k : k + 1] for k in range(len(batch)))

    return files.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in files.dtypes) + ", head binary")


def with_heads(files: DataFrame, size: int) -> DataFrame:
    """files and their first bytes as `head`, null where a file can't be read."""
    return files.mapInPandas(_heads(size), ", ".join(f"`{c}` {t}" for c, t in files.dtypes) + ", head binary")


def with_pieces(places: DataFrame, size: int) -> DataFrame:
    """places (path, start and others) and `size` bytes of each file from start as `head`; null where it can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = []
            for path, start in zip(batch["path"], batch["start"], strict=True):
                try:
                    with open_file(path) as f:
                        f.seek(int(start))
                        heads.append(f.read(size))
                except (OSError, ValueError, TypeError):
                    heads.append(None)
            yield batch.assign(head=heads)

    return places.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in places.dtypes) + ", head binary")


def data_files(listing: DataFrame, slides: DataFrame) -> DataFrame:
    """path, file, name, length: all files in the folders named as the slides (path)."""
    every = listing.where("error IS NULL").select(F.col("path").alias("file"), "length")
    every = every.withColumn("_dir", F.regexp_replace("file", "/[^/]*$", "")).withColumn("name", F.regexp_extract("file", "([^/]*)$", 1))
    return slides.select("path", F.regexp_replace("path", r"\.[^./]*$", "").alias("_dir")).join(every, "_dir").select("path", "file", "name", "length")


def is_tiff(head: Column) -> Column:
    """II or MM, then 42, or 43 with offsets of 8 bytes."""
    h = F.hex(F.substring(head, 1, 6))
    return h.rlike("^(49492A00|4D4D002A|49492B000800|4D4D002B0008)")


def claimed_by(ext: Column, head: Column) -> Column:
    """The first format that claims a file by suffix and, for some, by its first 132 bytes; unknown for none."""
    return P.first_of(
        [
            (ext == "ndpi", F.lit("ndpi")),
            (ext == "svs", F.lit("svs")),
            (ext == "mrxs", F.lit("mrxs")),
            ((ext == "bif") & is_tiff(head), F.lit("bif")),
            ((ext == "scn") & is_tiff(head), F.lit("scn")),
            (ext.isin("dcm", "dicom") & (F.hex(F.substring(head, 129, 4)) == "4449434D"), F.lit("dicom")),
            (ext.isin(*TIFF_SUFFIXES) & F.hex(F.substring(head, 1, 4)).rlike("^(49492[AB]00|4D4D002[AB])"), F.lit("tiff")),
        ],
        F.lit("unknown"),
    )


def detected(files: DataFrame) -> DataFrame:
    """files with format, see claimed_by."""
    return with_heads(files, 132).withColumn("format", claimed_by(F.col("ext"), F.col("head"))).drop("head")


def handler(format_column: str = "format") -> Column:
    """Files that no format claims are tried as TIFF."""
    return F.when(F.col(format_column) == "unknown", "tiff").otherwise(F.col(format_column))


def companions(listing: DataFrame, files: DataFrame) -> DataFrame:
    """path, companion: .ndpa and .ndpis files beside an NDPI file, by equal stem or stem and underscore."""
    others = listing.where("error IS NULL").select(F.col("path").alias("companion"), P.extension(F.col("path")).alias("ext")).where(F.col("ext").isin("ndpa", "ndpis"))
    others = others.select("companion", "ext", F.regexp_replace("companion", "/[^/]*$", "").alias("dir"), P.stem(F.col("companion")).alias("_stem"))
    slides = files.where("ext = 'ndpi'").select("path", "dir", "stem")
    same = slides.join(others, "dir").where((F.col("_stem") == F.col("stem")) | (F.col("ext") == "ndpa") & F.col("_stem").startswith(F.concat("stem", F.lit("_"))))
    return same.select("path", "companion").orderBy("path", "companion")
