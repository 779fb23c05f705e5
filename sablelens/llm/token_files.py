"""Token-ID output: compressed id arrays with a shared dictionary and an index.

The ids of a document, each as 2 or 4 little-endian bytes, are one zstandard frame, compressed by itself with a
dictionary trained on serialized id arrays. Frames of consecutive documents in ascending doc_id order fill a
segment, which is one binary value:

    magic "SLTOK001" | width u32 | documents u32 | sha-256 of the dictionary, 32 bytes
    | doc_id i64 * n | null id u8 * n | first token u64 * (n + 1) | frame offset u64 * (n + 1) | frames

First tokens count from the segment's start; the segments' totals, summed in order, give their places in the
whole. Segments are rows of Parquet files, so that any store that Spark writes to can hold them, beside the
table of the dictionary. A document is read by its index entry and frame alone; see read_document.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sablelens.llm.common import bounded_batches, lean, partitions, prefix_sums, shared_dir
from sablelens.llm.encoding import known, vocabulary

MAGIC = b"SLTOK001"
END = 0
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: Bounds of the sample that trains the dictionary; it decides how well frames compress and nothing else.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 4000
SEGMENT_BYTES = 4 << 20
#: Ids for each partition in the sample that finds the ranges.
CUT_SAMPLE = 200


def train_dictionary(docs: DataFrame, tokenizer: str, text: str, doc_id: str) -> bytes:
    """A zstandard dictionary from the documents with the smallest hashes; empty where there is too little to train on.

    Null ids and texts are not trained on, repeated rows are as often as they fit; extra columns are ignored.
    """
    # The ids are picked first, so that a task hands on ids and no texts.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    ids = rows.select("_id").where("_id IS NOT NULL").orderBy(F.xxhash64(F.lit("op3"), "_id"), "_id").limit(SAMPLE_DOCS).distinct().withColumnRenamed("_id", "_picked")
    picked = rows.join(F.broadcast(ids), F.col("_id") == F.col("_picked"), "left_semi").select(F.substring("_text", 1, SAMPLE_CHARS)).limit(SAMPLE_DOCS)
    texts = [r[0] or "" for r in picked.collect()]
    try:
        samples = vocabulary(tokenizer).ids(texts)
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _cuts(ids: DataFrame, parts: int) -> list[int]:
    """Ends of some 4 * parts ranges of about as many ids each, from a sample of rows whose size doesn't depend on theirs; they decide no result."""
    wanted = CUT_SAMPLE * parts
    share = min(1.0, wanted / max(1, ids.count()))
    sampled = ids.where(F.rand(3) < share) if share < 1 else ids
    return sampled.agg(F.percentile_approx("_id", [i / (4 * parts) for i in range(1, 4 * parts)], 20 * parts)).first()[0] or []


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=LEVEL)  # else every document would pay for loading it
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=True)


@lru_cache(maxsize=4)
def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _encode(tokenizer: str, dictionary: bytes, cuts: list[int]):
    """Rows of (doc_id, text) to (bucket, doc_id, _tie, n_tokens, frame); buckets are ranges of doc_id."""
    edges = np.array(cuts, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = vocabulary(tokenizer), _compressor(dictionary)
        end = END.to_bytes(words.width, "little")
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            frames, counts, ties = [], [], []
            for text, ids in zip(texts, words.ids(texts), strict=True):
                raw = ids + end
                counts.append(len(raw) // words.width)
                frames.append(packer.compress(raw))
                ties.append(zlib.crc32(raw))
            ids = batch.column("_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
            # An id that fills several buckets by its repeats is spread over them in the order of its ties.
            spread = (np.array(ties, dtype=np.uint64) * (high - low).astype(np.uint64)) >> np.uint64(32)
            bucket = np.where(high > low, low + 1 + spread.astype(np.int64), low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), batch.column("_id"), pa.array(ties, pa.int64()), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())],
                names=["bucket", "doc_id", "_tie", "n_tokens", "frame"],
            )

    return run


def pack_segment(rows: list[tuple[int | None, int, bytes]], width: int, dictionary: bytes) -> bytes:
    """doc_id, number of tokens and frame of each document, in order."""
    ids = np.array([i or 0 for i, _, _ in rows], "<i8")
    nulls = np.array([i is None for i, _, _ in rows], "u1")
    tokens = np.cumsum([0, *(n for _, n, _ in rows)]).astype("<u8")
    offsets = np.cumsum([0, *(len(f) for _, _, f in rows)]).astype("<u8")
    head = MAGIC + struct.pack("<II", width, len(rows)) + hashlib.sha256(dictionary).digest()
    return b"".join([head, ids.tobytes(), nulls.tobytes(), tokens.tobytes(), offsets.tobytes(), *(f for _, _, f in rows)])


class Segment:
    """A packed segment, opened without decompressing anything."""

    def __init__(self, raw: bytes, dictionary: bytes):
        if raw[:8] != MAGIC or raw[16:48] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token segment, or one of another dictionary")
        self.raw, self.unpack = raw, _decompressor(dictionary)
        self.width, self.n = struct.unpack_from("<II", raw, 8)
        at = 48
        self.ids = np.frombuffer(raw, "<i8", self.n, at)
        self.nulls = np.frombuffer(raw, "u1", self.n, at := at + 8 * self.n)
        self.tokens = np.frombuffer(raw, "<u8", self.n + 1, at := at + self.n)
        self.offsets = np.frombuffer(raw, "<u8", self.n + 1, at := at + 8 * (self.n + 1))
        self.body = at + 8 * (self.n + 1)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        frame = self.raw[self.body + int(self.offsets[k]) : self.body + int(self.offsets[k + 1])]
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.width}")


def _segments(width: int, dictionary: bytes, most: int):
    """Sorted rows to packed segments; holds one segment at a time."""
    names = ["bucket", "segment", "first_doc_id", "last_doc_id", "n_docs", "n_tokens", "content"]

    def packed(bucket: int, segment: int, rows: list) -> pa.RecordBatch:
        content = pack_segment(rows, width, dictionary)
        values = [bucket, segment, rows[0][0], rows[-1][0], len(rows), sum(n for _, n, _ in rows)]
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in values), pa.array([content], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, segment, size, rows = None, 0, 0, []
        for batch in batches:
            for bucket, doc, n, frame in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n_tokens", "frame")), strict=True):
                if rows and (bucket != at or size + len(frame) > most):
                    yield packed(at, segment, rows)
                    segment, size, rows = segment + 1 if bucket == at else 0, 0, []
                elif bucket != at:
                    segment = 0
                at, size = bucket, size + len(frame)
                rows.append((doc, n, frame))
        if rows:
            yield packed(at, segment, rows)

    return run


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str = "byte_bpe_50k.json", text: str = "text", doc_id: str = "doc_id") -> str:
    """Encode every whole text, append id 0 to each, and write the files in ascending doc_id order; returns their folder.

    Null texts count as empty and give the end id alone; null ids come first; rows that share an id are put in
    the order of a checksum of their ids. An empty table writes an empty folder of files; extra columns are ignored. The
    format holds ids of 64 bits: docs with ids of another type than an integer are refused.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} is no integer column")
    bounded_batches(spark)
    tokenizer = known(tokenizer)
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    dictionary = train_dictionary(docs, tokenizer, text, doc_id)
    parts = partitions(spark)
    ids = docs.select(F.col(doc_id).cast("long").alias("_id"))
    cuts = _cuts(ids, parts)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    encoded = rows.mapInArrow(lean(_encode(tokenizer, dictionary, list(cuts))), "bucket long, doc_id long, _tie long, n_tokens long, frame binary")
    dealt = encoded.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "_tie", "n_tokens")
    schema = "bucket long, segment long, first_doc_id long, last_doc_id long, n_docs long, n_tokens long, content binary"
    dealt.mapInArrow(lean(_segments(vocabulary(tokenizer).width, dictionary, SEGMENT_BYTES)), schema).write.option("compression", "none").parquet(f"{path}/segments")
    made = spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary), LEVEL)], "sha256 string, dictionary binary, level int")
    made.coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary in {path} doesn't fit its hash")
    return bytes(row["dictionary"])


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of that id, from the segments whose range holds it."""
    dictionary = read_dictionary(spark, path)
    rows = spark.read.parquet(f"{path}/segments").where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id)).select("content").toLocalIterator()
    out = []
    for row in rows:
        segment = Segment(bytes(row["content"]), dictionary)
        low, high = int(segment.nulls.sum()), segment.n
        first, last = (low + np.searchsorted(segment.ids[low:high], doc_id, side) for side in ("left", "right"))
        out += [segment.document(k) for k in range(first, last)]
    return out


def _read(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, number, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "segment", "content")), strict=True):
                s = Segment(raw, dictionary)
                sums = [zlib.crc32(s.document(k).astype("<u4").tobytes()) for k in range(s.n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([bucket] * s.n, pa.int64()),
                        pa.array([number] * s.n, pa.int64()),
                        pa.array(s.ids, pa.int64(), mask=s.nulls.astype(bool)),
                        pa.array(s.tokens[:-1].astype(np.int64), pa.int64()),
                        pa.array(np.diff(s.tokens).astype(np.int64), pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["bucket", "segment", "doc_id", "_local", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files, those of null and repeated ids included: doc_id, start, n_tokens, ids_crc32, bucket, segment. Files of an empty table give an empty result."""
    dictionary = read_dictionary(spark, path)
    bounded_batches(spark)
    segments = spark.read.parquet(f"{path}/segments")
    starts = prefix_sums(segments.select("bucket", "segment", "n_tokens"), ["bucket", "segment"], {"_base": "n_tokens"}, "op3-starts").drop("n_tokens")
    schema = "bucket long, segment long, doc_id long, _local long, n_tokens long, ids_crc32 long"
    rows = segments.select("bucket", "segment", "content").mapInArrow(lean(_read(dictionary)), schema)
    out = rows.join(starts, ["bucket", "segment"])
    return out.select("doc_id", (F.col("_base") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32", "bucket", "segment")
