"""Exact dedup by deterministic block naming.

Texts are lower-cased in A-Z only and cut into blocks of fixed size. Equal blocks get one integer name,
found by sorting the distinct blocks; adjacent names are paired and the distinct pairs named again, level
by level, until each document has a single name. Two documents of the same number of blocks have the same
last name exactly when their texts are equal: no step trusts a hash. Blocks travel under a 128-bit
fingerprint, and the distinct (fingerprint, content) rows prove that no fingerprint stands for two contents;
should one, all blocks are fingerprinted again with another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablelens.llm.common import bounded_batches, lean, prefix_sums, release, saved

#: Bytes of a block.
BLOCK = 4096
#: The only letters that are folded.
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def _normalised(column: pa.Array) -> Iterator[bytes]:
    fold = bytes.maketrans(UPPER, LOWER)
    for text in column:
        raw = text.as_py()
        yield b"" if raw is None else raw.translate(fold)


def _documents(seed: int, size: int):
    """Per row: key, id, sha-256 of the normalised text, and the fingerprints of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, prints = [], []
            for raw in _normalised(batch.column("_text")):
                shas.append(hashlib.sha256(raw).hexdigest())
                prints.append([xxhash.xxh3_128_digest(raw[i : i + size], seed) for i in range(0, max(1, len(raw)), size)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_id"), pa.array(shas, pa.string()), pa.array(prints, pa.list_(pa.binary()))],
                names=["_key", "_id", "text_sha256", "_prints"],
            )

    return run


def _blocks(seed: int, size: int):
    """Per block: fingerprint and content; a batch's own repeats go out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for raw in _normalised(batch.column("_text")):
                seen.update(raw[i : i + size] for i in range(0, max(1, len(raw)), size))
                if len(seen) * size > 8 << 20:
                    yield _named(seen, seed)
                    seen = set()
            if seen:
                yield _named(seen, seed)

    return run


def _named(blocks: set[bytes], seed: int) -> pa.RecordBatch:
    rows = list(blocks)
    return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(b, seed) for b in rows], pa.binary()), pa.array(rows, pa.binary())], names=["_print", "_content"])


def _integer_names(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sort distinct rows and number them: keys, 1 and a dense long `_name`, saved."""
    return prefix_sums(distinct.select(*keys, F.lit(1).alias("_one")), keys, {"_name": "_one"}, name)


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_blocks, identity.

    Of equal texts the row with the largest id stays; of rows that share even that id, one (kept is true
    once in every group). A null text counts as empty; null ids sort below all others. Empty tables give
    an empty result, and extra columns of docs are ignored.
    """
    bounded_batches(docs.sparkSession)
    # Binary columns, so that texts cross to Python without decoding.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text")).withColumn("_key", F.monotonically_increasing_id())
    kind = docs.schema[doc_id].dataType.simpleString()
    seed = 0
    while True:
        contents = rows.select("_text").mapInArrow(lean(_blocks(seed, block)), "_print binary, _content binary").distinct()
        prints = saved(contents.groupBy("_print").agg(F.count("*").alias("_contents")), "op6-prints")
        if prints.where("_contents > 1").limit(1).count() == 0:
            break
        release(prints)
        seed += 1
    narrow = saved(rows.mapInArrow(lean(_documents(seed, block)), f"_key long, _id {kind}, text_sha256 string, _prints array<binary>"), "op6-docs")
    names = _integer_names(prints, ["_print"], "op6-names0")
    # Level 0: fingerprints become names, gathered again in each document's order.
    parts = narrow.select("_key", F.posexplode("_prints").alias("_at", "_print"))
    level = saved(parts.join(names, "_print").select("_key", "_at", "_name"), "op6-named0")
    made = [prints, names, level]
    sizes = narrow.select("_key", F.size("_prints").cast("long").alias("n_blocks"))
    done = level.join(sizes.where("n_blocks = 1"), "_key").select("_key", "_name", "n_blocks")
    level = level.join(sizes.where("n_blocks > 1"), "_key").select("_key", "_at", "_name", "n_blocks")
    longest = narrow.agg(F.max(F.size("_prints"))).first()[0] or 1
    depth = 1
    while (1 << (depth - 1)) < longest:
        # At most two rows meet per (document, pair); an unpaired last block is named as (name, null).
        pairs = saved(
            level.groupBy("_key", "n_blocks", F.expr("_at div 2").cast("int").alias("_at")).agg(
                F.max(F.when(F.col("_at") % 2 == 0, F.col("_name"))).alias("_left"), F.coalesce(F.max(F.when(F.col("_at") % 2 == 1, F.col("_name"))), F.lit(-1)).alias("_right")
            ),
            f"op6-pairs{depth}",
        )
        named = _integer_names(pairs.select("_left", "_right").distinct(), ["_left", "_right"], f"op6-names{depth}")
        every = saved(pairs.join(named, ["_left", "_right"]).select("_key", "_at", "_name", "n_blocks"), f"op6-named{depth}")
        made += [pairs, named, every]
        last = F.col("n_blocks") <= (1 << depth)
        done = done.unionByName(every.where(last).select("_key", "_name", "n_blocks"))
        level = every.where(~last)
        depth += 1
    identity = saved(narrow.select("_key", "_id", "text_sha256").join(done, "_key"), "op6-identity")
    release(narrow, *made)
    best = F.max(F.struct("_id", "_key")).alias("_best")
    # Written, so that the join deals both sides itself and a huge group of copies is split.
    groups = saved(identity.groupBy("n_blocks", "_name").agg(best, F.count("*").alias("group_size")), "op6-groups")
    out = identity.join(groups, ["n_blocks", "_name"])
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_best._id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("_best._key") == F.col("_key")).alias("kept"),
        "text_sha256",
        "n_blocks",
        F.col("_name").alias("identity"),
    )
