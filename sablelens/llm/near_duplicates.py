"""N-gram Jaccard join: MinHash LSH forest and exact verification.

Words are runs between the contract's white space, lower-cased; shingles are five words (a shorter text is one
shingle). Texts of equal word sequences are one class, represented by one row. Each class gets TREES labels of
DEPTH minhash bytes. Sorted by one label, classes form a prefix trie; classes that share a prefix are candidates.
Matching starts with whole labels. The prefixes are then shortened, one byte a round, until the links found show
that the target recall is reached: a link of similarity j is seen at depth d with a probability that is known,
1 - (1 - j^d)^TREES, and one over it estimates how many like it there are. It also ends at the depth where even a
link of just the least similarity is seen with that probability, whatever was found.

Candidates of a round are gathered as stars around each trie node's least member, and their components are
clusters. Only texts of clusters are dealt out. A cluster's texts meet in tasks of two blocks of some BLOCK members,
however large it is, where all pairs are verified exactly by a product of presence matrices: a cluster of n different texts
takes n * n / 2 comparisons and carries each text n / BLOCK times, the price of exact numbers of links. Tasks send on a
spanning forest of the links they found and the number of links of each member, never the pairs, so that a huge group
costs rows in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablelens.llm.common import bounded_batches, lean, partitions, release, saved, slices
from sablelens.llm.components import components

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 24, 7, 0.999
#: Members and words of a block, about.
BLOCK, BLOCK_WORDS = 256, 1 << 18
#: Most keys of 8 bytes that are broadcast to pick the texts of clusters, or the rows that go; more are joined by a shuffle of all texts.
BROADCAST_KEYS = 1 << 21
#: Bytes that are hashed at a time.
WINDOW = 1 << 18
#: Odd multipliers and their inverse powers' base for hashing bytes and words.
BYTE_STEP, MIX_A, MIX_B = np.uint64(0x100000001B3), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX_A
    x = (x ^ (x >> np.uint64(33))) * MIX_B
    return x ^ (x >> np.uint64(33))


_INVERSE = np.uint64(pow(int(BYTE_STEP), -1, 1 << 64))


@lru_cache(maxsize=2)
def _ladders(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _ladder(n, BYTE_STEP), _ladder(n, _INVERSE)


def _ladder(n: int, step: np.uint64) -> np.ndarray:
    out = np.full(max(n, 1), step)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's words begin (one more entry at the end)."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    wide = pa.types.is_large_string(low.type)
    ends = np.frombuffer(low.buffers()[1], np.int64 if wide else np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    raw = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(low) + 1, np.int64)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    begins = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]])))
    stops = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]]))) + 1
    at = np.searchsorted(begins, ends)
    return _mix(_raw_hashes(raw, begins, stops) + (stops - begins).astype(np.uint64)), at


def _raw_hashes(raw: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words by running sums modulo 2**64, divided by the power of their place; a window at a time."""
    out = np.empty(len(begins), np.uint64)
    up, down = _ladders(WINDOW)
    k = 0
    while k < len(begins):
        first = begins[k]
        end = max(k + 1, int(np.searchsorted(stops, first + WINDOW, "right")))
        size = int(stops[end - 1] - first)
        if size > WINDOW:
            up, down = _ladders(size)  # one word longer than a window
        terms = (raw[first : first + size].astype(np.uint64) + np.uint64(1)) * up[:size]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        b = begins[k:end] - first
        out[k:end] = (sums[stops[k:end] - first] - sums[b]) * down[b]
        k = end
    return out


def shingles(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each text, and where each text's begin; repeats stay."""
    counts = np.diff(at)
    n = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(n)])
    if len(words) >= WORDS:
        h = np.zeros(len(words) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            h = h * MIX_A + words[k : len(words) - WORDS + 1 + k]
        own = np.repeat(at[:-1][counts >= WORDS], n[counts >= WORDS]) + (np.arange(int(n[counts >= WORDS].sum())) - np.repeat(np.cumsum(n[counts >= WORDS]) - n[counts >= WORDS], n[counts >= WORDS]))
        long = _mix(h[own])
    else:
        long = np.zeros(0, np.uint64)
    out = np.empty(starts[-1], np.uint64)
    is_long = np.repeat(counts >= WORDS, n)
    out[is_long] = long
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        h = np.zeros(1, np.uint64)
        for w in words[at[i] : at[i + 1]]:
            h = h * MIX_A + w
        out[starts[i]] = _mix(h + np.uint64(counts[i]))[0]
    return out, starts


def labels(found: np.ndarray, starts: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """texts x (trees * depth) minhash bytes; rows of texts without shingles mean nothing."""
    rng = np.random.Generator(np.random.PCG64(5))
    flips = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
    odds = rng.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((len(starts) - 1, trees * depth), np.uint8)
    full = np.flatnonzero(np.diff(starts))
    if not len(full):
        return out
    # Some texts at a time, so that the hashes stay in the cache.
    for part in np.array_split(full, max(1, len(found) // 100_000)):
        if not len(part):
            continue
        a, b = starts[part[0]], starts[part[-1] + 1]
        h = (found[a:b] >> np.uint64(32)).astype(np.uint32)
        begin = starts[part] - a
        for k in range(trees * depth):
            least = np.minimum.reduceat((h ^ flips[k]) * odds[k], begin)
            out[part, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _signatures(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "_text")):
            words, at = word_hashes(batch.column("_text"))
            found, starts = shingles(words, at)
            made = labels(found, starts, trees, depth)
            n = np.diff(at)
            classes = [xxhash.xxh3_128_digest(words[at[i] : at[i + 1]].tobytes()) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(classes, pa.binary()), pa.array(n, pa.int64()), pa.array([r.tobytes() for r in made], pa.binary())], names=["_key", "_class", "n_words", "_labels"]
            )

    return lean(run)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames: half of what Spark's own compression leaves to be dealt."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        frames = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(frames, pa.binary())], names=["_key", "_frame"])


def _unpacked_slices(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts take some `most` bytes unpacked, and a row at least: some texts shrink a thousandfold."""
    sizes = [max(0, zstandard.frame_content_size(f.as_py())) for f in batch.column("_frame")]
    begin = held = 0
    for k, size in enumerate(sizes):
        if k > begin and held + size > most:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    yield batch.slice(begin)


class Forest:
    """Union-find over the members of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def similarities(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Exact Jaccard similarities of the first `left` sets with all others; sets are sorted distinct hashes. A set's entry with itself means nothing."""
    names, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = often[inverse] > 1
    rows, columns = owner[shared], place[inverse[shared]]
    both = np.zeros((left, len(sets)), np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    width = 1 << 12  # columns at a time, for bounded memory
    for begin in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        a, b = np.searchsorted(columns, [begin, begin + width])
        x = np.zeros((len(sets), width), np.float32)
        x[rows[a:b], columns[a:b] - begin] = 1
        both += x[:left] @ x.T
    sizes = np.array([len(s) for s in sets], np.float32)
    return both / (sizes[:left, None] + sizes[None, :] - both)


def _verify(similarity: float, depth: int, trees: int):
    """Rows sorted by (cluster, i, j, side) to links: kind 0 is an edge of the forest, kind 1 a member's number of links, kind 2 the recall sums."""

    def task(rows: list[tuple[int, int, int, np.ndarray]], out: list[tuple]) -> None:
        first = [r for r in rows if r[0] == 0]
        every = first + [r for r in rows if r[0] == 1]
        alone = len(first) == len(every)
        s = similarities([r[3] for r in every], len(first))
        i, j = np.nonzero(s >= similarity - 1e-6)
        real = (j > i) if alone else (j >= len(first))
        i, j = i[real], j[real]
        if not len(i):
            return
        weight = np.array([r[2] for r in every])
        links = np.bincount(i, weight[j], len(every)) + np.bincount(j, weight[i], len(every))
        forest = Forest(len(every))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(a, b):
                out.append((0, every[a][1], every[b][1], 0.0))
        out.extend((1, every[k][1], int(links[k]), 0.0) for k in np.flatnonzero(links).tolist())
        seen = 1 - (1 - s[i, j].astype(np.float64) ** depth) ** trees
        out.append((2, 0, len(i), float((1 / seen).sum())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out, unpack = None, [], [], zstandard.ZstdDecompressor()
        for batch in (part for whole in batches for part in _unpacked_slices(whole)):
            texts = [unpack.decompress(f).decode("utf-8", "surrogatepass") for f in batch.column("_frame").to_pylist()]
            words, begin = word_hashes(pa.array(texts, pa.large_string()))
            found, starts = shingles(words, begin)
            columns = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "side", "node", "weight")]
            for k, (cluster, i, j, side, node, weight) in enumerate(zip(*columns, strict=True)):
                if rows and (cluster, i, j) != at:
                    task(rows, out)
                    rows = []
                at = (cluster, i, j)
                rows.append((side, node, weight, np.unique(found[starts[k] : starts[k + 1]])))
            if len(out) > 10_000:
                yield _made(out)
                out = []
        if rows:
            task(rows, out)
        if out:
            yield _made(out)

    return lean(run)


def _made(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "a", "b", "x"])


@dataclass(frozen=True)
class Near:
    """rows: _key, _row (all columns of the input), as saved. members: _key, doc_id, class_key, n_links. firsts:
    class_key, class_id (the class's least doc_id, null where it has none) and the _key of the row that has it.
    links: a, b, keys of different texts that are linked, a spanning forest of them. recall: estimated, of all links."""

    rows: DataFrame
    members: DataFrame
    firsts: DataFrame
    links: DataFrame
    recall: float


def seen_with(similarity: float, depth: int, trees: int) -> float:
    """The probability that two texts of that similarity share a prefix of that depth in any tree."""
    return 1 - (1 - similarity**depth) ** trees


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> Near:
    """Link all texts whose sets of five-word shingles have a Jaccard similarity of at least `similarity`.

    n_links counts the other rows linked to a row, copies included. Texts without words (null, empty, white
    space) have no links, not even to each other. Null ids and repeated rows are rows like others. An empty
    table gives empty results; extra columns, whatever their names, are carried in `rows` alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = saved(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), "op4-rows")
    texts = rows.select("_key", F.col(f"_row.`{text}`").alias("_text"))
    signed = saved(texts.mapInArrow(_signatures(trees, depth), "_key long, _class binary, n_words long, _labels binary"), "op4-signed")
    worded = signed.where("n_words > 0")
    # Labels and numbers of words are the same in all of a class.
    classes = worded.groupBy("_class").agg(F.min("_key").alias("node"), F.count("*").alias("weight"), F.first("n_words").alias("n_words"), F.first("_labels").alias("_labels"))
    classes = saved(classes, "op4-classes")
    nodes = classes.select("node", "weight", "n_words", "_labels")
    at = depth
    while True:
        found = _round(texts, nodes, trees, depth, at, similarity)
        n, estimate = found.where("kind = 2").agg(F.sum("b"), F.sum("x")).first()
        reached = n / estimate if n else seen_with(similarity, at, trees)
        if n and reached >= recall or at == 1 or seen_with(similarity, at, trees) >= recall:
            break
        at -= 1
        release(found)
    links = found.where("kind = 0").select("a", "b")
    groups = components(links, "op4-groups")
    counts = saved(found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links")), "op4-counts")
    done = classes.select("_class", "node", "weight").join(groups, "node", "left").join(counts, "node", "left")
    done = saved(done.select("_class", F.coalesce("component", "node").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links")), "op4-done")
    ids = rows.select("_key", F.col(f"_row.`{doc_id}`").alias("doc_id"))
    keyed = saved(worded.select("_key", "_class").join(done, "_class"), "op4-keyed")
    members = ids.join(keyed, "_key", "left").select("_key", "doc_id", "_class", F.coalesce("class_key", "_key").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    members = saved(members, "op4-members")
    release(signed, classes, groups, counts, done, keyed)
    # By doc_id, and by the text among equal ids, so that neither depends on how the rows came.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_class", "_key")).alias("_least")
    firsts = saved(members.groupBy("class_key").agg(least).select("class_key", F.col("_least.doc_id").alias("class_id"), F.col("_least._key").alias("_key")), "op4-firsts")
    return Near(rows, members.drop("_class"), firsts, links, reached)


def _round(texts: DataFrame, nodes: DataFrame, trees: int, depth: int, at: int, similarity: float) -> DataFrame:
    """Match prefixes of `at` bytes in every tree and verify the clusters that come of it."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    # Trie nodes go by a hash of tree and prefix; two that shared one would only be more candidates.
    prefixes = nodes.select("node", "_labels", tree).select("node", F.xxhash64("tree", F.expr(f"substring(_labels, tree * {depth} + 1, {at})")).alias("trie"))
    heads = prefixes.groupBy("trie").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads = saved(heads, "op4-heads")
    # Stars around the least member of each trie node: candidates, not links.
    stars = prefixes.join(heads, "trie").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    stars = saved(stars, "op4-stars")
    found = components(stars, "op4-clusters")
    clusters = saved(found.join(nodes.select("node", "weight", "n_words"), "node"), "op4-clustered")
    release(heads, stars, found)
    sizes = saved(clusters.groupBy("component").agg(F.count("*").alias("size"), F.sum("n_words").alias("words")), "op4-sizes")
    # Small clusters are one task of one block. Large ones are dealt to blocks by a hash, and every two blocks meet once.
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    mine = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), "blocks")).cast("int")
    placed = saved(clusters.join(sizes, "component").withColumn("blocks", blocks).withColumn("mine", mine), "op4-placed")
    release(clusters, sizes)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.withColumn("other", other).select(
        "node", "weight", F.col("component").alias("cluster"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    wanted = placed.select(F.col("node").alias("_node"))
    few = placed.count() <= BROADCAST_KEYS
    picked = texts.join(F.broadcast(wanted) if few else wanted, F.col("_key") == F.col("_node"), "left_semi")
    packed = picked.mapInArrow(lean(_packed), "_key long, _frame binary")
    if few:
        packed = saved(packed, "op4-packed")
    full = packed.join(met, F.col("node") == F.col("_key")).select("cluster", "i", "j", "side", "node", "weight", "_frame")
    dealt = full.repartition(partitions(texts.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "node")
    made = saved(dealt.mapInArrow(_verify(similarity, at, trees), "kind int, a long, b long, x double"), "op4-found")
    release(placed, *([packed] if few else []))
    return made


def near_classes(near: Near) -> DataFrame:
    """One row per row of the input: doc_id, class_id, n_links; class_id is the least doc_id of its class.

    Nulls come last: a class has a null id only if all its rows do. Texts without words are classes of their own; an empty
    input gives an empty result.
    """
    return near.members.join(near.firsts.select("class_key", "class_id"), "class_key").select("doc_id", "class_id", "n_links")


def without_near_duplicates(near: Near) -> DataFrame:
    """The row of the least doc_id of each class (of equal ids one), with the input's columns; null ids come last.

    Texts without words are classes of their own and all stay; an empty input gives an empty result.
    """
    firsts = near.firsts.select("class_key", F.col("_key").alias("_first"))
    gone = saved(near.members.join(firsts, "class_key").where("_key <> _first").select(F.col("_key").alias("_gone")), "op4-gone")
    # The rows that go are the fewer; only with many of them are all rows dealt out.
    return near.rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, F.col("_key") == F.col("_gone"), "left_anti").select("_row.*")
