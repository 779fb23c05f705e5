"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by a hash into blocks of some 32 documents, and the blocks permuted.
Water filling turns weights into word targets, targets into an exact quota of block draws per source. The
tree starts with all quotas in one node; a node hands half of its slots to its left child, and which sources
these slots hold is one multivariate-hypergeometric draw, the rest goes right, so that every shard is a
fair sample of the mix while the quotas stay exact. A shard then draws the next blocks of each source's
permutation (wrapping for a second pass), which makes the draws disjoint, and shuffles its documents locally.
The last block of a source is drawn in part: its documents in permuted order as far as they fit.

Everything is DataFrame expressions. Tables of documents, of blocks and of the tree's nodes are distributed: nodes are dealt out
anew, and saved, every SPREAD levels. Only the table of sources, one row for each, is ordered in a single task, and a node holds one number
per source.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablelens.llm.common import WORD, partitions, prefix_sums, release, saved, unit

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST_REPEATS = 1.5, 2
BLOCK_DOCS, SHARD_WORDS = 32, 1 << 20
#: Levels of the tree that are worked out where their ancestor is.
SPREAD = 6


@dataclass(frozen=True)
class Mix:
    """sources: source, size, n_docs, weight, target, quota. units: one row per distinct (doc_id, source, size).
    draws: doc_id, source, size, copies, pass, block, shard, position; a row each time that a unit is taken. shards: shard, and
    quotas, the draws of blocks from each source in the order of sources."""

    sources: DataFrame
    units: DataFrame
    draws: DataFrame
    shards: DataFrame


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out and planned once, however often it is used: it becomes the variable of a one-element transform."""
    return F.transform(F.array(value), use)[0]


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` slots, taken from `total` slots of which `good` are marked, are marked: inversion from the mode.

    Probabilities are relative to the mode's and run to 12 standard deviations, beyond which doubles hold nothing. Each step's
    values are bound: written out, they would multiply from step to step, and the plan fill the driver's memory.
    """
    given = F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn"), u.alias("u"))

    def draw(v: Column) -> Column:
        total, good, drawn, u = (v[name] for name in ("total", "good", "drawn", "u"))
        low, high = F.greatest(F.lit(0), drawn + good - total), F.least(drawn, good)
        mean = drawn * good / F.greatest(total, F.lit(1))
        reach = F.ceil(F.lit(12.0) * F.sqrt(mean + 1)) + 12
        middle = F.least(high, F.greatest(low, F.floor((drawn + 1) * (good + 1) / (total + 2)))).cast("long")
        none = F.array().cast("array<bigint>")
        to = lambda x: (good - x + 1) * (drawn - x + 1) / (x * (total - good - drawn + x))  # noqa: E731  from x - 1 to x
        back = lambda x: (x + 1) * (total - good - drawn + x + 1) / ((good - x) * (drawn - x))  # noqa: E731  from x + 1 to x
        one = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"))

        def ways(m: Column) -> Column:
            mode, reach = m["mode"], m["reach"]
            first, last = F.greatest(low, mode - reach).cast("long"), F.least(high, mode + reach).cast("long")
            up = F.when(last > mode, F.sequence(mode + 1, last)).otherwise(none)
            down = F.when(mode > first, F.sequence(mode - 1, first, F.lit(-1).cast("long"))).otherwise(none)
            return F.struct(mode.alias("mode"), up.alias("up"), down.alias("down"))

        def mass(xs: Column, ratio) -> Column:
            return F.aggregate(xs, one, lambda s, x: _bound(s["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (s["t"] + w).alias("t"))), lambda s: s["t"])

        def walk(xs: Column, ratio, mode: Column, goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"), mode.alias("x"))
            on = lambda s, x: _bound(s["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (s["t"] + w).alias("t"), x.alias("x")))
            return F.aggregate(xs, start, lambda s, x: F.when(s["t"] > goal, s).otherwise(on(s, x)), lambda s: s["x"])

        def picked(m: Column, sums: Column) -> Column:
            above = sums["above"]

            def at(goal: Column) -> Column:
                return F.when(goal <= 1, m["mode"]).when(goal <= 1 + above, walk(m["up"], to, m["mode"], goal - 1)).otherwise(walk(m["down"], back, m["mode"], goal - 1 - above))

            return _bound(u * (1 + above + sums["below"]), at)

        sums = lambda m: F.struct(mass(m["up"], to).alias("above"), mass(m["down"], back).alias("below"))
        drawn_good = _bound(_bound(F.struct(middle.alias("mode"), reach.alias("reach")), ways), lambda m: _bound(sums(m), lambda t: picked(m, t)))
        return F.when((good == 0) | (drawn == 0), F.lit(0).cast("long")).when(good == total, drawn).otherwise(drawn_good.cast("long"))

    return _bound(given, draw)


def _split(quotas: Column, slots: Column, *seed: Column) -> Column:
    """Of the node's quotas (one per source), those of a child with `slots` slots."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q)
    start = F.struct(total.alias("total"), slots.alias("left"), F.array().cast("array<bigint>").alias("got"))

    def step(s: Column, q: Column) -> Column:
        x = _hypergeometric(s["total"], q, s["left"], unit(*seed, F.size(s["got"])))
        return _bound(x, lambda x: F.struct((s["total"] - q).alias("total"), (s["left"] - x).alias("left"), F.concat(s["got"], F.array(x)).alias("got")))

    return F.aggregate(quotas, start, step, lambda s: s["got"])


def splitting_tree(quotas: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """From one row with `quotas` (array of long) to 2**depth rows: shard and its quotas. Sums over shards equal the input exactly."""
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "quotas")
    for level in range(depth):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q)
        slots = F.floor(total / 2).cast("long")
        halved = nodes.withColumn("_slots", slots).withColumn("_left", _split(F.col("quotas"), F.col("_slots"), F.lit(seed), F.lit(level), F.col("shard")))
        right = F.zip_with("quotas", "_left", lambda q, x: q - x)
        children = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("_left").alias("quotas")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("quotas")))
        nodes = halved.select(F.explode(children).alias("_c")).select("_c.*")
        if (level + 1) % SPREAD == 0:
            nodes = nodes.repartition(partitions(quotas.sparkSession), "shard")
            if level + 1 < depth:  # saved, so that no plan holds more than SPREAD levels, however deep the tree
                nodes = saved(nodes, "op1-nodes")
    return nodes


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Water filling in closed form: sources sorted by ceiling per weight, the full ones are a prefix."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1).cast("double")
    s = sources.withColumn("_rank", rank).withColumn("weight", weight).withColumn("_most", F.col("size") * F.lit(float(most)))
    everything = Window.partitionBy()
    full = Window.orderBy(F.col("_most") / F.col("weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("size").over(everything) * share - F.coalesce(F.sum("_most").over(full), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    s = s.withColumn("_level", left / open_weight)
    # Below the first source that the level does not fill, the level no longer changes.
    s = s.withColumn("_open", F.col("_level") * F.col("weight") < F.col("_most"))
    s = s.withColumn("_fullness", F.row_number().over(Window.orderBy(F.col("_most") / F.col("weight"), "_rank")))
    water = F.min(F.when(F.col("_open"), F.struct("_fullness", "_level"))).over(everything)["_level"]
    s = s.withColumn("_water", water)
    target = F.coalesce(F.least(F.col("_most"), F.col("_water") * F.col("weight")), F.col("_most"))
    return s.select("source", "_sk", "size", "n_docs", "n_blocks", "weight", "_rank", target.alias("target"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_repeats: int = MOST_REPEATS,
    block_docs: int = BLOCK_DOCS,
    shard_words: int = SHARD_WORDS,
    seed: int = 0,
) -> Mix:
    """Mix all documents to weighted word targets; see the module and Mix.

    Null texts have size 0 and null sources are a source of their own. Rows equal in id, source and size
    are one unit, taken together; ties in a permutation are broken by the id. An empty table gives empty
    results; extra columns are ignored. Reruns agree whatever the partitioning.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    units = plain.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    units = saved(units.withColumn("_sk", key).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "source", "size")), "op1-units")
    words = F.col("size") * F.col("copies")
    counted = units.groupBy("source", "_sk").agg(F.sum(words).alias("size"), F.count("*").alias("n_docs"))
    counted = saved(counted.withColumn("n_blocks", F.ceil(F.col("n_docs") / block_docs).cast("long")), "op1-sources")
    sources = saved(_targets(counted, weights, share, most_repeats), "op1-targets")

    blocked = units.join(counted.select("_sk", "n_blocks"), "_sk").withColumn("block", F.pmod("_h", "n_blocks"))
    blocks = blocked.groupBy("_sk", "block").agg(F.sum(words).alias("_words"), F.lit(1).alias("_one"))
    blocks = blocks.withColumn("_perm", F.xxhash64(F.lit(seed + 1), "_sk", "block"))
    summed = prefix_sums(blocks, ["_sk", "_perm", "block"], {"_before": "_words", "_place": "_one"}, "op1-blocks")
    bases = summed.groupBy("_sk").agg(F.min("_before").alias("_b0"), F.min("_place").alias("_p0"), F.count("*").alias("_full"))
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    plan = sources.join(bases, "_sk").withColumn("_passes", passes).withColumn("_rest", F.col("target") - F.col("_passes") * F.col("size"))
    placed = summed.join(plan.select("_sk", "_b0", "_p0", "_full", "_passes", "_rest"), "_sk")
    placed = placed.withColumn("_before", F.col("_before") - F.col("_b0")).withColumn("_place", F.col("_place") - F.col("_p0"))
    part = F.when((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest")), F.col("_rest") - F.col("_before"))
    placed = placed.withColumn("_part", part).withColumn("_whole", (F.col("_before") + F.col("_words") <= F.col("_rest")) & (F.col("_words") > 0))
    placed = saved(placed, "op1-placed")
    last = placed.groupBy("_sk").agg(F.sum(F.col("_whole").cast("long")).alias("_wholes"), F.max(F.col("_part").isNotNull()).alias("_broken"))
    # Blocks without words sort anywhere; a partial pass ends behind the last block that it reaches.
    reach = placed.where(F.col("_whole") | F.col("_part").isNotNull()).groupBy("_sk").agg((F.max("_place") + 1).alias("_reach"))
    quota = F.col("_passes") * F.col("_full") + F.coalesce("_reach", F.lit(0))
    quotas = saved(plan.join(last, "_sk").join(reach, "_sk", "left").withColumn("quota", quota.cast("long")), "op1-quotas")

    taken = quotas.agg(F.sum("target")).first()[0] or 0.0
    depth = max(0, math.ceil(math.log2(max(1.0, taken / shard_words))))
    root = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "quota"))), lambda x: x["quota"]).alias("quotas"))
    shards = saved(splitting_tree(root, depth, seed), "op1-tree")
    leaves = shards.select("shard", F.posexplode("quotas").alias("_i", "_n")).withColumn("_rank", F.col("_i") + 1)
    upto = F.sum("_n").over(Window.partitionBy("_rank").orderBy("shard"))
    ranges = leaves.withColumn("_to", upto).where("_n > 0").select("_rank", "shard", F.explode(F.sequence(F.col("_to") - F.col("_n"), F.col("_to") - 1)).alias("_draw"))
    ranges = ranges.join(quotas.select("_rank", "_sk", "_full", "_passes"), "_rank")
    ranges = ranges.withColumn("pass", F.floor(F.col("_draw") / F.col("_full")).cast("int")).withColumn("_place", F.col("_draw") % F.col("_full"))
    drawn = saved(ranges.join(placed.select("_sk", "_place", "block", "_part"), ["_sk", "_place"]).withColumn("_left", F.when(F.col("pass") == F.col("_passes"), F.col("_part"))), "op1-drawn")

    whole = blocked.join(drawn.where("_left IS NULL").select("_sk", "block", "pass", "shard"), ["_sk", "block"])
    some = blocked.join(drawn.where("_left IS NOT NULL").select("_sk", "block", "pass", "shard", "_left"), ["_sk", "block"])
    # A broken block holds some 32 units, hashed to it; in permuted order each is taken if it still fits.
    unit_row = F.struct("_h", "doc_id", "source", "size", "copies")
    some = some.groupBy("_sk", "block", "pass", "shard", "_left").agg(F.array_sort(F.collect_list(unit_row)).alias("_units"))
    kind = some.schema["_units"].dataType.simpleString()

    def fill(s: Column, x: Column) -> Column:
        need = (x["size"] * x["copies"]).cast("double")
        fits = (need > 0) & (need <= s["left"])
        return F.struct((s["left"] - F.when(fits, need).otherwise(0.0)).alias("left"), F.when(fits, F.concat(s["got"], F.array(x))).otherwise(s["got"]).alias("got"))

    filled = F.aggregate("_units", F.struct(F.col("_left").cast("double").alias("left"), F.array().cast(kind).alias("got")), fill, lambda s: s["got"])
    some = some.select("_sk", "block", "pass", "shard", F.explode(filled).alias("_u")).select("_sk", "block", "pass", "shard", "_u.*")
    columns = ["doc_id", "source", "size", "copies", "pass", "block", "shard", "_h"]
    draws = whole.select(*columns).unionByName(some.select(*columns)).where("size > 0")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "_h", "pass", "shard"), "_h", "doc_id", "pass")
    draws = saved(draws.withColumn("position", F.row_number().over(local)).drop("_h"), "op1-draws")
    release(counted, summed, placed, quotas, drawn)
    return Mix(sources.drop("_rank"), units, draws, shards)


def taken_words(mixed: Mix) -> DataFrame:
    """Per row of the documents: doc_id, size, source_size, target, taken, and shards and positions of its draws, in the order of the passes.

    Rows never drawn, null and empty texts among them, have taken 0 and empty lists; null ids and sources are kept, and rows equal in
    id, source and size have equal results; an empty table gives an empty result.
    """
    place = F.array_sort(F.collect_list(F.struct("pass", "shard", "position"))).alias("_places")  # at most MOST_REPEATS and one
    drawn = mixed.draws.select(F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "pass", "shard", "position")
    drawn = drawn.groupBy("_doc_id", "_source", "_size").agg(place)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    out = mixed.units.join(drawn, same, "left").select("doc_id", "_sk", "size", "copies", F.coalesce("_places", F.array().cast("array<struct<pass:int,shard:bigint,position:int>>")).alias("_places"))
    out = out.join(mixed.sources.select("_sk", F.col("size").alias("source_size"), "target"), "_sk")
    out = out.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("doc_id", "size", "source_size", "target", (F.size("_places") * F.col("size")).cast("long").alias("taken"), F.col("_places.shard").alias("shards"), F.col("_places.position").alias("positions"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", places: bool = False, **options) -> DataFrame:
    """The mix itself: rows of docs with their columns, as often as they are drawn; rows never drawn, null and empty texts among them, go.

    Rows are dealt to partitions by a hash, so that no source stays together, and a partition's rows stand in the order of shard and
    position: a file written from it is a fair part of the mix in its order. With `places` the columns shard and position are
    added, in place of any so named. Null ids and sources are kept, repeated rows are drawn together; an empty table gives an
    empty result; extra columns, whatever their names, are carried along.
    """
    draws = mix(docs, text, source, doc_id, **options).draws.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "shard", "position")
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(doc_id).alias("_id"), F.col(source).alias("_source"), word_count(text).alias("_size"))
    same = F.col("_id").eqNullSafe(F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))
    # A merge join at every size: it is what deals the rows by a hash, and Spark can split a unit with many copies.
    drawn = sized.join(draws.hint("merge"), same).select("_row", "shard", "position").sortWithinPartitions("shard", "position")
    rest = [f"_row.`{c}`" for c in docs.columns if not (places and c in ("shard", "position"))]
    return drawn.select(*rest, *(["shard", "position"] if places else []))
