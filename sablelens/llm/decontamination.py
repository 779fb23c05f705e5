"""Benchmark decontamination by spaced seeds.

A seed is the hash of the tokens that a fixed mask selects in a window; tokens under the mask's zeros may differ.
The seeds of all windows of all documents meet those of the benchmark, which gives diagonals (document, item,
offset) where the two may run in parallel. Around each diagonal the tokens are compared one by one: it is an
overlap if in some stretch of min(STRETCH, length of the item) tokens at least AGREE of them are equal, wherever
the substitutions stand. An item that is shorter than the longest mask is one seed, all of its tokens in a row; one of fewer
than LEAST tokens, which stand in many clean texts, is an overlap only with a document of these very tokens and no others.

All of it is DataFrame expressions. The benchmark's seeds are broadcast only in portions of a checked number of rows;
a benchmark with more is searched for portion by portion. Diagonals are rows, joined to the tokens of their documents by key,
so that a document with many is no larger a row than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablelens.functions.spans import bound, running_sums
from sablelens.llm.common import release, saved, text_or_empty

#: Masks over consecutive tokens; 1 counts. Each tolerates substitutions at its zeros.
MASKS = ("1101011", "11001101", "110100011")
STRETCH, AGREE = 20, 0.8
#: Tokens of the shortest item that is looked for inside documents.
LEAST = 5
#: Rows of benchmark seeds in a broadcast, of 8 bytes each.
BROADCAST_SEEDS = 1_000_000
LONGEST = max(map(len, MASKS))
#: Scripts without spaces between words (Thai, Lao, Burmese, Khmer, Japanese, Chinese), and what any of them lies in.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"
BEYOND = r"[\x{0E00}-\x{3FFFF}]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; each character of a script without spaces is a token."""
    low = F.lower(text)
    spaced = F.when(low.rlike(BEYOND), F.regexp_replace(low, UNSPACED, " $0 ")).otherwise(low)
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")


def _windows(size: Column, mask: str) -> Column:
    return F.greatest(size - len(mask) + 1, F.lit(0))


def _seeds_of(mask: str) -> Column:
    places = [k for k, bit in enumerate(mask) if bit == "1"]
    windows = _windows(F.size("_hashes"), mask)
    begins = F.when(windows > 0, F.sequence(F.lit(0), windows - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(begins, lambda i: F.xxhash64(F.lit(mask), *[F.get(F.col("_hashes"), i + k) for k in places]))


def _seeded(rows: DataFrame, carry: list[str], text: str, masks: tuple[str, ...]) -> DataFrame:
    """carry, _size, _at, seed: a row for each seed of each text, those of the first mask by position, then of the next."""
    hashed = rows.select(*carry, F.transform(tokens(text_or_empty(text)), lambda t: F.xxhash64(t)).alias("_hashes"))
    sized = hashed.select(*carry, F.size("_hashes").alias("_size"), F.concat(*(_seeds_of(m) for m in masks)).alias("_seeds"))
    # The outer form: for the plain one Spark puts a filter below that works the seeds out all over again.
    return sized.select(*carry, "_size", F.posexplode_outer("_seeds").alias("_at", "seed"))


def _placed(seeded: DataFrame, masks: tuple[str, ...], *columns: str) -> DataFrame:
    """From the position in the list of seeds to the number of the mask and the window's first token."""
    before, place, number = F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, m in enumerate(masks):
        here = place.isNull() & (F.col("_at") < before + _windows(F.col("_size"), m))
        place, number = F.when(here, F.col("_at") - before).otherwise(place), F.when(here, F.lit(k)).otherwise(number)
        before = before + _windows(F.col("_size"), m)
    return seeded.select(*columns, place.alias("place"), number.alias("mask"))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """All verified overlaps of documents and benchmark items: (_key, doc_id, item_id, doc_token, item_token, agreeing, compared), and the rows.

    The second table is docs as saved, (_key, _row). Null texts count as empty; items without a token are not searched
    for; null ids are kept; repeated rows and items each have their overlaps. Empty tables give empty results;
    extra columns, whatever their names, are carried in the rows alone.
    """
    rows = saved(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), "op8-rows")
    items = benchmark.select(F.monotonically_increasing_id().alias("_item"), F.col(item_id).alias("item_id"), tokens(text_or_empty(item_text)).alias("_item_tokens"), F.col(item_text).alias("_item_text"))
    items = saved(items.where(F.size("_item_tokens") > 0).withColumn("_n", F.size("_item_tokens")), "op8-items")
    # At most one more mask for each length below the longest mask's, and only for those that there are.
    short = tuple("1" * r["_n"] for r in items.where(F.col("_n") < LONGEST).select("_n").distinct().orderBy("_n").collect())
    masks = MASKS + short
    wanted = _placed(_seeded(items, ["_item", "_n"], "_item_text", masks), masks, "_item", "_n", "seed").where("seed IS NOT NULL")
    own = F.when(F.col("_n") >= LONGEST, F.col("mask") < len(MASKS)).otherwise((F.col("mask") >= len(MASKS)) & F.element_at(F.array(*(F.lit(len(m)) for m in masks)), F.col("mask") + 1).eqNullSafe(F.col("_n")))
    wanted = saved(wanted.where(own).withColumnRenamed("place", "_item_place"), "op8-seeds")
    distinct = saved(wanted.select("seed").distinct(), "op8-wanted")
    portions = max(1, -(-distinct.count() // BROADCAST_SEEDS))
    texts = rows.select("_key", F.col(f"_row.`{text}`").alias("_text"))
    probes = _seeded(texts, ["_key"], "_text", masks)
    hits = None
    for k in range(portions):
        part = distinct.where(F.pmod("seed", F.lit(portions)) == k)
        met = _placed(probes.join(F.broadcast(part), "seed", "left_semi"), masks, "_key", "_size", "seed")
        hits = met if hits is None else hits.unionByName(met)
    hits = saved(hits, "op8-hits")
    # One row per diagonal: seeds of a parallel run all lie on it.
    met = hits.join(wanted.select("_item", "_n", "seed", "_item_place"), "seed").where((F.col("_n") >= LEAST) | (F.col("_size") == F.col("_n")))
    diagonals = saved(met.select("_key", "_item", "_n", (F.col("place") - F.col("_item_place")).alias("shift")).distinct(), "op8-diagonals")
    documents = diagonals.select("_key").distinct()
    tokened = saved(texts.join(documents, "_key", "left_semi").select("_key", tokens(text_or_empty("_text")).alias("_tokens")), "op8-tokens")
    # The part of the document beside the item; the item's own first tokens may lie before the document begins.
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    beside = F.slice(F.col("_tokens"), F.col("shift") + skipped + 1, F.col("_n") - skipped)
    beside = diagonals.join(tokened, "_key").select("_key", "_item", "shift", skipped.alias("skipped"), beside.alias("beside"))
    faced = beside.join(items.select("_item", "item_id", "_item_tokens"), "_item")
    equal = F.zip_with("beside", F.slice("_item_tokens", F.col("skipped") + 1, F.greatest(F.size("beside"), F.lit(1))), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    need = F.least(F.lit(STRETCH), F.size("_item_tokens"))
    faced = faced.where(F.size("beside") >= need).withColumn("_equal", equal).withColumn("compared", need)
    # The sums of all stretches, as differences of running sums.
    upto = F.concat(running_sums(F.col("_equal")), F.array(F.aggregate("_equal", F.lit(0), lambda s, x: s + x)))
    starts = F.sequence(F.lit(0), F.size("_equal") - F.col("compared"))
    stretches = lambda u: F.transform(starts, lambda i: F.struct((F.get(u, i + F.col("compared")) - F.get(u, i)).alias("agreeing"), (-i).alias("_back")))
    best = faced.withColumn("_best", F.array_max(bound(upto, stretches))).where(F.col("_best.agreeing") >= F.ceil(F.col("compared") * AGREE))
    first = F.col("skipped") - F.col("_best._back")
    ids = rows.select("_key", F.col(f"_row.`{doc_id}`").alias("doc_id"))
    verified = saved(best.select("_key", "_item", "item_id", (F.col("shift") + first).alias("doc_token"), first.alias("item_token"), F.col("_best.agreeing").alias("agreeing"), "compared"), "op8-verified")
    release(wanted, distinct, hits, diagonals, tokened, items)
    return verified.join(ids, "_key").select("_key", "doc_id", "_item", "item_id", "doc_token", "item_token", "agreeing", "compared"), rows


def contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, overlaps, and the best one's doc_token, item_token, agreeing, compared.

    Of equally good overlaps the first in the document counts. Nulls, repeated rows and empty tables are as in `overlaps`.
    """
    found, _ = overlaps(docs, benchmark, **names)
    best = F.max(F.struct("agreeing", (-F.col("doc_token")).alias("back"), (-F.col("item_token")).alias("item_back"), "compared")).alias("_best")
    out = found.groupBy("_key", "_item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.count("*").alias("overlaps"), best)
    return out.select(
        "doc_id", "item_id", "overlaps", (-F.col("_best.back")).alias("doc_token"), (-F.col("_best.item_back")).alias("item_token"), F.col("_best.agreeing").alias("agreeing"), F.col("_best.compared").alias("compared")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """docs without those that overlap the benchmark, its columns unchanged; documents without a text stay, and so do all of them where the benchmark is empty."""
    found, rows = overlaps(docs, benchmark, **names)
    bad = saved(found.select("_key").distinct(), "op8-bad")
    return rows.join(bad, "_key", "left_anti").select("_row.*")
