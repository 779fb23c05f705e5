"""Positions of regular-expression matches in text columns, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed by one fold: a fold's list is copied at each step, so that its cost grows with the square.
CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _fold(sizes: Column) -> Column:
    """struct(at, got): the sum of an array of int, and its exclusive running sums."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("got"))
    return F.aggregate(sizes, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["got"], F.array(s["at"])).alias("got")))


def running_sums(sizes: Column) -> Column:
    """Exclusive running sums of an array of int, in time in proportion to its length for up to some millions of elements."""

    def chunked(xs: Column) -> Column:
        begins = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        parts = F.transform(begins, lambda k: _fold(F.slice(xs, k * CHUNK + 1, F.lit(CHUNK))))
        moved = lambda ps: F.zip_with(ps, _fold(F.transform(ps, lambda p: p["at"]))["got"], lambda p, base: F.transform(p["got"], lambda x: x + base))
        return bound(parts, lambda ps: F.flatten(moved(ps)))

    return bound(sizes, lambda xs: F.when(F.size(xs) <= CHUNK, _fold(xs)["got"]).otherwise(chunked(xs)))


SPANS = "array<struct<start:int,end:int,value:string,gap:string>>"


def match_spans(text: Column, pattern: str | Column) -> Column:
    """All leftmost non-overlapping matches as structs of start, end (code points, end exclusive), value and gap, the text since the match before.

    Positions come from the lengths of matches and gaps. A text without any match costs one search.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = bound(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("before"), F.length(m).alias("own"), m.alias("value"), g.alias("gap"))),
    )

    def placed(ps: Column) -> Column:
        begins = running_sums(F.transform(ps, lambda p: p["before"] + p["own"]))
        return F.zip_with(ps, begins, lambda p, at: F.struct((at + p["before"]).alias("start"), (at + p["before"] + p["own"]).alias("end"), p["value"].alias("value"), p["gap"].alias("gap")))

    return F.when(F.rlike(text, pattern), bound(parts, placed)).otherwise(F.array().cast(SPANS))
