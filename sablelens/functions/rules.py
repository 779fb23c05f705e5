"""Detection rules and the scans that apply them to text columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablelens.functions.spans import bound, match_spans


@dataclass(frozen=True)
class Rule:
    pattern: str
    label: str


# Patterns and labels of the built-in rules, in the order in which they are applied.
IDENTIFIERS = (
    Rule(r"AS-\d\d-\d{3,}", "Accession_AS"),
    Rule(r"AC-\d\d-\d{3,}", "Accession_AC"),
    Rule(r"SP-\d\d-\d{3,}", "Accession_SP"),
    Rule(r"AP-\d\d-\d{3,}", "Accession_AP"),
    Rule(r"CY-\d\d-\d{3,}", "Accession_CY"),
    Rule(r"(?<![A-Z])H-\d\d-\d{3,}", "Accession_H"),
    Rule(r"(?<![A-Z])S-\d\d-\d{3,}", "Accession_S"),
    Rule(r"AS-(?:19|20)\d{2}-\d{3,}", "Accession_AS4"),
    Rule(r"AC-(?:19|20)\d{2}-\d{3,}", "Accession_AC4"),
    Rule(r"SP-(?:19|20)\d{2}-\d{3,}", "Accession_SP4"),
    Rule(r"AP-(?:19|20)\d{2}-\d{3,}", "Accession_AP4"),
    Rule(r"CY-(?:19|20)\d{2}-\d{3,}", "Accession_CY4"),
    Rule(r"CH\d{5,}", "Accession_CH"),
    Rule(r"00000AS\d+", "Accession_Padded"),
    Rule(r"MRN[-:# ]?\d{5,}", "MRN_Pattern"),
    Rule(r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", "SSN_Pattern"),
    Rule(r"DOB[-_:# ]?(?:19|20)\d{2}[-/]?\d{2}[-/]?\d{2}", "DOB_Pattern"),
)
DATES = (
    Rule(r"(?:19|20)\d{2}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}", "DateTime_TIFF"),
    Rule(r"(?:19|20)\d{2}/\d{2}/\d{2}", "DateTime_Slash"),
    Rule(r"(?:19|20)\d{2}-\d{2}-\d{2}", "DateTime_ISO"),
)
#: Dates that mean "removed".
DATE_SENTINELS = ("1900:01:01", "0000:00:00")
#: Fixed value: only so many leading bytes of a TIFF-based file are searched by rules.
HEAD_BYTES = 1_000_000
#: As many bytes as a binary value can hold.
WHOLE = (1 << 31) - 1


@dataclass(frozen=True)
class RuleSet:
    """Rules for bytes, strings and dates; from_json adds a file's rules behind the built-in ones."""

    byte: tuple[Rule, ...] = IDENTIFIERS
    string: tuple[Rule, ...] = IDENTIFIERS
    date: tuple[Rule, ...] = DATES

    @staticmethod
    def from_json(text: str) -> RuleSet:
        """{"byte_patterns": [[pattern, label], ...], "string_patterns": ..., "date_patterns": ...}; absent lists add nothing."""
        spec = json.loads(text)
        more = {k: tuple(Rule(*pair) for pair in spec.get(f"{k}_patterns", ())) for k in ("byte", "string", "date")}
        return RuleSet(*((*base, *more[k]) for k, base in (("byte", IDENTIFIERS), ("string", IDENTIFIERS), ("date", DATES))))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(kind, i, r.pattern, r.label) for kind in ("byte", "string", "date") for i, r in enumerate(getattr(self, kind))]
        return spark.createDataFrame(rows, "kind string, ord int, pattern string, label string")


#: A negative look-behind, and the text behind it that a pattern begins with: letters, digits and signs that mean themselves.
_BEGINS = re.compile(r"(?:\(\?<!(?:[^()\[\]\\]|\\.|\[(?:[^\]\\]|\\.)*\])*\))?([\w\-:@/%,;=\x20]+)(?![\w\-:@/%,;=\x20])(.?)", re.ASCII | re.DOTALL)


def needed(pattern: str) -> str:
    """A text that every match of the pattern begins with; empty where none is certain."""
    found = _BEGINS.match(pattern)
    if found is None or "|" in re.sub(r"\((?:[^()\\]|\\.)*\)", "", pattern):
        return ""
    return found[1][:-1] if found[2] in tuple("?*{") else found[1]


MATCHES = "array<struct<ord:int,label:string,start:int,length:int,value:string>>"


def matches(text: Column, rules: tuple[Rule, ...], unicode: bool = True, to_nul: bool = False, drop_blank: bool = False) -> Column:
    """All matches of all rules in rule order as an array of structs.

    A text is searched by a rule only if it holds what the rule's matches begin with, by patterns that are compiled once, and only
    for places by the rules that match. to_nul extends a match to the next NUL character; drop_blank leaves out those of X alone.
    """
    if not rules:
        return F.array().cast(MATCHES)
    flags = "(?U)" if unicode else ""
    table = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(r.label).alias("label"), F.lit(flags + r.pattern).alias("pattern")) for i, r in enumerate(rules)))

    def of_rule(t: Column, r: Column) -> Column:
        def row(m: Column) -> Column:
            length = m["end"] - m["start"]
            if to_nul:
                nul = F.call_function("locate", F.lit("\0"), t, m["start"] + 1)
                length = F.when(nul > 0, nul - 1 - m["start"]).otherwise(length)
            value = F.substring(t, m["start"] + 1, length) if to_nul else m["value"]
            return F.struct(r["ord"].alias("ord"), r["label"].alias("label"), m["start"].alias("start"), length.alias("length"), value.alias("value"))

        return F.transform(match_spans(t, r["pattern"]), row)

    def of(t: Column, r: Rule) -> Column:
        begin, match = needed(r.pattern), t.rlike(flags + r.pattern)
        return t.contains(begin) & match if begin else match

    hit = lambda t: F.array(*(of(t, r) for r in rules))
    live = lambda t: bound(hit(t), lambda h: F.filter(table, lambda r: F.get(h, r["ord"])))
    searched = lambda t: F.flatten(F.transform(live(t), lambda r: of_rule(t, r)))
    found = bound(text, searched)
    return F.filter(found, lambda m: ~m["value"].rlike("^X+$")) if drop_blank else found


def scan_strings(df: DataFrame, keys: list[str], text: str, rules: tuple[Rule, ...] = IDENTIFIERS) -> DataFrame:
    """keys, ord, label, start, length, value: a row per match of a string rule."""
    return _exploded(df, keys, matches(F.col(text), rules))


def scan_bytes(df: DataFrame, keys: list[str], content: str, rules: tuple[Rule, ...] = IDENTIFIERS, head: int = HEAD_BYTES, skip: DataFrame | None = None) -> DataFrame:
    """The same over the first `head` bytes of a binary column, read as ISO-8859-1, so that a character is a byte.

    Matches reach to the next NUL. skip holds keys and `start` of offsets that are known already; matches there go.
    """
    text = F.decode(F.substring(F.col(content), 1, head), "ISO-8859-1")
    found = _exploded(df, keys, matches(text, rules, unicode=False, to_nul=True, drop_blank=True))
    return found if skip is None else found.join(skip, [*keys, "start"], "left_anti")


def scan_dates(df: DataFrame, keys: list[str], text: str, rules: tuple[Rule, ...] = DATES) -> DataFrame:
    """Dates that are not sentinels."""
    found = _exploded(df, keys, matches(F.col(text), rules, unicode=False))
    return found.where(~is_sentinel(F.col("value")))


def is_sentinel(value: Column) -> Column:
    out = F.lit(False)
    for s in DATE_SENTINELS:
        out = out | value.contains(s)
    return out


def _exploded(df: DataFrame, keys: list[str], found: Column) -> DataFrame:
    # The outer form keeps Spark from adding a filter below that evaluates every rule a second time.
    rows = df.select(*keys, F.explode_outer(found).alias("_m")).where("_m IS NOT NULL")
    return rows.select(*keys, "_m.*")
