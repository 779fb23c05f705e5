"""Secret scans with multipart credential linking.

Certain secrets (base kinds) are reported as they stand. Weak candidates, which alone would be noise, are
reported only where complementary parts of one credential co-occur within their scope, SCOPE code points on either
side: an identifier or a secret needs both other roles (identifier, secret, endpoint) there, or a certain secret or
identifier that complements it. Parts are dealt to scope-wide bins and interval-joined with the bins on either side; each
bin is first reduced to its outermost parts of every role, certain ones apart, which is enough to tell whether any lies
within the distance, so that neither a document full of parts nor a hot one makes pairs.

One pass of JVM regular expressions reads the texts; all else works on narrow tables of spans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablelens.functions.spans import match_spans
from sablelens.llm.common import saved, text_or_empty

# The base kinds with the least length of what they must hold, in the order of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
KINDS = ("assign", "access", "hex")

#: Weak candidates by role: kind, pattern. An identifier or a secret of these is never reported alone.
WEAK = {
    "weak_id": ("id", r"""(?i)\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""),
    "weak_secret": ("secret", r"""(?i)\b(?:pass|pwd|pw|key|auth|credential|private_?key|secret_?key|access_?token)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    "weak_blob": ("secret", r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"""),
    "endpoint": ("endpoint", r"""(?i)\b(?:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ssh)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}"""),
}
#: What the value of a candidate of that kind must hold besides, wherever in it.
HOLDS = {"weak_blob": ("[0-9]", "[A-Z]", "[a-z]")}
#: The roles of certain kinds.
CERTAIN = {"access": "id", "assign": "secret", "hex": "secret"}
#: A cheap sign that a text holds a weak part at all.
ANY_WEAK = r"(?i)[:=]|[A-Za-z0-9+/_-]{20}"
SCOPE = 400


NO_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _spans(text: Column, pattern: str, kind: str, holds: Callable[[Column], Column] | None = None) -> Column:
    """All matches, of those whose value holds what it must, as structs of kind, start, end."""
    found = match_spans(text, pattern)
    kept = F.filter(found, lambda m: holds(m["value"])) if holds else found
    return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _assigned(match: Column) -> Column:
    """Whether an assignment's value is long enough."""
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_VALUE


def _holding(kind: str) -> Callable[[Column], Column] | None:
    signs = HOLDS.get(kind, ())
    return (lambda value: reduce(Column.__and__, (value.rlike(sign) for sign in signs))) if signs else None


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    rank = F.array(*(F.lit(k) for k in (*KINDS, *WEAK)))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_linked, base (spans), linked (spans), base_sha256, spans.

    Null texts count as empty and have no spans; null ids are kept; repeated rows are each reported; an empty
    table gives an empty result; extra columns are ignored. Spans are in code points, the end exclusive.
    """
    body = text_or_empty(text)
    weak = [_spans(body, pattern, kind, _holding(kind)) for kind, (_, pattern) in WEAK.items()]
    scanned = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.monotonically_increasing_id().alias("_key"),
        _spans(body, ASSIGN, "assign", _assigned).alias("_assign"),
        _spans(body, ACCESS, "access", lambda value: F.length(value) >= ACCESS_LENGTH).alias("_access"),
        _spans(body, HEX, "hex").alias("_hex"),
        F.when(body.rlike(ANY_WEAK), F.concat(*weak)).otherwise(F.array().cast(NO_SPANS)).alias("_weak"),
    )
    scanned = saved(scanned, "op2-spans")

    role_of = {k: role for k, (role, _) in WEAK.items()} | CERTAIN
    roles = F.create_map(*(F.lit(x) for pair in role_of.items() for x in pair))
    parts = scanned.where(F.size("_weak") > 0).select("_key", F.explode(F.concat("_weak", "_assign", "_access", "_hex")).alias("_s"))
    parts = parts.select("_key", "_s", roles[F.col("_s.kind")].alias("role"), F.expr(f"_s.start div {scope}").alias("_bin"))
    # Per bin and role the outermost parts say whether any lies within the scope of a point in a neighbouring bin;
    # certain parts count under a role of their own as well.
    marked = F.when(F.col("_s.kind").isin(*CERTAIN), F.array("role", F.concat(F.lit("sure "), "role"))).otherwise(F.array("role"))
    bins = parts.select("_key", "_bin", F.explode(marked).alias("role"), "_s.start").groupBy("_key", "_bin", "role").agg(F.min("start").alias("_first"), F.max("start").alias("_last"))
    near = bins.select("_key", F.col("role").alias("_other"), "_first", "_last", F.explode(F.array(F.col("_bin") - 1, "_bin", F.col("_bin") + 1)).alias("_bin"), F.col("_bin").alias("_of"))
    asked = parts.where(F.col("_s.kind").isin(*WEAK) & (F.col("role") != "endpoint"))
    at = F.col("_s.start")
    within = F.when(F.col("_of") < F.col("_bin"), at - F.col("_last") <= scope).when(F.col("_of") > F.col("_bin"), F.col("_first") - at <= scope).otherwise(True)
    linked = asked.join(near, ["_key", "_bin"]).where(within).groupBy("_key", "role", "_s").agg(F.collect_set("_other").alias("_roles"))
    other = F.when(F.col("role") == "id", "secret").otherwise("id")
    whole = F.array_contains("_roles", other) & F.array_contains("_roles", F.lit("endpoint"))
    linked = linked.where(whole | F.array_contains("_roles", F.concat(F.lit("sure "), other)))
    found = linked.groupBy("_key").agg(F.collect_list("_s").alias("_linked"))
    none = F.array().cast(NO_SPANS)
    out = scanned.drop("_weak").join(found, "_key", "left").withColumn("linked", F.coalesce("_linked", none)).withColumn("base", F.concat("_assign", "_access", "_hex"))
    return out.select(
        "doc_id",
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        F.size("linked").cast("long").alias("n_linked"),
        "base",
        "linked",
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"),
    )
