"""Format-preserving pseudonyms for personal data.

E-mail addresses, IP addresses, telephone numbers, social-security numbers, card and account numbers and dates
are found, validated and replaced by others of the same kind and format. A value is read as a number of a domain
that is exactly the set of valid values, split into two parts, and run through a keyed Feistel network on them: a
permutation, so that equal values get equal pseudonyms in all documents and different values different ones. Separators
and case stay; a card's check digit is made anew.

All of it is DataFrame expressions: one regular expression finds the candidates and their places, and only the few matches go
through the network. Spans are worked out in time in proportion to the matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablelens.functions.spans import SPANS, bound, match_spans, running_sums
from sablelens.llm.common import text_or_empty

KEY = "sablelens"
ROUNDS = 8

# What candidates look like, the most specific first. A domain has at most 127 labels.
EMAIL = r"(?<![A-Za-z0-9._%+\p{L}-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}(?![A-Za-z0-9-])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/]|[.-]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
TEN_DIGITS = r"(?<![\d.-])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{3}\)[\x20]?|\d{3}[\x20.-])\d{3}[\x20.-]\d{4}(?![\d]|[.-]\d)"
#: A plus sign and 8 to 15 digits; five pairs; or an area code of 3 to 5 digits and two groups, these with the 0 of national calls.
ABROAD = r"(?<![\w.+-])\+\d(?:[\x20.-]?(?:\(0\)\x20?)?\d){7,14}(?![\d]|[.-]\d)"
NATIONAL = r"(?<![\d.-])0\d(?:(?:\x20\d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4}|\d{1,3}[\x20-]\d{3,4}[\x20-]\d{3,4})(?![\d]|[.-]\d)"
PHONE = f"(?:{TEN_DIGITS})|(?:{ABROAD})|(?:{NATIONAL})"
#: Country codes, those of one and two digits first.
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
NUMBER = r"(?<![\d.,-])\d(?:[\x20-]?\d){12,18}(?![\d]|[.,-]\d)"
KINDS = {"email": EMAIL, "ip": IP, "date": DATE, "ssn": SSN, "phone": PHONE, "number": NUMBER}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A cheap sign that a text may hold any of them.
SIGN = r"@|\d[^\p{L}]{4}"
#: The Gregorian calendar repeats after 146,097 = 189 * 773 days; the cycle used begins here.
CYCLE_START, CYCLE_A, CYCLE_B = "1800-01-01", 189, 773
#: Days 13 and later of its months: 146,097 - 4800 * 12 = 9 * 9833.
LATE_A, LATE_B = 9, 9833
DATE_FORMATS = {"^....-": "yyyy-MM-dd", "/": "MM/dd/yyyy", r"\.": "dd.MM.yyyy"}


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column, key: str) -> Column:
    """struct(a, b) permuted within [0, size_a) x [0, size_b) by ROUNDS keyed rounds; tweak names the domain."""

    def turn(s: Column, r: Column) -> Column:
        mixed = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, r, s["b"]), 256), 1, 15), 16, 10).cast("long")
        moved = F.pmod(s["a"] + F.pmod(mixed, s["m"]), s["m"])
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["n"].alias("m"), s["m"].alias("n"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), size_a.cast("long").alias("m"), size_b.cast("long").alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _permuted(digits: Column, tweak: str, key: str) -> Column:
    """A string of at most 18 digits to another of the same length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    number = lambda d: F.coalesce(d.try_cast("long"), F.lit(0))
    size = lambda k: F.round(F.pow(F.lit(10.0), k)).cast("long")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half)
    tag = F.concat(F.lit(tweak), F.lit(":"), n.cast("string"))
    moved = feistel(number(left), number(right), size(half), size(n - half), tag, key)
    text = lambda x, length: F.lpad(x.cast("string"), length, "0")
    return bound(moved, lambda m: F.concat(F.when(half > 0, text(m["a"], half)).otherwise(""), text(m["b"], n - half)))


#: Symbols of names, and digits of a round's hash that give one of them: 16 ** 4 numbers for 36.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyz"
HASH_DIGITS = 4


def _permuted_name(symbols: Column, tweak: str, key: str) -> Column:
    """A string of a-z and 0-9 of any length to another of the same length, as an array: a Feistel network whose rounds
    add, symbol by symbol, the keyed hash of one half to the other."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    each = 128 // HASH_DIGITS

    def added(left: Column, right: Column, r: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(tweak), F.size(symbols), r, F.array_join(right, ","))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(left) / each).cast("int")), lambda k: F.sha2(F.concat_ws("|", seed, k), 512))
        stream = lambda h: F.transform(left, lambda x, i: ((x + F.conv(F.substring(F.element_at(h, F.floor(i / each).cast("int") + 1), i % each * HASH_DIGITS + 1, F.lit(HASH_DIGITS)), 16, 10).cast("int")) % len(SYMBOLS)).cast("int"))
        return bound(blocks, stream)

    numbers = F.transform(symbols, lambda c: (F.call_function("locate", c, F.lit(SYMBOLS)) - 1).cast("int"))
    start = F.struct(F.slice(numbers, F.lit(1), half).alias("a"), F.slice(numbers, half + 1, F.size(symbols)).alias("b"))
    turn = lambda s, r: F.struct(s["b"].alias("a"), added(s["a"], s["b"], r).alias("b"))
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))
    return F.transform(moved, lambda x: F.substring(F.lit(SYMBOLS), x + 1, F.lit(1)))


def _put_back(shape: Column, symbols: Column, pattern: str) -> Column:
    """shape with its characters that match pattern replaced, in order, by the array's; capitals stay capitals."""

    def placed(cs: Column) -> Column:
        before = running_sums(F.transform(cs, lambda c: c.rlike(pattern).cast("int")))
        new = lambda c, k: F.when(c.rlike("[A-Z]"), F.upper(F.element_at(symbols, k + 1))).otherwise(F.element_at(symbols, k + 1))
        return F.array_join(F.zip_with(cs, before, lambda c, k: F.when(c.rlike(pattern), new(c, k)).otherwise(c)), "")

    return bound(_characters(shape), placed)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(body: Column) -> Column:
    """The check digit that makes body valid."""
    n = F.length(body)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(body, i, F.lit(1)).cast("int")
        twice = d * 2
        return s + F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def _number(m: Column, key: str) -> Column:
    """Card and account numbers: all digits but the last are permuted, the last keeps its distance from the check digit, so that valid stays valid."""
    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    distance = F.pmod(F.substring(digits, F.length(digits), F.lit(1)).cast("int") - luhn(body), F.lit(10))
    new = bound(_permuted(body, "number", key), lambda b: F.concat(b, F.pmod(luhn(b) + distance, F.lit(10)).cast("string")))
    return bound(new, lambda x: _put_back(m, _characters(x), "[0-9]"))


def _phone(m: Column, key: str) -> Column:
    """The digits behind the country code or the 0 of national calls: the last ten where they are grouped by 3, 3 and 4."""
    digits = _digits(m)
    ten = m.rlike(rf"\A(?:{TEN_DIGITS})\z")
    abroad = F.length(F.regexp_extract(digits, COUNTRY, 1))
    country = F.when(ten, F.length(digits) - 10).when(m.startswith("+"), abroad).otherwise(1)
    new = F.concat(F.substring(digits, F.lit(1), country), _permuted(F.substring(digits, country + 1, F.length(digits) - country), "phone", key))
    return bound(new, lambda x: _put_back(m, _characters(x), "[0-9]"))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99 and serials 0001-9999 are valid."""
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    a = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

    def back(p: Column) -> Column:
        zone = F.floor(p["a"] / 99)
        parts = (F.lpad((zone + F.when(zone >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))
        return F.concat_ws("-", *parts)

    return F.when(valid, bound(feistel(a, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key), back))


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    octet = lambda k: parts[k].cast("int")
    valid = F.forall(parts, lambda p: p.cast("int") <= 255)
    moved = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), F.lit("ip"), key)
    return F.when(valid, bound(moved, lambda p: F.concat_ws(".", F.floor(p["a"] / 256).cast("string"), (p["a"] % 256).cast("string"), F.floor(p["b"] / 256).cast("string"), (p["b"] % 256).cast("string"))))


def _date(m: Column, key: str) -> Column:
    """Dates of the 400-year cycle. With slashes the month comes first, or the day where that is impossible."""
    out = F.lit(None).cast("string")
    for sign, form in DATE_FORMATS.items():
        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(form))), F.lit(CYCLE_START).cast("date"))
        moved = feistel(F.floor(day / CYCLE_B), day % CYCLE_B, F.lit(CYCLE_A), F.lit(CYCLE_B), F.lit("date"), key)
        out = F.when(m.rlike(sign), F.when(day.between(0, CYCLE_A * CYCLE_B - 1), _as_date(moved, form))).otherwise(out)
    return F.when(m.rlike("^(1[3-9]|[23].)/"), _day_first(m, key)).otherwise(out)


def _day_first(m: Column, key: str) -> Column:
    """dd/MM/yyyy from day 13 on, among its like, so that no pseudonym can be read with the month first."""
    start = F.lit(CYCLE_START).cast("date")
    day = F.to_date(F.try_to_timestamp(m, F.lit("dd/MM/yyyy")))

    def moved(d: Column) -> Column:
        # Every month lacks its first twelve days.
        place = F.datediff(d, start) - 12 * ((F.year(d) - 1800) * 12 + F.month(d))
        return bound(feistel(F.floor(place / LATE_B), place % LATE_B, F.lit(LATE_A), F.lit(LATE_B), F.lit("late"), key), lambda p: back((p["a"] * LATE_B + p["b"]).cast("int")))

    def back(place: Column) -> Column:
        near = F.floor(place * 4800 / (LATE_A * LATE_B)).cast("int")
        months = F.sequence(F.greatest(near - 3, F.lit(0)), near + 3)
        begun = F.filter(months, lambda k: F.datediff(F.add_months(start, k), start) - 12 * k <= place)
        return F.date_format(F.date_add(start, place + 12 * (F.array_max(begun) + 1)), "dd/MM/yyyy")

    return F.when(F.year(day).between(1800, 2199), bound(day, moved))


def _as_date(parts: Column, form: str) -> Column:
    return bound(parts, lambda p: F.date_format(F.date_add(F.lit(CYCLE_START).cast("date"), (p["a"] * CYCLE_B + p["b"]).cast("int")), form))


def _email(m: Column, key: str) -> Column:
    """The letters a-z and digits before the @ are permuted among those of their number. Other letters and the domain stay."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    symbols = _characters(F.regexp_replace(F.lower(local), "[^a-z0-9]", ""))
    made = bound(symbols, lambda s: F.when(F.size(s) == 0, local).otherwise(bound(_permuted_name(s, "email", key), lambda x: _put_back(local, x, "[a-zA-Z0-9]"))))
    return F.concat(made, F.lit("@"), domain)


#: A value to its pseudonym, null where the value isn't valid.
MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "number": _number}


def _replaced(m: Column, key: str) -> Column:
    """kind, value and pseudonym of a match, and whether it is valid; its own pseudonym where it isn't."""
    kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        whole = m.rlike(rf"\A(?:{pattern})\z")
        kind, new = F.when(whole, F.lit(name)).otherwise(kind), F.when(whole, MAKERS[name](m, key)).otherwise(new)
    return bound(new, lambda n: F.struct(kind.alias("kind"), m.alias("value"), F.coalesce(n, m).alias("pseudonym"), n.isNotNull().alias("valid")))


def pseudonymised(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with its text column rewritten and a column pii, an array of (kind, start, end, pseudonym), in place of any so named.

    Spans are code points of the old text, ends exclusive; only an IP address may change its length. Null texts stay null, with no spans;
    a text without personal data stays as it is, byte for byte. Ids, repeated rows and extra columns, whatever their names, don't
    matter to it; an empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in (text, "pii")]
    body = F.coalesce("_text", F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row") if rest else F.lit(None).alias("_row"), F.col(f"`{text}`").alias("_text"))
    found = F.when(body.rlike(SIGN), match_spans(body, ANY)).otherwise(F.array().cast(SPANS))
    made = lambda s: bound(_replaced(s["value"], key), lambda r: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["gap"].alias("gap"), r.alias("r")))
    rows = rows.withColumn("_found", F.transform(found, made))
    pieces = F.transform("_found", lambda s: F.concat(s["gap"], s["r"]["pseudonym"]))
    rest_of_it = F.substring(body, F.element_at("_found", -1)["end"] + 1, F.length(body))
    joined = F.concat(F.array_join(pieces, ""), rest_of_it)
    valid = F.filter("_found", lambda s: s["r"]["valid"])
    pii = F.transform(valid, lambda s: F.struct(s["r"]["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["r"]["pseudonym"].alias("pseudonym")))
    return rows.select(*([F.col("_row.*")] if rest else []), F.when(F.size("_found") > 0, joined).otherwise(F.col("_text")).alias(text), pii.alias("pii"))


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", key: str = KEY) -> DataFrame:
    """One row per row of docs that holds personal data: doc_id, n_found, one count per kind, spans, text (with pseudonyms).

    Null texts hold none; null ids are kept; repeated rows are each reported; an empty table gives an empty result; extra
    columns are ignored.
    """
    made = pseudonymised(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", key).where(F.size("pii") > 0)
    return made.select(
        "doc_id",
        F.size("pii").cast("long").alias("n_found"),
        *(_kind_count(k).alias(f"n_{k}") for k in KINDS),
        F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans"),
        "text",
    )


def _kind_count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
