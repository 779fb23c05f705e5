"""Scalar functions over tag values, names and key-value metadata, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sablelens.functions.spans import bound

# Suffixes by format, in the order in which formats are tried.
EXTENSIONS = {"ndpi": ("ndpi",), "svs": ("svs",), "mrxs": ("mrxs",), "bif": ("bif",), "scn": ("scn",), "dicom": ("dcm", "dicom"), "tiff": ("tif", "tiff")}
#: Fields that identify, by format.
SVS_FIELDS = ("ScanScope ID", "Filename", "Date", "Time", "User", "DSR ID")
NDPI_KEYS, NDPI_WORDS = ("Created", "Updated", "NDP.S/N", "Macro.S/N", "Firmware.Version"), ("User", "Name", "Operator")
XMP_ATTRIBUTES = ("BarCode1", "BarCode2", "BarCodeType1", "BarCodeType2", "ScanDate", "ScanTime", "BaseFileName", "UniqueID", "DeviceSerialNumber", "OperatorID", "PatientName", "CaseID", "SampleID", "LabelText", "Comment", "Description")
SCN_NAMES = ("barcode", "creationDate", "device", "model", "version", "slideName", "description", "user", "operator", "institution", "uniqueID", "serialNumber", "acquisitionDate", "acquisitionTime")
#: Names shown in reports.
FRIENDLY = {
    "NDPI_BARCODE": "Barcode",
    "NDPI_REFERENCE": "Reference",
    "NDPI_SERIAL_NUMBER": "Serial Number",
    "NDPI_SCANPROFILE": "Scan Profile",
    "NDPI_BARCODE_TYPE": "Barcode Type",
    "NDPI_FORMAT_FLAG": "Format Flag",
    "NDPI_SOURCELENS": "Source Lens",
    "NDPI_SCANNER_PROPS": "Scanner Properties",
    "DateTime": "Date/Time",
    "DateTimeOriginal": "Date/Time Original",
    "DateTimeDigitized": "Date/Time Digitized",
    "MacroImage": "Macro Image",
    "LabelImage": "Label Image",
    "ImageDescription": "Image Description",
    "Make": "Manufacturer",
    "Model": "Model",
    "Software": "Software",
    "Artist": "Artist",
    "HostComputer": "Computer Name",
    "ICCProfile": "ICC Color Profile",
    "XMP": "XMP Metadata",
    "UserComment": "User Comment",
    "ImageUniqueID": "Image Unique ID",
}


def first_of(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), otherwise)


def extension(name: Column) -> Column:
    """Lower-case suffix without its dot; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))


def stem(name: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def format_of(name: Column) -> Column:
    """Format by suffix, or unknown."""
    ext = extension(name)
    return first_of([(ext.isin(*exts), F.lit(kind)) for kind, exts in EXTENSIONS.items()], F.lit("unknown"))


def strip(value: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def all_x(value: Column) -> Column:
    return value.rlike("^X+$")


def date_removed(value: Column) -> Column:
    """A sentinel, or nothing but NUL and spaces."""
    return value.contains("1900:01:01") | value.contains("0000:00:00") | (F.regexp_replace(value, r"^[\x00 ]+|[\x00 ]+$", "") == "")


def mask_preview(value: Column) -> Column:
    """Four characters or fewer are all masked; of more, the first and last two stay."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))


def truncated(value: Column, most: int) -> Column:
    """At most `most` characters, the last three dots if any went."""
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most - 3)), F.lit("..."))).otherwise(value)


def printable_share(value: Column) -> Column:
    """Share of printable ASCII, TAB, LF and CR."""
    return F.length(F.regexp_replace(value, r"[^\x20-\x7E\t\n\r]", "")) / F.length(value)


def is_printable(value: Column) -> Column:
    """At least four characters of which three in four are printable."""
    return (F.length(value) >= 4) & (printable_share(value) >= 0.75)


def friendly_name(tag: Column) -> Column:
    """A tag's name for people: the fixed ones, then by prefix."""
    known = F.create_map(*(F.lit(x) for pair in FRIENDLY.items() for x in pair))
    rest = F.regexp_replace(tag, "^[^:]*:", "")
    named = lambda t: F.coalesce(F.try_element_at(known, t), t)
    return first_of(
        [
            (F.try_element_at(known, tag).isNotNull(), F.try_element_at(known, tag)),
            (tag.startswith("EXIF:"), F.concat(F.lit("EXIF: "), named(rest))),
            (tag.startswith("GPS:"), F.concat(F.lit("GPS: "), F.when(rest.startswith("GPS"), F.regexp_replace(rest, "GPS", "")).otherwise(rest))),
            (tag.startswith("NDPI_SCANNER_PROPS:"), F.concat(F.lit("Scanner: "), rest)),
            (tag.startswith("regex:") | tag.startswith("fallback:"), F.concat(F.lit("Pattern: "), rest)),
            (tag.contains(":"), F.regexp_replace(tag, "^([^:]*):", "$1: ")),
            (tag.startswith("NDPI_Tag_"), F.concat(F.lit("NDPI Tag "), F.regexp_replace(tag, "^NDPI_Tag_", ""))),
            (tag.startswith("NDPI_UNKNOWN_"), F.concat(F.lit("NDPI Tag "), F.regexp_replace(tag, "^NDPI_UNKNOWN_", ""))),
            (tag.startswith("Tag_"), F.concat(F.lit("Tag "), F.regexp_replace(tag, "^Tag_", ""))),
        ],
        tag,
    )


def replacement(source: Column) -> Column:
    """What a finding of that source was replaced with."""
    return F.when(source == "image_content", "Blank image (IFD unlinked)").when(source == "regex_scan", "Overwritten with padding bytes").otherwise("Cleared (null bytes)")


def image_kind(description: Column, thumbnails: bool = False) -> Column:
    """LabelImage, MacroImage or (where asked for) ThumbnailImage by an image's description; null for others."""
    low = F.lower(description)
    kind = F.when(low.contains("label"), "LabelImage").when(low.contains("macro"), "MacroImage")
    return kind.when(low.contains("thumbnail"), "ThumbnailImage") if thumbnails else kind


# SVS: pipe-separated `key = value` fields behind a free first part.


def svs_fields(description: Column) -> Column:
    """Array of (key, value), later repeats of a key replacing earlier ones in place of the last."""
    parts = F.filter(F.split(description, r"\|"), lambda p, i: (i > 0) & p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("key"), strip(F.regexp_replace(p, r"(?s)^[^=]*=", "")).alias("value")))
    last = lambda ps, keys: F.filter(ps, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))
    return bound(pairs, lambda ps: bound(F.transform(ps, lambda p: p["key"]), lambda keys: last(ps, keys)))


def svs_done(key: Column, value: Column) -> Column:
    bare = strip(value)
    return (bare == "") | all_x(bare) | (key == "Date") & (bare == "01/01/00") | (key == "Time") & (bare == "00:00:00")


def svs_findings(description: Column) -> Column:
    return F.filter(svs_fields(description), lambda f: f["key"].isin(*SVS_FIELDS) & ~svs_done(f["key"], f["value"]))


def svs_dated_findings(description: Column) -> Column:
    """svs_findings, and the date that means "removed" where other fields still identify: there it is the day of the scan, 1 January 2000."""
    named = F.filter(svs_fields(description), lambda f: f["key"].isin(*SVS_FIELDS))

    def found(fs: Column) -> Column:
        live = F.exists(fs, lambda f: ~svs_done(f["key"], f["value"]))
        return F.filter(fs, lambda f: ~svs_done(f["key"], f["value"]) | live & (f["key"] == "Date") & (f["value"] == "01/01/00"))

    return bound(named, found)


def svs_redacted(description: Column) -> Column:
    """Identifying fields replaced: dates and times by sentinels, others by as many X; cut or filled up to the old length by the writer."""

    def one(p: Column) -> Column:
        key, value = strip(F.substring_index(p, "=", 1)), strip(F.regexp_replace(p, r"(?s)^[^=]*=", ""))
        new = F.when(key == "Date", "01/01/00").when(key == "Time", "00:00:00").otherwise(F.repeat(F.lit("X"), F.length(value)))
        touched = p.contains("=") & key.isin(*SVS_FIELDS) & ~svs_done(key, value)
        return F.when(touched, F.concat(F.substring_index(p, "=", 1), F.lit("= "), new)).otherwise(p)

    return F.array_join(F.transform(F.split(description, r"\|"), one), "|")


# NDPI: `key=value` lines.


def ndpi_key(key: Column) -> Column:
    return reduce(lambda a, w: a | key.contains(w), NDPI_WORDS, key.isin(*NDPI_KEYS))


def ndpi_findings(props: Column) -> Column:
    """Array of (key, value) of identifying lines whose value isn't empty or all X."""
    lines = F.filter(F.split(props, "\n"), lambda p: p.contains("="))
    pairs = F.transform(lines, lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("key"), strip(F.regexp_replace(p, r"(?s)^[^=]*=", "")).alias("value")))
    return F.filter(pairs, lambda f: ndpi_key(f["key"]) & (f["value"] != "") & ~all_x(f["value"]))


def ndpi_redacted(props: Column) -> Column:
    """Values of identifying lines become as many X."""

    def one(p: Column) -> Column:
        key, value = F.substring_index(p, "=", 1), F.regexp_replace(p, r"(?s)^[^=]*=", "")
        touched = p.contains("=") & ndpi_key(strip(key)) & (strip(value) != "") & ~all_x(strip(value))
        return F.when(touched, F.concat(key, F.lit("="), F.repeat(F.lit("X"), F.length(value)))).otherwise(p)

    return F.array_join(F.transform(F.split(props, "\n"), one), "\n")


# XML: attributes and elements by name, in any case, wherever they stand; never parsed as a tree.


def markup_done(value: Column) -> Column:
    bare = strip(value)
    return (bare == "") | all_x(bare)


def _named(text: Column, names: tuple[str, ...], pattern: str) -> Column:
    """(key, value) of all names, in their order and then by place; the text is gone through once for each group."""
    known = F.array(*(F.lit(n.lower()) for n in names))
    spelled = F.array(*map(F.lit, names))
    found = [F.regexp_extract_all(text, F.lit(_any(pattern, names)), F.lit(g)) for g in (1, 2)]
    ranked = F.zip_with(*found, lambda n, v: F.struct(F.array_position(known, F.lower(F.upper(n))).cast("int").alias("rank"), v.alias("value")))
    placed = F.array_sort(F.transform(ranked, lambda r, i: F.struct(r["rank"].alias("rank"), i.alias("at"), r["value"].alias("value"))))
    pairs = F.transform(placed, lambda r: F.struct(F.element_at(spelled, r["rank"]).alias("key"), strip(r["value"]).alias("value")))
    return F.when(text.rlike(_any(pattern, names)), pairs).otherwise(F.array().cast(PAIRS))


def _any(pattern: str, names: tuple[str, ...]) -> str:
    return pattern.replace("NAME", f"({'|'.join(names)})")


PAIRS = "array<struct<key:string,value:string>>"
ATTRIBUTE, ELEMENT = r'(?iu)NAME\s*=\s*"([^"]*)"', r"(?iu)<NAME[^>]*>([^<]+)</\1>"
#: Processing instructions, whose attributes don't count.
INSTRUCTION = r"(?s)<\?.*?(?:\?>|\z)"


def xmp_findings(text: Column) -> Column:
    return F.filter(_named(text, XMP_ATTRIBUTES, ATTRIBUTE), lambda f: ~markup_done(f["value"]))


def scn_findings(text: Column) -> Column:
    bare = F.regexp_replace(text, INSTRUCTION, " ")
    found = F.concat(_named(text, SCN_NAMES, ELEMENT), _named(bare, SCN_NAMES, ATTRIBUTE))
    return F.when(text.contains("<"), F.filter(found, lambda f: ~markup_done(f["value"]))).otherwise(F.array().cast(PAIRS))


def _overwritten(text: Column, pattern: str, group: int) -> Column:
    """The given group of every match replaced by as many X, where it isn't done already; all else stays."""

    def one(m: Column, v: Column) -> Column:
        head = F.regexp_extract(m, r'(?s)^(.*?["\>])', 1)  # up to the value
        tail = F.substring(m, F.length(head) + F.length(v) + 1, F.length(m))
        return F.when(markup_done(v), m).otherwise(F.concat(head, F.repeat(F.lit("X"), F.length(v)), tail))

    def joined(found: Column) -> Column:
        changed = F.zip_with(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), one)
        return bound(F.split(text, pattern, -1), lambda gaps: F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(found)), changed, lambda g, c: F.concat(g, c)), ""), F.element_at(gaps, -1)))

    return F.when(text.rlike(pattern), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), joined)).otherwise(text)


def xmp_redacted(text: Column) -> Column:
    return _overwritten(text, _any(ATTRIBUTE, XMP_ATTRIBUTES), 2)


def scn_redacted(text: Column) -> Column:
    """Elements, then attributes outside of processing instructions."""
    marked = F.regexp_replace(_overwritten(text, _any(ELEMENT, SCN_NAMES), 2), f"({INSTRUCTION})", "\0$1\0")
    fixed = F.transform(F.split(marked, "\0"), lambda p: F.when(p.startswith("<?"), p).otherwise(_overwritten(p, _any(ATTRIBUTE, SCN_NAMES), 2)))
    return F.array_join(fixed, "")


# DICOM values.


def dicom_done(vr: Column, value: Column) -> Column:
    """Whether a value is one that replacement leaves behind."""
    sentinel = F.when(vr == "DA", value == "19000101").when(vr == "TM", value == "000000").when(vr == "DT", value == "19000101000000").when(vr == "PN", value.rlike(r"^\^+$")).otherwise(F.lit(False))
    return (value == "") | all_x(value) | sentinel


def dicom_replacement(vr: Column) -> Column:
    return F.when(vr == "DA", "19000101").when(vr == "TM", "000000").when(vr == "DT", "19000101000000").otherwise("")
