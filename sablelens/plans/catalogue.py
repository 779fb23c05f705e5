"""Registered queries of the engine, each with the SQL that must give the same rows; where there is none, SQL can't express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablelens.functions import fields as P
from sablelens.functions import rules as R
from sablelens.functions import tables as T
from sablelens.operators import dicom as D
from sablelens.operators import mrxs as M
from sablelens.operators import patches as A
from sablelens.operators import report as G
from sablelens.plans.slides import DUCK_SQL, SPARK_SQL, slides
from sablelens.sources.tiff import decode_tags
from sablelens.streaming.landing import sessions, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; {S} in its SQL is the slide relation."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{S}", f"({DUCK_SQL})")
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# RE2 has no look-behind: such rules are matched with the character before, of which there is none to keep.
def _duck(rule: R.Rule) -> tuple[str, int]:
    p = rule.pattern
    if p.startswith("(?<![A-Z])"):
        return "(?:^|[^A-Z])(" + p.removeprefix("(?<![A-Z])") + ")", 1
    return p.replace(r"(?<!\d)", r"\b").replace(r"(?!\d)", r"\b"), 0


def _rules_sql(source: str, key: str, text: str, rules: tuple[R.Rule, ...]) -> str:
    parts = []
    for i, r in enumerate(rules):
        p, group = _duck(r)
        parts.append(f"SELECT {key}, {i} AS ord, '{r.label}' AS label, unnest(regexp_extract_all({text}, '{p}', {group})) AS value FROM src WHERE {text} IS NOT NULL")
    return f"WITH src AS (SELECT * FROM {source} x) " + " UNION ALL ".join(parts)


_HITS = _rules_sql("{S}", "slide_id", "label_text", R.IDENTIFIERS)


def _label_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scan_strings(slides(spark, sf_dir), ["slide_id"], "label_text")


@query(_HITS)
def scan_string_rules(spark, sf_dir):
    return _label_hits(spark, sf_dir).select("slide_id", "ord", "label", "value")


@query(f"WITH h AS ({_HITS}) SELECT label, count(*) AS hits, count(DISTINCT slide_id) AS slides FROM h GROUP BY label")
def rule_hit_counts(spark, sf_dir):
    return _label_hits(spark, sf_dir).groupBy("label").agg(F.count("*").alias("hits"), F.countDistinct("slide_id").alias("slides"))


_TAIL = "CASE WHEN done THEN code ELSE concat('id=', code, 'tail', chr(0), 'rest') END"


@query(
    f"WITH h AS ({_rules_sql('(SELECT slide_id, done, concat(' + chr(39) + 'id=' + chr(39) + ', code) AS t FROM {S} y)', 'slide_id, done', 't', R.IDENTIFIERS)}) "
    "SELECT slide_id, label, CAST(3 AS INTEGER) AS start, CAST(length(value) + CASE WHEN done THEN 0 ELSE 4 END AS INTEGER) AS length FROM h"
)
def scan_bytes_nul_extend(spark, sf_dir):
    s = slides(spark, sf_dir)
    content = F.when(F.col("done"), F.concat(F.lit("id="), "code")).otherwise(F.concat(F.lit("id="), "code", F.lit("tail\0rest"))).cast("binary")
    return R.scan_bytes(s.withColumn("content", content), ["slide_id"], "content").select("slide_id", "label", "start", "length")


@query(f"WITH h AS ({_HITS}) SELECT slide_id, label, value FROM h WHERE slide_id % 2 = 1")
def skip_offset_anti(spark, sf_dir):
    s = slides(spark, sf_dir)
    known = s.where("slide_id % 2 = 0").select("slide_id", F.lit(0).alias("start"))
    return R.scan_bytes(s.withColumn("content", F.col("label_text").cast("binary")), ["slide_id"], "content", skip=known).select("slide_id", "label", "value")


@query("SELECT slide_id, 'DateTime_TIFF' AS label, CAST(0 AS INTEGER) AS start, time_tag AS value FROM {S} s WHERE NOT done")
def scan_dates(spark, sf_dir):
    return R.scan_dates(slides(spark, sf_dir), ["slide_id"], "time_tag").select("slide_id", "label", "start", "value")


@query("SELECT done, count(*) AS tags FROM {S} s WHERE NOT (contains(time_tag, '1900:01:01') OR contains(time_tag, '0000:00:00')) GROUP BY done")
def date_sentinel_filter(spark, sf_dir):
    return slides(spark, sf_dir).where(~P.date_removed(F.col("time_tag"))).groupBy("done").agg(F.count("*").alias("tags"))


_STEM_HITS = _rules_sql("(SELECT slide_id, name, regexp_replace(name, '[.][^.]*$', '') AS stem FROM {S} y)", "slide_id, name", "stem", R.IDENTIFIERS)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scan_strings(slides(spark, sf_dir).withColumn("stem", P.stem(F.col("name"))), ["slide_id", "name"], "stem")


@query(f"WITH h AS ({_STEM_HITS}) SELECT slide_id, label, name AS value_preview FROM h")
def filename_scan(spark, sf_dir):
    return _names(spark, sf_dir).select("slide_id", "label", F.col("name").alias("value_preview"))


@query(f"WITH h AS ({_STEM_HITS}) SELECT count(DISTINCT slide_id) AS files FROM h")
def filename_phi_count(spark, sf_dir):
    return _names(spark, sf_dir).agg(F.countDistinct("slide_id").alias("files"))


_KIND = "CASE lower(regexp_extract(name, '[.]([^.]*)$', 1)) WHEN 'ndpi' THEN 'ndpi' WHEN 'svs' THEN 'svs' WHEN 'mrxs' THEN 'mrxs' WHEN 'bif' THEN 'bif' WHEN 'scn' THEN 'scn' WHEN 'dcm' THEN 'dicom' WHEN 'dicom' THEN 'dicom' WHEN 'tif' THEN 'tiff' WHEN 'tiff' THEN 'tiff' ELSE 'unknown' END"


@query("SELECT slide_id, name FROM {S} s WHERE lower(regexp_extract(name, '[.]([^.]*)$', 1)) IN ('tif', 'tiff')")
def collect_by_ext(spark, sf_dir):
    return slides(spark, sf_dir).where(P.extension(F.col("name")).isin(*P.EXTENSIONS["tiff"])).select("slide_id", "name")


@query(f"SELECT {_KIND} AS format, count(*) AS files FROM {{S}} s GROUP BY 1")
def detect_format(spark, sf_dir):
    return slides(spark, sf_dir).groupBy(P.format_of(F.col("name")).alias("format")).agg(F.count("*").alias("files"))


def _pairs(df: DataFrame, found: Column) -> DataFrame:
    return df.select("slide_id", F.explode_outer(found).alias("_f")).where("_f IS NOT NULL").select("slide_id", "_f.key", "_f.value")


_SVS = "SELECT slide_id, done, trim(split_part(p, '=', 1)) AS key, trim(substr(p, strpos(p, '=') + 1)) AS value FROM (SELECT slide_id, done, unnest(string_split(svs_text, '|')[2:]) AS p FROM {S} s) WHERE contains(p, '=')"
_SVS_KEYS = "('ScanScope ID', 'Filename', 'Date', 'Time', 'User', 'DSR ID')"
_SVS_LEFT = f"key IN {_SVS_KEYS} AND NOT (value = '' OR regexp_full_match(value, 'X+') OR (key = 'Date' AND value = '01/01/00') OR (key = 'Time' AND value = '00:00:00'))"


@query(f"SELECT slide_id, key, value FROM ({_SVS})")
def svs_parse(spark, sf_dir):
    return _pairs(slides(spark, sf_dir), P.svs_fields(F.col("svs_text")))


@query(f"SELECT slide_id, key, value FROM ({_SVS}) WHERE {_SVS_LEFT}")
def svs_scan(spark, sf_dir):
    return _pairs(slides(spark, sf_dir), P.svs_findings(F.col("svs_text")))


@query(
    "SELECT slide_id, CASE WHEN done THEN svs_text ELSE concat('Image Library v12', chr(10), '1000x800|AppMag = 40|ScanScope ID = XXXXXXXX|Filename = ', repeat('X', length(code)), "
    "'|Date = 01/01/00|Time = 00:00:00|User = ', repeat('X', length(person)), '|MPP = 0.25') END AS redacted FROM {S} s"
)
def svs_redact(spark, sf_dir):
    return slides(spark, sf_dir).select("slide_id", P.svs_redacted(F.col("svs_text")).alias("redacted"))


@query(
    "SELECT slide_id, key, value FROM (SELECT slide_id, trim(split_part(p, '=', 1)) AS key, trim(substr(p, strpos(p, '=') + 1)) AS value FROM (SELECT slide_id, unnest(string_split(props, chr(10))) AS p FROM {S} s) WHERE contains(p, '=')) "
    "WHERE (key IN ('Created', 'Updated', 'NDP.S/N', 'Macro.S/N', 'Firmware.Version') OR contains(key, 'User') OR contains(key, 'Name') OR contains(key, 'Operator')) AND value <> '' AND NOT regexp_full_match(value, 'X+')"
)
def ndpi_props_scan(spark, sf_dir):
    return _pairs(slides(spark, sf_dir), P.ndpi_findings(F.col("props")))


@query("SELECT slide_id, CASE WHEN done THEN props ELSE concat('NDP.S/N=XXXXXX', chr(10), 'Objective.Lens=20', chr(10), 'Created=XXXXXXXXXX', chr(10), 'Operator.Id=', repeat('X', length(person) + 1)) END AS redacted FROM {S} s")
def ndpi_props_redact(spark, sf_dir):
    return slides(spark, sf_dir).select("slide_id", P.ndpi_redacted(F.col("props")).alias("redacted"))


def _xml_sql(names: tuple[str, ...], source: str, element: bool) -> str:
    parts = []
    for n in names:
        for p in ([f"(?i)<{n}[^>]*>([^<]+)</{n}>"] if element else []) + [f'(?i){n}\\s*=\\s*"([^"]*)"']:
            parts.append(f"SELECT slide_id, '{n}' AS key, trim(unnest(regexp_extract_all(t, '{p}', 1))) AS value FROM src")
    return f"WITH src AS (SELECT slide_id, regexp_replace({source}, '<[?].*?[?]>', ' ') AS t FROM {{S}} s), f AS ({' UNION ALL '.join(parts)}) SELECT slide_id, key, value FROM f WHERE value <> '' AND NOT regexp_full_match(value, 'X+')"


@query(_xml_sql(P.XMP_ATTRIBUTES, "xmp_text", False))
def xmp_scan(spark, sf_dir):
    return _pairs(slides(spark, sf_dir), P.xmp_findings(F.col("xmp_text")))


@query("SELECT slide_id, CASE WHEN done THEN xmp_text ELSE concat('<xmp><iScan BarCode1=\"', repeat('X', length(code)), '\" ScanDate=\"XXXXXXXXXX\" OperatorID = \"', repeat('X', length(person)), '\" Magnification=\"40\" UniqueID=\"\"/></xmp>') END AS redacted FROM {S} s")
def xmp_redact(spark, sf_dir):
    return slides(spark, sf_dir).select("slide_id", P.xmp_redacted(F.col("xmp_text")).alias("redacted"))


@query(_xml_sql(P.SCN_NAMES, "scn_text", True))
def scn_scan(spark, sf_dir):
    return _pairs(slides(spark, sf_dir), P.scn_findings(F.col("scn_text")))


@query(
    "SELECT slide_id, CASE WHEN done THEN scn_text ELSE concat('<?xml version=\"1.0\"?><scn><image><barcode>', repeat('X', length(code)), '</barcode><creationDate>XXXXXXXXXX</creationDate><device kind=\"', 'D', lpad(CAST(slide_id AS STRING), 6, '0'), '\" operator=\"', repeat('X', length(person)), '\"/></image></scn>') END AS redacted FROM {S} s"
)
def scn_redact(spark, sf_dir):
    return slides(spark, sf_dir).select("slide_id", P.scn_redacted(F.col("scn_text")).alias("redacted"))


def _derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Rows of a relation over the slides, {S} in its text."""
    source = f"({SPARK_SQL.replace('FROM orders', 'FROM {orders}').replace('JOIN customer', 'JOIN {customer}')})"
    return spark.sql(f"SELECT * FROM {text.replace('{S}', source)}", orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


# INI rows of the slides: section, key, value.
_INI = """(SELECT slide_id, i.section, i.key, CASE i.what WHEN 'code' THEN CASE WHEN done THEN repeat('X', length(code)) ELSE code END WHEN 'person' THEN CASE WHEN done THEN '' ELSE person END ELSE i.what END AS value
 FROM {S} s CROSS JOIN (VALUES ('GENERAL', 'SLIDE_NAME', 'code'), ('GENERAL', 'slide_barcode', 'code'), ('GENERAL', 'SLIDE_VERSION', '2.1'), ('NOTES', 'OPERATOR', 'person'), ('NOTES', 'PATIENT_ID', 'code'),
 ('HIERARCHICAL', 'NONHIER_COUNT', '1'), ('HIERARCHICAL', 'NONHIER_0_COUNT', '2'), ('HIERARCHICAL', 'NONHIER_0_VAL_0', 'ScanDataLayer_SlideBarcode'), ('HIERARCHICAL', 'NONHIER_0_VAL_1', 'ScanDataLayer_SlidePreview'),
 ('HIERARCHICAL', 'NONHIER_0_VAL_0_SECTION', 'LABEL_SECTION'), ('LABEL_SECTION', 'FILE', 'Data0001.dat'), ('LABEL_SECTION', 'OFFSET', '128'), ('LABEL_SECTION', 'SIZE', '4096')) AS i(section, key, what))"""


def ini_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, _INI)


@query(f"SELECT slide_id, key, value FROM {_INI} r WHERE section = 'GENERAL' AND upper(key) IN {T.MRXS_GENERAL} AND value <> '' AND NOT regexp_full_match(value, 'X+')")
def ini_general(spark, sf_dir):
    return M.general_findings(ini_rows(spark, sf_dir), ["slide_id"]).select("slide_id", "key", "value")


@query(f"SELECT slide_id, section, key, value FROM {_INI} r WHERE section <> 'GENERAL' AND upper(key) IN {T.MRXS_OTHER} AND value <> '' AND NOT regexp_full_match(value, 'X+')")
def ini_sections(spark, sf_dir):
    return M.section_findings(ini_rows(spark, sf_dir), ["slide_id"]).select("slide_id", "section", "key", "value")


@query(
    "SELECT slide_id, 'LabelImage' AS image, 'LABEL_SECTION' AS section, 'Data0001.dat' AS dat_key, CAST(128 AS BIGINT) AS start, CAST(4096 AS BIGINT) AS size FROM {S} s UNION ALL "
    "SELECT slide_id, 'MacroImage', 'NONHIER_0_LEVEL_1', NULL, 0, 0 FROM {S} s"
)
def mrxs_assoc_images(spark, sf_dir):
    return M.associated_images(ini_rows(spark, sf_dir), ["slide_id"]).select("slide_id", "image", "section", "dat_key", "start", "size")


@query("SELECT c_mktsegment AS segment, CASE WHEN contains(lower(t), 'label') THEN 'LabelImage' WHEN contains(lower(t), 'macro') THEN 'MacroImage' END AS image, count(*) AS pages FROM (SELECT c_mktsegment, concat(CASE c_custkey % 3 WHEN 0 THEN 'Label ' WHEN 1 THEN 'MACRO ' ELSE 'slide ' END, c_name) AS t FROM customer) GROUP BY 1, 2")
def label_macro_classify(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    kind = F.col("c_custkey") % 3
    text = F.concat(F.when(kind == 0, "Label ").when(kind == 1, "MACRO ").otherwise("slide "), "c_name")
    return c.groupBy(F.col("c_mktsegment").alias("segment"), P.image_kind(text).alias("image")).agg(F.count("*").alias("pages"))


# Tag rows of the slides: two directories that share value offsets.
_TAGS = """(SELECT slide_id, d.dir, t.pos, t.tag, t.kind, CAST(slide_id * 100 + t.pos * 10 + d.dir * t.own AS BIGINT) AS place, CASE t.what WHEN 'label' THEN label_text WHEN 'time' THEN time_tag WHEN 'person' THEN CASE WHEN done THEN 'XXXX' ELSE person END ELSE t.what END AS value
 FROM {S} s CROSS JOIN (VALUES (0), (1)) AS d(dir) CROSS JOIN (VALUES (0, 256, 3, '1024', 0), (1, 306, 2, 'time', 0), (2, 315, 2, 'person', 1), (3, 700, 7, '', 1), (4, 270, 2, 'label', 0), (5, 65468, 2, 'label', 1)) AS t(pos, tag, kind, what, own))"""


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, _TAGS)


@query(f"SELECT tag, count(*) AS found FROM {_TAGS} r WHERE tag IN (270, 305, 315, 316, 700, 33432, 33723, 34675, 37510, 42016) AND kind IN (2, 7) AND trim(value) <> '' AND NOT regexp_full_match(value, 'X+') GROUP BY tag")
def extra_metadata_filter(spark, sf_dir):
    rows = tag_rows(spark, sf_dir)
    value = F.col("value")
    left = F.col("tag").isin(*T.EXTRA_TAGS) & F.col("kind").isin(2, 7) & ~value.rlike(r"^\x00*$") & (P.strip(value) != "") & ~P.all_x(value)
    return rows.where(left).groupBy("tag").agg(F.count("*").alias("found"))


@query(f"SELECT slide_id, dir, tag, place FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, place ORDER BY dir, pos) AS rn FROM {_TAGS} r WHERE tag IN (306, 36867, 36868)) WHERE rn = 1 AND NOT contains(value, '1900:01:01')")
def offset_dedup_first(spark, sf_dir):
    w = Window.partitionBy("slide_id", "place").orderBy("dir", "pos")
    first = tag_rows(spark, sf_dir).where(F.col("tag").isin(*T.DATE_TAGS)).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.where(~P.date_removed(F.col("value"))).select("slide_id", "dir", "tag", "place")


@query(f"WITH h AS ({_rules_sql(_TAGS, 'slide_id, dir, tag, kind, place', 'value', R.IDENTIFIERS)}) SELECT slide_id, dir, tag, label, place AS start FROM h WHERE kind = 2")
def generic_tiff_strings(spark, sf_dir):
    rows = tag_rows(spark, sf_dir).where("kind = 2")
    found = R.scan_strings(rows, ["slide_id", "dir", "tag", "place"], "value")
    return found.select("slide_id", "dir", "tag", "label", (F.col("place") + F.col("start")).alias("start"))


# DICOM elements of the slides.
_DICOM = """(SELECT slide_id, e.depth, e.tag, e.vr, e.private, CASE e.what WHEN 'code' THEN CASE WHEN done THEN '' ELSE code END WHEN 'person' THEN CASE WHEN done THEN '^^' ELSE person END WHEN 'date' THEN CASE WHEN done THEN '19000101' ELSE '20240615' END ELSE e.what END AS value
 FROM {S} s CROSS JOIN (VALUES (0, '0010,0010', 'PN', false, 'person'), (0, '0010,0020', 'LO', false, 'code'), (0, '0008,0020', 'DA', false, 'date'), (0, '0010,1040', 'LO', false, 'street'), (0, '0028,0010', 'US', false, '512'),
 (0, '0009,0010', 'LO', true, 'VENDOR'), (0, '0009,1001', 'LO', true, 'x'), (1, '0010,0020', 'LO', false, 'code'), (3, '0008,0050', 'SH', false, 'code'), (6, '0010,0010', 'PN', false, 'person')) AS e(depth, tag, vr, private, what))"""


def dicom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, _DICOM)


_DONE = "(value = '' OR regexp_full_match(value, 'X+') OR (vr = 'DA' AND value = '19000101') OR (vr = 'PN' AND regexp_full_match(value, '\\^+')))"


@query(f"SELECT slide_id, tag, value, CASE vr WHEN 'DA' THEN '19000101' WHEN 'TM' THEN '000000' WHEN 'DT' THEN '19000101000000' ELSE '' END AS replacement FROM {_DICOM} r WHERE depth = 0 AND tag IN ('0010,0010', '0010,0020', '0008,0020') AND NOT {_DONE}")
def dicom_blank(spark, sf_dir):
    return D.blank_findings(dicom_rows(spark, sf_dir)).select("slide_id", "tag", "value", P.dicom_replacement(F.col("vr")).alias("replacement"))


@query(f"SELECT slide_id, tag, value FROM {_DICOM} r WHERE depth = 0 AND tag = '0010,1040'")
def dicom_delete(spark, sf_dir):
    return D.delete_findings(dicom_rows(spark, sf_dir)).select("slide_id", "tag", "value")


@query(f"SELECT slide_id, depth, tag, value FROM {_DICOM} r WHERE depth BETWEEN 1 AND 6 AND tag IN ('0010,0020', '0008,0050', '0010,0010') AND NOT {_DONE}")
def dicom_nested(spark, sf_dir):
    return D.nested_findings(dicom_rows(spark, sf_dir)).select("slide_id", "depth", "tag", "value")


@query(f"SELECT slide_id, count(*) AS private_tags FROM {_DICOM} r WHERE private AND depth = 0 GROUP BY slide_id")
def dicom_private(spark, sf_dir):
    return D.private_counts(dicom_rows(spark, sf_dir), ["slide_id"])


@query("SELECT slide_id, CASE WHEN length(code) <= 4 THEN repeat('*', length(code)) ELSE concat(left(code, 2), repeat('*', length(code) - 4), right(code, 2)) END AS masked FROM {S} s")
def mask_preview(spark, sf_dir):
    return slides(spark, sf_dir).select("slide_id", P.mask_preview(F.col("code")).alias("masked"))


@query("SELECT slide_id, CASE WHEN length(svs_text) > 50 THEN concat(left(svs_text, 47), '...') ELSE svs_text END AS preview, left(name, 30) AS cut FROM {S} s")
def preview_trunc(spark, sf_dir):
    return slides(spark, sf_dir).select("slide_id", P.truncated(F.col("svs_text"), 50).alias("preview"), F.left("name", F.lit(30)).alias("cut"))


_NAMES = "(VALUES ('DateTime'), ('EXIF:Software'), ('EXIF:SubSecTime'), ('GPS:GPSLatitude'), ('NDPI_SCANNER_PROPS:Created'), ('regex:MRN_Pattern'), ('fallback:Accession_AS'), ('SCN:XML:user'), ('NDPI_Tag_65480'), ('NDPI_UNKNOWN_65425'), ('Tag_999'), ('BarCode1'))"


@query(
    "SELECT tag, friendly FROM (VALUES ('DateTime', 'Date/Time'), ('EXIF:Software', 'EXIF: Software'), ('EXIF:SubSecTime', 'EXIF: SubSecTime'), ('GPS:GPSLatitude', 'GPS: Latitude'), ('NDPI_SCANNER_PROPS:Created', 'Scanner: Created'), ('regex:MRN_Pattern', 'Pattern: MRN_Pattern'), "
    "('fallback:Accession_AS', 'Pattern: Accession_AS'), ('SCN:XML:user', 'SCN: XML:user'), ('NDPI_Tag_65480', 'NDPI Tag 65480'), ('NDPI_UNKNOWN_65425', 'NDPI Tag 65425'), ('Tag_999', 'Tag 999'), ('BarCode1', 'BarCode1')) AS v(tag, friendly)"
)
def friendly_tag_name(spark, sf_dir):
    return spark.sql(f"SELECT tag FROM {_NAMES} AS v(tag)").select("tag", P.friendly_name(F.col("tag")).alias("friendly"))


@query("SELECT source, CASE source WHEN 'image_content' THEN 'Blank image (IFD unlinked)' WHEN 'regex_scan' THEN 'Overwritten with padding bytes' ELSE 'Cleared (null bytes)' END AS done FROM (VALUES ('image_content'), ('regex_scan'), ('tiff_tag'), ('filename')) AS v(source)")
def replacement_desc(spark, sf_dir):
    return spark.sql("SELECT source FROM (VALUES ('image_content'), ('regex_scan'), ('tiff_tag'), ('filename')) AS v(source)").select("source", P.replacement(F.col("source")).alias("done"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\x20-\\x7E\\t\\n\\r]', '', 'g')) * 1.0 / length(text) >= 0.75 AND length(text) >= 4 AS printable FROM documents")
def printable_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.is_printable(F.col("text")).alias("printable"))


#: Rules of a user's own, for tables that hold no slides.
CUSTOM = (R.Rule(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "EMAIL"), R.Rule(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "IPV4"), R.Rule(r"\d{5,}", "LONG_DIGITS"))


def _custom(spark: SparkSession, sf_dir: str, name: str, keys: list[str], text: str) -> DataFrame:
    rows = table(spark, sf_dir, name)
    return _hits(rows, keys, text)


def _hits(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    found = R._exploded(rows, keys, R.matches(F.col(text), CUSTOM, unicode=False))
    return found.select(*keys, "label", "value")


def _custom_sql(name: str, keys: str, text: str) -> str:
    return f"SELECT {keys}, label, value FROM ({_rules_sql(name, keys, text, CUSTOM)})"


@query(_custom_sql("documents", "doc_id", "text"))
def custom_rules_documents(spark, sf_dir):
    return _custom(spark, sf_dir, "documents", ["doc_id"], "text")


@query(_custom_sql("pages", "page_id", "html"))
def custom_rules_pages(spark, sf_dir):
    return _custom(spark, sf_dir, "pages", ["page_id"], "html")


@query(_custom_sql("conversations", "conv_id, turn", "text"))
def custom_rules_conversations(spark, sf_dir):
    return _custom(spark, sf_dir, "conversations", ["conv_id", "turn"], "text")


def _redacted(text: Column) -> Column:
    for r in CUSTOM:
        text = F.regexp_replace(text, r.pattern, "XXXX")
    return text


_REDACTED = f"regexp_replace(regexp_replace(regexp_replace(text, '{CUSTOM[0].pattern}', 'XXXX', 'g'), '{CUSTOM[1].pattern}', 'XXXX', 'g'), '{CUSTOM[2].pattern}', 'XXXX', 'g')"


@query(f"SELECT doc_id, sha256({_REDACTED}) AS redacted_sha256 FROM documents")
def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(_redacted(F.col("text")), 256).alias("redacted_sha256"))


@query("SELECT count(*) AS files, CAST(0 AS BIGINT) AS findings FROM documents")
def verify_after_redact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", _redacted(F.col("text")).alias("text"))
    left = docs.select("doc_id", F.size(R.matches(F.col("text"), CUSTOM, unicode=False)).alias("n"))
    return left.agg(F.count("*").alias("files"), F.sum("n").cast("long").alias("findings"))


# Results of a batch, derived from orders: status, verification, integrity.
_RESULTS = "(SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 11 = 0 THEN 'unreadable' END AS error, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 4 END AS cleared, o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 AS verified, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 12 = 0 END AS integrity, o_orderkey % 7 = 0 AS name_hit, CAST(o_orderkey * 1000 AS BIGINT) AS length FROM orders)"


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_RESULTS.replace('FROM orders', 'FROM {orders}')}", orders=table(spark, sf_dir, "orders"))


@query(f"SELECT count(*) AS total, count(*) FILTER (error IS NOT NULL) AS errored, count(*) FILTER (error IS NULL AND cleared > 0) AS anonymized, count(*) FILTER (error IS NULL AND cleared = 0) AS already_clean FROM {_RESULTS} r")
def batch_stats(spark, sf_dir):
    return G.batch_stats(result_rows(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (error IS NULL AND cleared = 0) AS clean, count(*) FILTER (error IS NOT NULL) AS errors, CAST(sum(cleared) AS BIGINT) AS findings, count(*) FILTER (error IS NULL AND cleared > 0) AS with_findings FROM {_RESULTS} r")
def scan_summary(spark, sf_dir):
    return G.scan_summary(result_rows(spark, sf_dir).withColumnRenamed("cleared", "n_findings"))


@query(f"SELECT count(*) FILTER (verified) AS clean, count(*) FILTER (NOT verified) AS dirty FROM {_RESULTS} r")
def verify_summary(spark, sf_dir):
    return result_rows(spark, sf_dir).agg(F.count_if("verified").alias("clean"), F.count_if(~F.col("verified")).alias("dirty"))


@query(
    f"WITH r AS (SELECT * FROM {_RESULTS} x), a AS (SELECT sum(cleared) AS n, count(*) AS t, count(*) FILTER (verified) AS v, count(*) FILTER (integrity) AS ok, count(*) FILTER (NOT integrity) AS bad FROM r) "
    "SELECT 'Metadata tags cleared' AS measure, CASE WHEN n > 0 THEN 'applied' ELSE 'not_needed' END AS status FROM a UNION ALL SELECT 'Label/macro images blanked', CASE WHEN n > 0 THEN 'applied' ELSE 'not_needed' END FROM a UNION ALL "
    "SELECT 'Post-anonymization verification', CASE WHEN v = t AND v > 0 THEN 'passed' ELSE 'skipped' END FROM a UNION ALL SELECT 'Image data integrity (SHA-256)', CASE WHEN bad = 0 THEN 'passed' ELSE 'failed' END FROM a WHERE ok + bad > 0"
)
def cert_measures(spark, sf_dir):
    return G.measures(result_rows(spark, sf_dir))


@query("SELECT l_orderkey AS path, bool_and(l_linenumber % 5 <> 4 OR l_orderkey % 2 = 0) AS verified FROM lineitem WHERE l_linenumber % 7 <> 6 GROUP BY l_orderkey")
def integrity_compare(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("ifd_offset"))
    before = items.withColumn("sha256", F.sha2(F.concat_ws("|", "path", "ifd_offset"), 256))
    broken = (F.col("ifd_offset") % 5 == 4) & (F.col("path") % 2 == 1)
    after = before.where("ifd_offset % 7 <> 6").withColumn("sha256", F.when(broken, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return G.integrity(before, after)


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    "WITH i AS (SELECT DISTINCT l_orderkey AS path, CAST(l_linenumber * 100 AS BIGINT) AS place, l_linenumber % 3 = 2 AS gone FROM lineitem), k AS (SELECT *, lead(place) OVER (PARTITION BY path ORDER BY place) AS after FROM i WHERE NOT gone), "
    "o AS (SELECT path, place, lead(place) OVER (PARTITION BY path ORDER BY place) AS was FROM i) SELECT k.path, k.place, coalesce(k.after, 0) AS next_place FROM k JOIN o USING (path, place) WHERE coalesce(k.after, 0) <> coalesce(o.was, 0)"
)
def unlink_chain(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    ifds = items.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("ifd_idx"), (F.col("l_linenumber") * 100).cast("long").alias("ifd_offset"), (F.col("l_linenumber") % 3 == 2).alias("gone")).distinct()
    return A.unlink(ifds).select("path", F.col("ifd_offset").alias("place"), F.col("next_offset").alias("next_place")).where("place IS NOT NULL")


@query(f"WITH h AS ({_HITS}), f AS ({_STEM_HITS}) SELECT slide_id, 'regex_scan' AS source, label FROM h UNION ALL SELECT slide_id, 'filename', label FROM f UNION ALL SELECT slide_id, 'tiff_tag', 'DateTime' FROM {{S}} s WHERE NOT done")
def union_findings(spark, sf_dir):
    tags = slides(spark, sf_dir).where(~P.date_removed(F.col("time_tag"))).select("slide_id", F.lit("tiff_tag").alias("source"), F.lit("DateTime").alias("label"))
    hits = _label_hits(spark, sf_dir).select("slide_id", F.lit("regex_scan").alias("source"), "label")
    return hits.unionByName(_names(spark, sf_dir).select("slide_id", F.lit("filename").alias("source"), "label")).unionByName(tags)


@query(f"SELECT count(*) AS files, CAST(sum(length) AS BIGINT) AS needed, CASE WHEN sum(length) > 1000000000 THEN 'error' WHEN sum(length) * 1.1 > 1000000000 THEN 'warning' ELSE 'ok' END AS space FROM {_RESULTS} r")
def preflight_sizes(spark, sf_dir):
    return G.space_needed(result_rows(spark, sf_dir), 1_000_000_000)


# Queries over bytes that are made in the query.


def _small_tiffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A little-endian TIFF per slide: one directory with a width and a text of the label, put together as hexadecimal."""
    s = slides(spark, sf_dir)
    le = lambda n, digits: F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), digits, "0"), F.lit("(..)"), F.lit(1))), "")
    label = F.encode("code", "US-ASCII")
    count = F.length(label).cast("long") + 1
    # 8 bytes of header, 2 of count, 2 entries of 12, 4 of next: the text begins at 38.
    text = F.concat(F.lit("49492A0008000000" + "0200" + "00010300" + "01000000" + "90010000" + "0E010200"), le(count, 8), F.lit("26000000" + "00000000"), F.hex(label), F.lit("00"))
    return s.select("slide_id", "code", F.unhex(text).alias("content"))


@query("SELECT CAST(slide_id AS STRING) AS path, tag_id, value FROM (SELECT slide_id, 256 AS tag_id, '400' AS value FROM {S} s UNION ALL SELECT slide_id, 270, code FROM {S} s)")
def tiff_udtf_roundtrip(spark, sf_dir):
    tags = decode_tags(_small_tiffs(spark, sf_dir), "slide_id", "content")
    text = F.when(F.col("dtype") == 2, F.regexp_replace(F.decode("raw", "ISO-8859-1"), r"\x00+$", "")).otherwise(F.get("nums", F.lit(0)).cast("long").cast("string"))
    return tags.select("path", "tag_id", text.alias("value"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, CAST(round(sum(value), 4) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return windows(table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, n"
)
def events_sessions(spark, sf_dir):
    made = sessions(table(spark, sf_dir, "events"))
    return made.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events")
