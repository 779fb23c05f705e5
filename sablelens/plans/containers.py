"""Queries that run the decoders, scans, patches and the splice over container files, which are built from the slide relation in the query.

Each slide becomes a file of a few hundred bytes in a binary column; its path is its slide_id as text. The SQL
says, from the slide relation alone, what must be found in these files and what must be left of them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablelens.functions import fields as P
from sablelens.functions import rules as R
from sablelens.functions import tables as T
from sablelens.operators import anonymize as A
from sablelens.operators import convert as C
from sablelens.operators import dicom as D
from sablelens.operators import report as G
from sablelens.operators import scan as N
from sablelens.operators.durable import in_parts, kept, stored
from sablelens.operators.levels import pyramid
from sablelens.operators.recheck import recheck_contents
from sablelens.operators.sink import patched_contents
from sablelens.plans.catalogue import ORACLE_SQL, QUERIES, query, table
from sablelens.plans.slides import slides
from sablelens.sources import files as S
from sablelens.sources import tiff
from sablelens.sources.dicom import as_elements, as_nested_private, decode_elements, decode_parsed
from sablelens.sources.ini import parse_ini

__all__ = ["ORACLE_SQL", "QUERIES"]


class Tiff:
    """Builds a TIFF; directories are lists of (tag, kind, count, value), a value being an int, bytes, a list of entries (a
    directory of its own) or the name of a place. Places: "image" and what else is given as tail, and "t<tag>", where that tag's value stands."""

    def __init__(self, order: str = "<", big: bool = False):
        self.order, self.big = order, big
        self.word, self.entry, self.out = ("Q", 20, bytearray(16)) if big else ("I", 12, bytearray(8))
        self.places: dict[str, int] = {}

    def number(self, n: int) -> bytes:
        return struct.pack(self.order + self.word, n)

    def extra(self, raw: bytes) -> int:
        self.out += raw
        return len(self.out) - len(raw)

    def directory(self, entries: list[tuple]) -> tuple[int, int]:
        """Where it begins, and where its pointer to the next one stands."""
        fields = []
        for tag, kind, count, value in entries:
            size = T.TYPE_BYTES[kind] * count
            if not isinstance(value, bytes):
                n = self.places[value] if isinstance(value, str) else self.directory(value)[0] if isinstance(value, list) else value
                field = struct.pack(self.order + {3: "H", 4: "I"}[kind], n) if kind in (3, 4) else self.number(n)
            elif size <= len(self.number(0)):
                field = value
            else:
                self.places[f"t{tag}"] = self.extra(value)
                field = self.number(self.places[f"t{tag}"])
            fields.append(struct.pack(self.order + "HH", tag, kind) + self.number(count) + field.ljust(len(self.number(0)), b"\0"))
        at = self.extra(struct.pack(self.order + ("Q" if self.big else "H"), len(entries)) + b"".join(fields) + self.number(0))
        return at, len(self.out) - len(self.number(0))

    def built(self, directories: list[list[tuple]], tail: dict[str, bytes] | None = None) -> bytes:
        for name, raw in (tail or {}).items():
            self.places[name] = self.extra(raw)
        pointer = 8 if self.big else 4
        self.out[: pointer] = (b"II" if self.order == "<" else b"MM") + (struct.pack(self.order + "HHH", 43, 8, 0) if self.big else struct.pack(self.order + "H", 42))
        for entries in directories:
            at, after = self.directory(entries)
            self.out[pointer : pointer + len(self.number(0))] = self.number(at)
            pointer = after
        return bytes(self.out)


def text(tag: int, value: str, kind: int = 2) -> tuple:
    raw = value.encode("latin-1") + b"\0"
    return tag, kind, len(raw), raw


#: Files that a task builds, and that it decodes and searches afterwards.
FILES_A_TASK = 4000
#: Files that are worked on at once by queries that keep several tables of their rows, some kilobytes a file.
FILES_A_PART = 300_000
WHOLE = (0, 1)


def _files(spark: SparkSession, sf_dir: str, build: Callable[[object], bytes], form: str, part: tuple[int, int] = WHOLE, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """path, format, content, and code, of a file for each slide; form is the format as SQL. part: (k, n) for the k-th of n parts of the slides; columns: those that build reads."""
    # The tables are a single split of Parquet up to a million slides, so that without dealing one task did all the work.
    k, n = part
    tasks = -(-table(spark, sf_dir, "orders").count() // (FILES_A_TASK * n))
    own = slides(spark, sf_dir).where(f"pmod(xxhash64(slide_id), {n}) = {k}") if n > 1 else slides(spark, sf_dir)
    rows = own.select(*columns).repartition(max(1, tasks), "slide_id").selectExpr("CAST(slide_id AS STRING) AS path", f"{form} AS format", "*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [build(r) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"path": batch["path"], "format": batch["format"], "content": made})

    return kept(rows.mapInPandas(run, "path string, format string, content binary"))


def _by_parts(spark: SparkSession, sf_dir: str, work: Callable[[tuple[int, int]], DataFrame]) -> DataFrame:
    """The rows of work for all parts of the slides."""
    n = max(1, -(-table(spark, sf_dir, "orders").count() // FILES_A_PART))
    return in_parts(spark, n, lambda k: work((k, n)))


IMAGE = b"IMAGEDATA1234567"


def _slide(r) -> bytes:
    """Odd slides as SVS, others as NDPI files; every fourth is a BigTIFF, and every third big-endian. The second directory is a label and shares a value with the first."""
    blanked = (bytes(16), b"\xff\xd8\xff\xd9" + bytes(12))[r.slide_id % 2]
    person = "XXXX" if r.done else r.person
    first = [(256, 3, 1, 1000), (257, 3, 1, 800), text(270, r.svs_text), text(306, r.time_tag), text(315, person), text(65449, r.props), text(65468, r.label_text)]
    label = [(256, 3, 1, 90), text(270, "the label"), (273, 4, 1, "image"), (279, 4, 1, 16), (306, 2, 20, "t306"), text(315, person)]
    lens = [(65421, 11, 1, struct.pack((">" if r.slide_id % 3 == 0 else "<") + "f", -2.0))]
    made = Tiff(">" if r.slide_id % 3 == 0 else "<", r.slide_id % 4 == 0)
    return made.built([first, label + (lens if r.format == "ndpi" else [])], {"image": blanked if r.done else IMAGE, "code": b"" if r.done else b"## " + r.code.encode() + b"\0"})


FORM = "CASE WHEN slide_id % 2 = 1 THEN 'svs' ELSE 'ndpi' END"


_SLIDE_COLUMNS = ("slide_id", "done", "person", "code", "svs_text", "time_tag", "props", "label_text")


def _decoded(spark: SparkSession, sf_dir: str, part: tuple[int, int] = WHOLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files, and their tags and segments."""
    files = _files(spark, sf_dir, _slide, FORM, part, _SLIDE_COLUMNS)
    structure = stored(tiff.decode_structure(files, "path", "content", True))
    return files, tiff.as_tags(structure), tiff.as_segments(structure)


def _heads(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("content").alias("head"))


@query(
    "SELECT CAST(slide_id AS STRING) AS path, CASE WHEN slide_id % 3 = 0 THEN '>' ELSE '<' END AS byte_order, slide_id % 4 = 0 AS big, CAST(2 AS BIGINT) AS pages, CAST(CASE WHEN slide_id % 2 = 1 THEN 13 ELSE 14 END AS BIGINT) AS entries, CAST(length(label_text) + 1 AS BIGINT) AS label_size FROM {S} s"
)
def tiff_structure(spark, sf_dir):
    """Headers of all four kinds, directory chains, entry counts and sizes of values."""
    _, tags, _ = _decoded(spark, sf_dir)
    size = F.max(F.when(F.col("tag_id") == 65468, F.col("total_size")))
    return tags.groupBy("path").agg(F.first("byte_order").alias("byte_order"), (F.first("pointer_bytes") == 8).alias("big"), F.countDistinct("ifd_idx").alias("pages"), F.count("*").alias("entries"), size.alias("label_size"))


@query(
    "SELECT tag_id, tag_name, count(*) AS found FROM (SELECT unnest(CASE WHEN slide_id % 2 = 1 THEN [256, 256, 257, 270, 270, 273, 279, 306, 306, 315, 315, 65449, 65468] ELSE [256, 256, 257, 270, 270, 273, 279, 306, 306, 315, 315, 65421, 65449, 65468] END) AS tag_id FROM {S} s)"
    " JOIN (VALUES (256, 'ImageWidth'), (257, 'ImageLength'), (270, 'ImageDescription'), (273, 'StripOffsets'), (279, 'StripByteCounts'), (306, 'DateTime'), (315, 'Artist'), (65421, 'NDPI_SOURCELENS'), (65449, 'NDPI_SCANNER_PROPS'), (65468, 'NDPI_BARCODE')) AS v(tag_id, tag_name) USING (tag_id) GROUP BY 1, 2"
)
def tiff_tag_names(spark, sf_dir):
    return _decoded(spark, sf_dir)[1].groupBy("tag_id", "tag_name").agg(F.count("*").alias("found"))


_META = (
    "SELECT CAST(slide_id AS STRING) AS path, 0 AS ifd_idx, 'DateTime' AS found_name, left(time_tag, 30) AS preview FROM {S} s WHERE NOT done"
    " UNION ALL SELECT CAST(slide_id AS STRING), d, 'Artist', left(person, 50) FROM {S} s, (VALUES (0), (1)) AS v(d) WHERE NOT done"
    " UNION ALL SELECT CAST(slide_id AS STRING), d, 'ImageDescription', left(CASE WHEN d = 0 THEN svs_text ELSE 'the label' END, 50) FROM {S} s, (VALUES (0), (1)) AS v(d) WHERE slide_id % 2 = 0"
    " UNION ALL SELECT CAST(slide_id AS STRING), 0, 'NDPI_BARCODE', left(label_text, 50) FROM {S} s WHERE NOT done AND slide_id % 2 = 0"
    " UNION ALL SELECT CAST(slide_id AS STRING), 0, 'NDPI_SCANNER_PROPS', left(props, 50) FROM {S} s WHERE slide_id % 2 = 0"
)


@query(_META)
def tiff_metadata(spark, sf_dir):
    """The phases of metadata, a value that two directories share counted once."""
    files, tags, _ = _decoded(spark, sf_dir)
    return N.metadata_rows(N.tagged(tags, files)).select("path", "ifd_idx", "found_name", "preview")


@query("SELECT CAST(slide_id AS STRING) AS path, 'LabelImage' AS image, CAST(16 AS BIGINT) AS size, done FROM {S} s")
def tiff_images(spark, sf_dir):
    """Labels by description or lens, and whether they are blanked: by zeros, or by an empty JPEG."""
    files, tags, segments = _decoded(spark, sf_dir)
    return N.image_rows(N.tagged(tags, files), segments).select("path", "image", "size", "done")


@query("SELECT CAST(slide_id AS STRING) AS path, sha256(CASE WHEN NOT done THEN 'IMAGEDATA1234567' END) AS sha256 FROM {S} s WHERE NOT done")
def tiff_image_hashes(spark, sf_dir):
    """SHA-256 of a directory's image data; those of blanked ones are left out here."""
    blank = [r.sha256 for r in spark.sql("SELECT sha2(unhex(repeat('00', 16)), 256) AS sha256 UNION ALL SELECT sha2(unhex(concat('FFD8FFD9', repeat('00', 12))), 256)").collect()]
    return tiff.decode_hashes(_files(spark, sf_dir, _slide, FORM), "path", "content").where(~F.col("sha256").isin(*blank)).select("path", "sha256")


_LABEL = "CASE WHEN code LIKE 'MRN%' THEN 'MRN_Pattern' WHEN code LIKE 'CH%' THEN 'Accession_CH' ELSE concat('Accession_', split_part(code, '-', 1)) END"
_KEYS = {"svs": ("ScanScope ID", "Filename", "Date", "User"), "ndpi": ("NDP.S/N", "Created", "Operator.Id")}
_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
# In an SVS file the code stands in the fields of its description, in the barcode's tag, which is none of its own, and behind the
# directories; the same in an NDPI file, where only the barcode's place is known already. Pattern hits in the description follow its text.
_FOUND = (
    "SELECT CAST(slide_id AS STRING) AS path, tag_name, source, count(*) AS found FROM ("
    "SELECT slide_id, 'DateTime' AS tag_name, 'tiff_tag' AS source FROM {S} s WHERE NOT done"
    " UNION ALL SELECT slide_id, 'Artist', 'tiff_tag' FROM {S} s, (VALUES (0), (1)) AS v(d) WHERE NOT done"
    " UNION ALL SELECT slide_id, 'ImageDescription', 'tiff_tag' FROM {S} s, (VALUES (0), (1)) AS v(d) WHERE slide_id % 2 = 0"
    " UNION ALL SELECT slide_id, 'NDPI_BARCODE', 'tiff_tag' FROM {S} s WHERE NOT done AND slide_id % 2 = 0"
    f" UNION ALL SELECT slide_id, concat('NDPI_SCANNER_PROPS:', unnest({_list(_KEYS['ndpi'])})), 'tiff_tag' FROM {{S}} s WHERE NOT done AND slide_id % 2 = 0"
    f" UNION ALL SELECT slide_id, concat('SVS:Tag270:', unnest({_list(_KEYS['svs'])})), 'tiff_tag' FROM {{S}} s WHERE NOT done AND slide_id % 2 = 1"
    " UNION ALL SELECT slide_id, 'LabelImage', 'image_content' FROM {S} s WHERE NOT done"
    f" UNION ALL SELECT slide_id, concat('regex:', {_LABEL}), 'regex_scan' FROM {{S}} s, (VALUES (0), (1), (2)) AS v(d) WHERE NOT done AND (slide_id % 2 = 1 OR d < 2)"
    ") GROUP BY ALL"
)


@query(_FOUND)
def tiff_findings(spark, sf_dir):
    """The whole scan: own texts, metadata, images, and patterns where nothing is found already."""
    files, tags, segments = _decoded(spark, sf_dir)
    found = N.scan_tiffs(files, tags, segments, R.RuleSet(), _heads(files))
    return found.groupBy("path", "tag_name", "source").agg(F.count("*").alias("found"))


@query(f"SELECT CAST(slide_id AS STRING) AS path, concat('fallback:', {_LABEL}) AS tag_name, CAST(8 AS BIGINT) AS start, CAST(length(code) AS BIGINT) AS length, code AS value_preview FROM {{S}} s WHERE NOT done")
def ndpi_fallback_scan(spark, sf_dir):
    """NDPI files without a readable structure are searched by patterns alone."""
    files = _files(spark, sf_dir, lambda r: b"garbage " + (b"" if r.done else r.code.encode()) + b"\0", "'ndpi'")
    structure = tiff.decode_structure(files, "path", "content")
    found = N.scan_tiffs(files, tiff.as_tags(structure), tiff.as_segments(structure), R.RuleSet(), _heads(files))
    return found.select("path", "tag_name", F.col("offset").alias("start"), "length", "value_preview")


@query("SELECT CAST(slide_id AS STRING) AS path, concat('garbage ', CASE WHEN done THEN '' ELSE repeat('X', length(code)) END, chr(35)) AS text FROM {S} s")
def ndpi_fallback_redact(spark, sf_dir):
    files = _files(spark, sf_dir, lambda r: b"garbage " + (b"" if r.done else r.code.encode()) + b"\0#", "'ndpi'")
    structure = tiff.decode_structure(files, "path", "content")
    patches = A.tiff_patches(files, tiff.as_tags(structure), tiff.as_segments(structure), R.RuleSet(), _heads(files))
    return patched_contents(files, patches).select("path", F.regexp_replace(F.decode("content", "ISO-8859-1"), "\\x00", "").alias("text"))


def _cleaned(spark: SparkSession, sf_dir: str, part: tuple[int, int] = WHOLE) -> tuple[DataFrame, DataFrame]:
    """The files before and after their patches are spliced in."""
    files, tags, segments = _decoded(spark, sf_dir, part)
    patches = A.tiff_patches(files, tags, segments, R.RuleSet(), _heads(files))
    return files, patched_contents(files, patches)


# What a label text, crossed out as a whole or by pattern, leaves; its code is the whole match up to the NUL.
_GONE = "CASE WHEN done THEN {0} ELSE repeat('X', length({0})) END"


@query(
    "SELECT CAST(slide_id AS STRING) AS path, tag_id, value FROM ("
    " SELECT slide_id, 306 AS tag_id, CASE WHEN done THEN time_tag ELSE '' END AS value FROM {S} s"
    " UNION ALL SELECT slide_id, 315, CASE WHEN done THEN 'XXXX' ELSE '' END FROM {S} s"
    " UNION ALL SELECT slide_id, 65468, CASE WHEN done THEN label_text ELSE repeat('X', length(label_text)) END FROM {S} s WHERE slide_id % 2 = 0"
    " UNION ALL SELECT slide_id, 270, '' FROM {S} s WHERE slide_id % 2 = 0)"
)
def tiff_redacted_tags(spark, sf_dir):
    """Tags of the first directory after their patches: dates, extra metadata, barcodes, descriptions."""

    def work(part: tuple[int, int]) -> DataFrame:
        _, after = _cleaned(spark, sf_dir, part)
        tags = tiff.decode_tags(after, "path", "content").where("ifd_idx = 0 AND dir = 'main'")
        wanted = F.col("tag_id").isin(306, 315) | F.col("tag_id").isin(270, 65468) & (F.col("path").cast("long") % 2 == 0)
        return tags.where(wanted).select("path", "tag_id", N.text_of(F.col("raw")).alias("value"))

    return _by_parts(spark, sf_dir, work)


@query(
    "SELECT CAST(slide_id AS STRING) AS path, CASE WHEN done THEN svs_text ELSE concat('Image Library v12', chr(10), '1000x800|AppMag = 40|ScanScope ID = XXXXXXXX|Filename = ', repeat('X', length(code)), '|Date = 01/01/00|Time = 00:00:00|User = ', repeat('X', length(person)), '|MPP = 0.25') END AS value FROM {S} s WHERE slide_id % 2 = 1"
)
def svs_redacted_tag(spark, sf_dir):
    """The description of an SVS file after its patches, fitted to its old size."""
    _, after = _cleaned(spark, sf_dir)
    tags = tiff.decode_tags(after, "path", "content").where("ifd_idx = 0 AND dir = 'main' AND tag_id = 270")
    return tags.where(F.col("path").cast("long") % 2 == 1).select("path", N.text_of(F.col("raw")).alias("value"))


@query("SELECT CAST(slide_id AS STRING) AS path, CAST(1 AS BIGINT) AS pages, false AS has_image, true AS same_length FROM {S} s")
def tiff_unlinked_images(spark, sf_dir):
    """Labels are out of the chain after their patches, whatever the byte order and the width of offsets, and their data is gone."""

    def work(part: tuple[int, int]) -> DataFrame:
        before, after = _cleaned(spark, sf_dir, part)
        after = stored(after)
        pages = tiff.decode_tags(after, "path", "content").groupBy("path").agg(F.countDistinct("ifd_idx").alias("pages"))
        lengths = before.select("path", F.length("content").alias("_n"))
        has = F.decode("content", "ISO-8859-1").contains(IMAGE.decode())
        return after.join(lengths, "path").select("path", has.alias("has_image"), (F.length("content") == F.col("_n")).alias("same_length")).join(pages, "path")

    return _by_parts(spark, sf_dir, work)


@query(f"WITH f AS ({_FOUND}) SELECT (SELECT count(*) FROM {{S}} s) AS files, CAST(sum(found) AS BIGINT) AS findings_before, CAST(0 AS BIGINT) AS findings_after FROM f")
def verified_contents(spark, sf_dir):
    """Findings before the patches, and after them: none."""

    def work(part: tuple[int, int]) -> DataFrame:
        files, tags, segments = _decoded(spark, sf_dir, part)
        known = N.looked(files, tags, segments, R.RuleSet())
        before = N.scan_tiffs(files, tags, segments, R.RuleSet(), _heads(files), known)
        patches = A.tiff_patches(files, tags, segments, R.RuleSet(), _heads(files), known)
        after = stored(patched_contents(files, patches).join(files.select("path", "format"), "path"))
        structure = stored(tiff.decode_structure(after, "path", "content", True))
        left = N.scan_tiffs(after, tiff.as_tags(structure), tiff.as_segments(structure), R.RuleSet(), _heads(after))
        return files.agg(F.count("*").alias("files")).crossJoin(before.agg(F.count("*").alias("findings_before"))).crossJoin(left.agg(F.count("*").alias("findings_after")))

    return _by_parts(spark, sf_dir, work).agg(*(F.sum(n).alias(n) for n in ("files", "findings_before", "findings_after")))


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS found FROM (SELECT slide_id, 'PATTERN' AS kind FROM {{S}} s WHERE NOT done UNION ALL SELECT slide_id, 'PATTERN' FROM {{S}} s WHERE NOT done UNION ALL SELECT slide_id, 'PATTERN' FROM {{S}} s WHERE NOT done UNION ALL SELECT slide_id, 'IMAGE DATA' FROM {{S}} s WHERE NOT done) GROUP BY kind")
def second_look(spark, sf_dir):
    """The independent reader over the same files: the code, the tag's time, the date of the properties, and the label; nothing in those that are done."""
    files = _files(spark, sf_dir, _slide, FORM)
    found = recheck_contents(files, "path", "content").where("NOT (kind = 'IMAGE DATA' AND detail <> 'LabelImage')")
    jpeg = F.col("kind").eqNullSafe("IMAGE DATA") & (F.col("path").cast("long") % 5 == 0)  # an empty JPEG is data to it
    return found.where(~jpeg).groupBy("kind").agg(F.count("*").alias("found"))


def _located(r) -> bytes:
    """A file with EXIF and GPS directories."""
    exif = [text(36867, r.time_tag), text(37510, "XXXX" if r.done else r.code, 7)]
    gps = [(1, 2, 2, b"N\0\0\0"), (2, 5, 1, struct.pack("<II", 0 if r.done else 48, 1))]
    return Tiff().built([[(256, 3, 1, 1000), (34665, 4, 1, exif), (34853, 4, 1, gps)]])


@query(
    "SELECT CAST(slide_id AS STRING) AS path, 'EXIF:UserComment' AS found_name, code AS preview FROM {S} s WHERE NOT done"
    " UNION ALL SELECT CAST(slide_id AS STRING), 'EXIF:DateTimeOriginal', left(time_tag, 50) FROM {S} s"
    " UNION ALL SELECT CAST(slide_id AS STRING), 'GPS:GPSLatitudeRef', 'N' FROM {S} s"
    " UNION ALL SELECT CAST(slide_id AS STRING), 'GPS:GPSLatitude', 'GPS:GPSLatitude=48.0' FROM {S} s WHERE NOT done"
)
def exif_gps_scan(spark, sf_dir):
    files = _files(spark, sf_dir, _located, "'tiff'")
    return N.metadata_rows(N.tagged(tiff.decode_tags(files, "path", "content"), files)).select("path", "found_name", "preview")


@query("SELECT slide_id, CASE WHEN name LIKE '%.bif' THEN CASE WHEN done THEN 'tiff' ELSE 'bif' END WHEN name LIKE '%.scn' THEN CASE WHEN done THEN 'unknown' ELSE 'scn' END WHEN name LIKE '%.dcm' THEN CASE WHEN done THEN 'unknown' ELSE 'dicom' END WHEN name LIKE '%.TIFF' THEN CASE WHEN done THEN 'unknown' ELSE 'tiff' END ELSE lower(split_part(name, '.', 2)) END AS format FROM {S} s")
def detect_by_bytes(spark, sf_dir):
    """Formats by suffix and first bytes; a BigTIFF that is cut after its magic number, and heads that belong to another format."""
    s = slides(spark, sf_dir)
    ext = P.extension(F.col("name"))
    whole = F.when(ext == "dcm", F.lit("00" * 128 + "4449434D")).when(ext == "bif", "49492B0008000000").when(ext == "scn", "4D4D002A00000008").otherwise("4D4D002B00080000")
    wrong = F.when(ext == "bif", "49492B00").otherwise("474946383961")
    return s.select("slide_id", S.claimed_by(ext, F.unhex(F.when(F.col("done"), wrong).otherwise(whole))).alias("format"))


def _dicom(r) -> bytes:
    """An explicit or, for even slides, implicit file with a name, dates, private elements at two depths and an identifier."""
    implicit = r.slide_id % 2 == 0

    def element(group: int, number: int, vr: str, value: bytes, meta: bool = False) -> bytes:
        value += (b"\0" if vr == "UI" else b" ") * (len(value) % 2)
        head = struct.pack("<HH", group, number)
        if implicit and not meta:
            return head + struct.pack("<I", len(value)) + value
        return head + vr.encode() + (b"\0\0" + struct.pack("<I", len(value)) if vr == "SQ" else struct.pack("<H", len(value))) + value

    item = element(9, 0x10, "LO", b"VENDOR") + element(0x10, 0x20, "LO", b"" if r.done else r.code.encode())
    parts = [
        element(8, 0x18, "UI", f"1.2.840.{r.slide_id}".encode()),
        element(8, 0x20, "DA", b"19000101" if r.done else b"20240615"),
        element(9, 0x10, "LO", b"VENDOR"),
        element(0x10, 0x10, "PN", b"" if r.done else r.person.encode()),
        element(0x10, 0x20, "LO", b"" if r.done else r.code.encode()),
        element(0x10, 0x1040, "LO", b"Street"),
        element(*((0x40, 0x275) if implicit else (0x54, 0x16)), "SQ", struct.pack("<HHI", 0xFFFE, 0xE000, len(item)) + item),
        element(0x7FE0, 0x10, "OB" if implicit else "OW", b"")[:8] + b"\0" * 64,
    ]
    syntax = b"1.2.840.10008.1.2" if implicit else b"1.2.840.10008.1.2.1"
    return bytes(128) + b"DICM" + element(2, 0x10, "UI", syntax, True) + b"".join(parts)


_NOT_DONE = "CASE WHEN done THEN '' ELSE {0} END"


@query(
    "SELECT CAST(slide_id AS STRING) AS path, depth, tag, private, value FROM (SELECT slide_id, 0 AS depth, '0008,0018' AS tag, false AS private, concat('1.2.840.', slide_id) AS value FROM {S} s"
    " UNION ALL SELECT slide_id, 0, '0008,0020', false, CASE WHEN done THEN '19000101' ELSE '20240615' END FROM {S} s"
    " UNION ALL SELECT slide_id, d, '0009,0010', true, 'VENDOR' FROM {S} s, (VALUES (0), (1)) AS v(d)"
    " UNION ALL SELECT slide_id, 0, '0010,0010', false, CASE WHEN done THEN '' ELSE person END FROM {S} s"
    " UNION ALL SELECT slide_id, d, '0010,0020', false, CASE WHEN done THEN '' ELSE code END FROM {S} s, (VALUES (0), (1)) AS v(d)"
    " UNION ALL SELECT slide_id, 0, '0010,1040', false, 'Street' FROM {S} s)"
)
def dicom_elements(spark, sf_dir):
    """Elements of explicit and implicit files, with those of sequence items, up to the pixels."""
    rows = decode_elements(_files(spark, sf_dir, _dicom, "'dicom'"), "path", "content")
    return rows.where("NOT tag IN ('0002,0010', '0040,0275', '0054,0016')").select("path", "depth", "tag", "private", "value")


_DIGITS = "list_reduce([CAST(strpos('0123456789abcdef', substr(h, CAST(i AS INTEGER), 1)) - 1 AS UHUGEINT) FOR i IN range(1, 33)], lambda a, b: a * CAST(16 AS UHUGEINT) + b)"


def _uid_sql(uid: str, path: str) -> str:
    """The first 128 bits of the hash as a decimal number."""
    return f"SELECT *, left(concat('2.25.', CAST({_DIGITS} AS VARCHAR)), 64) AS new_uid FROM (SELECT *, sha256(concat({uid}, ':', {path})) AS h FROM {{S}} s)"


@query(
    f"WITH u AS ({_uid_sql("concat('1.2.840.', slide_id)", 'slide_id')}) SELECT CAST(slide_id AS STRING) AS path, depth, tag, value FROM (SELECT slide_id, 0 AS depth, '0008,0018' AS tag, new_uid AS value FROM u"
    " UNION ALL SELECT slide_id, 0, '0008,0020', '19000101' FROM u UNION ALL SELECT slide_id, 0, '0010,0010', '' FROM u UNION ALL SELECT slide_id, d, '0010,0020', '' FROM u, (VALUES (0), (1)) AS v(d) WHERE d = 0 OR slide_id % 2 = 1"
    " UNION ALL SELECT slide_id, 0, '0012,0062', 'YES' FROM u UNION ALL SELECT slide_id, 0, '0012,0063', 'Identifiers removed or replaced' FROM u)"
)
def dicom_redacted(spark, sf_dir):
    """Elements after the patches: blanked, deleted (of the implicit files' sequence all of it), replaced, private ones gone at any depth, and marked."""

    def work(part: tuple[int, int]) -> DataFrame:
        files = _files(spark, sf_dir, _dicom, "'dicom'", part, ("slide_id", "done", "person", "code"))
        parsed = stored(decode_parsed(files, "path", "content"))
        patches = A.dicom_patches(as_elements(parsed), as_nested_private(parsed))
        rows = decode_elements(patched_contents(files, patches), "path", "content")
        return rows.where("NOT tag IN ('0002,0010', '0040,0275', '0054,0016')").select("path", "depth", "tag", "value")

    return _by_parts(spark, sf_dir, work)


@query(f"SELECT slide_id, new_uid FROM ({_uid_sql("concat('1.2.840.', slide_id)", 'name')})")
def uid_remap(spark, sf_dir):
    s = slides(spark, sf_dir).select("slide_id", F.concat(F.lit("1.2.840."), "slide_id").alias("uid"), "name")
    return s.select("slide_id", D.remapped_uid("uid", "name").alias("new_uid"))


@query("SELECT CAST(slide_id AS STRING) AS path, concat(repeat('X', 12), repeat('Y', length(code) - 2), 'zzzz') AS patched FROM {S} s")
def patch_apply(spark, sf_dir):
    """Patches that overlap: of the later one the part that the earlier leaves is written."""
    s = slides(spark, sf_dir).select(F.col("slide_id").cast("string").alias("path"), F.concat(F.lit("aaaaaaaaaa"), "code", F.lit("zzzz")).cast("binary").alias("content"), F.length("code").alias("n"))
    row = lambda at, n, fill: F.struct(F.lit(at).cast("long").alias("offset"), n.cast("long").alias("length"), F.lit(ord(fill)).alias("fill"), F.lit(None).cast("binary").alias("payload"))
    patches = s.select("path", F.explode(F.array(row(0, F.lit(12), "X"), row(10, F.col("n"), "Y"))).alias("_p")).select("path", "_p.*")
    return patched_contents(s, patches).select("path", F.decode("content", "US-ASCII").alias("patched"))


@query("SELECT CAST(slide_id AS STRING) AS path, section, key, value FROM (SELECT slide_id, 'GENERAL' AS section, 'SLIDE_NAME' AS key, code AS value FROM {S} s UNION ALL SELECT slide_id, 'GENERAL', 'Slide_Version', '2%' FROM {S} s UNION ALL SELECT slide_id, 'X', 'OPERATOR', person FROM {S} s)")
def ini_decode(spark, sf_dir):
    """INI texts: keys keep their case, percent signs mean nothing, a byte-order mark is skipped."""
    made = slides(spark, sf_dir).selectExpr("CAST(slide_id AS STRING) AS path", "concat('\\uFEFF[GENERAL]\\nSLIDE_NAME = ', code, '\\nSlide_Version=2%\\n[X]\\nOPERATOR=', person, '\\n') AS ini")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *row) for p, t in zip(batch["path"], batch["ini"], strict=True) for row in parse_ini(t)], columns=["path", "section", "key", "value"])

    return made.mapInPandas(run, "path string, section string, key string, value string")


@query("SELECT doc_id, regexp_replace(text, '[^\\x20-\\x7E]', '?', 'g') AS safe FROM documents")
def sanitized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.sanitized(F.col("text")).alias("safe"))


@query("SELECT CAST(slide_id AS STRING) AS path, concat('out/', stem, CASE WHEN n > 1 THEN concat('-', n) ELSE '' END, '.png') AS output, 'png' AS target FROM (SELECT slide_id, stem, row_number() OVER (PARTITION BY stem ORDER BY CAST(slide_id AS STRING)) AS n FROM (SELECT slide_id, concat('case-', slide_id % 100) AS stem FROM {S} s))")
def conversion_plan(spark, sf_dir):
    files = slides(spark, sf_dir).selectExpr("CAST(slide_id AS STRING) AS path", "concat('case-', slide_id % 100) AS stem")
    return C.plan(files, "out/", "png")


@query("SELECT count(*) AS total, count(*) FILTER (slide_id % 11 <> 0) AS converted, count(*) FILTER (slide_id % 11 = 0) AS errored FROM {S} s")
def conversion_counts(spark, sf_dir):
    return C.conversion_stats(slides(spark, sf_dir).selectExpr("CAST(slide_id AS STRING) AS path", "CASE WHEN slide_id % 11 = 0 THEN 'no codec' END AS error"))


@query("SELECT format, ext FROM (VALUES ('ndpi', 'ndpi'), ('svs', 'svs'), ('mrxs', 'mrxs'), ('bif', 'bif'), ('scn', 'scn'), ('dicom', 'dcm'), ('dicom', 'dicom'), ('tiff', 'tif'), ('tiff', 'tiff')) AS v(format, ext)")
def supported_formats(spark, sf_dir):
    """The formats with their suffixes."""
    return spark.createDataFrame([(kind, ext) for kind, exts in P.EXTENSIONS.items() for ext in exts], "format string, ext string")


def _pyramid(r) -> bytes:
    level = lambda w, h: [(256, 4, 1, w), (257, 4, 1, h)]
    width = 4000 + r.slide_id % 100 * 40
    return Tiff().built([[*level(width, 2000), text(270, "x|MPP = 0.25|y")], level(width // 4, 500), level(90, 70)])


@query("SELECT CAST(slide_id AS STRING) AS path, level, CAST(CASE WHEN level = 0 THEN 4000 + slide_id % 100 * 40 ELSE 1000 + slide_id % 100 * 10 END AS BIGINT) AS width, CASE WHEN level = 0 THEN 1.0 ELSE 4.0 END::DOUBLE AS downsample FROM {S} s, (VALUES (0), (1)) AS v(level)")
def pyramid_levels(spark, sf_dir):
    """Levels of a pyramid from the sizes of its pages; pages of another shape are none."""
    return pyramid(tiff.decode_tags(_files(spark, sf_dir, _pyramid, "'svs'"), "path", "content")).select("path", F.col("level").cast("int").alias("level"), F.col("width").cast("long").alias("width"), F.col("downsample").cast("double").alias("downsample"))
