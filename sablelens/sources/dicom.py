"""A parser of DICOM files, explicit or implicit VR, little endian, by seeking and up to the pixel data; nested datasets become rows."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from sablelens.functions import tables as T
from sablelens.sources.files import decoded, open_file

ELEMENTS = "path string, depth int, item_path string, tag string, vr string, private boolean, value string, items int, start long, value_offset long, end long, error string"
NAMES = [p.split()[0] for p in ELEMENTS.split(", ")]
#: VRs whose lengths take four bytes; those of text; the pixel data, delimiters and transfer syntaxes.
LONG_VRS = frozenset(("OB", "OD", "OF", "OL", "OV", "OW", "SQ", "UC", "UN", "UR", "UT", "SV", "UV"))
TEXT_VRS = frozenset(("AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT"))
PIXELS, ITEM, ITEM_END, SEQUENCE_END = (0x7FE0, 0x0010), (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
IMPLICIT = "1.2.840.10008.1.2"
#: Transfer syntaxes with another byte order, and with everything compressed; such files are errors, never clean.
NOT_READ = ("1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99")
SHORT, LONG, PAIR = struct.Struct("<H"), struct.Struct("<I"), struct.Struct("<HH")
WINDOW = 1 << 16
UNDEFINED = 0xFFFFFFFF
MOST_DEPTH = 16


#: VRs for implicit files, of the elements that matter here; others are UN.
IMPLICIT_VRS = {t: vr for t, _, vr in T.dicom_blank()} | {t: "UI" for t in T.DICOM_UIDS} | {t: "SQ" if n.endswith("Sequence") else "LO" for t, n in T.dicom_delete()}


@lru_cache(1 << 16)
def _tag(group: int, element: int) -> str:
    return f"{group:04X},{element:04X}"


class Window:
    """Bytes of an open file by place, of which WINDOW are held at a time."""

    def __init__(self, f):
        self.f, self.at, self.held, self.end = f, 0, b"", 0
        f.seek(0, 2)
        self.size = f.tell()

    def __len__(self) -> int:
        return self.size

    def part(self, at: int, n: int) -> bytes:
        if n > WINDOW:
            self.f.seek(at)
            return self.f.read(n)
        if not self.at <= at <= at + n <= self.end:
            self._hold(at)
        return self.held[at - self.at : at - self.at + n]

    def unpack(self, form: struct.Struct, at: int) -> tuple:
        if not self.at <= at <= at + form.size <= self.end:
            self._hold(at)
        return form.unpack_from(self.held, at - self.at)

    def _hold(self, at: int) -> None:
        self.f.seek(at)
        self.at, self.held = at, self.f.read(WINDOW)
        self.end = at + len(self.held)


class Reader:
    """Reads the structure and the texts of an open file, by seeking; pixels and other binary values are passed over."""

    def __init__(self, f):
        self.raw, self.rows, self.implicit = Window(f), [], False
        if self.raw.part(128, 4) != b"DICM":
            raise ValueError("not a DICOM file")
        #: Sequences and items of a defined length: where its field is, where the content begins and ends.
        self.sized: list[tuple[int, int, int]] = []

    def parse(self) -> list[tuple]:
        at = 132
        while at + 8 <= len(self.raw) and self.raw.unpack(SHORT, at)[0] == 2:
            at, row = self._element(at, 0, "", meta=True)
            if row and row[2] == "0002,0010":
                self.implicit = row[5] == IMPLICIT
                if row[5] in NOT_READ:
                    raise ValueError(f"transfer syntax {row[5]} is not read")
        self._dataset(at, len(self.raw), 0, "")
        return self.rows

    def _dataset(self, at: int, stop: int, depth: int, path: str) -> int:
        while at + 8 <= stop:
            tag = self.raw.unpack(PAIR, at)
            if tag == ITEM_END or tag == SEQUENCE_END:
                return at + 8
            if tag == PIXELS and depth == 0:
                return at
            at, row = self._element(at, depth, path)
        return at

    def _element(self, at: int, depth: int, path: str, meta: bool = False) -> tuple[int, tuple | None]:
        start, (group, element) = at, self.raw.unpack(PAIR, at)
        tag = _tag(group, element)
        if self.implicit and not meta:
            vr, length, at = IMPLICIT_VRS.get(tag, "UN"), self.raw.unpack(LONG, at + 4)[0], at + 8
        else:
            vr = self.raw.part(at + 4, 2).decode("ascii", "replace")
            if vr in LONG_VRS:
                length, at = self.raw.unpack(LONG, at + 8)[0], at + 12
            else:
                length, at = self.raw.unpack(SHORT, at + 6)[0], at + 8
        place = len(self.rows)
        if vr == "SQ" or length == UNDEFINED:
            self.rows.append(None)
            if length != UNDEFINED:
                self.sized.append((at - 4, at, min(at + length, len(self.raw))))
            end, items = self._sequence(at, len(self.raw) if length == UNDEFINED else min(at + length, len(self.raw)), depth, f"{path}{tag}")
            row = (depth, path, tag, vr, bool(group % 2), None, items, start, at, end)
            self.rows[place] = row
        else:
            end = at + length
            if end > len(self.raw):
                raise ValueError("a value runs past the end of the file")
            value = self.raw.part(at, length).decode("utf-8", "replace").rstrip("\0 ") if vr in TEXT_VRS or vr == "UN" and length < 256 else None
            row = (depth, path, tag, vr, bool(group % 2), value, None, start, at, end)
            self.rows.append(row)
        return end, row

    def _sequence(self, at: int, stop: int, depth: int, path: str) -> tuple[int, int]:
        items = 0
        while at + 8 <= stop:
            tag, length = self.raw.unpack(PAIR, at), self.raw.unpack(LONG, at + 4)[0]
            at += 8
            if tag == SEQUENCE_END:
                return at, items
            if tag != ITEM:
                break
            inner = stop if length == UNDEFINED else min(at + length, stop)
            if length != UNDEFINED:
                self.sized.append((at - 4, at, inner))
            if depth + 1 < MOST_DEPTH:
                at = max(self._dataset(at, inner, depth + 1, f"{path}[{items}]/"), at if length == UNDEFINED else inner)
            else:
                at = inner
            items += 1
        return at, items


def element_rows(path: str, content) -> list[tuple]:
    """Rows of ELEMENTS of an open file or of bytes; one with the error of what can't be read."""
    try:
        return [(path, *r, None) for r in Reader(io.BytesIO(content) if isinstance(content, bytes) else content).parse()]
    except (ValueError, struct.error) as why:
        return [(path, *[None] * (len(NAMES) - 2), str(why))]


def nested_private(f) -> list[tuple[int, int, bytes]]:
    """(offset, length, payload): what drops the private elements in sequence items and corrects the lengths of all around them."""
    reader = Reader(f)
    return _without_private(reader.parse(), reader.sized)


def _without_private(rows: list[tuple], sized: list[tuple[int, int, int]]) -> list[tuple[int, int, bytes]]:
    gone: list[tuple[int, int]] = []
    for start, end in sorted((r[7], r[9]) for r in rows if r[0] > 0 and r[4]):
        if not gone or start >= gone[-1][1]:  # one inside of another goes with it
            gone.append((start, end))
    if not gone:
        return []
    out = [(a, b - a, b"") for a, b in gone]
    for field, start, end in sized:
        less = sum(b - a for a, b in gone if start <= a and b <= end)
        if less:
            out.append((field, 4, LONG.pack(end - start - less)))
    return out


#: Rows of both kinds, so that a file is parsed once.
PARSED = f"of string, {ELEMENTS}, offset long, length long, payload binary"
_NO_PATCH, _NO_ELEMENT = (None,) * 3, (None,) * (len(NAMES) - 1)


def parsed_rows(path: str, f) -> list[tuple]:
    """Rows of PARSED of an open file: its elements, and what nested_private gives; one with the error of what can't be read."""
    try:
        reader = Reader(f)
        rows = reader.parse()
    except (ValueError, struct.error) as why:
        return [("element", path, *[None] * (len(NAMES) - 2), str(why), *_NO_PATCH)]
    return [("element", path, *r, None, *_NO_PATCH) for r in rows] + [("patch", path, *_NO_ELEMENT, *r) for r in _without_private(rows, reader.sized)]


def decode_parsed(contents: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of PARSED from files that are held in a binary column; as_elements and as_nested_private take them apart."""
    return decoded(contents, key, content, parsed_rows, PARSED)


def as_elements(parsed: DataFrame) -> DataFrame:
    return parsed.where("of = 'element'").select(*NAMES)


def as_nested_private(parsed: DataFrame) -> DataFrame:
    return parsed.where("of = 'patch'").select("path", "offset", "length", "payload")


def decode_nested_private(contents: DataFrame, key: str, content: str) -> DataFrame:
    """The rows of nested_private from files that are held in a binary column; key, as text, stands for their path."""
    return decoded(contents, key, content, lambda k, f: [(k, *r) for r in nested_private(f)], "path string, offset long, length long, payload binary")


def read_nested_private(files: DataFrame) -> DataFrame:
    """The rows of nested_private by path; none of a file that can't be read, which read_elements reports."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with open_file(path) as f:
                        rows = [(path, *r) for r in nested_private(f)]
                except (OSError, ValueError, struct.error):
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "offset", "length", "payload"]).astype(object)

    return files.select("path").mapInPandas(run, "path string, offset long, length long, payload binary")


def decode_elements(contents: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of ELEMENTS from files that are held in a binary column; key, as text, stands for their path."""
    return decoded(contents, key, content, element_rows, ELEMENTS)


def read_elements(files: DataFrame) -> DataFrame:
    """A row per element, nested ones with their depth and the path to their item; see ELEMENTS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with open_file(path) as f:
                        rows = element_rows(path, f)
                except OSError as why:
                    rows = [(path, *[None] * (len(NAMES) - 2), str(why))]
                yield pd.DataFrame(rows, columns=NAMES).astype(object)

    return files.select("path").mapInPandas(run, ELEMENTS)
