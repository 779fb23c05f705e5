"""A second look at finished files that shares neither the decoder nor the matcher of the scan: everything that could still identify.

Directories are read as NumPy records and patterns are Python's own, so that a fault of the engine's decoder or of its
expressions doesn't hide from it.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sablelens.functions import rules as R
from sablelens.functions import tables as T
from sablelens.sources.files import open_file

#: Bytes searched by patterns, the shortest value reported, the tags that hold blobs, and the pages looked at.
HEAD, SHORTEST, BLOBS, MOST_PAGES = 200 * 1024, 4, (700, 33723, 34675, 37510, 42016), 200
FOUND = "path string, kind string, detail string"
#: A header's first four bytes to byte order, and whether offsets take eight bytes.
HEADERS = {b"II\x2a\0": ("<", False), b"MM\0\x2a": (">", False), b"II\x2b\0": ("<", True), b"MM\0\x2b": (">", True)}


def _records(f, at: int, order: str, big: bool) -> tuple[np.ndarray, int]:
    """The entries of the directory at a place, and the place of the next; none where the file ends first."""
    wide = np.dtype(f"{order}u{8 if big else 2}")
    entry = np.dtype([("tag", f"{order}u2"), ("kind", f"{order}u2"), ("n", f"{order}u{8 if big else 4}"), ("field", f"{order}u{8 if big else 4}")])
    f.seek(at)
    head = f.read(wide.itemsize)
    n = int(np.frombuffer(head, wide)[0]) if len(head) == wide.itemsize else 0
    body = f.read(min(n, 5000) * entry.itemsize + entry["field"].itemsize)
    got = len(body) // entry.itemsize if len(body) < n * entry.itemsize else n
    entries = np.frombuffer(body, entry, got)
    rest = body[n * entry.itemsize :]
    return entries, int(np.frombuffer(rest, entry["field"])[0]) if len(rest) == entry["field"].itemsize else 0


def _value(f, at: int, k: int, entries: np.ndarray, order: str, big: bool) -> bytes:
    """The bytes of the k-th entry's value."""
    e = entries[k]
    size, room = T.TYPE_BYTES.get(int(e["kind"]), 1) * int(e["n"]), 8 if big else 4
    f.seek(at + (8 if big else 2) + (k + 1) * entries.dtype.itemsize - room if size <= room else int(e["field"]))
    return f.read(size)


def _look(path: str, f, rules: list[tuple[str, re.Pattern]]) -> Iterator[tuple[str, str, str]]:
    head = f.read(HEAD)
    if head[:4] not in HEADERS:
        yield path, "ERROR", "not a valid TIFF file"
    else:
        order, big = HEADERS[head[:4]]
        at, seen = int(np.frombuffer(head[8:16] if big else head[4:8], f"{order}u{8 if big else 4}")[0]) if len(head) >= (16 if big else 8) else 0, set()
        while at and at not in seen and len(seen) < MOST_PAGES:
            seen.add(at)
            entries, follow = _records(f, at, order, big)
            tags = entries["tag"].tolist()
            for k, tag in enumerate(tags):
                if tag in BLOBS and (value := _value(f, at, k, entries, order, big)).strip(b"\0"):
                    yield path, "BINARY TAG", f"Tag_{tag}: {len(value)} bytes"
            yield from _image(path, f, at, tags, entries, order, big)
            at = follow
    text, hits = head.decode("latin-1"), {}
    for label, pattern in rules:
        for m in pattern.finditer(text):
            if len(m[0]) >= SHORTEST and not any(s in m[0] for s in R.DATE_SENTINELS):
                hits[f"{label}: {m[0]}"] = None
    yield from ((path, "PATTERN", h) for h in hits)


def _image(path: str, f, at: int, tags: list[int], entries: np.ndarray, order: str, big: bool) -> Iterator[tuple[str, str, str]]:
    """A label or macro picture that still has data."""
    if 270 not in tags:
        return
    words = _value(f, at, tags.index(270), entries, order, big).lower()
    name = "LabelImage" if b"label" in words else "MacroImage" if b"macro" in words else None
    place = next((t for t in (273, 324) if t in tags), None)
    if name is None or place is None:
        return
    k = tags.index(place)
    raw, width = _value(f, at, k, entries, order, big), {3: 2, 4: 4, 16: 8}.get(int(entries[k]["kind"]))
    if width and len(raw) >= width:
        f.seek(int(np.frombuffer(raw[:width], f"{order}u{width}")[0]))
        if f.read(8).strip(b"\0"):
            yield path, "IMAGE DATA", name


def recheck_contents(contents: DataFrame, key: str, content: str, rules: tuple[R.Rule, ...] = R.IDENTIFIERS + R.DATES) -> DataFrame:
    """The same over files that are held in a binary column; key, as text, stands for their path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(r.label, re.compile(r.pattern, re.ASCII)) for r in rules]
        for batch in batches:
            rows = [r for k, raw in zip(batch["key"], batch["content"], strict=True) for r in _look(k, io.BytesIO(bytes(raw)), compiled)]
            yield pd.DataFrame(rows, columns=["path", "kind", "detail"])

    return contents.selectExpr(f"CAST(`{key}` AS STRING) AS key", f"`{content}` AS content").mapInPandas(run, FOUND)


def recheck(files: DataFrame, rules: tuple[R.Rule, ...] = R.IDENTIFIERS + R.DATES) -> DataFrame:
    """path, kind, detail: unreadable files, blobs that aren't zeroed, distinct pattern hits in the head, and label or macro images with data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(r.label, re.compile(r.pattern, re.ASCII)) for r in rules]
        for batch in batches:
            for path in batch["path"]:
                try:
                    with open_file(path) as f:
                        rows = list(_look(path, f, compiled))
                except (OSError, ValueError, OverflowError) as why:
                    rows = [(path, "ERROR", str(why))]
                yield pd.DataFrame(rows, columns=["path", "kind", "detail"])

    return files.select("path").mapInPandas(run, FOUND)
