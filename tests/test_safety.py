"""Overlapping patches, offsets beyond two gigabytes, preflight, the log, and files blanked by other means."""

from __future__ import annotations

import struct

import pytest

from sablelens.operators import report as G
from sablelens.operators.scan import scan
from sablelens.operators.sink import splice, uncovered_part
from sablelens.plans.containers import Tiff
from sablelens.sources.files import list_files, walk
from tests.builders import text, tiff


def test_overlapping_patches_leave_nothing(tmp_path):
    (tmp_path / "a").write_bytes(b"aaaaaaaaaaSECRETSECRETzzzz")
    splice(str(tmp_path / "a"), str(tmp_path / "b"), [(0, 16, ord("x"), None), (10, 12, ord("y"), None), (12, 2, ord("q"), None), (20, 4, None, b"1234")])
    assert (tmp_path / "b").read_bytes() == b"x" * 16 + b"y" * 6 + b"34" + b"zz"
    assert uncovered_part((5, 3, 0, None), 8) is None and uncovered_part((5, 5, 0, None), 8) == (8, 2, 0, None)
    with pytest.raises(ValueError):
        uncovered_part((5, 5, None, b""), 8)


def test_values_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file whose only directory lies behind 2**31 bytes."""
    at = (1 << 31) + 4096
    body = b"2024:06:15 10:30:00\0"
    with open(tmp_path / "far.svs", "wb") as f:
        f.write(b"II" + struct.pack("<HI", 42, at))
        f.seek(at)
        f.write(struct.pack("<H", 1) + struct.pack("<HHII", 306, 2, 20, at + 18) + bytes(4) + body)
    rows = scan(spark, str(tmp_path))[1].collect()
    assert [(r["tag_name"], r["offset"]) for r in rows] == [("DateTime", at + 18)]


def test_preflight_and_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.svs").write_bytes(tiff([[text(270, "x")]]))
    (tmp_path / "file").write_text("")
    files = list_files(walk(spark, str(tmp_path / "in")))
    said = lambda *a: {(r["level"], r["message"].split(":")[0]) for r in G.preflight(*a).collect()}
    assert said(files, str(tmp_path / "out"), 1 << 40) == {("warning", "Output directory will be created")}
    assert said(files, str(tmp_path / "file"), 1) == {("error", "Output path exists but is not a directory"), ("error", "Insufficient disk space")}
    assert said(files.limit(0)) == {("error", "No files to process.")}
    assert said(files.selectExpr("'/none/x.svs' AS path", "'x.svs' AS name", "length")) == {("error", "Cannot read x.svs")}
    results = spark.createDataFrame([("p1", None, 3, True), ("p2", "why", 0, False), ("p3", None, 1, False)], "path string, error string, cleared int, verified boolean")
    lines = [r["line"].split("] ", 1)[1] for r in G.result_log(results).collect()]
    assert lines == ["[INFO]  p1: 3 cleared", "[ERROR] p2: why", "[WARN]  p3: 1 cleared"]


def test_images_blanked_by_other_means(spark, tmp_path):
    pixel = b"\xff\xd8\xff\xe0" + bytes(60) + b"\xff\xc0\0\x11\x08\0\1\0\1\3" + bytes(200)
    for name, image in (("zero", bytes(64)), ("empty", b"\xff\xd8\xff\xd9" + bytes(60)), ("pixel", pixel), ("real", b"\xff\xd8\xff\xe0" + b"picture" * 20)):
        entries = [text(270, "the label"), (273, 4, 1, "image"), (279, 4, 1, len(image))]
        (tmp_path / f"{name}.svs").write_bytes(Tiff().built([[(256, 3, 1, 9)], entries], {"image": image}))
    found = {r["path"].rsplit("/", 1)[1] for r in scan(spark, str(tmp_path))[1].where("source = 'image_content'").collect()}
    assert found == {"real.svs"}
