"""The data source, the stream over a folder, the second look, and pyramids."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sablelens.functions import rules as R
from sablelens.operators import anonymize as A
from sablelens.operators import durable
from sablelens.operators import scan as N
from sablelens.operators.levels import pyramid
from sablelens.operators.recheck import recheck
from sablelens.operators.sink import patched_contents
from sablelens.plans import containers
from sablelens.sources import tiff as tiff_source
from sablelens.sources.datasource import register
from sablelens.sources.dicom import ELEMENTS, element_rows
from sablelens.sources.files import list_files, walk
from sablelens.sources.tiff import read_tags
from sablelens.streaming.landing import watch
from tests.builders import text, tiff


def test_data_source_pushes_filters(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.svs").write_bytes(tiff([[(256, 3, 1, 100 + k), text(270, f"text {k}"), text(305, "soft")], [(256, 3, 1, 5)]]))
    (tmp_path / "other.txt").write_text("no slide")
    (tmp_path / "bad.svs").write_text("no slide")
    register(spark)
    rows = spark.read.format("slides").load(str(tmp_path))
    assert rows.count() == 13 and rows.where("error IS NOT NULL").count() == 1
    some = rows.where("tag_id = 270 AND dir = 'main'")
    assert sorted(bytes(r["raw"]) for r in some.collect()) == [b"text 0\0", b"text 1\0", b"text 2\0"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "= 270" not in plan and "= main" not in plan, "the decoder filters, not Spark"


def test_damaged_files(spark, tmp_path):
    good = tiff([[(256, 3, 1, 7), text(270, "long enough to lie outside")]])
    cases = {
        "empty": b"",
        "one": b"I",
        "header": good[:8],
        "cut": good[:20],
        "value": good[:-10],
        "cycle": good[:34] + (8).to_bytes(4, "little") + good[38:],
        "past": good[:4] + (99999).to_bytes(4, "little") + good[8:],
        "many": good[:8] + b"\xff\xff" + good[10:],
    }
    for name, content in cases.items():
        (tmp_path / f"{name}.tif").write_bytes(content)
    rows = read_tags(list_files(walk(spark, str(tmp_path)))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[1][:-4], []).append(r)
    assert all(by[n][0]["error"] for n in ("empty", "one")) and len(by["cycle"]) == 2
    assert not {"header", "past", "many", "cut"} & set(by) and len(by["value"]) == 2


def test_stream(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    take = lambda df, n: seen.extend((r["path"].rsplit("/", 1)[1], r["value"]) for r in df.collect())
    (folder / "a.ndpi").write_bytes(tiff([[text(270, "AS-24-123456")]]))
    watch(spark, str(folder), str(tmp_path / "c"), take).awaitTermination(60)
    (folder / "b.tif").write_bytes(tiff([[text(270, "CH12345")]]))
    (folder / "c.txt").write_text("AS-24-123456")
    watch(spark, str(folder), str(tmp_path / "c"), take).awaitTermination(60)
    assert seen == [("a.ndpi", "AS-24-123456"), ("b.tif", "CH12345")]


def test_second_look(spark, tmp_path):
    (tmp_path / "a.svs").write_bytes(tiff([[text(270, "macro AS-24-123456 AS-24-123456"), (273, 4, 1, 8), (279, 4, 1, 4), text(700, "<x/>", 7)]]))
    (tmp_path / "b.svs").write_bytes(tiff([[(256, 3, 1, 7)]]))
    (tmp_path / "c.svs").write_bytes(b"junk")
    got = sorted((r["path"][-5:], r["kind"], r["detail"]) for r in recheck(list_files(walk(spark, str(tmp_path)))).collect())
    assert got == [("a.svs", "BINARY TAG", "Tag_700: 5 bytes"), ("a.svs", "IMAGE DATA", "MacroImage"), ("a.svs", "PATTERN", "Accession_AS: AS-24-123456"), ("c.svs", "ERROR", "not a valid TIFF file")]


def test_pyramid(spark, tmp_path):
    level = lambda w, h, *more: [(256, 3, 1, w), (257, 3, 1, h), *more]
    (tmp_path / "a.svs").write_bytes(tiff([level(4000, 2000, text(270, "x|MPP = 0.5|y")), level(300, 400), level(1000, 500)]))
    got = pyramid(read_tags(list_files(walk(spark, str(tmp_path))))).orderBy("level").select("level", "width", "downsample", F.round("pixels_per_cm", 1)).collect()
    assert [tuple(r) for r in got] == [(0, 4000, 1.0, 20000.0), (1, 1000, 4.0, 5000.0)]


def test_svs_scanned_on_the_date_that_means_removed_is_found_and_cleaned(spark):
    raw = tiff([[(256, 3, 1, 9), text(270, "L|Filename = AS-24-123456|Date = 01/01/00|Time = 00:00:00")]])
    files = spark.createDataFrame([("a", "svs", raw)], "path string, format string, content binary")

    def found(files):
        structure = tiff_source.decode_structure(files, "path", "content")
        heads = files.selectExpr("path", "content AS head")
        args = files, tiff_source.as_tags(structure), tiff_source.as_segments(structure), R.RuleSet(), heads
        return args, sorted(r.tag_name for r in N.scan_tiffs(*args).where("source = 'tiff_tag'").collect())

    args, before = found(files)
    assert before == ["SVS:Tag270:Date", "SVS:Tag270:Filename"]
    after = patched_contents(files, A.tiff_patches(*args)).selectExpr("path", "'svs' AS format", "content")
    assert found(after)[1] == []


def test_container_files_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    spark.range(10).selectExpr("id AS o_orderkey", "0L AS o_custkey", "TIMESTAMP_NTZ '2024-01-02 00:00:00' AS o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1).selectExpr("id AS c_custkey", "'n' AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(containers, "FILES_A_TASK", 3)
    files = containers._files(spark, str(tmp_path), lambda r: b"x", "'svs'")
    assert files.rdd.getNumPartitions() == 4 and files.count() == 10


def test_dicom_patches_read_nested_elements_once(spark):
    read = spark.sparkContext.accumulator(0)

    def nested(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch.assign(length=2, payload=b"")

    rows = element_rows("0", containers._dicom(SimpleNamespace(slide_id=1, done=False, code="AS-24-123456", person="p")))
    elements = spark.createDataFrame(rows, ELEMENTS)
    patches = A.dicom_patches(elements, spark.range(1).selectExpr("CAST(id AS STRING) AS path", "9L AS offset").mapInPandas(nested, "path string, offset long, length long, payload binary"))
    assert patches.where("offset = 9").count() == 1 and read.value == 1


def test_dicom_parser_looks_its_tables_up_once(monkeypatch):
    raw = containers._dicom(SimpleNamespace(slide_id=2, done=False, code="AS-24-123456", person="p"))
    monkeypatch.setattr("sablelens.functions.tables.dicom_blank", lambda: 1 / 0)
    rows = element_rows("0", raw)
    assert [(r[3], r[4]) for r in rows if r[3] in ("0008,0020", "0040,0275")] == [("0008,0020", "DA"), ("0040,0275", "SQ")]


def test_parts_leave_only_their_results(spark, tmp_path):
    folder = Path(durable._folder(spark).removeprefix("file:"))
    durable.stored(spark.range(1))
    before = set(folder.iterdir())
    got = durable.in_parts(spark, 3, lambda k: durable.stored(durable.kept(spark.range(k, k + 2))))
    assert sorted(r.id for r in got.collect()) == [0, 1, 1, 2, 2, 3]
    assert len(set(folder.iterdir()) - before) == 1


def test_container_queries_give_the_same_in_parts(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    made = lambda: sorted(map(tuple, containers.dicom_redacted(spark, sf_dir).collect()))
    whole = made()
    monkeypatch.setattr(containers, "FILES_A_PART", 700)
    assert made() == whole and len(whole) > 9000


def test_rules_are_tried_only_where_their_matches_can_begin():
    known = {r.label: R.needed(r.pattern) for r in R.IDENTIFIERS}
    assert (known["Accession_AS4"], known["Accession_H"], known["MRN_Pattern"], known["SSN_Pattern"]) == ("AS-", "H-", "MRN", "")
    for pattern, begin in (("AB|CD", ""), ("(?i)ab", ""), ("ab?c", "a"), ("ab{0,1}", "a"), ("ab+", "ab"), ("A(x|y)", "A"), (r"A\(|B", ""), (r"(?<!a|b)XY\d", "XY"), ("A(?:(c)|d)", ""), ("^A", "")):
        assert R.needed(pattern) == begin


@pytest.mark.parametrize("name", ["tiff_redacted_tags", "tiff_unlinked_images", "verified_contents"])
def test_tiff_queries_leave_only_their_results(spark, monkeypatch, name):
    folder = Path(durable._folder(spark).removeprefix("file:"))
    monkeypatch.setattr(containers, "FILES_A_PART", 800)
    before = set(folder.iterdir())
    got = containers.QUERIES[name](spark, "/root/testdata/sf0.001")
    left = set(folder.iterdir()) - before
    assert len(left) == 1 and len(list(left.pop().iterdir())) == 2
    rows = got.collect()
    if name == "verified_contents":
        assert len(rows) == 1 and rows[0].files == 1500 and rows[0].findings_before > 0 and rows[0].findings_after == 0
    elif name == "tiff_unlinked_images":
        assert len({r.path for r in rows}) == len(rows) == 1500 and {tuple(r)[1:] for r in rows} == {(False, True, 1)}
    else:
        assert len(rows) == 4500
