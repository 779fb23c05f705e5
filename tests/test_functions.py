"""Rules and field functions on values that are easy to get wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sablelens.functions import fields as P
from sablelens.functions import rules as R
from sablelens.operators import report as G
from sablelens.operators.patches import first_per_offset, uncovered, unlink


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("AS-24-123", [("Accession_AS", 0, 9)]),
        ("as-24-123456", []),
        ("AS-24-12", []),
        ("x AS-2024-1234 y", [("Accession_AS4", 2, 12)]),
        ("CH-24-123 H-24-123", [("Accession_H", 10, 8)]),
        ("BH-24-123", []),
        ("AS-24-111,AS-24-222", [("Accession_AS", 0, 9), ("Accession_AS", 10, 9)]),
        ("1123-45-6789", []),
        ("123-45-6789", [("SSN_Pattern", 0, 11)]),
        ("00000AS12", [("Accession_Padded", 0, 9)]),
        ("MRN#12345 MRN 99999", [("MRN_Pattern", 0, 9), ("MRN_Pattern", 10, 9)]),
        ("DOB:1980/01/02", [("DOB_Pattern", 0, 14)]),
        ("é😀CH12345", [("Accession_CH", 2, 7)]),
        ("AS-٢٤-123", [("Accession_AS", 0, 9)]),
        ("", []),
    ],
)
def test_string_rules(spark, text, want):
    got = one(spark, text, lambda v: R.matches(v, R.IDENTIFIERS))
    assert [(m["label"], m["start"], m["length"]) for m in got] == want


def test_byte_rules_reach_to_the_next_nul(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\x00AS-24-123tail\x00x AC-23-987654")), (2, bytearray(b"XXXX")), (3, bytearray(b"AS-24-123" + b" " * 20))], "id int, c binary")
    rows = {(r["id"], r["label"]): (r["start"], r["length"]) for r in R.scan_bytes(df, ["id"], "c").collect()}
    assert rows == {(1, "Accession_AS"): (2, 13), (1, "Accession_AC"): (18, 12), (3, "Accession_AS"): (0, 9)}
    assert R.scan_bytes(df, ["id"], "c", head=8).count() == 0, "what lies behind the head isn't looked at"
    skip = spark.createDataFrame([(1, 2)], "id int, start int")
    assert {r["label"] for r in R.scan_bytes(df, ["id"], "c", skip=skip).collect() if r["id"] == 1} == {"Accession_AC"}


@pytest.mark.parametrize("value, want", [("1900:01:01 00:00:00", True), ("0000:00:00", True), (" \0 ", True), ("", True), ("2024:01:01", False)])
def test_removed_dates(spark, value, want):
    assert one(spark, value, P.date_removed) is want


@pytest.mark.parametrize("value, want", [("abc", "***"), ("abcd", "****"), ("abcde", "ab*de"), ("", "")])
def test_masks(spark, value, want):
    assert one(spark, value, P.mask_preview) == want


@pytest.mark.parametrize("name, stem, kind", [("a.b.NDPI", "a.b", "ndpi"), ("/d/x.tar.gz", "x.tar", "unknown"), (".svs", ".svs", "unknown"), ("n", "n", "unknown"), ("d.x/y.dcm", "y", "dicom"), ("f.tif", "f", "tiff")])
def test_names(spark, name, stem, kind):
    assert one(spark, name, P.stem) == stem and one(spark, name, P.format_of) == kind


def test_svs_text(spark):
    text = "Lib|A = 1|Date = 01/02/24|Date = 03/04/24|User =  |Filename = a=b|bare|ScanScope ID = XXX"
    assert [(f["key"], f["value"]) for f in one(spark, text, P.svs_findings)] == [("Date", "03/04/24"), ("Filename", "a=b")]
    assert one(spark, text, P.svs_redacted) == "Lib|A = 1|Date = 01/01/00|Date = 01/01/00|User =  |Filename = XXX|bare|ScanScope ID = XXX"
    again = one(spark, one(spark, text, P.svs_redacted), P.svs_findings)
    assert again == []


def test_xml_texts(spark):
    text = '<?xml barcode="p"?><scn BARCODE = "q1"><user>joe</user><user></user><username>no</username><device model="XX"/></scn>'
    assert {(f["key"], f["value"]) for f in one(spark, text, P.scn_findings)} == {("barcode", "q1"), ("user", "joe")}
    assert one(spark, text, P.scn_redacted) == '<?xml barcode="p"?><scn BARCODE = "XX"><user>XXX</user><user></user><username>no</username><device model="XX"/></scn>'
    assert one(spark, "no markup barcode=\"x\"", P.scn_findings) == []
    assert one(spark, '<i UniqueID="" ScanDate="2024" Mag="40"/>', P.xmp_redacted) == '<i UniqueID="" ScanDate="XXXX" Mag="40"/>'


def test_ndpi_texts(spark):
    text = "NDP.S/N=12\nObjective=20\nUserId=\nOperatorName=a=b\nnothing"
    assert [(f["key"], f["value"]) for f in one(spark, text, P.ndpi_findings)] == [("NDP.S/N", "12"), ("OperatorName", "a=b")]
    assert one(spark, text, P.ndpi_redacted) == "NDP.S/N=XX\nObjective=20\nUserId=\nOperatorName=XXX\nnothing"


@pytest.mark.parametrize("vr, value, want", [("DA", "19000101", True), ("DA", "20240101", False), ("PN", "^^", True), ("PN", "A^B", False), ("TM", "000000", True), ("DT", "19000101000000", True), ("LO", "", True), ("LO", "XX", True), ("LO", "19000101", False)])
def test_dicom_values(spark, vr, value, want):
    assert spark.createDataFrame([(vr, value)], "vr string, v string").select(P.dicom_done(F.col("vr"), F.col("v"))).first()[0] is want


def test_unlink(spark):
    """Runs of gone directories are skipped at once; a gone first one moves the header's pointer."""
    rows = [("a", k, 100 * (k + 1), g) for k, g in enumerate([False, True, True, False, True])] + [("b", 0, 8, True), ("b", 1, 80, False), ("c", 0, 8, True), ("d", 0, 8, False)]
    got = {(r["path"], r["ifd_offset"]): r["next_offset"] for r in unlink(spark.createDataFrame(rows, "path string, ifd_idx int, ifd_offset long, gone boolean")).collect()}
    assert got == {("a", 100): 400, ("a", 400): 0, ("b", None): 80, ("c", None): 0}


def test_covered_hits_and_first_findings(spark):
    hits = spark.createDataFrame([("p", 10, 5), ("p", 30, 5), ("q", 10, 5)], "path string, offset long, length long")
    patches = spark.createDataFrame([("p", 8, 10), ("p", 32, 10)], "path string, offset long, length long")
    assert sorted(tuple(r) for r in uncovered(hits, patches, ["path"]).collect()) == [("p", 30, 5), ("q", 10, 5)]
    found = spark.createDataFrame([("p", 5, 2, "b"), ("p", 5, 1, "a"), ("p", 6, 3, "c")], "path string, offset long, rank int, name string")
    assert sorted(r["name"] for r in first_per_offset(found, ["path"], ["rank"]).collect()) == ["a", "c"]


def test_reports(spark):
    schema = "path string, cleared int, error string, verified boolean, integrity boolean"
    results = spark.createDataFrame([("a", 2, None, True, True), ("b", 0, None, True, None), ("c", 0, "bad", True, None)], schema)
    assert G.batch_stats(results).first().asDict() == {"total": 3, "errored": 1, "anonymized": 1, "already_clean": 1}
    assert {r["measure"]: r["status"] for r in G.measures(results, True).collect()}["Post-anonymization verification"] == "passed"
    assert G.measures(results.where("cleared = 0")).count() == 3
    assert G.batch_stats(results.limit(0)).first()["total"] == 0
    assert G.space_needed(spark.createDataFrame([(95,)], "length long"), 100).first()["space"] == "warning"


def test_svs_date_that_means_removed_is_a_date_beside_fields_that_identify(spark):
    found = lambda text: [f["key"] for f in one(spark, text, P.svs_dated_findings)]
    assert found("L|Filename = a|Date = 01/01/00|Time = 00:00:00|User = ") == ["Filename", "Date"]
    assert found("L|Filename = X|Date = 01/01/00|Time = 00:00:00|User = ") == []
    assert found("L|A = 1|Date = 01/01/00") == []
