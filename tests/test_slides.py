"""Scan, anonymise and verify built files, end to end."""

from __future__ import annotations

import json

import pytest

from sablelens.__main__ import main
from sablelens.functions.rules import RuleSet
from sablelens.operators.anonymize import anonymize, verified
from sablelens.operators.info import info
from sablelens.operators.scan import scan
from sablelens.sources.dicom import element_rows
from tests.builders import dicom, element, item, text, tiff


def labelled(labelled_at: int) -> bytes:
    """Three directories, the second a label whose image is at the given place, behind all of them."""
    main = [text(270, "Lib|AppMag = 40|ScanScope ID = SS1|Filename = f|Date = 01/02/24|User = u")]
    label = [text(270, "the label"), (273, 4, 1, labelled_at), (279, 4, 1, 9)]
    return tiff([main, label, [(256, 3, 1, 7)]], tail=b"IMAGEDATAzz AC-23-987654\0" if labelled_at else b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("slides")
    (d / "m").mkdir()
    files = {
        "a.ndpi": tiff([[(256, 3, 1, 100), (257, 3, 1, 100), text(306, "2024:06:15 10:30:00"), text(65427, "REF-001"), text(65468, "AS-24-123456"), text(65449, "NDP.S/N=123\nObjective=20\nOperator.Name=jo")]]),
        "big.ndpi": tiff([[text(306, "2024:06:15 10:30:00"), text(65468, "AS-24-123456")]], order=">"),
        "clean.tif": tiff([[(256, 3, 1, 100), (257, 3, 1, 100)]]),
        "p.tiff": tiff([[text(270, "Patient: AS-22-555555 x"), (256, 3, 1, 1)]]),
        "AS-24-999999.svs": labelled(labelled_at=len(labelled(0))),
        "x.bif": tiff([[text(700, '<iScan BarCode1="B77" OperatorID="op" Magnification="40"/>', 7)]]),
        "y.scn": tiff([[text(270, '<?xml version="1.0"?><scn><barcode>B88</barcode><device user="me"/></scn>')]]),
        "bad.ndpi": b"garbage",
        "m.mrxs": b"MIRAX\0",
        "m/Slidedat.ini": "﻿[GENERAL]\nSLIDE_NAME = AS-24-777777\nSLIDE_VERSION=2%\n[X]\nOPERATOR=bob\n[HIERARCHICAL]\nNONHIER_COUNT=1\nNONHIER_0_COUNT=1\nNONHIER_0_VAL_0=ScanDataLayer_SlideLabel\nNONHIER_0_VAL_0_SECTION=L\n[L]\nFILE=k1\nOFFSET=4\nSIZE=9\n[DATAFILE]\nk1=Data0001.dat\n".encode(),
        "m/Data0001.dat": b"headMRXSLABELtail",
        "w.dcm": dicom(
            element(8, 0x18, "UI", b"1.2.3.4"),
            element(9, 0x10, "LO", b"VENDOR"),
            element(0x10, 0x10, "PN", b"Doe^J"),
            element(0x10, 0x20, "LO", b"ID1"),
            element(0x10, 0x30, "DA", b"19700101"),
            element(0x10, 0x1040, "LO", b"Street"),
            element(0x40, 0x560, "SQ", item(element(0x10, 0x20, "LO", b"N1"))),
            element(0x28, 0x10, "US", b"\0\2"),
        ),
    }
    for name, content in files.items():
        (d / name).write_bytes(content)
    return d


def test_scan(spark, folder):
    files, findings, results = scan(spark, str(folder))
    by = {r["path"].rsplit("/", 1)[1]: r for r in results.collect()}
    assert len(by) == 10
    assert by["clean.tif"]["is_clean"] and by["clean.tif"]["format"] == "tiff"
    assert not by["bad.ndpi"]["is_clean"] and by["bad.ndpi"]["error"]
    found = {}
    for r in findings.collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["tag_name"], r["value_preview"]))
    assert sorted(found["a.ndpi"]) == [
        ("DateTime", "2024:06:15 10:30:00"),
        ("NDPI_BARCODE", "AS-24-123456"),
        ("NDPI_REFERENCE", "REF-001"),
        ("NDPI_SCANNER_PROPS:NDP.S/N", "NDP.S/N=123"),
        ("NDPI_SCANNER_PROPS:Operator.Name", "Operator.Name=jo"),
    ]
    assert sorted(n for n, _ in found["big.ndpi"]) == ["DateTime", "NDPI_BARCODE"]
    assert {n for n, _ in found["AS-24-999999.svs"]} == {"SVS:Tag270:ScanScope ID", "SVS:Tag270:Filename", "SVS:Tag270:Date", "SVS:Tag270:User", "LabelImage", "regex:Accession_AC", "filename:Accession_AS"}
    # A plain TIFF reports the same text three times: as a string, as extra metadata and by pattern.
    assert sorted(n for n, _ in found["p.tiff"]) == ["ImageDescription", "ImageDescription:Accession_AS", "regex:Accession_AS"]
    assert {n for n, _ in found["x.bif"]} == {"BIF:XMP:BarCode1", "BIF:XMP:OperatorID"}
    assert {n for n, _ in found["y.scn"]} == {"SCN:XML:barcode", "SCN:XML:user"}
    assert {n for n, _ in found["m.mrxs"]} == {"MRXS:SLIDE_NAME", "MRXS:X:OPERATOR", "regex:Accession_AS", "LabelImage"}
    assert {n for n, _ in found["w.dcm"]} == {"DICOM:PatientName", "DICOM:PatientID", "DICOM:PatientBirthDate", "DICOM:PatientAddress", "DICOM:SpecimenDescriptionSequence", "DICOM:SQ:PatientID", "DICOM:PrivateTags"}


def test_anonymize_then_verify(spark, folder, tmp_path):
    out = tmp_path / "out"
    rows = {r["path"].rsplit("/", 1)[1]: r for r in anonymize(spark, str(folder), str(out), check_images=True).collect()}
    assert all(r["verified"] for n, r in rows.items() if n != "bad.ndpi"), rows
    assert rows["bad.ndpi"]["error"] and not rows["bad.ndpi"]["verified"]
    assert rows["AS-24-999999.svs"]["name_hit"] and rows["AS-24-999999.svs"]["cleared"] > 0 and rows["clean.tif"]["cleared"] == 0
    for name in ("a.ndpi", "big.ndpi", "p.tiff", "AS-24-999999.svs", "x.bif", "y.scn", "clean.tif"):
        old, new = (folder / name).read_bytes(), (out / name).read_bytes()
        assert len(old) == len(new)
    assert (out / "clean.tif").read_bytes() == (folder / "clean.tif").read_bytes()
    whole = b"".join(p.read_bytes() for p in out.rglob("*") if p.is_file())
    for secret in (b"123456", b"REF-001", b"555555", b"987654", b"777777", b"bob", b"Doe^J", b"Street", b"B77", b"B88", b"1.2.3.4", b"VENDOR", b"IMAGEDATA", b"N1", b"19700101"):
        assert secret not in whole, secret
    assert (out / "m/Data0001.dat").read_bytes() == b"head" + b"\0" * 9 + b"tail"
    # The label's directory is out of the chain and the one behind it still in.
    tags = scan(spark, str(out))[0]
    assert tags.count() == 10
    assert info(spark, str(out / "AS-24-999999.svs"))["page_count"] == 2
    # A second run finds nothing to overwrite.
    again = anonymize(spark, str(out), str(tmp_path / "again"), dry_run=True).where("path NOT LIKE '%Slidedat.ini'")
    assert again.where("payload IS NULL OR length(payload) > 0").count() == 0


def test_mrxs_is_searched_whole(spark, tmp_path):
    """Identifiers behind the first million bytes of the index file and of the INI file."""
    d, out = tmp_path / "in", tmp_path / "out"
    (d / "m").mkdir(parents=True)
    (d / "m.mrxs").write_bytes(b"MIRAX\0" + b"z" * 999_990 + b"AS-24-111111\0" + b"z" * 200_000 + b"\0AS-24-222222\0end")
    (d / "m/Slidedat.ini").write_text(f"[GENERAL]\nFILLER={'z' * 1_100_000}\nNOTE=AS-24-333333\n")
    found = {r["value_preview"] for r in scan(spark, str(d))[1].where("tag_name LIKE 'regex:%'").collect()}
    assert {v[:12] for v in found} == {"AS-24-111111", "AS-24-222222", "AS-24-333333"}
    assert verified(spark, str(d)).where("clean").count() == 0
    assert [r["verified"] for r in anonymize(spark, str(d), str(out)).collect()] == [True]
    old, new = (d / "m.mrxs").read_bytes(), (out / "m.mrxs").read_bytes()
    assert new == old.replace(b"AS-24-111111", b"X" * 12).replace(b"AS-24-222222", b"X" * 12)
    assert b"333333" not in (out / "m/Slidedat.ini").read_bytes()


def test_dicom_private_elements_in_items_and_marks(spark, tmp_path):
    """Private elements go at every depth, the lengths around them shrink, and the file says that it was anonymised."""
    d, out = tmp_path / "in", tmp_path / "out"
    d.mkdir()
    inner = item(element(8, 0x100, "SH", b"CODE") + element(0x11, 0x10, "LO", b"DEEPSECRET"))
    outer = item(element(8, 0x104, "LO", b"meaning") + element(9, 0x10, "LO", b"NESTEDSECRET") + element(0x48, 0x105, "SQ", inner) + element(0x41, 0x10, "SQ", item(element(0x43, 1, "LO", b"PRIVATEITEM"))))
    rest = (element(0x28, 0x10, "US", b"\0\2"), element(0x48, 0x105, "SQ", outer), element(0x48, 0x106, "LO", b"after"))
    (d / "n.dcm").write_bytes(dicom(*rest))
    # The element behind the marks is deleted, and one mark is there already.
    (d / "p.dcm").write_bytes(dicom(element(0x10, 0x20, "LO", b"ID7"), element(0x12, 0x62, "CS", b"NO"), element(0x13, 0x10, "LO", b"PRIV"), *rest))
    (d / "clean.dcm").write_bytes(dicom(rest[0], rest[2]))
    dirty = {r["path"].rsplit("/", 1)[1] for r in verified(spark, str(d)).where("NOT clean").collect()}
    assert dirty == {"n.dcm", "p.dcm"}
    assert all(r["verified"] for r in anonymize(spark, str(d), str(out)).collect())
    assert (out / "clean.dcm").read_bytes() == (d / "clean.dcm").read_bytes()
    marks = [("0012,0062", "YES"), ("0012,0063", "Identifiers removed or replaced")]
    kept = [("0028,0010", None), ("0048,0105", None), ("0008,0104", "meaning"), ("0048,0105", None), ("0008,0100", "CODE"), ("0048,0106", "after")]
    for name, first in (("n.dcm", []), ("p.dcm", [("0010,0020", "")])):
        rows = element_rows(name, (out / name).read_bytes())
        assert [(r[3], r[6]) for r in rows][1:] == first + marks + kept, name
        assert b"SECRET" not in (out / name).read_bytes() and b"PRIV" not in (out / name).read_bytes()
        assert rows[-1][10] == len((out / name).read_bytes())


def test_in_place(spark, tmp_path):
    """Files are replaced whole, and companions of NDPI files go."""
    (tmp_path / "a.ndpi").write_bytes(tiff([[text(65468, "AS-24-123456"), (256, 3, 1, 1)]]))
    (tmp_path / "a.ndpa").write_text("<note/>")
    (tmp_path / "b.ndpa").write_text("<other/>")
    rows = anonymize(spark, str(tmp_path), str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["verified"] and rows[0]["cleared"] > 0
    assert sorted(p.name for p in tmp_path.glob("[ab]*")) == ["a.ndpi", "b.ndpa"]
    assert b"123456" not in (tmp_path / "a.ndpi").read_bytes()


def test_verify_and_rules(spark, folder):
    dirty = {r["path"].rsplit("/", 1)[1] for r in verified(spark, str(folder)).where("NOT clean").collect()}
    assert "clean.tif" not in dirty and "a.ndpi" in dirty
    more = RuleSet.from_json('{"byte_patterns": [["garb[a-z]+", "Custom"]]}')
    assert len(more.byte) == 18 and len(more.string) == 17


def test_command_line(spark, folder, tmp_path, capsys):
    assert main(["anonymize", str(folder)], spark) == 1
    assert main(["scan", str(folder), "--format", "svs", "--json-out", str(tmp_path / "s.json")], spark) == 0
    assert len(json.loads((tmp_path / "s.json").read_text())) == 7
    assert main(["info", str(folder)], spark) == 1
    assert main(["info", str(folder / "a.ndpi")], spark) == 0
    code = main(["anonymize", str(folder), "-o", str(tmp_path / "o"), "--format", "svs", "-c", str(tmp_path / "c.json")], spark)
    assert code == 0
    certificate = json.loads((tmp_path / "c.json").read_text())
    assert certificate["summary"]["anonymized"] == 1 and certificate["measures"][2]["status"] == "passed"
    assert main(["verify", str(tmp_path / "o"), "--format", "svs"], spark) == 0
