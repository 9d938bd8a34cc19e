"""Folder listings, text decoding and office texts on files written for the test."""

import io
import os
import zipfile

from pyspark.sql import functions as F

from manualdex.sources import folder as Fo
from manualdex.sources.office import office_text

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_scan_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A b.PDF").write_bytes(b"12345")
    (tmp_path / "x.tar.gz").write_bytes(b"1")
    (tmp_path / "plain").write_bytes(b"")
    (tmp_path / "sub" / ".hidden").write_bytes(b"1")
    rows = {r["filename"]: r for r in Fo.scan_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A b.PDF", "x.tar.gz", "plain", ".hidden"}
    pdf = rows["A b.PDF"]
    assert (pdf["extension"], pdf["size"], pdf["extractable"]) == (".pdf", 5, True)
    assert pdf["filepath"] == str(tmp_path / "sub" / "A b.PDF")
    assert abs(pdf["modified"] - (tmp_path / "sub" / "A b.PDF").stat().st_mtime) < 1
    assert rows["x.tar.gz"]["extension"] == ".gz" and rows["plain"]["extension"] == ""
    assert Fo.scan_folder(spark, str(tmp_path / "absent")).count() == 0
    assert Fo.scan_folder(spark, f"file://{tmp_path}/absent").count() == 0


def test_unreadable_paths_are_told_apart(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"1")
    os.symlink(tmp_path / "loop", tmp_path / "loop")
    listing, failed = Fo.list_folder(spark, str(tmp_path))
    assert [r["filename"] for r in listing.collect()] == ["a.txt"]
    assert [r["path"] for r in failed.collect()] == [str(tmp_path / "loop")]
    assert Fo.list_folder(spark, str(tmp_path / "absent"))[1].count() == 0


def test_decoding_runs_no_python(spark):
    df = spark.createDataFrame([(b"x",)], "content binary")
    plan = Fo.decode_text(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_scan_folder_prunes_contents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"1")
    listed = Fo.scan_folder(spark, f"file://{tmp_path}")
    assert [r["filepath"] for r in listed.collect()] == [str(tmp_path / "a.txt")]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_extensions(spark):
    names = [(".bashrc", ""), ("name.", ""), ("a.TXT", ".txt"), ("..a", ".a"), ("a.b.c", ".c")]
    df = spark.createDataFrame(names, "n string, want string")
    assert df.filter(Fo.extension_of(F.col("n")) != F.col("want")).count() == 0


def test_decode_text(spark):
    cases = [
        ("bom", "﻿привет".encode(), "привет"),
        ("utf8", "привет\r\nмир\rx".encode(), "привет\nмир\nx"),
        ("cp1251", "привет".encode("cp1251"), "привет"),
        ("cp866", bytes([0x98]) + "привет".encode("cp866"), "Шпривет"),
        ("empty", b"", ""),
        ("missing", None, ""),
    ]
    df = spark.createDataFrame([(n, c) for n, c, _ in cases], "name string, content binary")
    got = {r["name"]: r["text"] for r in Fo.decode_text(df).collect()}
    assert got == {n: t for n, _, t in cases}


def test_docx():
    cell = "<w:tc>{}<w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    doc = (
        f"<w:document {W}><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/>"
        "<w:tbl><w:tr>"
        + cell.format('<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>', "wide")
        + "</w:tr><w:tr>"
        + cell.format("", "a")
        + cell.format("", "")
        + "</w:tr></w:tbl><w:p><w:r><w:t>last</w:t></w:r></w:p></w:body></w:document>"
    )
    assert office_text(".docx", packed({"word/document.xml": doc})) == "one\ttwo\nlast\nwide\nwide\na"
    assert office_text(".docx", b"not a zip") == ""
    assert office_text(".docx", None) == ""


def test_xlsx():
    content = packed(
        {
            "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="Лист" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {S}><si><t>hello</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
            "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c/><c><v>5</v></c>'
            '<c><v>2.50</v></c><c t="b"><v>1</v></c><c s="1"><v>45292</v></c></row><row><c/></row>'
            '<row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>x</t></is></c><c t="str"><v>cached</v></c></row></sheetData></worksheet>',
        }
    )
    assert office_text(".xlsx", content) == (
        "\n[Лист]\nhello | 5 | 2.5 | True | 2024-01-01 00:00:00\nrich | x | cached"
    )


def test_open_documents():
    ns = 'xmlns:office="o" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
    odt = f'<office:d {ns}><text:h>Title</text:h><text:p>a<text:s text:c="2"/>b</text:p><table:table><table:table-row><table:table-cell><text:p>cell</text:p></table:table-cell></table:table-row></table:table></office:d>'
    assert office_text(".odt", packed({"content.xml": odt})) == "Title\na  b\ncell"
    ods = f'<office:d {ns}><table:table table:name="S"><table:table-row><table:table-cell><text:p>1</text:p></table:table-cell><table:table-cell/><table:table-cell><text:p>x</text:p></table:table-cell></table:table-row></table:table></office:d>'
    assert office_text(".ods", packed({"content.xml": ods})) == "\n[S]\n1 | x"


def test_routes_share_one_table(spark):
    doc = f"<w:document {W}><w:body><w:p><w:r><w:t>word text</w:t></w:r></w:p></w:body></w:document>"
    df = spark.createDataFrame(
        [("/a.docx", packed({"word/document.xml": doc})), ("/b.txt", b"plain"), ("/c.bin", b"no")],
        "path string, content binary",
    )
    got = {r["path"]: r["text"] for r in Fo.extract_by_route(df).collect()}
    assert got == {"/a.docx": "word text", "/b.txt": "plain"}
