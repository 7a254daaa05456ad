import zipfile

import pytest

from statloom.sources.tables import read_table
from statloom.sources.workbook import column_number

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheet, shared="", more=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="a" sheetId="2" r:id="rId7"/><sheet name="b" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId7" Target="worksheets/first.xml"/></Relationships>')
        z.writestr("xl/worksheets/first.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1"><v>9</v></c></row></sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
        for name, text in more:
            z.writestr(name, text)


def test_first_sheet(spark, tmp_path):
    shared = "<si><t>name</t></si><si><r><t>Ann</t></r><r><t> Lee</t></r><rPh><t>no</t></rPh></si>"
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>size</t></is></c></row><row r="2"/>'
    rows += '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"><v>2.5</v></c></row><row r="4"><c r="C4"><v>4</v></c><c r="D4"/></row>'
    workbook(tmp_path / "a.xlsx", rows, shared)
    got = read_table(spark, str(tmp_path / "a.xlsx"))
    assert len(got.columns) == 3
    found = [tuple(r) for r in got.orderBy(got.columns[2]).collect()]
    assert found == [("Ann Lee", "true", 2.5), (None, None, 4.0)]


def test_empty_sheet_and_long_gaps(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", '<row r="1"/>')
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "a.xlsx"))
    cell = lambda r, v: f'<row r="{r}"><c r="A{r}" t="inlineStr"><is><t>{v}</t></is></c></row>'
    workbook(tmp_path / "b.xlsx", cell(1, "name") + cell(2, "x") + cell(10_002, "y") + cell(30_000, "z"))
    assert sorted(r["name"] for r in read_table(spark, str(tmp_path / "b.xlsx")).collect()) == ["x", "y"]


def test_places():
    assert [column_number(c) for c in ("A1", "Z9", "AA1", "AB12")] == [0, 25, 26, 27]
