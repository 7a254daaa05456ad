import struct
import zipfile

import pytest

from statloom.sources.screening import WORKBOOK, file_faults

TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/>{}</Types>'
MAIN = f'<Override PartName="/xl/workbook.xml" ContentType="{WORKBOOK}"/>'
SETTINGS = '<Default Extension="bin" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.printerSettings"/>'
VBA = '<Override PartName="/xl/code.bin" ContentType="application/vnd.ms-office.vbaProject"/>'


def archive(path, declared, **parts):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", TYPES.format(declared))
        for name, text in ({"xl/workbook.xml": "<workbook/>"} | {k.replace("__", "."): v for k, v in parts.items()}).items():
            z.writestr(name, text)


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    archive(at / "plain.xlsx", MAIN)
    archive(at / "printer.xlsx", MAIN + SETTINGS, printer__bin="x")
    archive(at / "code.xlsx", MAIN + VBA, code__bin="x")
    archive(at / "enabled.xlsx", MAIN.replace("sheet.main+xml", "macroEnabled.main+xml"))
    archive(at / "hidden.xlsx", MAIN, vbaProject__bin="x")
    archive(at / "letter.xlsx", "")
    archive(at / "swollen.xlsx", MAIN, big__xml=" " * 30_000_000)
    whole = (at / "plain.xlsx").read_bytes()
    files = {
        "half.xlsx": whole[: len(whole) // 2], "table.xlsx": b"town,size\nKara,3\n", "towns.tsv": "ville\tâge\nKpalimé\t4\n".encode(), "latin.txt": "é;1\n".encode("latin-1"), "nothing.csv": b"",
        "zeros.csv": b"town\0size", "book.csv": whole, "script.txt": b"#!/bin/sh\n", "tool.exe": b"MZ\x90", "survey.sav": b"$FL3@(#) SPSS", "renamed.sav": b"<stata_dta>", "new.dta": b"<stata_dta><header>",
        "old.dta": struct.pack("4B", 114, 2, 1, 0), "word.dta": b"rstuv", "r.csv": b"rstuv,1\n", "long.csv": b"a,b\n" * 100,
    }
    for name, content in files.items():
        (at / name).write_bytes(content)
    return {r["file"].rsplit("/", 1)[1]: r["fault"] for r in file_faults(spark, str(at), 20_000).collect()} | {"all": {r["file"].rsplit("/", 1)[1] for r in file_faults(spark, str(at), 200).where("fault = 'too large'").collect()}}


def test_files_that_are_what_they_say(found):
    assert {k for k, v in found.items() if v is None} == {"plain.xlsx", "printer.xlsx", "towns.tsv", "latin.txt", "survey.sav", "new.dta", "old.dta", "r.csv", "long.csv"}
    assert "nothing.csv" not in found


@pytest.mark.parametrize("name,fault", [
    ("code.xlsx", "holds macros"), ("enabled.xlsx", "holds macros"), ("hidden.xlsx", "holds parts of no declared type"), ("letter.xlsx", "not a workbook"), ("half.xlsx", "damaged"), ("table.xlsx", "is text, not zip"),
    ("zeros.csv", "is binary, not text"), ("book.csv", "is zip, not text"), ("script.txt", "is program, not text"), ("tool.exe", "unknown format"), ("renamed.sav", "is stata, not spss"), ("word.dta", "is text, not stata"),
])
def test_faults(found, name, fault):
    assert found[name] == fault


def test_sizes(found):
    assert found["swollen.xlsx"] in ("unpacks to too much", "too large") and {"long.csv", "plain.xlsx"} <= found["all"]
