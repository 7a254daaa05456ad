"""Labelled files written here by hand, cell by cell, and read back."""

import datetime
import random
import struct

import pytest

from statloom.operators.cleaning import apply_labels
from statloom.sources.labelled import read_labelled
from statloom.sources.tables import read_table

GONE = -1.7976931348623157e308


def sav(rows, packed, order="<", blocks_of_codes=True):
    """A file with: sex (labelled, 9 missing), a town of up to 12 bytes, a weight and a date. rows hold their values."""
    i, d = lambda *n: struct.pack(f"{order}{len(n)}i", *n), lambda x: struct.pack(order + "d", x)
    out = b"$FL2" + b"made by hand".ljust(60) + i(2, 5, int(packed), 0, len(rows)) + d(100.0) + b"01 Jan 2410:00:00".ljust(17) + b" " * 67
    out += i(2, 0, 1, 1, 5 << 16 | 8 << 8, 5 << 16 | 8 << 8) + b"SEX     " + i(10) + b"Sex of her".ljust(12) + d(9.0)
    out += i(2, 12, 0, 0, 1 << 16 | 12 << 8, 1 << 16 | 12 << 8) + b"TOWN    " + i(2, -1, 0, 0, 0, 0) + b"        "
    out += i(2, 0, 0, -2, 5 << 16, 5 << 16) + b"WEIGHT  " + d(900.0) + d(999.0)
    out += i(2, 0, 0, 0, 20 << 16, 20 << 16) + b"BORN    "
    out += i(3, 2) + d(1.0) + b"\x03man".ljust(8) + d(2.0) + b"\x05woman".ljust(8) + i(4, 1, 1)
    long_names = b"SEX=sex_of_person\tTOWN=town"
    out += i(7, 20, 1, 5) + b"UTF-8" + i(7, 13, 1, len(long_names)) + long_names + i(999, 0)
    codes, cells = bytearray(), bytearray()

    def flush(end=False):
        nonlocal codes, cells, out
        if codes and (len(codes) == 8 or end):
            out += bytes(codes).ljust(8, b"\0") + bytes(cells)
            codes, cells = bytearray(), bytearray()

    for sex, town, weight, born in rows:
        day = GONE if born is None else (born - datetime.date(1582, 10, 14)).days * 86400.0
        text = (town or "").encode().ljust(16)
        for cell in (GONE if sex is None else sex, text[:8], text[8:], GONE if weight is None else weight, day):
            raw = cell if isinstance(cell, bytes) else d(cell)
            if not packed:
                out += raw
                continue
            if cell == b" " * 8:
                codes.append(254)
            elif cell == GONE:
                codes.append(255)
            elif not isinstance(cell, bytes) and cell == int(cell) and -99 <= cell <= 151:
                codes.append(int(cell) + 100)
            else:
                codes.append(253)
                cells += raw
            flush()
    if packed:
        codes.append(252)
        flush(True)
    return out


ROWS = [
    (random.Random(k).choice([1.0, 2.0, 9.0, None]), random.Random(k + 1).choice(["Lomé", "", "Ouagadougou", "a"]), random.Random(k + 2).choice([50.5, 3.0, 950.0, None, -20.0]),
     random.Random(k + 3).choice([None, datetime.date(1990, 5, 17), datetime.date(1600, 1, 1)]))
    for k in range(237)
]
WANT = [(None if s in (9.0, None) else s, t or None, None if w == 950.0 else w, b) for s, t, w, b in ROWS]


@pytest.mark.parametrize("packed,order", [(False, "<"), (True, "<"), (True, ">"), (False, ">")])
def test_spss_rows_in_blocks(spark, tmp_path, packed, order):
    path = tmp_path / "a.sav"
    path.write_bytes(sav(ROWS, packed, order))
    df = read_labelled(spark, str(path), rows_per_partition=50)
    assert df.dtypes == [("sex_of_person", "double"), ("town", "string"), ("WEIGHT", "double"), ("BORN", "date")]
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(WANT, key=repr)


def test_labels_join(spark, tmp_path):
    path = tmp_path / "a.sav"
    path.write_bytes(sav(ROWS, True))
    labels = read_labelled(spark, str(path), "labels")
    assert sorted(map(tuple, labels.collect())) == [("sex_of_person", "1.0", "man"), ("sex_of_person", "2.0", "woman")]
    named = apply_labels(read_table(spark, str(path)), "sex_of_person", labels.where("variable = 'sex_of_person'"))
    assert {r["sex_of_person"] for r in named.select("sex_of_person").distinct().collect()} == {"man", "woman", None}
    assert read_labelled(spark, str(path), "variables").where("label is not null").collect()[0]["label"] == "Sex of her"


def test_empty_and_damaged(spark, tmp_path):
    (tmp_path / "none.sav").write_bytes(sav([], True))
    assert read_labelled(spark, str(tmp_path / "none.sav")).count() == 0
    (tmp_path / "cut.sav").write_bytes(sav(ROWS, False)[:-4])
    with pytest.raises(Exception, match="ends within its rows"):
        read_labelled(spark, str(tmp_path / "cut.sav")).collect()
    (tmp_path / "no.sav").write_bytes(b"something else that is long enough")
    with pytest.raises(Exception, match="not an SPSS"):
        read_labelled(spark, str(tmp_path / "no.sav"))


PEOPLE = [(1, 300, 70_000, 1.5, 2.25, "Zoë", 12_000), (None, None, None, None, None, "", None), (2, -5, -9, -0.5, 1e300, "x", -1)]
TYPES = [("sex", "b", 65530), ("n2", "h", 65529), ("n4", "i", 65528), ("f", "f", 65527), ("g", "d", 65526), ("name", "6s", 6), ("day", "i", 65528)]
MISSING = {"b": 101, "h": 32_741, "i": 2_147_483_621, "f": float.fromhex("0x1p127"), "d": float.fromhex("0x1p1023")}


def records(order):
    return b"".join(struct.pack(order + t, (v or "").encode() if t == "6s" else MISSING[t] if v is None else v) for row in PEOPLE for (_, t, _), v in zip(TYPES, row))


def label_set(order, name_size):
    texts = "man\0wömän\0".encode("utf-8" if name_size == 129 else "cp1252")
    body = struct.pack(order + "2i", 2, len(texts)) + struct.pack(order + "4i", 0, 4, 1, 2) + texts
    return struct.pack(order + "i", len(body)) + b"sexes".ljust(name_size, b"\0") + b"\0" * 3 + body


def new_dta(release, order):
    """Sections between tags, with the map of their places."""
    n, f, t = (33, 49, 81) if release == 117 else (129, 57, 321)
    fixed = lambda items, size: b"".join(x.encode().ljust(size, b"\0") for x in items)
    head = f"<stata_dta><header><release>{release}</release><byteorder>{'MSF' if order == '>' else 'LSF'}</byteorder><K>".encode() + struct.pack(order + "H", 7) + b"</K><N>"
    head += struct.pack(order + ("I" if release == 117 else "Q"), 3) + b"</N><label>" + struct.pack(order + ("B" if release == 117 else "H"), 2) + b"ab</label><timestamp>\0</timestamp></header>"
    sections = [
        b"<variable_types>" + struct.pack(order + "7H", *[c for *_, c in TYPES]) + b"</variable_types>", b"<varnames>" + fixed([c for c, *_ in TYPES], n) + b"</varnames>", b"<sortlist>" + b"\0" * 16 + b"</sortlist>",
        b"<formats>" + fixed(["%8.0g"] * 6 + ["%td"], f) + b"</formats>", b"<value_label_names>" + fixed(["sexes"] + [""] * 6, n) + b"</value_label_names>", b"<variable_labels>" + fixed(["Sex"] + [""] * 6, t) + b"</variable_labels>",
        b"<characteristics></characteristics>", b"<data>" + records(order) + b"</data>", b"<strls></strls>", b"<value_labels><lbl>" + label_set(order, n) + b"</lbl></value_labels>", b"</stata_dta>",
    ]
    at = len(head) + len(b"<map></map>") + 14 * 8
    places = [0, len(head)]
    for s in sections:
        places.append(at)
        at += len(s)
    places.append(at)
    return head + b"<map>" + struct.pack(order + "14Q", *places) + b"</map>" + b"".join(sections)


def old_dta(release, order):
    fixed = lambda items, size: b"".join(x.encode().ljust(size, b"\0") for x in items)
    out = struct.pack("4B", release, 1 if order == ">" else 2, 1, 0) + struct.pack(order + "HI", 7, 3) + b"\0" * 99
    out += bytes({"b": 251, "h": 252, "i": 253, "f": 254, "d": 255, "6s": 6}[t] for _, t, _ in TYPES) + fixed([c for c, *_ in TYPES], 33) + b"\0" * 16
    out += fixed(["%8.0g"] * 6 + ["%d"], 12 if release == 113 else 49) + fixed(["sexes"] + [""] * 6, 33) + fixed(["Sex"] + [""] * 6, 81)
    return out + b"\1" + struct.pack(order + "i", 3) + b"abc" + b"\0" + struct.pack(order + "i", 0) + records(order) + label_set(order, 33)


@pytest.mark.parametrize("release,order", [(118, "<"), (117, ">"), (114, "<"), (113, ">"), (115, "<")])
def test_stata(spark, tmp_path, release, order):
    path = tmp_path / "a.dta"
    path.write_bytes(new_dta(release, order) if release >= 117 else old_dta(release, order))
    df = read_labelled(spark, str(path), rows_per_partition=2)
    assert [k for _, k in df.dtypes] == ["tinyint", "smallint", "int", "float", "double", "string", "date"] and df.rdd.getNumPartitions() == 2
    name = "Zoë" if release == 118 else "Zoë".encode().decode("cp1252")
    day = lambda n: datetime.date(1960, 1, 1) + datetime.timedelta(n)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(1, 300, 70_000, 1.5, 2.25, name, day(12_000)), (None,) * 7, (2, -5, -9, -0.5, 1e300, "x", day(-1))], key=repr)
    assert sorted(map(tuple, read_labelled(spark, str(path), "labels").collect())) == [("sex", "1", "man"), ("sex", "2", "wömän")]
