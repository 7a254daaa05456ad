"""Labelled survey files as a Spark data source: SPSS system files (.sav) and Stata files (.dta).

The schema comes from the header alone. Rows are planned as blocks, each a partition: records have a fixed width, so a
block of an uncompressed file is a byte range. SPSS byte codes compress rows to unlike widths; planning then walks the
codes once, without unpacking values, and notes where every block begins. Labels of variables and values are tables of
their own beside the data.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_PARTITION, ROWS_PER_BATCH, READ_AHEAD = 50_000, 5_000, 1 << 20
#: Days from 1970 back to the first day of both calendars.
SPSS_EPOCH = (datetime.date(1582, 10, 14) - datetime.date(1970, 1, 1)).days
STATA_EPOCH = (datetime.date(1960, 1, 1) - datetime.date(1970, 1, 1)).days
SQL_TYPES = {"i1": "tinyint", "i2": "smallint", "i4": "int", "f4": "float", "f8": "double", "text": "string", "date": "date", "time": "timestamp_ntz"}
ARROW_TYPES = {"i1": pa.int8(), "i2": pa.int16(), "i4": pa.int32(), "f4": pa.float32(), "f8": pa.float64(), "text": pa.string(), "date": pa.date32(), "time": pa.timestamp("us")}


@dataclass
class Column:
    name: str
    kind: str  # a key of SQL_TYPES
    offset: int
    width: int
    stored: str = ""  # the number's form in the file
    label: str = ""
    label_set: str = ""
    missing: tuple[float, ...] = ()
    missing_range: tuple[float, float] | None = None


@dataclass
class Layout:
    """What the header says: columns, where the rows are, and how they are packed."""

    form: str  # sav or dta
    order: str
    encoding: str
    rows: int
    width: int
    start: int
    columns: list[Column]
    packed: bool = False
    bias: float = 0.0
    labels: dict[str, list[tuple[float | str, str]]] = field(default_factory=dict)


def open_file(path: str):
    """A seekable file below a local path or a URI that Arrow knows."""
    if urlparse(path).scheme:
        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    return fs.LocalFileSystem().open_input_file(path)


class _Cursor:
    """Reads numbers and texts one after another."""

    def __init__(self, file, order: str = "<"):
        self.file, self.order, self.at = file, order, 0

    def take(self, n: int) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(n)
        if len(data) < n:
            raise ValueError("the file ends within its header")
        self.at += n
        return data

    def numbers(self, form: str) -> tuple:
        return struct.unpack(self.order + form, self.take(struct.calcsize(self.order + form)))

    def one(self, form: str):
        return self.numbers(form)[0]


def _text(data: bytes, encoding: str) -> str:
    return data.split(b"\0")[0].decode(encoding, "replace").rstrip()


# SPSS: records of 8-byte cells; a text takes as many cells as it needs

SPSS_DATES, SPSS_TIMES = {20, 23, 24, 38, 39}, {22, 41}
SPSS_MISSING = -np.finfo(np.float64).max
CODE_PAD, CODE_END, CODE_CELL, CODE_BLANK, CODE_MISSING = 0, 252, 253, 254, 255
CODE_PAGES = {65001: "utf-8", 1252: "cp1252", 1250: "cp1250", 1251: "cp1251", 28591: "latin-1", 2: "ascii"}


def sav_layout(file) -> Layout:
    c = _Cursor(file)
    if c.take(4) not in (b"$FL2", b"$FL3"):
        raise ValueError("not an SPSS system file")
    c.at = 64
    if c.one("i") not in (2, 3):
        c.order, c.at = ">", 68
    _, packing, _, rows = c.numbers("4i")
    if packing not in (0, 1):
        raise ValueError("SPSS files packed as ZSAV aren't read")
    bias = c.one("d")
    c.at = 176
    raw: list[dict] = []  # one entry a cell of the record
    sets: list[tuple[list[tuple[bytes, bytes]], list[int]]] = []
    longer: dict[str, str] = {}
    encoding, pending = "cp1252", []
    while (kind := c.one("i")) != 999:
        if kind == 2:
            width, labelled, missing, shown, _ = c.numbers("5i")
            cell = {"width": width, "name": c.take(8), "format": shown >> 16 & 255, "label": b"", "missing": (), "range": None}
            if labelled:
                n = c.one("i")
                cell["label"] = c.take(-(-n // 4) * 4)[:n]
            values = c.numbers(f"{abs(missing)}d") if width <= 0 else (c.take(8 * abs(missing)) and ())
            cell["range"], cell["missing"] = (values[:2], values[2:]) if missing < 0 and values else (None, values)
            raw.append(cell)
        elif kind == 3:
            pending = []
            for _ in range(c.one("i")):
                value, n = c.take(8), c.take(1)[0]
                pending.append((value, c.take(-(-(n + 1) // 8) * 8 - 1)[:n]))
        elif kind == 4:
            sets.append((pending, list(c.numbers(f"{c.one('i')}i"))))
        elif kind == 6:
            c.take(80 * c.one("i"))
        elif kind == 7:
            subtype, size, count = c.numbers("3i")
            data = c.take(size * count)
            if subtype == 3 and encoding == "cp1252":
                encoding = CODE_PAGES.get(struct.unpack(c.order + "8i", data)[7], "cp1252")
            elif subtype == 20:
                encoding = data.decode("ascii").lower()
            elif subtype == 13:
                longer = dict(pair.split(b"=", 1) for pair in data.split(b"\t") if b"=" in pair)
            elif subtype == 14:
                raise ValueError("SPSS texts of more than 255 bytes aren't read")
            elif subtype == 16:
                rows = struct.unpack(c.order + "2q", data)[1]
        else:
            raise ValueError(f"unknown record {kind} in an SPSS file")
    c.one("i")
    named = {k.rstrip(): v.decode(encoding, "replace") for k, v in longer.items()}
    columns, labels = [], {}
    for i, cell in enumerate(raw):
        if cell["width"] < 0:
            continue
        kind = "text" if cell["width"] else "date" if cell["format"] in SPSS_DATES else "time" if cell["format"] in SPSS_TIMES else "f8"
        name = named.get(cell["name"].rstrip(), _text(cell["name"], encoding))
        columns.append(Column(name, kind, 8 * i, cell["width"] or 8, "f8", cell["label"].decode(encoding, "replace"), "", tuple(cell["missing"]), cell["range"]))
    at = {col.offset // 8 + 1: col for col in columns}
    for k, (pairs, places) in enumerate(sets):
        text = bool(places) and at[places[0]].kind == "text"
        labels[str(k)] = [(_text(v, encoding) if text else struct.unpack(c.order + "d", v)[0], t.decode(encoding, "replace").rstrip()) for v, t in pairs]
        for p in places:
            at[p].label_set = str(k)
    width = 8 * len(raw)
    if rows < 0 and not packing:
        rows = (file.size() - c.at) // max(width, 1)
    return Layout("sav", c.order, encoding, rows, width, c.at, columns, packing == 1, bias, labels)


class Codes:
    """Walks a packed SPSS file from a place (octet of codes, code within it, next cell)."""

    def __init__(self, file, start: int, code: int = 0, cell: int | None = None):
        self.file, self.octet, self.code, self.cell = file, start, code, start + 8 if cell is None else cell
        self.base, self.buffer = start, b""

    def eight(self, at: int) -> bytes:
        if not self.base <= at <= self.base + len(self.buffer) - 8:
            self.file.seek(at)
            self.base, self.buffer = at, self.file.read(READ_AHEAD)
        return self.buffer[at - self.base : at - self.base + 8]

    def walk(self, cells: int, bias: float, order: str, keep: bool) -> tuple[int, bytearray]:
        """Steps over so many cells and returns how many there were, and their 8 bytes each if they are to be kept."""
        out, done, number = bytearray(), 0, struct.Struct(order + "d").pack
        codes = self.eight(self.octet)
        while done < cells:
            if self.code == 8:
                self.octet, self.cell, self.code = self.cell, self.cell + 8, 0
                codes = self.eight(self.octet)
            if self.code >= len(codes):
                break
            code = codes[self.code]
            if code == CODE_END:
                break
            self.code += 1
            if code == CODE_PAD:
                continue
            if keep:
                out += self.eight(self.cell) if code == CODE_CELL else b" " * 8 if code == CODE_BLANK else number(SPSS_MISSING) if code == CODE_MISSING else number(code - bias)
            if code == CODE_CELL:
                self.cell += 8
            done += 1
        return done, out


# Stata: sections between tags from release 117 on, a plain sequence before

STATA_LIMITS = {"i1": 100, "i2": 32_740, "i4": 2_147_483_620, "f4": float.fromhex("0x1.fffffep126"), "f8": float.fromhex("0x1.fffffffffffffp1022")}
SIZES = {"i1": 1, "i2": 2, "i4": 4, "f4": 4, "f8": 8}


def _stata_columns(names, types, formats, sets, titles) -> tuple[list[Column], int]:
    columns, at = [], 0
    for name, stored, shown, used, title in zip(names, types, formats, sets, titles, strict=True):
        width = SIZES.get(stored) or int(stored)
        kind = "text" if stored not in SIZES else "date" if shown.startswith(("%td", "%d", "%-td")) else "time" if shown.lower().startswith(("%tc", "%-tc")) else stored
        columns.append(Column(name, kind, at, width, stored if stored in SIZES else "", title, used))
        at += width
    return columns, at


def _stata_set(c: _Cursor, name_size: int, encoding: str) -> tuple[str, list[tuple[float | str, str]]]:
    c.one("i")
    name = _text(c.take(name_size), encoding)
    c.take(3)
    n, size = c.numbers("2i")
    offsets, values, texts = c.numbers(f"{n}i"), c.numbers(f"{n}i"), c.take(size)
    return name, [(v, _text(texts[o:], encoding)) for o, v in zip(offsets, values, strict=True)]


def dta_layout(file) -> Layout:
    c = _Cursor(file)
    if c.take(11) == b"<stata_dta>":
        return _tagged_layout(c)
    c.at = 0
    release, order = c.numbers("2B")
    if release not in (113, 114, 115):
        raise ValueError("a Stata file of a release that isn't read")
    c.order, c.at, encoding = ">" if order == 1 else "<", 4, "cp1252"
    k, rows = c.one("H"), c.one("I")
    c.at = 109
    types = [{251: "i1", 252: "i2", 253: "i4", 254: "f4", 255: "f8"}.get(t, str(t)) for t in c.take(k)]
    texts = lambda n, size: [_text(c.take(size), encoding) for _ in range(n)]
    names = texts(k, 33)
    c.take(2 * (k + 1))
    columns, width = _stata_columns(names, types, texts(k, 12 if release == 113 else 49), texts(k, 33), texts(k, 81))
    while True:  # characteristics
        kind, n = c.one("b"), c.one("i")
        if not kind and not n:
            break
        c.take(n)
    start, labels = c.at, {}
    c.at += width * rows
    while c.at < file.size():
        name, pairs = _stata_set(c, 33, encoding)
        labels[name] = pairs
    return Layout("dta", c.order, encoding, rows, width, start, columns, labels=labels)


def _tagged_layout(c: _Cursor) -> Layout:
    def tag(name: str) -> None:
        if c.take(len(name) + 2) != f"<{name}>".encode():
            raise ValueError(f"a Stata file without its tag {name}")

    tag("header")
    tag("release")
    release = int(c.take(3))
    if release not in (117, 118, 119):
        raise ValueError("a Stata file of a release that isn't read")
    tag("/release")
    tag("byteorder")
    c.order = ">" if c.take(3) == b"MSF" else "<"
    tag("/byteorder")
    tag("K")
    k = c.one("I" if release == 119 else "H")
    tag("/K")
    tag("N")
    rows = c.one("I" if release == 117 else "Q")
    tag("/N")
    tag("label")
    c.take(c.one("B" if release == 117 else "H"))
    tag("/label")
    tag("timestamp")
    c.take(c.one("B"))
    tag("/timestamp")
    tag("/header")
    tag("map")
    places = c.numbers("14Q")
    encoding, name_size, format_size, title_size = ("cp1252", 33, 49, 81) if release == 117 else ("utf-8", 129, 57, 321)

    def section(place: int, name: str) -> None:
        c.at = places[place]
        tag(name)

    section(2, "variable_types")
    codes = c.numbers(f"{k}H")
    if 32768 in codes:
        raise ValueError("Stata texts of any length (strL) aren't read")
    types = [{65526: "f8", 65527: "f4", 65528: "i4", 65529: "i2", 65530: "i1"}.get(t, str(t)) for t in codes]
    lists = []
    for place, name, size in ((3, "varnames", name_size), (5, "formats", format_size), (6, "value_label_names", name_size), (7, "variable_labels", title_size)):
        section(place, name)
        lists.append([_text(c.take(size), encoding) for _ in range(k)])
    columns, width = _stata_columns(lists[0], types, *lists[1:])
    section(9, "data")
    start, labels = c.at, {}
    section(11, "value_labels")
    while c.take(5) == b"<lbl>":
        name, pairs = _stata_set(c, name_size, encoding)
        labels[name] = pairs
        c.take(len("</lbl>"))
    return Layout("dta", c.order, encoding, rows, width, start, columns, labels=labels)


def layout_of(path: str) -> Layout:
    with open_file(path) as file:
        return sav_layout(file) if PurePosixPath(path).suffix.lower() == ".sav" else dta_layout(file)


def _decoded(layout: Layout, column: Column, records: np.ndarray) -> pa.Array:
    """A column of records, a matrix of bytes."""
    own = np.ascontiguousarray(records[:, column.offset : column.offset + column.width])
    if column.kind == "text":
        return pa.array([_text(bytes(r), layout.encoding) or None for r in own], pa.string())
    x = own.view(np.dtype(layout.order + column.stored))[:, 0]
    if layout.form == "sav":
        gone = x <= SPSS_MISSING
        for value in column.missing:
            gone |= x == value
        if column.missing_range:
            gone |= (x >= column.missing_range[0]) & (x <= column.missing_range[1])
    else:
        gone = (x > STATA_LIMITS[column.stored]) | (x != x)
    if column.kind in ("date", "time"):
        x = np.where(gone, 0, x).astype(np.float64)
        if layout.form == "sav":  # seconds
            days, micros = x // 86_400 + SPSS_EPOCH, (x + SPSS_EPOCH * 86_400) * 1e6
        else:  # days or milliseconds
            days, micros = x + STATA_EPOCH, (x + STATA_EPOCH * 86_400_000) * 1e3
        x = days.astype(np.int32) if column.kind == "date" else np.round(micros).astype(np.int64)
    return pa.array(x.astype(x.dtype.newbyteorder("=")), mask=gone).cast(ARROW_TYPES[column.kind])


@dataclass
class Block(InputPartition):
    first: int
    rows: int
    octet: int = 0
    code: int = 0
    cell: int = 0


class LabelledReader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int):
        self.path, self.table, self.rows = path, table, rows

    def partitions(self) -> list[Block]:
        if self.table != "rows":
            return [Block(0, 0)]
        layout = layout_of(self.path)
        if not layout.packed:
            return [Block(k, min(self.rows, layout.rows - k)) for k in range(0, layout.rows, self.rows)] or [Block(0, 0)]
        blocks, first, cells = [], 0, layout.width // 8
        with open_file(self.path) as file:
            codes = Codes(file, layout.start)
            while layout.rows < 0 or first < layout.rows:
                place = (codes.octet, codes.code, codes.cell)
                done = codes.walk(cells * self.rows, layout.bias, layout.order, False)[0] // cells
                if not done:
                    break
                blocks.append(Block(first, done, *place))
                first += done
        return blocks or [Block(0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        layout = layout_of(self.path)
        if self.table != "rows":
            yield self._labels(layout)
            return
        with open_file(self.path) as file:
            codes = Codes(file, block.octet, block.code, block.cell) if layout.packed and block.rows else None
            for low in range(0, block.rows, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, block.rows - low)
                if codes:
                    data = bytes(codes.walk(n * layout.width // 8, layout.bias, layout.order, True)[1])
                else:
                    file.seek(layout.start + (block.first + low) * layout.width)
                    data = file.read(n * layout.width)
                if len(data) < n * layout.width:
                    raise ValueError("the file ends within its rows")
                records = np.frombuffer(data, np.uint8).reshape(n, layout.width)
                yield pa.RecordBatch.from_arrays([_decoded(layout, c, records) for c in layout.columns], [c.name for c in layout.columns])

    def _labels(self, layout: Layout) -> pa.RecordBatch:
        if self.table == "variables":
            told = [(c.name, c.label or None) for c in layout.columns]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*told, strict=True)], ["variable", "label"])
        spelled = lambda c, v: v if c.kind == "text" else str(float(v)) if c.kind in ("f4", "f8") else str(int(v))
        told = [(c.name, spelled(c, v), text) for c in layout.columns for v, text in layout.labels.get(c.label_set, [])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in told], pa.string()) for i in range(3)], ["variable", "code", "label"])


class LabelledSource(DataSource):
    """spark.read.format("labelled").load(path); options: table (rows, variables or labels) and rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "labelled"

    def schema(self) -> str:
        table = self.options.get("table", "rows")
        if table == "rows":
            return ", ".join(f"`{c.name}` {SQL_TYPES[c.kind]}" for c in layout_of(self.options["path"]).columns)
        return "variable string, label string" if table == "variables" else "variable string, code string, label string"

    def reader(self, schema) -> LabelledReader:
        return LabelledReader(self.options["path"], self.options.get("table", "rows"), int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION)))


def read_labelled(spark: SparkSession, path: str, table: str = "rows", rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The rows of a labelled file, its variables (variable, label), or its value labels (variable, code, label).

    Answers that the file declares as missing are null, blank texts too. Codes are spelled as Spark spells the column's
    values, so labels join through cleaning.apply_labels(). Not read: ZSAV, SPSS texts over 255 bytes, strL.
    """
    spark.dataSource.register(LabelledSource)
    return spark.read.format("labelled").option("table", table).option("rowsPerPartition", rows_per_partition).load(path)
