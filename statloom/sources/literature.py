"""Bibliographic services as a Spark data source over folders of their answers, pages of JSON.

    path/index/year=2021/...      pages with results[] and inverted abstracts
    path/registry/year=2021/...   pages with message.items[], read where there is no index

Bounds of the year, kinds of works and columns are parameters of a request, given as options of the read. It names the
years' folders, so pages of other years aren't opened; each file is a partition. A file holds a page a line.

With the option pushFilters and Spark's setting spark.sql.python.filterPushdown.enabled, filters of a query narrow the
request too. Spark 4.1 keeps one plan of the read for all uses of a frame, so that one filter then rules the others: use a
frame that was read so in one query, with one filter. Without the option frames are used as any others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

ROWS_PER_BATCH = 1_000
TYPES = {"doi": pa.string(), "title": pa.string(), "year": pa.int32(), "authors": pa.list_(pa.string()), "journal": pa.string(), "citations": pa.int64(), "abstract": pa.string(), "open_access": pa.bool_(), "kind": pa.string(), "service": pa.string()}
SQL_TYPES = {"doi": "string", "title": "string", "year": "int", "authors": "array<string>", "journal": "string", "citations": "bigint", "abstract": "string", "open_access": "boolean", "kind": "string", "service": "string"}
_TAG = re.compile(r"<[^<>]*>")
_YEAR_FOLDER = re.compile(r"/year=([^/]+)/[^/]+$")


@dataclass
class Request:
    """What is asked of a service: years between two bounds or among some, kinds of works, and columns."""

    columns: tuple[str, ...]
    first: int | None = None
    last: int | None = None
    years: frozenset[int] | None = None
    kinds: frozenset[str] | None = None
    known: frozenset[str] = frozenset()

    def narrow(self, f: Filter) -> bool:
        """Take a filter into the request, if it has such a parameter."""
        name, value = getattr(f, "attribute", None), getattr(f, "value", None)
        several = frozenset(value) - {None} if isinstance(f, In) else frozenset((value,)) if isinstance(f, EqualTo) else None
        if isinstance(f, IsNotNull) and name in (("year",), ("kind",)):
            self.known |= set(name)
        elif name == ("kind",) and several is not None:
            self.kinds = several if self.kinds is None else self.kinds & several
        elif name == ("year",) and several is not None:
            self.years = several if self.years is None else self.years & several
        elif name == ("year",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
            low = value + isinstance(f, GreaterThan)
            self.first = low if self.first is None else max(self.first, low)
        elif name == ("year",) and isinstance(f, LessThan | LessThanOrEqual):
            high = value - isinstance(f, LessThan)
            self.last = high if self.last is None else min(self.last, high)
        else:
            return False
        return True

    def wants_year(self, year: int | None) -> bool:
        if year is None:  # null is neither within bounds nor among years
            return self.first is None and self.last is None and self.years is None and "year" not in self.known
        return (self.first is None or year >= self.first) and (self.last is None or year <= self.last) and (self.years is None or year in self.years)

    def wants(self, work: dict) -> bool:
        kind = work["kind"]
        return self.wants_year(work["year"]) and (self.kinds is None or kind in self.kinds) and (kind is not None or "kind" not in self.known)


def _plain(text: str | None) -> str | None:
    return None if text is None else unescape(_TAG.sub(" ", text)).strip()


def _ordered(places: dict[str, list[int]] | None) -> str | None:
    """A text from the places of its words."""
    return " ".join(w for _, w in sorted((i, w) for w, at in places.items() for i in at)) if places else None


def _at(value, *path):
    """What a path of names and numbers leads to, null where it breaks off."""
    for step in path:
        if isinstance(step, int):
            value = value[step] if isinstance(value, list) and len(value) > step else None
        else:
            value = value.get(step) if isinstance(value, dict) else None
    return value


def _index_fields(r: dict) -> dict[str, Callable]:
    return {
        "doi": lambda: re.sub(r"^https?://(dx\.)?doi\.org/", "", r["doi"]) if r.get("doi") else None,
        "title": lambda: _plain(r.get("title") or r.get("display_name")),
        "year": lambda: r.get("publication_year"),
        "authors": lambda: [n for a in r.get("authorships") or () if (n := _at(a, "author", "display_name"))],
        "journal": lambda: _at(r, "primary_location", "source", "display_name"),
        "citations": lambda: int(r.get("cited_by_count") or 0),
        "abstract": lambda: _ordered(r.get("abstract_inverted_index")),
        "open_access": lambda: _at(r, "open_access", "is_oa"),
        "kind": lambda: r.get("type"),
        "service": lambda: "index",
    }


def _registry_fields(r: dict) -> dict[str, Callable]:
    dates = ("published-print", "published-online", "issued")
    return {
        "doi": lambda: r.get("DOI"),
        "title": lambda: _plain(_at(r, "title", 0)),
        "year": lambda: next((y for d in dates if (y := _at(r, d, "date-parts", 0, 0))), None),
        "authors": lambda: [" ".join(x for x in (a.get("given"), a["family"]) if x) for a in r.get("author") or () if a.get("family")],
        "journal": lambda: _at(r, "container-title", 0),
        "citations": lambda: int(r.get("is-referenced-by-count") or 0),
        "abstract": lambda: _plain(r.get("abstract")),
        "open_access": lambda: None,
        "kind": lambda: r.get("type"),
        "service": lambda: "registry",
    }


#: Services in the order in which they are asked: where a page's records are, and their fields.
SERVICES = {"index": (("results",), _index_fields), "registry": (("message", "items"), _registry_fields)}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    found = urlparse(path)
    if found.scheme in ("", "file"):  # Java writes file:/a, others file:///a
        return fs.LocalFileSystem(), found.path if found.scheme else path
    return fs.FileSystem.from_uri(path)


@dataclass
class Pages(InputPartition):
    service: str
    name: str


class LiteratureReader(DataSourceReader):
    def __init__(self, path: str, request: Request):
        self.path, self.request = path, request

    def partitions(self) -> list[Pages]:
        """Files of the years that the request wants, at the first service whose folder is there."""
        store, root = _store(self.path)
        for service in SERVICES:
            folder = f"{root.rstrip('/')}/{service}"
            if store.get_file_info(folder).type != fs.FileType.Directory:
                continue
            names = sorted(i.path for i in store.get_file_info(fs.FileSelector(folder, recursive=True)) if i.is_file and i.size and not i.base_name.startswith(("_", ".")))
            # pages outside folders of years may hold any year
            told = [(n, m[1] if (m := _YEAR_FOLDER.search(n)) else "any") for n in names]
            return [Pages(service, n) for n, y in told if y == "any" or self.request.wants_year(int(y) if y.isdigit() else None)]
        raise FileNotFoundError(f"no pages of {' or '.join(SERVICES)} below {self.path}")

    def read(self, pages: Pages | None) -> Iterator[pa.RecordBatch]:
        if pages is None:  # no files at all
            return
        store, _ = _store(self.path)
        place, fields_of = SERVICES[pages.service]
        columns = self.request.columns
        rows: list[list] = []

        def batch() -> pa.RecordBatch:
            made = [pa.array([r[i] for r in rows], TYPES[c]) for i, c in enumerate(columns)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, list(columns))

        with store.open_input_stream(pages.name) as raw, pa.PythonFile(raw, mode="r") as file:
            for number, line in enumerate(_lines(file), 1):
                try:
                    page = json.loads(line)
                except ValueError as fault:
                    raise ValueError(f"page {number} of {pages.name} is no JSON") from fault
                for record in _at(page, *place) or ():
                    fields = fields_of(record)
                    if self.request.wants({"year": fields["year"](), "kind": fields["kind"]()}):
                        rows.append([fields[c]() for c in columns])
                        if len(rows) == ROWS_PER_BATCH:
                            yield batch()
        if rows:
            yield batch()


class PushingReader(LiteratureReader):
    """Takes filters into the request. Spark accepts no such reader where its setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.request.narrow(f)]


def _lines(file) -> Iterator[bytes]:
    """Lines that aren't blank, read block by block."""
    rest = b""
    while block := file.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


class LiteratureSource(DataSource):
    """spark.read.format("literature").load(path); options: columns and kinds (names by commas, all if none), firstYear,
    lastYear, pushFilters (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "literature"

    def _names(self, option: str) -> tuple[str, ...]:
        return tuple(c.strip() for c in self.options.get(option, "").split(",") if c.strip())

    def _columns(self) -> tuple[str, ...]:
        asked = self._names("columns") or tuple(TYPES)
        if unknown := set(asked) - set(TYPES):
            raise ValueError(f"no such columns of works: {', '.join(sorted(unknown))}")
        return asked

    def schema(self) -> str:
        return ", ".join(f"{c} {SQL_TYPES[c]}" for c in self._columns())

    def reader(self, schema) -> LiteratureReader:
        first, last = (int(v) if (v := self.options.get(o)) else None for o in ("firstYear", "lastYear"))
        kind = PushingReader if self.options.get("pushFilters", "").lower() == "true" else LiteratureReader
        return kind(self.options["path"], Request(self._columns(), first, last, kinds=frozenset(self._names("kinds")) or None))


def read_literature(spark: SparkSession, path: str, columns: Iterable[str] = (), first_year: int | None = None, last_year: int | None = None, kinds: Iterable[str] = (), push: bool = False) -> DataFrame:
    """Works of the first service that has answers below path: columns as in SQL_TYPES, or those asked for.

    Bounds of the year include their ends and leave out works without a year. Absent fields are null, absent citations 0.
    A page that is no JSON is an error with its place. Where both folders are missing, that is an error too.
    push lets a query's filters into the request, for a frame of one use (see above).
    """
    spark.dataSource.register(LiteratureSource)
    options = {"columns": ",".join(columns), "kinds": ",".join(kinds), "firstYear": first_year, "lastYear": last_year, "pushFilters": "true" if push else ""}
    return spark.read.format("literature").options(**{k: str(v) for k, v in options.items() if v not in (None, "")}).load(path)


def write_index(works: DataFrame, path: str) -> None:
    """Write works (doi, title, year, citations, kind) as the index's pages, in folders of years, a record a page."""
    record = F.struct("doi", "title", F.col("year").alias("publication_year"), F.col("citations").alias("cited_by_count"), F.col("kind").alias("type"))
    works.select("year", F.to_json(F.struct(F.array(record).alias("results"))).alias("value")).write.partitionBy("year").mode("overwrite").text(f"{path.rstrip('/')}/index")
