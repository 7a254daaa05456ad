"""URL filter over a sorted array of 64-bit digests.

The list of blocked hosts and of host and path rules becomes one file: ascending XXH64 keys, string offsets, verdict
codes and the strings themselves. Executors memory-map it and probe all candidate keys of a batch of URLs with one
vectorised binary search; a hit counts only if the stored string equals the candidate, so collisions do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from statloom.llm.base import shared_dir

#: A list file above this many bytes is not sent to the executors; it is joined instead.
MOST_BYTES = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEAD = 3  # int64 words before the keys: number of entries, number of path lengths, length of the longest host
_SEPARATOR = "\x00"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the URL's path starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: str = "url") -> tuple:
    """Host (after the first ://, ASCII lower case) and path (up to ? or #); both empty without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def _key(host: str, path: str | None) -> bytes:
    return (host if path is None else host + _SEPARATOR + path).encode()


def build(rules: Iterable[Rule], blocked: Iterable[str]) -> bytes:
    """The list file. Entries: host NUL path for rules, bare host for blocked hosts."""
    rules = list(dict.fromkeys(rules))
    keys = [_key(r.host, r.path) for r in rules]
    if len(set(keys)) < len(keys):
        raise ValueError("two rules share host and path")
    codes = [1 if r.verdict == "allow" else 2 for r in rules]
    hosts = sorted(set(blocked))
    keys += [_key(h, None) for h in hosts]
    codes += [3] * len(hosts)
    digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
    order = np.argsort(digests, kind="stable")
    ordered = [keys[i] for i in order]
    offsets = np.cumsum([0, *map(len, ordered)], dtype=np.int64)
    lengths = np.array(sorted({len(r.path) for r in rules}), dtype=np.int64)
    longest = max([len(h) for h in [*hosts, *(r.host for r in rules)]], default=0)
    head = np.array([len(keys), len(lengths), longest], dtype=np.int64)
    parts = (head, lengths, digests[order], offsets, np.array(codes, dtype=np.int64)[order])
    return b"".join(p.tobytes() for p in parts) + b"".join(ordered)


class DigestArray:
    """The list file, memory-mapped."""

    def __init__(self, path: str):
        words = np.memmap(path, dtype=np.int64, mode="r", shape=(_HEAD,))
        n, k, self.longest = map(int, words)
        all_words = np.memmap(path, dtype=np.int64, mode="r", shape=(_HEAD + k + 3 * n + 1,))
        self.lengths = all_words[_HEAD : _HEAD + k]
        at = _HEAD + k
        self.digests = all_words[at : at + n].view(np.uint64)
        self.offsets = all_words[at + n : at + 2 * n + 1]
        self.codes = all_words[at + 2 * n + 1 : at + 3 * n + 1]
        start = 8 * len(all_words)
        size = int(self.offsets[-1])
        self.heap = np.memmap(path, dtype=np.uint8, mode="r", offset=start, shape=(size,)) if size else b""

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The entry's code for each key, 0 where the array does not hold that very string."""
        out = np.zeros(len(keys), dtype=np.int64)
        if not len(self.digests) or not keys:
            return out
        wanted = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        at = np.searchsorted(self.digests, wanted)
        inside = at < len(self.digests)
        hits = np.flatnonzero(inside & (self.digests[np.minimum(at, len(self.digests) - 1)] == wanted))
        for i in hits:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:  # equal digests stand side by side
                if bytes(self.heap[self.offsets[j] : self.offsets[j + 1]]) == keys[i]:
                    out[i] = self.codes[j]
                    break
                j += 1
        return out


def _suffixes(host: str, longest: int) -> Iterator[str]:
    """The host and its parent domains, of those at most `longest` long; longer ones are in no list."""
    if host and len(host) <= longest:
        yield host
    tail = host[-longest - 1 :]
    at = tail.find(".")
    while -1 < at < len(tail) - 1:
        yield tail[at + 1 :]
        at = tail.find(".", at + 1)


def _judge(array: DigestArray, hosts: list[str], paths: list[str]) -> tuple[list, list]:
    keys, owner, texts = [], [], []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        for part in _suffixes(host, array.longest):
            keys.append(_key(part, None))
            owner.append(i)
            texts.append(None)
            for n in array.lengths:
                if n <= len(path):
                    keys.append(_key(part, path[:n]))
                    owner.append(i)
                    texts.append((len(part) + int(n), len(part), part + path[:n]))
    best: list = [None] * len(hosts)
    listed = [False] * len(hosts)
    codes = array.find(keys)
    for k in np.flatnonzero(codes):
        i = owner[k]
        if codes[k] == 3:
            listed[i] = True
        elif best[i] is None or texts[k][:2] > best[i][0][:2]:
            best[i] = (texts[k], "allow" if codes[k] == 1 else "block")
    rules = [b and b[0][2] for b in best]
    return rules, [b[1] if b else "block" if x else "allow" for b, x in zip(best, listed, strict=True)]


def publish(spark: SparkSession, content: bytes) -> str:
    """Put the list file into the shared folder and have Spark hand it to every executor. Returns its name."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark)}/statloom/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        for k in range(0, len(content), 1 << 20):
            out.write(bytearray(content[k : k + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def filter_urls(pages: DataFrame, rules: Iterable[Rule], blocked: Iterable[str] | DataFrame, id_column: str = "page_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    The longest fitting rule decides (of equally long ones that with the longer host); without one, `block` if the host
    or a parent domain of it is listed in blocked, else `allow`. A null url, or one without ://, has empty host and path
    and is allowed with rule null. Rows with equal ids or urls are judged each for itself; an empty table gives an empty
    result; further columns are ignored. However long a host is, only parent domains no longer than the longest listed
    host are tried. blocked may be a DataFrame with a column host. A list above most_bytes is not sent to executors, and
    as a DataFrame doesn't reach the driver: see join_urls().
    """
    rules = list(rules)
    if any(r.verdict not in ("allow", "block") for r in rules):
        raise ValueError("a rule allows or blocks")
    host, path = host_and_path()
    judged = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(blocked, DataFrame):
        blocked = blocked.select(F.col("host").cast("string").alias("host")).where("host is not null")
        size = blocked.agg(F.coalesce(F.sum(F.octet_length("host") + 24), F.lit(0)).alias("bytes")).first()["bytes"]
        if size > most_bytes:
            return join_urls(judged, rules, blocked)
        blocked = [r["host"] for r in blocked.collect()]
    content = build(rules, blocked)
    if len(content) > most_bytes:
        return join_urls(judged, rules, pages.sparkSession.createDataFrame([(h,) for h in blocked], "host string"))
    name = publish(pages.sparkSession, content)
    schema = StructType([*judged.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            found, verdicts = _judge(array, b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return judged.mapInArrow(probe, schema)


def join_urls(judged: DataFrame, rules: list[Rule], blocked: DataFrame) -> DataFrame:
    """The same verdicts by shuffled equality joins on digest and string, for lists too large to send out."""
    spark = judged.sparkSession
    entries = spark.createDataFrame([(r.host, r.path, r.verdict, r.text) for r in rules], "host string, prefix string, verdict string, rule string")
    none = F.lit(None).cast("string")
    listed = entries.unionByName(blocked.select("host", none.alias("prefix"), F.lit("block").alias("verdict"), none.alias("rule"))).distinct()
    longest = listed.agg(F.max(F.length("host")).alias("n")).first()["n"] or 0
    # of a longer host only the parts after the first point of its end can be listed
    parts = F.split(F.expr(f"right(host, {longest + 1})"), r"\.")
    first = F.when(F.length("host") > longest, 2).otherwise(1)
    domains = F.when(F.size(parts) >= first, F.transform(F.sequence(first, F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts)))))
    lengths = sorted({len(r.path) for r in rules})
    prefixes = F.array(F.lit(None).cast("string"), *[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    rows = judged.withColumn("row", F.monotonically_increasing_id())
    keys = rows.select("row", F.explode(F.array_distinct(domains)).alias("host"), F.array_distinct(prefixes).alias("prefixes")).where("host <> ''").select("row", "host", F.explode("prefixes").alias("prefix"))
    same = (F.xxhash64("k.host", "k.prefix") == F.xxhash64("l.host", "l.prefix")) & (F.col("k.host") == F.col("l.host")) & F.col("k.prefix").eqNullSafe(F.col("l.prefix"))
    hits = keys.alias("k").join(listed.alias("l"), same).select("row", "l.verdict", "rule", F.length("rule").alias("size"), F.length("l.host").alias("host_size"))
    best = hits.groupBy("row").agg(F.max(F.when(F.col("rule").isNotNull(), F.struct("size", "host_size", "rule", "verdict"))).alias("best"), F.lit(True).alias("hit"))
    verdict = F.coalesce("best.verdict", F.when(F.col("hit"), "block"), F.lit("allow"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
