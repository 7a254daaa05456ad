"""Near-duplicates by SimHash fingerprints with deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. Of two fingerprints that differ in four bits at most, some segment
differs in one bit at most, so with that one bit blanked out the segments are equal. Each fingerprint is indexed under
every segment with every one of its bits blanked (64 keys), equal keys meet in an equality join, and the full
fingerprints are compared. A link counts only under the first key that its two fingerprints share.

Equal fingerprints are one node, so copies never meet in pairs. Fingerprints under a very common key are dealt into
blocks; each pair of blocks is one small task that returns a spanning forest of its links instead of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.base import dealt, drop, join_hot, raw, stash

SHINGLE = 4
MOST_BITS = 4
HASH_SEED = 42
#: First bit and width of the segments. With k segments and MOST_BITS < 2 k some segment has one differing bit at most.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys with more fingerprints are compared block by block; rows in a block.
COMMON = 192
BLOCK = 256
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """A bit is 1 if it is set in over half of the XXH64 of the word shingles, repeats included; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t) for t in raw(b.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _mask(segment: tuple[int, int]) -> int:
    return ((1 << segment[1]) - 1) << segment[0]


def _variants(nodes: DataFrame) -> DataFrame:
    """fp under each of its 64 keys: bit (the blanked one) and value (its segment without that bit)."""
    masks = [_signed(_mask(s) & ~(1 << b)) for s in SEGMENTS for b in range(s[0], s[0] + s[1])]
    at = F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("bit", "mask")
    return nodes.select("fp", at).select("fp", "bit", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))


def _first_key(x: Column, bit: Column) -> Column:
    """Whether `bit` belongs to the first key under which two fingerprints with xor x meet."""
    found = F.lit(None).cast("int")
    for first, width in reversed(SEGMENTS):
        part = x.bitwiseAND(F.lit(_signed(_mask((first, width)))))
        at = F.when(part == 0, F.lit(first)).otherwise(F.bit_count(part - 1).cast("int"))
        if first + width == 64:  # part - 1 of the topmost bit alone is still right in two's complement
            at = F.when(part == 0, F.lit(first)).when(part < 0, F.lit(63)).otherwise(F.bit_count(part - 1).cast("int"))
        found = F.when(F.bit_count(part) <= 1, at).otherwise(found)
    return found == bit


def _numpy_first_key(x: np.ndarray, bit: int) -> np.ndarray:
    """The same for an array of xors."""
    ok = np.ones(x.shape, dtype=bool)
    for segment in SEGMENTS:
        part = x & np.uint64(_mask(segment))
        few = np.bitwise_count(part) <= 1
        if segment[0] <= bit < segment[0] + segment[1]:
            here = (part == np.uint64(1 << bit)) | ((part == 0) & (bit == segment[0]))
            return ok & here
        ok &= ~few
    raise ValueError(bit)


def _forest(left: np.ndarray, right: np.ndarray, bit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks (or within one), without listing the links."""
    x = left[:, None] ^ right[None, :]
    linked = (np.bitwise_count(x) <= MOST_BITS) & (x != 0) & _numpy_first_key(x, bit)
    edges: list[tuple[int, int]] = []
    free_l, free_r = np.ones(len(left), dtype=bool), np.ones(len(right), dtype=bool)
    for start in np.flatnonzero(linked.any(axis=1)):
        if not free_l[start]:
            continue
        free_l[start] = False
        todo = [(True, int(start))]
        while todo:
            is_left, i = todo.pop()
            near, free = (linked[i], free_r) if is_left else (linked[:, i], free_l)
            new = np.flatnonzero(near & free)
            free[new] = False
            for j in new.tolist():
                edges.append((int(left[i]), int(right[j])) if is_left else (int(left[j]), int(right[i])))
                todo.append((not is_left, j))
    return edges


def _block_pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Forest edges of one pair of blocks of one key."""
    bit, a, b = int(key[0]), int(key[2]), int(key[3])
    fps = rows["fp"].to_numpy().view(np.uint64)
    blocks = rows["block"].to_numpy()
    edges = np.array(_forest(fps[blocks == a], fps[blocks == b], bit), dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints that keep all connections. nodes: distinct fp.

    Under keys of at most COMMON fingerprints every link at most MOST_BITS bits apart, once; under more common ones a
    spanning forest for each pair of blocks.
    """
    # 64 keys come from each row, so the rows are dealt out before
    variants = _variants(dealt(nodes.select("fp"), "fp"))
    counts = variants.groupBy("bit", "value").agg(F.count("*").alias("n"))
    # Spark sizes exploded rows by what they came from, and would broadcast them: so it is told to merge
    marked = variants.join(counts.where(F.col("n") > COMMON).hint("merge"), ["bit", "value"], "left")
    rare, common = marked.where(F.col("n").isNull()), marked.where(F.col("n").isNotNull())
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    same = (F.col("l.bit") == F.col("r.bit")) & (F.col("l.value") == F.col("r.value")) & (F.col("l.fp") < F.col("r.fp"))
    found = rare.alias("l").join(rare.hint("merge").alias("r"), same & (F.bit_count(x) <= MOST_BITS) & _first_key(x, F.col("l.bit"))).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    in_blocks = common.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = in_blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("fp", "bit", "value", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    forests = pairs.groupBy("bit", "value", "a", "b").applyInPandas(_block_pair, "a long, b long")
    edges, _ = stash(found.unionByName(forests), "links")
    return edges


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for every node with an edge.

    Alternating large-star and small-star steps until the edges are stars; each step is written to the shared folder.
    """
    spark = edges.sparkSession
    current, path = stash(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "stars")
    for _ in range(most_rounds):
        both = current.select(F.col("low").alias("u"), F.col("high").alias("v")).union(current.select("high", "low"))
        total = 2 * current.count()
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, least, "u", "n", total).where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low <> high").distinct()
        # small star: every node and its lower neighbours point to the lowest of them
        lower = large.groupBy("high").agg(F.min("low").alias("m"), F.count("*").alias("n"))
        linked = join_hot(large, lower, "high", "n", total)
        small = linked.select(F.col("m").alias("low"), F.col("low").alias("high")).where("low <> high").union(lower.select(F.col("m").alias("low"), "high")).distinct()
        after, after_path = stash(small, "stars")
        # stars: no node is both a root and a leaf, and each leaf has one root
        done = after.groupBy("high").count().where("count > 1").limit(1).isEmpty() and after.select(F.col("low").alias("high")).join(after, "high", "left_semi").limit(1).isEmpty()
        drop(spark, path)
        current, path = after, after_path
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("high").alias("node"), F.col("low").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like others. Rows that repeat a doc_id each return a row;
    null ids take part, but name a component only if it holds no other id (then null). Copies of one text are one node,
    whatever their number; an empty table gives an empty result; further columns are ignored.
    """
    prints, _ = stash(fingerprints(docs), "fingerprints")
    nodes, _ = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    of_print = join_hot(rooted, smallest, "root", "n", nodes.count()).select("fp", "copies", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_hot(prints, of_print, "fp", "copies", prints.count()).select("doc_id", text.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of docs: the one with the smallest doc_id.

    Of rows that repeat that doc_id, one stays: that with the smallest hash of its text and columns.
    """
    firsts = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("times"))
    chosen, _ = stash(firsts, "firsts")
    kept = docs.join(chosen.where("doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    nulls = chosen.where("doc_id is null").limit(1).count()
    if nulls:
        kept = kept.unionByName(docs.where("doc_id is null"))
    if chosen.where("times > 1").limit(1).isEmpty():
        return kept
    whole = kept.select(F.struct(*docs.columns).alias("row"))
    rank = F.row_number().over(Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row")))
    return whole.withColumn("rank", rank).where("rank = 1").select("row.*")
