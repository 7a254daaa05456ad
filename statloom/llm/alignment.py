"""Align the tokens that two tokenizers cut the same text into.

Each document's B tokens form a static interval index over its bytes: sorted starts and ends. Every A token stabs it by
bisection at its first and its last byte, which lists the B tokens it overlaps. A gap after an A token that no B token
spans is a boundary between groups. Documents that hold a pair of ids linked are then counted over the whole corpus:
documents lie in blocks of bounded size, and a block sends each of its distinct pairs once and gets its count back.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.base import stash

#: A block of documents ends when it holds so many distinct pairs, summed over its documents.
BLOCK_PAIRS = 1_000_000
#: Rows of text that a worker takes at a time, in bytes.
SLICE_BYTES = 8_000_000


class Encoder:
    """Ids of texts, and the bytes that each id stands for.

    kind by file name: .json (byte-level vocabulary), .tiktoken (the same as ranks, with its splitting pattern), .model
    (pieces with byte fallback; adds a space before the text itself).
    """

    def __init__(self, path: str, pattern: str | None = None):
        kind = Path(path).suffix
        if kind == ".tiktoken":
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
            coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda text: np.asarray(coder.encode_ordinary(text), np.int64)
            self.spelled = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                self.spelled[rank] = token
        elif kind == ".json":
            words = tokenizers.Tokenizer.from_file(path)
            words.encode_special_tokens = True
            self.encode = lambda text: np.asarray(words.encode(text, add_special_tokens=False).ids, np.int64)
            letters = _byte_letters()
            self.spelled = [b""] * (max(words.get_vocab().values()) + 1)
            for token, k in words.get_vocab().items():
                if all(c in letters for c in token):
                    self.spelled[k] = bytes(letters[c] for c in token)
        else:
            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda text: np.asarray(pieces.encode(text), np.int64)
            names = [pieces.id_to_piece(k) for k in range(pieces.get_piece_size())]
            self.spelled = [bytes([int(n[3:-1], 16)]) if pieces.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.lengths = np.fromiter(map(len, self.spelled), np.int64, len(self.spelled))

    def __len__(self) -> int:
        return len(self.spelled)

    def join(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))


def _byte_letters() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    spare = count(256)
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class Intervals:
    """A static index of intervals that lie one behind the other: sorted starts and ends, searched by bisection."""

    def __init__(self, lengths: np.ndarray):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def holding(self, place: np.ndarray) -> np.ndarray:
        """The interval that holds each byte."""
        return np.searchsorted(self.ends, place, "right")

    def spans(self, gap: np.ndarray) -> np.ndarray:
        """Whether an interval begins before and ends after each gap."""
        at = np.minimum(self.holding(gap), len(self.ends) - 1)
        return (self.starts[at] < gap) & (gap < self.ends[at])


class Aligned:
    """The links and groups of one text's tokens; tokens are not empty and cover the same bytes on both sides."""

    def __init__(self, a_lengths: np.ndarray, b_lengths: np.ndarray):
        index, ends = Intervals(b_lengths), np.cumsum(a_lengths)
        self.first, last = index.holding(ends - a_lengths), index.holding(ends - 1)
        self.each = last - self.first + 1
        self.bounds = np.flatnonzero(~index.spans(ends))  # A tokens that end a group
        self.ends = ends[self.bounds]
        self.b_bounds = np.searchsorted(index.ends, self.ends)  # B tokens that end a group

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and the B token of every link."""
        a = np.repeat(np.arange(len(self.each)), self.each)
        return a, self.first[a] + np.arange(len(a)) - np.repeat(np.cumsum(self.each) - self.each, self.each)


class Writer:
    """Writes groups as a1,a2|b1;a3|b2,b3."""

    def __init__(self, n_a: int, n_b: int):
        self.parts = [f"{k}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for k in range(n)]
        self.n_a, self.n_b = n_a, n_b

    def write(self, a: np.ndarray, b: np.ndarray, aligned: Aligned) -> str:
        codes_a, codes_b = a.copy(), b + 2 * self.n_a
        codes_a[aligned.bounds] += self.n_a
        codes_b[aligned.b_bounds] += self.n_b
        a_after, b_after = aligned.bounds + 1, aligned.b_bounds + 1  # tokens up to each group's end
        group_a = np.repeat(np.arange(len(a_after)), np.diff(a_after, prepend=0))
        group_b = np.repeat(np.arange(len(b_after)), np.diff(b_after, prepend=0))
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate(([0], b_after))[group_a]] = codes_a
        out[np.arange(len(b)) + a_after[group_b]] = codes_b
        return "".join(map(self.parts.__getitem__, out.tolist()))[:-1]


def tokens(a: Encoder, b: Encoder, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of both sides; none where the text is null or empty or where either side's bytes aren't a space and the text."""
    if text:
        whole, ids_a, ids_b = " " + text, a.encode(" " + text), b.encode(text)
        data = whole.encode()
        if a.join(ids_a) == data and b.join(ids_b) == data:
            return ids_a[a.lengths[ids_a] > 0], ids_b[b.lengths[ids_b] > 0]
    return np.empty(0, np.int64), np.empty(0, np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    """doc_id and text row by row, of which a bounded part is unpacked at a time."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(SLICE_BYTES, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


_FIRST = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _first_pass(a_path: str, b_path: str, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Encoder(a_path, pattern), Encoder(b_path, pattern)
        writer, names = Writer(len(a), len(b)), [c.split()[0] for c in _FIRST.split(", ")]
        block, held, rows = TaskContext.get().partitionId() << 32, 0, []

        def packed() -> pa.RecordBatch:
            *plain, pairs, times = zip(*rows, strict=True)
            cuts = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            kinds = [pa.int64()] * 6 + [pa.string()]
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x))) for x in (pairs, times)]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(plain, kinds, strict=True)] + lists, names)

        for doc_id, text in _texts(batches):
            ids_a, ids_b = tokens(a, b, text)
            if len(ids_a):
                aligned = Aligned(a.lengths[ids_a], b.lengths[ids_b])
                at_a, at_b = aligned.links()
                pairs, times = np.unique(ids_a[at_a] * len(b) + ids_b[at_b], return_counts=True)
                digest = hashlib.sha256(writer.write(ids_a, ids_b, aligned).encode()).hexdigest()
                rows.append((block, doc_id, len(ids_a), len(ids_b), len(aligned.bounds), len(at_a), digest, pairs, times.astype(np.int32)))
            else:
                rows.append((block, doc_id, 0, 0, 0, 0, "", ids_a, ids_a.astype(np.int32)))
            held += len(rows[-1][-1]) + 16
            if held > BLOCK_PAIRS:
                yield packed()
                block, held, rows = block + 1, 0, []
        if rows:
            yield packed()

    return run


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, pair and the number of documents with it, from rows of whole or cut blocks."""
    for batch in batches:
        blocks, cuts = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy()
        flat = batch.column(1).values.to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            pair, n = np.unique(flat[cuts[low] : cuts[high]], return_counts=True)
            if high > low and len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), blocks[low])), pa.array(pair), pa.array(n)], ["block", "pair", "n"])


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _second_pass(docs: pa.Table, told: pa.Table) -> pa.Table:
    docs = docs.combine_chunks()
    pair = told.column("pair").to_numpy()
    order = np.argsort(pair, kind="stable")
    pair, docs_with, best = pair[order], told.column("docs_with").to_numpy()[order], told.column("best").to_numpy(zero_copy_only=False)[order]
    pairs, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
    if len(pair):
        at, weight = np.searchsorted(pair, pairs.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (weight * docs_with[at], weight * best[at])]
    else:
        sums = [np.zeros(1, np.int64)] * 2
    cuts = np.concatenate(([0], np.cumsum(np.asarray(pairs.value_lengths()))))
    count_sum, n_best = (s[cuts[1:]] - s[cuts[:-1]] for s in sums)
    columns = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return pa.table([columns[c] if c in columns else docs.column(c) for c in names], names=names)


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Every row is a document, those that repeat a doc_id or have none too. Rows whose text is null or empty, or whose
    tokens don't spell a space and the text, have zeros and an empty digest. An empty table gives an empty result;
    further columns are ignored. Ties for an A id's highest count all count as best. pattern: how a .tiktoken file's
    texts are split.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first, _ = stash(given.mapInArrow(_first_pass(a_path, b_path, pattern), _FIRST), "aligned")
    parts, _ = stash(first.select("block", "pairs").mapInArrow(_block_pairs, "block long, pair long, n long"), "pairs")
    counts, _ = stash(parts.groupBy("pair").agg(F.sum("n").alias("docs_with")), "counts")
    n_b = len(Encoder(b_path, pattern))
    id_a = F.floor(F.col("pair") / F.lit(n_b))
    highest = counts.groupBy(id_a.alias("id_a")).agg(F.max("docs_with").alias("highest"))
    # one row for each id of A's vocabulary at most
    marked = counts.withColumn("id_a", id_a).join(F.broadcast(highest), "id_a").select("pair", "docs_with", (F.col("docs_with") == F.col("highest")).alias("best"))
    told = parts.select("block", "pair").join(marked, "pair")
    return first.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_second_pass, _RESULT)


_GROUPS = "doc_id long, ends array<long>, a_ids array<array<int>>, b_ids array<array<int>>"


def groups(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id and, for each group, its last byte offset and the ids of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Encoder(a_path, pattern), Encoder(b_path, pattern)
        for doc_id, text in _texts(batches):
            ids_a, ids_b = tokens(a, b, text)
            found: tuple = ([], [], [])
            if len(ids_a):
                x = Aligned(a.lengths[ids_a], b.lengths[ids_b])
                found = (x.ends.tolist(), *([p.tolist() for p in np.split(ids, at[:-1] + 1)] for ids, at in ((ids_a, x.bounds), (ids_b, x.b_bounds))))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((doc_id, *found), kinds, strict=True)], ["doc_id", "ends", "a_ids", "b_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _GROUPS)
