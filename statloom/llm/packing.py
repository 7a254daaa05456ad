"""Packing of documents into sequences along a space-filling curve.

Each document's token counts are hashed into a vector, projected to three dimensions and given its place on a Hilbert
curve. Spark range-partitions and sorts the documents by that place, so each partition holds a stretch of the curve;
its token stream is cut into full sequences one after another.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statloom.llm.base import raw, stash

LENGTH = 2048
END_ID = 1
DIMENSIONS, BITS = 3, 10
HASHED = 1024
SEED = 5
#: Words that a worker remembers, the first that it meets; longer words than that many bytes are not remembered.
REMEMBERED = 900_000
LONG_WORD = 48
#: Trailing marks that the tokenizer parts from a letter before them.
MARKS = b".,;:!?"


class WordTokens:
    """Token ids of whole texts. White space always parts tokens here, so each distinct word is tokenised once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                out[w] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not met before. Case does not matter, and a letter is parted from marks that end the word."""
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        for w in words:
            low = w.lower()
            base = low.rstrip(MARKS)
            parts[w] = (base, low[len(base) :]) if base[-1:].isalpha() or base and base[-1] > 127 and base.decode("utf-8", "replace")[-1].isalpha() else (low, b"")
        known = self.known
        new = self._encode([p for p in dict.fromkeys(p for pair in parts.values() for p in pair) if p and p not in known])
        self._remember(new)
        get = new.get
        return {w: (known.get(a) or get(a, b"")) + (known.get(b) or get(b, b"")) for w, (a, b) in parts.items()}

    def _remember(self, ids: dict[bytes, bytes]) -> None:
        room = REMEMBERED - len(self.known)
        if room > 0:
            self.known.update([(w, x) for w, x in ids.items() if len(w) <= LONG_WORD][:room])

    def ids(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        found = list(map(self.known.get, words))
        if None in found:
            own = self._learn(list(dict.fromkeys(w for w, x in zip(words, found, strict=True) if x is None)))
            found = [own[w] if x is None else x for w, x in zip(words, found, strict=True)]
            self._remember(own)
        return np.frombuffer(b"".join(found), dtype="<u4")


@cache
def _worker_tokens(path: str) -> WordTokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
    return WordTokens(path)


@cache
def _projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((HASHED, DIMENSIONS))


def coordinates(ids: np.ndarray) -> np.ndarray:
    """The document's hashed vector of log counts, scaled to length one, projected and cut to BITS bits a dimension."""
    if not len(ids):
        return np.zeros(DIMENSIONS, dtype=np.int64)
    places = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 10)
    vector = np.log1p(np.bincount(places.astype(np.int64), minlength=HASHED))
    point = vector @ _projection() / np.linalg.norm(vector)
    return np.clip((point + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates."""
    x = [points[:, k].copy() for k in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level, from the top
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    place = np.zeros_like(x[0])
    x = [v ^ t for v in x]
    for b in range(bits - 1, -1, -1):
        for v in x:
            place = (place << 1) | ((v >> b) & 1)
    return place


def tokenised(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (little-endian, with END_ID last), doc_tokens and place of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens(tokenizer_path)
        small = tokens.tokenizer.get_vocab_size() <= 1 << 16
        for b in batches:
            if not b.num_rows:
                continue
            ids, counts, points = [], [], []
            for text in raw(b.column("text")):
                own = tokens.ids(text)
                points.append(coordinates(own))
                own = np.append(own, np.uint32(END_ID))
                counts.append(len(own))
                ids.append(own.astype("<u2" if small else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(hilbert(np.array(points)))], names=["doc_id", "ids", "doc_tokens", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, doc_tokens long, place long")


class _Packer:
    """Cuts a stream of documents into sequences; the pieces of the open sequence wait until it is full."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.open: list[tuple] = []
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, self.length - self.filled)
            self.open.append((doc_id, start, ids[start : start + n], len(ids)))
            self.filled += n
            start += n
            if self.filled == self.length:
                self._close()

    def _close(self) -> None:
        at = 0
        for doc_id, start, ids, total in self.open:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, at))
            at += len(ids)
        self.open, self.filled = [], 0
        self.sequence += 1

    def finish(self) -> None:
        """The rest is cut into sequences whose lengths are powers of two, which need no padding."""
        rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        whole = self.length
        for doc_id, start, ids, total in rest:
            at = 0
            while at < len(ids):
                if not self.open:
                    self.length = 1 << (left.bit_length() - 1)
                n = min(len(ids) - at, self.length - self.filled)
                self.open.append((doc_id, start + at, ids[at : at + n], total))
                self.filled += n
                at += n
                if self.filled == self.length:
                    left -= self.length
                    self._close()
        self.length = whole

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each row of docs is a document of its own, also where a doc_id or text repeats; a null or empty text is the single
    id END_ID; an empty table gives no pieces; further columns are ignored. Copies share a place on the curve; a hash of
    the id orders them, so that the range partitions can part them. The last, partly filled sequence of each partition
    is cut into sequences of 1024, 512 ... 1 tokens as needed. A sequence's number holds its partition above bit 40.
    """
    kept, _ = stash(tokenised(docs, tokenizer_path), "tokens")
    order = ["place", "tie", "doc_id"]
    dealt = kept.withColumn("tie", F.xxhash64("doc_id")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids", "doc_tokens")
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << 40)
        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=list(NAMES))

        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc_id, ids, n in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("doc_tokens").to_pylist(), strict=True):
                packer.add(doc_id, np.frombuffer(ids, dtype=f"<u{len(ids) // n}"))
            yield batch(packer.take())
        packer.finish()
        if kind is not None:
            yield batch(packer.take())

    return dealt.mapInArrow(run, schema)
