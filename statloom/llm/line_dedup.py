"""Drop lines that many documents repeat.

Every line of a document is exploded with its position, normalised and hashed; documents are counted once for each
hash; lines whose hash is in too many documents go, except in the largest doc_id that holds it; what is left is put
together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.base import join_hot, stash

LEAST_CHARS = 20
LEAST_DOCS = 3
_BLANKS = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def _keyed(docs: DataFrame) -> DataFrame:
    """The whole row as _row, its text and what finds it again: doc_id and a hash of the text. Rows alike in both have
    the same lines, so they may share what is found for one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_mark"))


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """_id, _mark, position from 1 and two 64-bit hashes of the key of every line that is long enough."""
    lines = _keyed(docs).where("_id IS NOT NULL").select("_id", "_mark", F.posexplode(F.split("_text", "\n")).alias("_at", "_line"))
    keys = lines.select("_id", "_mark", (F.col("_at") + 1).alias("_at"), line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= least_chars)
    return keys.select("_id", "_mark", "_at", F.xxhash64(F.lit(1), "_key").alias("_h1"), F.xxhash64(F.lit(2), "_key").alias("_h2"))


def _solved(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """_row, _lines, _dropped and _kept of every row."""
    found, _ = stash(occurrences(docs, least_chars), "lines")
    once = found.groupBy("_h1", "_h2", "_id").agg(F.count("*").alias("_n"))
    repeated = once.groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.max("_id").alias("_keeper"), F.sum("_n").alias("_n")).where(F.col("_docs") >= least_docs)
    told, _ = stash(repeated.drop("_docs"), "repeated")
    going = join_hot(found, told, ["_h1", "_h2"], "_n", found.count()).where("_id <> _keeper")
    places = going.groupBy("_id", "_mark").agg(F.array_distinct(F.collect_list("_at")).alias("_places"))
    rows = _keyed(docs).join(places, ["_id", "_mark"], "left").withColumn("_lines", F.regexp_count("_text", F.lit("\n")).cast("long") + 1)
    left = F.array_except(F.sequence(F.lit(1), F.col("_lines").cast("int")), "_places")
    # the outer function binds the lines, so a text is split once
    kept = F.transform(F.array(F.split("_text", "\n")), lambda lines: F.array_join(F.transform(left, lambda p: F.get(lines, p - 1)), "\n"))[0]
    return rows.select("_row", "_lines", F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("_dropped"), F.when(F.col("_places").isNull(), F.col("_text")).otherwise(kept).alias("_kept"))


def line_report(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped and the kept text.

    A null or empty text is one empty line. Rows that share a doc_id are one document when documents are counted, and
    each is a row of the result; a row without a doc_id is no document: it counts nowhere and keeps all its lines. A
    document of which all lines go has an empty text. An empty table gives an empty result; further columns are ignored,
    whatever their names.
    """
    return _solved(docs, least_chars, least_docs).select("_row.doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_kept").alias("kept"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with the kept text in `text`, as in line_report(); n_chars, where docs has it, is that of the new text."""
    rows = _solved(docs, least_chars, least_docs)
    new = {"text": F.when(F.col("_row.text").isNotNull(), F.col("_kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_dropped") > 0, F.char_length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return rows.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
