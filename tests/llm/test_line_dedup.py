import hashlib

from pyspark.sql import functions as F

from statloom.llm import line_dedup

BLANKS = " \t\n\v\f\r"
SCHEMA = "doc_id long, text string"


def brute(rows, least_chars=20, least_docs=3):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc_id is None or len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=repr)


LONG = "a line of more than twenty characters"
HARD = [
    (1, f"one\n  {LONG.upper()}\t\nlast"), (2, f"{LONG}\n{LONG}\n"), (3, LONG), (4, f"\n\n{LONG}\v\n {LONG}"),
    (5, None), (6, ""), (7, "\n"), (8, "ÀÉ" * 10), (9, "àé" * 10), (10, "ÀÉ" * 10), (11, " " + "ÀÉ" * 10 + "\r\nkept"),
    (12, "short\nshort"), (13, "short"), (14, "short"), (None, LONG), (None, None), (3, LONG), (3, "another text\n" + LONG), (-5, "x" * 20), (-6, "x" * 20), (-7, "x" * 19 + " "), (-8, "X" * 20 + "\nend"),
]


def test_hard_cases(spark):
    assert got(line_dedup.line_report(spark.createDataFrame(HARD, SCHEMA))) == brute(HARD)
    assert got(line_dedup.line_report(spark.createDataFrame([], SCHEMA))) == []


def test_repeats_of_one_id_are_one_document(spark):
    rows = [(1, LONG), (1, LONG), (1, LONG), (2, LONG)]
    assert got(line_dedup.line_report(spark.createDataFrame(rows, SCHEMA))) == brute(rows) and all(r[2] == 0 for r in brute(rows))


def test_long_text_and_common_line(spark):
    rows = [(k, f"{LONG}\nown line of document number {k}") for k in range(600)] + [(9999, "\n".join(f"line {k % 700} of a very long document" for k in range(20_000)))]
    rows += [(10_000 + k, "\n".join(f"line {j} of a very long document" for j in range(0, 700, 2))) for k in range(3)]
    assert got(line_dedup.line_report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_columns_stay(spark):
    rows = [(k, f"{LONG}\nrest", "x", k, 99) for k in range(4)] + [(9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _at long, n_chars long")
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["_text"], r["_at"], r["n_chars"]) for r in out.collect()} == {(k, "rest", "x", k, 4) for k in range(3)} | {(3, f"{LONG}\nrest", "x", 3, 99), (9, None, None, None, None)}


def test_query(spark, sf_dir):
    from statloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")).collect()
    want = {(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute([tuple(r) for r in docs])}
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in QUERIES["op13_line_dedup"](spark, sf_dir).collect()} == want
