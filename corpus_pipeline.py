"""A corpus pipeline of five stages: quality rules, language, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again as the next one's documents. All but the last return the columns of documents.

A stage begins by deleting the tables that earlier ones wrote on their way, and the documents before its own, as its own
documents are written by then. Null texts, empty tables, repeated rows and further columns are as the operators say:
quality.keep, language.keep, simhash.keep_first, mixing.apply_mix and packing.pack.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import language, mixing, packing, quality, simhash
from statloom.llm.base import drop_earlier, stash, table

TOKENIZER = "word_bpe_49k.json"
#: Documents whose language is less sure than this go, as do those without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    drop_earlier(docs)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells well enough."""
    drop_earlier(docs)
    return language.keep(docs, language.fit(docs), LEAST_LANGUAGE_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    drop_earlier(docs)
    return simhash.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each time that a document, or part of it, is taken."""
    drop_earlier(docs)
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences."""
    drop_earlier(docs)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Forests, linear machines and fingerprints have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs, _ = stash(stage(spark, docs, sf_dir), f"stage{k}")
    return docs


QUERIES = {"pipeline": run}
