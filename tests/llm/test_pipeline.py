import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm import language, mixing, packing, quality, simhash
from statloom.llm.base import table


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs = table(spark, sf_dir, "documents")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_each_stage_against_its_operator(spark, sf_dir, steps):
    docs, kept, told, once, mixed, packed = steps
    assert all(s.columns == docs.columns for s in steps[:5])
    verdicts = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    assert ids(kept) == ids(verdicts.where("kept"))
    guesses = language.identify(kept, language.fit(kept))
    assert ids(told) == ids(guesses.where((F.col("lang_pred") != "und") & (F.col("score") >= corpus_pipeline.LEAST_LANGUAGE_SCORE)))
    classes = simhash.near_duplicates(told)
    assert ids(once) == ids(classes.where("doc_id = component_id"))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(once).where("taken > 0").collect()}
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == taken
    tokens = packing.tokenised(mixed, __import__("public_tokenizers").path(corpus_pipeline.TOKENIZER)).agg(F.sum("doc_tokens")).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == tokens
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n.to_numpy()
    assert np.all((fill == packing.LENGTH) | (fill & (fill - 1) == 0))


def test_run_and_labels(spark, sf_dir, steps):
    assert corpus_pipeline.run(spark, sf_dir).count() == steps[-1].count()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    kept = set(ids(steps[1]))
    good = [d for d, q in labels.items() if q == 1]
    assert np.mean([d in kept for d in good]) > 0.85 and np.mean([d in kept for d, q in labels.items() if q == 0]) < 0.2
