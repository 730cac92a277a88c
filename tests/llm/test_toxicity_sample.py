"""The classifier's sample of labelled rows: ties, repeats, null ids and empty tables, and a score made anew from the model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import toxicity

SCHEMA = "doc_id long, text string, toxic int"
BAD, GOOD = "you utter vermin get lost vermin", "the river runs past the old mill today"


def rows(ids, n=40):
    return [(ids(i), f"{BAD if i % 2 else GOOD} {i}", i % 2) for i in range(n)]


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: i], ids=["one id", "null ids", "different ids"])
def test_ties_do_not_empty_the_sample(spark, ids):
    table = spark.createDataFrame(rows(ids), SCHEMA)
    model = toxicity.train(table, sample=24)
    again = toxicity.train(table.repartition(5), sample=24)  # the same rows, whose sums may differ in their last digits
    assert model.features and model.features == again.features and np.allclose(model.weights, again.weights, atol=1e-3)
    got = {r["text"]: r["predicted"] for r in toxicity.score(spark.createDataFrame([(1, BAD, 0), (2, GOOD, 0)], SCHEMA), model).collect()}
    assert got == {BAD: 1, GOOD: 0}


def test_repeated_rows_and_one_label(spark):
    same = spark.createDataFrame([(1, BAD, 1)] * 30, SCHEMA)
    scored = toxicity.score(spark.createDataFrame([(1, GOOD, 0), (2, None, 0), (3, "", 0)], SCHEMA), toxicity.train(same, sample=20)).collect()
    assert all(r["score"] > 0.99 for r in scored) and scored[1]["score"] == scored[2]["score"]
    assert all(r["predicted"] == 0 for r in toxicity.score(same, toxicity.train(same.limit(0))).collect())


def test_a_score_is_the_sum_of_its_ngrams_weights(spark):
    model = toxicity.train(spark.createDataFrame(rows(lambda i: i), SCHEMA))
    weight = dict(zip(model.features, model.weights, strict=True))
    texts = [BAD, GOOD, f"{BAD} and {GOOD}", "", "x" * 50_000 + BAD, BAD]
    got = toxicity.score(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA), model).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        there = {int(f) for part in toxicity.ngram_features(text) for f in part}
        margin = model.base + sum(w for f, w in weight.items() if f in there)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-margin)), rel_tol=1e-9, abs_tol=1e-12)
    assert got[0]["score"] == got[5]["score"] and toxicity.score(spark.createDataFrame([], SCHEMA), model).select(F.count("*")).first()[0] == 0
