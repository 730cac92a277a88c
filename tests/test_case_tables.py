"""How cases are built: what is dealt out, and what is not stored twice."""

from pyspark.sql import functions as F

from ledgerlight.operators import features
from ledgerlight.plans import corpus
from ledgerlight.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_cases_are_dealt_out_without_traces_and_measures(spark):
    made = corpus.built(spark, SF, "features")
    plan = corpus.TABLES["cases"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression") :]
    assert "rule_id" not in dealt.split("Join", 1)[0] and "days_since_last_payment__why#" not in dealt.split("Relation", 1)[0]
    assert set(features.MEASURES) == {c.removesuffix("__why") for c in made.columns if c.endswith("__why")} - {"recommended_date", "completion_date", "certified_amt", "asset_image", "allocated_amt"}


def test_measures_of_cases_are_those_of_the_features(spark):
    made, cases = corpus.built(spark, SF, "features"), corpus.built(spark, SF, "cases")
    assert cases.columns[: len(made.columns)] == made.columns
    assert made.count() == cases.count() and made.exceptAll(cases.select(*made.columns)).count() == 0


def test_reading_traces_stores_no_second_table(spark):
    app = spark.sparkContext.applicationId
    corpus.forget(SF)
    QUERIES["alerts_loudest_rule"](spark, SF).count()
    assert {k[2] for k in corpus._BUILT if k[:2] == (app, SF)} & {"hits", "base", "citations"} == set()
    hits = corpus.hits(spark, SF)
    assert hits.count() == corpus.built(spark, SF, "cases").agg(F.sum(F.size("trace"))).first()[0]
