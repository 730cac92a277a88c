"""Memos, the words on blank figures, and citations in stored traces."""

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import memos, scoring
from ledgerlight.operators.rulebook import NUMERIC, TRUTHS, loads
from ledgerlight.plans import corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cases(spark):
    return corpus.scored_cases(spark, SF)


def said(rows, book=None):
    return rows.select("case_id", memos.memo(book or corpus.rulebook()).alias("memo")).collect()


def test_every_skipped_rule_is_named_with_its_reason_and_no_memo_calls_a_wrong(cases):
    trace = {r["case_id"]: r for r in cases.select("case_id", "trace", "bonus", "score", "severity", "coverage_pct").collect()}
    for case_id, text in said(cases):
        row = trace[case_id]
        for t in row["trace"]:
            assert (f"{t['rule_id'].replace('_', ' ')} - " in text) == (t["status"] == "skipped")
        lost = sum(t["weight"] for t in row["trace"] if t["status"] == "skipped")
        assert (f"That is {lost} of {corpus.rulebook().weight_total} points" in text) == (lost > 0)
        assert f"Score {row['score']} of 100, {row['severity']}, under" in text and text.endswith(memos.NOTICE)
        assert ("adds" in text) == (row["bonus"] > 0)
        assert not any(w in text.lower() for w in ("fraud", "corrupt", "guilty", "suspicious"))


def test_a_picture_that_was_not_looked_for_is_not_called_missing(cases):
    for _, text in said(cases.where("asset_image_absent is null")):
        assert "no picture of the asset was filed" not in text and "asset evidence missing - only the export" in text


def test_nulls_are_said_and_make_no_memo_null(cases):
    blank = ["description", "agency", "sanctioned_amt", "sanction_date", "recommended_date", "fy", "is_synthetic", "last_payment", "paid_amt"]
    rows = cases.limit(20)
    for c in blank:
        rows = rows.withColumn(c, F.lit(None).cast(cases.schema[c].dataType))
    for _, text in said(rows):
        assert "(no published description) was sanctioned an unpublished amount on an unpublished date" in text and text.endswith(memos.NOTICE)
    long = cases.limit(1).withColumn("description", F.repeat(F.lit("road "), 20_000))
    assert len(said(long)[0]["memo"]) > 100_000
    assert said(cases.limit(0)) == []


def test_a_control_row_says_so_first(cases):
    for _, text in said(cases.where("is_synthetic")):
        assert text.startswith(memos.CONTROL)
    assert not any(memos.CONTROL in text for _, text in said(cases.where("not is_synthetic")))


def test_a_rule_without_words_of_its_own_is_quoted(spark, cases):
    book = loads("version: v2\nseverity_bands: {high: 75, medium: 50}\nrules:\n- {id: many_payments, field: payment_count, operator: gte, threshold: 1, weight: 5, label: Many Payments}\n")
    rows = scoring.cases(corpus.features(spark, SF), book).where("payment_count = 3").limit(3)
    assert all("many payments (3.00 against 1)" in text for _, text in said(rows, book))


def test_an_unknown_reason_is_named_as_such(spark):
    rule = corpus.rulebook().rules[0]
    rows = spark.createDataFrame([("published_zero",), ("lost",), (None,)], "why string")
    got = [r[0] for r in rows.select(memos.unread(rule, F.col("why"))).collect()]
    assert got[0].endswith(memos.REASONS["published_zero"]) and got[1] == got[2] and got[1].endswith("the reading was not to be had")


def test_each_blank_figure_has_words(cases):
    rows = cases.select("case_id", *[F.col(f"{f}__why") for f in (*NUMERIC, *TRUTHS)], memos.unavailable([*NUMERIC, *TRUTHS]).alias("u")).collect()
    for r in rows:
        wanted = {f: r[f"{f}__why"] for f in (*NUMERIC, *TRUTHS) if r[f"{f}__why"] != "published"}
        assert {u["field"]: u["why"] for u in r["u"]} == wanted
        assert all(u["detail"] == memos.DETAILS.get((u["field"], u["why"]), memos.DETAIL_REASONS[u["why"]]) for u in r["u"])


def test_traces_cite_where_the_rule_fired_and_nowhere_else(spark, cases):
    hits = corpus.hits(spark, SF)
    cites = (F.col("rule_id") == "duplicate_work") & (F.col("status") == "fired")
    assert hits.where(cites != F.col("citation").isNotNull()).count() == 0 and hits.where(cites).count() > 0
    own = hits.where(cites).where(F.array_contains("citation.matched", F.col("work_id")) | (F.size("citation.matched") > corpus.CITED) | ~F.col("citation.score").between(0.85, 1))
    assert own.count() == 0
    for case_id, text in said(cases.where(F.exists("trace", lambda t: t["citation"].isNotNull()))):
        assert "; compare WS/" in text


def test_a_case_without_evidence_is_not_stored(spark):
    base, found = corpus.built(spark, SF, "base"), corpus.built(spark, SF, "citations")
    one = found.select("work_id").first()[0]
    with pytest.raises(Exception, match="cites no work"):
        scoring.with_evidence(base, found.where(F.col("work_id") != one)).write.format("noop").mode("overwrite").save()
    assert scoring.with_evidence(base, found).count() == base.count()
