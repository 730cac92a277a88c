"""Unit tests of parsing, rules and scores on small literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import text as fn
from ledgerlight.operators import alerts, rulebook, scope, scoring, similarity
from ledgerlight.plans import corpus

D = datetime.date


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression("v").alias("r")).first()["r"]


def test_amounts_keep_zero_and_absence_apart(spark):
    assert one(spark, fn.parsed_amount, "40,79,58,27,851.08") == (40795827851, "published")
    assert one(spark, fn.parsed_amount, "0") == (0, "published_zero")
    for absent in ("", "N/A", "-", None):
        assert one(spark, fn.parsed_amount, absent) == (None, "not_published")
    assert one(spark, fn.parsed_amount, "2.5")[0] == 2 and one(spark, fn.malformed_amount, "twelve")


def test_dates(spark):
    assert one(spark, fn.parsed_date, "05-Mar-2024") == D(2024, 3, 5)
    assert one(spark, fn.parsed_date, "31-31-2024") is None and one(spark, fn.malformed_date, "31-31-2024")
    assert not one(spark, fn.malformed_date, "N/A")


def test_ids(spark):
    assert one(spark, fn.case_id, "WS/MP503/2025-2026/140882") == "NG-622268C00E"
    canon = one(spark, lambda c: fn.work_id_parts(c)["canon"], " ws/mp1\t2/2024-2025/ 77-road")
    assert canon == "WS/MP12/2024-2025/77"
    assert one(spark, lambda c: fn.work_id_parts(c)["canon"], "NA-road") is None


def test_names(spark):
    assert one(spark, fn.member_name, "Dr. Shri Ashok K. Mittal (2022-28) (2022-2028)") == ("ASHOK K MITTAL", 2022, 2028)
    assert one(spark, fn.member_name, "Shri Javed Khan (NaN-NaN)") == ("JAVED KHAN", None, None)
    assert one(spark, fn.district_and_agency, "GHAZIABAD(DISTRICT OFFICE_IDA)") == ("GHAZIABAD", "DISTRICT OFFICE")
    assert one(spark, fn.district_and_agency, "PLAIN OFFICE_5") == (None, "PLAIN OFFICE")
    assert one(spark, fn.description_key, "???") is None


def test_rupees(spark):
    assert one(spark, lambda c: fn.rupees(F.col(c).cast("long")), "1234567") == "Rs 12,34,567"
    assert one(spark, lambda c: fn.rupees(F.col(c).cast("long")), "567") == "Rs 567"
    assert one(spark, lambda c: fn.rupees(F.col(c).cast("long")), None) == "an unpublished amount"


def test_rulebook_faults_are_all_named():
    with pytest.raises(ValueError, match="no operator between.*no feature moon"):
        rulebook.loads("version: v1\nseverity_bands: {}\nrules:\n- {id: a, field: moon, operator: between, threshold: 1, weight: 1}")


def test_rulebook_edits_keep_comments():
    from pathlib import Path

    text = Path(corpus.__file__).with_name("synthetic_rules.yaml").read_text()
    out = rulebook.edited(text, {"stalled_work": {"threshold": 500}}, {"high": 80}, 12)
    assert "# between p5 and p25" in out and rulebook.loads(out).high == 80
    assert rulebook.differences(rulebook.loads(text), rulebook.loads(out))[0][:2] == ("stalled_work", "threshold")
    with pytest.raises(ValueError):
        rulebook.edited(text, {"stalled_work": {"field": 1}})


def test_coverage_rounds_half_to_even(spark):
    book = rulebook.Rulebook("v", (rulebook.Rule("a", "execution_days", "gt", 1, 5), rulebook.Rule("b", "payment_count", "gt", 1, 3)))
    rows = spark.createDataFrame([(1, None, "not_applicable", 2, "published")], "i int, execution_days int, execution_days__why string, payment_count int, payment_count__why string")
    got = rows.select(scoring.coverage_pct(rulebook.trace(book), book).alias("c"), rulebook.trace(book).alias("t")).first()
    assert got["c"] == 38 and [t["status"] for t in got["t"]] == ["skipped", "fired"]


def test_null_without_reason_is_an_error(spark):
    rows = spark.createDataFrame([(None, "published")], "execution_days int, execution_days__why string")
    with pytest.raises(Exception, match="contradict"):
        rulebook.checked(rows).collect()


def test_scope():
    who = scope.Principal(scope.DISTRICT, "S", "D")
    with pytest.raises(PermissionError):
        scope.require_grain(who, "national")
    with pytest.raises(PermissionError):
        scope.require_write(scope.Principal(scope.MEMBER, member=1))
    assert alerts.may_move("open", "escalate", who) == "escalated"
    with pytest.raises(ValueError):
        alerts.may_move("escalated", "acknowledge", who)


def test_ratios():
    assert similarity.token_set_ratio("new road", "new road at market") == 100.0
    assert similarity.indel_ratio("abcd", "abed") == 75.0
    assert similarity.token_sort_ratio("b a", "a b") == 100.0


def test_bonus_needs_three_other_cases(spark):
    rows = spark.createDataFrame([("x", "f", f"w{i}", 80, "HIGH") for i in range(4)] + [(None, "f", "n", 10, "LOW")], "agency string, fy string, work_id string, subtotal int, base_severity string")
    got = {r["work_id"]: (r["peer_count"], r["bonus"], r["score"]) for r in scoring.with_bonus(rows, corpus.rulebook()).collect()}
    assert got["w0"] == (3, 10, 90) and got["n"] == (0, 0, 10)


def test_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
