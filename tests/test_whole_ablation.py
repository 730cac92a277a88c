"""The range of band changes against the plain greedy method, case by case."""

from pyspark.sql import functions as F

from ledgerlight.operators import ablation
from ledgerlight.plans import corpus
from ledgerlight.plans.reading import QUERIES


def plain(cases, field, book, budget):
    capacity, needed = 0, []
    for score, met, trace in cases:
        weights = sorted(t["weight"] for t in trace if t["rule_id"] in field.rules and t["status"] == "skipped" and t["skip_reason"] == field.skip_reason)
        if not met or not weights:
            continue
        if score >= book.high:
            capacity += len(weights)
            continue
        gap = (book.medium if score < book.medium else book.high) - score
        capacity += sum(sum(weights[: n + 1]) < gap for n in range(len(weights)))
        needed += [n for n in range(1, len(weights) + 1) if sum(weights[-n:]) >= gap][:1]
    spent = ceiling = 0
    for n in sorted(needed):
        if spent + n > budget:
            break
        spent, ceiling = spent + n, ceiling + 1
    return (field.key, len(needed), budget, capacity, max(0, budget - capacity), ceiling)


def test_band_range_has_a_floor(spark):
    book, field = corpus.rulebook(), ablation.ATTRIBUTED[0]
    hit = lambda rule, weight, status="skipped", why="not_published": {"rule_id": rule, "weight": weight, "status": status, "skip_reason": why}
    light = [hit("utilisation_shortfall", 22), hit("stalled_work", 16), hit("vendor_concentration", 12)]
    rows = [("a", 0, 0, light), ("b", 49, 0, light), ("c", 74, 0, light), ("d", 90, 0, light), ("e", 30, 0, light[:1]), ("f", 40, 0, [hit("stalled_work", 16, why="not_applicable"), light[2]]), ("g", 49, 3, light), ("h", 35, 0, light)]
    cases = spark.createDataFrame(rows, "work_id string, score int, payment_count int, trace array<struct<rule_id string, weight int, status string, skip_reason string>>")
    for budget in (0, 3, 9, 14, 40):
        attributed = spark.createDataFrame([(field.key, budget), ("asset_image_publication_scope", 99)], "field string, extrapolated_fires long")
        got = tuple(ablation.band_range(cases, attributed, field, book).first())
        assert got == plain([(s, n == 0, t) for _, s, n, t in rows], field, book, budget)
    assert got[4] > 0


def test_band_range_query_covers_each_attributed_field(spark):
    d = "/root/testdata/sf0.001"
    got = {r["field"]: tuple(r) for r in QUERIES["ablation_band_range_by_field"](spark, d).collect()}
    cases = corpus.scored_cases(spark, d).select("score", "trace", *[F.expr(f.condition).alias(f.key) for f in ablation.ATTRIBUTED]).collect()
    assert got.keys() == {f.key for f in ablation.ATTRIBUTED}
    for f in ablation.ATTRIBUTED:
        assert got[f.key] == plain([(r["score"], r[f.key], r["trace"]) for r in cases], f, corpus.rulebook(), got[f.key][2])


def test_fields_cite_measures_that_were_taken(spark):
    measured = QUERIES["gap_measures"](spark, "/root/testdata/sf0.001").first().asDict()
    for f in ablation.CATALOGUE:
        assert set(ablation.corroborating(measured, f)) == set(f.beside)
    assert measured["works_with_payment"] + measured["works_without_payment"] == measured["corpus_works"]
    try:
        ablation.corroborating({}, ablation.ATTRIBUTED[0])
        raise AssertionError("a measure that wasn't taken was cited")
    except KeyError:
        pass
