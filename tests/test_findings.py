"""Payloads of the findings on small graphs and rows, against plain Python."""

import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import anomaly, badges, graph, similarity


def groups_of(pairs):
    """The sets of nodes that links reach."""
    of = {}
    for a, b in pairs:
        both = of.get(a, {a}) | of.get(b, {b})
        for node in both:
            of[node] = both
    return of


def test_structure_against_plain_python(spark):
    random = np.random.default_rng(11)
    paid = [(f"a{i}", int(v), int(random.integers(0, 4) * 100)) for i in range(25) for v in random.integers(0, 40, random.integers(1, 4))] + [("tied", 901, 500), ("tied", 900, 500), ("none", 902, 0), (None, 1, 5), ("a1", None, 5), ("a1", 3, None)]
    edges = graph.with_share(graph.agency_totals(spark.createDataFrame(paid, "agency string, vendor_id long, paid_amt long")))
    got = {r["agency"]: r for r in graph.structure(edges, 600).collect()}
    sums = defaultdict(int)
    for a, v, p in paid:
        if None not in (a, v, p):
            sums[a, v] += p
    linked, span = groups_of([(("A", a), ("V", v)) for a, v in sums]), defaultdict(set)
    for a, v in sums:
        span[v].add(a)
    for agency in {a for a, _ in sums}:
        own = {v: p for (a, v), p in sums.items() if a == agency}
        total = sum(own.values())
        if not total:
            assert agency not in got
            continue
        r, component = got[agency], linked["A", agency]
        assert (r["vendors"], r["disbursed_total"], r["above_floor"], r["widest_span"]) == (len(own), total, total > 600, max(len(span[v]) for v in own))
        assert r["top_vendor"] == min(own, key=lambda v: (-own[v], v))
        assert (r["component_size"], r["component_agencies"]) == (len(component), sum(k == "A" for k, _ in component))
        assert r["hhi"] == pytest.approx(sum((p / total) ** 2 for p in own.values())) and r["top_share_pct"] == pytest.approx(max(own.values()) / total * 100)
        assert r["shared_exposure_pct"] == pytest.approx(sum(p for v, p in own.items() if len(span[v]) > 1) / total * 100)
    assert got["tied"]["top_vendor"] == 900


def test_a_work_tells_its_vendors_and_one_without_edges_says_so(spark):
    edges = graph.with_share(graph.agency_totals(spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("b", 2, 5)], "agency string, vendor_id long, paid_amt long")))
    works = spark.createDataFrame([("w", "a"), ("x", "a"), ("y", "c"), ("z", None)], "work_id string, agency string")
    paid = spark.createDataFrame([("w", 2), ("w", 1), ("w", 2), ("w", None), ("y", 9)], "work_id string, vendor_id long")
    vendors = spark.createDataFrame([(2, "Two")], "vendor_id long, vendor_name string")
    rows = graph.structure_findings(works, paid, graph.structure(edges, 1), vendors, graph.spans(edges))
    got = {r["work_id"]: r for r in rows.collect()}
    assert [tuple(v) for v in got["w"]["work_vendors"]] == [(1, None, 1), (2, "Two", 2)] and got["w"]["top_vendor_name"] == "Two"
    assert got["x"]["work_vendors"] is None and got["x"]["hhi__why"] == "published"
    assert [tuple(v) for v in got["y"]["work_vendors"]] == [(9, None, None)]
    assert all(got[w]["hhi"] is None and got[w]["hhi__why"] == "not_applicable" for w in "yz")
    made = {r["work_id"]: json.loads(r["payload_json"]) for r in badges.findings({"vendor_concentration_graph": (rows, "hhi", "hhi__why", {"floor": 1})}).collect()}
    assert list(made["w"])[0] == "availability" and made["w"]["work_vendors"][1] == {"vendor_id": 2, "vendor_name": "Two", "agency_span": 2}
    assert made["z"] == {"availability": "not_applicable"}


def test_a_version_moves_with_what_made_the_findings(spark):
    rows = spark.createDataFrame([("w", 2, "f", "published", "c")], "work_id string, works long, first_work string, works__why string, cluster_id string").withColumns({"cited": F.array(F.lit("x")), "best": F.lit(1.0)})
    version = lambda **p: badges.findings({"duplicate_cluster": (rows, "works", "works__why", p)}).first()["model_version"]
    assert version(least=2, works=5) == version(works=5, least=2) != version(least=2, works=6)
    found = badges.findings({"duplicate_cluster": (rows, "works", "works__why", {})}).first()
    assert (found["value"], found["feeds_score"]) == (2.0, False) and json.loads(found["payload_json"])["cited"] == ["x"]


def test_outcomes_of_works_without_a_risk(spark):
    rows = spark.createDataFrame([("completed", 1001), ("completed", 1000), ("past_horizon", None), ("open", None)], "population string, execution_days int")
    assert [r[0] for r in rows.select(badges.delay_outcome(1000.0)).collect()] == ["exceeded", "within_horizon", "already_exceeded", None]


def test_where_no_row_is_complete_each_says_why(spark):
    rows = spark.createDataFrame([("w", "a", None, 1.0), ("x", "a", 2.0, None)], "work_id string, g string, x double, y double")
    got = anomaly.anomaly_badges(rows, ("x", "y"), ("g",)).collect()
    assert {(r["work_id"], r["score__why"], tuple(r["missing_features"])) for r in got} == {("w", "not_published", ("x",)), ("x", "not_published", ("y",))}


def test_citation_ratios_against_every_offset(spark):
    random = np.random.default_rng(5)
    words = ["road", "bridge", "wall", "new", "old", "of", "school", "a"]
    pairs = [tuple(" ".join(random.choice(words, random.integers(0, 5))) for _ in range(2)) for _ in range(120)]
    got = similarity.citation_components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b, 1):
            out.append(row[j - 1] + 1 if x == y else max(row[j], out[-1]))
        return out

    def ratio(a, b):
        return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))

    for r in got:
        a, b = r["a"], r["b"]
        assert r["components"]["sorted"] == pytest.approx(ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) / 100, abs=6e-4)
        short, long = sorted((a, b), key=len)
        if short:
            whole = max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))
            assert r["components"]["partial"] >= whole / 100 - 6e-4 and r["components"]["partial"] <= 1
