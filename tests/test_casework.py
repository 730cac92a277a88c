"""Casework, badges, ranks, notes, publishing, exports and the alert stream on small rows, against plain Python."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import alerts, anomaly, audit, badges, casework, graph, ingest, ranking, rulebook, scope, scoring, similarity, snapshots
from ledgerlight.plans import build, corpus
from ledgerlight.plans.reading import QUERIES
from ledgerlight.sources import tables
from ledgerlight.streaming.alerts import alert_stream

SF = "/root/testdata/sf0.001"


def test_ranks_of_spread_groups(spark):
    random = np.random.default_rng(2)
    rows = [(i, f"g{i % 3}" if i % 7 else None, float(random.integers(0, 40)) if i % 11 else None) for i in range(900)] + [(1000, "alone", 5.0)]
    table = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r["id"]: (r["_rank"], r["_upto"], r["_n"]) for r in ranking.spread_ranks(table, "v", ["id"], ("g",), ranges=5).collect()}
    for group in {g for _, g, _ in rows}:
        mine = sorted((v, i) for i, g, v in rows if g == group and v is not None)
        for place, (v, i) in enumerate(mine, 1):
            assert got[i] == (place, sum(w <= v for w, _ in mine), len(mine))
    assert len(got) == sum(v is not None for *_, v in rows)
    assert ranking.spread_ranks(table.limit(0), "v", ["id"]).count() == 0


@pytest.mark.parametrize("kind", ["outlier", "log-normal", "half share one value"])
def test_skewed_values_are_dealt_evenly_and_ranked_exactly(spark, kind):
    random = np.random.default_rng(4)
    values = {"outlier": lambda: [*random.random(3999), 1e12], "log-normal": lambda: random.lognormal(10, 3, 4000), "half share one value": lambda: [7.0] * 2000 + [*(random.random(2000) * 20)]}[kind]()
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(random.permutation(values))], "id long, v double").repartition(6)
    sizes = [r["count"] for r in ranking.dealt_to_ranges(table, "v", ["id"], ranges=10).groupBy("_range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 3 * sum(sizes) / len(sizes)
    got = sorted((r["v"], r["id"], r["_rank"], r["_upto"], r["_n"]) for r in ranking.spread_ranks(table, "v", ["id"], ranges=10).collect())
    order = np.sort([v for v, *_ in got])
    assert [r[2] for r in got] == list(range(1, 4001))
    assert all(upto == np.searchsorted(order, v, side="right") and n == 4000 for v, _, _, upto, n in got)


def test_chains_hash_canonical_json(spark):
    rows = [(0, "c", "A", "2024", "é😀", "state", None, '{"k": "x"}'), (1, "c", "B", "2025", "b", None, "7", None), (0, "d", "A", None, "a", "r", "1", "p")]
    chain = audit.chained(spark.createDataFrame(rows, "id long, case_id string, event string, at string, actor string, actor_role string, actor_id string, payload_json string"))
    got = {(r["case_id"], r["id"]): r for r in chain.collect()}
    prev = {}
    for i, case, *rest in rows:
        body = dict(zip(["event", "at", "actor", "actor_role", "actor_id", "payload_json"], rest, strict=True)) | {"case_id": case, "prev_hash": prev.get(case, audit.GENESIS)}
        prev[case] = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert (got[case, i]["prev_hash"], got[case, i]["row_hash"]) == (body["prev_hash"], prev[case])
    assert audit.broken(chain).count() == 0
    assert audit.broken(chain.where("not (case_id = 'c' and id = 0)")).collect() == [("c", 1)]
    assert [r["sound"] for r in audit.trail(chain.withColumn("event", F.when(F.col("id") == 1, "X").otherwise(F.col("event"))), ["c"]).collect()] == [True, False]


def test_notes_have_bounds(spark):
    officer = scope.Principal(scope.STATE, "S")
    note = lambda text: spark.createDataFrame([("c", "2024", "me", text)], "case_id string, at string, actor string, text string")
    assert casework.notes(note(" seen "), officer).first()["payload_json"] == '{"text":"seen"}'
    for bad in ("  ", None, "x" * 4001):
        with pytest.raises(Exception, match="1 to 4000"):
            casework.notes(note(bad), officer).collect()
    with pytest.raises(PermissionError):
        casework.notes(note("x"), scope.Principal(scope.MEMBER, member=1))
    events = casework.notes(note("seen"), officer).withColumn("text", F.get_json_object("payload_json", "$.text"))
    assert scope.redacted(events, scope.Principal(scope.MEMBER, member=1)).first()["text"] is None and scope.redacted(events, officer).first()["text"] == "seen"


def test_a_finding_says_why_it_has_no_value(spark):
    rows = spark.createDataFrame([("w", 1.0, "published"), ("x", None, "not_applicable")], "work_id string, v double, why string")
    made = badges.finding(rows, "delay_risk", "v", "why", badges.model_version("m", {"b": 1, "a": 2}))
    assert [r["feeds_score"] for r in made.collect()] == [False, False] and badges.model_version("m", {"a": 2, "b": 1}) == made.first()["model_version"]
    with pytest.raises(Exception, match="contradict"):
        badges.finding(rows.withColumn("why", F.lit("published")), "delay_risk", "v", "why", "m").collect()
    with pytest.raises(ValueError):
        badges.finding(rows, "score", "v", "why", "m")
    cases = spark.createDataFrame([("w", 5, 6)], "work_id string, score int, b_v int")
    with pytest.raises(ValueError, match="would change"):
        badges.attach(cases, {"b": rows})
    assert badges.attach(cases.drop("b_v"), {"b": rows}).first() == ("w", 5, 1.0, "published")


def test_badges_leave_the_score_alone(spark):
    cases = corpus.scored_cases(spark, SF).select("case_id", "score", "severity")
    assert QUERIES["badges_attached"](spark, SF).select("case_id", "score", "severity").exceptAll(cases).count() == 0
    fired = badges.fired_counts(corpus.scored_cases(spark, SF))
    flagged = fired.select("work_id", (F.col("n_fired") > 2).alias("flagged"))
    got = anomaly.confirmed(flagged, fired.where("n_fired < 4")).select("flagged", badges.confirms("flagged").alias("c"), "n_fired").distinct().collect()
    assert all(r["c"] == (None if r["n_fired"] is None else r["flagged"] and r["n_fired"] > 0) for r in got)


def test_a_repeated_work_must_cite(spark):
    trace = "array<struct<rule_id string, status string>>"
    cases = spark.createDataFrame([("c", "w", [("duplicate_work", "fired")]), ("d", "x", [("duplicate_work", "passed")])], f"case_id string, work_id string, trace {trace}")
    peers = spark.createDataFrame([("w", "p", 0.9, 2), ("w", "q", 1.0, 1), ("w", "r", 0.8, 3)], "work_id string, peer string, score double, rank int")
    assert scoring.with_citations(cases, peers).collect() == [("c", "w", ["q", "p"], 1.0)]
    with pytest.raises(Exception, match="cites no work"):
        scoring.with_citations(cases, peers.where("work_id = 'z'")).collect()
    parts = similarity.citation_components(spark.createDataFrame([("new road", "a new road")], "a string, b string"), "a", "b").first()["components"]
    assert tuple(parts) == (1.0, 0.889)


def test_similar_peers_against_all_pairs(spark):
    random = np.random.default_rng(6)
    words = ["road", "bridge", "wall", "new", "old", "school"]
    rows = [(f"w{i:03d}", f"b{i % 2}", " ".join(random.choice(words, 2))) for i in range(80)]
    got = {}
    for r in similarity.similar_peers(spark.createDataFrame(rows, "id string, block string, key string"), "block", "id", "key", k=3).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["peer"], r["score"])
    for i, block, text in rows:
        wanted = sorted((-similarity.token_set_ratio(text, t) / 100, j) for j, b, t in rows if b == block and j != i)[:3]
        assert got[i] == {n: (j, -s) for n, (s, j) in enumerate(wanted, 1)}


def test_publishing_replaces_the_file_and_logs_first(tmp_path):
    path, text = tmp_path / "rules.yaml", build.RULES.read_text()
    path.write_text(text)
    rows = []
    row = rulebook.publish(path, rulebook.edited(text, {"stalled_work": {"threshold": 500}}), rows.append)
    assert rows == [row] and rulebook.load(path).version == "v1.1.0" == row["version"] and row["replaces"] == "v1.0.0"
    assert rulebook.digest(path.read_text()) == row["sha256"] and [p.name for p in tmp_path.iterdir()] == ["rules.yaml"]
    with pytest.raises(ValueError, match="no skip reason moon"):
        rulebook.publish(path, text.replace("published_zero:", "moon:"))


def test_caveats_of_rules(spark):
    rule = rulebook.Rule("a", "payment_count", "gt", 1, 5, caveat="look", caveat_when="fired", skip_caveats={"not_published": "none said"})
    rows = spark.createDataFrame([(None, "not_published"), (1, "published"), (2, "published")], "payment_count int, payment_count__why string")
    traced = rows.select(rulebook.trace(rulebook.Rulebook("v", (rule,)))[0].alias("t")).select("t.status", "t.caveat", "t.operator", "t.field").collect()
    assert traced == [("skipped", "none said", "gt", "payment_count"), ("passed", None, "gt", "payment_count"), ("fired", "look", "gt", "payment_count")]


def test_recompute_replays_the_bonus_and_leaves_stored_cases(spark):
    stored = corpus.scored_cases(spark, SF)
    again = snapshots.recompute(stored, corpus.features(spark, SF), build.versions(spark))
    assert audit.diff_cases(casework.headline(stored), casework.headline(again)).count() == 0
    assert audit.diff_traces(scoring.rule_hits(stored), scoring.rule_hits(again)).count() == 0


def test_exports_keep_rows_numbers_and_loose_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffS.No,WORK-ID,State\n1,\"WS/MP1/2024-2025/1\n\",X\n2,,\n".encode())
    (tmp_path / "b.csv").write_text("Work Id,Extra\nWS/MP2/2024-2025/2,e\n")
    rows = tables.read_all(spark, {("works", "one"): str(tmp_path / "a.csv"), ("works", "two"): str(tmp_path / "b.csv")})["works"]
    one = rows.where("_house = 'one'").orderBy("_row_number").collect()
    assert [(r["_row_number"], r["S.No"]) for r in one] == [(1, "1"), (2, "2")] and one[0]["_source_file"] == "a.csv"
    assert tables.resolve(one[0].__fields__, "work id") == "WORK-ID" and tables.resolve(["Amount ( Rs )"], "amount") == "Amount ( Rs )"
    with pytest.raises(KeyError):
        tables.resolve(["a"], "work id")


def test_members_of_two_houses(spark):
    rows = [("A", "ls", "S1", None, 2019, 2024, False, 1), ("A", "ls", "S2", "C", None, None, True, 2), ("B", "rs", "S3", None, None, None, False, 3), ("B", "rs", "S4", None, 2020, 2026, False, 4), ("B", "rs", "S4", None, None, None, False, 5)]
    table = spark.createDataFrame(rows, "name string, house string, state string, constituency string, term_start int, term_end int, is_allocation boolean, seen long")
    assert sorted(ingest.register_members(table).collect()) == [("A", "ls", "S2", "C", 2019, 2024), ("B", "rs", "S4", None, 2020, 2026)]


def test_alert_stream_adds_each_alert_once(spark, tmp_path):
    cases = spark.createDataFrame([("a", "HIGH", False, 90), ("b", "LOW", False, 5), ("c", "HIGH", True, 80), ("a", "HIGH", False, 90)], "case_id string, severity string, is_synthetic boolean, score int")
    cases.write.parquet(str(tmp_path / "in"))
    for run in range(2):
        stream = spark.readStream.schema(cases.schema).parquet(str(tmp_path / "in"))
        alert_stream(stream, str(tmp_path / "alerts"), str(tmp_path / f"log{run}")).awaitTermination(120)
    assert [tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "alerts")).collect()] == [("a", "high_severity", 90)]
    log = spark.createDataFrame([("a", "k", 1, "raise"), ("a", "k", 2, "escalate"), ("a", "k", 3, "acknowledge")], "case_id string, kind string, seq int, action string")
    assert alerts.current_status(log).first()["status"] == "escalated"


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert got == {f"n{i:02d}": "n00" for i in range(41)} | {"x": "x", "y": "x"}


def test_the_build_writes_all_tables_again_and_again(spark, tmp_path):
    first = {n: t.count() for n, t in build.build(spark, SF, str(tmp_path)).items()}
    again = build.build(spark, SF, str(tmp_path))
    assert {n: t.count() for n, t in again.items()} == first and first["cases"] > 0
    assert audit.broken(again["audit_log"]).count() == 0
    log = f"{build.current(spark, str(tmp_path))}/audit_log"
    row = again["audit_log"].withColumn("seq", F.col("id"))
    assert build.append_events(spark, log, row) == 0  # all of it is there
    assert build.append_events(spark, log, row.limit(5).withColumn("event_key", F.concat(F.lit("again:"), "event_key"))) == 5
    whole = build.read(spark, str(tmp_path), "audit_log")
    assert whole.count() == first["audit_log"] + 5 and audit.broken(whole).count() == 0
    rolled = again["rollup_state"]
    from ledgerlight.operators import rollups

    assert not rollups.stale(rolled, again["cases"]) and rollups.stale(rolled, again["cases"].limit(10))


def test_a_build_that_fails_changes_nothing_that_is_read(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    with pytest.raises(ValueError, match="nothing was published"):
        build.read(spark, out, "cases")
    build.build(spark, SF, out)
    before = build.current(spark, out)
    made = build.opening_log
    monkeypatch.setattr(build, "opening_log", lambda cases: made(cases).withColumn("at", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        build.build(spark, SF, out)
    assert build.current(spark, out) == before and build.read(spark, out, "cases").count() > 0
    monkeypatch.undo()
    build.build(spark, SF, out)
    assert build.current(spark, out) != before and build.manifest(spark, out).count() == 2
    assert build.drop_old(spark, out) == 2 and build.read(spark, out, "hits").count() > 0 and build.drop_old(spark, out) == 0
