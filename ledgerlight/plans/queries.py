"""The registered queries: one for each operator or group of operators, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import ablation, alerts, anomaly, audit, features, forecast, graph, ingest, memos, rollups, rulebook, scope, scoring, similarity
from ..sources.tables import materialised
from . import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ITEM = ["case_id", "work_id", "state", "district", "agency", "score", "raw_score", "severity", "coverage_pct"]
MINISTRY = scope.Principal(scope.MINISTRY)
DISTRICT_OFFICER = scope.Principal(scope.DISTRICT, "EUROPE", "NATION_13")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(c: str, places: int = 6) -> Column:
    return F.round(F.col(c).cast("double"), places).alias(c)


@query
def case_ranking_topn(spark, d):
    return scope.ranked(corpus.scored_cases(spark, d), 100).select(*ITEM)


@query
def feature_dictionary(spark, d):
    rows = corpus.features(spark, d, check=True)
    rounded = ["variance_sanction_to_disbursement", "variance_disbursement_to_certification", "vendor_share_in_agency_pct", "mp_utilisation_pct"]
    plain = ["sanction_lag_days", "sanction_to_first_payment_days", "first_payment_to_completion_days", "execution_days", "days_since_last_payment", "asset_image_absent", "duplicate_similarity"]
    return rows.select("work_id", *map(six, rounded), *plain, *[f"{c}__why" for c in rounded + plain], "completed_without_payment", "same_desc_same_agency_count", "payment_count")


@query
def rule_trace_long(spark, d):
    return corpus.hits(spark, d).select("case_id", "rule_id", "status", "contribution", "skip_reason")


@query
def rule_firing_counts(spark, d):
    return scoring.firing_counts(corpus.hits(spark, d))


@query
def coverage_by_severity(spark, d):
    c = corpus.scored_cases(spark, d)
    return c.groupBy("severity").agg(F.count("*").alias("cases"), F.round(F.avg("coverage_pct"), 6).alias("mean_coverage"), F.min("coverage_pct").alias("least"), F.max("coverage_pct").alias("most"))


@query
def corroboration_peers(spark, d):
    return corpus.scored_cases(spark, d).where("peer_count > 0").select("case_id", "agency", "fy", "peer_count", "bonus", "score", "severity")


@query
def corroboration_evidence(spark, d):
    rows = scoring.peer_evidence(corpus.scored_cases(spark, d))
    return rows.select("case_id", "peer_count", F.array_join("matched", ",").alias("matched"))


@query
def gap_hop_slowest_lag(spark, d):
    return corpus.scored_cases(spark, d).select("work_id", "gap_hop", "slowest_lag")


@query
def ladders(spark, d):
    rows = corpus.features(spark, d)
    fund, lifecycle = features.fund_ladder(-60.0), features.lifecycle_ladder()
    text = lambda rungs, part: F.array_join(F.transform(rungs, lambda r: F.coalesce(r[part].cast("string"), F.lit("-"))), ",")
    missing = memos.unavailable(["execution_days", "sanction_lag_days", "asset_image_absent"])
    return rows.select(
        "work_id", text(fund, "amount").alias("amounts"), text(fund, "state").alias("states"), text(fund, "why").alias("hop_reasons"), text(lifecycle, "on").alias("dates"), text(lifecycle, "lag_days").alias("lags"), text(lifecycle, "why").alias("lag_reasons"),
        F.array_join(F.transform(missing, lambda m: F.concat_ws(":", m["field"], m["why"])), ",").alias("unavailable"),
    )


@query
def case_memos(spark, d):
    return corpus.scored_cases(spark, d).select("case_id", memos.memo(corpus.rulebook()).alias("memo"))


@query
def unavailable_details(spark, d):
    """Why each figure of each case that is blank is so, in words."""
    rows = corpus.scored_cases(spark, d).select("case_id", F.explode(memos.unavailable([*rulebook.NUMERIC, *rulebook.TRUTHS])).alias("u"))
    return rows.select("case_id", "u.*")


@query
def trace_citations(spark, d):
    """What the stored traces cite, a row for each work cited."""
    rows = corpus.hits(spark, d).where("citation is not null")
    return rows.select("case_id", "rule_id", F.posexplode("citation.matched").alias("at", "cited"), F.round("citation.score", 6).alias("best"))


@query
def fund_accounts_two_grain(spark, d):
    rows = rollups.fund_accounts(corpus.works(spark, d), corpus.paid(spark, d), corpus.members(spark, d))
    return rows.withColumn("utilisation_pct", F.round("utilisation_pct", 6))


def _rollup(grain: str) -> Query:
    def run(spark, d):
        return corpus.built(spark, d, f"rollup_{grain}").withColumn("mean_coverage", F.round("mean_coverage", 6))

    run.__name__ = f"rollup_{grain}"
    return run


for _grain in rollups.GRAINS:
    query(_rollup(_grain))


@query
def rollup_retotal(spark, d):
    return rollups.totalled(corpus.built(spark, d, "rollup_state")).withColumn("mean_coverage", F.round("mean_coverage", 4))


@query
def national_top_states(spark, d):
    return rollups.top_states(corpus.built(spark, d, "rollup_state")).select("state", "cases", "high", "sanctioned")


@query
def district_queue(spark, d):
    return scope.ranked(scope.scoped(corpus.scored_cases(spark, d), DISTRICT_OFFICER), 25).select(*ITEM)


@query
def member_worst_cases(spark, d):
    return scope.ranked(scope.scoped(corpus.scored_cases(spark, d), scope.Principal(scope.MEMBER, member=7)), 5).select(*ITEM)


@query
def member_utilisation_percentile(spark, d):
    ratio = F.col("account_sanctioned") / F.nullif(F.col("allocated_amt"), F.lit(0)) * 100
    rows = corpus.accounts(spark, d).where("account_sanctioned is not null").select("member", ratio.alias("utilisation_pct"))
    return rollups.member_percentile(rows).select("member", six("utilisation_pct"), six("percentile", 1))


@query
def case_search_paged(spark, d):
    c = corpus.scored_cases(spark, d).where("severity <> 'LOW'")
    return scope.ranked(scope.listed(c, MINISTRY, term=("plate", "building")), 20, 10).select(*ITEM)


def _scoped(name: str, who: scope.Principal) -> None:
    def run(spark, d):
        rows = scope.scoped(corpus.scored_cases(spark, d), who)
        return rows.select(*ITEM) if who.member is not None else rows.groupBy("severity").agg(F.count("*").alias("cases"))

    QUERIES[name] = run


_scoped("scoped_state", scope.Principal(scope.STATE, "EUROPE"))
_scoped("scoped_district", DISTRICT_OFFICER)
_scoped("scoped_member", scope.Principal(scope.MEMBER, member=1))


@query
def ambiguous_names(spark, d):
    rows = corpus.table(spark, d, "customer").join(F.broadcast(corpus.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return scope.ambiguous_names(rows.select(F.col("c_mktsegment").alias("district"), F.col("n_name").alias("state")))


@query
def busiest_scopes(spark, d):
    c = corpus.scored_cases(spark, d).select("state", "district", "agency", "severity")
    parts = [scope.busiest(c, k).select(F.lit(k).alias("scope"), F.col(k).alias("name"), "cases", "high") for k in ("state", "district", "agency")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def corpus_measures(spark, d):
    c = corpus.scored_cases(spark, d)
    return c.agg(F.count("*").alias("cases"), F.countDistinct("agency").alias("agencies"), F.countDistinct("member").alias("members"), F.sum("sanctioned_amt").alias("sanctioned"), F.count_if(F.col("bonus") > 0).alias("with_bonus"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.count_if(F.col("payment_count") == 0).alias("unpaid"), F.round(F.avg("coverage_pct"), 6).alias("mean_coverage"))


@query
def exact_clusters(spark, d):
    return similarity.exact_clusters(corpus.works(spark, d).withColumn("description_key", fn.description_key("description")))


@query
def cluster_stats_topk(spark, d):
    rows = exact_clusters(spark, d).where("works >= 3").select("agency", "description_key", "works")
    return rows.orderBy(F.desc("works"), "agency", "description_key").limit(20)


@query
def vendor_share(spark, d):
    rows = graph.with_share(corpus.shares(spark, d))
    return rows.select("agency", "vendor_id", "vendor_paid", "agency_paid", F.round(F.col("share") * 100, 6).alias("share_pct"))


@query
def vendor_span(spark, d):
    return graph.spans(corpus.shares(spark, d))


@query
def agency_hhi(spark, d):
    rows = graph.concentration(graph.with_share(corpus.shares(spark, d)))
    return rows.select("agency", "vendors", *[six(c, 9) for c in ("hhi", "top_share", "shared_exposure")])


@query
def concentrated_pairs(spark, d):
    return graph.concentrated_pairs(graph.with_share(corpus.shares(spark, d)), 2.5, features.AGENCY_FLOOR)


@query
def graph_components(spark, d):
    big = graph.with_share(corpus.shares(spark, d)).where("share * 100 > 2.0")
    return graph.components(big.select(F.concat(F.lit("A"), "agency").alias("a"), F.concat(F.lit("V"), F.col("vendor_id").cast("string")).alias("b")))


@query
def graph_findings(spark, d):
    return graph.graph_findings(corpus.works(spark, d).select("work_id", "agency"), graph.with_share(corpus.shares(spark, d))).withColumn("hhi", F.round("hhi", 9))


def dirty_exports(spark: SparkSession, d: str) -> DataFrame:
    """Events made to look like a published export: ids, amounts and dates as text, some of them broken."""
    e = corpus.table(spark, d, "events")
    i, s = F.col("event_id"), lambda c: c.cast("string")
    work = F.when(i % 11 == 0, F.concat(F.lit(" ws/mp"), s(F.col("user_id")), F.lit("/2024-2025 /"), s(i), F.lit("-x"))).when(i % 13 == 0, F.concat(F.lit("NA-"), "event_type")).otherwise(F.concat(F.lit("WS/MP"), s(F.col("user_id")), F.lit("/2024-2025/"), s(i - i % 7)))
    amount = F.when(i % 17 == 0, "").when(i % 19 == 0, "twelve").when(i % 23 == 0, "0").otherwise(F.concat(s(F.floor(F.col("value") * 100).cast("long")), F.lit(".5")))
    on = F.when(i % 29 == 0, "N/A").when(i % 31 == 0, "31-31-2024").otherwise(F.date_format("ts", "dd-MMM-yyyy"))
    return e.select("event_id", "event_type", work.alias("work"), amount.alias("amount"), on.alias("on_text"))


def judged_exports(spark: SparkSession, d: str) -> DataFrame:
    rows = dirty_exports(spark, d).withColumns({"canon": fn.work_id_parts("work")["canon"], "amt": fn.parsed_amount("amount"), "on_date": fn.parsed_date("on_text")})
    fault = ingest.first_reason([(F.col("canon").isNull(), "work_id_unparseable"), (fn.malformed_amount("amount"), "unparseable_amount"), (F.col("amt.value").isNull(), "null_required_field"), (fn.malformed_date("on_text"), "unparseable_date")])
    return ingest.judged(rows, "canon", "event_id", fault)


@query
def ingest_rejects(spark, d):
    return judged_exports(spark, d).where("reason is not null").select(F.col("event_id").alias("row_number"), F.col("canon").alias("work_id"), "reason")


@query
def reject_ledger(spark, d):
    return ingest.reject_ledger(judged_exports(spark, d), "event_type", "event_id", ["work", "amount", "on_text"])


@query
def ingest_reconcile(spark, d):
    return ingest.reconciled(judged_exports(spark, d), "event_type")


@query
def rejects_by_reason(spark, d):
    return judged_exports(spark, d).where("reason is not null").groupBy("reason").agg(F.count("*").alias("rows"))


@query
def duplicate_ids(spark, d):
    return judged_exports(spark, d).where("reason = 'duplicate_work_id'").groupBy(F.col("canon").alias("work_id")).agg(F.count("*").alias("rows"))


@query
def parsed_amounts_dates(spark, d):
    rows = dirty_exports(spark, d).withColumn("amt", fn.parsed_amount("amount"))
    return rows.select("event_id", fn.work_id_parts("work")["canon"].alias("work_id"), F.col("amt.value").alias("amount"), F.col("amt.why").alias("amount__why"), fn.parsed_date("on_text").alias("on_date"))


@query
def join_yields(spark, d):
    orders, lines = corpus.table(spark, d, "orders"), corpus.table(spark, d, "lineitem")
    paid = orders.select("o_orderkey").join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return orders.agg(F.countDistinct("o_orderkey").alias("works")).crossJoin(lines.agg(F.countDistinct("l_orderkey").alias("paid_works"))).crossJoin(paid.agg(F.countDistinct("o_orderkey").alias("joined")))


@query
def vocabulary_drift(spark, d):
    return ingest.drift(corpus.table(spark, d, "events"), "event_type", ["click", "view"])


@query
def first_source_merge(spark, d):
    e = corpus.table(spark, d, "events")
    first = e.where("event_type = 'click'").selectExpr("event_id % 500 as id", "1 as precedence", "event_id", "case when event_id % 3 = 0 then event_type end as status", "case when event_id % 4 = 0 then value end as amount")
    second = e.where("event_type <> 'click'").selectExpr("event_id % 500 as id", "2 as precedence", "event_id", "event_type as status", "case when event_id % 2 = 0 then value end as amount")
    rows = ingest.first_by_precedence(first.unionByName(second), "id", ["precedence", "event_id"], ["status", "amount"])
    return rows.withColumn("amount", F.round("amount", 6))


@query
def majority_vote(spark, d):
    return ingest.majority(corpus.table(spark, d, "events"), "user_id", "event_type", "event_id")


@query
def clean_text_keys(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", fn.description_key("text").alias("description_key"))


@query
def member_names(spark, d):
    raw = F.concat(F.lit("Dr. Shri "), "c_name", F.lit(" (2022-28) (2022-2028)"))
    return corpus.table(spark, d, "customer").select(F.col("c_custkey").alias("member"), fn.member_name(raw).alias("m")).select("member", "m.*")


@query
def case_ids(spark, d):
    w = corpus.works(spark, d)
    return w.select("work_id", fn.case_id("work_id").alias("case_id"), fn.work_id_parts("work_id")["mp_code"].alias("mp_code"), "fy", fn.fy_start_year("fy").alias("fy_start"))


@query
def alerts_new(spark, d):
    c = corpus.scored_cases(spark, d)
    raised = c.where("severity = 'HIGH' and order_key % 5 = 0").select("case_id", F.lit("high_severity").alias("kind"))
    return alerts.new_alerts(c, raised).select("case_id", "kind", "state", "district", "score")


@query
def alerts_loudest_rule(spark, d):
    return scoring.loudest_rule(corpus.hits(spark, d))


@query
def alerts_inbox_order(spark, d):
    c = corpus.scored_cases(spark, d).where("severity = 'HIGH'")
    raised = c.select("case_id", F.element_at(F.array(*map(F.lit, alerts.STATUSES)), (F.col("order_key") % 4 + 1).cast("int")).alias("status"))
    return alerts.inbox(raised, c).select("case_id", "status", "score").limit(50)


@query
def alerts_folded(spark, d):
    """The status of each alert after its events in their order; here a user's events are the actions on one alert."""
    e = corpus.table(spark, d, "events")
    action = F.element_at(F.array(*map(F.lit, ("raise", "acknowledge", "raise", "escalate", "acknowledge", "close", "raise"))), (F.col("event_id") % 7 + 1).cast("int"))
    rows = e.select(F.col("user_id").cast("string").alias("case_id"), F.lit("high_severity").alias("kind"), F.col("event_id").alias("seq"), action.alias("action"))
    return alerts.current_status(rows)


@query
def alerts_orphans(spark, d):
    c = corpus.scored_cases(spark, d).where("severity = 'HIGH'")
    return alerts.orphans(c.select("case_id"), c.where("order_key % 9 <> 0")).select("case_id")


def _attributed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = corpus.scored_cases(spark, d)
    rows = c.select("work_id", *ablation.READ, F.explode("trace").alias("t")).select("work_id", *ablation.READ, "t.*")
    return c, ablation.attribute(rows)


@query
def ablation_attribution(spark, d):
    return _attributed(spark, d)[1].drop("weight").withColumn("firing_rate", F.round("firing_rate", 9))


@query
def ablation_rank(spark, d):
    return ablation.rank_fields(_attributed(spark, d)[1])


@query
def ablation_band_range(spark, d):
    c, found = _attributed(spark, d)
    budget = found.where("field = 'expenditure_linkage'").agg(F.sum("extrapolated_fires")).first()[0]
    return ablation.band_ceiling(ablation.band_capacity(c, ablation.ATTRIBUTED[0], corpus.rulebook()), int(budget or 0))


@query
def ablation_band_range_by_field(spark, d):
    """Both ends of the range, for each field that rules are attributed to."""
    c, found = _attributed(spark, d)
    found = materialised(found, "ablation-fields")
    parts = [ablation.band_range(c, found, f, corpus.rulebook()) for f in ablation.ATTRIBUTED]
    return reduce(DataFrame.unionByName, parts)


@query
def trace_diff(spark, d):
    from dataclasses import replace

    book = corpus.rulebook()
    other = replace(book, rules=tuple(replace(r, threshold=400) if r.id == "stalled_work" else r for r in book.rules))
    return audit.diff_within(corpus.scored_cases(spark, d).withColumn("again", rulebook.trace(other)), "trace", "again", ("status",))


@query
def audit_openings(spark, d):
    return audit.opening_events(corpus.scored_cases(spark, d)).drop("seq")


@query
def audit_chain_verify(spark, d):
    e = corpus.table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("event"), F.col("ts").cast("string").alias("at"), F.lit("officer").alias("actor"), F.lit("state").alias("actor_role"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("é"), F.col("user_id").cast("string"))).alias("actor_id"), F.col("props").alias("payload_json"))
    chain = materialised(audit.chained(rows), "audit-chain")
    touched = chain.withColumn("actor", F.when(F.col("id") % 1999 == 5, "someone").otherwise(F.col("actor")))
    return audit.broken(touched)


@query
def forecast_populations(spark, d):
    rows = corpus.works(spark, d).withColumn("population", forecast.population(forecast.horizon_days(corpus.rulebook()), corpus.AS_OF))
    return rows.groupBy("population").agg(F.count("*").alias("works"), F.sum("sanctioned_amt").alias("sanctioned"))


@query
def risk_percentile(spark, d):
    return forecast.percentile_in(corpus.works(spark, d).select("work_id", "fy", "sanctioned_amt"), "sanctioned_amt", ["fy"]).select("work_id", six("percentile"))


@query
def peer_groups(spark, d):
    rows = corpus.works(spark, d).groupBy("category", "state", "fy").agg(F.count("*").alias("size"))
    return rows.withColumn("comparable", F.col("size") >= anomaly.PEER_FLOOR)


def similar_peers(spark: SparkSession, d: str, k: int) -> DataFrame:
    return similarity.similar_peers(corpus.described(spark, d), "agency", "work_id", "key", k, best=corpus.built(spark, d, "similar"))


@query
def similar_works_topk(spark, d):
    return similar_peers(spark, d, 8)


@query
def tfidf_cosine(spark, d):
    rows = corpus.described(spark, d)
    pairs = materialised(similar_peers(spark, d, 1).select(F.col("work_id").alias("a"), F.col("peer").alias("b")), "tfidf-pairs")
    return similarity.tfidf_cosine(rows, "work_id", "key", pairs)


@query
def canonical_agencies(spark, d):
    p = corpus.table(spark, d, "part").select(F.col("p_brand").alias("district"), F.upper("p_name").alias("name"), "p_partkey")
    return similarity.canonical_names(p, "district", "name", "p_partkey")


@query
def anomaly_badges(spark, d):
    return corpus.built(spark, d, "outliers").drop("n_fired", "confirms")


@query
def delay_risk_gbt(spark, d):
    """Every work's population and days, and for open works the risk of running late and its rank among them."""
    return corpus.built(spark, d, "risks").drop("outcome", "risk__why")
