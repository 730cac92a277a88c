"""The star-schema tables in the roles of works, payments, members and agencies, and the tables built from them.

Each built table is written once for a session and folder, from tables built before it, and read by all queries after
that. ``built`` makes what is asked for and what it needs, so that a query about vendors doesn't score any case.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import NOT_APPLICABLE, NOT_PUBLISHED, PUBLISHED, case_id, description_key
from ..operators import anomaly, badges, forecast, graph, rollups, scoring
from ..operators.features import DONE, MEASURES, agency_totals, derive, measured
from ..operators.rulebook import Rulebook, checked, load
from ..operators.similarity import best_in_block, exact_clusters, own_peers, peer_lists, similar_texts
from ..sources.tables import materialised, shared_path

#: All days are counted to this one, never to today.
AS_OF = datetime.date(2001, 12, 31)
#: Paid by an agency in all, at or below which a vendor's share of it is not looked at: large enough here to leave some out.
AGENCY_FLOOR = 20_000_000
#: Works that a case on a repeated description cites.
CITED = 2
#: One order of so many is a synthetic work, which rollups, lists and alerts leave out.
SYNTHETIC_EVERY = 997


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rulebook() -> Rulebook:
    from pathlib import Path

    return load(Path(__file__).with_name("synthetic_rules.yaml"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.col("r_name").alias("state"), F.col("n_name").alias("district"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, state, district, agency, allocated_amt: a negative balance is an allocation of zero."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(places(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("member"), "state", "district", F.concat("district", F.lit("/"), "c_mktsegment").alias("agency"), F.bround(F.greatest("c_acctbal", F.lit(0.0)), 0).cast("long").alias("allocated_amt"))


#: By session, folder and name: where a built table is, and its columns.
_BUILT: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def built(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``TABLES``, written to the shared folder by the first query that needs it.

    What was built holds for the session: ``forget`` it where the inputs change. Files that are gone are built anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _BUILT:
        path, schema = _BUILT[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # the folder was removed
            del _BUILT[key]
    rows = TABLES[name](spark, sf_dir)
    path = shared_path(spark, f"corpus-{name}")
    rows.write.option("compression", "zstd").parquet(path)
    _BUILT[key] = path, rows.schema
    return spark.read.schema(rows.schema).parquet(path)


def forget(sf_dir: str) -> None:
    for key in [k for k in _BUILT if k[1] == sf_dir]:
        del _BUILT[key]


def _paid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one reading of lineitem: sums for each order and vendor."""
    rupees = F.bround("l_extendedprice", 0).cast("long")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", rupees.alias("paid"), F.to_date("l_shipdate").alias("on"), "l_returnflag")
    return lines.groupBy(F.col("l_orderkey").alias("order_key"), F.col("l_suppkey").alias("vendor_id")).agg(
        F.sum("paid").alias("paid"), F.count("*").alias("n"), F.min("on").alias("lo"), F.max("on").alias("hi"), F.min("l_partkey").alias("part"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("paid"))).alias("certified_amt")
    )


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work for each order. Its recommendation is the member's order before; its description is the part of its first line."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("on"), "o_orderpriority")
    top = F.max_by("vendor_id", F.when(F.col("vendor_id").isNotNull() & F.col("paid").isNotNull(), F.struct(F.col("paid"), -F.col("vendor_id"))))
    by_order = built(spark, sf_dir, "lines").groupBy("order_key").agg(
        F.min("part").alias("part"), F.sum("certified_amt").alias("certified_amt"), F.sum("paid").alias("paid_amt"), F.sum("n").alias("n_payments"), F.min("lo").alias("first_payment"), F.max("hi").alias("last_payment"), top.alias("top_vendor")
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("description"))
    earlier = W.partitionBy("o_custkey").orderBy("on", "o_orderkey")
    rows = orders.withColumn("recommended_date", F.lag("on").over(earlier)).join(by_order, F.col("o_orderkey") == F.col("order_key"), "left").drop("order_key").join(part, "part", "left")
    rows = rows.join(members(spark, sf_dir), F.col("o_custkey") == F.col("member"))
    year = F.year("on").cast("string")
    fy = F.concat(year, F.lit("-"), (F.year("on") + 1).cast("string"))
    done = F.col("o_orderstatus") == "F"
    image = F.substring("o_orderpriority", 1, 1)
    return rows.select(
        F.concat(F.lit("WS/MP"), F.col("member").cast("string"), F.lit("/"), fy, F.lit("/"), F.col("o_orderkey").cast("string")).alias("work_id"),
        "member", "state", "district", "agency", fy.alias("fy"), "description", F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("category"),
        F.when(done, DONE).when(F.col("o_orderstatus") == "P", "Work partially Completed").otherwise("Sanction").alias("status"),
        F.bround("o_totalprice", 0).cast("long").alias("sanctioned_amt"), F.col("on").alias("sanction_date"),
        "recommended_date", F.when(F.col("recommended_date").isNull(), NOT_PUBLISHED).otherwise(PUBLISHED).alias("recommended_date__why"),
        F.when(done, F.col("last_payment")).alias("completion_date"), F.when(~done, NOT_APPLICABLE).when(F.col("last_payment").isNull(), NOT_PUBLISHED).otherwise(PUBLISHED).alias("completion_date__why"),
        "certified_amt", F.when(F.col("certified_amt").isNull(), NOT_PUBLISHED).otherwise(PUBLISHED).alias("certified_amt__why"),
        F.when(done & (image != "3"), image != "5").alias("asset_image_present"), F.when(done & (image != "3"), PUBLISHED).otherwise(NOT_PUBLISHED).alias("asset_image__why"),
        (F.col("o_orderkey") % SYNTHETIC_EVERY == 1).alias("is_synthetic"), "paid_amt", "n_payments", "first_payment", "last_payment", "top_vendor",
    )


PAYMENT_SUMS = ("paid_amt", "n_payments", "first_payment", "last_payment", "top_vendor")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "works").drop(*PAYMENT_SUMS)


def paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per work with a payment: paid_amt, n_payments, first_payment, last_payment and top_vendor."""
    return built(spark, sf_dir, "works").where("n_payments is not null").select("work_id", *PAYMENT_SUMS)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, agency, vendor_id, paid_amt, payment_date for each line."""
    work = built(spark, sf_dir, "works").select("order_key", "work_id", "agency")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("vendor_id"), F.bround("l_extendedprice", 0).cast("long").alias("paid_amt"), F.to_date("l_shipdate").alias("payment_date"))
    return lines.join(work, F.col("l_orderkey") == F.col("order_key")).select("work_id", "agency", "vendor_id", "paid_amt", "payment_date", F.col("l_linenumber").alias("line"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(agency, vendor_id, vendor_paid, agency_paid) over all works; what is paid is summed before and after the join."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = built(spark, sf_dir, "lines").select("order_key", "vendor_id", F.col("paid").alias("paid_amt"))
    by_member = lines.join(orders, F.col("order_key") == F.col("o_orderkey")).groupBy("o_custkey", "vendor_id").agg(F.sum("paid_amt").alias("paid_amt"))
    return agency_totals(by_member.join(members(spark, sf_dir).select("member", "agency"), F.col("o_custkey") == F.col("member")))


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, allocated_amt, allocated_amt__why, account_sanctioned: to date."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.sum(F.bround("o_totalprice", 0).cast("long")).alias("account_sanctioned"))
    return members(spark, sf_dir).select("member", "allocated_amt", F.lit(PUBLISHED).alias("allocated_amt__why")).join(spent, "member", "left")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "accounts")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, agency and key, the description as it is compared."""
    return built(spark, sf_dir, "works").select("work_id", "agency", description_key("description").alias("key"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = built(spark, sf_dir, "works")
    similar = materialised(best_in_block(work, "agency", "description_key", "work_id", built(spark, sf_dir, "similar").withColumnRenamed("key", "description_key")), "best-ratios")
    return derive(work, None, accounts(spark, sf_dir), AS_OF, similarity=similar, agency_floor=AGENCY_FLOOR, shares=built(spark, sf_dir, "shares"))


def _with_cited(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows of the features with ``_cited``, the works that each is most like: from one list for each text, so no row is shuffled where these are few."""
    lists = built(spark, sf_dir, "peers").select(F.col("agency").alias("_a"), F.col("key").alias("_d"), "_peers")
    rows = rows.join(lists, (F.col("agency") == F.col("_a")) & (F.col("description_key") == F.col("_d")), "left").withColumn("_peers", own_peers("work_id", CITED))
    found = scoring.citation(F.transform("_peers", lambda p: p["peer"]), -F.element_at("_peers", 1)["less"])
    return rows.withColumn("_cited", F.when(F.size("_peers") > 0, found)).drop("_a", "_d", "_peers")


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, work_id, cited, best): what each fired repetition cites, as the stored cases have it."""
    cited = built(spark, sf_dir, "cases").select("case_id", "work_id", F.explode("trace.citation").alias("c")).where("c is not null")
    return cited.select("case_id", "work_id", F.col("c.matched").alias("cited"), F.col("c.score").alias("best"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases under the rulebook, in files that hold few states and districts each.

    Dealt out is only what measures follow from; these and the traces, many times as large, are made after, in the tasks
    that write them.
    """
    book, made = rulebook(), built(spark, sf_dir, "features")
    counts = materialised(scoring.high_peers(scoring.base_scores(made, book)), "high-peers")
    inputs = [c for c in made.columns if c.removesuffix("__why") not in MEASURES]
    rows = _with_cited(spark, sf_dir, made.select(*inputs, F.col("duplicate_similarity").alias("_similar"))).withColumn("_case", case_id("work_id"))
    rows = rows.repartitionByRange("state", "district", "_case").sortWithinPartitions("state", "district", "_case").drop("_case")
    again = measured(rows, AS_OF, AGENCY_FLOOR)
    base = scoring.evidenced(scoring.base_scores(again.select(*made.columns, "_cited"), book))
    return scoring.with_bonus(base, book, counts)


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.structure(graph.with_share(built(spark, sf_dir, "shares")), AGENCY_FLOOR)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each work with its agency's place in the graph of payments and its own vendors."""
    work = built(spark, sf_dir, "works").select("work_id", "agency", "order_key")
    own = built(spark, sf_dir, "lines").select("order_key", "vendor_id").join(work, "order_key").select("work_id", "vendor_id")
    vendors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"))
    return graph.structure_findings(work, own, built(spark, sf_dir, "structure"), vendors, graph.spans(built(spark, sf_dir, "shares")))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each work with its exact cluster and what it cites."""
    work = built(spark, sf_dir, "features").select("work_id", "agency", "description_key")
    rows = badges.cluster_findings(work, exact_clusters(work))
    return rows.join(built(spark, sf_dir, "citations").select("work_id", "cited", "best"), "work_id", "left")


def _outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomaly.anomaly_badges(built(spark, sf_dir, "features").select("work_id", "category", "state", "fy", *anomaly.COLUMNS))
    return anomaly.confirmed(rows, badges.fired_counts(built(spark, sf_dir, "cases")))


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every work's population and days, and for open works the risk of running late and its rank among them."""
    late = forecast.horizon_days(rulebook())
    rows = materialised(forecast.model_rows(built(spark, sf_dir, "features"), late, AS_OF), "forecast-rows")
    scored = materialised(forecast.risks(rows, forecast.fit(rows)), "forecast-risks")
    found = forecast.with_percentile(scored).select("work_id", "population", "elapsed_days", "held_out", "label", F.when(F.col("population") == "open", F.col("risk")).alias("risk"), "risk_percentile")
    took = built(spark, sf_dir, "features").select("work_id", "execution_days")
    return found.join(took, "work_id").withColumns({"outcome": badges.delay_outcome(late), "risk__why": F.when(F.col("risk").isNull(), NOT_APPLICABLE).otherwise(PUBLISHED)}).drop("execution_days")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all four kinds, four rows a work, not stored: what is counted of them needs no payloads. Each kind's version names what its model was made with and over."""
    own = {name: built(spark, sf_dir, name) for name in ("clusters", "outliers", "risks", "graph")}
    works, edges = built(spark, sf_dir, "works").count(), built(spark, sf_dir, "shares").count()
    return badges.findings({
        "duplicate_cluster": (own["clusters"], "works", "works__why", {"least": 2, "works": works}),
        "statistical_outlier": (own["outliers"], "score", "score__why", {"columns": anomaly.COLUMNS, "trees": anomaly.TREES, "sample": anomaly.SAMPLE, "contamination": anomaly.CONTAMINATION, "seed": anomaly.SEED, "works": works}),
        "delay_risk": (own["risks"], "risk", "risk__why", {"numbers": forecast.NUMBERS, "categories": forecast.CATEGORIES, "horizon": forecast.horizon_days(rulebook()), "as_of": str(AS_OF), "works": works}),
        "vendor_concentration_graph": (own["graph"], "hhi", "hhi__why", {"measure": "hhi", "floor": AGENCY_FLOOR, "edges": edges}),
    })


TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lines": _paid_lines,
    "works": _works,
    "shares": _shares,
    "accounts": _accounts,
    "similar": lambda spark, d: similar_texts(described(spark, d), "agency", "work_id", "key"),
    "peers": lambda spark, d: peer_lists(described(spark, d), "agency", "work_id", "key", CITED, best=built(spark, d, "similar")),
    "features": _features,
    "base": lambda spark, d: scoring.base_scores(built(spark, d, "features"), rulebook()),
    "citations": _citations,
    "cases": _cases,
    "hits": lambda spark, d: scoring.rule_hits(built(spark, d, "cases")),
    "structure": _structure,
    "graph": _graph,
    "clusters": _clusters,
    "outliers": _outliers,
    "risks": _risks,
    "findings": findings,
    **{f"rollup_{g}": (lambda spark, d, g=g: rollups.rollup(built(spark, d, "cases"), g)) for g in rollups.GRAINS},
}


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "shares")


def features(spark: SparkSession, sf_dir: str, check: bool = False) -> DataFrame:
    rows = built(spark, sf_dir, "features")
    return checked(rows) if check else rows


def scored_cases(spark: SparkSession, sf_dir: str, book: Rulebook | None = None) -> DataFrame:
    """The stored cases; under another rulebook, the stored features scored anew."""
    return built(spark, sf_dir, "cases") if book is None else scoring.cases(built(spark, sf_dir, "features"), book)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces in long form, read from the stored cases; only a build stores them a second time."""
    return scoring.rule_hits(built(spark, sf_dir, "cases"))
