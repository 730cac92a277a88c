"""Rollups of cases at four grains, and their use: totals, rankings, percentiles and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import spread_ranks

GRAINS = {"state": ["state"], "district": ["state", "district"], "agency": ["state", "district", "agency"], "member": ["member"]}
#: What else each grain counts: distinct values of these.
DISTINCT = {"state": "district", "district": "agency", "agency": "member", "member": "district"}


def measures() -> list:
    c = F.col
    return [
        F.count("*").alias("cases"), F.count_if(c("severity") == "HIGH").alias("high"), F.count_if(c("severity") == "MEDIUM").alias("medium"), F.count_if(c("severity") == "LOW").alias("low"),
        F.count_if(c("bonus") > 0).alias("with_bonus"), F.count_if(c("paid_amt").isNull()).alias("unpaid"), F.sum("sanctioned_amt").alias("sanctioned"),
        F.sum(F.coalesce("paid_amt", F.lit(0))).alias("paid"), (F.sum("coverage_pct") / F.count("*")).alias("mean_coverage"), F.max("raw_score").alias("worst"),
    ]


def rollup(cases: DataFrame, grain: str) -> DataFrame:
    """One row for each value of the grain; synthetic cases are left out, and null agencies at the agency's grain."""
    rows = cases.where("not is_synthetic")
    if grain == "agency":
        rows = rows.where("agency is not null")
    return rows.groupBy(*GRAINS[grain]).agg(*measures(), F.countDistinct(DISTINCT[grain]).alias(f"n_{DISTINCT[grain]}"))


def totalled(rolled: DataFrame) -> DataFrame:
    """One row over rollup rows: sums, the mean coverage weighted by cases, the worst score."""
    return rolled.agg(F.sum("cases").alias("cases"), F.sum("high").alias("high"), F.sum("medium").alias("medium"), F.sum("low").alias("low"), F.sum("sanctioned").alias("sanctioned"), F.sum("paid").alias("paid"), F.try_divide(F.sum(F.col("mean_coverage") * F.col("cases")), F.sum("cases")).alias("mean_coverage"), F.max("worst").alias("worst"))


def top_states(rolled: DataFrame, n: int = 10) -> DataFrame:
    return rolled.orderBy(F.desc("high"), F.desc("sanctioned"), "state").limit(n)


def in_rank(rolled: DataFrame, name: str) -> DataFrame:
    """Districts or agencies with their places: most HIGH cases, then most money, then by name."""
    return rolled.withColumn("place", F.row_number().over(W.orderBy(F.desc("high"), F.desc("sanctioned"), *GRAINS[name])))  # a row for each office


def preview(rolled: DataFrame, n: int, *names: str) -> DataFrame:
    """The n rows with the most HIGH and then most cases, the last of them first, as a bar chart lists them."""
    top = rolled.orderBy(F.desc("high"), F.desc("cases"), *names).limit(n)
    return top.orderBy("high", "cases", *[F.desc(c) for c in names])


def tally(rows: DataFrame, column: str, kinds: tuple[str, ...]) -> DataFrame:
    """(column, rows) for each of the kinds, those without a row too."""
    counted = F.array(*[F.struct(F.lit(k).alias(column), F.count_if(F.col(column) == k).alias("rows")) for k in kinds])
    return rows.agg(counted.alias("t")).select(F.inline("t"))


def shares_of_total(rolled: DataFrame, within: list[str], value: str) -> DataFrame:
    """Adds share (of the total within, in percent) and scale (of the largest there) to a rollup's rows."""
    whole = W.partitionBy(*within)
    return rolled.withColumn("share_pct", F.try_divide(F.col(value), F.sum(value).over(whole)) * 100).withColumn("scale", F.try_divide(F.col(value), F.max(value).over(whole)))


def stale(rolled: DataFrame, cases: DataFrame) -> bool:
    """Whether a rollup no longer holds its cases: counts or money differ."""
    a = rolled.agg(F.coalesce(F.sum("cases"), F.lit(0)), F.coalesce(F.sum("sanctioned"), F.lit(0))).first()
    b = cases.where("not is_synthetic").agg(F.count("*"), F.coalesce(F.sum("sanctioned_amt"), F.lit(0))).first()
    return tuple(a) != tuple(b)


def member_percentile(accounts: DataFrame) -> DataFrame:
    """(member, utilisation_pct, percentile): the share of members whose utilisation is at most the own one, in percent.

    Members are dealt to ranges of the value, so no task sees all of them.
    """
    rows = spread_ranks(accounts, "utilisation_pct", ["member"])
    return rows.select("member", "utilisation_pct", (F.col("_upto") * 100.0 / F.col("_n")).alias("percentile"))


def fund_accounts(works: DataFrame, paid: DataFrame, allocations: DataFrame) -> DataFrame:
    """Per member: a row for each financial year, and one for the term to date, which alone carries the allocation.

    works: member, fy, sanctioned_amt, work_id. paid: work_id, paid_amt. allocations: member, allocated_amt.
    """
    rows = works.join(paid.select("work_id", "paid_amt"), "work_id", "left")
    sums = rows.groupingSets([["member", "fy"], ["member"]], "member", "fy").agg(F.grouping("fy").alias("term"), F.sum("sanctioned_amt").alias("sanctioned"), F.sum(F.coalesce("paid_amt", F.lit(0))).alias("paid"), F.count("*").alias("works"))
    sums = sums.select("member", F.when(F.col("term") == 1, "term_to_date").otherwise(F.col("fy")).alias("fy"), "sanctioned", "paid", "works")
    sums = sums.join(allocations.select("member", "allocated_amt"), "member", "left")
    on_term = F.when(F.col("fy") == "term_to_date", F.col("allocated_amt"))
    pct = F.col("sanctioned") / F.nullif(on_term, F.lit(0)) * 100
    return sums.select("member", "fy", "sanctioned", "paid", "works", on_term.alias("allocated"), pct.alias("utilisation_pct"))
