"""The feature dictionary: measures of a work, each with the reason where it is missing.

``derive`` reads one row for each work, with its payments already summed, and adds for
every feature a column and ``<feature>__why``. A value is there exactly when the reason
says published.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NOT_APPLICABLE, NOT_PUBLISHED, PUBLISHED, PUBLISHED_ZERO, description_key
from ..sources.tables import materialised

#: Paid by an agency in all, at or below which a vendor's share of it is not looked at.
AGENCY_FLOOR = 5_000_000
#: A fund hop counts as open below this percentage where no rule says otherwise.
HOP_TOLERANCE = -15.0
DONE = "Work Completed"
#: What ``measured`` adds, each with its reason.
MEASURES = (
    "variance_sanction_to_disbursement", "variance_disbursement_to_certification", "sanction_lag_days", "sanction_to_first_payment_days", "first_payment_to_completion_days", "execution_days", "days_since_last_payment",
    "vendor_share_in_agency_pct", "completed_without_payment", "asset_image_absent", "mp_utilisation_pct", "duplicate_similarity", "same_desc_same_agency_count", "payment_count",
)


def _pair(name: str, value: Column, why: Column) -> dict[str, Column]:
    return {name: value, f"{name}__why": F.when(value.isNotNull(), PUBLISHED).otherwise(why)}


def _variance(before: Column, before_why: Column, after: Column, after_why: Column) -> tuple[Column, Column]:
    value = F.when((before != 0) & after.isNotNull(), (after - before) / F.nullif(before, F.lit(0)) * 100)
    return value, F.when(before.isNull(), before_why).when(before == 0, PUBLISHED_ZERO).otherwise(after_why)


def payment_rollup(payments: DataFrame) -> DataFrame:
    """Per work: paid_amt (null if no row has an amount), n_payments, first_payment, last_payment, top_vendor.

    payments: work_id, vendor_id, paid_amt, payment_date. The top vendor is the one paid most for the work, ties by the
    smaller id. Amounts are summed before any join, vendor by vendor first, so hot works shuffle partial sums only.
    """
    by_vendor = payments.groupBy("work_id", "vendor_id").agg(F.sum("paid_amt").alias("paid"), F.count("*").alias("n"), F.min("payment_date").alias("lo"), F.max("payment_date").alias("hi"))
    top = F.max_by("vendor_id", F.when(F.col("vendor_id").isNotNull() & F.col("paid").isNotNull(), F.struct(F.col("paid"), -F.col("vendor_id"))))
    return by_vendor.groupBy("work_id").agg(F.sum("paid").alias("paid_amt"), F.sum("n").alias("n_payments"), F.min("lo").alias("first_payment"), F.max("hi").alias("last_payment"), top.alias("top_vendor"))


def agency_totals(paid: DataFrame) -> DataFrame:
    """(agency, vendor_id, vendor_paid, agency_paid) over all works of an agency; paid: agency, vendor_id, paid_amt."""
    edges = paid.where("agency is not null and vendor_id is not null and paid_amt is not null").groupBy("agency", "vendor_id").agg(F.sum("paid_amt").alias("vendor_paid"))
    return edges.withColumn("agency_paid", F.sum("vendor_paid").over(W.partitionBy("agency")))


def exact_counts(works: DataFrame) -> DataFrame:
    """(agency, description_key, same_count, agency_described): works that share a description under one agency.

    Counted by aggregation and joined back: an agency with a third of all works is no hot window.
    """
    counts = works.where("agency is not null").groupBy("agency", "description_key").agg(F.count("*").alias("same_count"))
    readable = counts.where("description_key is not null")
    return readable.withColumn("agency_described", F.sum("same_count").over(W.partitionBy("agency")))


def derive(works: DataFrame, payments: DataFrame | None, accounts: DataFrame, as_of: datetime.date, similarity: DataFrame | None = None, agency_floor: int = AGENCY_FLOOR, shares: DataFrame | None = None) -> DataFrame:
    """All features of each work.

    works: work_id, agency, member, fy, status, description, sanctioned_amt, sanction_date, recommended_date,
    recommended_date__why, completion_date, completion_date__why, certified_amt, certified_amt__why, asset_image_present,
    asset_image__why. payments: work_id, agency, vendor_id, paid_amt, payment_date; where it is None, works have the columns
    of ``payment_rollup``, and shares those of ``agency_totals``. accounts: member, allocated_amt,
    allocated_amt__why, account_sanctioned. similarity: agency, description_key, duplicate_similarity (null or no row: no
    peer); without it a repeated description under the agency is 1 and any other readable one 0.
    """
    works = works.withColumn("description_key", description_key("description"))
    shares = (agency_totals(payments) if shares is None else shares).select(F.col("agency").alias("_agency"), F.col("vendor_id").alias("_vendor"), "vendor_paid", "agency_paid")
    counts = materialised(exact_counts(works), "same-texts").select(F.col("agency").alias("_a"), F.col("description_key").alias("_d"), "same_count", "agency_described")
    rows = works if payments is None else works.join(payment_rollup(payments), "work_id", "left")
    rows = rows.join(shares, (F.col("agency") == F.col("_agency")) & (F.col("top_vendor") == F.col("_vendor")), "left").drop("_agency", "_vendor")
    rows = rows.join(counts, (F.col("agency") == F.col("_a")) & (F.col("description_key") == F.col("_d")), "left").drop("_a", "_d")
    rows = rows.join(accounts, "member", "left")
    if similarity is not None:
        best = similarity.select(F.col("agency").alias("_a"), F.col("description_key").alias("_d"), F.col("duplicate_similarity").alias("_similar"))
        rows = rows.join(best, (F.col("agency") == F.col("_a")) & (F.col("description_key") == F.col("_d")), "left").drop("_a", "_d")
    else:
        rows = rows.withColumn("_similar", F.when(F.col("agency_described") > 1, F.when(F.col("same_count") > 1, 1.0).otherwise(0.0)))

    return measured(rows, as_of, agency_floor)


def measured(rows: DataFrame, as_of: datetime.date, agency_floor: int = AGENCY_FLOOR) -> DataFrame:
    """The features of rows that have all that they follow from; ``_similar`` among it, which is left out of the result.

    Nothing is joined, so what was measured before can be left out of rows that are shuffled, and measured again after.
    """
    c = F.col
    none = F.coalesce(c("n_payments"), F.lit(0)) == 0
    paid_why = F.when(c("paid_amt").isNull(), NOT_PUBLISHED).when(c("paid_amt") == 0, PUBLISHED_ZERO).otherwise(PUBLISHED)
    undated = F.when(none, NOT_APPLICABLE).otherwise(NOT_PUBLISHED)
    done_why = F.coalesce(c("completion_date__why"), F.lit(NOT_APPLICABLE))
    features: dict[str, Column] = {}
    features |= _pair("variance_sanction_to_disbursement", *_variance(c("sanctioned_amt"), F.lit(NOT_PUBLISHED), c("paid_amt"), paid_why))
    features |= _pair("variance_disbursement_to_certification", *_variance(c("paid_amt"), paid_why, c("certified_amt"), F.coalesce(c("certified_amt__why"), F.lit(NOT_PUBLISHED))))
    features |= _pair("sanction_lag_days", F.datediff("sanction_date", "recommended_date"), F.coalesce(c("recommended_date__why"), F.lit(NOT_PUBLISHED)))
    features |= _pair("sanction_to_first_payment_days", F.datediff("first_payment", "sanction_date"), undated)
    features |= _pair("first_payment_to_completion_days", F.datediff("completion_date", "first_payment"), F.when(c("first_payment").isNull(), undated).otherwise(done_why))
    features |= _pair("execution_days", F.datediff("completion_date", "sanction_date"), done_why)
    features |= _pair("days_since_last_payment", F.datediff(F.lit(as_of), "last_payment"), F.lit(NOT_PUBLISHED))
    share = F.when(c("agency_paid") > agency_floor, c("vendor_paid") / F.nullif(c("agency_paid"), F.lit(0)) * 100)
    features |= _pair("vendor_share_in_agency_pct", share, F.when(c("agency_paid") <= agency_floor, NOT_APPLICABLE).otherwise(NOT_PUBLISHED))
    features |= _pair("completed_without_payment", (c("status") == DONE) & none, F.lit(NOT_PUBLISHED))
    features |= _pair("asset_image_absent", F.when(c("asset_image__why") == PUBLISHED, ~c("asset_image_present")), F.lit(NOT_PUBLISHED))
    ratio = c("account_sanctioned") / F.nullif(c("allocated_amt"), F.lit(0)) * 100
    features |= _pair("mp_utilisation_pct", F.when(c("allocated_amt") != 0, F.coalesce(ratio, F.lit(0.0))), F.when(c("allocated_amt") == 0, PUBLISHED_ZERO).otherwise(F.coalesce(c("allocated_amt__why"), F.lit(NOT_PUBLISHED))))
    features |= _pair("duplicate_similarity", F.when(c("description_key").isNotNull(), c("_similar")), F.when(c("description_key").isNull(), NOT_PUBLISHED).otherwise(NOT_APPLICABLE))
    features |= _pair("same_desc_same_agency_count", c("same_count"), F.lit(NOT_PUBLISHED))
    features |= _pair("payment_count", F.coalesce(c("n_payments"), F.lit(0)), F.lit(NOT_PUBLISHED))
    return rows.withColumns(features).drop("_similar")


def gap_hop(tolerance: float = HOP_TOLERANCE) -> Column:
    """The first fund hop that is measured and below the tolerance; unmeasured hops are passed over."""
    return F.when(F.col("variance_sanction_to_disbursement") < tolerance, "sanction_to_disbursement").when(F.col("variance_disbursement_to_certification") < tolerance, "disbursement_to_certification")


LAGS = {"recommend_to_sanction": "sanction_lag_days", "sanction_to_first_payment": "sanction_to_first_payment_days", "first_payment_to_completion": "first_payment_to_completion_days"}


def slowest_lag() -> Column:
    """The longest measured lag; ties go to the earlier one."""
    longest = F.greatest(*[F.col(c) for c in LAGS.values()])
    out = F
    for name, column in LAGS.items():
        out = out.when(F.col(column) == longest, name)
    return out


def fund_ladder(tolerance: float = HOP_TOLERANCE) -> Column:
    """array<struct<rung, amount, hop_pct, state, why>>: sanctioned, disbursed, certified."""

    def rung(name: str, amount: str, hop: str | None) -> Column:
        pct = F.lit(None).cast("double") if hop is None else F.col(hop)
        why = F.lit(None).cast("string") if hop is None else F.col(f"{hop}__why")
        state = F.when(pct.isNull(), "unavailable").when(pct < tolerance, "open").otherwise("closed") if hop else F.lit("start")
        return F.struct(F.lit(name).alias("rung"), F.col(amount).cast("long").alias("amount"), pct.alias("hop_pct"), state.alias("state"), why.alias("why"))

    return F.array(rung("sanctioned", "sanctioned_amt", None), rung("disbursed", "paid_amt", "variance_sanction_to_disbursement"), rung("certified", "certified_amt", "variance_disbursement_to_certification"))


def lifecycle_ladder() -> Column:
    """array<struct<step, on, lag_days, why>>: recommended, sanctioned, first payment, completion."""
    steps = (("recommended", "recommended_date", None), ("sanctioned", "sanction_date", "sanction_lag_days"), ("first_payment", "first_payment", "sanction_to_first_payment_days"), ("completion", "completion_date", "first_payment_to_completion_days"))
    rows = [F.struct(F.lit(s).alias("step"), F.col(d).alias("on"), (F.col(f).cast("int") if f else F.lit(None).cast("int")).alias("lag_days"), (F.col(f"{f}__why") if f else F.lit(None).cast("string")).alias("why")) for s, d, f in steps]
    return F.array(*rows)
