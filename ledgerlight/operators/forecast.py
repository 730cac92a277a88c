"""Delay risk: boosted trees over what is known at sanction, checked on agencies held out whole."""

from __future__ import annotations

import datetime

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .ranking import spread_ranks
from .rulebook import Rulebook

# What the model reads. These are known once a work is under way and mean the same for works that are done
# and works that aren't; days since the last payment, what is paid so far and the number of payments don't.
NUMBERS = ("sanction_lag_days", "sanction_to_first_payment_days", "duplicate_similarity", "same_desc_same_agency_count", "mp_utilisation_pct", "log10_sanctioned_amt")
CATEGORIES = ("state", "category")


def horizon_days(book: Rulebook) -> float:
    """From when on a work is late: the threshold of the rule that reads execution days. Without one there is no meaning of late."""
    rule = book.by_field("execution_days")
    if rule is None:
        raise ValueError("no rule reads execution_days, so the forecast has no definition of late")
    return float(rule.threshold)


def population(horizon_days: float, as_of: datetime.date) -> Column:
    """completed, past_horizon or open; only open works get a probability."""
    return F.when(F.col("completion_date").isNotNull(), "completed").when(F.datediff(F.lit(as_of), "sanction_date") > horizon_days, "past_horizon").otherwise("open")


def elapsed_days(as_of: datetime.date) -> Column:
    """Days from the sanction to the corpus's day, never to today."""
    return F.datediff(F.lit(as_of), "sanction_date")


def model_rows(features: DataFrame, horizon_days: float, as_of: datetime.date) -> DataFrame:
    """work_id, agency, population, elapsed_days, label (completed works that aren't synthetic only), held_out and what the model reads.

    A value that isn't there stays null. An agency is held out as a whole; a work without one is a group of its own.
    """
    rows = features.withColumn("log10_sanctioned_amt", F.when(F.col("sanctioned_amt") > 0, F.log10("sanctioned_amt"))).withColumn("population", population(horizon_days, as_of))
    label = F.when(F.col("execution_days").isNotNull() & ~F.coalesce("is_synthetic", F.lit(False)), (F.col("execution_days") > horizon_days).cast("double"))
    group = F.coalesce("agency", F.concat(F.lit("work "), F.col("work_id")))
    return rows.select("work_id", "agency", "population", elapsed_days(as_of).alias("elapsed_days"), label.alias("label"), (F.pmod(F.xxhash64(group), F.lit(100)) < 25).alias("held_out"), *[F.col(c).cast("double").alias(c) for c in NUMBERS], *CATEGORIES)


def with_random_split(rows: DataFrame) -> DataFrame:
    """The rows held out one by one instead of by agency: the contrast that shows what a model knows of agencies it has seen."""
    return rows.withColumn("held_out", F.pmod(F.xxhash64("work_id", F.lit("split")), F.lit(100)) < 25)


def fit(rows: DataFrame, trees: int = 20) -> boosting.Boosted:
    return boosting.fit(rows.where("not held_out"), "label", NUMBERS, CATEGORIES, trees=trees)


def risks(rows: DataFrame, model: boosting.Boosted) -> DataFrame:
    return rows.withColumn("risk", model.probability())


def with_percentile(scored: DataFrame) -> DataFrame:
    """Adds risk_percentile: the share of the other open works whose risk ranks lower, in percent; null for all that aren't open."""
    ranked = percentile_in(scored.where("population = 'open'").select("work_id", "population", "risk"), "risk", ["population"])
    return scored.join(ranked.select("work_id", F.col("percentile").alias("risk_percentile")), "work_id", "left")


def quality(scored: DataFrame) -> dict[str, float]:
    """On the agencies held out: area under the curve, accuracy, Brier score, and the Brier score of the constant share."""
    held = scored.where("held_out and label is not null")
    share = scored.where("not held_out and label is not null").agg(F.avg("label")).first()[0] or 0.0
    accuracy, brier, constant = held.agg(F.avg(((F.col("risk") >= 0.5).cast("double") == F.col("label")).cast("double")), F.avg((F.col("risk") - F.col("label")) ** 2), F.avg((F.lit(share) - F.col("label")) ** 2)).first()
    return {"auc": BinaryClassificationEvaluator(rawPredictionCol="risk").evaluate(held), "accuracy": accuracy, "brier": brier, "constant_brier": constant}


def percentile_in(rows: DataFrame, value: str, groups: list[str], tie: str = "work_id") -> DataFrame:
    """Adds percentile: the share of the group's other rows ranked below, in percent; ties by id, null for a row alone."""
    ranked = spread_ranks(rows, value, [tie], tuple(groups))
    return ranked.withColumn("percentile", (F.col("_rank") - 1) / F.nullif(F.col("_n") - 1, F.lit(0)) * 100).drop("_rank", "_upto", "_n")
