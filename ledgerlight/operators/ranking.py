"""Ranks over whole tables, or large groups of them, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialised


def dealt_to_ranges(rows: DataFrame, value: str, ties: list[str], groups: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """The rows with _range, stored: ranges of about as many rows each, in the order of groups, value and ties.

    Their ends come from Spark's sample of these keys, so an outlier takes no range for itself, and a value that many rows
    share is divided by the ties. What the sample misses moves an end; ranks are counted after that and are exact.
    """
    keys = [*groups, value, *ties]
    dealt = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    return materialised(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def spread_ranks(rows: DataFrame, value: str, ties: list[str], groups: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Adds _rank (from 1, in the order of value and then ties), _upto (rows with this value or a smaller one) and _n.

    Rows are dealt to ranges of even size, which are counted before any row is ranked; running sums go over counts only, of
    which there is one for each range and group. Rows whose value is null aren't ranked and don't come back.
    """
    rows = dealt_to_ranges(rows.where(F.col(value).isNotNull()), value, ties, groups, ranges)
    keys = list(groups)

    def same(left: DataFrame, right: DataFrame, also: Column) -> DataFrame:
        right = right.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        for k in keys:
            also &= F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        return left.join(right, also).drop(*[f"_g_{k}" for k in keys])

    each = rows.groupBy(*keys, "_range", value).agg(F.count("*").alias("_c"))
    parts = each.groupBy(*keys, F.col("_range").alias("_r")).agg(F.sum("_c").alias("_in"), F.min(F.struct(F.col(value).alias("v"), F.col("_c").alias("c"))).alias("_lo"), F.max(value).alias("_hi"))
    before = F.coalesce(F.sum("_in").over(W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_n": F.sum("_in").over(W.partitionBy(*keys))})
    # A value can go on in the ranges after: then it is their least one, and the last of its rows says how far it goes.
    ends = F.array(F.struct(F.col("_lo.v").alias("v"), (F.col("_before") + F.col("_lo.c")).alias("at")), F.struct(F.col("_hi").alias("v"), (F.col("_before") + F.col("_in")).alias("at")))
    ends = parts.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, F.col("e.v").alias("_v")).agg(F.max("e.at").alias("_end"))
    parts = same(parts.drop("_in", "_lo"), ends, F.col("_hi") == F.col("_v")).drop("_v")
    rows = same(rows, parts, F.col("_range") == F.col("_r"))
    inside = W.partitionBy(*keys, "_range")
    rank = F.col("_before") + F.row_number().over(inside.orderBy(value, *ties))
    upto = F.col("_before") + F.count("*").over(inside.orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumns({"_rank": rank, "_upto": F.when(F.col(value) == F.col("_hi"), F.col("_end")).otherwise(upto)}).drop("_range", "_r", "_before", "_hi", "_end")
