"""Mixing sources to target weights by Pareto order sampling.

Each source has a target of words. A document's expected number of copies is in
proportion to its priority, by default the root of its size, up to the most copies that
it may have; the source's level makes the expected words come to the target. The whole
part is taken for certain, and the rest is the document's inclusion probability in a
Pareto sample: documents are ranked by their random odds divided by their inclusion
odds, and the first ones make up the sample, whose size in words is fixed by what
certain copies leave of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Weights by place of the source in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: All targets together, as a part of all sizes.
BUDGET = 1.5
#: No target, and no document's copies, exceed this times the size.
MOST = 2
#: Ranges of the ranking key that are summed before any single rows are ranked.
RANGES = 1 << 14
#: Tasks that the rows of a source are dealt to where they meet what is known of it.
SALTS = 64
SEED = 17


def n_words(text: str | Column) -> Column:
    """The number of runs of other characters than the contract's white space."""
    return F.regexp_count(text_or_empty(text), F.lit("[^ \\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, capped, with the excess dealt out again.

    The fixed point of dealing again is one water level L with target = min(most * size, L * weight). Sources are put in
    the order in which rising water caps them; L is what is left over the weights that are left, at the first source
    that it doesn't cap. The table has a row per source, so its windows are small.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    capping = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earlier, later = capping.rowsBetween(W.unboundedPreceding, -1), capping.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(later)).withColumn("nth", F.row_number().over(capping))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))).over(everything)["level"]
    return rows.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _of_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows with the columns of ``facts`` (a row for each _source); a source's rows are dealt to SALTS tasks."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "size"), F.lit(SALTS)).cast("int"))
    facts = facts.withColumn("_s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(facts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_s_salt"))).drop("_source", "_salt", "_s_salt")


def levels(rows: DataFrame, goal: DataFrame, most: float = MOST) -> DataFrame:
    """(source, level): with copies of least(most, level * priority) a source's expected words come to its target.

    rows: source, size, _priority; goal: source, target. The largest priorities reach ``most`` first, so running sums in
    their order tell where the level lies. They go over sums for each source and priority. A source without words has no
    row, and one whose target is all that can be taken has a level at which all documents have the most copies.
    """
    sums = rows.where("size > 0").groupBy(F.col("source").alias("_s"), "_priority").agg(F.sum("size").alias("_words"))
    sums = sums.join(goal.select("source", "target"), F.col("_s").eqNullSafe(F.col("source")))
    down = W.partitionBy("source").orderBy(F.desc("_priority"))
    full = F.coalesce(F.sum("_words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * float(most)
    open_mass = F.sum(F.col("_words") * F.col("_priority")).over(down.rowsBetween(0, W.unboundedFollowing))
    sums = sums.withColumn("_level", F.greatest(F.lit(0.0), F.col("target") - full) / open_mass)
    # The first priority that the level keeps below the most copies; if there is none, a level that fills all.
    fits = F.when(F.col("_level") * F.col("_priority") <= float(most), F.struct(-F.col("_priority"), "_level"))
    return sums.groupBy("source").agg(F.min(fits)["_level"].alias("_first"), (F.lit(float(most)) / F.min("_priority")).alias("_all")).select("source", F.coalesce("_first", "_all").alias("level"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", priority: Column | None = None, seed: int = SEED, ranges: int = RANGES, row_col: str | None = None) -> DataFrame:
    """id, size, source_size, target, copies and taken (= copies * size) for each row; all of them, taken or not.

    row_col: a column that tells rows apart, also those that repeat an id; the result has it first.
    priority: a positive column of the documents by which expected copies rise; without it, the root of the size. Random numbers are hashes of id and seed, so reruns agree, and so do rows that repeat an id. Null or
    blank texts have size 0 and are not taken. Null sources are one source, last in order. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = documents.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), (F.lit(None) if priority is None else priority).cast("double").alias("_priority"), *([F.col(row_col).alias("_row")] if row_col else []))
    own = ["_row"] if row_col else []
    rows = stored(rows, "mix-rows")  # without texts: words are counted once
    if priority is None:
        rows = rows.withColumn("_priority", F.sqrt("size"))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    level = levels(rows, goal).select(F.col("source").alias("_s"), "level")
    goal = goal.join(level, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_source"), "source_size", "target", "level")
    goal = stored(goal, "mix-goal")  # a row for each source; all that follows would hold its plan again at each place that reads it
    rows = _of_source(rows, goal)

    # Whole numbers but for rounding are whole: a document at its most copies is settled.
    copies = F.least(F.lit(float(MOST)), F.col("level") * F.col("_priority"))
    near = F.round(copies, 0)
    expected = F.when(F.col("size") > 0, F.when(F.abs(copies - near) < 1e-9, near).otherwise(copies)).otherwise(0.0)
    rows = rows.withColumn("_expected", expected).withColumn("_whole", F.floor("_expected")).withColumn("_part", F.col("_expected") - F.col("_whole"))
    u = (F.shiftrightunsigned(F.xxhash64("_id", F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    sure = rows.groupBy("source").agg(F.sum(F.col("_whole") * F.col("size")).alias("_sure")).select(F.col("source").alias("_s"), "_sure")
    # Rows without a fractional part are settled; only the others are ranked.
    settled = rows.where("_part <= 0").withColumn("copies", F.col("_whole").cast("long"))
    rows = rows.where("_part > 0")
    odds = F.when(F.col("_part") > 0, (u / (1 - u)) * ((1 - F.col("_part")) / F.col("_part")))  # may be put before the filter
    rows = rows.withColumn("_rank", odds).withColumn("_range", F.floor(ranges * odds / (1 + odds)).cast("int"))

    # Words ranked before a row: those of all earlier ranges of its source, and of earlier rows in its range.
    by_range = rows.groupBy("source", "_range").agg(F.sum("size").alias("_in"))
    earlier = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    by_range = by_range.select(F.col("source").alias("_source"), F.col("_range").alias("_r"), F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    by_range = by_range.join(sure, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.join(by_range, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    inside = W.partitionBy("source", "_range").orderBy("_rank", "_id", "size", *own).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # A row is in the sample if most of it lies before the words that are left.
    sampled = before + F.col("size") / 2 <= F.col("target") - F.col("_sure")
    rows = rows.withColumn("copies", (F.col("_whole") + sampled.cast("int")).cast("long"))
    rows = rows.select(*settled.columns).unionByName(settled)
    return rows.select(*[F.col(c).alias(row_col) for c in own], F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
