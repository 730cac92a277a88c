"""Ingestion: ordered validation with a complete reject ledger, merging by source precedence, and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NOT_PUBLISHED, case_id, collapsed, is_null_token, malformed_amount, malformed_date, member_name, work_id_parts

# The reasons that a row can be rejected for. The last two are reserved: drift is counted and the row kept.
REASONS = (
    "grand_total_row", "work_id_unparseable", "unparseable_amount", "unparseable_date", "null_required_field", "duplicate_work_id",
    "case_id_collision", "unresolved_reference", "negative_lag", "column_shift", "unknown_category",
)


def is_footer(c: str) -> Column:
    return F.lower(F.regexp_replace(F.col(c), r"(?U)\s+", " ")).contains("grand total")


def work_checks(serial: str, work: str, state: str, member: str, own: list[tuple[Column, str]] | None = None) -> list[tuple[Column, str]]:
    """What every work row is checked for, in order; a dataset's own checks come before that for a name of signs only."""
    return [
        (is_footer(serial), "grand_total_row"), (work_id_parts(work)["canon"].isNull(), "work_id_unparseable"), (_blank(collapsed(state)), "null_required_field"),
        (is_null_token(member), "null_required_field"), *(own or []), (_blank(member_name(member)["name"]), "null_required_field"),
    ]


def expenditure_checks(serial: str, work: str, state: str, status: str, amount: str, on: str, member: str) -> list[tuple[Column, str]]:
    """The checks of a payment row, in order. An amount or date that isn't published is no fault; one that can't be read is."""
    return [
        (is_footer(serial), "grand_total_row"), (work_id_parts(work)["canon"].isNull(), "work_id_unparseable"), (_blank(collapsed(state)), "null_required_field"),
        (is_null_token(status), "null_required_field"), (malformed_amount(amount), "unparseable_amount"), (malformed_date(on), "unparseable_date"), (_blank(member_name(member)["name"]), "null_required_field"),
    ]


def allocation_checks(serial: str, state: str, amount: str, member: str) -> list[tuple[Column, str]]:
    """The checks of an allocation or calamity row, in order; whether the member is known is a join (``unresolved``)."""
    return [(is_footer(serial), "grand_total_row"), (_blank(collapsed(state)), "null_required_field"), (malformed_amount(amount), "unparseable_amount"), (_blank(member_name(member)["name"]), "null_required_field")]


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def first_seen(rows: DataFrame, key: str, raw: str, order: list[str]) -> DataFrame:
    """(key, raw): of each key the spelling that was read first."""
    return rows.where(F.col(raw).isNotNull()).groupBy(key).agg(F.min_by(raw, F.struct(*order)).alias(raw))


def best_variant(rows: DataFrame, key: str, raw: str, score: str, id_col: str) -> DataFrame:
    """(key, raw, score): of each key the spelling that matched best, ties by the smaller id."""
    return rows.groupBy(key).agg(F.max_by(F.struct(raw, score), F.struct(F.col(score), -F.col(id_col))).alias("b")).select(key, f"b.{raw}", f"b.{score}")


def with_recommended(sanctions: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Sanctions with recommended_amt and its reason; those that no recommendation names have none published."""
    rows = sanctions.join(recommendations.select("work_id", "recommended_amt", "recommended_amt__why"), "work_id", "left")
    return rows.withColumn("recommended_amt__why", F.coalesce("recommended_amt__why", F.lit(NOT_PUBLISHED)))


def with_synthetic_control(works: DataFrame, control: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works with the labelled control rows, control rows rejected as their case id is taken)."""
    taken = works.select(case_id("work_id").alias("_case")).distinct()
    control = control.withColumn("_case", case_id("work_id")).withColumn("is_synthetic", F.lit(True))
    fresh = control.join(taken, "_case", "left_anti").drop("_case")
    return works.unionByName(fresh, allowMissingColumns=True), control.join(taken, "_case", "left_semi").drop("_case").withColumn("reason", F.lit("case_id_collision"))


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """The reason of the first check that holds, or null."""
    out = F
    for condition, reason in checks:
        if reason not in REASONS:
            raise ValueError(f"no reason {reason}")
        out = out.when(condition, reason)
    return out


def judged(rows: DataFrame, id_col: str, order_col: str, fault: Column, file_cols: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``reason``, null for those accepted.

    An id counts as seen once a row of the file with it was accepted: the first row of an id that has no fault of its
    own stays, and rows after it are duplicates, whatever else is wrong with them. That row's place is an aggregate
    joined back, so a hot id isn't gathered in one task.
    """
    rows = rows.withColumn("_fault", fault)
    keys = [*file_cols, id_col]
    seen = rows.where(F.col("_fault").isNull() & F.col(id_col).isNotNull()).groupBy(*keys).agg(F.min(order_col).alias("_first"))
    same = F.lit(True)
    seen = seen.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first")
    for k in keys:
        same &= F.col(k) == F.col(f"_k_{k}")
    rows = rows.join(seen, same, "left").drop(*[f"_k_{k}" for k in keys])
    reason = F.when(F.col(id_col).isNull(), "work_id_unparseable").when(F.col("_first") < F.col(order_col), "duplicate_work_id").otherwise(F.col("_fault"))
    return rows.withColumn("reason", reason).drop("_fault", "_first")


def reject_ledger(rows: DataFrame, file_col: str, order_col: str, raw_cols: list[str]) -> DataFrame:
    """file, row_number, reason and the whole raw row as JSON."""
    keep = [c for c in raw_cols if not c.startswith("_")]
    return rows.where("reason is not null").select(F.col(file_col).alias("file"), F.col(order_col).alias("row_number"), "reason", F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}).alias("raw_row"))


def reconciled(rows: DataFrame, file_col: str) -> DataFrame:
    """file, read, loaded, rejected; read is always the sum of the others."""
    return rows.groupBy(F.col(file_col).alias("file")).agg(F.count("*").alias("read"), F.count_if(F.col("reason").isNull()).alias("loaded"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))


def first_by_precedence(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per key and column, the first value that isn't null in the order given; a value and its reason go as one struct."""
    place = F.struct(*order)
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def majority(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per key the most frequent value, ties by the one seen first: (key, winner, votes)."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct(F.col("n"), -F.col("at"))).alias("winner"), F.max("n").alias("votes"))


def drift(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Values that aren't in the vocabulary, with their rows; the rows are kept elsewhere."""
    return rows.where(~F.col(column).isin(*known)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))


def unresolved(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows that refer to nothing known."""
    return rows.join(known.select(*on).distinct(), on, "left_anti")


def register_members(rows: DataFrame) -> DataFrame:
    """(name, house, state, constituency, term_start, term_end) from rows with is_allocation and seen (their order).

    An allocation's state and constituency outrank those of works; the state falls back on the works' majority; the
    first stated term wins.
    """
    order = F.struct((~F.col("is_allocation")).alias("works_last"), F.col("seen"))

    def first(c: str, when: Column | None = None) -> Column:
        there = F.col(c).isNotNull() if when is None else F.col(c).isNotNull() & when
        return F.min_by(c, F.when(there, order)).alias(c)

    firsts = rows.groupBy("name", "house").agg(first("state", F.col("is_allocation")), first("constituency"), first("term_start"), first("term_end"))
    votes = majority(rows.where("state is not null").withColumn("_k", F.concat_ws("\u001f", "name", "house")), "_k", "state", "seen")
    out = firsts.withColumn("_k", F.concat_ws("\u001f", "name", "house")).join(votes.select("_k", "winner"), "_k", "left")
    return out.select("name", "house", F.coalesce("state", "winner").alias("state"), "constituency", "term_start", "term_end")
