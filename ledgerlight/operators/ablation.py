"""What missing data costs: skips by field, extrapolated fires, ranks and the range of cases that could change band."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import PUBLISHED, crore
from .rulebook import Rulebook


@dataclass(frozen=True)
class Field:
    """A field that could be published. Either rules skip for want of it, where ``condition`` holds, or there is a reason for none."""

    key: str
    rules: tuple[str, ...] = ()
    skip_reason: str = ""
    condition: str = ""
    zero_reason: str = ""
    #: Figures of ``corpus_measures`` that are cited beside the field, and never turned into weight.
    beside: tuple[str, ...] = ()

    def __post_init__(self):
        if bool(self.rules) == bool(self.zero_reason):
            raise ValueError(f"{self.key} needs rules or a reason for none")


#: Columns of a case that conditions read.
READ = ("payment_count", "completion_date")
# The fields' keys, and the rules, reasons and conditions of those that skips are attributed to.
CATALOGUE = (
    Field("revised_cost_estimate", zero_reason="no rule compares a sanction with a revision of it"),
    Field("utilisation_certificate", zero_reason="no rule waits for a certificate", beside=("certification_not_published",)),
    Field("milestone_progress", zero_reason="no rule reads progress between sanction and completion"),
    Field("tender_records", zero_reason="no rule reads how a vendor was chosen"),
    Field("work_geocoordinates", zero_reason="no rule reads a place; two rules would fire more exactly", beside=("duplicate_work_fires", "split_sanction_fires")),
    Field("asset_photo_geotag", zero_reason="no rule reads where and when a photograph was taken", beside=("asset_evidence_passes", "asset_evidence_fires")),
    Field("beneficiary_counts", zero_reason="no rule reads an outcome"),
    Field("expenditure_linkage", ("utilisation_shortfall", "stalled_work", "vendor_concentration"), "not_published", "payment_count = 0", beside=("works_with_payment", "works_without_payment")),
    Field("asset_image_publication_scope", ("asset_evidence_missing",), "not_published", "completion_date is null", beside=("asset_image_published", "works_without_completion")),
)
ATTRIBUTED = tuple(f for f in CATALOGUE if f.rules)


def attribute(hits: DataFrame, catalogue: tuple[Field, ...] = CATALOGUE) -> DataFrame:
    """(field, rule_id, weight, skips, fired, passed, unrealised_weight, firing_rate, extrapolated_fires).

    hits: the long trace with the columns that the conditions read. The rate is over works that the rule could read.
    """
    parts = []
    for f in catalogue:
        for rule in f.rules:
            skipped = (F.col("status") == "skipped") & (F.col("skip_reason") == f.skip_reason) & F.expr(f.condition)
            counts = hits.where(F.col("rule_id") == rule).groupBy("rule_id").agg(F.first("weight").alias("weight"), F.count_if(skipped).alias("skips"), F.count_if(F.col("status") == "fired").alias("fired"), F.count_if(F.col("status") == "passed").alias("passed"))
            parts.append(counts.withColumn("field", F.lit(f.key)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rate = F.try_divide("fired", F.col("fired") + F.col("passed"))
    return out.withColumn("unrealised_weight", F.col("skips") * F.col("weight")).withColumn("firing_rate", rate).withColumn("extrapolated_fires", F.bround(F.col("firing_rate") * F.col("skips"), 0).cast("long"))


def rank_fields(attributed: DataFrame, catalogue: tuple[Field, ...] = CATALOGUE) -> DataFrame:
    """(field, criterion, position) by unrealised weight; ties and zeros have no position. A row for each field."""
    names = attributed.sparkSession.createDataFrame([(f.key,) for f in catalogue], "field string")
    sums = names.join(attributed.groupBy("field").agg(F.sum("unrealised_weight").alias("criterion")), "field", "left").withColumn("criterion", F.coalesce("criterion", F.lit(0)))
    place = F.dense_rank().over(W.orderBy(F.desc("criterion")))
    ties = F.count("*").over(W.partitionBy("criterion"))
    return sums.withColumn("place", place).withColumn("ties", ties).select("field", "criterion", F.when((F.col("criterion") > 0) & (F.col("ties") == 1), F.col("place")).alias("position"))


def band_ceiling(needs: DataFrame, budget: int) -> DataFrame:
    """(can_change, budget, ceiling): how many cases the extrapolated fires suffice for at most, cheapest first.

    Cases with one need are alike, so the running sum is over needs, of which there are as many as rules.
    """
    counts = needs.where("fires is not null").groupBy("fires").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum(F.col("fires") * F.col("n")).over(W.orderBy("fires").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    can = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.lit(budget) - before) / F.col("fires"))))
    return counts.select("n", can.alias("can")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("can_change"), F.lit(budget).cast("long").alias("budget"), F.coalesce(F.sum("can"), F.lit(0)).cast("long").alias("ceiling"))


def band_capacity(cases: DataFrame, field: Field, book: Rulebook) -> DataFrame:
    """(work_id, absorbs, fires) of the cases on which rules of the field were skipped for want of it.

    absorbs: the most fires, lightest first, that keep the case in its band; all of them where no band lies above. fires:
    the fewest, heaviest first, that bring it to the next band; null if none do. Only the rules that were skipped on the
    case, for the field's reason, can fire.
    """
    edge = F.when(F.col("score") < book.medium, book.medium).when(F.col("score") < book.high, book.high)
    skipped = F.filter("trace", lambda t: t["rule_id"].isin(*field.rules) & (t["status"] == "skipped") & (t["skip_reason"] == field.skip_reason))
    rows = cases.where(F.expr(field.condition)).select("work_id", (edge - F.col("score")).alias("gap"), F.array_sort(F.transform(skipped, lambda t: t["weight"])).alias("light"))
    rows = rows.where(F.size("light") > 0)

    def short(weights: Column) -> Column:
        """How many of the weights, in their order, together stay below the gap."""
        sums = F.transform(F.sequence(F.lit(1), F.size(weights)), lambda n: F.aggregate(F.slice(weights, 1, n), F.lit(0), lambda a, w: a + w))
        return F.size(F.filter(sums, lambda x: x < F.col("gap")))

    absorbs = F.when(F.col("gap").isNull(), F.size("light")).otherwise(short(F.col("light")))
    fires = short(F.reverse("light")) + 1
    return rows.select("work_id", absorbs.alias("absorbs"), F.when(F.col("gap").isNotNull() & (fires <= F.size("light")), fires).alias("fires"))


def band_range(cases: DataFrame, attributed: DataFrame, field: Field, book: Rulebook) -> DataFrame:
    """(field, can_change, budget, absorb_capacity, floor, ceiling): between which numbers of cases the field's
    extrapolated fires change the band.

    The floor is what the lightest-first capacity of all cases leaves of the budget; the ceiling is ``band_ceiling``.
    """
    budget = attributed.where(F.col("field") == field.key).agg(F.sum("extrapolated_fires")).first()[0]
    needs = band_capacity(cases, field, book)
    capacity = needs.agg(F.coalesce(F.sum("absorbs"), F.lit(0)).cast("long").alias("absorb_capacity"))
    rows = band_ceiling(needs, int(budget or 0)).crossJoin(capacity)
    return rows.select(F.lit(field.key).alias("field"), "can_change", "budget", "absorb_capacity", F.greatest(F.lit(0), F.col("budget") - F.col("absorb_capacity")).cast("long").alias("floor"), "ceiling")


def recovered_weight(field: Field) -> Column:
    """The weight that rules skipped on a case for want of the field, or 0."""
    mine = F.filter("trace", lambda t: t["rule_id"].isin(*field.rules) & (t["status"] == "skipped") & (t["skip_reason"] == field.skip_reason))
    return F.when(F.expr(field.condition), F.aggregate(mine, F.lit(0), lambda a, t: a + t["weight"])).otherwise(0)


def measure_all(cases: DataFrame, book: Rulebook, catalogue: tuple[Field, ...] = CATALOGUE) -> DataFrame:
    """(field, works_affected, unrealised_weight, coverage_now, coverage_if_published, uplift, zero_reason) for each field.

    All fields are measured in one pass over the cases. Coverage is the mean of each case's rounded percentage, the uplift
    the difference of the two means, unrounded.
    """
    lost = F.aggregate(F.filter("trace", lambda t: t["status"] == "skipped"), F.lit(0), lambda a, t: a + t["weight"])
    measured = [f for f in catalogue if f.rules]
    rows = cases.select("coverage_pct", lost.alias("_lost"), *[recovered_weight(f).alias(f.key) for f in measured])
    sums = [F.avg("coverage_pct").alias("now")]
    for f in measured:
        better = F.bround((F.lit(book.weight_total) - F.col("_lost") + F.col(f.key)) / book.weight_total * 100, 0)
        sums.append(F.struct(F.count_if(F.col(f.key) > 0).alias("works"), F.coalesce(F.sum(f.key), F.lit(0)).alias("weight"), F.avg(better).alias("then")).alias(f.key))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    parts = [
        F.struct(F.lit(f.key).alias("field"), F.col(f"{f.key}.works").alias("works_affected"), F.col(f"{f.key}.weight").alias("unrealised_weight"), F.col("now").alias("coverage_now"), F.col(f"{f.key}.then").alias("coverage_if_published"), none.alias("zero_reason"))
        if f.rules
        else F.struct(F.lit(f.key).alias("field"), zero.alias("works_affected"), zero.alias("unrealised_weight"), F.col("now").alias("coverage_now"), F.col("now").alias("coverage_if_published"), F.lit(f.zero_reason).alias("zero_reason"))
        for f in catalogue
    ]
    return rows.agg(*sums).select(F.inline(F.array(*parts))).withColumn("uplift", F.col("coverage_if_published") - F.col("coverage_now"))


def corpus_measures(cases: DataFrame, recommended: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of the figures that fields may cite, over works that aren't synthetic.

    recommended: work_id, recommended_amt, recommended_amt__why. edges: work_id, vendor_id, a row or more for each pair.
    """
    real = cases.where("not is_synthetic")
    status = lambda rule, s: F.count_if(F.exists("trace", lambda t: (t["rule_id"] == rule) & (t["status"] == s)))
    paid, done = F.col("payment_count") > 0, F.col("completion_date").isNotNull()
    one = real.agg(
        F.count("*").alias("corpus_works"), F.count_if(F.col("certified_amt").isNull()).alias("certification_not_published"), F.count("certified_amt").alias("certification_rows"),
        F.count_if(paid).alias("works_with_payment"), F.count_if(~paid).alias("works_without_payment"), F.count_if(~done).alias("works_without_completion"), F.count_if(paid & ~done).alias("paid_without_completion"), F.count_if(done).alias("asset_image_published"),
        status("asset_evidence_missing", "fired").alias("asset_evidence_fires"), status("asset_evidence_missing", "passed").alias("asset_evidence_passes"), status("duplicate_work", "fired").alias("duplicate_work_fires"),
        status("split_sanction", "fired").alias("split_sanction_fires"), status("vendor_concentration", "fired").alias("vendor_concentration_fires"), F.countDistinct("agency").alias("agencies"), crore(F.sum("sanctioned_amt")).alias("sanctioned_value"),
    )
    said = recommended.select("work_id", "recommended_amt", "recommended_amt__why").join(real.select("work_id", "sanctioned_amt"), "work_id")
    published = F.col("recommended_amt__why") == PUBLISHED
    two = said.agg(F.count_if(published).alias("degeneracy_matched"), F.count_if(published & (F.col("recommended_amt") != F.col("sanctioned_amt"))).alias("degeneracy_differing"), F.count_if(~published).alias("recommended_not_published"))
    three = edges.join(real.select("work_id"), "work_id", "left_semi").agg(F.countDistinct("vendor_id").alias("vendors"))
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))  # one row each


def corroborating(measures: dict, field: Field) -> dict:
    """The figures that stand beside a field; one that wasn't measured is an error."""
    return {name: measures[name] for name in field.beside}


def in_order(ranked: DataFrame) -> DataFrame:
    """Ranked fields first, those without a place after them, by criterion and key; place counts all from 1."""
    by = W.orderBy(F.col("position").asc_nulls_last(), F.desc("criterion"), "field")
    return ranked.withColumn("place", F.row_number().over(by))  # a row for each field of the catalogue


def band_counts(cases: DataFrame) -> DataFrame:
    """(severity, cases): the histogram that a field's changes are read against."""
    return cases.groupBy("severity").agg(F.count("*").alias("cases"))


def markdown(report: list[dict]) -> str:
    """The few rows of a report as a table."""
    if not report:
        return ""
    keys = list(report[0])
    return "\n".join(["| " + " | ".join(keys) + " |", "|" + " --- |" * len(keys), *("| " + " | ".join("" if r[k] is None else str(r[k]) for k in keys) + " |" for r in report)])
