"""From traces to cases: weighted scores, coverage, bands and the bonus for an agency's pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import case_id
from .features import gap_hop, slowest_lag
from .rulebook import CITATION, SCORE_CAP, Rulebook, trace


def severity(score: Column, book: Rulebook) -> Column:
    return F.when(score >= book.high, "HIGH").when(score >= book.medium, "MEDIUM").otherwise("LOW")


def total(rows: Column, field: str, status: str) -> Column:
    return F.aggregate(F.filter(rows, lambda r: r["status"] == status), F.lit(0), lambda a, r: a + r[field])


def coverage_pct(rows: Column, book: Rulebook) -> Column:
    """The part of all weight that could be read, rounded half to even."""
    return F.bround((F.lit(book.weight_total) - total(rows, "weight", "skipped")) / book.weight_total * 100, 0).cast("long")


def base_scores(features: DataFrame, book: Rulebook) -> DataFrame:
    """The features with trace, subtotal, base severity (before any bonus), coverage, gap_hop and slowest_lag."""
    rule = book.by_field("variance_sanction_to_disbursement")
    rows = features.withColumn("trace", trace(book))
    rows = rows.withColumn("subtotal", total(F.col("trace"), "contribution", "fired"))
    return rows.withColumns({
        "case_id": case_id("work_id"), "rulebook_version": F.lit(book.version), "base_severity": severity(F.least("subtotal", F.lit(SCORE_CAP)), book), "coverage_pct": coverage_pct(F.col("trace"), book),
        "gap_hop": gap_hop(float(rule.threshold)) if rule else gap_hop(), "slowest_lag": slowest_lag(),
    })


def high_peers(scored: DataFrame) -> DataFrame:
    """(agency, fy, n_high) by aggregation; null agencies are one group."""
    return scored.groupBy("agency", "fy").agg(F.count_if(F.col("base_severity") == "HIGH").alias("n_high"))


def with_bonus(scored: DataFrame, book: Rulebook, counts: DataFrame | None = None) -> DataFrame:
    """Adds peer_count (HIGH cases of the agency and year, itself left out), bonus, raw_score, score and severity.

    All or nothing: the bonus is not scaled. The counts are a small table joined back, so a hot agency stays spread.
    counts: ``high_peers`` of the same cases where they are stored; then their size is known when the join is planned.
    """
    peers = (high_peers(scored) if counts is None else counts).select(F.col("agency").alias("_a"), F.col("fy").alias("_f"), "n_high")
    rows = scored.join(peers, F.col("agency").eqNullSafe(F.col("_a")) & F.col("fy").eqNullSafe(F.col("_f"))).drop("_a", "_f")
    rows = rows.withColumn("peer_count", F.col("n_high") - (F.col("base_severity") == "HIGH").cast("int")).drop("n_high")
    rows = rows.withColumn("bonus", F.when(F.col("peer_count") >= book.bonus_least, book.bonus_weight).otherwise(0))
    rows = rows.withColumn("raw_score", F.col("subtotal") + F.col("bonus")).withColumn("score", F.least("raw_score", F.lit(SCORE_CAP)))
    return rows.withColumn("severity", severity(F.col("score"), book))


def cases(features: DataFrame, book: Rulebook) -> DataFrame:
    return with_bonus(base_scores(features, book), book)


def peer_evidence(cased: DataFrame, most: int = 3) -> DataFrame:
    """(case_id, matched): for cases with the bonus, the first ids of other HIGH cases of the agency and year by work id.

    Only the first most + 1 ids of each group can be evidence, so no group is collected.
    """
    high = cased.where("base_severity = 'HIGH'").select("agency", "fy", "work_id", F.col("case_id").alias("peer"))
    ranked = high.withColumn("n", F.row_number().over(W.partitionBy("agency", "fy").orderBy("work_id"))).where(F.col("n") <= most + 1)
    lists = ranked.groupBy("agency", "fy").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "peer"))), lambda s: s["peer"]).alias("peers"))
    lists = lists.select(F.col("agency").alias("_a"), F.col("fy").alias("_f"), "peers")
    rows = cased.where("bonus > 0").join(lists, F.col("agency").eqNullSafe(F.col("_a")) & F.col("fy").eqNullSafe(F.col("_f")))
    return rows.select("case_id", "peer_count", F.slice(F.filter("peers", lambda p: p != F.col("case_id")), 1, most).alias("matched"))


def rule_hits(cased: DataFrame) -> DataFrame:
    """The trace in long form, a row for each case and rule."""
    return cased.select("case_id", "work_id", F.explode("trace").alias("t")).select("case_id", "work_id", "t.*")


def firing_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("rule_id").pivot("status", ["fired", "passed", "skipped"]).count().na.fill(0, ["fired", "passed", "skipped"])


def loudest_rule(hits: DataFrame) -> DataFrame:
    """(case_id, rule_id, contribution): the fired rule that adds most, ties by id."""
    best = F.min_by(F.struct("rule_id", "contribution"), F.struct(-F.col("contribution"), F.col("rule_id")))
    return hits.where("status = 'fired'").groupBy("case_id").agg(best.alias("b")).select("case_id", "b.rule_id", "b.contribution")


def with_citations(cases: DataFrame, peers: DataFrame, rule: str = "duplicate_work", most: int = 2) -> DataFrame:
    """(case_id, work_id, cited, best): the works that each case with the rule fired cites, the most similar first.

    peers: (work_id, peer, score, rank) of ``similar_peers``. A case on which the rule fired and that can cite nothing is
    an error: a repeated work must name the work that it repeats.
    """
    fired = cases.where(F.exists("trace", lambda t: (t["rule_id"] == rule) & (t["status"] == "fired"))).select("case_id", "work_id")
    listed = peers.where(F.col("rank") <= most).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("rank", "peer", "score"))).alias("peers"))
    rows = fired.join(listed, "work_id", "left")
    cited = F.when(F.coalesce(F.size("peers"), F.lit(0)) < 1, F.raise_error(F.lit(f"{rule} fired and cites no work"))).otherwise(F.transform("peers", lambda p: p["peer"]))
    return rows.select("case_id", "work_id", cited.cast("array<string>").alias("cited"), F.element_at("peers", 1)["score"].alias("best"))


def with_evidence(cases: DataFrame, citations: DataFrame, rule: str = "duplicate_work") -> DataFrame:
    """The cases with what they cite in their traces, as the citation (matched, score) of the rule where it fired.

    citations: of ``with_citations``, a row for each case with the rule fired. A fired rule without its row is an error,
    so no case can be stored on a similarity that names no other work.
    """
    return evidenced(cases.join(citations.select("work_id", citation("cited", "best").alias("_cited")), "work_id", "left"), rule)


def citation(matched: str | Column, score: str | Column) -> Column:
    return F.struct(F.col(matched).alias("matched") if isinstance(matched, str) else matched.alias("matched"), F.col(score).alias("score") if isinstance(score, str) else score.alias("score")).cast(CITATION)


def evidenced(rows: DataFrame, rule: str = "duplicate_work") -> DataFrame:
    """As ``with_evidence``, of rows that have what they cite in ``_cited``, null where they can cite nothing."""
    missing = F.raise_error(F.lit(f"{rule} fired and cites no work")).cast(CITATION)
    own = lambda t: F.when((t["rule_id"] == rule) & (t["status"] == "fired"), F.coalesce(F.col("_cited"), missing))
    return rows.withColumn("trace", F.transform("trace", lambda t: t.withField("citation", own(t)))).drop("_cited")
