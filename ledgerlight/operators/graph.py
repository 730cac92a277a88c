"""The bipartite graph of agencies and vendors: shares, concentration and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_APPLICABLE, PUBLISHED
from ..sources.tables import materialised
from .features import agency_totals


def with_share(totals: DataFrame) -> DataFrame:
    """agency, vendor_id, vendor_paid and agency_paid with the vendor's share of what the agency pays."""
    return totals.withColumn("share", F.try_divide("vendor_paid", "agency_paid"))


def shares(paid: DataFrame) -> DataFrame:
    """(agency, vendor_id, vendor_paid, agency_paid, share)."""
    return with_share(agency_totals(paid))


def spans(edges: DataFrame) -> DataFrame:
    """(vendor_id, agency_span): in how many agencies a vendor is paid."""
    return edges.groupBy("vendor_id").agg(F.countDistinct("agency").alias("agency_span"))


def concentration(edges: DataFrame) -> DataFrame:
    """Per agency: vendors, hhi (sum of squared shares), top_share, shared_exposure (paid to vendors of several agencies)."""
    rows = edges.join(spans(edges), "vendor_id")
    shared = F.sum(F.when(F.col("agency_span") > 1, F.col("vendor_paid")))
    return rows.groupBy("agency").agg(F.count("*").alias("vendors"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("top_share"), F.try_divide(shared, F.first("agency_paid")).alias("shared_exposure"))


def concentrated_pairs(edges: DataFrame, threshold_pct: float, floor: int) -> DataFrame:
    return edges.where((F.col("share") * 100 > threshold_pct) & (F.col("agency_paid") > floor)).select("agency", "vendor_id", "vendor_paid")


def graph_findings(works: DataFrame, edges: DataFrame) -> DataFrame:
    """(work_id, hhi, hhi__why): the concentration of a work's agency, not applicable without an edge."""
    rows = works.join(concentration(edges).select("agency", "hhi"), "agency", "left")
    return rows.select("work_id", "hhi", F.when(F.col("hhi").isNull(), "not_applicable").otherwise("published").alias("hhi__why"))


def structure(edges: DataFrame, floor: int, roots: DataFrame | None = None) -> DataFrame:
    """Where each agency stands in the graph of all payments: a row for each agency that paid something.

    (agency, vendors, disbursed_total, above_floor, top_vendor, top_share_pct, hhi, shared_exposure_pct, widest_span,
    component_size, component_agencies). edges: of ``with_share``, all of them, as leaving small ones out would cut the graph.
    The top vendor is the one paid most, ties by the smaller id. roots: (node, root) of ``components`` of ``named_links``.
    """
    roots = components(named_links(edges)) if roots is None else roots
    rows = edges.join(spans(edges), "vendor_id")
    top = F.min_by(F.struct("vendor_id", "share"), F.struct(-F.col("vendor_paid"), F.col("vendor_id")))
    shared = F.sum(F.when(F.col("agency_span") > 1, F.col("vendor_paid")).otherwise(0))
    found = rows.groupBy("agency").agg(F.count("*").alias("vendors"), F.first("agency_paid").alias("disbursed_total"), top.alias("_top"), F.sum(F.col("share") * F.col("share")).alias("hhi"), shared.alias("_shared"), F.max("agency_span").alias("widest_span")).where("disbursed_total > 0")
    sizes = roots.groupBy("root").agg(F.count("*").alias("component_size"), F.count_if(F.startswith("node", F.lit("A"))).alias("component_agencies"))
    of = roots.where(F.startswith("node", F.lit("A"))).join(sizes, "root").select(F.substr("node", F.lit(2)).alias("agency"), "component_size", "component_agencies")
    return found.join(of, "agency").select(
        "agency", "vendors", "disbursed_total", (F.col("disbursed_total") > floor).alias("above_floor"), F.col("_top.vendor_id").alias("top_vendor"), (F.col("_top.share") * 100).alias("top_share_pct"),
        "hhi", (F.col("_shared") / F.col("disbursed_total") * 100).alias("shared_exposure_pct"), "widest_span", "component_size", "component_agencies",
    )


def named_links(edges: DataFrame) -> DataFrame:
    """The edges as links of nodes A<agency> and V<vendor>."""
    return edges.select(F.concat(F.lit("A"), "agency").alias("a"), F.concat(F.lit("V"), F.col("vendor_id").cast("string")).alias("b"))


def structure_findings(works: DataFrame, paid: DataFrame, found: DataFrame, vendors: DataFrame, spanned: DataFrame) -> DataFrame:
    """Each work with its agency's place in the graph and its own vendors; ``hhi__why`` is not applicable without an edge.

    works: work_id, agency. paid: (work_id, vendor_id), repeats allowed. found: of ``structure``. vendors: (vendor_id,
    vendor_name). spanned: of ``spans``. work_vendors is an array of (vendor_id, vendor_name, agency_span), by id.
    """
    known = spanned.join(vendors, "vendor_id", "left")
    own = paid.where("vendor_id is not null").distinct().join(known, "vendor_id", "left")
    own = own.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("vendor_id", "vendor_name", "agency_span"))).alias("work_vendors"))
    named = found.join(vendors.select(F.col("vendor_id").alias("top_vendor"), F.col("vendor_name").alias("top_vendor_name")), "top_vendor", "left")
    rows = works.select("work_id", "agency").join(named, "agency", "left").join(own, "work_id", "left")
    return rows.withColumn("hhi__why", F.when(F.col("hhi").isNull(), NOT_APPLICABLE).otherwise(PUBLISHED))


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that links (a, b) reach.

    Each round joins nodes to the smallest label among their neighbours, then follows labels of labels, so the number
    of rounds grows with the logarithm of a component's width. Rounds are written to the shared folder.
    """
    both = materialised(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-links")
    labels = materialised(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "graph-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        step = step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
        step = materialised(step, "graph-labels")
        labels = step.select("node", "root")
        if not step.where("old <> root").limit(1).count():
            return labels
