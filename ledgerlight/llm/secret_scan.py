"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame operations only.

Every version of a text is a blob, named by the SHA-256 of its bytes. A ledger holds,
for each pair of blob and rule version, the spans found. A run scans one copy of each
blob that has no such pair yet, appends what it found, and joins the ledger back to
all paths. A second run over the same history scans nothing; a new rule version or a
new blob is scanned alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

# Fixed values of the contract: the kinds in their order of listing, and what each must hold.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlaps; a match counts if group ``group`` has ``least`` code points.

    ``wanted`` is a regular expression with at least one match in any text that has a counting match: texts without one
    are passed over.
    """

    kind: str
    pattern: str
    group: int
    least: int
    wanted: str


#: The rules, in the order that breaks ties between spans that start together.
RULES = (
    Rule("assign", ASSIGN, 2, 6, ASSIGN),
    Rule("access", ACCESS, 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", HEX, 0, 24, "[0-9a-f]{24}"),
)
RULE_VERSION = "base-1"


def _pieces(text: Column, rule: Rule) -> Column:
    """Array of (gap, whole, tested): code points before a match since the last one, in it, and in its tested group."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    made = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("w"), tested.alias("t")),
        lambda x: F.struct(F.length(x["g"]).cast("long").alias("gap"), F.length(x["w"]).cast("long").alias("whole"), F.length(x["t"]).alias("tested")),
    )
    return F.when(text.rlike(rule.wanted), made).otherwise(F.array().cast("array<struct<gap:bigint,whole:bigint,tested:int>>"))


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, at, start, end) of every counting match in ``blobs`` (blob, text); at is the kind's place in ``rules``.

    Positions are running sums of lengths along the text's matches, made by a window: cost and memory stay linear in
    the number of matches, however many one text has. A blob may come several times: its equal matches count once.
    """
    from pyspark.sql import Window as W

    found = None
    for at, rule in enumerate(rules):
        rows = blobs.select("blob", F.posexplode(_pieces(F.col("text"), rule)).alias("no", "m")).select("blob", F.lit(at).alias("at"), "no", "m.gap", "m.whole", (F.col("m.tested") >= rule.least).alias("good"))
        found = rows if found is None else found.unionByName(rows)
    in_order = W.partitionBy("blob", "at").orderBy("no")
    found = found.withColumn("again", F.lag("no").over(in_order).eqNullSafe(F.col("no"))).where("not again")
    so_far = in_order.rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("whole")).over(so_far)
    kinds = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("at") + 1)
    return found.withColumn("end", end).where("good").select("blob", kinds.alias("kind"), "at", (F.col("end") - F.col("whole")).alias("start"), "end")


def scan_history(versions: DataFrame, path_cols: list[str], text_col: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings per path, new ledger rows).

    versions: any rows of path columns and a text; null texts are the empty blob. ledger: (blob, rule_version, counts,
    spans) of earlier runs. The new ledger rows are to be appended to it. Findings have the path columns, blob, counts
    (an array by rule) and spans (kind:start:end by start, then kind as listed, comma-joined). Repeated versions share
    one scan and each get a row. An empty history gives empty tables; columns of other names are ignored.
    """
    text = text_or_empty(text_col)
    paths = stored(versions.select(*[F.col(c).alias(f"_path{i}") for i, c in enumerate(path_cols)], F.sha2(text, 256).alias("blob")), "secrets-paths")

    names = [f"_path{i}" for i in range(len(path_cols))]
    unseen = paths.groupBy("blob").agg(F.min(F.struct(*names)).alias("first"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    # Only the small side is built into a table; the texts stream past it once, dealt by path. Rows that repeat both path
    # and text all pass.
    chosen = unseen.select("blob", *[F.col(f"first.{n}").alias(f"_at{i}") for i, n in enumerate(names)])
    texts = versions.select(*[F.col(c).alias(n) for n, c in zip(names, path_cols, strict=True)], text.alias("text")).withColumn("blob", F.sha2("text", 256))
    same = F.lit(True)
    for i, n in enumerate(names):
        same &= F.col(n).eqNullSafe(F.col(f"_at{i}"))
    chosen = chosen.withColumnRenamed("blob", "_blob").hint("shuffle_hash")
    blobs = texts.join(chosen, same & (F.col("blob") == F.col("_blob")), "left_semi").select("blob", "text")

    spans = find_spans(blobs, rules)  # a row that repeats path and text is a copy of its blob there
    each = F.array_sort(F.collect_list(F.struct("start", "at", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("span"))))
    counts = F.array(*[F.count_if(F.col("at") == i) for i in range(len(rules))])
    hits = spans.groupBy("blob").agg(counts.alias("counts"), F.array_join(F.transform(each, lambda s: s["span"]), ",").alias("spans"))
    none = F.array(*[F.lit(0).cast("long")] * len(rules))
    fresh = stored(
        unseen.select("blob")
        .join(hits, "blob", "left")
        .select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("counts", none).alias("counts"), F.coalesce("spans", F.lit("")).alias("spans")),
        "secrets-ledger",
    )
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule_version") == rule_version).select(*fresh.columns))
    findings = paths.join(known.drop("rule_version"), "blob").select(*[F.col(n).alias(c) for n, c in zip(names, path_cols, strict=True)], "blob", "counts", "spans")
    return findings, fresh
