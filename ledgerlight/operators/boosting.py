"""Boosted trees for a yes-or-no label, with a branch for missing values and unordered categories.

Values are put into bins once. For each level of a tree one aggregation sums the label's gradients
by node, feature and bin; these sums, whose number only the parameters bound, are all that reaches
the driver, which picks each node's split. A number is split at an edge between bins, a category
into two sets along the order of the categories' mean gradients, and rows without a value go to the
side that gains more. Nothing is filled in. The model is a column expression over the values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialised

#: Bins of a number, and categories of a feature; rarer categories count as missing.
BINS, CATEGORIES = 64, 255
#: Trees after which the rows' margins are stored anew, so that expressions don't grow with the number of trees.
STORE_EVERY = 10


@dataclass(frozen=True)
class Split:
    """Where a node's rows go: left where a number is below the edge or a category in the set, and where missing ones go."""

    feature: str
    edge: float | None
    left_set: tuple[str, ...] | None
    missing_left: bool
    left: Split | float
    right: Split | float
    known: tuple[str, ...] = ()

    def goes_left(self) -> Column:
        if self.left_set is not None:
            value = F.col(self.feature).cast("string")
            said, value = value.isin(*self.left_set), F.when(value.isin(*self.known), value)  # what the training rows didn't have is missing
        else:
            value = F.col(self.feature).cast("double")
            said, value = value < self.edge, F.when(~F.isnan(value), value)
        return F.when(value.isNull(), F.lit(self.missing_left)).otherwise(said)


def leaf_value(node: Split | float) -> Column:
    return F.lit(float(node)) if not isinstance(node, Split) else F.when(node.goes_left(), leaf_value(node.left)).otherwise(leaf_value(node.right))


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[Split | float, ...]

    def margin(self) -> Column:
        out = F.lit(self.base)
        for t in self.trees:
            out = out + leaf_value(t)
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


@dataclass(frozen=True)
class _Bins:
    edges: dict[str, list[float]]
    levels: dict[str, list[str]]


def _bins(rows: DataFrame, numbers: tuple[str, ...], categories: tuple[str, ...], bins: int) -> _Bins:
    """Edges at even shares of each number's rows; the CATEGORIES most frequent values of each category, in their order."""
    shares = [i / bins for i in range(bins + 1)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares, 100_000).alias(c) for c in numbers]).first() if numbers else {}
    edges = {c: sorted(set(found[c] or []))[1:] for c in numbers}  # at or above the least value nothing is left of it
    levels = {}
    for c in categories:
        top = rows.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(CATEGORIES).collect()
        levels[c] = sorted(str(r[0]) for r in top)
    return _Bins(edges, levels)


def _binned(rows: DataFrame, bins: _Bins) -> DataFrame:
    """A column of the bin's number for each feature, -1 where the value is missing."""
    for c, edges in bins.edges.items():
        if not edges:  # one value, or none
            rows = rows.withColumn(f"_bin_{c}", F.when(F.col(c).isNull(), -1).otherwise(0))
            continue
        value = rows.withColumn("_v", F.coalesce(F.col(c).cast("double"), F.lit(math.nan)))
        put = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_v", outputCol="_b", handleInvalid="keep")
        rows = put.transform(value).withColumn(f"_bin_{c}", F.when(F.isnan("_v"), -1).otherwise(F.col("_b").cast("int"))).drop("_v", "_b")
    for c, levels in bins.levels.items():
        rows = rows.withColumn(f"_bin_{c}", F.array_position(F.array(*map(F.lit, levels)), F.col(c).cast("string")).cast("int") - 1 if levels else F.lit(-1))
        rows = rows.withColumn(f"_bin_{c}", F.coalesce(f"_bin_{c}", F.lit(-1)))
    return rows


def _gain(g: float, h: float, smooth: float) -> float:
    return g * g / (h + smooth) if h + smooth > 0 else 0.0


def best_split(sums: dict[int, tuple[float, float, int]], ordered: bool, least_rows: int, smooth: float) -> tuple[float, list[int], bool, tuple, tuple] | None:
    """(gain, bins on the left, whether missing rows are, sums of either side) for one node and feature, from (gradients, hessians, rows) by bin.

    Equal gains: the first in the bins' order, missing to the right. A side needs ``least_rows``; a split needs a gain.
    """
    none = sums.get(-1, (0.0, 0.0, 0))
    order = sorted(b for b in sums if b >= 0)
    if not ordered:
        order.sort(key=lambda b: (sums[b][0] / (sums[b][1] + 10), b))  # the mean gradient, drawn to 0 where rows are few
    whole = [sum(s[i] for s in sums.values()) for i in range(3)]
    best, before = None, _gain(whole[0], whole[1], smooth)
    g = h = 0.0
    n = 0
    for k, b in enumerate(order):
        g, h, n = g + sums[b][0], h + sums[b][1], n + sums[b][2]
        last = k == len(order) - 1
        for missing_left in (False, True) if none[2] else (False,):
            if last and missing_left:
                continue  # all on one side
            lg, lh, ln = (g + none[0], h + none[1], n + none[2]) if missing_left else (g, h, n)
            if min(ln, whole[2] - ln) < least_rows:
                continue
            gain = _gain(lg, lh, smooth) + _gain(whole[0] - lg, whole[1] - lh, smooth) - before
            if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                best = gain, order[: k + 1], missing_left, (lg, lh), (whole[0] - lg, whole[1] - lh)
    return best


def _grown(rows: DataFrame, bins: _Bins, depth: int, least_rows: int, smooth: float, rate: float) -> Split | float:
    """One tree over rows with _g and _h, level by level."""
    names = [*bins.edges, *bins.levels]
    tree: dict[int, tuple] = {}
    leaves: dict[int, float] = {}
    node = F.lit(1)
    open_ = {1}
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_bin_{c}").alias("b")) for i, c in enumerate(names)])
    for _ in range(depth):
        placed = rows.withColumn("_node", node).where(F.col("_node").isin(*open_))
        sums: dict[int, dict[int, dict[int, tuple]]] = {}
        for r in placed.select("_node", "_g", "_h", F.explode(pairs).alias("p")).groupBy("_node", "p.f", "p.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count("*").alias("n")).collect():
            sums.setdefault(r["_node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"], r["n"])
        grown = set()
        for at in sorted(open_ & set(sums)):
            options = [(s, f) for f in sorted(sums[at]) if (s := best_split(sums[at][f], names[f] in bins.edges, least_rows, smooth))]
            if options:
                (_, left, missing_left, *sides), f = max(options, key=lambda o: (o[0][0], -o[1]))
                tree[at] = names[f], left, missing_left
                grown |= {2 * at, 2 * at + 1}
                for side, (g, h) in zip((2 * at, 2 * at + 1), sides, strict=True):  # what a side gives unless it is split again
                    leaves[side] = -rate * g / (h + smooth) if h + smooth > 0 else 0.0
        step = F.lit(None).cast("int")
        for at in sorted(grown & {2 * a for a in tree}):
            name, left, missing_left = tree[at // 2]
            b = F.col(f"_bin_{name}")
            step = F.when(node == at // 2, F.when(b.isin(*left) | (b == -1) if missing_left else b.isin(*left), at).otherwise(at + 1)).otherwise(step)
        node, open_ = step, grown
        if not open_:
            break

    def made(at: int) -> Split | float:
        if at not in tree:
            return leaves.get(at, 0.0)
        name, left, missing_left = tree[at]
        if name in bins.edges:
            k = max(left)
            return Split(name, bins.edges[name][k] if k < len(bins.edges[name]) else math.inf, None, missing_left, made(2 * at), made(2 * at + 1))
        return Split(name, None, tuple(bins.levels[name][b] for b in sorted(left)), missing_left, made(2 * at), made(2 * at + 1), tuple(bins.levels[name]))

    return made(1)


def fit(rows: DataFrame, label: str, numbers: tuple[str, ...], categories: tuple[str, ...] = (), trees: int = 20, depth: int = 3, rate: float = 0.1, bins: int = BINS, least_rows: int = 20, smooth: float = 1.0) -> Boosted:
    """The model of a label of 0 and 1 from its rows; null labels are left out, nulls and NaN of features are missing values.

    A table without both labels gives the constant of the one there is (a margin of 10 either way; 0 without rows).
    Rows that repeat count as often as they are there. Trees go level by level, features in the order given where gains
    are equal, so the same rows give the same model.
    """
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in numbers], *[F.col(c).cast("string").alias(c) for c in categories])
    share, n = rows.agg(F.avg("_y"), F.count("*")).first()
    if not n or share in (0.0, 1.0):
        return Boosted(0.0 if not n else 10.0 if share else -10.0, ())
    base = math.log(share / (1 - share))
    cut = _bins(rows, numbers, categories, bins)
    held = materialised(_binned(rows, cut).withColumn("_m", F.lit(base)), "boost-rows")
    grown: list[Split | float] = []
    recent: list[Split | float] = []
    for _ in range(trees):
        margin = F.col("_m")
        for t in recent:
            margin = margin + leaf_value(t)
        p = 1 / (1 + F.exp(-margin))
        tree = _grown(held.withColumn("_p", p).withColumn("_g", F.col("_p") - F.col("_y")).withColumn("_h", F.col("_p") * (1 - F.col("_p"))), cut, depth, least_rows, smooth, rate)
        if not isinstance(tree, Split):
            break
        grown.append(tree)
        recent.append(tree)
        if len(recent) == STORE_EVERY:
            held, recent = materialised(held.withColumn("_m", margin + leaf_value(tree)), "boost-rows"), []
    return Boosted(base, tuple(grown))
