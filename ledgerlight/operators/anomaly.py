"""Outlier badges: an isolation forest over complete feature vectors, with peer groups. It never moves a score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialised

# Fixed values of the model's settings.
TREES, SAMPLE, CONTAMINATION, SEED, PEER_FLOOR = 200, 256, 0.11, 7, 5
COLUMNS = (
    "sanctioned_amt", "variance_sanction_to_disbursement", "sanction_lag_days", "sanction_to_first_payment_days", "execution_days",
    "days_since_last_payment", "vendor_share_in_agency_pct", "mp_utilisation_pct", "payment_count",
)


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, trees: int = TREES, seed: int = SEED) -> list[list[tuple]]:
    """Trees as lists of nodes (column, split, left, right), or (-1, depth, 0, 0) for leaves; each on a sample of SAMPLE rows."""
    random, forest = np.random.default_rng(seed), []
    deepest = int(np.ceil(np.log2(max(2, min(SAMPLE, len(rows))))))
    for _ in range(trees):
        picked = rows[random.choice(len(rows), min(SAMPLE, len(rows)), replace=False)]
        nodes: list[tuple] = []

        def split(part: np.ndarray, depth: int, nodes=nodes) -> int:
            at = len(nodes)
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else ()
            if depth >= deepest or not len(spread):
                nodes.append((-1, depth + _average_path(len(part)), 0, 0))
                return at
            column = int(random.choice(spread))
            cut = float(random.uniform(part[:, column].min(), part[:, column].max()))
            nodes.append(())
            left = split(part[part[:, column] < cut], depth + 1)
            nodes[at] = (column, cut, left, split(part[part[:, column] >= cut], depth + 1))
            return at

        split(picked, 0)
        forest.append(nodes)
    return forest


def path_scores(rows: np.ndarray, forest: list[list[tuple]], sample: int) -> np.ndarray:
    """2 to the power of minus the mean path over the average path: near 1 for outliers."""
    total = np.zeros(len(rows))
    for nodes in forest:
        column, cut, left, right = (np.array([n[i] for n in nodes]) for i in range(4))
        at = np.zeros(len(rows), int)
        while (inner := column[at] >= 0).any():
            i = np.flatnonzero(inner)
            here = at[i]
            at[i] = np.where(rows[i, column[here]] < cut[here], left[here], right[here])
        total += cut[at]
    return 2 ** (-total / len(forest) / max(_average_path(sample), 1e-9))


def missing(columns: tuple[str, ...] = COLUMNS):
    """The names of the model's columns that are null in a row."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in columns]))


def anomaly_badges(features: DataFrame, columns: tuple[str, ...] = COLUMNS, peers: tuple[str, ...] = ("category", "state", "fy")) -> DataFrame:
    """(work_id, score, flagged, score__why, peer_size, missing_features): rows with a null among the columns, or in a group below the floor of
    peers, have no score and say so; nothing is imputed.

    The trees grow on the driver from a sample of TREES * SAMPLE rows by the order of a hash; they are of fixed size and go
    to all tasks. The threshold is the contamination quantile over all scored rows.
    """
    size = features.groupBy(*peers).agg(F.count("*").alias("peer_size"))
    rows = features.join(size, list(peers)).withColumn("missing_features", missing(columns)).withColumn("_whole", F.size("missing_features") == 0)
    numeric = [F.col(c).cast("double").alias(c) for c in columns]
    n = rows.where("_whole").count()
    share = min(1.0, TREES * SAMPLE / max(n, 1))
    sample = rows.where("_whole").where(F.shiftrightunsigned(F.xxhash64("work_id"), 1) <= min(2**63 - 1, int(share * 2**63))).select("work_id", *numeric).toPandas().sort_values("work_id")
    if not len(sample):
        return rows.select("work_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("flagged"), F.when(F.col("_whole"), "not_applicable").otherwise("not_published").alias("score__why"), "peer_size", "missing_features")
    matrix = sample[list(columns)].to_numpy(float)
    forest, size_of = grow(matrix), min(SAMPLE, len(matrix))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"work_id": frame["work_id"], "score": path_scores(frame[list(columns)].to_numpy(float), forest, size_of)})

    scores = materialised(rows.where("_whole").select("work_id", *numeric).mapInPandas(scored, "work_id string, score double"), "outlier-scores")
    limit = scores.agg(F.percentile_approx("score", 1 - CONTAMINATION, 100_000)).first()[0]
    out = rows.select("work_id", "peer_size", "missing_features", "_whole").join(scores, "work_id", "left")
    shown = F.when(F.col("peer_size") >= PEER_FLOOR, F.col("score"))
    return out.select("work_id", shown.alias("score"), (shown > limit).alias("flagged"), F.when(shown.isNotNull(), "published").when(~F.col("_whole"), "not_published").otherwise("not_applicable").alias("score__why"), "peer_size", "missing_features")


def confirmed(badges: DataFrame, fired: DataFrame) -> DataFrame:
    """Whether a flag agrees with the rules: flagged and some rule fired; null where the number of fired rules isn't known."""
    return badges.join(fired.select("work_id", "n_fired"), "work_id", "left").withColumn("confirms", F.col("flagged") & (F.col("n_fired") > 0))
