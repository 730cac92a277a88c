"""Findings that stand beside a case and never move its score."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_APPLICABLE, PUBLISHED, cluster_id

#: What may be attached; none of it is read by a rule.
KINDS = ("duplicate_cluster", "statistical_outlier", "delay_risk", "vendor_concentration_graph")
#: What a badge must not change.
SCORED = ("score", "raw_score", "severity", "coverage_pct", "bonus")


def model_version(prefix: str, parameters: dict) -> str:
    """A name for what a model was made with: the prefix and twelve hex digits of the parameters' sorted JSON."""
    return f"{prefix}-{hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:12]}"


def finding(rows: DataFrame, kind: str, value: str, why: str, version: str, payload: tuple[str, ...] = ()) -> DataFrame:
    """(work_id, kind, value, why, model_version, feeds_score, payload_json); an error where a value is there without being published, or not there though it is.

    payload_json holds the availability, then the named columns; one that is null is left out.
    """
    if kind not in KINDS:
        raise ValueError(f"no badge {kind}")
    fault = F.col(value).isNotNull() != (F.col(why) == PUBLISHED)
    sound = F.when(F.coalesce(fault, F.lit(True)), F.raise_error(F.lit(f"a {kind} and its reason contradict each other"))).otherwise(F.col(value).cast("double"))
    return rows.select("work_id", F.lit(kind).alias("kind"), sound.alias("value"), F.col(why).alias("why"), F.lit(version).alias("model_version"), F.lit(False).alias("feeds_score"), F.to_json(F.struct(F.col(why).alias("availability"), *payload)).alias("payload_json"))


#: What each kind of finding tells beside its value.
PAYLOADS = {
    "duplicate_cluster": ("cluster_id", "first_work", "cited", "best"),
    "statistical_outlier": ("flagged", "confirms", "peer_size", "missing_features"),
    "delay_risk": ("population", "elapsed_days", "risk_percentile", "outcome"),
    "vendor_concentration_graph": ("agency", "vendors", "disbursed_total", "above_floor", "top_vendor", "top_vendor_name", "top_share_pct", "shared_exposure_pct", "widest_span", "component_size", "component_agencies", "work_vendors"),
}


def findings(parts: dict[str, tuple[DataFrame, str, str, dict]]) -> DataFrame:
    """All findings as one table. parts: by kind, rows with that kind's payload, the value's column, the reason's, and the model's parameters."""
    made = [finding(rows, kind, value, why, model_version(kind, parameters), PAYLOADS[kind]) for kind, (rows, value, why, parameters) in parts.items()]
    return reduce(DataFrame.unionByName, made)


def delay_outcome(horizon_days: float) -> Column:
    """What became of a work that gets no risk: how long it took against the horizon, or that the horizon is past; null for open works."""
    done = F.when(F.col("execution_days") > horizon_days, "exceeded").otherwise("within_horizon")
    return F.when(F.col("population") == "completed", done).when(F.col("population") == "past_horizon", "already_exceeded")


def fired_counts(cases: DataFrame) -> DataFrame:
    """(work_id, n_fired): the rules that fired on each case, the bonus among them."""
    fired = F.size(F.filter("trace", lambda t: t["status"] == "fired")) + (F.col("bonus") > 0).cast("int")
    return cases.select("work_id", fired.alias("n_fired"))


def cluster_findings(works: DataFrame, clusters: DataFrame) -> DataFrame:
    """(work_id, cluster_id, works, first_work, works__why): the exact cluster of each work; not applicable where its text doesn't repeat."""
    rows = works.select("work_id", F.when(F.col("agency").isNotNull() & F.col("description_key").isNotNull(), cluster_id("agency", "description_key")).alias("cluster_id"))
    rows = rows.join(clusters.select("cluster_id", "works", "first_work"), "cluster_id", "left")
    return rows.select("work_id", F.when(F.col("works").isNotNull(), F.col("cluster_id")).alias("cluster_id"), "works", "first_work", F.when(F.col("works").isNull(), NOT_APPLICABLE).otherwise(PUBLISHED).alias("works__why"))


def attach(cases: DataFrame, findings: dict[str, DataFrame], on: str = "work_id") -> DataFrame:
    """The cases with ``<badge>_<column>`` for each column of each badge's findings; what is scored stays as it is.

    findings: by badge, a row for each work at most. A badge that has a scored column's name is refused.
    """
    for name, rows in findings.items():
        renamed = rows.select(F.col(on), *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != on])
        if clash := {c for c in renamed.columns if c != on} & set(cases.columns):
            raise ValueError(f"{name} would change {sorted(clash)}")
        cases = cases.join(renamed, on, "left")
    return cases


def confirms(flagged: str, n_fired: str = "n_fired"):
    """Whether a badge says again what a rule says; null where it isn't known how many rules fired."""
    return F.when(F.col(n_fired).isNotNull(), F.col(flagged) & (F.col(n_fired) > 0))
