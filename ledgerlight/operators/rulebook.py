"""Rulebooks: rules as data, compiled to column expressions.

A rule compares one feature with one threshold. It fires, passes, or is skipped where
the feature has no value; then the reason for the missing value is the reason for the
skip. There is no nesting: conjunctions are separate rules whose weights add.
"""

from __future__ import annotations

import hashlib
import json
import operator
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge, "eq": operator.eq, "ne": operator.ne}
SQL_OPERATORS = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "eq": "=", "ne": "<>"}

#: Features that rules may read; the truth-valued ones are compared as such.
NUMERIC = (
    "variance_sanction_to_disbursement", "variance_disbursement_to_certification", "sanction_lag_days", "sanction_to_first_payment_days",
    "first_payment_to_completion_days", "execution_days", "days_since_last_payment", "vendor_share_in_agency_pct", "mp_utilisation_pct",
    "duplicate_similarity", "same_desc_same_agency_count", "payment_count",
)
TRUTHS = ("completed_without_payment", "asset_image_absent")
SCORE_CAP = 100
# Why a feature can have no value, and when a rule's own caveat is shown.
SKIP_REASONS = ("not_published", "published_zero", "not_applicable")
CAVEAT_WHEN = ("always", "fired")
#: What a fired rule cites: the works that it was judged against, the most similar first, and how similar that one is.
CITATION = "struct<matched: array<string>, score: double>"


@dataclass(frozen=True)
class Rule:
    id: str
    field: str
    operator: str
    threshold: float | bool
    weight: int
    severity: str = "medium"
    label: str = ""
    skip_caveats: dict = field(default_factory=dict, hash=False)
    caveat: str = ""
    caveat_when: str = "always"


@dataclass(frozen=True)
class Rulebook:
    version: str
    rules: tuple[Rule, ...]
    high: float = 75
    medium: float = 50
    bonus_id: str = "agency_pattern_bonus"
    bonus_weight: int = 10
    bonus_least: int = 3

    @property
    def weight_total(self) -> int:
        return sum(r.weight for r in self.rules)

    def by_field(self, name: str) -> Rule | None:
        return next((r for r in self.rules if r.field == name), None)


def loads(text: str) -> Rulebook:
    """A validated rulebook from YAML; raises ValueError with every fault found."""
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ValueError("a rulebook is a mapping")
    faults = []
    rules = raw.get("rules") or []
    for key in ("version", "rules", "severity_bands"):
        if key not in raw:
            faults.append(f"{key} is missing")
    ids = [r.get("id") for r in rules]
    faults += [f"rule {i} is there twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for r in rules:
        faults += [f"rule {r.get('id')}: {k} is missing" for k in ("id", "field", "operator", "threshold", "weight") if k not in r]
        if r.get("operator") not in OPERATORS:
            faults.append(f"rule {r.get('id')}: no operator {r.get('operator')}")
        if r.get("field") not in NUMERIC + TRUTHS:
            faults.append(f"rule {r.get('id')}: no feature {r.get('field')}")
        faults += [f"rule {r.get('id')}: no skip reason {reason}" for reason in r.get("skip_caveats") or {} if reason not in SKIP_REASONS]
        if r.get("caveat_when", "always") not in CAVEAT_WHEN:
            faults.append(f"rule {r.get('id')}: no caveat when {r.get('caveat_when')}")
    if faults:
        raise ValueError("; ".join(faults))
    bands, bonus = raw["severity_bands"], raw.get("corroboration") or {}
    made = tuple(Rule(r["id"], r["field"], r["operator"], r["threshold"], r["weight"], r.get("severity", "medium"), r.get("label", ""), r.get("skip_caveats") or {}, r.get("caveat", ""), r.get("caveat_when", "always")) for r in rules)
    return Rulebook(str(raw["version"]), made, bands.get("high", 75), bands.get("medium", 50), bonus.get("id", "agency_pattern_bonus"), bonus.get("weight", 10), bonus.get("min_high_cases", 3))


def load(path: str | Path) -> Rulebook:
    return loads(Path(path).read_text(encoding="utf-8"))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def next_version(version: str) -> str:
    """v1.0.0 becomes v1.1.0; other forms get .1 at the end."""
    m = re.fullmatch(r"(v?)(\d+)\.(\d+)\.(\d+)", version)
    return f"{m[1]}{m[2]}.{int(m[3]) + 1}.0" if m else f"{version}.1"


def edited(text: str, rules: dict[str, dict] | None = None, bands: dict | None = None, bonus_weight: int | None = None) -> str:
    """The YAML with thresholds, weights, bands or the bonus weight changed in place; comments and order stay.

    Raises ValueError if a named rule or key isn't there, or if anything else would change.
    """
    lines, wanted = text.split("\n"), {("rules", i, k): v for i, changes in (rules or {}).items() for k, v in changes.items()}
    if any(k not in ("threshold", "weight") for _, _, k in wanted):
        raise ValueError("only thresholds and weights of rules can be edited")
    wanted |= {("severity_bands", None, k): v for k, v in (bands or {}).items()}
    if bonus_weight is not None:
        wanted["corroboration", None, "weight"] = bonus_weight
    section, rule = None, None
    for n, line in enumerate(lines):
        if m := re.match(r"([a-z_]+):", line):
            section, rule = m[1], None
        if section == "rules" and (m := re.match(r"\s*- id:\s*(\S+)", line)):
            rule = m[1]
        if (m := re.match(r"(\s+)([a-z_]+):(\s*)([^#\s]+)(.*)$", line)) and (key := (section, rule if section == "rules" else None, m[2])) in wanted:
            lines[n] = f"{m[1]}{m[2]}:{m[3]}{json.dumps(wanted.pop(key))}{m[5]}"
    if wanted:
        raise ValueError(f"nothing to edit at {sorted(map(str, wanted))}")
    out = "\n".join(lines)
    loads(out)
    return out


def differences(before: Rulebook, after: Rulebook) -> list[tuple[str, str, object, object]]:
    """(rule, key, before, after) of what changed."""
    old, new = {r.id: r for r in before.rules}, {r.id: r for r in after.rules}
    found = [(i, k, getattr(old.get(i), k, None), getattr(new.get(i), k, None)) for i in sorted(old.keys() | new.keys()) for k in ("field", "operator", "threshold", "weight")]
    found += [("", k, getattr(before, k), getattr(after, k)) for k in ("high", "medium", "bonus_weight", "bonus_least")]
    return [x for x in found if x[2] != x[3]]


def published(book: Rulebook, text: str) -> tuple[Rulebook, dict]:
    """The next version of an edited rulebook and its row for the version table; nothing is scored again."""
    made = replace(loads(text), version=next_version(book.version))
    return made, {"version": made.version, "replaces": book.version, "sha256": digest(text), "yaml": text}


def publish(path: str | Path, text: str, log: Callable[[dict], None] | None = None) -> dict:
    """Puts an edited rulebook in the place of the one at ``path``, as its next version, and gives the version's row.

    The text is checked before anything is written. ``log`` writes the version's row and its audit event; the file is
    replaced after that, in one step, so a reader sees the old file or the new one and no version without a row.
    """
    path = Path(path)
    made, row = published(load(path), text)
    out = re.sub(r"(?m)^version:.*$", f"version: {json.dumps(made.version)}", text, count=1)
    loads(out)
    row |= {"yaml": out, "sha256": digest(out)}
    if log is not None:
        log(row)
    draft = path.with_name(f"{path.name}.new")
    draft.write_text(out, encoding="utf-8")
    os.replace(draft, path)
    return row


def trace(book: Rulebook) -> Column:
    """array<struct<rule_id, label, field, operator, status, raw_value, threshold, contribution, skip_reason, caveat, citation,
    severity, weight>>, a row for each rule.

    Values are compared as they are and rounded half to even to two places for display only. A skipped rule has the caveat
    for its reason, any other the rule's own, where it is shown always or the rule fired. citation is left for evidence.
    """
    rows = []
    for r in book.rules:
        value, why = F.col(r.field), F.col(f"{r.field}__why")
        hit = OPERATORS[r.operator](value, F.lit(r.threshold))
        status = F.when(value.isNull(), "skipped").when(hit, "fired").otherwise("passed")
        shown = value.cast("string") if r.field in TRUTHS else F.bround(value.cast("double"), 2).cast("string")
        caveats = F.create_map(*[F.lit(x) for pair in r.skip_caveats.items() for x in pair]) if r.skip_caveats else None
        none = F.lit(None).cast("string")
        own = F.lit(r.caveat) if r.caveat and r.caveat_when == "always" else F.when(status == "fired", r.caveat) if r.caveat else none
        caveat = F.when(value.isNull(), none if caveats is None else caveats[why]).otherwise(own)
        rows.append(
            F.struct(
                F.lit(r.id).alias("rule_id"), F.lit(r.label).alias("label"), F.lit(r.field).alias("field"), F.lit(r.operator).alias("operator"), status.alias("status"), shown.alias("raw_value"), F.lit(str(r.threshold).lower() if isinstance(r.threshold, bool) else str(float(r.threshold))).alias("threshold"),
                F.when(status == "fired", r.weight).otherwise(0).alias("contribution"), F.when(value.isNull(), why).alias("skip_reason"), caveat.alias("caveat"), F.lit(None).cast(CITATION).alias("citation"), F.lit(r.severity).alias("severity"), F.lit(r.weight).alias("weight"),
            )
        )
    return F.array(*rows)


def checked(features: DataFrame) -> DataFrame:
    """The rows, with an error for any feature that is null without a reason or has a reason not to be there."""
    faults = F.lit(False)
    for name in [c for c in features.columns if f"{c}__why" in features.columns]:
        faults |= F.coalesce(F.col(name).isNotNull() != (F.col(f"{name}__why") == "published"), F.lit(True))
    return features.where(F.when(faults, F.raise_error(F.lit("a feature and its reason contradict each other"))).otherwise(True).cast("boolean"))
