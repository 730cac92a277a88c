"""Alerts: an idempotent top-up over cases, an inbox in the order of work, and a state machine over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scope import Principal, require_write

STATUSES = ("open", "acknowledged", "escalated", "closed")
#: Where an escalation goes from each role.
ESCALATES_TO = {"district": "state", "state": "ministry"}


def new_alerts(cases: DataFrame, existing: DataFrame, kind: str = "high_severity") -> DataFrame:
    """Alerts for HIGH cases, synthetic ones left out, that have none of the kind; running it again adds nothing."""
    high = cases.where("severity = 'HIGH' and not is_synthetic").withColumn("kind", F.lit(kind))
    return high.join(existing.select("case_id", "kind"), ["case_id", "kind"], "left_anti")


def message() -> Column:
    return F.format_string("Case %s in %s (%s) scores %d; loudest rule: %s.", "case_id", "district", "state", F.col("score").cast("long"), F.coalesce("rule_id", F.lit("none")))


def inbox(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """Alerts whose case is there, the statuses in the order of work, then the worst scores."""
    rows = alerts.join(cases.select("case_id", "score"), "case_id")
    return rows.orderBy(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), F.desc("score"), "case_id")


def orphans(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    return alerts.join(cases.select("case_id"), "case_id", "left_anti")


#: What can be done to an alert, and where it goes from each status; what isn't here is refused. A repeated move changes nothing.
ACTIONS = ("raise", "acknowledge", "escalate", "close")
MOVES = {
    ("none", "raise"): "open", ("open", "raise"): "open", ("open", "acknowledge"): "acknowledged", ("acknowledged", "acknowledge"): "acknowledged", ("open", "escalate"): "escalated",
    ("acknowledged", "escalate"): "escalated", ("escalated", "escalate"): "escalated", ("acknowledged", "close"): "closed", ("escalated", "close"): "closed", ("closed", "close"): "closed",
}
_FROM = ("none", *STATUSES)


def _steps() -> tuple[Column, Column]:
    """For each action, after one another, where each status goes, and whether the move is refused."""
    to, refused = [], []
    for action in ACTIONS:
        for status in _FROM:
            to.append(_FROM.index(MOVES.get((status, action), status)))
            refused.append(int((status, action) not in MOVES))
    return F.array(*map(F.lit, to)), F.array(*map(F.lit, refused))


def _composed(first: Column, then: Column) -> Column:
    """One function from status to status after another, with the counts of refused moves on either way."""
    return F.transform(first, lambda x: F.struct(then[x["to"]]["to"].alias("to"), F.zip_with(x["refused"], then[x["to"]]["refused"], lambda a, b: a + b).alias("refused")))


def current_status(events: DataFrame) -> DataFrame:
    """(case_id, kind, status, refused, refused_moves) by folding events (case_id, kind, seq, action) in the order of seq.

    An event is a function from status to status, and functions compose whatever brackets are put around them: each task
    folds the run of an alert's events that it has, for every status that the run could begin in, and the runs of an alert
    are composed in their order. So an alert with most of all events is folded in many tasks. A refused move changes
    nothing and is counted; refused_moves names each kind with its number, as ``closed:escalate=2``. Null seqs come first,
    events of one seq in the order of their actions; an alert that was never raised has the status none; an unknown or
    null action is an error.
    """
    ids, n = ["case_id", "kind"], len(_FROM)
    known = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    action = F.when(F.coalesce(known, F.lit(0)) == 0, F.raise_error(F.concat(F.lit("no action "), F.coalesce("action", F.lit("null"))))).otherwise(known - 1).cast("int")
    rows = events.select(*ids, F.col("seq").isNotNull().alias("_placed"), "seq", action.alias("_a")).repartitionByRange(*ids, F.col("_placed"), F.col("seq"), F.col("_a"))
    runs = rows.groupBy(*ids, F.spark_partition_id().alias("_run")).agg(F.array_sort(F.collect_list(F.struct("_placed", "seq", "_a"))).alias("_events"))
    to, refused = _steps()
    same = F.array(*[F.struct(F.lit(i).alias("to"), F.array_repeat(F.lit(0).cast("long"), n * len(ACTIONS)).alias("refused")) for i in range(n)])

    def moved(f: Column, e: Column) -> Column:
        at = lambda x: e["_a"] * n + x["to"]
        return F.transform(f, lambda x: F.struct(to[at(x)].alias("to"), F.transform(x["refused"], lambda c, i: F.when(i == at(x), c + refused[at(x)]).otherwise(c)).alias("refused")))

    runs = runs.select(*ids, "_run", F.aggregate("_events", same, moved).alias("_f"))
    whole = runs.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("_run", "_f"))).alias("_runs"))
    end = F.aggregate("_runs", same, lambda f, r: _composed(f, r["_f"]))[0]
    names = F.array(*[F.lit(f"{s}:{a}") for a in ACTIONS for s in _FROM])
    said = F.array_sort(F.filter(F.zip_with(names, F.col("_end.refused"), lambda m, c: F.when(c > 0, F.concat(m, F.lit("="), c.cast("string")))), lambda x: x.isNotNull()))
    total = F.aggregate("_end.refused", F.lit(0).cast("long"), lambda x, c: x + c)
    return whole.select(*ids, end.alias("_end")).select(*ids, F.array(*map(F.lit, _FROM))[F.col("_end.to")].alias("status"), total.alias("refused"), F.array_join(said, ",").alias("refused_moves"))


def may_move(status: str, action: str, who: Principal) -> str:
    """The status after an action; raises if the role may not act or the alert may not move."""
    require_write(who)
    if MOVES.get((status, action), status) == status:
        raise ValueError(f"{status} alerts don't {action}")
    if action == "escalate" and who.role not in ESCALATES_TO:
        raise PermissionError(f"{who.role} has nobody to escalate to")
    return MOVES[status, action]
