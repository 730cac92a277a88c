"""The alerts' state machine against a sequential fold, with one alert that has most events."""

import random
from collections import Counter

import pytest

from ledgerlight.operators import alerts


def fold(events):
    out = {}
    for case, kind, seq, action in sorted(events, key=lambda e: (e[0] or "", e[1], e[2] is not None, e[2] or 0, alerts.ACTIONS.index(e[3]))):
        status, refused = out.get((case, kind), ("none", Counter()))
        if (status, action) in alerts.MOVES:
            status = alerts.MOVES[status, action]
        else:
            refused[f"{status}:{action}"] += 1
        out[case, kind] = status, refused
    return {k: (s, sum(c.values()), ",".join(sorted(f"{m}={n}" for m, n in c.items()))) for k, (s, c) in out.items()}


def test_statuses_are_those_of_a_sequential_fold(spark):
    rng = random.Random(6)
    named = [("a", ["raise", "close"]), ("b", ["raise", "acknowledge", "close", "escalate"]), ("c", ["escalate"]), ("d", ["raise", "raise", "escalate", "escalate", "acknowledge", "close", "close"])]
    rows = [(case, "k", i, action) for case, actions in named for i, action in enumerate(actions)]
    rows += [(rng.choice(["x", "y", None]), rng.choice("kl"), rng.choice([None, *range(30)]), rng.choice(alerts.ACTIONS)) for _ in range(150)]
    rows += [("hot", "k", i, rng.choice(alerts.ACTIONS)) for i in range(2000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "case_id string, kind string, seq long, action string")
    got = {(r["case_id"], r["kind"]): (r["status"], r["refused"], r["refused_moves"]) for r in alerts.current_status(frame.repartition(7)).collect()}
    assert got == fold(rows)
    assert got["a", "k"] == ("open", 1, "open:close=1") and got["b", "k"] == ("closed", 1, "closed:escalate=1") and got["c", "k"] == ("none", 1, "none:escalate=1") and got["d", "k"] == ("closed", 1, "escalated:acknowledge=1")
    assert alerts.current_status(frame.limit(0)).count() == 0
    with pytest.raises(Exception, match="no action reopen"):
        alerts.current_status(spark.createDataFrame([("a", "k", 1, "reopen")], frame.schema)).collect()
