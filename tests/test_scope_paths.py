"""Each table and each role: what is visible, against plain Python."""

import pytest

from ledgerlight.operators import scope

WHO = [scope.Principal(scope.MINISTRY), scope.Principal(scope.STATE, "S"), scope.Principal(scope.DISTRICT, "S", "D"), scope.Principal(scope.MEMBER, member=1)]


def _sees(who, row):
    state, district, member = row
    return {"ministry": True, "state": state == who.state, "district": (state, district) == (who.state, who.district), "member": member == who.member}[who.role]


@pytest.mark.parametrize("who", WHO, ids=lambda w: w.role)
def test_rows_of_all_tables_follow_their_paths(spark, who):
    works = [("w1", "c1", "S", "D", 1), ("w2", "c2", "S", "E", 2), ("w3", "c3", "T", "D", 1), ("w4", "c4", None, None, None)]
    base = spark.createDataFrame(works, "work_id string, case_id string, state string, district string, member long")
    keyed = lambda key, ids: spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"n long, {key} string")
    ids = {"payments": ["w1", "w1", "w3", "w4", "gone", None], "hits": ["c1", "c2", "c2"], "alerts": ["c3", "c1"], "audit_log": ["c4", None, "c1", "c1"]}
    tables = {"works": base, "cases": base} | {name: keyed("work_id" if name == "payments" else "case_id", x) for name, x in ids.items()}
    place = {w: tuple(rest) for w, _, *rest in works} | {c: tuple(rest) for _, c, *rest in works}
    for name in ("works", "cases"):
        assert {r["work_id"] for r in scope.visible(name, tables, who).collect()} == {w for w, *_ in works if _sees(who, place[w])}
    for name, given in ids.items():
        got = scope.visible(name, tables, who)
        assert got.columns == tables[name].columns
        assert sorted(r["n"] for r in got.collect()) == [i for i, x in enumerate(given) if who.role == "ministry" or x in place and _sees(who, place[x])]


def test_unknown_tables_and_roles_are_denied(spark):
    rows = spark.createDataFrame([("c",)], "case_id string")
    with pytest.raises(PermissionError):
        scope.visible("passwords", {"passwords": rows}, WHO[0])
    with pytest.raises(PermissionError):
        scope.visible("hits", {"hits": rows, "cases": rows}, scope.Principal("guest"))


def test_a_district_in_several_states_is_named_as_such(spark):
    rows = spark.createDataFrame([("A", "North", 1), ("B", "North", 2), ("A", "South", 3)], "state string, district string, member int")
    assert scope.resolve_state(rows, "South", scope.Principal(scope.MINISTRY)) == "A"
    assert scope.resolve_state(rows, "North", scope.Principal(scope.STATE, "B")) == "B"
    with pytest.raises(LookupError, match="'A', 'B'"):
        scope.resolve_state(rows, "North", scope.Principal(scope.MINISTRY))
    with pytest.raises(LookupError, match="no state"):
        scope.resolve_state(rows, "South", scope.Principal(scope.STATE, "B"))
