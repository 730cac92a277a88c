"""Who may see what: row predicates by principal, grains, ranked and searched lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINISTRY, STATE, DISTRICT, MEMBER = "ministry", "state", "district", "member"
#: Grains that each role may ask aggregates for.
MAY_ASK = {MINISTRY: {"national", "state", "district", "member"}, STATE: {"state", "district"}, DISTRICT: {"district"}, MEMBER: {"member"}}
#: Roles that may write notes, acknowledge and escalate.
WRITERS = {MINISTRY, STATE, DISTRICT}
RANKING = (F.desc, "score"), (F.desc, "raw_score"), (F.desc, "coverage_pct"), (F.asc, "case_id")
SEARCHED = ("work_id", "case_id", "state", "district", "agency", "description")


@dataclass(frozen=True)
class Principal:
    role: str
    state: str | None = None
    district: str | None = None
    member: int | None = None


def predicate(who: Principal) -> Column:
    """The rows that a principal may see; it goes into the plan before everything else and so to the scan."""
    if who.role == MINISTRY:
        return F.lit(True)
    if who.role == STATE:
        return F.col("state") == who.state
    if who.role == DISTRICT:
        return (F.col("state") == who.state) & (F.col("district") == who.district)
    if who.role == MEMBER:
        return F.col("member") == who.member
    raise PermissionError(f"no role {who.role}")


def scoped(rows: DataFrame, who: Principal) -> DataFrame:
    return rows.where(predicate(who))


#: How a table's rows come into scope: by their own columns, or by those of the row that their key names in another table.
PATHS: dict[str, tuple[str, str] | None] = {
    "works": None, "cases": None, "payments": ("work_id", "works"), "hits": ("case_id", "cases"), "alerts": ("case_id", "cases"), "audit_log": ("case_id", "cases"),
}


def visible(name: str, tables: dict[str, DataFrame], who: Principal) -> DataFrame:
    """The rows of a table that a principal may see, in its columns; a table without a path is denied to all.

    The predicate goes to the scan of the table that holds places and members, and other tables are kept to its keys, so
    a row whose key is null or names nothing is seen by the ministry alone. Where both tables have works, these must agree
    too: two works can share a case id, and one of them can be out of scope.
    """
    if name not in PATHS:
        raise PermissionError(f"no scope is known for {name}")
    rows, path = tables[name], PATHS[name]
    if path is None or who.role == MINISTRY:
        return rows.where(predicate(who))
    key, through = path
    keys = [key, *(["work_id"] if key != "work_id" and "work_id" in rows.columns and "work_id" in tables[through].columns else [])]
    return rows.join(visible(through, tables, who).select(*keys), keys, "left_semi").select(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns])


def require_grain(who: Principal, grain: str, state: str | None = None, district: str | None = None, member: int | None = None) -> None:
    """Raises PermissionError unless the role may ask for the grain and for this value of it."""
    own = {"state": (who.state, state), "district": (who.district, district), "member": (who.member, member)}
    if grain not in MAY_ASK.get(who.role, ()):
        raise PermissionError(f"{who.role} may not ask for {grain}")
    for mine, asked in own.values():
        if who.role != MINISTRY and mine is not None and asked is not None and mine != asked:
            raise PermissionError(f"{asked} is out of scope")


def require_write(who: Principal) -> None:
    if who.role not in WRITERS:
        raise PermissionError(f"{who.role} may only read")


def district_states(works: DataFrame, district: str) -> DataFrame:
    return works.where(F.col("district") == district).groupBy("state").agg(F.count("*").alias("works")).orderBy("state")


def resolve_state(works: DataFrame, district: str, who: Principal) -> str:
    """The state of a district's name for this principal; a name in several visible states is an error that lists them."""
    names = [r["state"] for r in district_states(scoped(works, who), district).collect()]
    if len(names) != 1:
        raise LookupError(f"{district} is in {names or 'no state'}")
    return names[0]


def ambiguous_names(works: DataFrame) -> DataFrame:
    return works.groupBy("district").agg(F.countDistinct("state").alias("states")).where("states > 1")


def ranked(cases: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in triage order, which is total: the worst scores first, then the best covered, then by id."""
    return cases.orderBy(*[way(c) for way, c in RANKING]).offset(offset).limit(limit)


def listed(cases: DataFrame, who: Principal, severity: str | None = None, state: str | None = None, district: str | None = None, agency: str | None = None, status: str | None = None, synthetic: bool = False, term: str | tuple[str, ...] | None = None) -> DataFrame:
    """The scoped and filtered cases; a search term, or any of several, is looked for in six columns, before any limit."""
    rows = scoped(cases, who)
    if not synthetic:
        rows = rows.where("not is_synthetic")
    for column, value in (("severity", severity), ("state", state), ("district", district), ("agency", agency), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if term:
        found = F.lit(False)
        for c in SEARCHED:
            for t in (term,) if isinstance(term, str) else term:
                found |= F.coalesce(F.lower(c).contains(t.lower()), F.lit(False))
        rows = rows.where(found)
    return rows


def busiest(cases: DataFrame, column: str) -> DataFrame:
    """The value with the most HIGH cases, then most cases, then first by name."""
    return cases.groupBy(column).agg(F.count("*").alias("cases"), F.count_if(F.col("severity") == "HIGH").alias("high")).orderBy(F.desc("high"), F.desc("cases"), column).limit(1)


def redacted(events: DataFrame, who: Principal) -> DataFrame:
    """Audit events as the principal may read them: members don't see the text of notes."""
    hide = F.lit(who.role == MEMBER) & (F.col("event") == "NOTE_ADDED")
    return events.withColumn("redacted", hide).withColumn("text", F.when(~hide, F.col("text")))
