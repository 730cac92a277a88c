"""Works that share a case id, which has ten hex digits of a hash: each stays a case of its own, as in the SQL."""

import os
import shutil
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import audit, scope
from ledgerlight.plans import build, corpus
from ledgerlight.plans.oracles import ORACLE_SQL
from ledgerlight.plans.reading import QUERIES

SF = "/root/testdata/sf0.001"
#: (member, year, order) of two works each whose ids give the same case id.
SHARED = [
    ((290819, 1995, 2888393), (552374, 1999, 5514851)), ((744357, 2000, 7403367), (13089, 1995, 76238)), ((708638, 2000, 7083395), (665626, 2001, 6657061)), ((439847, 1996, 4464646), (494943, 1996, 4929828)),
    ((315057, 1995, 3264403), (71672, 2000, 610382)), ((845026, 1999, 8446800), (157614, 1997, 1631220)), ((686551, 1995, 6784436), (520679, 2001, 5108074)), ((719990, 1998, 7109961), (291018, 2001, 2884703)),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The tables with these works besides, each with the figures of some order of its own; half of them are of EUROPE's members."""
    out, db = str(tmp_path_factory.mktemp("shared")), duckdb.connect()
    for name in os.listdir(SF):
        shutil.copyfile(f"{SF}/{name}", f"{out}/{name}")
    works = [w for pair in SHARED for w in pair]
    db.execute("create table more (nth int, member bigint, year int, work bigint)")
    db.executemany("insert into more values (?, ?, ?, ?)", [(i, *w) for i, w in enumerate(works)])
    db.execute(f"create table old as select *, row_number() over (order by o_orderkey) - 1 as nth from (select * from '{SF}/orders.parquet' where o_orderkey in (select l_orderkey from '{SF}/lineitem.parquet'))")
    db.execute(f"create table european as select n_nationkey from '{SF}/nation.parquet' join '{SF}/region.parquet' on n_regionkey = r_regionkey where r_name = 'EUROPE'")
    written = {
        "customer": f"select * from '{SF}/customer.parquet' union all select member, 'Customer', case when nth % 2 = 0 then (select min(n_nationkey) from european) else (select min(n_nationkey) from '{SF}/nation.parquet' where n_nationkey not in (from european)) end, 100.0 + nth, 'BUILDING' from more",
        "orders": f"select * from '{SF}/orders.parquet' union all select work, member, o_orderstatus, o_totalprice, make_timestamp(year, 6, 1 + m.nth, 0, 0, 0.0), o_orderpriority from more m join old o on o.nth = 3 * m.nth",
        "lineitem": f"select * from '{SF}/lineitem.parquet' union all select l.* replace (work as l_orderkey) from more m join old o on o.nth = 3 * m.nth join '{SF}/lineitem.parquet' l on l_orderkey = o_orderkey",
    }
    for name, sql in written.items():
        db.execute(f"copy ({sql}) to '{out}/{name}.parquet' (format parquet)")
    return out


def by_sql(folder, name):
    db = duckdb.connect()
    for table in os.listdir(folder):
        db.execute(f"create view {table.split('.')[0]} as select * from '{folder}/{table}'")
    found = db.execute(ORACLE_SQL[name])
    return [c[0] for c in found.description], found.fetchall()


def assert_as_sql(spark, folder, name, columns=None):
    names, rows = by_sql(folder, name)
    at = [names.index(c) for c in columns or names]
    got = QUERIES[name](spark, folder).select(*[names[i] for i in at]).collect()
    assert Counter(tuple(str(v) for v in r) for r in got) == Counter(tuple(str(r[i]) for i in at) for r in rows)


def test_the_log_has_each_event_of_both_works_once(spark, folder):
    shared = corpus.scored_cases(spark, folder).groupBy("case_id").count().where("count > 1")
    assert shared.count() == len(SHARED)
    assert_as_sql(spark, folder, "build_counts")


def test_events_of_two_works_are_one_sound_chain(spark, folder):
    assert_as_sql(spark, folder, "audit_log_hashes", ["case_id", "id", "event"])
    assert audit.broken(build.opening_log(corpus.scored_cases(spark, folder))).count() == 0


def test_recomputed_cases_are_compared_work_by_work(spark, folder):
    assert_as_sql(spark, folder, "recompute_diff")


def test_snapshots_list_what_moved_under_a_case_id(spark, folder):
    assert_as_sql(spark, folder, "recompute_snapshots")


def test_a_case_id_lets_nobody_see_the_other_work(spark, folder):
    assert_as_sql(spark, folder, "scoped_tables")
    who, cases = scope.Principal(scope.STATE, "EUROPE"), corpus.scored_cases(spark, folder)
    seen = scope.visible("hits", {"hits": corpus.hits(spark, folder), "cases": cases}, who)
    assert seen.join(cases.where(F.col("state") == "EUROPE").select("work_id"), "work_id", "left_anti").count() == 0


def test_statuses_of_traces_are_compared_work_by_work(spark, folder):
    assert_as_sql(spark, folder, "trace_diff")


def test_fields_of_traces_are_compared_work_by_work(spark, folder):
    assert_as_sql(spark, folder, "trace_diff_fields")
    cases = corpus.scored_cases(spark, folder).withColumn("again", F.filter("trace", lambda t: t["rule_id"] != "stalled_work"))
    gone = audit.diff_within(cases, "trace", "again", ("status",))
    assert gone.count() == cases.count() == gone.where("rule_id = 'stalled_work' and before is not null and after is null").count()
