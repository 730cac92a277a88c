"""How many rows the join on shingles makes of a list: in proportion to its members, not to their pairs."""

import numpy as np
import pyarrow as pa

from ledgerlight.llm import ngram_join
from ledgerlight.llm.components import connected_components


def rows_of(step, **columns):
    batch = pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns.values()], list(columns))
    return [r for b in step(iter([batch])) for r in b.to_pylist()]


def test_a_short_list_makes_pairs_with_its_leader_only():
    k = np.arange(40)
    rows = rows_of(ngram_join._candidates, entry=k * 0 + 8, name=k + 100, n=k * 0 + 50, rare=k)
    assert sorted((r["a"], r["b"]) for r in rows if r["b"] is not None) == [(100, 100 + i) for i in range(1, 40)]
    assert len(rows) <= 2 * len(k)


def test_two_groups_that_share_a_passage_are_not_written_out_in_pairs():
    k = np.arange(50)
    root = np.where(k < 30, 1, 2)
    rows = rows_of(ngram_join._divided, entry=k * 0 + 8, name=k + 100, n=k * 0 + 50, root=root, open=k * 0 + 20)
    assert len(rows) <= len(k)
    assert {r["a"] for r in rows} == {100 + i for i in range(30, 50)} and {r["b"] for r in rows} == {1}


def test_texts_alone_of_their_components_are_paired():
    rows = rows_of(ngram_join._divided, entry=[8] * 3 + [10] * 3, name=[1, 2, 3] * 2, n=[50] * 6, root=[1, 2, 3] * 2, open=[20] * 6)
    assert {(r["a"], r["b"]): r["shared"] for r in rows} == {(1, 2): 2, (1, 3): 2, (2, 3): 2}


def test_components_are_found_in_few_jobs(spark):
    links = [(100, k) for k in range(8, 60)] + [(k, k + 1) for k in range(200, 204)] + [(5, 5)]
    spark.sparkContext.setJobGroup("components", "links of a star, a chain and one of a node to itself")
    try:
        got = {tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(k, 8) for k in [*range(8, 60), 100]} | {(k, 200) for k in range(200, 205)}
    assert jobs <= 30  # 26; 37 where the plan of a step had its links at 16 places, now 4, and a job of its own asked whether it changed any
