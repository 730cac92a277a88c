"""Sharding by longest-processing-time scheduling with a heap.

Groups that must stay together are taken from the largest down, each by the shard with
the least load so far. Groups of one size are alike, so the driver gets only how many
there are of each size, and says how many of them each shard takes: with sizes that add
up to B bytes there are fewer than the root of 2B different ones. Spark numbers the
groups of a size and gives each its shard. Every load then is what taking the groups one
by one gives, and differs from the least one by one group at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Parts of a shard, or of the groups of one size, that are counted apart, so that no task holds a whole one.
PARTS = 1 << 10
#: How many groups of a size each shard takes.
PLAN = pa.schema([("bytes", pa.int64()), ("_taken", pa.list_(pa.int64()))])


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """(size, groups for each shard) for (size, number of groups), which come from the largest size down.

    As if each group went to the least loaded shard, ties by number: while one shard is behind the others by whole
    groups it takes these at once, and while all are within one group, each takes one in turn.
    """
    heap = [(0, s) for s in range(shards)]
    most = 0
    for size, left in sizes:
        taken = [0] * shards
        while left:
            load, shard = heap[0]
            if most - load < size and left >= shards:
                rounds = left // shards
                heap = [(at + rounds * size, s) for at, s in heap]
                taken, left, most = [n + rounds for n in taken], left % shards, most + rounds * size
                continue
            behind = min(heap[1:3], default=(load, shard))[0] - load
            n = min(left, max(1, behind // size))
            heapq.heapreplace(heap, (load + n * size, shard))
            taken[shard], left, most = taken[shard] + n, left - n, max(most, load + n * size)
        yield size, taken


def _numbered(rows: DataFrame, key: str, order: list[str], parts: int) -> DataFrame:
    """Adds _no, from 0 without gaps within each key, counted in parts by a hash and then put after the parts before."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(key, "_part").agg(F.count("*").alias("_n")).select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(key, "_part").orderBy(*order))
    return rows.withColumn("_in", inside).join(offsets, [key, "_part"]).withColumn("_no", (F.col("_offset") + F.col("_in") - 1).cast("long")).drop("_part", "_offset", "_in")


def shard_documents(documents: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Size is the text's UTF-8 bytes plus 8. Rows with equal texts share a shard; null texts count as empty and so are
    one group with the empty ones. The law is ``bytes``, so grown_shard is null. slot counts each shard's rows from 0
    without gaps, in an order that depends on the rows only; rows that are repeated get slots of their own. An empty
    table gives an empty result; other columns are ignored.
    """
    raw = F.encode(text_or_empty(text_col), "UTF-8")
    rows = documents.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(raw, 256)).alias("_group"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = stored(rows, "shard-rows")  # without texts: each is hashed once
    groups = rows.groupBy("_group").agg(F.sum("size").alias("bytes"))  # few bytes of each row: made again where needed, not stored

    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.desc("bytes")).toLocalIterator()
    plan = [(size, taken) for size, taken in longest_first(((r["bytes"], r["n"]) for r in sizes), shards)]
    # As an Arrow table, which executors read without Python workers.
    plan = documents.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array([x[k] for x in plan], kind) for k, kind in enumerate(PLAN.types)], schema=PLAN))
    # The groups of a size go to shards in turn: the first ones to shard 0, as many as it takes, and so on.
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("_taken", 1, k), F.lit(0).cast("long"), lambda a, n: a + n))
    placed = _numbered(groups, "bytes", ["_group"], parts).join(plan.select("bytes", ends.alias("_ends")), "bytes").select("_group", F.size(F.filter("_ends", lambda e: e <= F.col("_no"))).alias("shard"))
    rows = _numbered(rows.join(placed, "_group"), "shard", ["_id", "text_crc32", "size"], parts)
    return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("_no").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
