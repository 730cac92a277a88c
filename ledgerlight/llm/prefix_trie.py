"""Conversation prefix trie: which turns conversations share, merged by family first.

A family is the conversations of one base id. Its conversations are cogrouped with the base one,
whose first turns they begin with, and make a small trie: a node for each distinct sequence of
turns, with how many of the family begin with it and which end there. Only these nodes are
shuffled on and merged to the trie of all; turns are digests in there, texts go no further than
their own task.

Sums over subtrees need no walk over depths: a node of the whole trie is counted in the family of
its smallest member, which knows all nodes above it; each family sums up its own small trie, and
the families' sums of a node are added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty, tidy

#: Conversations of a family: those whose ids agree but for the remainder by this; and the number that their lengths of borrowed turns are below.
FAMILY, HEADS = 100, 6
ROOT = bytes(16)


def borrowed(conv_id: str | Column, heads: int = HEADS) -> Column:
    """How many of its base conversation's turns a conversation begins with."""
    return F.crc32((F.col(conv_id) if isinstance(conv_id, str) else conv_id).cast("string")) % heads


def turns(conversations: DataFrame, family: int = FAMILY) -> DataFrame:
    """(base, conv_id, nil, turn, digest, chars) for each row: a turn's place, and its role and text as a digest."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256)), 1, 16)
    conv = F.col("conv_id").cast("long")
    return conversations.where(conv.isNotNull()).select((conv - conv % family).alias("base"), conv.alias("conv_id"), F.col("turn").isNotNull().alias("placed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"), borrowed(conv).alias("h"))


def _sequences(rows: pd.DataFrame) -> dict[int, list[tuple[bytes, int]]]:
    """Each conversation's turns in their order; turns of one place by their digests."""
    found: dict[int, list[tuple[bytes, int]]] = {}
    for conv, _, _, digest, chars in sorted(zip(rows["conv_id"], rows["placed"], rows["turn"], map(bytes, rows["digest"]), rows["chars"], strict=True)):
        found.setdefault(conv, []).append((digest, chars))
    return found


NODES = "key binary, base long, parent binary, depth long, chars long, conv_id long, n_convs long, ends string"


def family_trie(others: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one family's trie, from its rows but the base conversation's and from those of that one."""
    own = _sequences(others) | _sequences(base)
    heads = dict(zip(others["conv_id"], others["h"], strict=True)) | dict(zip(base["conv_id"], base["h"], strict=True))
    at = int((others if len(others) else base)["base"].iloc[0])
    first = own.get(at, [])
    nodes: dict[bytes, list] = {}
    for conv in sorted(own):
        h = int(heads[conv])
        key, parent = ROOT, None
        path = [(ROOT, None, 0)]
        for digest, chars in first[:h] + own[conv][h:]:
            key, parent = hashlib.blake2b(key + digest, digest_size=16).digest(), key
            path.append((key, parent, chars))
        for depth, (key, parent, chars) in enumerate(path):
            node = nodes.setdefault(key, [parent, depth, chars, int(conv), 0, []])
            node[4] += 1
        node[5].append(str(conv))
    rows = [(key, at, *node[:5], ",".join(node[5]) or None) for key, node in nodes.items()]
    return pd.DataFrame(rows, columns=["key", "base", "parent", "depth", "chars", "conv_id", "n_convs", "ends"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of one family's trie, of the nodes that are counted in the family."""
    rows = rows.sort_values("depth", ascending=False)
    sums = {bytes(k): [a, b] for k, a, b in zip(rows["key"], rows["leaves"], rows["saved"], strict=True)}
    for key, parent in zip(rows["key"], rows["parent"], strict=True):
        if parent is not None:
            mine, above = sums[bytes(key)], sums[bytes(parent)]
            above[0] += mine[0]
            above[1] += mine[1]
    return pd.DataFrame([(k, a, b) for k, (a, b) in sums.items() if a or b], columns=["key", "n_leaves", "saved_tokens"])


def ends_digests(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of all ids that end at a node, ascending. Families come in the order of their ids, so the text streams through."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for key, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != at:
                    if at is not None:
                        out.append((at, state.hexdigest()))
                    at, state = key, hashlib.sha256(ends.encode())
                else:
                    state.update(f",{ends}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["key", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    rows = nodes.where("ends is not null").select("key", "base", "ends").repartition("key").sortWithinPartitions("key", "base")
    return rows.mapInArrow(tidy(fold), "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, null turns come first; turns of one place (repeated rows too) are all there, in the
    order of their digests. Rows without a conversation id belong to none and are members of nothing. Very long texts
    are digested whole. Conversations left without turns end at the root. An empty table has no root and gives no rows;
    other columns are ignored. A family is one group, of at most ``family`` conversations on either side of 0; its rows
    hold a turn's digest and length, not its text.
    """
    rows = turns(conversations, family)
    others, bases = rows.where("conv_id != base"), rows.where("conv_id = base")
    small = stored(others.groupBy("base").cogroup(bases.groupBy("base")).applyInPandas(family_trie, NODES), "trie-families")
    merged = small.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"))
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stored(merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    counted = nodes.select("key", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    placed = small.select("key", "base", "parent", "depth").join(counted, ["key", "base"], "left").fillna(0, ["leaves", "saved"])
    sums = placed.groupBy("base").applyInPandas(_summed, "key binary, n_leaves long, saved_tokens long").groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, "parent", "left").join(sums, "key").join(ends_digests(small), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
