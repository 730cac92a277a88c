"""Exact Jaccard join of documents on word shingles by token-combination prefixes.

Tokens (shingles) are put in one order: rare ones first, then frequent ones. Two sets
with Jaccard similarity of at least 3/4 share a token among the first n - ceil(3n/4) + 1
of each, its prefix. Rare tokens in a prefix are index entries by themselves. Frequent
tokens would make long lists, so they are split into groups, and pairs of tokens of one
group are the entries; the prefix is extended by one token for each group that it holds,
so that two similar sets share a rare token or two frequent tokens of one group. The
number of groups grows with the set, which keeps entries in proportion to it; sets whose
sizes can be similar share a grouping.

Texts with one set form a class and go through the join once. A list is sorted by the
share of rare tokens in its members: the first ones are nearest to the text that a group
of near copies goes back to, and lead all of the group's lists. A leader is compared with
all others of its list that sizes allow, which makes a pair for each member of a list, and
links whole groups. Other pairs matter only where components still divide a list. Those of
two texts that are each alone of their component are pruned by how many prefix tokens they
share. A text x that meets more of another component is not paired with each of these: it is
compared with one of them, the pivot p, and so are all of that component. What a text lacks
of p and has beyond p is its difference. The texts x and y share |x & p| + |y & p| - |p|
tokens, and one more for each element that their differences share. So if x is not similar to
p, it can only be similar to a y whose difference shares a known number of elements with
its own, and prefixes of the differences find these. Large groups of near copies are so not
expanded into their pairs, and no link between components is missed. All candidates
are verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import measured, shuffle_partitions, stored, tidy
from .components import connected_components
from .shingles import mixed, shingle_sets

#: Similar: OVER * union <= UNDER * intersection.
UNDER, OVER = 4, 3
#: Documents, counted by task, from which a token is frequent; and the most tokens that are (the most frequent ones).
#: This orders and groups tokens only: which pairs are found does not depend on it.
FREQUENT, MOST_FREQUENT = 32, 1 << 17
#: Members of an index list up to which one member leads it and shared lists are counted by pair.
SHORT = 40
#: Members of a longer list that lead it.
LEADERS = 3
#: Tokens whose counts a task holds before it merges them; classes whose entries a task remembers to have sent.
HELD = 1 << 21
#: Sets below this size use frequent tokens like rare ones; those that can be similar to such sets do both.
TINY = 8
#: Pairs in a part of those of one class; bits of the filter before the join with texts (8 bits to a byte).
PART, FILTER_BITS = 100, 1 << 23
_U = np.uint64


def _needed(n: int) -> int:
    """ceil(3n/4): what a set of n shares at least with any similar one."""
    return -(-OVER * n // UNDER)


def _least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many tokens of their prefixes similar sets of these sizes share at least.

    They share 3/7 of both sizes together, and the suffix of the larger holds fewer than 3/4 of it.
    """
    return -(-OVER * (n + m) // (OVER + UNDER)) - -(-OVER * np.maximum(n, m) // UNDER) + 1


def _class_of(tokens: np.ndarray) -> int:
    """A set's name: a 64-bit hash of all its tokens."""
    with np.errstate(over="ignore"):
        return int(np.sum(mixed(tokens * _U(0x9E3779B97F4A7C15) + _U(len(tokens))), dtype=_U).astype(np.int64))


def _frequent_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, count) of tokens that occur in two texts or more of a run of the task's texts; equal sets count once."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= 2
        return pa.RecordBatch.from_arrays([pa.array(tokens[often].astype(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "count"])

    for batch in batches:
        for tokens in shingle_sets(t.as_py() for t in batch.column(0)):
            if len(tokens) == 0 or (name := _class_of(tokens)) in seen:
                continue
            if len(seen) < HELD:
                seen.add(name)
            held.append(tokens)
            size += len(tokens)
            if size >= HELD:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def frequent_tokens(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """The sorted frequent tokens, at most MOST_FREQUENT of them (8 bytes each)."""
    counts = documents.select(text_col).mapInArrow(tidy(_frequent_here), "token long, count long").groupBy("token").agg(F.sum("count").alias("n"))
    rows = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(rows.column(0).combine_chunks().to_numpy().astype(np.int64).view(_U))


def _groups(level: int) -> int:
    return int((4 / 3) ** level / 8) + 1


def entries(tokens: np.ndarray, is_frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The index entries of a set, single tokens even and pairs odd numbers, and the number of frequent tokens in its prefix."""
    n = len(tokens)
    first = n - _needed(n) + 1
    rare, often = tokens[~is_frequent], tokens[is_frequent]
    if len(rare) >= first:
        return rare[:first] & ~_U(1), 0
    singles = [rare & ~_U(1)]
    if n <= TINY * UNDER // OVER:
        singles.append(often[: first - len(rare)] & ~_U(1))
    if n >= TINY:
        level = int(np.floor(np.log(n) / np.log(4 / 3) + 1e-9))
        for scheme in (level, level + 1):
            group = (mixed(often ^ _U(0xA5A5A5A5)) % _U(_groups(scheme))).astype(np.int64)
            # Each group in the prefix lengthens it by one token.
            length = first - len(rare)
            while (longer := min(len(often), first - len(rare) + len(np.unique(group[:length])))) > length:
                length = longer
            order = np.argsort(group[:length], kind="stable")
            mine, kept = group[:length][order], often[:length][order]
            for step in range(1, length):
                same = np.flatnonzero(mine[step:] == mine[:-step])
                if not len(same):
                    break
                singles.append(mixed(kept[same] * _U(0x9E3779B97F4A7C15) + mixed(kept[same + step]) + _U(scheme)) | _U(1))
    return np.concatenate(singles), first - len(rare)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, class, n, rare) rows sorted by entry, rare and class to (a, b, shared, entry, n): pairs (a, b) of a list's leader
    and another member, and with b null the members of lists of three or more.

    Lists pass by as a stream. A pair has a row for each short list, with shared 1 if that is of a single token; pairs of
    long lists come once from a run of lists, with shared 0. A member has shared 0 where it leads a short list: the list's
    pairs with it are all there.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "shared", "entry", "n")])
    held: list[np.ndarray] = []
    size = 0

    def sent(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows), 50_000):
            part = rows[k : k + 50_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(part[:, c]) for c in range(3)], none, none], schema=schema)

    for entry, name, n, _ in _runs(batches):
        begins = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        count = np.diff(np.append(begins, len(entry)))
        width, single = np.repeat(count, count), 1 - (entry & 1)
        place = np.arange(len(entry)) - np.repeat(begins, count)
        other = np.flatnonzero((width <= SHORT) & (place > 0))
        yield from sent(_pairs(name, n, other - place[other], other, single[other]))
        long = np.flatnonzero(width > SHORT)
        for leader in range(LEADERS) if len(long) else ():
            other = long[place[long] > leader]
            held.append(_pairs(name, n, other - place[other] + leader, other, np.zeros(len(other), np.int64)))
            size += len(held[-1])
        if size > 1 << 20:
            yield from sent(_summed(held))
            held, size = [], 0
        more = np.flatnonzero(width > 2)
        if len(more):
            left = ((place > 0) | (width > SHORT))[more].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name[more]), pa.nulls(len(more), pa.int64()), pa.array(left), pa.array(entry[more]), pa.array(n[more])], schema=schema)
    if held:
        yield from sent(_summed(held))


def _summed(pairs: list[np.ndarray]) -> np.ndarray:
    """A row for each pair, by the first two columns, with the sums of the others."""
    rows = np.concatenate(pairs)
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    at = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
    return np.concatenate([rows[at, :2], np.add.reduceat(rows[:, 2:], at)], axis=1)


def _pairs(name: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Rows (smaller class, larger class, shared) of those pairs that sizes allow."""
    fits = (UNDER * np.minimum(n[i], n[j]) >= OVER * np.maximum(n[i], n[j])) & (name[i] != name[j])
    a, b = name[i[fits]], name[j[fits]]
    return np.stack([np.minimum(a, b), np.maximum(a, b), shared[fits]], axis=1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted rows, cut so that rows of one entry stay together, without rows that repeat an entry and class."""
    rest: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        columns = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(columns[0]):
            continue
        cut = np.searchsorted(columns[0], columns[0][-1])
        if cut:
            rest.append(tuple(c[:cut] for c in columns))
            yield _distinct(rest)
            rest = []
        rest.append(tuple(c[cut:] for c in columns))
    if rest:
        yield _distinct(rest)


def _distinct(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    columns = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    fresh = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
    return tuple(c[fresh] for c in columns)


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, class, n, root, open) rows sorted by entry and class to what of a list its components divide.

    Where two texts are each alone of their components in the list: (a, b, shared, 0) with both classes, shared being the
    lists of single tokens in the task that have them so. Else, for each text of the one that has fewer: (class, root of the
    other, 0, 1). A pair's common prefix tokens are no more than what is open for either: where that is too few, nothing is sent.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "shared", "wide")])
    held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    size = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for wide, parts in enumerate(held):
            if parts:
                rows = _summed(parts)
                yield pa.RecordBatch.from_arrays([*[pa.array(rows[:, c]) for c in range(3)], pa.array(np.full(len(rows), wide))], schema=schema)
                parts.clear()

    for entry, name, n, root, free in _runs(batches):
        begins = np.append(np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])), len(entry))
        for lo, hi in zip(begins[:-1], begins[1:], strict=True):
            roots, group, counts = np.unique(root[lo:hi], return_inverse=True, return_counts=True)
            # The components by size, so that each text looks at those after its own.
            order = np.argsort(np.argsort(counts, kind="stable"), kind="stable")[group]
            alone = counts[group] == 1
            for i in np.flatnonzero(order < len(roots) - 1):
                j = np.flatnonzero(order > order[i])
                sizes, at = n[lo + j], n[lo + i]
                fits = (UNDER * np.minimum(sizes, at) >= OVER * np.maximum(sizes, at)) & (np.minimum(free[lo + i], free[lo + j]) >= _least_common(at, sizes))
                j = j[fits]
                if not len(j):
                    continue
                single = lo + j[alone[j]]
                if len(single):
                    held[0].append(_pairs(name, n, np.full(len(single), lo + i), single, np.full(len(single), 1 - (entry[lo] & 1))))
                wide = np.unique(root[lo + j[~alone[j]]])
                if len(wide):
                    held[1].append(np.stack([np.full(len(wide), name[lo + i]), wide, np.zeros(len(wide), np.int64)], axis=1))
                size += len(j)
                if size > 1 << 20:
                    yield from merged()
                    size = 0
    yield from merged()


def _index(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, class, n, often, rare, entries) for each row; entries is null where the task has sent those of the class
    before, key is the text's SHA-256 where there is no id, and rare is the part of rare tokens in a set, in 10,000ths."""
    frequent = frequent_tokens(documents, text_col)
    kind = documents.schema[id_col].dataType

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        marks = np.zeros(1 << 20, bool)
        marks[(frequent >> _U(44)).astype(np.int64)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, sizes, often, rare, lists = [], [], [], [], []
                for tokens in shingle_sets(t.as_py() for t in part.column(1)):
                    name = _class_of(tokens) if len(tokens) else None
                    names.append(name)
                    sizes.append(len(tokens))
                    if name is None or name in sent:
                        often.append(0)
                        rare.append(0)
                        lists.append(None)
                        continue
                    if len(sent) < HELD:
                        sent.add(name)
                    known = marks[(tokens >> _U(44)).astype(np.int64)]
                    if len(frequent) and known.any():
                        at_known = np.flatnonzero(known)
                        spot = np.minimum(np.searchsorted(frequent, tokens[at_known]), len(frequent) - 1)
                        known[at_known] = frequent[spot] == tokens[at_known]
                    found, count = entries(tokens, known)
                    often.append(count)
                    rare.append(int(np.count_nonzero(~known)) * 10_000 // len(tokens))
                    lists.append(found.view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in lists])]).astype(np.int32)
                values = np.concatenate([x for x in lists if x is not None] or [np.empty(0, np.int64)])
                none = pa.array([x is None for x in lists])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(often, pa.int64()), pa.array(rare, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=none)], ["id", "key", "class", "n", "often", "rare", "entries"])

    key = F.when(F.col(id_col).isNull(), F.sha2(text_col, 256)).alias("_key")
    return stored(documents.select(id_col, text_col, key).mapInArrow(tidy(build), f"id {kind.simpleString()}, key string, class long, n long, often long, rare long, entries array<long>"), "join-index")


def _passing(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Those rows whose key may be in ``wanted`` (one column): a Bloom filter of FILTER_BITS bits in a table of fixed size.

    It keeps most rows that a join would drop out of the join's shuffle. On inputs too large for it, all rows pass.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = wanted.select(F.pmod(F.xxhash64(wanted.columns[0]), F.lit(FILTER_BITS)).alias("bit"))
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    rows = rows.withColumn("_bit", bit).join(F.broadcast(maps), F.bitmap_bucket_number("_bit") == F.col("_bucket"))
    at = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return rows.where(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("long") % 2 == 1).drop("_bit", "_bucket", "_map")


def _compared(documents: DataFrame, id_col: str, text_col: str, index: DataFrame, pairs: DataFrame, step: Callable[[pa.Table, dict[int, np.ndarray]], pa.Table], kinds: str) -> DataFrame:
    """What ``step`` makes of pairs (a, b, and more columns) of classes and the sets of these.

    Pairs are dealt by the one of the two that is in more of them, so that its set is sent once for all; those of a class
    in many pairs are dealt in parts, by the other class, and its set is sent to each part.
    """
    asks = pairs.columns
    degrees = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("degree"))
    cells = pairs
    for side in ("a", "b"):
        cells = cells.join(degrees.select(F.col("class").alias(side), F.col("degree").alias(f"of_{side}")), side)
    by_a = F.struct("of_a", "a") >= F.struct("of_b", "b")
    cells = cells.select(*asks, F.when(by_a, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(by_a, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("of_a", "of_b").alias("degree"))
    part = F.pmod(F.xxhash64("other"), F.ceil(F.col("degree") / PART))
    cells = stored(cells.select(*asks, "home", "other", F.concat_ws(":", "home", part).alias("cell")), "join-cells")

    wanted = cells.select(F.col("home").alias("class"), "cell").distinct().unionByName(cells.select(F.col("other").alias("class"), "cell"))
    first = index.where("class is not null").groupBy("class").agg(F.min("id").alias("_id"), F.min("key").alias("_key"))
    wanted, seen = measured(wanted.groupBy("class").agg(F.collect_set("cell").alias("cells")).join(first, "class"), "join-wanted", F.count_if(F.col("_id").isNull()).alias("nameless"))
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    named, nameless = wanted.where("_id is not null").drop("_key"), wanted.where("_id is null").drop("_id")
    # Classes whose rows all have no id get a text by its hash; equal texts are brought to one before they are dealt.
    apart = None
    if seen["nameless"]:
        apart = texts.where("_id is null").select(F.sha2("_text", 256).alias("_key"), "_text")
        apart = _passing(apart, "_key", nameless.select("_key")).groupBy("_key").agg(F.first("_text").alias("_text"))
        apart = apart.join(nameless.hint("shuffle_hash"), "_key").select("_text", "class", "cells")
    texts = _passing(texts, "_id", named.select("_id")).join(named.hint("shuffle_hash"), "_id").select("_text", "class", "cells")
    texts = texts if apart is None else texts.unionByName(apart)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.string()), ("class", pa.int64()), ("tokens", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for tokens, name, places in zip(shingle_sets(t.as_py() for t in part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if len(tokens) and _class_of(tokens) == name:  # rows that repeat an id may hold other texts
                        data = tokens.tobytes()
                        out += [(place, name, data) for place in places]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def together(asked: pa.Table, sent: pa.Table) -> pa.Table:
        return step(asked.select(asks), {name: np.frombuffer(data.as_buffer(), _U) for name, data in zip(sent.column("class").to_pylist(), sent.column("tokens"), strict=True)})

    whole = texts.mapInArrow(tidy(sets), "cell string, class long, tokens binary")
    return cells.select(*asks, "cell").groupBy("cell").cogroup(whole.groupBy("cell")).applyInArrow(together, kinds)


def _counted(asked: pa.Table, tokens: dict[int, np.ndarray]) -> pa.Table:
    """The pairs with the sizes of both sets and of what they share."""
    sizes = []
    for x, y in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True):
        p, q = tokens[x], tokens[y]
        sizes.append((len(p), len(q), len(p) + len(q) - len(np.union1d(p, q))))
    for k, name in enumerate(("na", "nb", "both")):
        asked = asked.append_column(name, pa.array([x[k] for x in sizes], pa.int64()))
    return asked


def _differences(asked: pa.Table, tokens: dict[int, np.ndarray]) -> pa.Table:
    """For pairs (a, b, root, outside, reach, take) the first ``take`` elements of a's difference to b: what it has beyond b, as even
    numbers, which few others have, then what it lacks, as odd ones."""
    out: list[tuple[int, np.ndarray]] = []
    for x, y, take in zip(*[asked.column(c).to_pylist() for c in ("a", "b", "take")], strict=True):
        p, q = tokens[x], tokens[y]
        out.append(np.concatenate([np.setdiff1d(p, q, True) & ~_U(1), np.setdiff1d(q, p, True) | _U(1)])[:take].view(np.int64))
    rows = asked.select(["a", "root", "outside", "reach"]).take(pa.array(np.repeat(np.arange(len(out)), [len(x) for x in out])))
    return rows.append_column("element", pa.array(np.concatenate([np.empty(0, np.int64), *out]), pa.int64()))


def _similar(pairs: DataFrame) -> DataFrame:
    return pairs.where((UNDER + OVER) * F.col("both") >= OVER * (F.col("na") + F.col("nb"))).select("a", "b")


def _beside(compare: Callable[[DataFrame, Callable, str], DataFrame], wide: DataFrame, links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For texts and components (class, root) that they may belong to: links to pivots, and the pairs (a, b) with others of
    the component that can be similar by their differences to the pivot. Of a component, the text with most links is the pivot.

    A text beyond p by e tokens and without m of p's has a gap to p of 4m + 3e - |p|: above 0 if not similar. It is similar to
    another such text if their differences share (its gap + 4m' + 3e') / 7 elements or more; that text has m' + e'.
    """
    degrees = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    pivots = degrees.join(roots, "node").groupBy("root").agg(F.max_by("node", F.struct("degree", "node")).alias("b"))
    pivots = stored(pivots.join(wide.select("root").distinct(), "root", "left_semi"), "join-pivots")
    outside = wide.join(pivots, "root").select(F.col("class").alias("a"), "b", "root", F.lit(1).cast("long").alias("outside"))
    inside = roots.join(pivots, "root").where("node != b").select(F.col("node").alias("a"), "b", "root", F.lit(0).cast("long").alias("outside"))
    near = stored(compare(outside.unionByName(inside), _counted, "a long, b long, root long, outside long, na long, nb long, both long"), "join-near")
    near = near.withColumns({"m": F.col("nb") - F.col("both"), "e": F.col("na") - F.col("both")})
    near = near.withColumns({"gap": UNDER * F.col("m") + OVER * F.col("e") - F.col("nb"), "apart": UNDER * F.col("m") + OVER * F.col("e")})
    # What a text inside the component reaches: the gap up to which its own difference has as many elements as must be shared.
    near = near.withColumn("reach", F.when(F.col("outside") == 1, F.col("gap")).otherwise(OVER * F.col("m") + UNDER * F.col("e")))
    bounds = near.groupBy("root").agg(F.min(F.expr("if(outside = 1 and gap > 0, gap, null)")).alias("least_gap"), F.max(F.expr("if(outside = 0, reach, null)")).alias("most_reach"), F.min(F.expr("if(outside = 0, apart, null)")).alias("least_apart"))
    kept = near.join(bounds, "root").where("if(outside = 1, gap > 0 and gap <= most_reach, reach >= least_gap)")
    must = F.when(F.col("outside") == 1, F.col("gap") + F.col("least_apart")).otherwise(F.col("apart") + F.col("least_gap"))
    kept = kept.withColumn("take", F.col("m") + F.col("e") - F.ceil(must / (UNDER + OVER)) + 1).where("take > 0")
    kept = stored(kept.select("a", "b", "root", "outside", "reach", "take"), "join-apart")
    found = stored(compare(kept, _differences, "a long, root long, outside long, reach long, element long"), "join-differences")
    one, other = found.where("outside = 1").drop("outside"), found.where("outside = 0").select(F.col("a").alias("b"), "root", "element", F.col("reach").alias("reached"))
    pairs = one.join(other, ["root", "element"]).where("reach <= reached").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _similar(near.where("outside = 1")), pairs


def _possible(pairs: DataFrame, facts: DataFrame, uncounted: str) -> DataFrame:
    """Those of the pairs (a, b, shared) that can be similar by the tokens that their prefixes share (``_least_common``).

    ``uncounted`` bounds, for each class, the prefix tokens that ``shared`` doesn't count.
    """
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("class").alias(side), F.col("n").alias(f"n{side}"), F.col(uncounted).alias(f"open{side}")), side)
    both = F.ceil((F.col("na") + F.col("nb")) * OVER / (OVER + UNDER) - 1e-9)
    least = both - F.ceil(F.greatest("na", "nb") * OVER / UNDER) + 1
    return pairs.where(F.col("shared") + F.least("opena", "openb") >= least).select("a", "b")


def near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for each row; component_id is the smallest id that links can reach, itself included.

    Two texts are linked if 100 * shared >= 75 * all of their distinct five-word shingles. Texts of one to four words
    are one shingle; null and blank texts have none, are linked with nothing, and are their own component. Rows that
    repeat an id are rows of their own; if their texts differ, each has its own component. Null ids come last: where all
    rows of a component have none, component_id is null. An empty table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    index = _index(documents, id_col, text_col)
    lists = index.where("entries is not null").select(F.explode("entries").alias("entry"), "class", "n", "rare")
    lists = lists.repartition(shuffle_partitions(spark), "entry").sortWithinPartitions("entry", "rare", "class")
    found = stored(lists.mapInArrow(tidy(_candidates), "a long, b long, shared long, entry long, n long"), "join-candidates")

    def compare(pairs: DataFrame, step: Callable, kinds: str) -> DataFrame:
        return _compared(documents, id_col, text_col, index, pairs, step, kinds)

    def similar(pairs: DataFrame) -> DataFrame:
        return _similar(compare(pairs, _counted, "a long, b long, na long, nb long, both long"))

    # A pair needs as many common tokens in the prefixes as their suffixes leave open; frequent tokens, and those of lists
    # that neither leads and of long lists, which aren't counted by pair, are taken as common as far as both have them.
    left = found.where("b is null and shared = 1 and entry % 2 = 0").groupBy(F.col("a").alias("class")).agg(F.count("*").alias("left"))
    facts = index.where("class is not null").groupBy("class").agg(F.first("n").alias("n"), F.max("often").alias("often")).join(left, "class", "left")
    facts = stored(facts.select("class", "n", "often", (F.col("often") + F.coalesce("left", F.lit(0))).alias("open")), "join-facts")
    counted = found.where("b is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    pairs = stored(_possible(counted, facts, "open"), "join-pairs")
    links = stored(similar(pairs), "join-links")
    roots = connected_components(links)

    # What components still divide: lists that neither of a pair leads. A pair that isn't compared yet shares no others.
    members = found.where("b is null and shared = 1").select("entry", F.col("a").alias("class"), "n").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_lists = members.groupBy("entry").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.min("class").alias("least")).where("lo != hi")
    # Short lists go to the task of their smallest class, where a pair's lists mostly meet and are counted as one row.
    home = F.when(F.col("size") <= SHORT, F.col("least")).otherwise(F.col("entry")).alias("home")
    members = stored(members.join(open_lists.select("entry", home), "entry"), "join-members")
    free = members.where("entry % 2 = 0").groupBy("class").agg(F.count("*").alias("lists"))
    free = facts.join(free, "class", "left").select("class", (F.col("often") + F.coalesce("lists", F.lit(0))).alias("open"))
    rest = members.join(free, "class").repartition(shuffle_partitions(spark), "home").sortWithinPartitions("entry", "class")
    divided = stored(rest.select("entry", "class", "n", "root", "open").mapInArrow(tidy(_divided), "a long, b long, shared long, wide long"), "join-divided")
    more = _possible(divided.where("wide = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared")), facts, "often")
    size = F.count("*").alias("n")
    wide, of_wide = measured(divided.where("wide = 1").select(F.col("a").alias("class"), F.col("b").alias("root")).distinct(), "join-wide", size)
    fresh = []
    if of_wide["n"]:
        direct, beside = _beside(compare, wide, links, roots)
        fresh, more = [direct], more.unionByName(beside).distinct()
    more, of_more = measured(more.join(pairs, ["a", "b"], "left_anti"), "join-rest", size)
    if of_more["n"]:
        fresh.append(similar(more))
    if fresh:  # components of components: each node's link to its root stands for the links that were there
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        for found in fresh:
            links = links.unionByName(found)
        roots = connected_components(links)

    rows = index.select("id", "n", "class").join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("id").alias("_least"))
    rows = rows.select("id", "n", "root").join(least, "root", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("_least", "id").alias("component_id"))
