"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with a cosine of at least c lie within eps = sqrt(2 - 2c) of each other.
Vectors are turned to their principal dimensions and put in the order of the grid cells
(of width eps) of the leading ones. The sequence is cut into blocks; blocks and intervals
of FAN of them, of FAN of these and so on have bounding boxes. Pairs of intervals are
joined from the top down: those whose boxes are farther apart than eps are skipped, the
others are split, down to pairs of blocks, which are dealt out. A task goes on in the same
way within its two blocks, and compares the parts that are left.

The result does not depend on how well the dimensions separate the vectors: they decide
only what can be skipped. A task holds two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored
from .components import connected_components

LEAST_COSINE = 0.9
#: Vectors in a block, two of which a task holds; and in the parts of a block that are compared at once.
BLOCK, LEAF = 4096, 256
#: Intervals in an interval of the next level.
FAN = 8
#: Leading dimensions whose cells make the order.
LEADING = 6
#: Products closer to the limit than this are taken again: those in single precision in double, these with more digits, one by one.
ROUGH, CLOSE = 1e-4, 1e-10


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks().values if isinstance(column, pa.ChunkedArray) else column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """The principal dimensions of all unit vectors, as columns, the widest first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = _unit(_matrix(batch.column(0), dim))
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    rows = vectors.select("x").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v")).collect()
    total = np.zeros(((dim + 1) ** 2))
    for i, v in rows:
        total[i] = v
    total = total.reshape(dim + 1, dim + 1)
    n = total[dim, dim]
    mean = total[dim, :dim] / n
    values, turned = np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))
    return turned[:, np.argsort(-values)]


def _sequence(vectors: DataFrame, dim: int, eps: float, block: int, rotation: np.ndarray) -> tuple[DataFrame, DataFrame, int, int]:
    """(id, times, x, block, place) in grid order, boxes of parts of blocks (block, lo, hi), and the levels and fan of the interval tree."""
    lead = min(dim, LEADING)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _unit(_matrix(batch.column(2), dim)) @ rotation[:, :lead]
            # Cells of width eps, and within these finer ones; ten bits each.
            order = np.concatenate([np.floor(y / eps), np.floor(y / eps * 8) % 8], axis=1).astype(np.int64) + 512
            text = ["".join(f"{v:04d}" for v in row) for row in order.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], ["id", "times", "x", "cell"])

    kind = vectors.schema["x"].dataType.simpleString()
    spark = vectors.sparkSession
    ordered = vectors.select("id", "times", "x").mapInArrow(cells, f"id long, times long, x {kind}, cell string").repartitionByRange(shuffle_partitions(spark), "cell", "id").sortWithinPartitions("cell", "id")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))], ["id", "times", "x", "part", "place"])
            at += n

    rows = stored(ordered.select("id", "times", "x").mapInArrow(place, f"id long, times long, x {kind}, part long, place long"), "grid-sequence")
    # Places in the whole sequence: those in a task's part after the sizes of the parts before it, of which there is one for each task.
    sizes = sorted(tuple(r) for r in rows.groupBy("part").count().collect())
    total, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    rows = rows.join(F.broadcast(spark.createDataFrame(offsets, "part long, _before long")), "part").withColumn("place", F.col("place") + F.col("_before"))
    rows = rows.select("id", "times", "x", F.floor(F.col("place") / block).cast("long").alias("block"), "place")

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, at = _unit(_matrix(batch.column(1), dim)) @ rotation, batch.column(0).to_numpy()
            blocks = np.unique(at)
            sides = [pa.array([side(y[at == k], axis=0).tolist() for k in blocks], pa.list_(pa.float64())) for side in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), *sides], ["block", "lo", "hi"])

    levels, top = 0, 1
    while top * block < total:
        levels, top = levels + 1, top * FAN
    return rows, rows.select("block", "x").mapInArrow(box, "block long, lo array<double>, hi array<double>"), levels, FAN


def near_block_pairs(boxes: DataFrame, levels: int, fan: int, eps: float) -> DataFrame:
    """(i, j), i <= j, of all blocks whose boxes are within eps, by recursion over intervals of the sequence."""
    sides = boxes.select("block", F.posexplode(F.arrays_zip("lo", "hi")).alias("k", "s")).select("block", "k", "s.lo", "s.hi")
    sides = stored(sides, "grid-boxes")

    def nodes(level: int) -> DataFrame:
        at = F.floor(F.col("block") / float(fan**level)).cast("long")
        sums = sides.groupBy(at.alias("node"), "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        box = F.array_sort(F.collect_list(F.struct("k", "lo", "hi")))  # a row for each dimension
        return sums.groupBy("node").agg(F.transform(box, lambda s: s["lo"]).alias("lo"), F.transform(box, lambda s: s["hi"]).alias("hi"))

    pairs = nodes(levels).select(F.col("node").alias("i"), F.col("node").alias("j"))
    for level in range(levels - 1, -1, -1):
        below = stored(nodes(level), f"grid-nodes{level}")
        up = F.floor(F.col("node") / float(fan)).cast("long")
        left = below.select(up.alias("i"), F.col("node").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        right = below.select(up.alias("j"), F.col("node").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        gap = F.zip_with(F.arrays_zip("alo", "ahi"), F.arrays_zip("blo", "bhi"), lambda p, q: F.greatest(F.lit(0.0), p["alo"] - q["bhi"], q["blo"] - p["ahi"]))
        apart = F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g)
        pairs = pairs.join(left, "i").join(right, "j").where("a <= b").where(apart <= eps * eps + 1e-9)
        pairs = stored(pairs.select(F.col("a").alias("i"), F.col("b").alias("j")), f"grid-pairs{level}")
    return pairs


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of unit vectors with a cosine of at least ``least``: found in single precision with a margin, then judged in double."""
    i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(least - ROUGH))
    sure = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        p, q = x[i[at : at + (1 << 14)]], y[j[at : at + (1 << 14)]]
        cosines = np.einsum("ij,ij->i", p, q)
        sure[at : at + len(p)] = cosines >= least
        for k in np.flatnonzero(np.abs(cosines - least) < CLOSE):
            dot, m, n = (float(np.dot(v.astype(np.longdouble), w.astype(np.longdouble))) for v, w in ((p[k], q[k]), (p[k], p[k]), (q[k], q[k])))
            sure[at + k] = dot / np.sqrt(m * n) >= least
    return i[sure], j[sure]


def _near_parts(x: np.ndarray, y: np.ndarray, same: bool, eps: float, leaf: int) -> Iterator[tuple[slice, slice]]:
    """Pairs of intervals of at most ``leaf`` vectors whose boxes are within eps, by recursion over halves of both sequences."""

    def box(v: np.ndarray, at: slice, known: dict) -> tuple[np.ndarray, np.ndarray]:
        if (found := known.get((at.start, at.stop))) is None:
            found = known[at.start, at.stop] = v[at].min(axis=0), v[at].max(axis=0)
        return found

    def halves(at: slice) -> list[slice]:
        middle = (at.start + at.stop) // 2
        return [at] if at.stop - at.start <= leaf else [slice(at.start, middle), slice(middle, at.stop)]

    left: dict = {}
    right = left if same else {}
    open_pairs = [(slice(0, len(x)), slice(0, len(y)))]
    while open_pairs:
        p, q = open_pairs.pop()
        (plo, phi), (qlo, qhi) = box(x, p, left), box(y, q, right)
        gap = np.maximum(0, np.maximum(plo - qhi, qlo - phi))
        if gap @ gap > eps * eps + 1e-9:
            continue
        if p.stop - p.start <= leaf and q.stop - q.start <= leaf:
            yield p, q
            continue
        open_pairs += [(a, b) for a in halves(p) for b in halves(q) if not same or a.start <= b.start]


def _compare(dim: int, least: float, eps: float, rotation: np.ndarray, leaf: int):
    """For the rows of a pair of blocks: each vector's links to the other block (b null), and links that connect what is linked."""

    def run(group: pa.Table) -> pa.Table:
        side, place = group.column("side").to_numpy(), group.column("place").to_numpy()
        order = np.lexsort((place, side))
        side, ids, times = side[order], group.column("id").to_numpy()[order], group.column("times").to_numpy()[order]
        x = _unit(_matrix(group.column("x"), dim))[order]
        turned = x @ rotation
        split = int((side == 0).sum())
        same = split == len(side)  # a block with itself has one side
        base = 0 if same else split
        links = np.zeros(len(ids), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for p, q in _near_parts(turned[:split], turned[base:], same, eps, leaf):
            i, j = _linked(x[:split][p], x[base:][q], least)
            i, j = i + p.start, j + q.start + base
            if same and p.start == q.start:
                i, j = i[i < j], j[i < j]
            if len(i):
                links += np.bincount(i, times[j], len(ids)).astype(np.int64) + np.bincount(j, times[i], len(ids)).astype(np.int64)
                found.append(_spanning(i, j))
        root, moved = _spanning(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else (np.empty(0, np.int64),) * 2
        linked = np.flatnonzero(links)
        b = np.concatenate([np.full(len(linked), -1), ids[root]])
        return pa.table({"a": pa.array(ids[np.concatenate([linked, moved])], pa.int64()), "b": pa.array(b, pa.int64(), mask=np.arange(len(b)) < len(linked)), "n": pa.array(np.concatenate([links[linked], np.zeros(len(moved), np.int64)]), pa.int64())})

    return run


def _spanning(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of vertices to the smallest that the given links reach, one for each vertex that is not itself the smallest."""
    vertices, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j, label = at[: len(i)], at[len(i) :], np.arange(len(vertices))
    while True:
        before = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(len(label)))
            return vertices[label[moved]], vertices[moved]


def _join(vectors: DataFrame, dim: int, least: float, block: int, leaf: int) -> DataFrame:
    eps, rotation = float(np.sqrt(2 - 2 * least)), _rotation(vectors, dim)
    rows, boxes, levels, fan = _sequence(vectors, dim, eps, block, rotation)
    pairs = near_block_pairs(boxes, levels, fan, eps)
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")), F.when(F.col("i") != F.col("j"), F.struct(F.lit(1).alias("side"), F.col("j").alias("block"))))
    sides = pairs.select("i", "j", F.explode(both).alias("s")).where("s is not null").select("i", "j", "s.side", "s.block")
    dealt = sides.join(rows, "block").select("i", "j", "side", "place", "id", "times", "x")
    return stored(dealt.groupBy("i", "j").applyInArrow(lambda t: _compare(dim, least, eps, rotation, leaf)(t), "a long, b long, n long"), "grid-links")


def link_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """id, n_links, component_id and kept for each row.

    Rows are linked if the cosine of their vectors, in double precision, is at least ``least``. n_links counts the other
    rows linked to a row; equal vectors are compared once and counted as often as they occur. component_id is the smallest
    id that links reach; kept marks the rows that have it. Vectors that are null, empty or zero, that hold null or
    non-finite components, or whose row has no id, are linked with nothing and are their own component. Vectors of
    different lengths are not linked. An empty table gives an empty result; other columns, labels too, play no part.
    """
    rows = embeddings.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_x"))
    finite = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(F.col("_id").isNotNull() & finite & F.exists("_x", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("_sound", sound)
    copies = rows.where("_sound").groupBy(F.col("_x").alias("x")).agg(F.min("_id").alias("id"), F.count("*").alias("times"))
    copies = stored(copies, "grid-vectors")
    # A table may hold several classes with one smallest id only if rows repeat an id; these are told apart by a number.
    repeated = copies.groupBy("id").count().where("count > 1").limit(1).count()
    copies = copies.withColumn("node", F.monotonically_increasing_id() if repeated else F.col("id"))
    if repeated:
        copies = stored(copies, "grid-nodes")

    found = None
    for (dim,) in copies.select(F.size("x").alias("d")).distinct().orderBy("d").collect():
        part = _join(copies.where(F.size("x") == dim).select(F.col("node").alias("id"), "times", "x"), dim, least, block, leaf)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    classes = copies.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = classes.groupBy("root").agg(F.min("id").alias("least"))
    classes = classes.join(heads, "root").select("x", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), "least")
    out = rows.join(classes, F.col("_sound") & (F.col("_x") == F.col("x")), "left")
    first = F.coalesce("least", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), first.alias("component_id"), F.coalesce(F.col("_id") == first, F.lit(True)).alias("kept"))
