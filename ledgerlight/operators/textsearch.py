"""The most similar other texts of a block by token-set ratio, exactly, with bounds before comparisons.

A block's distinct texts are dealt to tiles. A tile's task holds its texts and what is best for
each so far, while all texts of the block stream through. For a batch of these, a pair's bound
follows in bulk: from the words that both have (whose ratio to either side is a matter of lengths)
and from how often each letter is in both. Only pairs whose bound reaches a text's k-th best so
far are compared, in falling order of their bounds, letter by letter; bit rows for many texts at once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialised

#: Texts of a tile, and how many stream through it at a time.
TILE, BATCH = 1_024, 8_192
#: Columns that letters are counted in; signs and words up to which texts are compared together, and from how many on.
_COLUMNS, _SIGNS, _WORDS, _FEW = 32, 64, 62, 8


class Batch:
    """Texts (text, first id), with what their bounds follow from."""

    def __init__(self, rows: list[tuple[str, str]], once: bool = True):
        self.rows = rows
        self.words = [sorted(set(t.split()) if once else t.split()) for t, _ in rows]
        self.joined = [" ".join(w) for w in self.words]
        self.sizes = np.array([len(j) for j in self.joined], dtype=np.int64)
        self.n_words = np.array([len(w) for w in self.words], dtype=np.int64)
        width = max(1, int(self.sizes.max(initial=0)))
        points = np.zeros((len(rows), width), dtype=np.uint32)
        for i, j in enumerate(self.joined):
            points[i, : len(j)] = np.frombuffer(j.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.points = points
        inside = np.arange(width) < self.sizes[:, None]
        flat = (np.arange(len(rows))[:, None] * _COLUMNS + (points & (_COLUMNS - 1)))[inside]
        bags = np.bincount(flat, minlength=len(rows) * _COLUMNS).reshape(len(rows), _COLUMNS)
        self.bags = bags.astype(np.uint8 if width < 256 else np.uint32)
        having: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.word_of = np.full(points.shape, -1, dtype=np.int16)  # the word, with the blank after it, that each sign is of
        for i, ws in enumerate(self.words):
            a = 0
            for n, w in enumerate(ws):
                having[w].append((i, n))
                self.word_of[i, a : a + len(w) + 1] = n
                a += len(w) + 1
        #: For each word the texts that have it, and which of their words it is.
        self.at = {w: np.array(x).T for w, x in having.items()}
        self.signs, self.codes = np.unique(points, return_inverse=True)
        self.none = len(self.signs)
        self.codes = self.codes.reshape(points.shape).astype(np.uint16 if self.none < 1 << 16 else np.uint32)


def _lcs(a: str, b: str) -> int:
    """The longest common subsequence of two texts; a whole number holds a row of the table."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _lcs_of_many(a: str, batch: Batch, at: np.ndarray, without: list[str]) -> np.ndarray:
    """The same for one text of at most 64 signs and many of a batch, as 64-bit rows; ``without``: words that all of these have and that are left out."""
    codes = batch.codes[at, : int(batch.sizes[at].max(initial=0))]
    if without:
        words, kept = batch.word_of[at, : codes.shape[1]], np.arange(codes.shape[1]) < batch.sizes[at][:, None]
        for w in without:
            texts, places = batch.at[w]
            kept &= words != places[np.searchsorted(texts, at)][:, None]
        last = codes.shape[1] - 1 - np.argmax(kept[:, ::-1], axis=1)  # a blank there is of a word that was last and is gone
        rows = np.arange(len(at))
        kept[rows, last] &= batch.points[at, last] != 32
        codes = np.where(kept, codes, codes.dtype.type(batch.none))
    masks = np.zeros(len(batch.signs) + 1, dtype=np.uint64)
    own = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    where = np.minimum(np.searchsorted(batch.signs, own), len(batch.signs) - 1)
    for i in np.flatnonzero(batch.signs[where] == own).tolist():
        masks[where[i]] |= np.uint64(1 << i)
    masks[:-1][batch.signs == 0] = 0
    full = np.uint64((1 << len(a)) - 1)
    row = np.full(len(at), full)
    for column in np.ascontiguousarray(codes.T):
        hit = row & masks[column]
        row = ((row + hit) | (row - hit)) & full
    return len(a) - np.bitwise_count(row).astype(np.int64)


class Best:
    """The k best others of one text so far, ties by the others' first ids."""

    __slots__ = ("text", "words", "joined", "bag", "k", "found", "compared")

    def __init__(self, text: str, k: int):
        self.text, self.k, self.words = text, k, sorted(set(text.split()))
        self.joined = " ".join(self.words)
        self.bag = np.bincount(np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & (_COLUMNS - 1), minlength=_COLUMNS)
        self.found: list[tuple[float, str, str]] = []
        self.compared = 0

    def add(self, batch: Batch) -> None:
        """Takes in what a batch has; scores are from 0 to 1."""
        n, own = len(batch.rows), len(self.joined)
        shared, common, which = (np.zeros(n, dtype=np.int64) for _ in range(3))
        for j, w in enumerate(self.words):
            if w in batch.at:
                at = batch.at[w][0]
                shared[at] += len(w)
                common[at] += 1
                which[at] |= 1 << j if j < _WORDS else 1 << _WORDS
        both = np.where(common > 0, shared + common - 1, 0)
        sizes = batch.sizes
        # The shared words against each side; 1 where a side has no other words. Ratios are 200 * common signs / all signs, then / 100.
        sure = np.where(common > 0, np.maximum(200.0 * both / np.maximum(both + own, 1), 200.0 * both / np.maximum(both + sizes, 1)), 0.0) / 100
        sure[(common > 0) & ((common == len(self.words)) | (common == batch.n_words))] = 1.0
        for i in np.flatnonzero(sizes == own).tolist():
            if batch.rows[i][0] == self.text:
                sure[i] = 1.0
        bag = self.bag.astype(batch.bags.dtype) if int(self.bag.max(initial=0)) < 256 or batch.bags.dtype != np.uint8 else np.minimum(self.bag, 255).astype(np.uint8)
        overlap = np.minimum(batch.bags, bag).sum(axis=1, dtype=np.int64)
        can = np.where((sizes > 0) & (own > 0), 200.0 * overlap / np.maximum(own + sizes, 1), 0.0) / 100
        done = (sure >= can) | (own == 0) | (sizes == 0)
        self._keep(batch, np.flatnonzero(done), sure[done])
        least = self._least(sure[~done])
        open_ = np.flatnonzero(~done & (can >= least))
        open_ = open_[np.argsort(-can[open_], kind="stable")]
        a, step = 0, max(4 * self.k, 64)
        while a < len(open_):
            at = open_[a : a + step]
            at = at[can[at] >= self._least(sure[open_[a:]])]
            if not len(at):
                break
            self.compared += len(at)
            self._keep(batch, at, np.maximum(sure[at], self._ratios(batch, at, which[at], both)))
            a, step = a + step, 2 * step

    def _ratios(self, batch: Batch, at: np.ndarray, which: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Of all words of both sides, the shared ones first: these match as they are, so only the others' signs are compared.

        Texts that share the same words with this one are compared together.
        """
        found, mine = np.zeros(len(at), dtype=np.int64), set(self.words)
        kinds, kind, sizes = np.unique(which, return_inverse=True, return_counts=True)
        for n, bits in enumerate(kinds.tolist()):
            same = np.flatnonzero(kind == n)
            shared = [w for j, w in enumerate(self.words[:_WORDS]) if bits >> j & 1]
            rest = " ".join(w for j, w in enumerate(self.words) if j >= _WORDS or not bits >> j & 1)
            if sizes[n] > _FEW and len(rest) <= _SIGNS and not bits >> _WORDS:
                found[same] = _lcs_of_many(rest, batch, at[same], shared) + (both[at[same]] + 1 if bits else 0)
                continue
            for j in same.tolist():
                theirs = batch.words[at[j]]
                own, others = (self.joined, batch.joined[at[j]]) if not bits else (" ".join(w for w in self.words if w not in set(theirs)), " ".join(w for w in theirs if w not in mine))
                found[j] = _lcs(own, others) + (both[at[j]] + 1 if bits else 0)
        return 200.0 * found / (len(self.joined) + batch.sizes[at]) / 100

    def _least(self, sure: np.ndarray) -> float:
        """What the k-th best has at least, by what was found and by what others are sure to have."""
        known = [s for s, _, _ in self.found]
        if len(known) + len(sure) < self.k:
            return -1.0
        if len(known) == self.k and (not len(sure) or sure.max() <= known[-1]):
            return known[-1]
        every = np.concatenate([known, sure])
        return float(np.partition(every, len(every) - self.k)[len(every) - self.k])

    def _keep(self, batch: Batch, at: np.ndarray, scores: np.ndarray) -> None:
        if len(self.found) == self.k:
            fit = scores >= self.found[-1][0]
            at, scores = at[fit], scores[fit]
        if len(at):
            more = [(float(s), *batch.rows[i][::-1]) for i, s in zip(at.tolist(), scores.tolist(), strict=True)]
            self.found = heapq.nsmallest(self.k, [*self.found, *more], key=lambda x: (-x[0], x[1]))


class Near:
    """The earlier names that one name is near to: what is alike of all their words, sorted, reaches a floor (0 to 100)."""

    __slots__ = ("text", "order", "joined", "bag", "floor")

    def __init__(self, text: str, order: str, floor: float):
        self.text, self.order, self.floor, self.joined = text, order, floor, " ".join(sorted(text.split()))
        self.bag = np.bincount(np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & (_COLUMNS - 1), minlength=_COLUMNS)

    def among(self, batch: Batch) -> list[tuple[str, float]]:
        own, sizes = len(self.joined), batch.sizes
        whole = np.maximum(own + sizes, 1)
        at = np.flatnonzero((200.0 * np.minimum(own, sizes) / whole >= self.floor) | (own + sizes == 0))
        bag = np.minimum(self.bag, 255).astype(np.uint8) if batch.bags.dtype == np.uint8 else self.bag
        at = at[(200.0 * np.minimum(batch.bags[at], bag).sum(axis=1, dtype=np.int64) / whole[at] >= self.floor) | (whole[at] == 1)]
        at = np.array([i for i in at.tolist() if batch.rows[i][1] < self.order], dtype=np.int64)
        if len(at) > _FEW and own <= _SIGNS:
            found = _lcs_of_many(self.joined, batch, at, [])
        else:
            found = np.array([_lcs(self.joined, batch.joined[i]) for i in at.tolist()], dtype=np.int64)
        scores = np.where(own + sizes[at] == 0, 100.0, 200.0 * found / whole[at])
        return [(batch.rows[i][0], s) for i, s in zip(at.tolist(), scores.tolist(), strict=True) if s >= self.floor]


def _tiled(texts: DataFrame, block: str, key: str, second: str, tile: int) -> DataFrame:
    """A block's rows dealt to tiles (side 0), and all of them again for each of its tiles (side 1), in this order in a tile's task.

    Tiles are runs of ``tile`` rows at most in the order of the blocks and of the texts' longest words, and a tile's own
    rows come first on side 1: most texts meet those that are most like them at once, and with these bounds all others.
    """
    rows = texts.where(F.col(block).isNotNull() & F.col(key).isNotNull()).select(F.col(block).cast("string").alias("_block"), F.col(key).alias("_key"), F.col(second).cast("string").alias("_second"))
    longest = F.array_max(F.transform(F.split("_key", r"\s+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    order = ["_block", "_longest", "_key"]
    rows = rows.withColumn("_longest", longest).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialised(rows.select("_block", "_key", "_second", F.floor(F.monotonically_increasing_id() / tile).alias("_tile")), "text-tiles")
    tiles = rows.groupBy("_block").agg(F.collect_set("_tile").alias("_tiles"))
    left = rows.withColumn("_side", F.lit(0)).withColumn("_far", F.lit(False))
    right = rows.withColumnRenamed("_tile", "_own").join(tiles, "_block").withColumn("_tile", F.explode("_tiles")).withColumn("_side", F.lit(1)).withColumn("_far", F.col("_own") != F.col("_tile"))
    columns = ["_block", "_tile", "_side", "_key", "_second", "_far"]
    both = left.select(*columns).unionByName(right.select(*columns))
    return both.repartition("_block", "_tile").sortWithinPartitions("_block", "_tile", "_side", "_far", "_key").drop("_far")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str]], list[tuple[str, str]], bool]]:
    """(block, the tile's rows, some of all rows of the block, whether they are the last) for each tile, in pieces of BATCH."""
    at, left, held = None, [], []
    for batch in batches:
        for block, tile, side, text, second in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (block, tile) != at:
                if at is not None:
                    yield at[0], left, held, True
                at, left, held = (block, tile), [], []
            if side == 0:
                left.append((text, second))
                continue
            if len(held) >= BATCH:
                yield at[0], left, held, False
                held = []
            held.append((text, second))
    if at is not None:
        yield at[0], left, held, True


def best_texts(texts: DataFrame, block: str, key: str, first: str, k: int, tile: int = TILE) -> DataFrame:
    """(block, key, other, score, nth): each text's k best texts of its block, itself (with 1) among them, ties by ``first``.

    texts has a row for each distinct text of a block, with the first id (a string) that has it. No block is one task:
    each tile of it is one, of at most about ``tile`` texts, and gets the block's texts as a stream. Rows without a block
    or text are left out; a text without words has 0 with all others.
    """
    schema = pa.schema([("_block", pa.string()), ("_key", pa.string()), ("other", pa.string()), ("score", pa.float64()), ("nth", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[Best] = []
        for at, left, some, last in _streamed(batches):
            best = best or [Best(text, k) for text, _ in left]
            batch = Batch(some)
            for one in best:
                one.add(batch)
            if last:
                made = [(at, one.text, other, score, i) for one in best for i, (score, _, other) in enumerate(one.found, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(schema)], schema=schema)
                best = []

    found = _tiled(texts, block, key, first, tile).mapInArrow(run, "_block string, _key string, other string, score double, nth int")
    return found.select(F.col("_block").cast(texts.schema[block].dataType).alias(block), F.col("_key").alias(key), "other", "score", "nth")


def near_names(names: DataFrame, block: str, name: str, order: str, floor: float, tile: int = TILE) -> DataFrame:
    """(block, name, earlier, score): the pairs of a block's names whose sorted words are alike by the floor or more, the later one first.

    order: a string that no two names of a block share and by which they come. A pair's bound is its lengths', then its
    letters'; what reaches the floor by both is compared. Pairs go out as they are found.
    """
    schema = pa.schema([("_block", pa.string()), ("_key", pa.string()), ("earlier", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, left, some, _ in _streamed(batches):
            batch = Batch(some, once=False)
            made = [(at, text, other, score) for text, second in left for other, score in Near(text, second, floor).among(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(schema)], schema=schema)

    found = _tiled(names, block, name, order, tile).mapInArrow(run, "_block string, _key string, earlier string, score double")
    return found.select(F.col("_block").cast(names.schema[block].dataType).alias(block), F.col("_key").alias(name), "earlier", "score")
