"""Ranked lexical search: an inverted index in segments of documents, searched by MaxScore in each segment.

A segment holds a bounded number of postings, so no term's list grows with the corpus. Beside a
list stand, for each term frequency in it, the least length of a document: the highest score that
a term can give in the segment follows from these exactly under any corpus statistics, so
segments can be added and none is rewritten as counts change.

In a segment a query's terms stand by falling upper bound. Lists are added up as long as a
document which is in none so far could still be among the best (the essential ones); the others
are only probed, by binary search, for documents whose score so far and the bounds still to come
reach the k-th best. Each segment gives k documents a query, and the best of all are kept.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, tidy

#: What terms are made of, as a regular expression: ASCII letters and digits, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on UTF-8 bytes: what isn't of a term becomes a blank, A-Z become a-z.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Most postings of a segment (a document is never divided), and most queries that one task ranks at a time.
POSTINGS, QUERIES = 1 << 21, 2_000
SCHEMA = "segment string, term string, docs array<int>, tfs array<int>, level_tfs array<int>, level_ns array<long>, ids array<long>, ns array<long>"


def terms(text: str | Column) -> Column:
    """A text's terms, with repeats, in their order."""
    return F.regexp_extract_all(F.translate(F.col(text) if isinstance(text, str) else text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


@dataclass(frozen=True)
class Index:
    """rows: for each segment one row without a term, which holds its documents' ids and lengths, and one for each term."""

    rows: DataFrame

    def statistics(self) -> tuple[int, int]:
        """The number of documents that hold a term, and of all terms with repeats."""
        found = self.rows.where("term is null").agg(F.sum(F.size("ids")), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        return int(found[0] or 0), int(found[1] or 0)


class _Segment:
    """Postings of documents in the order in which they come."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.terms, self.docs, self.tfs = array("i"), array("i"), array("i")
        self.ids: list[int | None] = []
        self.ns: list[int] = []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts, places = Counter(words), self.places
        self.terms.extend([places.setdefault(w, len(places)) for w in counts])
        self.tfs.extend(counts.values())
        self.docs.extend([len(self.ids)] * len(counts))
        self.ids.append(doc_id)
        self.ns.append(len(words))

    def batches(self, name: str) -> Iterator[pa.RecordBatch]:
        names = pa.schema([("segment", pa.string()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("level_tfs", pa.list_(pa.int32())), ("level_ns", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pylist([{"segment": name, "ids": self.ids, "ns": self.ns}], schema=names)
        at, docs, tfs = (np.frombuffer(x, dtype=np.int32) for x in (self.terms, self.docs, self.tfs))
        order = np.argsort(at, kind="stable")
        at, docs, tfs = at[order], docs[order], tfs[order]
        starts = np.searchsorted(at, np.arange(len(self.places) + 1)).astype(np.int32)
        ns = np.array(self.ns, dtype=np.int64)[docs]
        by = np.lexsort((tfs, at))
        levels = np.flatnonzero(np.r_[True, (np.diff(at[by]) != 0) | (np.diff(tfs[by]) != 0)])
        level_tfs, level_ns = tfs[by][levels], np.minimum.reduceat(ns[by], levels)
        level_starts = np.searchsorted(at[by][levels], np.arange(len(self.places) + 1)).astype(np.int32)
        words = list(self.places)
        for a in range(0, len(words), 20_000):
            b = min(a + 20_000, len(words))
            lists = [pa.ListArray.from_arrays(pa.array(s[a : b + 1] - s[a]), pa.array(v[s[a] : s[b]])) for s, v in ((starts, docs), (starts, tfs), (level_starts, level_tfs), (level_starts, level_ns))]
            none = pa.nulls(b - a, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * (b - a)), pa.array([w.decode("utf-8", "replace") for w in words[a:b]]), *lists, none, none], schema=names)


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", postings: int = POSTINGS) -> Index:
    """The index of all rows and whole texts, stored in the shared folder.

    Null and empty texts and texts without terms are in no segment. Rows that repeat an id are documents of their own,
    as are rows without one. A very long text is one document, whole: its task holds its words while it counts them.
    An empty table gives an empty index; other columns, whatever their names, are ignored.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, prefix, made = _Segment(), None, 0
        for batch in batches:
            for doc_id, text, task in zip(*batch.columns, strict=True):
                words = (text.as_py() or b"").translate(_BYTES).split()
                if not words:
                    continue
                prefix = task.as_py() if prefix is None else prefix
                held.add(doc_id.as_py(), words)
                if len(held.terms) >= postings:
                    yield from held.batches(f"{prefix}-{made}")
                    held, made = _Segment(), made + 1
        if held.ids:
            yield from held.batches(f"{prefix}-{made}")

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.spark_partition_id().cast("string").alias("task"))
    return Index(stored(rows.mapInArrow(tidy(build), SCHEMA), "search-index"))


class _List:
    """A term's list in a segment; scores are made when they are asked for, and those of the whole list are kept."""

    def __init__(self, weight: int, docs: np.ndarray, tfs: np.ndarray, ms: np.ndarray, bound: int):
        self.weight, self.docs, self.tfs, self.ms, self.bound, self.whole = weight, docs, tfs, ms, bound, None

    def scores(self) -> np.ndarray:
        if self.whole is None:
            self.whole = self.weight * impacts(self.tfs, self.ms[self.docs])
        return self.whole

    def probe(self, docs: np.ndarray) -> np.ndarray:
        """The scores of these documents, 0 where the term isn't in them."""
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        found = np.flatnonzero(self.docs[at] == docs)
        out = np.zeros(len(docs), dtype=np.int64)
        out[found] = self.weight * impacts(self.tfs[at[found]], self.ms[docs[found]])
        return out


def impacts(tfs: np.ndarray, ms: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tfs) // (1_000 * tfs + 8 * ms)


def lengths(ns: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m for its number of terms. Products beyond 64 bits are made in whole numbers of any size."""
    if len(ns) and 90 * int(ns.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(n) * n_docs // n_terms for n in ns], dtype=np.int64)
    return 10 + (90 * ns * n_docs) // n_terms


def max_score(lists: list[_List], k: int, ids: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best k documents (positions, scores) of a segment for one query, ties by id. ``sums``: zeros for all documents; left so.

    Ties with the k-th best go on as candidates, since a smaller id may win.
    """
    lists = sorted(lists, key=lambda x: -x.bound)
    rest = np.cumsum([0, *[x.bound for x in lists[::-1]]])[::-1]
    least, i = 0, 0
    while i < len(lists) and rest[i] >= max(least, 1):
        sums[lists[i].docs] += lists[i].scores()
        i += 1
        if len(sums) >= k:
            least = int(np.partition(sums, len(sums) - k)[len(sums) - k])
    docs = np.flatnonzero((sums > 0) & (sums + rest[i] >= least))
    scores = sums[docs]
    for x in lists[:i]:
        sums[x.docs] = 0
    for j in range(i, len(lists)):
        can = scores + rest[j] >= least
        docs, scores = docs[can], scores[can]
        scores = scores + lists[j].probe(docs)
        if len(scores) >= k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    best = np.lexsort((ids[docs], -scores))[:k]
    return docs[best], scores[best]


#: Null ids come after all others.
_LAST = np.iinfo(np.int64).max


def _rank(group: pa.Table, k: int, n_docs: int, n_terms: int) -> pa.Table:
    kept = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    names = {c: group.column(c).combine_chunks() for c in group.column_names}
    own = int(np.flatnonzero(names["ids"].is_valid().to_numpy(zero_copy_only=False))[0])
    values = lambda c, i: names[c][i].values.to_numpy(zero_copy_only=False)
    ids = np.array([_LAST if x is None else x for x in names["ids"][own].as_py()], dtype=np.int64)
    real = np.array([x is not None for x in names["ids"][own].as_py()])
    ms = lengths(values("ns", own), n_docs, n_terms)
    of: dict[int, list[_List]] = {}
    for i, weight in enumerate(names["weight"].to_pylist()):
        if i != own:
            bound = weight * int(impacts(values("level_tfs", i).astype(np.int64), lengths(values("level_ns", i), n_docs, n_terms)).max())
            one = _List(weight, values("docs", i), values("tfs", i).astype(np.int64), ms, bound)
            for q in names["queries"][i].as_py():
                of.setdefault(q, []).append(one)
    sums, found = np.zeros(len(ids), dtype=np.int64), []
    for q, lists in of.items():
        docs, scores = max_score(lists, k, ids, sums)
        found.append((np.full(len(docs), q), ids[docs], real[docs], scores))
    if not found:
        return kept.empty_table()
    q, doc, there, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table([pa.array(q), pa.array(doc, mask=~there), pa.array(score)], schema=kept)


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block: int = QUERIES) -> DataFrame:
    """(id_col, rank, doc_id, score): the k best documents of each row of queries, scores above 0 only, equal ones by doc_id.

    Each row of queries is one query, rows that repeat an id too (their ranks then appear twice); null ids stay null, and
    queries without a term that is in the index have no rows. Documents without an id come last among equal scores.
    Queries are dealt in blocks: a task ranks one block over one segment, and gets only the lists of the block's terms.
    """
    n_docs, n_terms = index.statistics()
    asked = stored(queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("_id"), F.array_distinct(terms(text_col)).alias("terms")), "search-queries")
    blocks = max(1, -(-asked.count() // block))
    wanted = asked.select("query", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"), F.explode("terms").alias("term"))
    lists = index.rows.where("term is not null").join(wanted.select("term").distinct(), "term", "left_semi")
    df = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weights = df.select("term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")).where("weight > 0")
    wanted = stored(wanted.join(weights, "term").groupBy("block", "term", "weight").agg(F.collect_list("query").alias("queries")), "search-terms")
    lists = index.rows.where("term is not null").drop("ids", "ns").join(wanted, "term").drop("term")
    own = index.rows.where("term is null").select("segment", "ids", "ns", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def rank(group: pa.Table) -> pa.Table:
        return _rank(group, k, n_docs, n_terms)

    found = lists.unionByName(own, allowMissingColumns=True).groupBy("segment", "block").applyInArrow(rank, "query long, doc_id long, score long")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(asked.select("query", "_id"), "query").select(F.col("_id").alias(id_col), "rank", "doc_id", "score")
