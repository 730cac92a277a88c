"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled documents (``SAMPLE``). For each n-gram,
hashed to one of ``DIMS`` features, documents with and without the label are counted
by Spark; features are kept whose difference is beyond chance (``CERTAIN`` standard
errors), however many these are. A document's value for a feature is its log-count ratio if it
occurs in the text, else 0; Spark's logistic regression weighs these values. A score
is the logistic of the summed weights of the features present, computed in the tasks
that read the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored, tidy

#: Labelled documents that are trained on, at most (drawn by a hash of the id).
SAMPLE = 20_000
#: Characters in an n-gram.
SIZES = (4, 5, 6)
DIMS = 1 << 20
#: Standard errors by which an n-gram's shares must differ between the labels.
CERTAIN = 4.0
SMOOTHING = 1.0
#: Ridge penalty of the logistic regression.
PENALTY = 0.0005
#: Code points that are hashed at a time, so that long texts take bounded memory.
WINDOW = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """features: sorted feature numbers; weights: what each adds; base: the score of a text without any."""

    features: tuple[int, ...]
    weights: tuple[float, ...]
    base: float


def ngram_features(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of the text's n-grams in any order, in pieces; repeated ones may repeat."""
    reach = max(SIZES) - 1
    lowered = f" {text.lower()} "
    for at in range(0, len(lowered), WINDOW):
        piece = lowered[at : at + WINDOW + reach]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        rolled = codes * _MIX
        n = 1
        for size in range(2, max(SIZES) + 1):
            if len(codes) < size:
                return
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[size - 1 :] * _MIX
            n += 1
            if n in SIZES:
                yield ((rolled ^ (rolled >> np.uint64(31))) * _MIX >> np.uint64(44)).astype(np.int64) % DIMS


def _present(text: str) -> np.ndarray:
    parts = list(ngram_features(text))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def _places(index: np.ndarray) -> np.ndarray:
    """By feature number, its place in the model, or one place after the last for the others."""
    place = np.full(DIMS, len(index), np.int32)
    place[index] = np.arange(len(index))
    return place


def _seen(text: str, place: np.ndarray, n: int) -> np.ndarray:
    """Which of the model's n features occur in the text."""
    here = np.zeros(n + 1, bool)
    for features in ngram_features(text):
        here[place[features]] = True
    return here[:-1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) rows to (feature, clean, toxic) counts of documents, summed over the task's rows."""
    counts = np.zeros((2, DIMS), np.int32)
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[label, _present(text.as_py() or "")] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(seen), 100_000):
        part = seen[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[0, part].astype(np.int64)), pa.array(counts[1, part].astype(np.int64))], ["feature", "clean", "toxic"])


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", order_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits the model on at most ``sample`` rows of (text, label 0 or 1); rows with a null label are left out.

    Beyond ``sample`` rows, exactly so many are taken: those of the least hashes of their ids, rows of one id (null ids are
    one) by the hash of their texts, so neither ties nor repeated rows empty the sample. Very long texts are read whole, a
    null text as an empty one. With rows of one label only, or none, there is nothing to tell apart: every text scores the
    share of that label, or 0 without rows.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("toxic"), F.col(text_col).alias("text"), F.xxhash64(F.col(order_col)).alias("_order"))
    first = rows.select("_order").orderBy("_order").limit(sample).agg(F.count("*").alias("n"), F.max("_order").alias("end")).first()
    if first["n"] == sample:
        rows = rows.where(F.col("_order") <= first["end"])  # by the id alone, so that no other text is moved
    rows = stored(rows, "toxicity-sample")
    over = rows.count() - sample
    if first["n"] == sample and over > 0:  # of the rows whose ids tie at the end, those of the least hashes of their texts
        tied, key = rows.where(F.col("_order") == first["end"]), F.struct(F.xxhash64("text").alias("b"), F.col("toxic").alias("c"))
        last = tied.select(key.alias("k")).orderBy("k").limit(tied.count() - over).agg(F.max("k").alias("k")).first()["k"]
        end = F.struct(F.lit(last["b"]).alias("b"), F.lit(last["c"]).alias("c"))
        below = rows.where((F.col("_order") < first["end"]) | (key < end))
        same = tied.where(key == end).limit(sample - below.count())  # rows that repeat the last one in all
        rows = stored(below.unionByName(same), "toxicity-sample")
    rows = rows.select("toxic", "text")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model((), (), 20.0 if totals.get(1) else -20.0)

    shares = {k: F.col(k) / F.lit(float(totals[i])) for i, k in enumerate(("clean", "toxic"))}
    pooled = (F.col("clean") + F.col("toxic")) / F.lit(float(sum(totals.values())))
    spread = F.sqrt(pooled * (1 - pooled) * F.lit(1 / totals[0] + 1 / totals[1]))
    ratio = F.log(((F.col("toxic") + SMOOTHING) / (totals[1] + 2 * SMOOTHING)) / ((F.col("clean") + SMOOTHING) / (totals[0] + 2 * SMOOTHING)))
    counts = rows.mapInArrow(tidy(_counted), "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    picked = counts.withColumn("z", F.try_divide(F.abs(shares["toxic"] - shares["clean"]), spread)).where(F.col("z") >= CERTAIN)
    best = sorted((r["feature"], r["ratio"]) for r in picked.select("feature", ratio.alias("ratio")).collect())  # of DIMS features at most
    if not best:
        return Model((), (), float(np.log(totals[1] / totals[0])))
    index, ratios = np.array([f for f, _ in best]), np.array([r for _, r in best])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(index)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [np.flatnonzero(_seen(t.as_py() or "", place, len(index))) for t in part.column(1)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).astype(np.int32)))], ["label", "places"])

    places = stored(rows.mapInArrow(tidy(values), "label double, places array<int>"), "toxicity-features")
    named = places.select("label", F.transform("places", lambda p: p.cast("string")).alias("places"))
    seen = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(index))], inputCol="places", outputCol="seen")
    vectors = ElementwiseProduct(scalingVec=Vectors.dense(ratios), inputCol="seen", outputCol="features").transform(seen.transform(named)).select("label", "features")
    fitted = LogisticRegression(maxIter=50, regParam=PENALTY, elasticNetParam=0.0, standardization=False).fit(vectors)
    weights = np.asarray(fitted.coefficients.toArray()) * ratios
    return Model(tuple(int(i) for i in index), tuple(float(w) for w in weights), float(fitted.intercept))


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with score (0 to 1) and predicted (1 from 0.5 on) added; null texts score as empty ones do."""
    index, weights = np.array(model.features, np.int64), np.array(model.weights)

    @F.pandas_udf("double")
    def scores(texts):
        place = _places(index)
        sums = np.array([weights[_seen(text, place, len(index))].sum() for text in texts])
        release()
        return pd.Series(1 / (1 + np.exp(-np.clip(model.base + sums, -500, 500))))

    scored = documents.withColumn("score", scores(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id"):
    """Whether a document's label may not be learned from: the CRC-32 of its id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) for training: labelled documents that aren't held out. Of several labels for one id the
    largest counts; documents that repeat an id each get it."""
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return documents.select("doc_id", "text").join(marks, "doc_id")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated and empty ones too; other columns play no part."""
    scored = score(documents.select("doc_id", "text"), train(labelled_documents(documents, labels)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
