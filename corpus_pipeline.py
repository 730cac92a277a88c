"""A corpus pipeline of five stages, each by one of the operators in ledgerlight.llm.

Each stage is a function of (spark, docs, sf_dir) to a DataFrame; ``run`` writes each
one's rows as Parquet to the shared folder and gives them to the next as docs. All but
the last return the columns of documents.

In all stages null texts count as empty, very long texts are read whole, rows may repeat
ids or have none, an empty table gives an empty one, and columns beyond those of
documents, whatever their names, go through unchanged (the last stage drops them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.bpe import token_digests
from ledgerlight.llm.common import packed, stored, table
from ledgerlight.llm.exact_dedup import drop_copies
from ledgerlight.llm.mixing import mix
from ledgerlight.llm.ngram_join import near_copies
from ledgerlight.llm.queries import TOKENIZER
from ledgerlight.llm.toxicity import labelled_documents, score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier calls toxic; each row is judged by its own text, so copies share a verdict.

    The classifier learns from those documents that have a label in ``labels`` and aren't held out. Without both kinds of
    labels it has nothing to tell apart, and no document goes unless all labels say toxic.
    """
    model = train(labelled_documents(docs, table(spark, sf_dir, "labels")))
    return score(docs.select(packed(docs).alias("doc"), "text"), model).where("predicted = 0").select("doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the best of the documents whose texts are equal but for white space: the longest original text, then the
    smallest id (null ids last); of rows that tie in all of this, one. Null, empty and blank texts are one group."""
    return drop_copies(docs)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """(row, doc): each row's key, and its columns in one; stored, so that a row has one key wherever it is read."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), packed(docs).alias("doc")), label)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id (null ids last), of each group of near copies.

    Of rows that tie in the id any one stays. Texts without words are near copies of nothing and all stay.
    """
    rows = numbered(docs, "pipeline-near-rows")
    found = near_copies(rows.select("row", "doc.text"), "row").select("row", "component_id")
    ids = rows.select("row", F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row").alias("at"))
    stays = found.join(ids, "row").groupBy("component_id").agg(F.min("at").alias("at")).select(F.col("at.row").alias("row"))
    return rows.join(stays.hint("shuffle_hash"), "row", "left_semi").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their target weights: each document is there as often as the mix takes it, twice at most.

    Texts without words have no size and are not taken; null sources are one source. Rows that tie are ranked by id and row.
    """
    rows = numbered(docs, "pipeline-mix-rows")
    copies = mix(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), row_col="row").where("copies > 0").select("row", "copies")
    taken = rows.join(copies.hint("shuffle_hash"), "row")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes it again: doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, repeats too."""
    return token_digests(docs, TOKENIZER)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("mixing", mixing), ("BPE", bpe)]

#: SQL can express neither the classifier nor the sample's hashes; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
