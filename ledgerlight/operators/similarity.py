"""String similarity within blocks, name canonicalising, and TF-IDF cosines, with exact clusters."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cluster_id
from ..sources.tables import materialised
from .textsearch import best_texts, near_names


def indel_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / both lengths: the ratio of insertions and deletions, in percent.

    The subsequence's length comes from bit rows: one whole number holds a row of the table.
    """
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and each side's words after them; 100 if one side's words are all shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (only_x and only_y):
        return 100.0
    base, p, q = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    return max(indel_ratio(p, q), indel_ratio(base, p) if both else 0.0, indel_ratio(base, q) if both else 0.0)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any stretch of the longer one of its length, or cut off at an end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(indel_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def similar_texts(rows: DataFrame, block: str, id_col: str, key: str, k: int = 9) -> DataFrame:
    """(block, key, n, other, score, nth): each distinct text of a block, how many rows have it, and its k best texts of the block.

    The text itself is among them, with 1; ties go by the first id that has a text. Lists of up to k - 1 similar rows and
    the best ratio of any row follow from it, so it is worth storing.
    """
    texts = rows.where(F.col(block).isNotNull() & F.col(key).isNotNull()).groupBy(block, key).agg(F.min(id_col).alias("_first"), F.count("*").alias("n"))
    return best_texts(texts, block, key, "_first", k).join(texts.select(block, key, "n"), [block, key]).select(block, key, "n", "other", "score", "nth")


def similar_peers(rows: DataFrame, block: str, id_col: str, key: str, k: int = 8, least: float = 0.0, best: DataFrame | None = None) -> DataFrame:
    """(id, peer, score, rank): each row's k most similar other rows of its block by token-set ratio (0 to 1).

    best: ``similar_texts`` of the rows, with at least k + 1 texts for each. The first k + 1 ids of these texts are
    merged to one list for each text, of which a row takes what isn't itself: no list grows with how often a text repeats.
    """
    found = rows.select(block, key, id_col).join(peer_lists(rows, block, id_col, key, k, least, best), [block, key]).select(id_col, F.posexplode(own_peers(id_col, k)).alias("_at", "_p"))
    return found.select(id_col, F.col("_p.peer").alias("peer"), (-F.col("_p.less")).alias("score"), (F.col("_at") + 1).alias("rank"))


def peer_lists(rows: DataFrame, block: str, id_col: str, key: str, k: int = 8, least: float = 0.0, best: DataFrame | None = None) -> DataFrame:
    """(block, key, _peers): for each distinct text of a block the first k + 1 ids of what is most similar to it, of which ``own_peers`` takes a row's."""
    rows = rows.where(F.col(block).isNotNull() & F.col(key).isNotNull()).select(block, key, id_col)
    best = similar_texts(rows, block, id_col, key, k + 1) if best is None else best
    nth = F.row_number().over(W.partitionBy(block, key).orderBy(id_col))
    firsts = rows.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).groupBy(block, F.col(key).alias("other")).agg(F.collect_list(id_col).alias("_ids"))
    near = best.where((F.col("nth") <= k + 1) & (F.col("score") >= least)).select(block, key, "other", "score").join(firsts, [block, "other"])
    lists = near.groupBy(block, key).agg(F.array_sort(F.flatten(F.collect_list(F.transform("_ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("peer")))))).alias("_peers"))
    return lists.select(block, key, F.slice("_peers", 1, k + 1).alias("_peers"))


def own_peers(id_col: str, k: int) -> Column:
    """Of the ids in ``_peers`` the first k that aren't the row's, each with ``less``, its score below zero; null without a list."""
    return F.slice(F.filter("_peers", lambda p: p["peer"] != F.col(id_col)), 1, k)


def best_in_block(rows: DataFrame, block: str, key: str, id_col: str, best: DataFrame | None = None) -> DataFrame:
    """(block, key, duplicate_similarity): for each text of a block, the best ratio to another row's text there.

    best: ``similar_texts`` of the rows. A text that repeats has 1; one that is alone in its block has no row.
    """
    best = similar_texts(rows, block, id_col, key, 2) if best is None else best
    other = F.when(F.col("other") != F.col(key), F.col("score"))
    found = best.groupBy(block, key).agg(F.max("n").alias("_n"), F.max(other).alias("_other"))
    return found.select(block, key, F.when(F.col("_n") > 1, 1.0).otherwise(F.col("_other")).alias("duplicate_similarity")).where("duplicate_similarity is not null")


def citation_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The rows with partial and sorted ratios of two texts, to three places; for the few rows that are cited."""

    @F.pandas_udf("partial double, sorted double")
    def parts(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(round(partial_ratio(p, q) / 100, 3), round(token_sort_ratio(p, q) / 100, 3)) for p, q in zip(x, y, strict=True)], columns=["partial", "sorted"])

    return pairs.withColumn("components", parts(a, b))


def canonical_names(rows: DataFrame, block: str, name: str, order: str, floor: float = 90.0) -> DataFrame:
    """(block, name, canonical, score): each distinct name's canonical one, taken greedily in the order of first sight.

    A name with no canonical name before it that it is near to (its sorted words are alike by the floor) is canonical;
    any other goes to the nearest of these, to the earliest of equally near ones. What the sequence decides is the first
    independent set, in its order, of the graph of near names, and rounds find it: a name is decided once a near one
    before it is canonical, or once all of them are not. Names of a block are compared and decided in many tasks; a round
    takes in all blocks, and there are as many as the longest run of names that wait for each other.
    """
    distinct = rows.where(F.col(name).isNotNull()).groupBy(block, name).agg(F.min(order).alias("_at"))
    at = F.col("_at").cast("string")
    if rows.schema[order].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        at = F.lpad((F.col("_at").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    of = F.coalesce(F.concat(F.lit("="), F.col(block).cast("string")), F.lit(""))  # names without a block are one block
    names = materialised(distinct.select(block, name, of.alias("_of"), F.concat(at, F.lit(" "), F.col(name)).alias("_order")), "canonical-names")
    near = materialised(near_names(names, "_of", name, "_order", floor), "canonical-near")
    first = names.join(near.select("_of", name).distinct(), ["_of", name], "left_anti")
    decided = materialised(first.select("_of", name, F.lit(True).alias("kept")), "canonical-decided")
    parts, open_ = [decided], near.select("_of", name, "earlier")
    while open_.limit(1).count():
        known = decided.select("_of", F.col(name).alias("earlier"), "kept")
        judged = open_.join(known, ["_of", "earlier"], "left").groupBy("_of", name).agg(F.bool_or("kept").alias("_near"), F.count_if(F.col("kept").isNull()).alias("_wait"))
        fresh = materialised(judged.where("_near or _wait = 0").select("_of", name, (~F.coalesce("_near", F.lit(False))).alias("kept")), "canonical-decided")
        # A name that is decided waits no more, and nothing waits for one that is known not to be canonical.
        gone = decided.where("not kept").select("_of", F.col(name).alias("earlier"))
        open_ = materialised(open_.join(fresh.select("_of", name), ["_of", name], "left_anti").join(gone, ["_of", "earlier"], "left_anti"), "canonical-open")
        parts.append(fresh)
        decided = reduce(DataFrame.unionByName, parts)
    kept = decided.where("kept").select("_of", F.col(name).alias("earlier"))
    ranked = near.join(kept, ["_of", "earlier"]).join(names.select("_of", F.col(name).alias("earlier"), "_order"), ["_of", "earlier"])
    best = ranked.groupBy("_of", name).agg(F.min_by(F.struct("earlier", "score"), F.struct((-F.col("score")).alias("less"), "_order")).alias("_b"))
    # A canonical name has no canonical one near and before it.
    return names.join(best, ["_of", name], "left").select(block, name, F.coalesce("_b.earlier", F.col(name)).alias("canonical"), F.col("_b.score").alias("score"))


def merge_summary(merged: DataFrame, block: str) -> DataFrame:
    """Per canonical name: variants, fuzzy merges, and the weakest score among them."""
    return merged.groupBy(block, "canonical").agg(F.count("*").alias("variants"), F.count("score").alias("fuzzy"), F.min("score").alias("confidence"))


def exact_clusters(works: DataFrame, least: int = 2) -> DataFrame:
    """(cluster_id, agency, description_key, works, first_work) of descriptions that repeat under one agency."""
    rows = works.where("agency is not null and description_key is not null")
    counts = rows.groupBy("agency", "description_key").agg(F.count("*").alias("works"), F.min("work_id").alias("first_work")).where(F.col("works") >= least)
    return counts.select(cluster_id("agency", "description_key").alias("cluster_id"), "agency", "description_key", "works", "first_work")


def tfidf_cosine(rows: DataFrame, id_col: str, text: str, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) for the pairs of ids: words and pairs of words, 1 + ln tf, ln((1 + n) / (1 + df)) + 1, unit length."""
    words = F.split(F.col(text), " ")
    grams = F.concat(words, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at(words, i), F.get(words, i))))
    terms = rows.where(F.length(text) > 0).select(id_col, F.explode(grams).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    n = rows.where(F.length(text) > 0).agg(F.count("*").alias("n"))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    weights = terms.join(df, "term").select(id_col, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = weights.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = weights.join(norms, id_col).select(id_col, "term", (F.col("w") / F.col("norm")).alias("w"))
    left = pairs.join(weights.select(F.col(id_col).alias("a"), "term", F.col("w").alias("wa")), "a")
    dots = left.join(weights.select(F.col(id_col).alias("b"), "term", F.col("w").alias("wb")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
