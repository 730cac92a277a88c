"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text without its white space is cut into blocks of ``BLOCK`` code points. Blocks
get integer names: equal blocks the same name, different blocks different names.
Then adjacent names are paired and the pairs named, level by level, until a
document has one name. Two documents have the same level and name exactly when
their normalised texts are equal: naming compares contents, so no hash collision
can join two texts.

Names are made from a 64-bit hash of the block, after all contents with one hash
were compared in an aggregation; blocks of a hash that stands for several contents
are named by their contents themselves. So the contents are shuffled once, after a
map-side combine, and the later levels move integers only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, packed, stored, text_or_empty

#: Code points in a block.
BLOCK = 4096
#: Ranges of the hash within which names are counted up; a name is rank * SLOTS + range.
SLOTS = 1 << 16


def normalised(text: str | Column) -> Column:
    return F.translate(text_or_empty(text), SPACES, "")


def _blocks(norm: Column, size: int) -> Column:
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _named(distinct: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds an integer to each row of a table of distinct keys; the same keys get the same integers."""
    slot = F.pmod(F.xxhash64(*order), F.lit(SLOTS))
    rank = F.row_number().over(W.partitionBy("_slot").orderBy(*order)).cast("long")
    return distinct.withColumn("_slot", slot).withColumn(name, rank * SLOTS + F.col("_slot")).drop("_slot")


def identities(rows: DataFrame, norm: str = "norm", block: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``rows`` plus ``level`` and ``name``, which are equal for rows with equal ``norm`` only; ``norm`` itself goes.

    ``hashed`` may be any function of a block, even one with many collisions.
    """
    blocks = _blocks(F.col(norm), block)
    keep = [c for c in rows.columns if c != norm]
    numbered = rows.withColumn("_uid", F.monotonically_increasing_id())
    hashes = [*keep, "_uid", F.transform(blocks, lambda b: hashed(b)).alias("_hashes")]
    docs = stored(numbered.select(*hashes), "dedup-hashes")

    contents = rows.select(F.explode(blocks).alias("block")).select(hashed(F.col("block")).alias("hash"), "block")
    checked = stored(contents.groupBy("hash").agg((F.min("block") != F.max("block")).alias("several")), "dedup-checked")
    names = _named(checked.where(~F.col("several")).select("hash"), ["hash"], "name").select("hash", (F.col("name") * 2).alias("name"))

    collided = checked.where("several").limit(1).count() > 0
    if collided:
        numbered = stored(numbered, "dedup-rows")
        docs = numbered.select(*hashes)
    items = docs.select("_uid", F.posexplode("_hashes").alias("idx", "hash"))
    items = items.join(names, "hash", "left")
    if collided:
        # Blocks whose hash stands for several contents: each content is named by itself.
        odd = checked.where("several").select("hash")
        apart = contents.join(odd, "hash", "left_semi").distinct()
        by_content = _named(apart.select("block"), ["block"], "odd").select("block", (F.col("odd") * 2 + 1).alias("odd"))
        at = numbered.select("_uid", F.posexplode(blocks).alias("idx", "block"))
        at = at.join(by_content, "block").select("_uid", "idx", "odd")
        items = items.join(at, ["_uid", "idx"], "left").withColumn("name", F.coalesce("name", "odd"))
    items = stored(items.select("_uid", "idx", "name"), "dedup-level0")

    done, level = None, 0
    while True:
        # A document whose highest index at this level is 0 has its one name.
        pairs = items.groupBy("_uid", F.floor(F.col("idx") / 2).cast("int").alias("up")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("b")
        )
        ended = F.col("up").eqNullSafe(F.lit(0)) & F.col("b").isNull()
        pairs = stored(pairs.withColumn("ended", ended), f"dedup-pairs{level}")
        ready = pairs.where("ended").select("_uid", F.lit(level).alias("level"), F.col("a").alias("name"))
        done = ready if done is None else done.unionByName(ready)
        rest = pairs.where("not ended")
        if not rest.limit(1).count():
            break
        key = rest.withColumn("b", F.coalesce("b", F.lit(-1)))
        fresh = _named(key.select("a", "b").distinct(), ["a", "b"], "name")
        items = stored(key.join(fresh, ["a", "b"]).select("_uid", F.col("up").alias("idx"), "name"), f"dedup-level{level + 1}")
        level += 1
    return docs.drop("_hashes").join(done, "_uid")


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty and blank texts are equal to each other.
    Of equal texts the one with the most code points in the original text stays,
    then the smallest id (null ids last). Rows that repeat an id are rows of their own
    and count in group_size; where several would stay, all with that id are kept.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = documents.select(F.col(id_col).alias("_id"), F.length(text_or_empty(text_col)).alias("_chars"), normalised(text_col).alias("norm"))
    rows = rows.withColumn("_sha", F.sha2("norm", 256))
    docs = identities(rows, block=block, hashed=hashed)
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("id")))
    groups = docs.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best"))
    out = docs.join(groups, ["level", "name"])
    kept = F.col("_id").eqNullSafe(F.col("best.id")) & (F.col("_chars") == -F.col("best.c"))
    return out.select(F.col("_id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which no better copy exists, with all their columns; of rows that repeat an id and text, one."""
    key = {"_stay_id": F.col(id_col), "_stay_sha": F.sha2(normalised(text_col), 256), "_stay_chars": F.length(text_or_empty(text_col))}
    groups = exact_groups(documents.select(id_col, text_col), id_col, text_col).where("kept")
    stays = groups.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = documents.select(packed(documents).alias("_doc"), *[c.alias(n) for n, c in key.items()])
    same = F.col("_stay_id").eqNullSafe(F.col("_id")) & (F.col("_stay_sha") == F.col("_sha"))
    rows = rows.join(stays.hint("merge"), same, "left_semi")
    best = W.partitionBy("_stay_id", "_stay_sha").orderBy(F.desc("_stay_chars"))
    return rows.withColumn("_no", F.row_number().over(best)).where("_no = 1").select("_doc.*")
