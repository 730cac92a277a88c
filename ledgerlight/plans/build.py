"""The batch build: every table of the corpus written to a folder, as one set that is published at once, with an audit log and versions."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, casework, rollups
from ..sources.tables import materialised
from . import corpus

RULES = Path(corpus.__file__).with_name("synthetic_rules.yaml")
#: What is written, besides the log and the versions.
WRITTEN = ("works", "shares", "cases", "hits", "rollup_state", "rollup_district", "rollup_agency", "rollup_member")


MANIFEST = "seq long, build string"
#: Parts of the stored log, by the hash of the case.
LOG_BUCKETS = 64


def bucket() -> Column:
    return F.pmod(F.xxhash64("case_id"), F.lit(LOG_BUCKETS)).cast("int")


def versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(casework.versions(corpus.rulebook(), RULES.read_text(encoding="utf-8")), casework.VERSION_SCHEMA)


def opening_log(cases: DataFrame) -> DataFrame:
    """The opening events of all cases as rows of the log, hashed in a chain for each case. They are dated to the corpus, not to today."""
    rows = audit.opening_chains(cases)
    payload = F.to_json(F.struct("rule_id", "score"), {"ignoreNullFields": "false"})
    at, actor = F.lit(f"{corpus.AS_OF}T00:00:00"), F.lit("system")
    return audit.chained(rows.select("id", "case_id", "event", at.alias("at"), actor.alias("actor"), actor.alias("actor_role"), F.lit(None).cast("string").alias("actor_id"), payload.alias("payload_json")), dealt=True)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(seq, build): the sets of tables that were published to a folder, the current one with the highest seq; empty where there is none."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, out: str) -> str:
    """The folder of the current set of tables; an error where none was published."""
    last = manifest(spark, out).orderBy(F.desc("seq")).first()
    if last is None:
        raise ValueError(f"nothing was published to {out}")
    return f"{out}/builds/{last['build']}"


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the current set. All that is read by one name resolves to one set, whatever builds are under way."""
    return spark.read.parquet(f"{current(spark, out)}/{name}")


def build(spark: SparkSession, sf_dir: str, out: str, findings: bool = False) -> dict[str, DataFrame]:
    """Writes all tables as a new set under ``out``, publishes it in one step, and gives them as read back.

    Tables are written under the build's own id, and the manifest gets a row for it last, in one small file: a build that
    fails at any table leaves what is read as it was. Running it again gives the same tables, and the inputs are read
    anew: what the session built from them before is forgotten. No cases, or rollups that don't sum them up, are an
    error. The log lies in LOG_BUCKETS parts by case, of which an append reads those of its own cases.
    With ``findings`` the badges of all four kinds are made anew and belong to the set; two of them fit a model.
    """
    corpus.forget(sf_dir)
    made = {name: corpus.built(spark, sf_dir, name) for name in (*WRITTEN, *(("findings",) if findings else ()))}
    if not made["cases"].limit(1).count():
        raise ValueError(f"no cases in {sf_dir}")
    made |= {"rulebook_versions": versions(spark), "audit_log": opening_log(made["cases"]).withColumn("bucket", bucket())}
    name_of_build = uuid.uuid4().hex
    folder = f"{out}/builds/{name_of_build}"
    for name, rows in made.items():
        (rows.write.partitionBy("bucket") if name == "audit_log" else rows.write).option("compression", "zstd").parquet(f"{folder}/{name}")
    found = {name: spark.read.schema(rows.schema).parquet(f"{folder}/{name}") for name, rows in made.items()}
    if rollups.stale(found["rollup_state"], found["cases"]):
        raise ValueError("the rollups are not those of the cases")
    seq = manifest(spark, out).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
    spark.createDataFrame([(seq, name_of_build)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{out}/manifest")
    return found


def drop_old(spark: SparkSession, out: str, keep: int = 1) -> int:
    """Removes all sets but the newest ``keep`` that were published, those of failed builds too; gives the number removed.

    Not to be run while a build is under way, whose set isn't published yet.
    """
    wanted = {r["build"] for r in manifest(spark, out).orderBy(F.desc("seq")).limit(keep).collect()}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/builds")
    files, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for found in files.listStatus(root) if files.exists(root) else []:
        if found.getPath().getName() not in wanted:
            gone += bool(files.delete(found.getPath(), True))
    return gone


def append_events(spark: SparkSession, log: str, events: DataFrame) -> int:
    """Adds a batch of events to the stored log, as ``audit.appended`` says; none of its rows is ever changed. Gives the number added.

    The batch is chained first and written in one step, so a run that fails leaves the log as it was; sent again, it adds
    what isn't there. Batches are appended one at a time.
    """
    events = materialised(events, "audit-batch")
    parts = [r[0] for r in events.select(bucket()).distinct().collect()]  # LOG_BUCKETS of them at most
    rows = materialised(audit.appended(spark.read.parquet(log).where(F.col("bucket").isin(parts)), events), "audit-rows")
    rows.withColumn("bucket", bucket()).write.mode("append").partitionBy("bucket").option("compression", "zstd").parquet(log)
    return rows.count()
