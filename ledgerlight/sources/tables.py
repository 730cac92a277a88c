"""Tables in the folder that all executors share, and loosely typed exports."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, a temporary one for local sessions, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _local_folder() if re.match(r"local(\[|$)", spark.sparkContext.master) else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back, which cuts their lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def loose(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve(columns: list[str], wanted: str) -> str:
    """The column meant by a name: equal but for case and punctuation, else the one that contains it or is contained."""
    key = loose(wanted)
    exact = [c for c in columns if loose(c) == key]
    near = [c for c in columns if key in loose(c) or loose(c) and loose(c) in key]
    if not (exact or near):
        raise KeyError(f"no column {wanted} among {columns}")
    return (exact or near)[0]


def read_export(spark: SparkSession, path: str, house: str) -> DataFrame:
    """A CSV export as text columns, with _row_number from 1, _source_file and _house; nothing is dropped or inferred.

    Exports are single files of some megabytes, quoted over several lines, so Spark reads each in one task and row
    numbers follow its order.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8", quote='"', escape='"', inferSchema=False, nullValue="\u0000", emptyValue="")
    return raw.withColumn("_row_number", F.monotonically_increasing_id() + 1).withColumn("_source_file", F.element_at(F.split(F.lit(path), "/"), -1)).withColumn("_house", F.lit(house))


def read_all(spark: SparkSession, paths: dict[tuple[str, str], str]) -> dict[str, DataFrame]:
    """{dataset: rows of both houses} for {(dataset, house): path}; columns that a house lacks are null."""
    found: dict[str, DataFrame] = {}
    for (dataset, house), path in paths.items():
        part = read_export(spark, path, house)
        found[dataset] = part if dataset not in found else found[dataset].unionByName(part, allowMissingColumns=True)
    return found
