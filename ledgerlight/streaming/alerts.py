"""Alerts raised from a stream of cases, each once: a micro-batch tops up the alert table by what it hasn't got."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.alerts import new_alerts


def alert_stream(cases: DataFrame, alerts_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends alerts for HIGH cases to the Parquet table at ``alerts_path`` (case_id, kind, score, batch).

    A batch that is run again after a failure finds its alerts there and adds none.
    """

    def top_up(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "case_id string, kind string, score long, batch long"
        try:
            there = spark.read.schema(schema).parquet(alerts_path)
            there.limit(1).count()
        except Exception as e:  # no alert has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = spark.createDataFrame([], schema)
        fresh = new_alerts(batch.dropDuplicates(["case_id"]), there)
        fresh.selectExpr("case_id", "kind", "cast(score as long) as score", f"{number}L as batch").write.mode("append").parquet(alerts_path)

    return cases.writeStream.foreachBatch(top_up).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
