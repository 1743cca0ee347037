"""States of alerts over time: an append-only log of changes, the state that it folds to, and its compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def record(changes: DataFrame, path: str) -> None:
    """Add changes (alert_id, status, changed_us, change_no) to the log. Recording a change twice does no harm."""
    changes.select("alert_id", "status", "changed_us", "change_no").write.mode("append").parquet(path)


def record_stream(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add a stream of changes to the log."""
    rows = changes.select("alert_id", "status", "changed_us", "change_no")
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def folded(log: DataFrame) -> DataFrame:
    """(alert_id, status, changed_us, change_no): the latest change of each alert, whatever the order they came in; of one
    instant the greater number. Folding is its own union: fold(a + b) = fold(fold(a) + b), so parts combine before the shuffle."""
    latest = F.max_by(F.struct("status", "changed_us", "change_no"), F.struct("changed_us", "change_no"))
    return log.groupBy("alert_id").agg(latest.alias("l")).select("alert_id", "l.*")


def compacted(log: DataFrame, path: str) -> DataFrame:
    """The log with one change per alert, at a new path; it folds to the same states, with later changes too."""
    folded(log).write.mode("overwrite").parquet(path)
    return log.sparkSession.read.schema(log.select("alert_id", "status", "changed_us", "change_no").schema).parquet(path)


def with_states(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts with the status of their latest change and ``updated_us``, when that was; without any, their own and ``at_us``.
    Changes of alerts that are not there are passed over."""
    latest = folded(log).select("alert_id", F.col("status").alias("_status"), F.col("changed_us").alias("_at"))
    joined = alerts.join(latest, "alert_id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).withColumn("updated_us", F.coalesce("_at", "at_us")).drop("_status", "_at")
