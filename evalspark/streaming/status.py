"""Streaming status tracking (J1-J3, J5); completion detection is in ``streaming.ready``.

Each function takes a streaming DataFrame of flat status events (``operators.status.parse_events``
over ``readStream``) and reuses the batch column functions, so stream and batch agree.
Sinks are idempotent per micro-batch id, so a restart from the checkpoint writes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators import status as st
from evalspark.streaming.ready import READY_SCHEMA, TIMED_OUT_TYPE, stream_ready  # noqa: F401


def dedup_events(events: DataFrame, delay: str = "1 hour", keys=("evaluation_id", "model", "detail_type", "event_seq")) -> DataFrame:
    """Drop at-least-once re-deliveries of the same event within the watermark delay."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(keys))


def status_updates(events: DataFrame, legacy_default: bool = False) -> DataFrame:
    """Keyed upsert, last arrival wins, as a streaming aggregation (J2, J3); run in update mode."""
    order = F.struct("event_time", "event_seq")
    return events.groupBy("evaluation_id", "model").agg(
        F.max_by(st.effective_status(legacy_default), order).alias("status"), F.max(order).alias("_last")
    ).select("evaluation_id", "model", "status", F.col("_last.event_time").alias("updated_at"), F.col("_last.event_seq").alias("updated_seq"))


def write_status_updates(updates: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Start the upsert stream: every micro-batch's changed keys go to ``path/batch_id=<id>``
    (overwritten on replay); the current map is ``current_status(spark, path)``.  ``checkpoint``
    defaults to ``<spark.checkpoint.dir>/streams/status_updates``."""
    from evalspark.session import stream_checkpoint

    checkpoint = checkpoint or stream_checkpoint(updates.sparkSession, "status_updates")

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    w = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def current_status(spark, path: str) -> DataFrame:
    """Latest status per (evaluation, model) over all written micro-batches."""
    rows = spark.read.parquet(path)
    order = F.struct("updated_at", "updated_seq")
    return rows.groupBy("evaluation_id", "model").agg(F.max_by("status", order).alias("status"))
