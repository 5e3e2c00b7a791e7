"""Events with and without an evaluation (C4) as a stream, and re-deliveries (J5) as a table.

``route_events`` joins the event stream with the stream of evaluations.  An event waits in the join's state until its
evaluation comes; when the watermark passes the time by which it could come, the event leaves without one and is
quarantined.  ``drop_redelivered`` is the batch twin of ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPTED, QUARANTINED = "accepted", "quarantined"


def route_events(events: DataFrame, evals: DataFrame, wait: str = "1 hour", before: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """``events`` plus ``route``, as a stream (or a table, if both are tables).

    An event is accepted if its evaluation was created at most ``before`` earlier or ``wait`` later than the event's time;
    otherwise it comes out as quarantined, once the watermark (``delay`` behind the newest times of both streams) says that
    no such evaluation can come any more.  Repeated records of an evaluation within that span would repeat the event: the
    evaluations are made unique by id within the watermark first.
    """
    e = events.withWatermark("event_time", delay) if events.isStreaming else events
    known = evals.select(F.col("evaluation_id").alias("known_id"), F.col("created_at").cast("timestamp").alias("created_at"))
    if evals.isStreaming:
        known = known.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["known_id"])
    else:
        known = known.groupBy("known_id").agg(F.min("created_at").alias("created_at"))
    span = F.col("created_at").between(F.col("event_time") - F.expr(f"INTERVAL {before}"), F.col("event_time") + F.expr(f"INTERVAL {wait}"))
    j = e.join(known, (F.col("evaluation_id") == F.col("known_id")) & span, "leftOuter")
    route = F.when(F.col("known_id").isNotNull(), ACCEPTED).otherwise(QUARANTINED)
    return j.withColumn("route", route).select(*events.columns, "route")


def write_routes(routed: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Start the stream; a micro-batch's rows go to ``path/batch_id=<n>/route=<route>``, replaced on replay."""
    from evalspark.session import stream_checkpoint

    checkpoint = checkpoint or stream_checkpoint(routed.sparkSession, "route_events")

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch_id={batch_id}")

    w = routed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def drop_redelivered(events: DataFrame, delay: str = "1 hour", keys=("evaluation_id", "model", "detail_type", "event_seq")) -> DataFrame:
    """One row per delivery that counts: ``events`` without those that repeat a key within ``delay`` of the one kept before.

    Deliveries of a key are put into groups at gaps longer than ``delay``; the first of a group counts.  In a group
    that is longer than ``delay`` as a whole the first one behind the delay counts again, and so on: each round finds one more
    in all such groups by a grouped minimum.  Gaps are sought between blocks of one delay, so a key with a third of all rows
    is as many rows in one task as its time span has delays.  Of deliveries with equal time the least row counts.  Rows without a
    time are never dropped; null keys equal each other.
    """
    from evalspark.session import materialize
    from evalspark.streaming.ready import interval_ms

    span = interval_ms(delay) * 1000
    names, keys = events.columns, list(keys)
    same = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    t = events.select("*", _micros("event_time").alias("_t"), same.alias("_k"))
    timeless = t.where(F.col("_t").isNull()).select(*names)
    rest = F.struct(*[c for c in names if c not in keys])
    one = t.where(F.col("_t").isNotNull()).groupBy("_k", *keys, "_t").agg(F.min(rest).alias("_row"))
    one = materialize(one.withColumn("_block", F.floor(F.col("_t") / span)))

    def on(left: DataFrame, right: DataFrame, cols: list[str]) -> list[Column]:
        return [left[c].eqNullSafe(right[f"_of_{c}"]) for c in cols]

    def other(df: DataFrame, cols: list[str], *more: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"_of_{c}") for c in cols], *more)

    key = ["_k", *keys]
    blocks = one.groupBy(*key, "_block").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    order = Window.partitionBy(*key).orderBy("_block")
    starts = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) > span, F.lit(True))
    blocks = blocks.withColumn("_starts", starts.cast("long")).withColumn("_group", F.sum("_starts").over(order))
    group = [*key, "_group"]
    groups = blocks.groupBy(*group).agg(F.min("_lo").alias("_last"), F.max("_hi").alias("_end"))
    b = other(blocks, [*key, "_block"], "_group")
    placed = materialize(one.join(b, on(one, b, [*key, "_block"])).select(*one.columns, "_group"))
    found, kept = materialize(groups), []
    while not found.isEmpty():
        f = other(found, group, F.col("_last").alias("_at"))
        kept.append(placed.join(f, on(placed, f, group) + [F.col("_t") == F.col("_at")]).select(*placed.columns))
        more = other(found.where(F.col("_end") - F.col("_last") > span), group, "_last", "_end")
        behind = placed.join(more, on(placed, more, group)).where(F.col("_t") - F.col("_last") > span)
        found = materialize(behind.groupBy(*group, "_end").agg(F.min("_t").alias("_last")))
    out = placed.limit(0)
    for k in kept:
        out = out.unionByName(k)
    return out.select(*keys, "_row.*").select(*names).unionByName(timeless)
