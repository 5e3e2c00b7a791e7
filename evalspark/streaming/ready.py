"""Completion detection as a stateful stream (J4, J6): typed state per evaluation, timers, no whole-state text.

State of an evaluation: the requested models (a value), model → (status, time, number) (a map, one entry per answering
model), the deadline (a value) and whether it has fired (a value).  An event reads and writes the entry of its own
model only.  When an evaluation fires, everything but the mark that it has fired is freed; a timer frees the mark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evalspark.operators import status as st

READY_SCHEMA = "evaluation_id string, detail_type string, n_models int"
TIMED_OUT_TYPE = "EvaluationTimedOut"
#: Typed state needs this store; it also keeps state on disk instead of in the executors' heaps.
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ReadyProcessor(StatefulProcessor):
    """Fires once per evaluation: when all its requested models have answered, or at its deadline."""

    def __init__(self, count_failed: bool, timeout_ms: int | None, keep_ms: int | None):
        self.done = {st.RECEIVED, st.FAILED} if count_failed else {st.RECEIVED}
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requested = handle.getValueState("requested", "models array<string>")
        self.models = handle.getMapState("models", "model string", "status string, event_us bigint, event_seq bigint")
        self.deadline = handle.getValueState("deadline", "ms bigint")
        self.fired = handle.getValueState("fired", "since_ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = list(rows)
        times = [r.event_us // 1000 for r in seen if r.event_us >= 0]
        now = max([self._watermark(timerValues), *times])
        if self.fired.exists():
            self._remember(now)  # a late event extends the memory, it never fires again
            return
        self._fold(seen)
        if self.timeout_ms is not None and times and not self.deadline.exists():
            self.deadline.update((min(times) + self.timeout_ms,))
        names = list(self.requested.get()[0]) if self.requested.exists() else []
        if names and all(self._answered(m) for m in names):
            yield self._fire(key, st.READY_TYPE, len(names), now)
        elif self.deadline.exists():
            at = self.deadline.get()[0]
            if at <= self._watermark(timerValues):  # already past it
                yield self._fire(key, TIMED_OUT_TYPE, len(names), now)
            else:
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.fired.exists():
            self.fired.clear()
            return
        names = self.requested.get()[0] if self.requested.exists() else []
        yield self._fire(key, TIMED_OUT_TYPE, len(names), self._watermark(timerValues))

    def close(self) -> None:
        pass

    def _watermark(self, timer_values) -> int:
        """0 in a stream's first batch, and without event time."""
        return max(0, timer_values.getCurrentWatermarkInMs()) if self.timed else 0

    @property
    def timed(self) -> bool:
        return self.timeout_ms is not None or self.keep_ms is not None

    def _fold(self, rows: list[Row]) -> None:
        """Requested models once; per model the latest answer, read and written entry by entry."""
        best: dict[str, tuple] = {}
        for r in rows:
            if r.requested_models is not None and not self.requested.exists():
                self.requested.update((list(dict.fromkeys(r.requested_models)),))
            if r.model is not None and (r.model not in best or (r.event_us, r.event_seq) > best[r.model][1:]):
                best[r.model] = (r.eff_status, r.event_us, r.event_seq)
        for model, new in best.items():
            old = self.models.getValue((model,)) if self.models.containsKey((model,)) else None
            if old is None or new[1:] > (old[1], old[2]):
                self.models.updateValue((model,), new)

    def _answered(self, model: str) -> bool:
        return self.models.containsKey((model,)) and self.models.getValue((model,))[0] in self.done

    def _fire(self, key, kind: str, n: int, now: int) -> Row:
        for state in (self.requested, self.models, self.deadline):
            state.clear()
        self._remember(now)
        return Row(evaluation_id=key[0], detail_type=kind, n_models=n)

    def _remember(self, now: int) -> None:
        self.fired.update((now,))
        if self.timed:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if self.keep_ms is not None:
            self.handle.registerTimer(now + self.keep_ms)


def use_typed_state(spark: SparkSession) -> None:
    """Set the state store that typed state needs, unless the session names one that is no default."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(PROVIDER_CONF, "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER_CONF, PROVIDER)


def stream_ready(
    events: DataFrame,
    evals: DataFrame,
    count_failed: bool = True,
    timeout: str | None = None,
    delay: str = "1 hour",
    keep: str | None = None,
) -> DataFrame:
    """Emit one AllLLMResponsesReady row per open evaluation once all requested models answered.

    ``evals`` has (evaluation_id, requested_models, status) and may be

    * a stream (evaluation records or initiated events): both streams meet in the state, so evaluations
      created after the start count, and responses that come before their evaluation wait for it.  With
      ``timeout`` or ``keep`` it needs an ``event_time`` (or ``created_at``) column for the watermark;
    * a table: a stream-static join, which drops events of unknown or closed evaluations.  A table over
      files keeps the files it had when it was made; use the stream form if evaluations arrive later.

    After firing only a mark is kept, so re-deliveries and restarts fire nothing twice.  ``keep`` (e.g.
    ``"7 days"``) frees the mark once the watermark is that far past the firing; without it marks stay.

    ``timeout`` (e.g. ``"30 minutes"``) adds an event-time deadline after the first event of an
    evaluation: if it is still incomplete when the watermark (``delay``) passes the deadline, one
    ``EvaluationTimedOut`` row is emitted (J6) and later events fire nothing.

    With ``timeout`` or ``keep`` Spark drops events older than the watermark; without both no event is
    dropped, however late.  The query runs in append mode and sets the session's state store (``use_typed_state``).
    """
    use_typed_state(events.sparkSession)
    timeout_ms = None if timeout is None else interval_ms(timeout)
    keep_ms = None if keep is None else interval_ms(keep)
    timed = timeout is not None or keep is not None
    if timed:
        events = events.withWatermark("event_time", delay)
    open_e = st.open_evaluations(evals)
    flat = [
        "evaluation_id",
        "model",
        st.effective_status().alias("eff_status"),
        F.coalesce(F.unix_micros(F.col("event_time").cast("timestamp")), F.lit(-1)).alias("event_us"),
        F.coalesce(F.col("event_seq").cast("long"), F.lit(-1)).alias("event_seq"),
    ]
    late = ["event_time"] if timed else []
    if evals.isStreaming:
        none = F.lit(None).cast("string")
        when = next((F.col(c).cast("timestamp") for c in ("event_time", "created_at") if c in evals.columns), F.lit(None).cast("timestamp"))
        opened = open_e.withColumn("event_time", when)
        if timed:
            opened = opened.withWatermark("event_time", delay)
        opened = opened.select(
            "evaluation_id", none.alias("model"), none.alias("eff_status"),
            F.coalesce(F.unix_micros("event_time"), F.lit(-1)).alias("event_us"), F.lit(-1).cast("long").alias("event_seq"),
            "requested_models", *late,
        )
        rows = events.select(*flat, F.lit(None).cast("array<string>").alias("requested_models"), *late).unionByName(opened)
    else:
        rows = events.join(open_e.select("evaluation_id", "requested_models"), "evaluation_id").select(*flat, "requested_models", *late)
    work = ReadyProcessor(count_failed, timeout_ms, keep_ms)
    return rows.groupBy("evaluation_id").transformWithState(work, READY_SCHEMA, "append", "EventTime" if timed else "None")


def interval_ms(text: str) -> int:
    n, unit = text.split()
    scale = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    return int(float(n) * scale[unit.rstrip("s")])
