"""Response status tracking and completion detection, batch form.

The streaming twins in ``evalspark.streaming`` call the same column functions.  Per-evaluation
collections (status maps) are bounded by the number of models of one evaluation; the
(evaluation, model) reductions are partial aggregations, so a hot evaluation collapses map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

# Event detail types and statuses.
RECEIVED_TYPE, FAILED_TYPE, READY_TYPE, INITIATED_TYPE = (
    "LLMResponseReceived",
    "LLMResponseFailed",
    "AllLLMResponsesReady",
    "EvaluationInitiated",
)
RECEIVED, FAILED, PENDING = "RECEIVED", "FAILED", "PENDING"
INITIATED, PROCESSING, COMPLETED = "INITIATED", "PROCESSING", "COMPLETED"
OPEN_STATES = [INITIATED, PROCESSING]

DETAIL_SCHEMA = StructType(
    [
        StructField("evaluation_id", StringType()),
        StructField("llm_name", StringType()),
        StructField("status", StringType()),
        StructField("error", StringType()),
        StructField("s3_key", StringType()),
    ]
)
# Timestamps travel as ISO text with microseconds.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

ENVELOPE_SCHEMA = StructType(
    [
        StructField("detail-type", StringType()),
        StructField("time", TimestampType()),
        StructField("seq", LongType()),
        StructField("detail", DETAIL_SCHEMA),
    ]
)


def to_envelopes(events: DataFrame) -> DataFrame:
    """status_events rows → JSON envelope text (the event-bus form)."""
    detail = F.struct(
        F.col("evaluation_id"),
        F.col("model").alias("llm_name"),
        F.col("status"),
        F.col("error"),
        F.col("response_key").alias("s3_key") if "response_key" in events.columns else F.lit(None).cast("string").alias("s3_key"),
    )
    env = F.struct(
        F.col("detail_type").alias("detail-type"),
        F.col("event_time").cast("timestamp").alias("time"),
        F.col("event_seq").alias("seq"),
        detail.alias("detail"),
    )
    return events.select(F.to_json(env, JSON_OPTIONS).alias("value"))


def initiated_envelopes(evals: DataFrame) -> DataFrame:
    """Evaluation records → EvaluationInitiated envelopes, JSON text."""
    detail = F.struct("evaluation_id", "prompt", "reference_answer", "context", F.col("requested_models").alias("selected_llms"))
    env = F.struct(F.lit(INITIATED_TYPE).alias("detail-type"), F.col("created_at").alias("time"), detail.alias("detail"))
    return evals.select(F.to_json(env, JSON_OPTIONS).alias("value"))


def ready_envelopes(ready: DataFrame) -> DataFrame:
    """Ready rows → AllLLMResponsesReady envelopes, JSON text."""
    env = F.struct(F.lit(READY_TYPE).alias("detail-type"), F.struct("evaluation_id").alias("detail"))
    return ready.select(F.to_json(env, JSON_OPTIONS).alias("value"))


INITIATED_SCHEMA = (
    "`detail-type` string, time timestamp, detail struct<evaluation_id: string, prompt: string, reference_answer: string, "
    "context: string, selected_llms: array<string>>"
)


def parse_initiated(raw: DataFrame, col: str = "value") -> DataFrame:
    """EvaluationInitiated envelopes → open evaluation records; the stream form of the evaluation table."""
    e = raw.select(F.from_json(F.col(col), INITIATED_SCHEMA, JSON_OPTIONS).alias("e")).where(F.col("e.`detail-type`") == INITIATED_TYPE)
    return e.select(
        "e.detail.evaluation_id", "e.detail.prompt", "e.detail.reference_answer", "e.detail.context",
        F.col("e.detail.selected_llms").alias("requested_models"), F.lit(INITIATED).alias("status"), F.col("e.time").alias("created_at"),
    )


def parse_events(raw: DataFrame, col: str = "value") -> DataFrame:
    """Envelope JSON text → flat status events (A6, J1).  Missing fields stay null."""
    e = raw.select(F.from_json(F.col(col), ENVELOPE_SCHEMA, JSON_OPTIONS).alias("e"))
    return e.select(
        F.col("e.detail.evaluation_id").alias("evaluation_id"),
        F.col("e.detail.llm_name").alias("model"),
        F.col("e.`detail-type`").alias("detail_type"),
        F.col("e.detail.status").alias("status"),
        F.col("e.detail.error").alias("error"),
        F.col("e.detail.s3_key").alias("response_key"),
        F.col("e.time").alias("event_time"),
        F.col("e.seq").alias("event_seq"),
    )


def read_events(spark, path: str, streaming: bool = False) -> DataFrame:
    """Envelope files (one JSON object per line) → flat events; ``streaming`` gives a stream."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.schema("value string").text(path)
    return parse_events(raw, "value")


def effective_status(legacy_default: bool = False) -> Column:
    """Status written for an event (J3, D1): explicit status, else FAILED for a failure event and
    RECEIVED otherwise; ``legacy_default=True`` defaults every missing status to RECEIVED."""
    if legacy_default:
        return F.coalesce(F.col("status"), F.lit(RECEIVED))
    return F.coalesce(F.col("status"), F.when(F.col("detail_type") == FAILED_TYPE, F.lit(FAILED)).otherwise(F.lit(RECEIVED)))


def latest_status(events: DataFrame, legacy_default: bool = False) -> DataFrame:
    """Last-arrival-wins status per (evaluation, model), ordered by (event_time, event_seq)."""
    order = F.struct("event_time", "event_seq")
    return events.groupBy("evaluation_id", "model").agg(
        F.max_by(effective_status(legacy_default), order).alias("status"),
        F.max(order).alias("_last"),
    ).select("evaluation_id", "model", "status", F.col("_last.event_time").alias("updated_at"))


def status_map(evals: DataFrame, latest: DataFrame) -> DataFrame:
    """Per evaluation: ``responses_received`` map = PENDING for every requested model, overwritten by
    the latest event status; models that were not requested also enter the map (D4)."""
    pending = evals.select("evaluation_id", F.explode(F.array_distinct("requested_models")).alias("model")).select(
        "evaluation_id", "model", F.lit(PENDING).alias("status"), F.lit(0).alias("prio")
    )
    seen = latest.join(evals.select("evaluation_id"), "evaluation_id", "left_semi").select(
        "evaluation_id", "model", "status", F.lit(1).alias("prio")
    )
    cur = pending.unionByName(seen).groupBy("evaluation_id", "model").agg(F.max_by("status", "prio").alias("status"))
    m = cur.groupBy("evaluation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "status")))).alias("responses_received"))
    base = evals.drop("responses_received")  # a stored map (e.g. from ``initiate``) is replaced
    return base.join(m, "evaluation_id", "left").withColumn(
        "responses_received", F.coalesce("responses_received", F.create_map().cast("map<string,string>"))
    )


def open_evaluations(evals: DataFrame) -> DataFrame:
    """Evaluations still INITIATED or PROCESSING (A4); the filter reaches the Parquet scan."""
    return evals.where(F.col("status").isin(OPEN_STATES))


def _status_of(m: Column) -> Column:
    return F.try_element_at(F.col("responses_received"), m)


def received_count(withmap: DataFrame) -> DataFrame:
    """Requested models (de-duplicated) whose status is RECEIVED (G1)."""
    req = F.array_distinct("requested_models")
    return withmap.withColumn("n_requested", F.size(req)).withColumn(
        "n_received", F.size(F.filter(req, lambda m: _status_of(m) == RECEIVED))
    )


def is_complete(count_failed: bool = True) -> Column:
    """All requested models answered (G2, D2): RECEIVED, or FAILED too when ``count_failed``."""
    done = [RECEIVED, FAILED] if count_failed else [RECEIVED]
    req = F.array_distinct("requested_models")
    return (F.size(req) > 0) & F.forall(req, lambda m: F.coalesce(_status_of(m).isin(done), F.lit(False)))


def ready_evaluations(withmap: DataFrame, count_failed: bool = True, refire: bool = True) -> DataFrame:
    """Open evaluations that are complete → ready events with the new status.

    The PROCESSING guard: an INITIATED evaluation moves to PROCESSING; a PROCESSING one fires again
    only with ``refire=True`` (the reference's behaviour); the stream emits once.
    """
    ready = open_evaluations(withmap).where(is_complete(count_failed))
    if not refire:
        ready = ready.where(F.col("status") == INITIATED)
    return ready.select("evaluation_id", F.lit(PROCESSING).alias("new_status"), F.lit(READY_TYPE).alias("detail_type"))


def progress(withmap: DataFrame) -> DataFrame:
    """Missing models (sorted) and ``received/requested`` text for open evaluations."""
    rc = received_count(open_evaluations(withmap))
    missing = F.array_sort(F.filter(F.array_distinct("requested_models"), lambda m: F.coalesce(_status_of(m) != RECEIVED, F.lit(True))))
    return rc.select(
        "evaluation_id",
        missing.alias("missing"),
        F.concat(F.col("n_received").cast("string"), F.lit("/"), F.col("n_requested").cast("string")).alias("progress"),
    )


def timed_out(withmap: DataFrame, as_of, timeout_seconds: int, count_failed: bool = True) -> DataFrame:
    """Open, incomplete evaluations older than the timeout at ``as_of`` (J6, batch form)."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")
    return open_evaluations(withmap).where(~is_complete(count_failed) & (age > timeout_seconds)).select(
        "evaluation_id", F.lit(FAILED).alias("new_status"), age.alias("age_seconds")
    )


def lookup(ids: DataFrame, evals: DataFrame) -> DataFrame:
    """Event ids ⋈ evaluation records; unknown ids kept with ``found = false``."""
    e = evals.withColumn("_found", F.lit(True))
    return ids.join(e, "evaluation_id", "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def accepted_events(events: DataFrame, evals: DataFrame) -> DataFrame:
    """Status events of known evaluations (C4)."""
    return events.join(evals.select("evaluation_id"), "evaluation_id", "left_semi")


def rejected_events(events: DataFrame, evals: DataFrame) -> DataFrame:
    """Status events of unknown evaluations, for a quarantine table (C4)."""
    return events.join(evals.select("evaluation_id"), "evaluation_id", "left_anti")


def completion_rows(ready: DataFrame, failed_ids: DataFrame | None = None, batch_id: int = 0) -> DataFrame:
    """State rows written at the end of scoring (S5): COMPLETED with the final key, or FAILED.  The key is
    that of the document which ``write_final_metrics`` puts into the folder of the same batch."""
    done = ready.select(
        "evaluation_id",
        F.lit(COMPLETED).alias("status"),
        F.concat(F.lit(f"batch_id={int(batch_id)}/"), F.col("evaluation_id")).alias("final_key"),
        F.lit(None).cast("string").alias("error_message"),
        F.current_timestamp().alias("completion_timestamp"),
    )
    if failed_ids is None:
        return done
    bad = failed_ids.select(
        "evaluation_id",
        F.lit(FAILED).alias("status"),
        F.lit(None).cast("string").alias("final_key"),
        F.concat(F.lit("Overall Calculation Failure: "), F.col("error")).alias("error_message"),
        F.current_timestamp().alias("completion_timestamp"),
    )
    return done.unionByName(bad)


def current_state(state_rows: DataFrame) -> DataFrame:
    """Latest state per evaluation from appended state rows (``max_by`` on (time, rank))."""
    rank = F.when(F.col("status") == COMPLETED, 3).when(F.col("status") == FAILED, 2).when(F.col("status") == PROCESSING, 1).otherwise(0)
    order = F.struct(F.col("state_time"), rank)
    return state_rows.groupBy("evaluation_id").agg(
        F.max_by("status", order).alias("status"), F.max_by("final_key", order).alias("final_key")
    )
