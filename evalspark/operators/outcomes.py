"""Per-model outcome of an evaluation and the final metrics document.

Precedence (B11): SKIPPED_NOT_RECEIVED (status is not RECEIVED) → ERROR_PROCESSING_S3_RESPONSE
(no stored response object) → EMPTY_RESPONSE (response null or '') → COMPLETED.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.scalar import is_truthy, response_key

# Outcome names.
SKIPPED, ERROR_OBJECT, EMPTY, COMPLETED = "SKIPPED_NOT_RECEIVED", "ERROR_PROCESSING_S3_RESPONSE", "EMPTY_RESPONSE", "COMPLETED"


def classify_outcomes(withmap: DataFrame, responses: DataFrame) -> DataFrame:
    """(evaluation × requested model) ⋈ response objects (left) → outcome, message, response."""
    fan = withmap.select(
        "evaluation_id",
        F.explode(F.array_distinct("requested_models")).alias("model"),
        "responses_received",
    ).select("evaluation_id", "model", F.try_element_at("responses_received", F.col("model")).alias("model_status"))
    obj = responses.select("evaluation_id", "model", "response", F.lit(True).alias("_has_object"))
    j = fan.join(obj, ["evaluation_id", "model"], "left")
    received = F.coalesce(F.col("model_status") == "RECEIVED", F.lit(False))
    outcome = (
        F.when(~received, F.lit(SKIPPED))
        .when(F.col("_has_object").isNull(), F.lit(ERROR_OBJECT))
        .when(~is_truthy("response"), F.lit(EMPTY))
        .otherwise(F.lit(COMPLETED))
    )
    message = (
        F.when(~received, F.concat(F.lit("response for "), F.col("model"), F.lit(" was not marked as RECEIVED")))
        .when(F.col("_has_object").isNull(), F.concat(F.lit("no response object at "), response_key("evaluation_id", "model")))
        .when(~is_truthy("response"), F.lit("response object was empty or malformed"))
    )
    return j.select(
        "evaluation_id",
        "model",
        outcome.alias("outcome"),
        message.alias("message"),
        F.when(outcome == COMPLETED, F.col("response")).alias("response"),
    )


def to_final_metrics(outcomes: DataFrame, scores: DataFrame, evals: DataFrame | None = None) -> DataFrame:
    """One document per evaluation (S4): the evaluation's ``prompt``, ``reference_answer`` and ``context``
    (from ``evals``; null columns without it, an absent context is '') and ``model_comparisons map<model,
    struct<status, llm_response, metrics map<metric,double>, error, message>>``.  ``error`` holds the text of
    a failed or empty response, ``message`` that of a skipped one.

    ``scores`` is long (evaluation_id, model, metric, score): text metrics and whatever else was scored
    (``scoring.judge_scores``, ``scoring.cosine_metric``).  A repeated metric is averaged.  Collections are
    per evaluation and bounded by its models × metrics.
    """
    once = scores.groupBy("evaluation_id", "model", "metric").agg(F.avg("score").alias("score"))
    m = once.groupBy("evaluation_id", "model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "score")))).alias("metrics")
    )
    failed = F.col("outcome").isin(ERROR_OBJECT, EMPTY)
    per_model = outcomes.join(m, ["evaluation_id", "model"], "left").select(
        "evaluation_id",
        F.struct(
            "model",
            F.struct(
                F.col("outcome").alias("status"),
                F.col("response").alias("llm_response"),
                F.when(F.col("outcome") == COMPLETED, F.col("metrics")).alias("metrics"),
                F.when(failed, F.col("message")).alias("error"),
                F.when(~failed, F.col("message")).alias("message"),
            ).alias("result"),
        ).alias("entry"),
    )
    doc = per_model.groupBy("evaluation_id").agg(F.map_from_entries(F.collect_list("entry")).alias("model_comparisons"))
    head = ["prompt", "reference_answer", "context"]
    if evals is None:
        doc = doc.select("*", *[F.lit(None).cast("string").alias(c) for c in head])
    else:
        known = [F.col(c).cast("string").alias(c) if c in evals.columns else F.lit(None).cast("string").alias(c) for c in head]
        doc = doc.join(evals.select("evaluation_id", *known), "evaluation_id", "left")
    return doc.select("evaluation_id", "prompt", "reference_answer", F.coalesce("context", F.lit("")).alias("context"), "model_comparisons")


def flatten_final_metrics(doc: DataFrame) -> DataFrame:
    """Document → flat rows (evaluation_id, model, status, metric, score) for checks and tables."""
    e = doc.select("evaluation_id", F.explode("model_comparisons").alias("model", "r"))
    return e.select(
        "evaluation_id", "model", F.col("r.status").alias("status"), F.explode_outer("r.metrics").alias("metric", "score")
    )


def write_final_metrics(doc: DataFrame, path: str, batch_id: int = 0) -> None:
    """JSON documents, one per line, in the folder ``batch_id=<id>``: as many files as the plan has
    partitions, however many evaluations there are.  Writing a batch again replaces it."""
    lines = doc.select(F.to_json(F.struct(*doc.columns), {"ignoreNullFields": "true"}).alias("value"))
    lines.write.mode("overwrite").text(f"{path.rstrip('/')}/batch_id={int(batch_id)}")


DOCUMENT_SCHEMA = (
    "evaluation_id string, prompt string, reference_answer string, context string, model_comparisons map<string, "
    "struct<status: string, llm_response: string, metrics: map<string, double>, error: string, message: string>>, batch_id long"
)


def read_final_metrics(spark, path: str) -> DataFrame:
    """The stored documents; of an evaluation scored in several batches the latest."""
    rows = spark.read.schema(DOCUMENT_SCHEMA).json(path)
    cols = [c for c in rows.columns if c != "batch_id"]
    return rows.groupBy("evaluation_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("d")).select("d.*")
