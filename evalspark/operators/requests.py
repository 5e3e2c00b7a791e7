"""Evaluation requests: parse, validate, initiate, fan out, format prompts.

One DataFrame plan from request bodies to per-model work items.  Nothing collects: every body is
parsed on its own row and every item becomes its own row (``posexplode``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evalspark.functions.prompt import format_prompt
from evalspark.functions.scalar import is_truthy, response_key

# The model names of the four workers.
DEFAULT_MODELS = ["OpenAI", "Gemini", "Perplexity", "Bedrock Nova Lite"]

ITEM_SCHEMA = StructType(
    [
        StructField("prompt", StringType()),
        StructField("reference_answer", StringType()),
        StructField("context", StringType()),
    ]
)

NOT_OBJECT = "item is not a JSON object"
BAD_JSON = "item is not valid JSON"
BAD_BODY = "request body must be a JSON array of evaluation objects or a single evaluation object"


def parse_requests(df: DataFrame, body_col: str = "body", keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Request bodies → one row per item: (keys..., item_index, prompt, reference_answer, context, _raw, parse_error).

    A lone object is wrapped into a one-item list.  Items are split as raw JSON text first
    (``array<string>``), so one bad item cannot null its neighbours.  A body that is not an object
    or array gives one row with a null ``item_index`` and a ``parse_error``; a null body gives none.
    """
    keys = list(keys)
    body = F.col(body_col)
    is_obj = body.rlike(r"^\s*\{")
    items = F.when(is_obj, F.array(body)).otherwise(F.from_json(body, "array<string>"))
    # a body that splits into nothing becomes one item without index; an empty array gives no item
    split = F.when(items.isNull(), F.array(F.struct(F.lit(None).cast("int").alias("item_index"), body.alias("_raw")))).otherwise(
        F.transform(items, lambda x, i: F.struct(i.cast("int").alias("item_index"), x.alias("_raw")))
    )
    rows = df.where(body.isNotNull()).select(*keys, F.inline(split))
    item = F.when(F.col("_raw").rlike(r"^\s*\{") & F.col("item_index").isNotNull(), F.from_json(F.col("_raw"), ITEM_SCHEMA))
    return rows.select(*keys, "item_index", item.alias("it"), "_raw").select(
        *keys,
        "item_index",
        F.col("it.prompt").alias("prompt"),
        F.col("it.reference_answer").alias("reference_answer"),
        F.col("it.context").alias("context"),
        "_raw",
        F.when(F.col("item_index").isNull(), F.lit(BAD_BODY))
        .when(F.col("it").isNull(), F.lit(NOT_OBJECT))
        .when(F.get_json_object("_raw", "$").isNull(), F.lit(BAD_JSON))
        .alias("parse_error"),
    )


def validate_requests(parsed: DataFrame, models: Column | None = None) -> DataFrame:
    """Adds ``requested_models`` and ``error`` (null when the item is valid).

    Errors: unparseable item; prompt null or '' (blanks are accepted); empty model list.
    """
    models = models if models is not None else F.array(*[F.lit(m) for m in DEFAULT_MODELS])
    idx = F.coalesce(F.col("item_index").cast("string"), F.lit("?"))
    err = (
        F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(~is_truthy("prompt"), F.concat(F.lit("Prompt is required for item "), idx, F.lit(".")))
        .when(F.size(models) == 0, F.lit("No models configured for evaluation."))
    )
    return parsed.withColumn("requested_models", models).withColumn(
        "error", F.when(err.isNotNull(), F.concat(F.lit("Error processing item "), idx, F.lit(": "), err))
    )


def valid_requests(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error").isNull())


def request_errors(validated: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Error rows {item_index, error, input}."""
    return validated.where(F.col("error").isNotNull()).select(*keys, "item_index", "error", F.col("_raw").alias("input"))


def evaluation_id(keys: Sequence[str]) -> Column:
    """Deterministic id: sha-256 of the batch keys and the item index (recomputation gives the same id)."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys] + [F.col("item_index").cast("string")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def initiate(valid: DataFrame, keys: Sequence[str] = ("batch_id",), random_ids: bool = False) -> DataFrame:
    """Evaluation records (B5): id, INITIATED, per-model PENDING map, creation time.

    ``random_ids=True`` uses ``uuid()``; such a frame must be materialised before reuse
    (``evalspark.session.materialize``), since a recomputation would draw new ids.
    """
    eid = F.expr("uuid()") if random_ids else evaluation_id(keys)
    models = F.array_distinct("requested_models")
    return valid.select(
        eid.alias("evaluation_id"),
        *keys,
        "item_index",
        "prompt",
        "reference_answer",
        "context",
        F.col("requested_models"),
        F.map_from_entries(F.transform(models, lambda m: F.struct(m, F.lit("PENDING")))).alias("responses_received"),
        F.lit("INITIATED").alias("status"),
        F.current_timestamp().alias("created_at"),
    )


def initiated_events(evals: DataFrame) -> DataFrame:
    """EvaluationInitiated event payloads."""
    return evals.select(
        "evaluation_id", "prompt", "reference_answer", "context", F.col("requested_models").alias("selected_llms")
    )


def with_prompt(evals: DataFrame) -> DataFrame:
    """Formatted prompt per evaluation — computed once, before the fan-out."""
    return evals.withColumn("formatted_prompt", format_prompt("prompt", "context"))


def fan_out(evals: DataFrame) -> DataFrame:
    """One row per (evaluation, requested model), duplicates in the list removed."""
    cols = [c for c in evals.columns if c not in ("requested_models", "responses_received")]
    return evals.select(*cols, F.explode(F.array_distinct("requested_models")).alias("model"))


def requested_only(rows: DataFrame, evals: DataFrame) -> DataFrame:
    """Keep rows (evaluation_id, model, ...) whose model was requested for that evaluation."""
    req = evals.select("evaluation_id", "requested_models")
    return rows.join(req, "evaluation_id").where(F.array_contains("requested_models", F.col("model"))).drop("requested_models")


def with_response_key(fanned: DataFrame) -> DataFrame:
    """Object key of each (evaluation, model) response."""
    return fanned.withColumn("response_key", response_key("evaluation_id", "model"))


def batch_summary(validated: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Per batch: items received, initiated, errors; status 200 if no error else 207."""
    agg = validated.groupBy(*keys).agg(
        F.count(F.col("item_index")).alias("total_items_received"),
        F.count_if(F.col("error").isNull()).alias("items_initiated_successfully"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
    )
    return agg.withColumn("status_code", F.when(F.col("n_errors") == 0, F.lit(200)).otherwise(F.lit(207)))
