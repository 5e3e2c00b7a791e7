"""File readers and writers for the pipeline's stored objects.

All readers take explicit schemas (no inference pass over the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RESPONSE_SCHEMA = StructType(
    [StructField("response", StringType()), StructField("original_prompt_sent_to_llm", StringType())]
)


def read_request_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One request body per file (JSON object or array, any layout) → (batch_id = file path, body).

    ``wholetext`` keeps each file's text intact; parse it with ``operators.requests.parse_requests``.
    """
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("batch_id"), F.col("value").alias("body"))


def write_responses(df: DataFrame, path: str) -> None:
    """Response objects (S3): one JSON line per (evaluation, model) under
    ``evaluation_id=<id>/model_key=<model lower, blanks → _>``."""
    out = df.select(
        "evaluation_id",
        F.replace(F.lower("model"), F.lit(" "), F.lit("_")).alias("model_key"),
        F.col("response"),
        F.col("prompt_sent").alias("original_prompt_sent_to_llm"),
    )
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("evaluation_id", "model_key").json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored response objects (A3) → (evaluation_id, model_key, response, prompt_sent).

    Partition columns come from the folder names; filters on them prune folders.
    """
    schema = StructType(
        RESPONSE_SCHEMA.fields + [StructField("evaluation_id", StringType()), StructField("model_key", StringType())]
    )
    df = spark.read.schema(schema).json(path)
    return df.select("evaluation_id", "model_key", "response", F.col("original_prompt_sent_to_llm").alias("prompt_sent"))


def write_evaluations(df: DataFrame, path: str) -> None:
    """Evaluation records (S1), appended."""
    df.write.mode("append").parquet(path)


def write_events(df: DataFrame, path: str) -> None:
    """Event envelopes as JSON lines (S2); ``df`` has one ``value`` text column."""
    df.select("value").write.mode("append").text(path)
