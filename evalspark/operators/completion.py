"""Completion of evaluations (J7, S5): documents, state rows and a ledger that ties them together.

A batch of ready evaluations writes, in this order, its documents, one state row per evaluation, and last its entry in
the ledger.  A batch with an entry is done and a replay changes nothing; a batch without one is written again as a
whole, each folder replaced.  ``final_key`` of a completed evaluation opens its document.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.outcomes import COMPLETED as SCORED
from evalspark.operators.outcomes import DOCUMENT_SCHEMA, write_final_metrics
from evalspark.operators.status import COMPLETED, FAILED

STATE_SCHEMA = (
    "evaluation_id string, status string, final_key string, n_models int, n_scored int, error_message string, completion_timestamp timestamp"
)
LEDGER_SCHEMA = "n_ready long, n_completed long, n_failed long, n_scored long, written_at timestamp"
#: Fixed value: how the error text of a failed evaluation begins.
FAILURE = "Overall Calculation Failure: "
NO_RECORD, NO_MODELS = "no evaluation record", "no requested models"


def _folder(path: str, kind: str, batch_id: int | None = None) -> str:
    base = f"{path.rstrip('/')}/{kind}"
    return base if batch_id is None else f"{base}/batch_id={int(batch_id)}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def state_rows(ready: DataFrame, withmap: DataFrame, documents: DataFrame, batch_id: int, at: datetime) -> DataFrame:
    """One row of STATE_SCHEMA per ready evaluation.

    COMPLETED with the key of its document, the number of its models and of those that were scored; FAILED, with the
    error's text, if there is no record of it or the record names no model, so that no document could be made.
    """
    result = F.map_values("model_comparisons")
    docs = documents.select(
        "evaluation_id",
        F.size(result).alias("n_models"),
        F.size(F.filter(result, lambda r: r["status"] == SCORED)).alias("n_scored"),
        F.lit(True).alias("has_document"),
    )
    known = withmap.select("evaluation_id").distinct().withColumn("has_record", F.lit(True))
    j = ready.select("evaluation_id").distinct().join(known, "evaluation_id", "left").join(docs, "evaluation_id", "left")
    done = F.coalesce("has_document", F.lit(False))
    error = F.when(~done, F.concat(F.lit(FAILURE), F.when(F.col("has_record"), NO_MODELS).otherwise(NO_RECORD)))
    return j.select(
        "evaluation_id",
        F.when(done, COMPLETED).otherwise(FAILED).alias("status"),
        F.when(done, F.concat(F.lit(f"batch_id={int(batch_id)}/"), F.col("evaluation_id"))).alias("final_key"),
        F.coalesce("n_models", F.lit(0)).alias("n_models"),
        F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
        error.alias("error_message"),
        F.lit(at).cast("timestamp").alias("completion_timestamp"),
    )


def complete_batch(
    ready: DataFrame, withmap: DataFrame, responses: DataFrame, path: str, batch_id: int, extra_scores: DataFrame | None = None
) -> bool:
    """Score the ready evaluations of a batch and record them under ``path``; False if the ledger has the batch already.

    Documents are scored once: the state rows are made from the written ones.
    """
    from evalspark.plans.flows import score
    from evalspark.session import written

    spark = ready.sparkSession
    if _exists(spark, _folder(path, "ledger", batch_id) + "/_SUCCESS"):
        return False
    ready = written(ready.select("evaluation_id").distinct())  # a table of known size; its plan is done with
    write_final_metrics(score(ready, withmap, responses, extra_scores)["documents"], _folder(path, "documents"), batch_id)
    documents = spark.read.schema(DOCUMENT_SCHEMA).json(_folder(path, "documents", batch_id))
    now = datetime.now(timezone.utc)
    states = state_rows(ready, withmap, documents, batch_id, now)
    states.write.mode("overwrite").parquet(_folder(path, "states", batch_id))
    stored = spark.read.schema(STATE_SCHEMA).parquet(_folder(path, "states", batch_id))
    entry = stored.agg(
        F.count("*").alias("n_ready"),
        F.count(F.when(F.col("status") == COMPLETED, 1)).alias("n_completed"),
        F.count(F.when(F.col("status") == FAILED, 1)).alias("n_failed"),
        F.coalesce(F.sum("n_scored"), F.lit(0)).alias("n_scored"),
        F.lit(now).cast("timestamp").alias("written_at"),
    )
    entry.coalesce(1).write.mode("overwrite").json(_folder(path, "ledger", batch_id))
    return True


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished batch: batch_id, n_ready, n_completed, n_failed, n_scored, written_at."""
    if not _exists(spark, _folder(path, "ledger")):
        return spark.createDataFrame([], f"{LEDGER_SCHEMA}, batch_id long")
    return spark.read.schema(f"{LEDGER_SCHEMA}, batch_id long").json(_folder(path, "ledger"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """State rows of finished batches; of an evaluation completed in several batches the latest."""
    if not _exists(spark, _folder(path, "states")):
        return spark.createDataFrame([], f"{STATE_SCHEMA}, batch_id long")
    rows = spark.read.schema(f"{STATE_SCHEMA}, batch_id long").parquet(_folder(path, "states"))
    rows = rows.join(read_ledger(spark, path).select("batch_id"), "batch_id", "left_semi")
    cols = [c for c in rows.columns if c != "evaluation_id"]
    return rows.groupBy("evaluation_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("x")).select("evaluation_id", "x.*")


def open_documents(states: DataFrame, path: str) -> DataFrame:
    """Documents that the ``final_key`` of ``states`` names: final_key and the document's columns; keys without one are left
    out.  A key's folder is the document's partition, so a look-up of few batches reads few folders."""
    spark = states.sparkSession
    docs = spark.read.schema(DOCUMENT_SCHEMA).json(_folder(path, "documents"))
    keyed = docs.withColumn("final_key", F.concat(F.lit("batch_id="), F.col("batch_id").cast("string"), F.lit("/"), F.col("evaluation_id")))
    wanted = states.where(F.col("final_key").isNotNull()).select("final_key", F.split_part("final_key", F.lit("/"), F.lit(1)).alias("folder")).distinct()
    wanted = wanted.select("final_key", F.substring("folder", 10, 20).cast("long").alias("batch_id"))
    return keyed.join(wanted, ["batch_id", "final_key"])
