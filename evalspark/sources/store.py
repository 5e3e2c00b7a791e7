"""Response objects in buckets (A3, S3): look-ups read the folders and row groups of the ids they ask for.

``path/bucket=<b>`` holds the objects of the evaluations whose id hashes to b, sorted by id within each file, so that a
file's statistics carry the range of its ids.  Storing an object again adds a row; the row of the latest batch counts, and
``compact`` leaves one per object.  The number of folders is ``buckets``, the number of files grows with the batches (until
compacted), neither with the evaluations.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["evaluation_id", "model_key"]
VALUES = ["response", "prompt_sent"]
SCHEMA = "evaluation_id string, model_key string, response string, prompt_sent string, batch_id long, bucket int"
#: Look-ups of up to so many ids send them to the scan as a list; beyond that their range and buckets go there.
LISTED = 1_000


def bucket_of(buckets: int, evaluation_id: str = "evaluation_id") -> Column:
    return F.pmod(F.xxhash64(evaluation_id), F.lit(buckets)).cast("int")


def store_responses(df: DataFrame, path: str, batch_id: int, buckets: int = 64) -> None:
    """Append the objects of ``df`` (evaluation_id, model, response[, prompt_sent]).

    The model's key is its name in lower case with ``_`` for blanks.  Storing a batch again changes nothing that is read.
    Rows of a bucket are spread over as many files as its share of the rows needs, so a hot bucket is no single task.
    """
    key = F.replace(F.lower("model"), F.lit(" "), F.lit("_")).alias("model_key")
    prompt = F.col("prompt_sent") if "prompt_sent" in df.columns else F.lit(None).cast("string")
    rows = df.select(
        "evaluation_id", key, "response", prompt.alias("prompt_sent"), F.lit(int(batch_id)).cast("long").alias("batch_id"), bucket_of(buckets).alias("bucket")
    )
    ranged = rows.repartitionByRange("bucket", "evaluation_id", "model_key").sortWithinPartitions("bucket", "evaluation_id", "model_key")
    ranged.write.mode("append").partitionBy("bucket").parquet(path)


def _latest(rows: DataFrame) -> DataFrame:
    values = F.max_by(F.struct(*VALUES), F.struct("batch_id", F.hash(*VALUES))).alias("x")
    return rows.groupBy(*KEYS).agg(values, F.max("batch_id").alias("batch_id")).select(*KEYS, "x.*", "batch_id")


def stored_responses(spark: SparkSession, path: str) -> DataFrame:
    """Every object once: evaluation_id, model_key, response, prompt_sent, batch_id."""
    return _latest(spark.read.schema(SCHEMA).parquet(path).drop("bucket"))


def lookup_responses(ids: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """The objects of the evaluations in ``ids`` (evaluation_id), as ``stored_responses`` gives them.

    Bucket folders are pruned by the ids' buckets, files and row groups by the ids (few) or their range (many): at most
    ``buckets`` numbers and LISTED ids reach the driver.
    """
    spark = ids.sparkSession
    wanted = ids.select("evaluation_id").where(F.col("evaluation_id").isNotNull()).distinct()
    rows = spark.read.schema(SCHEMA).parquet(path)
    facts = wanted.agg(F.collect_set(bucket_of(buckets)).alias("b"), F.min("evaluation_id").alias("lo"), F.max("evaluation_id").alias("hi"), F.count("*").alias("n")).first()
    if not facts.n:
        return _latest(rows.limit(0).drop("bucket"))
    rows = rows.where(F.col("bucket").isin(sorted(facts.b)) & F.col("evaluation_id").between(facts.lo, facts.hi))
    if facts.n <= LISTED:
        rows = rows.where(F.col("evaluation_id").isin([r.evaluation_id for r in wanted.collect()]))
    else:
        rows = rows.join(wanted, "evaluation_id", "left_semi")
    return _latest(rows.drop("bucket"))


def compact(spark: SparkSession, path: str, buckets: int = 64) -> str:
    """A store beside ``path`` with every object once; returns its path.  The old one is left to the caller."""
    to = f"{path.rstrip('/')}-{uuid4().hex}"
    rows = stored_responses(spark, path).withColumn("bucket", bucket_of(buckets))
    ranged = rows.repartitionByRange("bucket", *KEYS).sortWithinPartitions("bucket", *KEYS)
    ranged.write.partitionBy("bucket").parquet(to)
    return to
