"""Keyed snapshot of the latest statuses (J2): a micro-batch rewrites only the buckets it touches.

Under ``path``: ``data/batch_id=<n>/bucket=<b>`` is bucket b as batch n left it, and ``manifest/batch_id=<n>`` says for every
bucket which batch wrote it last.  The manifest is written last, so a batch that dies before leaves the former state
in force, and a replayed batch whose manifest is there changes nothing.  Reading takes one manifest and one folder per bucket,
however many batches there were; folders that neither the last two manifests name are deleted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["evaluation_id", "model"]
SCHEMA = "evaluation_id string, model string, status string, updated_at timestamp, updated_seq long"


class Files:
    """The few file operations the snapshot needs, on whatever file system ``path`` names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self, folder: str) -> list[int]:
        """The n of its sub-folders ``batch_id=<n>`` that are complete, in order."""
        at = self._make(f"{self.path}/{folder}")
        if not self._fs.exists(at):
            return []
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(at)]
        found = sorted(int(m[1]) for x in names if (m := re.fullmatch(r"batch_id=(\d+)", x)))
        return [n for n in found if self._fs.exists(self._make(f"{self.path}/{folder}/batch_id={n}/_SUCCESS"))]

    def delete(self, folder: str) -> None:
        self._fs.delete(self._make(f"{self.path}/{folder}"), True)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, files: Files, n: int) -> dict[int, int]:
    """Bucket → batch; as many rows as there are buckets."""
    rows = spark.read.schema("bucket int, batch long").json(f"{files.path}/manifest/batch_id={n}").collect()
    return {r.bucket: r.batch for r in rows}


def _folder(bucket: int, batch: int) -> str:
    return f"data/batch_id={batch}/bucket={bucket}"


def _read(spark: SparkSession, files: Files, where: dict[int, int]) -> DataFrame:
    if not where:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{files.path}/{_folder(b, n)}" for b, n in sorted(where.items())])


def merge_batch(updates: DataFrame, path: str, batch_id: int, buckets: int = 64) -> bool:
    """Fold a micro-batch of updates (SCHEMA) into the snapshot; False if it is in already.

    The latest (updated_at, updated_seq) of a key wins, so the order of batches does not matter.  ``buckets`` must
    stay the same for the life of a snapshot; it is the bound of what the driver sees.
    """
    spark = updates.sparkSession
    files = Files(spark, path)
    done = files.numbers("manifest")
    if batch_id in done:
        return False
    base = _manifest(spark, files, done[-1]) if done else {}
    keyed = updates.select(*KEYS, "status", "updated_at", "updated_seq").withColumn("bucket", bucket_of(buckets))
    touched = sorted(r.bucket for r in keyed.select("bucket").distinct().collect())
    old = _read(spark, files, {b: n for b, n in base.items() if b in set(touched)}).withColumn("bucket", bucket_of(buckets))
    order = F.struct("updated_at", "updated_seq")
    latest = keyed.unionByName(old).groupBy("bucket", *KEYS).agg(F.max_by(F.struct("status", "updated_at", "updated_seq"), order).alias("x"))
    rows = latest.select("bucket", *KEYS, "x.*").repartition(max(1, len(touched)), "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{files.path}/data/batch_id={batch_id}")
    now = base | dict.fromkeys(touched, batch_id)
    entries = spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1)
    entries.write.mode("overwrite").json(f"{files.path}/manifest/batch_id={batch_id}")
    for n in done[:-1]:  # two manifests stay, and the folders they name
        named = set((base | now).items()) | set(base.items())
        for b, batch in _manifest(spark, files, n).items():
            if (b, batch) not in named:
                files.delete(_folder(b, batch))
        files.delete(f"manifest/batch_id={n}")
    return True


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Latest status per (evaluation, model): the columns of SCHEMA."""
    files = Files(spark, path)
    done = files.numbers("manifest")
    return _read(spark, files, _manifest(spark, files, done[-1]) if done else {})


def write_snapshot(updates: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None, buckets: int = 64):
    """Start the stream that folds ``status_updates`` into the snapshot at ``path``."""
    from evalspark.session import stream_checkpoint

    checkpoint = checkpoint or stream_checkpoint(updates.sparkSession, "status_snapshot")
    w = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    w = w.foreachBatch(lambda df, n: merge_batch(df, path, n, buckets) and None)
    return w.trigger(**(trigger or {"availableNow": True})).start()
