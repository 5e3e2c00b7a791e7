"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: runs of these ASCII blanks separate words.
BLANKS = r"[\x20\x09-\x0D]+"
#: Private columns of the operators start with this, so that they never clash with a caller's columns.
P = "_llm_"


def words(text: Column) -> Column:
    """Words (maximal runs without ASCII blanks) of a text; null text: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Only a local session may go without one
    (tests); it gets a temporary folder."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="llm-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` plus, for each name in ``sums``, ``<name>_before`` (its total over all rows that come
    earlier in ``order``) and ``<name>_all``.

    The rows are range-partitioned by ``order`` and kept (so a row's partition never changes), each
    partition adds up its own rows, and a table of one row per partition carries the offsets: no task
    sees more than its range.  ``order`` should end in a tie-breaker; tied rows are taken in any order.
    """
    part, here, ahead = f"{P}part", f"{P}here_", f"{P}ahead_"
    ranged = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    per_part = ranged.groupBy(part).agg(*[F.sum(c).alias(here + n) for n, c in sums.items()])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_part.select(
        F.col(part),
        *[F.coalesce(F.sum(here + n).over(earlier), F.lit(0)).alias(ahead + n) for n in sums],
        *[F.sum(here + n).over(everything).alias(n + "_all") for n in sums],
    )
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the broadcast is bounded by the number of partitions
    joined = ranged.join(F.broadcast(offsets), part)
    out = joined.withColumns(
        {n + "_before": F.col(ahead + n) + F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}
    )
    return out.drop(part, *[ahead + n for n in sums])


def hashed_sample(df: DataFrame, keys: list[str], n: int, count: int | None = None) -> DataFrame:
    """About ``n`` rows of ``df`` (all, if it has no more), chosen by a hash of ``keys``: rows with equal
    keys go together and a rerun picks the same.  What a driver collects of it doesn't grow with the tasks."""
    count = df.count() if count is None else count
    if count <= n:
        return df
    steps = 1 << 40
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(steps)) < int(steps * n / count))


def scratch_folder(spark: SparkSession) -> str:
    """This session's own folder for written intermediate tables, inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed Parquet table in the scratch folder and read again; for large
    intermediate tables, where a checkpoint's plain rows would be several times larger."""
    path = f"{scratch_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the session's scratch folder, once the results that read it are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
