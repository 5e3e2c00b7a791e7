"""Result reports and the dashboard's aggregates.

Long score table: (sno, prompt?, model, metric, score).  Every aggregate is a group-by on small
keys with partial (map-side) aggregation; winners rank *pre-aggregated* means, so a prompt with a
huge number of score rows still reaches the window as one row per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, MapType, StringType, StructField, StructType

from evalspark.functions.scalar import coerce_score, prompt_label
from evalspark.session import materialize

# Fixed value: the metric the dashboard leaves out by default.
GENERATED_TEXT = "generated_text"

REPORT_SCHEMA = StructType(
    [
        StructField("SNO", LongType()),
        StructField("prompt", StringType()),
        StructField("models", MapType(StringType(), MapType(StringType(), StringType()))),
    ]
)


# --- report in / out -----------------------------------------------------------------------------

def read_report(spark, path: str, lines: bool = False) -> DataFrame:
    """Report file(s): a JSON array of {SNO, prompt, models{model{metric: score}}} (A2); with ``lines`` one
    object per line, as ``write_report`` leaves them.

    Scores are read as text (they may be text); a missing path gives an empty table, as the dashboard
    shows "no data"; any other failure is raised.  Records that are no JSON are left out; ``broken_reports`` shows them.
    """
    try:
        return spark.read.schema(REPORT_SCHEMA).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REPORT_SCHEMA)


def broken_reports(spark, path: str) -> DataFrame:
    """(path, text, SNO) of the report files, or records of them, that ``read_report`` drops because they are no JSON."""
    try:
        schema = StructType([*REPORT_SCHEMA.fields, StructField("_broken", StringType())])
        raw = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, text string, SNO long")
    return raw.where(F.col("_broken").isNotNull()).select(F.col("_metadata.file_path").alias("path"), F.col("_broken").alias("text"), "SNO")


def assemble_report(scores: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """Long scores → one row per prompt with ``models map<model, map<metric, score text>>``.

    Duplicate (sno, model, metric) rows are averaged first, so map keys are unique.
    """
    per = scores.groupBy("sno", "model", "metric").agg(F.avg("score").alias("score"))
    by_model = per.groupBy("sno", "model").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.col("score").cast("string")))).alias("metrics")
    )
    rep = by_model.groupBy("sno").agg(F.map_from_entries(F.collect_list(F.struct("model", "metrics"))).alias("models"))
    if prompts is not None:
        rep = rep.join(prompts, "sno", "left")
    else:
        rep = rep.withColumn("prompt", F.lit(None).cast("string"))
    return rep.select(F.col("sno").alias("SNO"), "prompt", "models")


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object per line; read them with ``read_report(..., lines=True)``."""
    report.write.mode("overwrite").json(path)


def flatten_report(report: DataFrame) -> DataFrame:
    """Nested report → long rows (sno, prompt, model, metric, score_text); entries without models
    give no rows (B1)."""
    m = report.select(F.col("SNO").alias("sno"), "prompt", F.explode("models").alias("model", "metrics"))
    return m.select("sno", "prompt", "model", F.explode("metrics").alias("metric", "score_text"))


def coerce_scores(flat: DataFrame) -> DataFrame:
    """score_text → score double, bad values → null (B2)."""
    return flat.withColumn("score", coerce_score("score_text")).drop("score_text")


# --- filters and labels --------------------------------------------------------------------------

def default_metrics_filter() -> F.Column:
    return F.col("metric") != GENERATED_TEXT


def filter_scores(df: DataFrame, models: Sequence[str] | None = None, metrics: Sequence[str] | None = None) -> DataFrame:
    """model ∈ models ∧ metric ∈ metrics ∧ score present (B12, B13); None = all models / default metrics."""
    cond = F.col("score").isNotNull()
    cond = cond & (F.col("model").isin(list(models)) if models is not None else F.lit(True))
    cond = cond & (F.col("metric").isin(list(metrics)) if metrics is not None else default_metrics_filter())
    return df.where(cond)


def prompt_scores(df: DataFrame, sno=None) -> DataFrame:
    """Rows of one prompt (or of every prompt when ``sno`` is None) with a score."""
    out = df.where(F.col("score").isNotNull())
    return out.where(F.col("sno") == sno) if sno is not None else out


def prompt_labels(prompts: DataFrame) -> DataFrame:
    """(sno, label): first 70 characters + '...' (B16)."""
    return prompts.select("sno", prompt_label("prompt").alias("label"))


def label_index(prompts: DataFrame) -> DataFrame:
    """label → sno; equal labels collapse to the highest sno."""
    return prompt_labels(prompts).groupBy("label").agg(F.max("sno").alias("sno"))


def resolve_label(selected: DataFrame, index: DataFrame) -> DataFrame:
    """Chosen labels → sno."""
    return selected.join(index, "label")


# --- aggregates ----------------------------------------------------------------------------------

def mean_scores(df: DataFrame) -> DataFrame:
    """Mean score by (model, metric)."""
    return df.groupBy("model", "metric").agg(F.avg("score").alias("mean_score"))


def score_matrix(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """model × metric matrix of means, rows by model (G5, F4).  The metric list is passed, so no
    extra job runs; the sort is over one row per model."""
    return df.groupBy("model").pivot("metric", list(metrics)).agg(F.avg("score")).orderBy("model")


def prompt_matrix(df: DataFrame, metrics: Sequence[str], sno=None) -> DataFrame:
    """Per prompt, model × metric of means (duplicates averaged) (G6).  All prompts when ``sno`` is None."""
    return prompt_scores(df, sno).groupBy("sno", "model").pivot("metric", list(metrics)).agg(F.avg("score"))


def overall_mean(df: DataFrame) -> DataFrame:
    """Per model: mean over metrics of the per-metric means, missing skipped."""
    return mean_scores(df).groupBy("model").agg(F.avg("mean_score").alias("overall_mean"))


# Means equal to 9 decimals count as a tie (summation order must not pick the winner).
TIE_DIGITS = 9


def higher_is_better(df: DataFrame, lower_is_better: Sequence[str]) -> DataFrame:
    """Scores in [0, 1] of the named metrics turned round to 1 − score, so that higher is better."""
    flip = F.col("metric").isin(list(lower_is_better))
    return df.withColumn("score", F.when(flip, F.lit(1.0) - F.col("score")).otherwise(F.col("score")))


def with_aliases(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Model names replaced through an alias table (alias, model); unknown names stay (D12).  Of an alias
    listed twice the least model counts."""
    names = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("model").alias("_model"))
    joined = df.join(names, df.model == names._alias, "left")
    return joined.withColumn("model", F.coalesce("_model", "model")).select(*df.columns)


def overall_winner(df: DataFrame, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Top-1 model by overall mean; ties go to the first model name in sorted order.
    ``lower_is_better``: metrics that count as 1 − score."""
    om = overall_mean(higher_is_better(df, lower_is_better) if lower_is_better else df)
    return om.orderBy(F.bround("overall_mean", TIE_DIGITS).desc(), F.col("model").asc()).limit(1)


def prompt_means(df: DataFrame) -> DataFrame:
    """Per (sno, model): mean over metrics of the per-metric means (DT's row mean)."""
    per = df.where(F.col("score").isNotNull()).groupBy("sno", "model", "metric").agg(F.avg("score").alias("m"))
    return per.groupBy("sno", "model").agg(F.avg("m").alias("prompt_mean"))


def prompt_winners(df: DataFrame, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Winner of every prompt, same tie rule and ``lower_is_better``."""
    pm = prompt_means(higher_is_better(df, lower_is_better) if lower_is_better else df)
    w = Window.partitionBy("sno").orderBy(F.bround("prompt_mean", TIE_DIGITS).desc(), F.col("model").asc())
    return pm.withColumn("rk", F.row_number().over(w)).where(F.col("rk") == 1).drop("rk")


def winner_profile(df: DataFrame) -> DataFrame:
    """The overall winner's per-metric means as a closed polar series.

    Points are ordered by metric name; the first point is repeated at the end;
    ``axis_max = max(1, 1.1 · max value)``.
    """
    means = mean_scores(df)
    win = overall_winner(df).select("model")
    prof = means.join(win, "model")
    w = Window.partitionBy("model").orderBy("metric")
    pts = prof.withColumn("point_no", F.row_number().over(w))
    first = pts.where(F.col("point_no") == 1).withColumn("point_no", F.lit(None).cast("int"))
    n = prof.groupBy("model").agg(F.count("*").alias("n_points"), F.max("mean_score").alias("vmax"))
    closed = pts.unionByName(first).join(n, "model")
    closed = closed.withColumn("point_no", F.coalesce("point_no", (F.col("n_points") + 1).cast("int")))
    return closed.select(
        "model",
        "point_no",
        "metric",
        F.col("mean_score").alias("value"),
        F.greatest(F.lit(1.0), F.col("vmax") * F.lit(1.1)).alias("axis_max"),
    )


# --- distinct lists and positions ----------------------------------------------------------------

def distinct_metrics(df: DataFrame) -> DataFrame:
    """Sorted metric names."""
    return df.select("metric").distinct().orderBy("metric")


def distinct_prompts(df: DataFrame) -> DataFrame:
    """(sno, prompt) de-duplicated, sorted by sno (F2)."""
    return df.select("sno", "prompt").dropDuplicates(["sno", "prompt"]).orderBy("sno")


def prompt_text(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """First prompt text of each sno (F3), in ``order_col`` order (the row's place in the report; ties by
    text); without it rows have no order and the least text is taken."""
    order = F.struct(order_col, "prompt") if order_col else F.col("prompt")
    return df.groupBy("sno").agg(F.min_by("prompt", order).alias("prompt"))


def global_position(df: DataFrame, order_col: str, name: str = "position") -> DataFrame:
    """0-based position of each row in ``order_col`` order, without a single-partition window.

    Range-partition and sort, number rows inside each partition, then add the row count of all
    earlier partitions (a table of one row per partition, broadcast).  The numbered rows are kept in the
    checkpoint folder: range bounds are sampled, so a second run of them could cut elsewhere than the
    one that was counted.  Order keys must be distinct.
    """
    ranged = df.repartitionByRange(order_col).sortWithinPartitions(order_col)
    tagged = ranged.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    tagged = materialize(tagged.withColumn("_idx", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)))
    counts = tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_idx"))
    return out.drop("_pid", "_mid", "_idx", "_off")


def prompt_positions(df: DataFrame) -> DataFrame:
    """Position of each prompt in the sno-ordered prompt list."""
    return global_position(df.select("sno").distinct(), "sno")


def prompt_position(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Position of chosen sno values, 0 when not present."""
    pos = prompt_positions(df)
    return chosen.join(pos, "sno", "left").select("sno", F.coalesce("position", F.lit(0)).alias("position"))


def distinct_models(df: DataFrame, order_col: str = "sno") -> DataFrame:
    """Model names with the sno they are first seen in (G8), first by ``order_col`` (the row's place in the
    report; ties by sno), and that place as ``first_seen``."""
    first = F.min(F.struct(F.col(order_col).alias("at"), "sno")).alias("f")
    return df.groupBy("model").agg(first).select("model", F.col("f.sno").alias("first_sno"), F.col("f.at").alias("first_seen"))


def display_metrics(df: DataFrame) -> DataFrame:
    """Metrics shown in a prompt's table (U4): present with at least one score, minus generated_text."""
    return df.where(F.col("score").isNotNull() & default_metrics_filter()).select("metric").distinct()
