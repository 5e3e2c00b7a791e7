"""Judge-based scores from verdict and rating tables.

Verdict generation needs a judge model; ``judge`` runs a caller-supplied function over
Arrow batches (``mapInPandas``), one judge client per partition.  Everything after the verdicts is
plain grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Judge criteria and pass thresholds; ``hallucination`` and ``toxicity`` pass when
# the score is at most the threshold.
THRESHOLDS = [
    ("hallucination", 0.5, True),
    ("answer_relevancy", 0.5, False),
    ("faithfulness", 0.5, False),
    ("contextual_relevancy", 0.7, False),
    ("contextual_recall", 0.7, False),
    ("toxicity", 0.5, True),
    ("bias", 0.5, True),
]


def verdict_ratio(verdicts: DataFrame, keys=("evaluation_id", "model", "criterion")) -> DataFrame:
    """Share of positive verdicts per (evaluation, model, criterion) (G11, M8-M12, M14); null verdicts skipped."""
    return verdicts.groupBy(*keys).agg(
        F.avg(F.col("verdict").cast("double")).alias("score"), F.count("verdict").alias("n_verdicts")
    )


def rubric_score(ratings: DataFrame, max_rating: float, keys=("evaluation_id", "model", "criterion")) -> DataFrame:
    """Rubric (G-Eval style) score: mean rating / max rating (M7)."""
    return ratings.groupBy(*keys).agg((F.avg("rating") / F.lit(float(max_rating))).alias("score"))


def thresholds_table(spark) -> DataFrame:
    return spark.createDataFrame(THRESHOLDS, "criterion string, threshold double, lower_is_better boolean")


def with_pass(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pass/fail per score row at the criterion's threshold (M13).  The thresholds table is a
    handful of rows (one per criterion), so it is broadcast."""
    j = scores.join(F.broadcast(thresholds), "criterion", "left")
    passed = F.when(F.col("lower_is_better"), F.col("score") <= F.col("threshold")).otherwise(F.col("score") >= F.col("threshold"))
    return j.withColumn("passed", F.when(F.col("threshold").isNotNull() & F.col("score").isNotNull(), passed))


def label_rate(labels: DataFrame, flag: str, keys=("model",)) -> DataFrame:
    """Rate of flagged units (bias / toxicity style) per key."""
    return labels.groupBy(*keys).agg(F.avg(F.col(flag).cast("double")).alias("rate"), F.count("*").alias("n_units"))


def judge(
    requests: DataFrame,
    judge_fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str = "evaluation_id string, model string, criterion string, unit_no int, verdict boolean, note string",
) -> DataFrame:
    """Run a caller-supplied judge over verdict requests (K2).

    ``judge_fn`` receives a pandas batch and returns verdict rows.  If it fails on a batch, it is called
    again row by row, and only the rows that fail alone become null verdicts with the error as ``note``
    (never an answer-like text).
    """
    def one(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield judge_fn(b)
        except Exception as exc:  # the caller's function may raise anything
            if len(b) > 1:
                for i in range(len(b)):
                    yield from one(b.iloc[i : i + 1])
            else:
                yield pd.DataFrame(
                    {
                        "evaluation_id": b.get("evaluation_id"),
                        "model": b.get("model"),
                        "criterion": b.get("criterion"),
                        "unit_no": b.get("unit_no", pd.Series([None] * len(b))),
                        "verdict": [None] * len(b),
                        "note": [f"judge error: {exc}"] * len(b),
                    }
                )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from one(b)

    return requests.mapInPandas(run, schema)


def criteria_requests(pairs: DataFrame, criteria: list[tuple[str, str, list[str]]]) -> DataFrame:
    """One judge request per (pair, criterion) (K3).  ``criteria`` = [(name, criteria text, inputs
    used)], a handful of entries, so it is an ``explode`` of a literal array — no join."""
    arr = F.array(
        *[
            F.struct(F.lit(n).alias("criterion"), F.lit(t).alias("criteria_text"), F.array(*[F.lit(p) for p in params]).alias("inputs"))
            for n, t, params in criteria
        ]
    )
    return pairs.select("*", F.explode(arr).alias("_c")).select("*", "_c.*").drop("_c")
