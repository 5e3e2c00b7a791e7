"""Cosine similarity over embedding pairs (M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.scalar import round4
from evalspark.functions.vector import cosine


def cosine_scores(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Row-wise cosine of two array columns, rounded to 4: (keys..., cosine)."""
    return df.select(*keys, round4(cosine(F.col(a), F.col(b))).alias("cosine"))
