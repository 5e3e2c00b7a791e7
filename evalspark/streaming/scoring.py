"""Ready events → final metrics (J7): each micro-batch is scored with the batch operators.

The sink records a micro-batch as a whole (``operators.completion``): documents, state rows (COMPLETED with a key that opens
the document, or FAILED) and a ledger entry, each in a folder of the batch.  A replayed batch whose entry is there changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalspark.operators.completion import complete_batch
from evalspark.operators.status import READY_TYPE
from evalspark.plans.flows import score

#: A table, or a function that reads it anew (a file table lists its files when it is made).
Table = DataFrame | Callable[[SparkSession], DataFrame]


def _now(t: Table, spark: SparkSession) -> DataFrame:
    return t(spark) if callable(t) else t


def score_batch(ready: DataFrame, withmap: DataFrame, responses: DataFrame, extra_scores: DataFrame | None = None) -> DataFrame:
    """Final documents for the evaluations in ``ready`` (timeout rows are left out)."""
    if "detail_type" in ready.columns:
        ready = ready.where(ready.detail_type == READY_TYPE)
    return score(ready, withmap, responses, extra_scores)["documents"]


def score_stream(
    ready_stream: DataFrame,
    withmap: Table,
    responses: Table,
    out_path: str,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    extra_scores: Table | None = None,
):
    """Start the scoring stream; ``checkpoint`` defaults to ``<spark.checkpoint.dir>/streams/score_stream``.

    Pass ``withmap``, ``responses`` and ``extra_scores`` as functions ``spark → DataFrame`` when they are
    file tables that grow: they are called in every micro-batch, so evaluations and responses stored
    after the start are seen.  Documents are under ``out_path/documents``, states and ledger beside them.  A plain DataFrame over files keeps the files it had when it was made.
    """
    from evalspark.session import stream_checkpoint

    checkpoint = checkpoint or stream_checkpoint(ready_stream.sparkSession, "score_stream")

    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        extra = None if extra_scores is None else _now(extra_scores, spark)
        if "detail_type" in df.columns:
            df = df.where(df.detail_type == READY_TYPE)
        complete_batch(df, _now(withmap, spark), _now(responses, spark), out_path, batch_id, extra)

    w = ready_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"availableNow": True})).start()
