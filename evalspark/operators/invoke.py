"""Per-model invocation over the fan-out (K1).

The caller supplies ``client_factory(model) -> callable(prompt) -> text``; the engine ships no
vendor client.  One client per (partition, model); an exception becomes a FAILED row with the
error text, exactly like the failure events of the workers.  Materialise the result (see
``evalspark.session.materialize``) before reuse so that calls are never repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from evalspark.operators.status import FAILED, RECEIVED

OUT_SCHEMA = "evaluation_id string, model string, status string, response string, error string, prompt_sent string"


def invoke_models(fanned: DataFrame, client_factory: Callable[[str], Callable[[str], str]]) -> DataFrame:
    """Rows (evaluation_id, model, formatted_prompt) → (evaluation_id, model, status, response, error, prompt_sent)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict[str, Callable[[str], str]] = {}
        for b in batches:
            out = []
            for eid, model, prompt in zip(b["evaluation_id"], b["model"], b["formatted_prompt"]):
                try:
                    if model not in clients:
                        clients[model] = client_factory(model)
                    out.append((eid, model, RECEIVED, clients[model](prompt), None, prompt))
                except Exception as exc:  # the failure is data, the batch goes on
                    out.append((eid, model, FAILED, None, str(exc), prompt))
            yield pd.DataFrame(out, columns=["evaluation_id", "model", "status", "response", "error", "prompt_sent"])

    return fanned.select("evaluation_id", "model", "formatted_prompt").mapInPandas(run, OUT_SCHEMA)


def response_events(results: DataFrame) -> DataFrame:
    """Invocation results → flat status events (received / failed without status, as emitted)."""
    from pyspark.sql import functions as F

    from evalspark.functions.scalar import response_key
    from evalspark.operators.status import FAILED_TYPE, RECEIVED_TYPE

    ok = F.col("status") == RECEIVED
    return results.select(
        "evaluation_id",
        "model",
        F.when(ok, F.lit(RECEIVED_TYPE)).otherwise(F.lit(FAILED_TYPE)).alias("detail_type"),
        F.when(ok, F.lit(RECEIVED)).alias("status"),
        "error",
        F.when(ok, response_key("evaluation_id", "model")).alias("response_key"),
        F.current_timestamp().alias("event_time"),
        F.monotonically_increasing_id().alias("event_seq"),
    )
