"""Model calls that are made once (K1): a ledger of calls, anti-joined before calling.

A call is known by (evaluation, model, prompt).  ``run_calls`` sends the work whose calls the ledger does not hold,
several at a time in each task, with retry and back-off, and appends one row per call.  Rows carry their own times and
numbers, so events made from the ledger are the same however often they are read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.status import FAILED, RECEIVED

SCHEMA = (
    "call_id string, evaluation_id string, model string, status string, response string, error string, attempts int, prompt_sent string, "
    "started_at timestamp, finished_at timestamp"
)


class Transient(Exception):
    """Raised by a client for a failure that another attempt may mend."""


@dataclass(frozen=True)
class Policy:
    """Calls at once in a task; attempts per call, for exceptions of ``retry_on`` only; waits in seconds before the second
    attempt, its growth per attempt and its limit; calls per task, which is what a lost executor can make us repeat."""

    parallel: int = 8
    attempts: int = 4
    first_wait: float = 0.5
    growth: float = 2.0
    longest_wait: float = 30.0
    retry_on: tuple[type[BaseException], ...] = (Transient, TimeoutError, ConnectionError)
    calls_per_task: int = 200

    def wait(self, attempt: int) -> float:
        """Seconds before attempt number ``attempt`` (2, 3, ...)."""
        return min(self.longest_wait, self.first_wait * self.growth ** (attempt - 2))


def call_id(evaluation_id: str = "evaluation_id", model: str = "model", prompt: str = "formatted_prompt") -> Column:
    """Identity of a call: hash of evaluation, model and the prompt's hash; null parts count as empty."""
    parts = [F.coalesce(F.col(evaluation_id), F.lit("")), F.coalesce(F.col(model), F.lit("")), F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows (none if there is no ledger yet); of a call that was made again the latest row counts."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def latest_calls(ledger: DataFrame) -> DataFrame:
    cols = [c for c in ledger.columns if c != "call_id"]
    return ledger.groupBy("call_id").agg(F.max_by(F.struct(*cols), F.struct("finished_at", "attempts")).alias("x")).select("call_id", "x.*")


def pending_calls(work: DataFrame, ledger: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Distinct calls of ``work`` (evaluation_id, model, formatted_prompt) that the ledger does not hold.

    ``retry_failed`` sends calls again whose latest row is a failure.  Only two columns of the ledger are read.
    """
    known = ledger.select("call_id", "status", "finished_at")
    if retry_failed:
        known = known.groupBy("call_id").agg(F.max_by("status", "finished_at").alias("status")).where(F.col("status") == RECEIVED)
    rows = work.select(call_id().alias("call_id"), "evaluation_id", "model", "formatted_prompt").dropDuplicates(["call_id"])
    return rows.join(known.select("call_id"), "call_id", "left_anti")


def call_models(pending: DataFrame, client_factory: Callable[[str], Callable[[str], str]], policy: Policy = Policy()) -> DataFrame:
    """One row of SCHEMA per row of ``pending``.  ``client_factory(model)`` gives a callable prompt → text; one client per
    task and model, used by several threads.  A call that fails for good is a FAILED row with the error's text."""

    def attempt(client: Callable[[str], str] | Exception, row) -> tuple:
        started, tries, error = datetime.now(timezone.utc), 0, None
        while tries < policy.attempts:
            tries += 1
            if tries > 1:
                time.sleep(policy.wait(tries))
            try:
                if isinstance(client, Exception):
                    raise client
                text = client(row.formatted_prompt)
                return (row.call_id, row.evaluation_id, row.model, RECEIVED, text, None, tries, row.formatted_prompt, started, datetime.now(timezone.utc))
            except policy.retry_on as exc:
                error = exc
            except Exception as exc:  # the failure is data, the batch goes on
                error = exc
                break
        return (row.call_id, row.evaluation_id, row.model, FAILED, None, str(error), tries, row.formatted_prompt, started, datetime.now(timezone.utc))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict[str, Callable[[str], str] | Exception] = {}
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        with ThreadPoolExecutor(max_workers=policy.parallel) as pool:
            for b in batches:
                rows = list(b.itertuples(index=False))
                for m in {r.model for r in rows} - clients.keys():
                    try:
                        clients[m] = client_factory(m)
                    except Exception as exc:  # no client: every call of the model fails with it
                        clients[m] = exc
                out = list(pool.map(lambda r: attempt(clients[r.model], r), rows))
                yield pd.DataFrame(out, columns=names)

    return pending.mapInPandas(run, SCHEMA)


def run_calls(
    work: DataFrame, path: str, client_factory: Callable[[str], Callable[[str], str]], policy: Policy = Policy(), retry_failed: bool = False
) -> DataFrame:
    """Make the calls of ``work`` that the ledger at ``path`` lacks, append them, and return the ledger's rows of ``work``.

    Running it again repeats no call.  A task's rows reach the ledger when it commits, so a lost executor
    repeats at most ``policy.calls_per_task`` calls per lost task.
    """
    from evalspark.session import materialize

    spark = work.sparkSession
    todo = materialize(pending_calls(work, read_ledger(spark, path), retry_failed))
    n = todo.count()
    if n:
        tasks = -(-n // policy.calls_per_task)
        spread = todo.repartition(tasks, "call_id")
        call_models(spread, client_factory, policy).write.mode("append").parquet(path)
    mine = work.select(call_id().alias("call_id")).distinct()
    return latest_calls(read_ledger(spark, path).join(mine, "call_id", "left_semi"))


def ledger_events(calls: DataFrame) -> DataFrame:
    """Ledger rows → flat status events.  Time and number come from the row: ``event_seq`` is 60 bits of the call's
    identity, the same at every reading."""
    from evalspark.functions.scalar import response_key
    from evalspark.operators.status import FAILED_TYPE, RECEIVED_TYPE

    ok = F.col("status") == RECEIVED
    return calls.select(
        "evaluation_id",
        "model",
        F.when(ok, F.lit(RECEIVED_TYPE)).otherwise(F.lit(FAILED_TYPE)).alias("detail_type"),
        F.when(ok, F.lit(RECEIVED)).alias("status"),
        "error",
        F.when(ok, response_key("evaluation_id", "model")).alias("response_key"),
        F.col("finished_at").alias("event_time"),
        F.conv(F.substring("call_id", 1, 15), 16, 10).cast("long").alias("event_seq"),
    )


def own_ledger(spark: SparkSession) -> str:
    """A new ledger's path in the shared folder."""
    from evalspark.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/calls-{uuid4().hex}"
