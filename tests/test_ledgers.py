"""Call ledger and completion ledger: nothing is done twice, failures are rows."""

import datetime as dt
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from evalspark.operators import completion as cp
from evalspark.operators import ledger as lg
from evalspark.operators.ledger import Policy, Transient

WORK = "evaluation_id string, model string, formatted_prompt string, extra int"


@pytest.fixture()
def work(spark):
    rows = [(f"e{k}", m, f"prompt {k}", 1) for k in range(6) for m in ("A", "B")] + [("e0", "A", "prompt 0", 2), ("e9", "A", None, 1), (None, "A", "x", 1)]
    return spark.createDataFrame(rows, WORK)


def noting(folder, fails=0, kind=Transient):
    """A client factory that notes each call in a file and fails the first ``fails`` times per prompt."""

    def factory(model):
        seen, lock = {}, threading.Lock()

        def client(prompt):
            with lock:
                seen[prompt] = n = seen.get(prompt, 0) + 1
                with open(os.path.join(folder, "calls"), "a") as f:
                    f.write(f"{model}|{prompt}\n")
            if n <= fails:
                raise kind(f"try {n}")
            return f"{model}:{prompt}"

        return client

    return factory


def calls(folder):
    p = os.path.join(folder, "calls")
    return sorted(open(p).read().splitlines()) if os.path.exists(p) else []


def test_a_rerun_repeats_no_call(spark, work, tmpdir_path):
    path = os.path.join(tmpdir_path, "ledger")
    first = lg.run_calls(work, path, noting(tmpdir_path), Policy(first_wait=0)).collect()
    assert len(first) == 14 and len(calls(tmpdir_path)) == 14 == len(set(calls(tmpdir_path)))  # a repeated row is one call
    more = work.unionByName(spark.createDataFrame([("e0", "A", "another prompt", 1)], WORK))
    again = lg.run_calls(more, path, noting(tmpdir_path), Policy(first_wait=0)).collect()
    assert len(calls(tmpdir_path)) == 15 and len(again) == 15
    assert {r.call_id: r.finished_at for r in first}.items() <= {r.call_id: r.finished_at for r in again}.items()
    assert {r.status for r in again} == {"RECEIVED"} and {r.attempts for r in again} == {1}


@pytest.mark.parametrize("fails, kind, status, attempts", [(2, Transient, "RECEIVED", 3), (9, Transient, "FAILED", 3), (9, ValueError, "FAILED", 1), (1, TimeoutError, "RECEIVED", 2)])
def test_retry(spark, work, tmpdir_path, fails, kind, status, attempts):
    one = work.where("evaluation_id = 'e1'")
    rows = lg.run_calls(one, os.path.join(tmpdir_path, "ledger"), noting(tmpdir_path, fails, kind), Policy(attempts=3, first_wait=0)).collect()
    assert {(r.status, r.attempts) for r in rows} == {(status, attempts)} and len(calls(tmpdir_path)) == 2 * attempts
    assert all((r.error is None) == (status == "RECEIVED") and r.started_at <= r.finished_at for r in rows)


def test_failed_calls_are_sent_again_on_request_only(spark, work, tmpdir_path):
    path, one = os.path.join(tmpdir_path, "ledger"), work.where("evaluation_id in ('e1', 'e2')")
    lg.run_calls(one.where("evaluation_id = 'e1'"), path, noting(tmpdir_path, 9, ValueError), Policy(first_wait=0))
    assert {r.status for r in lg.run_calls(one, path, noting(tmpdir_path), Policy(first_wait=0)).collect()} == {"FAILED", "RECEIVED"}
    assert len(calls(tmpdir_path)) == 4
    rows = lg.run_calls(one, path, noting(tmpdir_path), Policy(first_wait=0), retry_failed=True).collect()
    assert {r.status for r in rows} == {"RECEIVED"} and len(calls(tmpdir_path)) == 6


def test_waits_grow_to_a_limit_and_no_client_fails_its_model(spark, work, tmpdir_path):
    p = Policy(first_wait=0.5, growth=2, longest_wait=3)
    assert [p.wait(k) for k in range(2, 7)] == [0.5, 1, 2, 3, 3]

    def factory(model):
        if model == "B":
            raise RuntimeError("no key")
        return lambda prompt: "ok"

    rows = lg.run_calls(work, os.path.join(tmpdir_path, "l"), factory, Policy(first_wait=0)).collect()
    assert {(r.model, r.status, r.error) for r in rows} == {("A", "RECEIVED", None), ("B", "FAILED", "no key")}


def test_calls_of_a_task_run_at_once_but_not_more(spark, tmpdir_path):
    folder = tmpdir_path

    def factory(model):
        now, lock = [0], threading.Lock()

        def client(prompt):
            with lock:
                now[0] += 1
                with open(os.path.join(folder, "busy"), "a") as f:
                    f.write(f"{now[0]}\n")
            time.sleep(0.05)
            with lock:
                now[0] -= 1
            return "x"

        return client

    rows = spark.createDataFrame([(f"e{k}", "A", f"p{k}", 1) for k in range(24)], WORK)
    lg.run_calls(rows, os.path.join(folder, "l"), factory, Policy(parallel=4, calls_per_task=100))
    busy = [int(x) for x in open(os.path.join(folder, "busy"))]
    assert max(busy) == 4 and len(busy) == 24


def test_events_of_the_ledger_do_not_change(spark, work, tmpdir_path):
    path = os.path.join(tmpdir_path, "ledger")
    got = lg.run_calls(work, path, noting(tmpdir_path), Policy(first_wait=0))
    a, b = (sorted(lg.ledger_events(x).collect(), key=str) for x in (got, lg.latest_calls(lg.read_ledger(spark, path))))
    assert a == b and len({r.event_seq for r in a}) == 14
    assert lg.read_ledger(spark, os.path.join(tmpdir_path, "none")).count() == 0


# --- completion -------------------------------------------------------------------------------------

WM = "evaluation_id string, requested_models array<string>, responses_received map<string,string>, prompt string, reference_answer string, context string"


@pytest.fixture()
def scored(spark, tmpdir_path):
    wm = spark.createDataFrame(
        [("e1", ["A", "B"], {"A": "RECEIVED", "B": "FAILED"}, "q1", "the cat sat", None), ("e2", ["A"], {"A": "RECEIVED"}, "q2", None, "c"),
         ("e3", [], {}, "q3", "r", None), ("e4", ["A"], {"A": "PENDING"}, "q4", "r", None)], WM
    )
    resp = spark.createDataFrame([("e1", "A", "the cat sat"), ("e2", "A", "")], "evaluation_id string, model string, response string")
    ready = spark.createDataFrame([(e,) for e in ("e1", "e2", "e3", "lost", "e1")], "evaluation_id string")
    return wm, resp, ready, os.path.join(tmpdir_path, "final")


def listing(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}


def test_states_documents_and_ledger(spark, scored):
    wm, resp, ready, path = scored
    assert cp.read_ledger(spark, path).count() == 0 and cp.read_states(spark, path).count() == 0
    assert cp.complete_batch(ready, wm, resp, path, 7)
    st = {r.evaluation_id: r for r in cp.read_states(spark, path).collect()}
    assert set(st) == {"e1", "e2", "e3", "lost"}
    assert (st["e1"].status, st["e1"].final_key, st["e1"].n_models, st["e1"].n_scored) == ("COMPLETED", "batch_id=7/e1", 2, 1)
    assert (st["e2"].status, st["e2"].n_models, st["e2"].n_scored) == ("COMPLETED", 1, 0)  # its only response is empty
    assert (st["e3"].status, st["e3"].error_message, st["e3"].final_key) == ("FAILED", cp.FAILURE + cp.NO_MODELS, None)
    assert st["lost"].error_message == cp.FAILURE + cp.NO_RECORD
    entry = cp.read_ledger(spark, path).first()
    assert (entry.batch_id, entry.n_ready, entry.n_completed, entry.n_failed, entry.n_scored) == (7, 4, 2, 2, 1)
    docs = {d.final_key: d for d in cp.open_documents(cp.read_states(spark, path), path).collect()}
    assert set(docs) == {"batch_id=7/e1", "batch_id=7/e2"}
    assert docs["batch_id=7/e1"].model_comparisons["A"].metrics["ROUGE-L_F1"] == 1.0 and docs["batch_id=7/e1"].prompt == "q1"


def test_a_replayed_batch_changes_nothing(spark, scored):
    wm, resp, ready, path = scored
    cp.complete_batch(ready, wm, resp, path, 0)
    before = listing(path)
    assert not cp.complete_batch(ready, wm, resp.limit(0), path, 0)
    assert listing(path) == before


def test_a_batch_without_its_entry_is_written_again_as_a_whole(spark, scored):
    wm, resp, ready, path = scored
    cp.complete_batch(ready, wm, resp, path, 0)
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(f"{path}/states/batch_id=1")  # left by a batch that died
    assert cp.read_states(spark, path).count() == 4
    assert cp.complete_batch(ready.where("evaluation_id = 'e1'"), wm, resp, path, 1)
    st = {r.evaluation_id: r.final_key for r in cp.read_states(spark, path).collect()}
    assert st["e1"] == "batch_id=1/e1" and st["e2"] == "batch_id=0/e2" and len(st) == 4


def test_stream_records_batches(spark, scored, tmpdir_path):
    from evalspark.operators import status as st
    from evalspark.streaming.scoring import score_stream

    wm, resp, _, path = scored
    rd, ck = os.path.join(tmpdir_path, "ready"), os.path.join(tmpdir_path, "ck")
    schema = "evaluation_id string, detail_type string"
    for rows in ([("e1", st.READY_TYPE), ("e4", "EvaluationTimedOut")], [("e2", st.READY_TYPE), ("lost", st.READY_TYPE)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(rd)
        score_stream(spark.readStream.schema(schema).parquet(rd), wm, resp, path, ck).awaitTermination()
    st_ = {r.evaluation_id: r.status for r in cp.read_states(spark, path).collect()}
    assert st_ == {"e1": "COMPLETED", "e2": "COMPLETED", "lost": "FAILED"}
    assert {r.batch_id: r.n_ready for r in cp.read_ledger(spark, path).collect()} == {0: 1, 1: 2}


def test_empty_batch(spark, scored):
    wm, resp, ready, path = scored
    assert cp.complete_batch(ready.limit(0), wm, resp, path, 3)
    assert cp.read_ledger(spark, path).first().n_ready == 0 and cp.read_states(spark, path).count() == 0
