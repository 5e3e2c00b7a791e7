import json
import os

import pandas as pd
from pyspark.sql import functions as F

from evalspark.operators import requests as rq
from evalspark.operators.invoke import invoke_models, response_events
from evalspark.operators.judge import judge, verdict_ratio
from evalspark.sources import io


def test_request_files_and_responses_roundtrip(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "in")
    os.makedirs(d)
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump([{"prompt": "q1", "reference_answer": "r1"}, {"prompt": "q2"}], f, indent=2)
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump({"prompt": "q3", "context": "c"}, f)
    bodies = io.read_request_bodies(spark, d)
    items = rq.parse_requests(bodies, "body", ["batch_id"]).collect()
    assert sorted(r.prompt for r in items) == ["q1", "q2", "q3"]

    resp = spark.createDataFrame(
        [("e1", "Open AI", "answer one", "p"), ("e2", "Gemini", "", "p")], "evaluation_id string, model string, response string, prompt_sent string"
    )
    out = os.path.join(tmpdir_path, "resp")
    io.write_responses(resp, out)
    back = {(r.evaluation_id, r.model_key): r.response for r in io.read_responses(spark, out).collect()}
    assert back[("e1", "open_ai")] == "answer one" and back[("e2", "gemini")] in ("", None)


def test_invoke_models_errors_become_rows(spark):
    fanned = spark.createDataFrame(
        [("e1", "good", "hello"), ("e1", "bad", "hello"), ("e2", "good", "boom")], "evaluation_id string, model string, formatted_prompt string"
    )

    def factory(model):
        if model == "bad":
            raise RuntimeError("no client")
        return lambda p: (_ for _ in ()).throw(ValueError("refused")) if p == "boom" else p.upper()

    res = {(r.evaluation_id, r.model): r for r in invoke_models(fanned, factory).collect()}
    assert res[("e1", "good")].status == "RECEIVED" and res[("e1", "good")].response == "HELLO"
    assert res[("e1", "bad")].status == "FAILED" and "no client" in res[("e1", "bad")].error
    assert res[("e2", "good")].status == "FAILED" and res[("e2", "good")].error == "refused"
    ev = {(r.evaluation_id, r.model): r for r in response_events(invoke_models(fanned, factory)).collect()}
    assert ev[("e1", "bad")].status is None and ev[("e1", "bad")].detail_type == "LLMResponseFailed"


def test_judge_with_caller_function(spark):
    reqs = spark.createDataFrame(
        [("e", "m", "faithfulness", i, "claim ok" if i % 2 else "claim bad") for i in range(6)],
        "evaluation_id string, model string, criterion string, unit_no int, text string",
    )

    def judge_fn(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "evaluation_id": b.evaluation_id,
                "model": b.model,
                "criterion": b.criterion,
                "unit_no": b.unit_no,
                "verdict": b.text.str.endswith("ok"),
                "note": None,
            }
        )

    v = judge(reqs, judge_fn)
    r = verdict_ratio(v).collect()[0]
    assert r.score == 0.5 and r.n_verdicts == 6

    def broken(b):
        raise RuntimeError("judge down")

    rows = judge(reqs, broken).collect()
    assert all(x.verdict is None and "judge down" in x.note for x in rows)


def test_score_stream_writes_documents(spark, tmpdir_path):
    from evalspark.streaming.scoring import score_batch

    wm = spark.createDataFrame(
        [("e1", ["A", "B"], {"A": "RECEIVED", "B": "FAILED"}, "the cat sat on the mat")],
        "evaluation_id string, requested_models array<string>, responses_received map<string,string>, reference_answer string",
    )
    resp = spark.createDataFrame([("e1", "A", "the cat sat on a mat")], "evaluation_id string, model string, response string")
    ready = spark.createDataFrame([("e1",)], "evaluation_id string")
    doc = score_batch(ready, wm, resp).collect()[0].model_comparisons
    assert doc["A"].status == "COMPLETED" and 0 < doc["A"].metrics["ROUGE-1_F1"] < 1
    assert doc["B"].status == "SKIPPED_NOT_RECEIVED"


def test_criteria_requests(spark):
    from evalspark.operators.judge import criteria_requests

    pairs = spark.createDataFrame([("p1", "a"), ("p2", "b")], "pair_id string, candidate string")
    crit = [("coherence", "collective quality of all sentences", ["actual_output"]), ("faithfulness", "claims supported", ["actual_output", "context"])]
    rows = criteria_requests(pairs, crit).collect()
    assert len(rows) == 4 and {r.criterion for r in rows} == {"coherence", "faithfulness"}


def test_materialize_keeps_random_ids(spark):
    from evalspark.session import materialize

    df = spark.createDataFrame([(f"b{i}", json.dumps({"prompt": f"q{i}"})) for i in range(20)], "batch_id string, body string")
    ev = rq.initiate(rq.valid_requests(rq.validate_requests(rq.parse_requests(df))), random_ids=True)
    fixed = materialize(ev)
    a = sorted(r.evaluation_id for r in fixed.collect())
    b = sorted(r.evaluation_id for r in fixed.collect())
    assert a == b and len(set(a)) == 20


def test_final_documents_rewrite_is_idempotent(spark, tmpdir_path):
    from evalspark.operators.outcomes import read_final_metrics, to_final_metrics, write_final_metrics

    out = spark.createDataFrame(
        [("e1", "A", "COMPLETED", None, "t"), ("e2", "A", "COMPLETED", None, "u")],
        "evaluation_id string, model string, outcome string, message string, response string",
    )
    sc = spark.createDataFrame([("e1", "A", "BLEU", 0.5), ("e2", "A", "BLEU", 0.7)], "evaluation_id string, model string, metric string, score double")
    path = os.path.join(tmpdir_path, "final")
    write_final_metrics(to_final_metrics(out, sc), path)
    for _ in range(2):  # one evaluation scored again in a later batch, and that batch replayed
        again = sc.withColumn("score", F.col("score") / 2)
        write_final_metrics(to_final_metrics(out.where("evaluation_id = 'e1'"), again), path, batch_id=1)
    assert spark.read.text(path).count() == 3
    docs = {d.evaluation_id: d.model_comparisons["A"].metrics["BLEU"] for d in read_final_metrics(spark, path).collect()}
    assert docs == {"e1": 0.25, "e2": 0.7}


def test_document_fields_and_other_metrics(spark):
    from evalspark.operators.outcomes import to_final_metrics
    from evalspark.operators.scoring import cosine_metric, judge_scores

    out = spark.createDataFrame(
        [("e1", "A", "COMPLETED", None, "t"), ("e1", "B", "EMPTY_RESPONSE", "was empty", None), ("e1", "C", "SKIPPED_NOT_RECEIVED", "not here", None)],
        "evaluation_id string, model string, outcome string, message string, response string",
    )
    ratios = spark.createDataFrame(
        [("e1", "A", "faithfulness", 0.5), ("e1", "A", "unnamed", 1.0)], "evaluation_id string, model string, criterion string, score double"
    )
    cos = spark.createDataFrame([("e1", "A", 0.25)], "evaluation_id string, model string, cosine double")
    evals = spark.createDataFrame([("e1", "q", "a", None)], "evaluation_id string, prompt string, reference_answer string, context string")
    d = to_final_metrics(out, judge_scores(ratios).unionByName(cosine_metric(cos)), evals).collect()[0]
    assert (d.prompt, d.reference_answer, d.context) == ("q", "a", "")
    mc = d.model_comparisons
    assert mc["A"].metrics == {"Faithfulness_Score": 0.5, "Cosine_Similarity_Score": 0.25} and mc["A"].error is None
    assert (mc["B"].error, mc["B"].message) == ("was empty", None) and (mc["C"].error, mc["C"].message) == (None, "not here")


def test_envelopes_of_initiated_and_ready(spark):
    import datetime as dt

    from evalspark.operators import status as st

    ev = spark.createDataFrame(
        [("e1", "q", None, None, ["A", "B"], "INITIATED", dt.datetime(2024, 1, 1))],
        "evaluation_id string, prompt string, reference_answer string, context string, requested_models array<string>, status string, created_at timestamp",
    )
    back = st.parse_initiated(st.initiated_envelopes(ev)).select(*ev.columns)
    assert back.collect() == ev.collect()
    env = json.loads(st.ready_envelopes(ev.select("evaluation_id")).collect()[0].value)
    assert env == {"detail-type": "AllLLMResponsesReady", "detail": {"evaluation_id": "e1"}}
    assert st.parse_initiated(st.ready_envelopes(ev)).count() == 0
