import datetime as dt

import pytest
from pyspark.sql import functions as F

from evalspark.operators import outcomes as oc
from evalspark.operators import status as st

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def t(s):
    return T0 + dt.timedelta(seconds=s)


EVENTS_SCHEMA = "evaluation_id string, model string, detail_type string, status string, error string, event_time timestamp, event_seq long"
EVALS_SCHEMA = "evaluation_id string, requested_models array<string>, status string, created_at timestamp"


@pytest.fixture(scope="module")
def world(spark):
    evals = spark.createDataFrame(
        [
            ("e1", ["A", "B"], "INITIATED", t(0)),
            ("e2", ["A", "B"], "INITIATED", t(0)),
            ("e3", [], "INITIATED", t(0)),
            ("e4", ["A", "A", "B"], "PROCESSING", t(0)),
            ("e5", ["A", "B"], "INITIATED", t(0)),
            ("e6", ["A"], "COMPLETED", t(0)),
            ("e7", ["A", "B"], "INITIATED", t(0)),
        ],
        EVALS_SCHEMA,
    )
    R, Fd = "LLMResponseReceived", "LLMResponseFailed"
    events = spark.createDataFrame(
        [
            ("e1", "A", R, "RECEIVED", None, t(1), 1),
            ("e1", "A", R, "RECEIVED", None, t(1), 1),  # duplicate event
            ("e1", "B", R, "RECEIVED", None, t(2), 2),
            ("e2", "A", Fd, None, "boom", t(1), 3),  # failed without status
            ("e2", "B", R, "RECEIVED", None, t(1), 4),
            ("e2", "B", Fd, None, "late", t(5), 5),  # failed after received
            ("e4", "A", R, "RECEIVED", None, t(1), 6),
            ("e4", "B", R, "RECEIVED", None, t(1), 7),
            ("e4", "C", R, "RECEIVED", None, t(1), 8),  # model not requested
            ("e5", "A", Fd, None, "x", t(1), 9),
            ("e5", "B", Fd, None, "y", t(1), 10),  # all failed
            ("e7", "A", R, "RECEIVED", None, t(3), 11),
            ("e7", "A", Fd, None, "z", t(3), 12),  # equal time, later seq wins
            ("zz", "A", R, "RECEIVED", None, t(1), 13),  # unknown evaluation
        ],
        EVENTS_SCHEMA,
    )
    return evals, events


def test_latest_status_rules(spark, world):
    evals, events = world
    got = {(r.evaluation_id, r.model): r.status for r in st.latest_status(events).collect()}
    assert got[("e2", "A")] == "FAILED" and got[("e2", "B")] == "FAILED" and got[("e7", "A")] == "FAILED"
    legacy = {(r.evaluation_id, r.model): r.status for r in st.latest_status(events, legacy_default=True).collect()}
    assert legacy[("e2", "A")] == "RECEIVED"


def test_status_map_and_counts(spark, world):
    evals, events = world
    wm = st.status_map(evals, st.latest_status(events))
    maps = {r.evaluation_id: dict(r.responses_received) for r in wm.collect()}
    assert maps["e4"] == {"A": "RECEIVED", "B": "RECEIVED", "C": "RECEIVED"}  # not requested, still in the map
    assert maps["e3"] == {} and maps["e6"] == {"A": "PENDING"}
    assert "zz" not in maps
    rc = {r.evaluation_id: (r.n_requested, r.n_received) for r in st.received_count(wm).collect()}
    assert rc["e4"] == (2, 2) and rc["e2"] == (2, 0)
    ready = {r.evaluation_id for r in st.ready_evaluations(wm).collect()}
    assert ready == {"e1", "e2", "e4", "e5"}
    code_rule = {r.evaluation_id for r in st.ready_evaluations(wm, count_failed=False).collect()}
    assert code_rule == {"e1", "e4"}
    once = {r.evaluation_id for r in st.ready_evaluations(wm, count_failed=False, refire=False).collect()}
    assert once == {"e1"}
    prog = {r.evaluation_id: (list(r.missing), r.progress) for r in st.progress(wm).collect()}
    assert prog["e2"] == (["A", "B"], "0/2") and prog["e3"] == ([], "0/0")


def test_accept_reject_lookup(spark, world):
    evals, events = world
    assert {r.evaluation_id for r in st.rejected_events(events, evals).collect()} == {"zz"}
    assert st.accepted_events(events, evals).count() == events.count() - 1
    ids = spark.createDataFrame([("e1",), ("nope",)], "evaluation_id string")
    got = {r.evaluation_id: r.found for r in st.lookup(ids, evals).collect()}
    assert got == {"e1": True, "nope": False}


def test_timed_out(spark, world):
    evals, events = world
    wm = st.status_map(evals, st.latest_status(events))
    got = {r.evaluation_id for r in st.timed_out(wm, "2024-01-02 00:00:00", 3600).collect()}
    assert got == {"e3", "e7"}


def test_outcomes(spark):
    wm = spark.createDataFrame(
        [("e", ["A", "B", "C", "D", "E"], {"A": "PENDING", "B": "RECEIVED", "C": "RECEIVED", "D": "RECEIVED", "E": "RECEIVED"})],
        "evaluation_id string, requested_models array<string>, responses_received map<string,string>",
    )
    resp = spark.createDataFrame(
        [("e", "C", None), ("e", "D", ""), ("e", "E", "fine")], "evaluation_id string, model string, response string"
    )
    got = {r.model: r.outcome for r in oc.classify_outcomes(wm, resp).collect()}
    assert got == {"A": oc.SKIPPED, "B": oc.ERROR_OBJECT, "C": oc.EMPTY, "D": oc.EMPTY, "E": oc.COMPLETED}


def test_envelope_roundtrip(spark, world):
    _, events = world
    back = st.parse_events(st.to_envelopes(events))
    a = sorted(tuple(r) for r in events.select("evaluation_id", "model", "detail_type", "status", "error", "event_time", "event_seq").collect())
    b = sorted(tuple(r) for r in back.select("evaluation_id", "model", "detail_type", "status", "error", "event_time", "event_seq").collect())
    assert a == b


def test_final_metrics_document(spark):
    out = spark.createDataFrame(
        [("e", "A", "COMPLETED", None, "txt"), ("e", "B", "SKIPPED_NOT_RECEIVED", "msg", None)],
        "evaluation_id string, model string, outcome string, message string, response string",
    )
    sc = spark.createDataFrame([("e", "A", "BLEU", 0.5), ("e", "A", "METEOR", 0.25)], "evaluation_id string, model string, metric string, score double")
    doc = oc.to_final_metrics(out, sc).collect()[0]
    mc = doc.model_comparisons
    assert mc["A"].status == "COMPLETED" and dict(mc["A"].metrics) == {"BLEU": 0.5, "METEOR": 0.25}
    assert mc["B"].metrics is None and mc["B"].message == "msg"
