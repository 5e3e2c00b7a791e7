import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from evalspark.operators import status as st
from evalspark.sources import views
from evalspark.streaming import status as sst


def _write_event_files(spark, root, parts=4):
    ev = views.status_events(spark, SF_SMALL)
    env = st.to_envelopes(ev.withColumn("part", F.pmod(F.col("event_seq"), F.lit(parts))))
    # one folder per slice, so the stream sees several files over several micro-batches
    for p in range(parts):
        st.to_envelopes(ev.where(F.pmod(F.col("event_seq"), F.lit(parts)) == p)).coalesce(1).write.mode("overwrite").text(
            os.path.join(root, f"slice{p}")
        )
    del env
    return ev


def _stream(spark, root):
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).text(root)
    return st.parse_events(raw)


def test_status_stream_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "events")
    ev = _write_event_files(spark, src)
    out, ck = os.path.join(tmpdir_path, "status"), os.path.join(tmpdir_path, "ck")
    q = sst.write_status_updates(sst.status_updates(_stream(spark, src)), out, ck)
    q.awaitTermination()
    got = {(r.evaluation_id, r.model): r.status for r in sst.current_status(spark, out).collect()}
    exp = {(r.evaluation_id, r.model): r.status for r in st.latest_status(ev).collect()}
    assert got == exp and len(got) > 0
    n_dirs = len(os.listdir(out))
    q2 = sst.write_status_updates(sst.status_updates(_stream(spark, src)), out, ck)  # restart: nothing new
    q2.awaitTermination()
    assert len(os.listdir(out)) == n_dirs


def test_status_stream_default_checkpoint_is_shared_folder(spark, tmpdir_path):
    from evalspark.session import checkpoint_dir, stream_checkpoint

    src = os.path.join(tmpdir_path, "events")
    _write_event_files(spark, src, parts=2)
    out = os.path.join(tmpdir_path, "status")
    ck = stream_checkpoint(spark, "status_updates")
    assert ck.startswith(checkpoint_dir(spark).rstrip("/") + "/")
    sst.write_status_updates(sst.status_updates(_stream(spark, src)), out).awaitTermination()
    assert os.path.isdir(os.path.join(ck.replace("file:", ""), "offsets"))
    n_dirs = len(os.listdir(out))
    sst.write_status_updates(sst.status_updates(_stream(spark, src)), out).awaitTermination()  # restart
    assert len(os.listdir(out)) == n_dirs


def test_ready_stream_emits_once_and_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "events")
    ev = _write_event_files(spark, src)
    evals = views.evaluations(spark, SF_SMALL)
    ck = os.path.join(tmpdir_path, "ck_ready")
    ready = sst.stream_ready(_stream(spark, src), evals)
    q = ready.writeStream.format("memory").queryName("ready_out").outputMode("append").option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM ready_out").collect()
    ids = [r.evaluation_id for r in rows]
    assert len(ids) == len(set(ids)) and len(ids) > 0
    wm = st.status_map(evals, st.latest_status(ev))
    exp = {r.evaluation_id for r in st.ready_evaluations(wm).collect()}
    assert set(ids) == exp


def test_dedup_events(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "dup")
    ev = views.status_events(spark, SF_SMALL).limit(50)
    st.to_envelopes(ev).coalesce(1).write.text(os.path.join(src, "a"))
    st.to_envelopes(ev).coalesce(1).write.text(os.path.join(src, "b"))
    d = sst.dedup_events(_stream(spark, src), "1 day")
    q = d.writeStream.format("memory").queryName("dedup_out").option("checkpointLocation", os.path.join(tmpdir_path, "ckd")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) AS n FROM dedup_out").collect()[0].n == 50


def test_ready_stream_timeout(spark, tmpdir_path):
    import datetime as dt

    src = os.path.join(tmpdir_path, "tev")
    t0 = dt.datetime(2024, 1, 1)
    evals = spark.createDataFrame(
        [("e1", ["A", "B"], "INITIATED"), ("e2", ["A"], "INITIATED")], "evaluation_id string, requested_models array<string>, status string"
    )
    schema = "evaluation_id string, model string, detail_type string, status string, error string, event_time timestamp, event_seq long"
    batches = [
        [("e1", "A", "LLMResponseReceived", "RECEIVED", None, t0, 1)],
        [("e2", "A", "LLMResponseReceived", "RECEIVED", None, t0 + dt.timedelta(hours=3), 2)],
        [("e2", "A", "LLMResponseReceived", "RECEIVED", None, t0 + dt.timedelta(hours=4), 3)],
    ]
    for i, rows in enumerate(batches):
        st.to_envelopes(spark.createDataFrame(rows, schema)).coalesce(1).write.text(os.path.join(src, f"s{i}"))
    ready = sst.stream_ready(_stream(spark, src), evals, timeout="30 minutes", delay="1 hour")
    q = ready.writeStream.format("memory").queryName("timeout_out").outputMode("append").option(
        "checkpointLocation", os.path.join(tmpdir_path, "ckt")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.evaluation_id, r.detail_type) for r in spark.sql("SELECT * FROM timeout_out").collect()}
    assert ("e2", "AllLLMResponsesReady") in got and ("e1", "EvaluationTimedOut") in got


EVENT_SCHEMA = "evaluation_id string, model string, detail_type string, status string, error string, event_time timestamp, event_seq long"


def _received(spark, src, name, rows):
    df = spark.createDataFrame([(e, m, "LLMResponseReceived", "RECEIVED", None, t, q) for e, m, t, q in rows], EVENT_SCHEMA)
    st.to_envelopes(df).coalesce(1).write.text(os.path.join(src, name))


def _run_ready(spark, frame, name, ck):
    def sink(df, batch_id):
        df.write.mode("overwrite").parquet(os.path.join(name, f"batch_id={batch_id}"))

    frame.writeStream.option("checkpointLocation", ck).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.evaluation_id, r.detail_type, r.n_models) for r in spark.read.parquet(name).collect())


def test_ready_stream_sees_evaluations_created_after_the_start(spark, tmpdir_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    src, es = os.path.join(tmpdir_path, "ev"), os.path.join(tmpdir_path, "evals")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    schema = "evaluation_id string, requested_models array<string>, status string, created_at timestamp"

    def frame():
        return sst.stream_ready(_stream(spark, src), spark.readStream.schema(schema).parquet(es))

    spark.createDataFrame([("e1", ["A"], "INITIATED", t0), ("closed", ["A"], "COMPLETED", t0)], schema).write.parquet(es)
    # "late" answers before its evaluation is known; "closed" is no open evaluation
    _received(spark, src, "s0", [("e1", "A", t0, 1), ("late", "A", t0, 2), ("closed", "A", t0, 3)])
    assert _run_ready(spark, frame(), out, ck) == [("e1", st.READY_TYPE, 1)]
    spark.createDataFrame([("late", ["A", "B", "A"], "INITIATED", t0)], schema).write.mode("append").parquet(es)
    _received(spark, src, "s1", [("late", "B", t0, 4), ("e1", "A", t0, 5)])  # e1 again: fires nothing
    assert _run_ready(spark, frame(), out, ck) == [("e1", st.READY_TYPE, 1), ("late", st.READY_TYPE, 2)]


def test_ready_stream_fires_once_around_the_deadline(spark, tmpdir_path):
    import datetime as dt

    t0, h = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    src, out, ck = (os.path.join(tmpdir_path, n) for n in ("ev", "out", "ck"))
    evals = spark.createDataFrame(
        [("e1", ["A", "B"], "INITIATED"), ("e2", ["A"], "INITIATED"), ("e3", ["A", "B"], "INITIATED")],
        "evaluation_id string, requested_models array<string>, status string",
    )

    def frame():
        return sst.stream_ready(_stream(spark, src), evals, timeout="30 minutes", delay="1 hour", keep="7 days")

    _received(spark, src, "s0", [("e1", "A", t0, 1), ("e2", "A", t0 + 5 * h, 2)])
    first = _run_ready(spark, frame(), out, ck)
    assert ("e2", st.READY_TYPE, 1) in first
    # e3 comes after the watermark (4 h) and is timed out by the next one (8 h); both answer after their timeout
    _received(spark, src, "s1", [("e3", "A", t0 + 4.5 * h, 3), ("e2", "A", t0 + 9 * h, 4)])
    _run_ready(spark, frame(), out, ck)
    _received(spark, src, "s2", [("e1", "A", t0 + 9 * h, 5), ("e1", "B", t0 + 9 * h, 6), ("e3", "B", t0 + 9 * h, 7)])
    got = _run_ready(spark, frame(), out, ck)
    assert got == [("e1", sst.TIMED_OUT_TYPE, 2), ("e2", st.READY_TYPE, 1), ("e3", sst.TIMED_OUT_TYPE, 2)]


def test_state_is_typed_per_model_and_freed_after_firing(spark, tmpdir_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    src, out, ck = (os.path.join(tmpdir_path, n) for n in ("ev", "out", "ck"))
    evals = spark.createDataFrame(
        [("e1", ["A", "B", "C"], "INITIATED"), ("e2", ["A"], "INITIATED")], "evaluation_id string, requested_models array<string>, status string"
    )
    _received(spark, src, "s0", [("e1", "A", t0, 1), ("e1", "A", t0, 5), ("e1", "B", t0, 2), ("e2", "A", t0, 3)])
    assert _run_ready(spark, sst.stream_ready(_stream(spark, src), evals), out, ck) == [("e2", st.READY_TYPE, 1)]

    def state(name):
        return spark.read.format("statestore").option("path", ck).option("stateVarName", name).load()

    models = {(r.key.evaluation_id, r.user_map_key.model): tuple(r.user_map_value) for r in state("models").collect()}
    us = int(t0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert models == {("e1", "A"): ("RECEIVED", us, 5), ("e1", "B"): ("RECEIVED", us, 2)}  # an entry per model, none of what fired
    assert [(r.key.evaluation_id, list(r.value.models)) for r in state("requested").collect()] == [("e1", ["A", "B", "C"])]
    assert [r.key.evaluation_id for r in state("fired").collect()] == ["e2"]


def test_late_data_past_the_deadline_times_out_at_once():
    from evalspark.streaming.ready import ReadyProcessor
    from pyspark.sql import Row

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    class Map(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    class Handle:
        def __init__(self):
            self.timers = set()

        def getValueState(self, name, schema):
            return Value()

        def getMapState(self, name, key, value):
            return Map()

        def registerTimer(self, ms):
            self.timers.add(ms)

        def deleteTimer(self, ms):
            self.timers.remove(ms)

        def listTimers(self):
            return iter(self.timers)

    class Time:
        ms = 0

        def getCurrentWatermarkInMs(self):
            return self.ms

    def rows(model, us):
        return iter([Row(model=model, eff_status="RECEIVED", event_us=us, event_seq=1, requested_models=["A", "B"])])

    handle, time, work = Handle(), Time(), ReadyProcessor(True, 1000, 5000)
    work.init(handle)
    assert list(work.handleInputRows(("e",), rows("A", 1_000_000), time)) == [] and handle.timers == {2000}
    time.ms = 3000  # past the deadline, and the key has data in this batch
    out = list(work.handleInputRows(("e",), rows("A", 3_500_000), time))
    assert [o.detail_type for o in out] == [sst.TIMED_OUT_TYPE] and handle.timers == {8500}
    assert list(work.handleInputRows(("e",), rows("B", 3_600_000), time)) == [] and handle.timers == {8600}
    time.ms = 9000
    assert list(work.handleExpiredTimer(("e",), time, None)) == [] and not work.fired.exists()


def test_score_stream_reads_tables_anew(spark, tmpdir_path):
    import datetime as dt

    from evalspark.operators.outcomes import read_final_metrics
    from evalspark.streaming.scoring import score_stream

    rd, rs, out, ck = (os.path.join(tmpdir_path, n) for n in ("ready", "resp", "out", "ck"))
    evals = spark.createDataFrame(
        [(e, "q", "the cat sat", None, ["A"], {"A": "RECEIVED"}, "PROCESSING", dt.datetime(2024, 1, 1)) for e in ("e1", "e2")],
        "evaluation_id string, prompt string, reference_answer string, context string, requested_models array<string>, "
        "responses_received map<string,string>, status string, created_at timestamp",
    )
    resp_schema = "evaluation_id string, model string, response string"
    ready_schema = "evaluation_id string, detail_type string, n_models int"

    def run():
        ready = spark.readStream.schema(ready_schema).parquet(rd)
        score_stream(ready, evals, lambda s: s.read.schema(resp_schema).parquet(rs), out, ck).awaitTermination()
        return {r.evaluation_id: r for r in read_final_metrics(spark, f"{out}/documents").collect()}

    for e in ("e1", "e2"):  # e2's response is stored after the first run
        spark.createDataFrame([(e, "A", "the cat sat")], resp_schema).write.mode("append").parquet(rs)
        spark.createDataFrame([(e, st.READY_TYPE, 1)], ready_schema).write.mode("append").parquet(rd)
        docs = run()
        assert docs[e].model_comparisons["A"].status == "COMPLETED"
        assert docs[e].model_comparisons["A"].metrics["ROUGE-L_F1"] == 1.0
    assert set(docs) == {"e1", "e2"} and docs["e1"].prompt == "q" and docs["e1"].context == ""
