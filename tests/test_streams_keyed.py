"""Snapshot by buckets, routed events, re-deliveries: streams against tables and brute force."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from evalspark.streaming import routing, snapshot
from evalspark.streaming import status as sst

T0 = dt.datetime(2024, 1, 1)
UPDATE = "evaluation_id string, model string, status string, updated_at timestamp, updated_seq long"
EVENT = "evaluation_id string, model string, detail_type string, event_time timestamp, event_seq long, note string"
RECORD = "evaluation_id string, created_at timestamp"


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


# --- snapshot -------------------------------------------------------------------------------------


def batch(spark, rng, n):
    rows = [(f"e{rng.randint(0, 30)}", rng.choice("AB"), rng.choice(["RECEIVED", "FAILED"]), minutes(rng.randint(0, 500)), k) for k in range(n)]
    return rows, spark.createDataFrame(rows, UPDATE)


def latest(rows):
    out = {}
    for e, m, s, t, q in rows:
        if (e, m) not in out or (t, q) > out[e, m][1:]:
            out[e, m] = (s, t, q)
    return out


def shown(spark, path):
    return {(r.evaluation_id, r.model): (r.status, r.updated_at, r.updated_seq) for r in snapshot.read_snapshot(spark, path).collect()}


def test_snapshot_equals_all_batches_and_stays_small(spark, tmpdir_path):
    path, rng, rows = os.path.join(tmpdir_path, "snap"), random.Random(4), []
    assert snapshot.read_snapshot(spark, path).count() == 0
    for n in range(6):
        more, df = batch(spark, rng, 12)
        rows += more
        assert snapshot.merge_batch(df, path, n, buckets=4)
        assert shown(spark, path) == latest(rows)
    folders = [f"{b}/{x}" for b in os.listdir(f"{path}/data") for x in os.listdir(f"{path}/data/{b}") if x.startswith("bucket=")]
    assert len(folders) <= 8  # two states of four buckets, after six batches
    assert len(os.listdir(f"{path}/manifest")) == 2


def test_a_batch_touches_its_buckets_only_and_a_replay_nothing(spark, tmpdir_path):
    path, rng = os.path.join(tmpdir_path, "snap"), random.Random(5)
    rows, df = batch(spark, rng, 40)
    snapshot.merge_batch(df, path, 0, buckets=8)
    one = spark.createDataFrame([("e1", "A", "RECEIVED", minutes(900), 99)], UPDATE)
    assert snapshot.merge_batch(one, path, 1, buckets=8)
    assert len([x for x in os.listdir(f"{path}/data/batch_id=1") if x.startswith("bucket=")]) == 1
    state = shown(spark, path)
    assert state == latest(rows + [("e1", "A", "RECEIVED", minutes(900), 99)])
    before = {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}
    assert not snapshot.merge_batch(df, path, 1, buckets=8)
    assert before == {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}


def test_a_batch_that_died_is_merged_anew(spark, tmpdir_path):
    path, rng = os.path.join(tmpdir_path, "snap"), random.Random(6)
    a, da = batch(spark, rng, 20)
    b, db = batch(spark, rng, 20)
    snapshot.merge_batch(da, path, 0, buckets=3)
    db.limit(3).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/data/batch_id=1")  # no manifest followed
    assert shown(spark, path) == latest(a)
    snapshot.merge_batch(db, path, 1, buckets=3)
    assert shown(spark, path) == latest(a + b)
    snapshot.merge_batch(db.limit(0), path, 2, buckets=3)
    assert shown(spark, path) == latest(a + b)


def test_snapshot_stream(spark, tmpdir_path):
    src, path, ck = (os.path.join(tmpdir_path, n) for n in ("src", "snap", "ck"))
    schema = EVENT.replace("note string", "status string")
    rows = [(f"e{k % 5}", "AB"[k % 2], "LLMResponseFailed" if k % 3 == 0 else "LLMResponseReceived", minutes(k), k, None) for k in range(30)]
    for lo in (0, 10, 20):
        spark.createDataFrame(rows[lo : lo + 10], schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        snapshot.write_snapshot(sst.status_updates(stream), path, ck, buckets=4).awaitTermination()
    exp = {(e, m): "FAILED" if d == "LLMResponseFailed" else "RECEIVED" for e, m, d, *_ in rows}
    assert {k: v[0] for k, v in shown(spark, path).items()} == exp


# --- routed events ----------------------------------------------------------------------------------


def test_late_and_missing_evaluations(spark, tmpdir_path):
    ev, rec, out, ck = (os.path.join(tmpdir_path, n) for n in ("ev", "rec", "out", "ck"))

    def go(events, records):
        if events:
            spark.createDataFrame(events, EVENT).write.mode("append").parquet(ev)
        if records:
            spark.createDataFrame(records, RECORD).write.mode("append").parquet(rec)
        e, r = spark.readStream.schema(EVENT).parquet(ev), spark.readStream.schema(RECORD).parquet(rec)
        routed = routing.route_events(e, r, wait="30 minutes", before="2 hours", delay="10 minutes")
        routing.write_routes(routed, out, ck).awaitTermination()
        df = spark.read.option("basePath", out).parquet(out)
        return sorted(((x.evaluation_id, x.event_seq, x.route) for x in df.collect()), key=str)

    first = go([("known", "A", "r", minutes(10), 1, ""), ("late", "A", "r", minutes(11), 2, ""), ("never", "A", "r", minutes(12), 3, ""), (None, "A", "r", minutes(12), 4, "")],
               [("known", minutes(0)), ("known", minutes(0))])
    assert first == [("known", 1, "accepted")]
    assert ("late", 2, "accepted") in go([], [("late", minutes(25)), ("other", minutes(0))])
    # both streams move on: the watermark passes the time by which an evaluation could come
    go([("known", "B", "r", minutes(60), 5, "")], [("more", minutes(300))])
    go([("more", "A", "r", minutes(310), 6, "")], [("even more", minutes(320))])
    got = go([("even more", "A", "r", minutes(330), 7, "")], [("last", minutes(340))])
    assert ("never", 3, "quarantined") in got and ("known", 5, "accepted") in got and ("more", 6, "accepted") in got
    assert [x for x in got if x[0] == "late"] == [("late", 2, "accepted")] and len({x[1] for x in got}) == len(got)
    assert ("never", 3, "accepted") not in got


def test_routes_of_tables(spark):
    ev = spark.createDataFrame([("a", "A", "r", minutes(10), 1, ""), ("b", "A", "r", minutes(10), 2, ""), (None, "A", "r", minutes(1), 3, ""), ("c", "A", "r", minutes(900), 4, "")], EVENT)
    rec = spark.createDataFrame([("a", minutes(5)), ("a", minutes(6)), ("c", minutes(0))], RECORD)
    got = {r.event_seq: r.route for r in routing.route_events(ev, rec, wait="1 hour", before="2 hours").collect()}
    assert got == {1: "accepted", 2: "quarantined", 3: "quarantined", 4: "quarantined"}


# --- re-deliveries ----------------------------------------------------------------------------------

KEYS = ["evaluation_id", "event_seq"]


def brute(rows, delay):
    out, last = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r)):
        k = (r[0], r[4])
        if k not in last or r[3] - last[k] > dt.timedelta(minutes=delay):
            last[k] = r[3]
            out.append((r[0], r[4], r[3]))
    return sorted(out, key=str)


def deliveries(seed, n, span):
    rng = random.Random(seed)
    return [(rng.choice(["e1", "e2", "hot", "hot"]), "A", "r", minutes(rng.randint(0, span)), rng.randint(0, 2), f"n{k}") for k in range(n)]


@pytest.mark.parametrize("seed, n, span", [(1, 60, 2000), (2, 150, 700), (3, 30, 30000), (4, 1, 1)])
def test_redeliveries_equal_brute_force(spark, seed, n, span):
    rows = deliveries(seed, n, span)
    df = spark.createDataFrame(rows, EVENT)
    got = sorted(((r.evaluation_id, r.event_seq, r.event_time) for r in routing.drop_redelivered(df, "1 hour", KEYS).collect()), key=str)
    assert got == brute(rows, 60)


def test_redeliveries_equal_the_stream(spark, tmpdir_path):
    src, ck = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "ck")
    rows = sorted(deliveries(8, 80, 1500), key=lambda r: r[3])
    chunks = [rows[k : k + 8] for k in range(0, len(rows), 8)]

    def go(part):
        spark.createDataFrame(part, EVENT).coalesce(1).sortWithinPartitions("event_time").write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENT).parquet(src)
        kept = sst.dedup_events(stream, "1 hour", KEYS)
        q = kept.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmpdir_path}/out/batch_id={n}"))
        q.option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    # a stream forgets a key when its watermark has passed; deliveries an hour or more apart both count there and here
    short = [r for part in chunks[:3] for r in part if r[3] <= rows[0][3] + dt.timedelta(minutes=60)]
    go(short[: len(short) // 2])
    go(short[len(short) // 2 :])
    got = sorted((r.evaluation_id, r.event_seq, r.event_time) for r in spark.read.parquet(f"{tmpdir_path}/out").select("evaluation_id", "event_seq", "event_time").collect())
    twin = routing.drop_redelivered(spark.createDataFrame(short, EVENT), "1 hour", KEYS).collect()
    assert got == sorted((r.evaluation_id, r.event_seq, r.event_time) for r in twin)


def test_nulls_ties_and_empty_table(spark):
    rows = [(None, "A", "r", minutes(0), None, "b"), (None, "A", "r", minutes(0), None, "a"), (None, "A", "r", minutes(50), None, "c"),
            ("e", "A", "r", None, 1, "x"), ("e", "A", "r", None, 1, "x")]
    got = [r.note for r in routing.drop_redelivered(spark.createDataFrame(rows, EVENT), "1 hour", KEYS).collect()]
    assert sorted(got) == ["a", "x", "x"]
    assert routing.drop_redelivered(spark.createDataFrame([], EVENT)).count() == 0
