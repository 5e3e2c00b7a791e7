"""Bucketed response store: round trip, look-ups that read few files, replays, compaction."""

import os

import pytest

from evalspark.sources import store

KIND = "evaluation_id string, model string, response string, prompt_sent string"


def rows(lo, hi, text):
    return [(f"e{k:04d}", m, f"{text} {k} {m}", f"p{k}") for k in range(lo, hi) for m in ("Open AI", "b")]


def read(df):
    return {(r.evaluation_id, r.model_key): (r.response, r.prompt_sent) for r in df.collect()}


@pytest.fixture()
def filled(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "store")
    store.store_responses(spark.createDataFrame(rows(0, 300, "old"), KIND), path, 0, buckets=8)
    store.store_responses(spark.createDataFrame(rows(290, 320, "new"), KIND), path, 1, buckets=8)
    return path


def want():
    old, new = rows(0, 300, "old"), rows(290, 320, "new")
    return {(e, m.lower().replace(" ", "_")): (r, p) for e, m, r, p in old + new}


def test_round_trip_latest_batch_counts(spark, filled):
    assert read(store.stored_responses(spark, filled)) == want()
    assert len([x for x in os.listdir(filled) if x.startswith("bucket=")]) == 8  # however many evaluations


def test_storing_a_batch_again_changes_nothing(spark, filled):
    store.store_responses(spark.createDataFrame(rows(290, 320, "new"), KIND), filled, 1, buckets=8)
    assert read(store.stored_responses(spark, filled)) == want()


@pytest.mark.parametrize("listed", [1000, 2])
def test_lookup(spark, filled, monkeypatch, listed):
    monkeypatch.setattr(store, "LISTED", listed)
    names = ["e0005", "e0295", "e0317", "e9999", None, "e0005"]
    ids = spark.createDataFrame([(x, 1) for x in names], "evaluation_id string, bucket int")
    got = read(store.lookup_responses(ids, filled, buckets=8))
    assert got == {k: v for k, v in want().items() if k[0] in names}
    assert store.lookup_responses(ids.limit(0), filled, buckets=8).count() == 0


def test_lookup_prunes_folders_and_pushes_ids(spark, filled):
    ids = spark.createDataFrame([("e0005",)], "evaluation_id string")
    plan = store.lookup_responses(ids, filled, buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "evaluation_id" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_compaction_keeps_every_object_once(spark, filled):
    to = store.compact(spark, filled, buckets=8)
    assert read(store.stored_responses(spark, to)) == want()
    assert spark.read.parquet(to).count() == len(want())


def test_nulls(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "n")
    store.store_responses(spark.createDataFrame([(None, "A", "x"), ("e", "A", None)], "evaluation_id string, model string, response string"), path, 0)
    assert read(store.stored_responses(spark, path)) == {(None, "a"): ("x", None), ("e", "a"): (None, None)}
