"""Plan-shape checks: the properties the design relies on at scale."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from evalspark.operators import status as st
from evalspark.operators.overlap import bleu
from evalspark.operators.scoring import score_pairs
from evalspark.sources import views


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _hash_keys(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_ngram_metrics_shuffle_only_pair_texts(spark):
    plan = _plan(bleu(views.pairs_edit(spark, SF_SMALL)))
    keys = _hash_keys(plan)
    assert keys, plan
    assert all(k.split("#")[0] == "pair_id" for k in keys), keys  # never a shuffle keyed by gram / order
    assert "gram" not in " ".join(keys)


def test_all_text_metrics_share_the_pair_partitioning(spark):
    wide = score_pairs(views.pairs_edit(spark, SF_SMALL), "pair_id")
    keys = _hash_keys(_plan(wide))
    assert keys and all(k.split("#")[0] == "pair_id" for k in keys), keys


def test_rouge_l_spreads_pairs_before_the_udf(spark):
    from evalspark.operators.lcs import rouge_l

    plan = _plan(rouge_l(views.pairs_edit(spark, SF_SMALL)))
    keys = _hash_keys(plan)
    assert len(keys) == 1 and keys[0].split("#")[0] == "pair_id", keys  # one exchange of pair texts
    wide = _plan(score_pairs(views.pairs_edit(spark, SF_SMALL), "pair_id"))
    assert all(k.split("#")[0] == "pair_id" for k in _hash_keys(wide))  # no second exchange inside score_pairs


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(bleu(views.pairs_edit(spark, SF_SMALL)))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan) or re.findall(r"ReadSchema: ([^,\]]*>)", plan)
    for s in schemas:
        assert "source" not in s and "lang" not in s and "n_chars" not in s, s


def test_status_filter_reaches_parquet(spark, tmpdir_path):
    evals = views.evaluations(spark, SF_SMALL)
    path = f"{tmpdir_path}/evals"
    evals.write.parquet(path)
    plan = _plan(st.open_evaluations(spark.read.parquet(path)))
    assert "PushedFilters: [In(status" in plan or "PushedFilters: [IsNotNull(status), In(status" in plan, plan


def test_requests_join_form_equals_window_form(spark):
    a = sorted(tuple(r) for r in views.requests(spark, SF_SMALL).collect())
    b = sorted(tuple(r) for r in views.requests_windowed(spark, SF_SMALL).collect())
    assert a == b and len(a) > 0


def test_pair_partitions_grow_with_the_input(spark, monkeypatch):
    from evalspark.operators import overlap

    pairs = views.pairs_edit(spark, SF_SMALL)
    size = overlap.input_bytes(pairs)
    assert 0 < size < 1 << 30
    least = overlap.pair_partitions(pairs)
    monkeypatch.setattr(overlap, "BYTES_PER_PARTITION", max(1, size // (3 * least)))
    assert overlap.pair_partitions(pairs) >= 3 * least
    assert overlap.pair_partitions(pairs.unionByName(pairs)) >= 6 * least  # two scans, twice the bytes
    monkeypatch.setattr(overlap, "MAX_PARTITIONS", 2 * least)
    assert overlap.pair_partitions(pairs) == 2 * least


def test_requests_of_sparse_turns_lose_no_answer(spark, tmpdir_path):
    rows = [(1, 0, "user", "q"), (1, 4, "assistant", "a"), (1, 9, "user", "q2"), (2, 0, "user", "only")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmpdir_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.reference_answer, r.context) for r in views.requests(spark, tmpdir_path).collect()}
    assert got == {(1, 0): ("a", None), (1, 9): (None, "a"), (2, 0): (None, None)}


def test_a_checkpointed_join_does_not_raise_the_number_of_partitions(spark, tmpdir_path):
    from evalspark.operators import overlap
    from evalspark.session import materialize

    ids = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    for t in "abc":
        ids.write.parquet(f"{tmpdir_path}/{t}")
    a, b, c = (spark.read.parquet(f"{tmpdir_path}/{t}") for t in "abc")
    few = materialize(a.join(b, "id").join(c, "id"))  # Spark's estimate: the product of three tables
    pairs = few.select(F.col("id").alias("pair_id"), F.lit("x").alias("candidate"), F.lit("y").alias("reference"))
    assert overlap.pair_partitions(pairs) == overlap.PARTITIONS_PER_SHUFFLE_PARTITION * 4
