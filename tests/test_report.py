import os

import pytest
from pyspark.sql import functions as F

from evalspark.operators import report

DATA = os.path.join(os.path.dirname(__file__), "data", "report_sample.json")


@pytest.fixture(scope="module")
def long(spark):
    return report.coerce_scores(report.flatten_report(report.read_report(spark, DATA)))


def test_flatten_shape(long):
    assert long.count() == 40
    assert {r.model for r in long.select("model").distinct().collect()} == {"Perplexity", "Gemini", "OpenAI", "AWS Nova-Lite"}


def test_golden_overall_means(long):
    got = {r.model: r.overall_mean for r in report.overall_mean(report.filter_scores(long)).collect()}
    assert got["OpenAI"] == pytest.approx(0.68399, abs=1e-9)
    assert got["AWS Nova-Lite"] == pytest.approx(0.61586, abs=1e-9)
    assert got["Gemini"] == pytest.approx(0.5821, abs=1e-9)
    assert got["Perplexity"] == pytest.approx(0.5212, abs=1e-9)
    w = report.overall_winner(report.filter_scores(long)).collect()
    assert [r.model for r in w] == ["OpenAI"]
    assert "%.4f" % w[0].overall_mean == "0.6840"


def test_score_matrix_and_profile(long):
    metrics = [r.metric for r in report.distinct_metrics(long).collect()]
    assert metrics == sorted(metrics) and len(metrics) == 10
    mx = report.score_matrix(report.filter_scores(long), metrics).where(F.col("model") == "OpenAI").collect()[0]
    assert mx["BLEU"] == pytest.approx(0.4016)
    prof = report.winner_profile(report.filter_scores(long)).orderBy("point_no").collect()
    assert len(prof) == 11 and prof[0].metric == prof[-1].metric
    assert prof[0].axis_max == pytest.approx(max(1.0, 1.0 * 1.1))


def test_prompt_winner_single_prompt(long):
    w = report.prompt_winners(long).collect()
    assert [(r.sno, r.model) for r in w] == [(1, "OpenAI")]


def test_missing_report_is_empty(spark):
    assert report.read_report(spark, "/nonexistent/report.json").count() == 0


def test_report_edges(spark):
    rows = [
        (1, "p1", {"A": {"m1": "0.5", "m2": " 1.5 ", "generated_text": "hello"}, "B": {}}),
        (2, "p2", None),
        (3, "p3", {"A": {"m1": "abc", "m2": ""}, "B": {"m1": "NaN", "m2": None}}),
    ]
    df = spark.createDataFrame(rows, report.REPORT_SCHEMA)
    long = report.coerce_scores(report.flatten_report(df))
    got = {(r.sno, r.model, r.metric): r.score for r in long.collect()}
    assert got[(1, "A", "m1")] == 0.5 and got[(1, "A", "m2")] == 1.5
    assert got[(1, "A", "generated_text")] is None
    assert all(got[(3, m, k)] is None for m, k in [("A", "m1"), ("A", "m2"), ("B", "m1"), ("B", "m2")])
    assert not any(k[0] == 2 for k in got)  # entry without models: no rows
    f = report.filter_scores(long).collect()
    assert {(r.sno, r.metric) for r in f} == {(1, "m1"), (1, "m2")}


def test_winner_tie_and_empty(spark):
    df = spark.createDataFrame(
        [(1, "zeta", "m", 0.5), (1, "alpha", "m", 0.5), (1, "beta", "m", 0.2)], "sno long, model string, metric string, score double"
    )
    assert [r.model for r in report.overall_winner(df).collect()] == ["alpha"]
    assert [r.model for r in report.prompt_winners(df).collect()] == ["alpha"]
    assert report.overall_winner(df.where("false")).count() == 0


def test_winner_missing_metric_skipped(spark):
    df = spark.createDataFrame(
        [(1, "a", "m1", 0.9), (1, "a", "m2", None), (1, "b", "m1", 0.5), (1, "b", "m2", 0.6)],
        "sno long, model string, metric string, score double",
    )
    om = {r.model: r.overall_mean for r in report.overall_mean(report.filter_scores(df)).collect()}
    assert om["a"] == pytest.approx(0.9) and om["b"] == pytest.approx(0.55)


def test_labels(spark):
    same = "x" * 70
    prompts = spark.createDataFrame(
        [(1, same + "tail one"), (2, same + "tail two"), (3, "short"), (4, "é" * 69 + "ü" + "rest")], "sno long, prompt string"
    )
    lab = {r.sno: r.label for r in report.prompt_labels(prompts).collect()}
    assert lab[3] == "short..." and lab[1] == same + "..."
    assert lab[4] == "é" * 69 + "ü..."
    idx = {r.label: r.sno for r in report.label_index(prompts).collect()}
    assert idx[same + "..."] == 2


def test_positions(spark):
    df = spark.range(0, 1000, 7).select(F.col("id").alias("sno")).repartition(5)
    pos = {r.sno: r.position for r in report.prompt_positions(df).collect()}
    assert sorted(pos.values()) == list(range(len(pos)))
    assert all(pos[s] == s // 7 for s in pos)
    chosen = spark.createDataFrame([(14,), (15,)], "sno long")
    got = {r.sno: r.position for r in report.prompt_position(df, chosen).collect()}
    assert got == {14: 2, 15: 0}


def test_assemble_then_flatten_roundtrip(spark):
    s = spark.createDataFrame(
        [(1, "m1", "BLEU", 0.25), (1, "m1", "BLEU", 0.75), (1, "m2", "METEOR", 0.1), (2, "m1", "BLEU", 1.0)],
        "sno long, model string, metric string, score double",
    )
    p = spark.createDataFrame([(1, "one"), (2, "two")], "sno long, prompt string")
    back = report.coerce_scores(report.flatten_report(report.assemble_report(s, p)))
    got = {(r.sno, r.model, r.metric): r.score for r in back.collect()}
    assert got == {(1, "m1", "BLEU"): 0.5, (1, "m2", "METEOR"): 0.1, (2, "m1", "BLEU"): 1.0}


def test_positions_of_more_keys_than_the_range_sample_holds(spark):
    df = spark.range(0, 40_000, 1, 4).select((F.col("id") * 7919 % 40_009).alias("sno"), F.repeat(F.lit("x"), 200).alias("wide"))
    rows = report.global_position(df, "sno").select("sno", "position").orderBy("sno").collect()
    assert [r.position for r in rows] == list(range(40_000))


def test_lower_is_better_aliases_and_first_seen(spark):
    df = spark.createDataFrame(
        [(2, "p2", "b", "H", 0.9, 1), (1, "p1", "a", "H", 0.2, 2), (2, "p0", "a", "H", 0.2, 3)],
        "sno long, prompt string, model string, metric string, score double, place long",
    )
    assert report.overall_winner(df).collect()[0].model == "b"
    assert report.overall_winner(df, ["H"]).collect()[0].model == "a"
    assert {(r.sno, r.model) for r in report.prompt_winners(df, ["H"]).collect()} == {(1, "a"), (2, "a")}
    names = spark.createDataFrame([("a", "A one"), ("a", "A two"), ("x", "y")], "alias string, model string")
    assert sorted(r.model for r in report.with_aliases(df, names).collect()) == ["A one", "A one", "b"]
    first = {(r.model, r.first_sno, r.first_seen) for r in report.distinct_models(df, "place").collect()}
    assert first == {("b", 2, 1), ("a", 1, 2)}
    assert {(r.sno, r.prompt) for r in report.prompt_text(df, "place").collect()} == {(1, "p1"), (2, "p2")}
    assert {(r.sno, r.prompt) for r in report.prompt_text(df).collect()} == {(1, "p1"), (2, "p0")}


def test_broken_report_files_are_shown(spark, tmpdir_path):
    import os

    from evalspark.operators.report import broken_reports, read_report

    with open(os.path.join(tmpdir_path, "good.json"), "w") as f:
        f.write('[{"SNO": 1, "prompt": "p", "models": {"A": {"BLEU": "0.5"}}}]')
    with open(os.path.join(tmpdir_path, "bad.json"), "w") as f:
        f.write('[{"SNO": 2, "prompt"')
    assert [r.SNO for r in read_report(spark, tmpdir_path).collect()] == [1]
    shown = broken_reports(spark, tmpdir_path).collect()
    assert [os.path.basename(r.path) for r in shown] == ["bad.json"] and shown[0].text.startswith('[{"SNO": 2')
    assert broken_reports(spark, os.path.join(tmpdir_path, "none")).count() == 0
