"""Judge criteria end to end: units, calls, failures, ratios."""

import pytest

from evalspark.operators import judging
from evalspark.operators.judging import CRITERIA, criterion_scores, judge_cases, judge_units, unit_requests

CASES = "evaluation_id string, model string, prompt string, response string, reference_answer string, context string, criterion_x int"
ROWS = [
    ("e1", "m1", "What is red?", "Roses are red. Grass is green. Red it is!", "Roses are red. Blood is red.", "Roses are red. The sky is blue.", 1),
    ("e1", "m2", "What is red?", None, "Roses are red.", "Roses are red.", 1),
    ("e2", "m1", "What is red?", "Roses.", None, None, 1),
    ("e3", "m1", None, "   ", "", " \n", 1),
    ("e4", "m1", "Boom?", "Boom. Bang.", "A.", "C.", 1),
]


@pytest.fixture(scope="module")
def contains_judge():
    def judge(name, text, units, against):
        """True for units that say red; fails on Boom; a rubric gives 8."""
        if any("Boom" in u for u in units) and name == "answer_relevancy":
            raise RuntimeError("no answer today")
        if any("Boom" in u for u in units) and name == "faithfulness":
            return [True]
        if name == "coherence":
            return [8]
        return [None if "sky" in u else "red" in u.lower() for u in units]

    return judge


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(ROWS, CASES)


def test_units_are_sentences_or_whole_texts(spark, cases):
    rows = {(r.evaluation_id, r.model, r.criterion): r for r in unit_requests(cases).collect()}
    assert len(rows) == len(ROWS) * len(CRITERIA)
    assert rows["e1", "m1", "faithfulness"].units == ["Roses are red.", "Grass is green.", "Red it is!"]
    assert rows["e1", "m1", "hallucination"].units == ["Roses are red. The sky is blue."]
    assert rows["e1", "m1", "contextual_relevancy"].units == ["Roses are red.", "The sky is blue."]
    assert rows["e1", "m1", "contextual_recall"].units == ["Roses are red.", "Blood is red."]
    assert rows["e1", "m1", "contextual_recall"].against == "Roses are red. The sky is blue."
    assert rows["e1", "m2", "answer_relevancy"].note == judging.NO_UNITS and rows["e1", "m2", "hallucination"].note == judging.NO_OTHER
    assert rows["e2", "m1", "faithfulness"].note == judging.NO_OTHER and rows["e3", "m1", "coherence"].note == judging.NO_UNITS


def test_scores_are_ratios(spark, cases, contains_judge):
    got = {(r.evaluation_id, r.model, r.criterion): r for r in judge_cases(cases, contains_judge).collect()}
    assert len(got) == len(ROWS) * len(CRITERIA)
    r = got["e1", "m1", "faithfulness"]
    assert r.score == pytest.approx(2 / 3) and (r.n_units, r.n_verdicts, r.passed, r.note) == (3, 3, True, None)
    r = got["e1", "m1", "contextual_relevancy"]  # one null verdict is left out
    assert r.score == 1.0 and (r.n_units, r.n_verdicts, r.passed) == (2, 1, True)
    r = got["e1", "m1", "hallucination"]
    assert r.score is None and r.note == judging.NO_VERDICT and r.passed is None
    assert got["e1", "m1", "coherence"].score == pytest.approx(0.8) and got["e1", "m1", "coherence"].passed is None
    assert got["e3", "m1", "coherence"].note == judging.NO_UNITS and got["e3", "m1", "coherence"].score is None


def test_a_failing_call_costs_one_request(spark, cases, contains_judge):
    got = {r.criterion: r for r in judge_cases(cases.where("evaluation_id = 'e4'"), contains_judge).collect()}
    assert got["answer_relevancy"].note == "judge error: no answer today" and got["answer_relevancy"].score is None
    assert got["faithfulness"].note == "judge error: 1 answers for 2 units"
    assert got["contextual_recall"].score == 0.0 and got["contextual_recall"].passed is False


def test_each_request_is_sent_once(spark, cases, tmp_path):
    log = str(tmp_path / "calls")

    def noted(name, text, units, against):
        with open(log, "a") as f:
            f.write(f"{name}|{units[0]}|{against}\n")
        return [8.0 if name == "coherence" else True] * len(units)

    judge_cases(cases, noted).collect()
    calls = open(log).read().splitlines()
    sent = unit_requests(cases).where("note IS NULL").count()
    assert len(calls) == sent


def test_own_criterion_and_empty_table(spark, cases):
    own = (judging.Criterion("tone", "polite", "response", whole=True, max_rating=5.0), judging.Criterion("on_topic", "t", "response", "prompt"))
    judge = lambda name, text, units, against: [4] if name == "tone" else [True for _ in units]
    got = {(r.evaluation_id, r.model, r.criterion): r.score for r in judge_cases(cases, judge, own).collect()}
    assert got["e1", "m1", "tone"] == pytest.approx(0.8) and got["e1", "m1", "on_topic"] == 1.0
    none = cases.limit(0)
    req = unit_requests(none)
    assert criterion_scores(req, judge_units(req, judge)).count() == 0
