"""Judge criteria end to end (M7-M12 with K2, K3): cases → numbered units → verdicts → scores.

A criterion names the text that is taken apart into units and the text they are held against.  Each (case, criterion) is
one request that carries its units as an array, so the other text is sent once and a judge model is called once;
the answers come back as one row per unit, and the scores are ratios over those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.treebank import sentences
from evalspark.operators.judge import rubric_score, thresholds_table, verdict_ratio, with_pass


@dataclass(frozen=True)
class Criterion:
    """``units_of``: the column whose sentences (``whole``: whose text as it is) are judged, each against column
    ``against``.  A rubric asks for a rating from 0 to ``max_rating`` instead of a verdict and needs no other text."""

    name: str
    text: str
    units_of: str
    against: str | None = None
    whole: bool = False
    max_rating: float | None = None


# The criteria of the evaluation and what each of them looks at.
CRITERIA = (
    Criterion("coherence", "the collective quality of all sentences in the answer", "response", whole=True, max_rating=10.0),
    Criterion("hallucination", "the answer contradicts this context", "context", "response", whole=True),
    Criterion("answer_relevancy", "this statement of the answer is relevant to the prompt", "response", "prompt"),
    Criterion("faithfulness", "this claim of the answer is supported by the context", "response", "context"),
    Criterion("contextual_relevancy", "this statement of the context is relevant to the prompt", "context", "prompt"),
    Criterion("contextual_recall", "this sentence of the expected answer is found in the context", "reference_answer", "context"),
)

KEYS = ("evaluation_id", "model")
#: Why a (case, criterion) has no score.
NO_UNITS, NO_OTHER, NO_VERDICT = "nothing to judge", "nothing to judge against", "no verdict"
ANSWERS = "unit_no int, verdict boolean, rating double, note string"


def _visible(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[^\x00-\x20]")


def unit_requests(cases: DataFrame, criteria: Sequence[Criterion] = CRITERIA, keys: Sequence[str] = KEYS) -> DataFrame:
    """One request per (case, criterion): keys, criterion, criteria_text, units array<string>, against, note.

    ``cases`` has the keys and the columns the criteria name.  Every text is split into sentences once, by
    built-in expressions, however many criteria use them.  A request that cannot be judged has a note: its units or its other text are missing or blank.
    """
    entries = []
    split = {c.units_of: f"_units_{i}" for i, c in enumerate(criteria) if not c.whole}
    cases = cases.select("*", *[sentences(column).alias(name) for column, name in split.items()])
    for c in criteria:
        own = F.col(c.units_of)
        units = F.when(_visible(own), F.array(own)).otherwise(F.array().cast("array<string>")) if c.whole else F.col(split[c.units_of])
        other = F.col(c.against) if c.against else F.lit(None).cast("string")
        entries.append(
            F.struct(F.lit(c.name).alias("criterion"), F.lit(c.text).alias("criteria_text"), units.alias("units"), other.alias("against"),
                     F.lit(c.against is not None).alias("paired"))
        )
    rows = cases.select(*keys, F.inline(F.array(*entries)))
    note = F.when(F.size("units") == 0, NO_UNITS).when(F.col("paired") & ~_visible(F.col("against")), NO_OTHER)
    return rows.withColumn("note", note).drop("paired")


def judge_units(
    requests: DataFrame, judge_fn: Callable[[str, str, list[str], str | None], list], criteria: Sequence[Criterion] = CRITERIA,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Answers of a caller-supplied judge: keys, criterion, unit_no (from 1), verdict, rating, note.

    ``judge_fn(criterion, criteria_text, units, against)`` returns one answer per unit: True, False or None, for a rubric a
    number or None.  An exception, or a wrong number of answers, makes null answers with a note for that request alone.  Requests
    with a note are not sent and have no rows here.  Materialise the result before it is used twice, so that no call is repeated.
    """
    rated = {c.name for c in criteria if c.max_rating is not None}
    names = [*keys, "criterion", "unit_no", "verdict", "rating", "note"]

    def answers(name: str, text: str, units: list[str], against: str | None) -> list[tuple]:
        try:
            got = list(judge_fn(name, text, units, against))
            if len(got) != len(units):
                raise ValueError(f"{len(got)} answers for {len(units)} units")
        except Exception as exc:  # the caller's function may raise anything; the failure is data
            return [(k + 1, None, None, f"judge error: {exc}") for k in range(len(units))]
        if name in rated:
            return [(k + 1, None, None if x is None else float(x), None) for k, x in enumerate(got)]
        return [(k + 1, None if x is None else bool(x), None, None) for k, x in enumerate(got)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                d = row._asdict()
                for a in answers(d["criterion"], d["criteria_text"], list(d["units"]), d["against"]):
                    out.append((*(d[k] for k in keys), d["criterion"], *a))
            yield pd.DataFrame(out, columns=names).astype({"verdict": "object", "rating": "float64"})

    kinds = ", ".join(f"`{k}` {requests.schema[k].dataType.simpleString()}" for k in keys)
    sent = requests.where(F.col("note").isNull()).drop("note")
    return sent.mapInPandas(run, f"{kinds}, criterion string, {ANSWERS}")


def criterion_scores(requests: DataFrame, answers: DataFrame, criteria: Sequence[Criterion] = CRITERIA, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per request: keys, criterion, score, n_units, n_verdicts, passed, note.

    Score is the share of true verdicts, for a rubric mean rating / highest rating; null verdicts are left out.  For
    ``hallucination`` a true verdict is a contradiction, so lower is better.  ``passed`` by the criterion's threshold (a rubric
    has none).  Without any verdict the score is null and the note says why.
    """
    by = [*keys, "criterion"]
    rated = {c.name: c.max_rating for c in criteria if c.max_rating is not None}
    ratios = verdict_ratio(answers.where(~F.col("criterion").isin(*rated)), by)
    parts = [ratios]
    for name, most in rated.items():
        own = answers.where(F.col("criterion") == name)
        counts = own.groupBy(*by).agg(F.count("rating").alias("n_verdicts"))
        parts.append(rubric_score(own, most, by).join(counts, by).select(*ratios.columns))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    trouble = answers.where(F.col("note").isNotNull()).groupBy(*by).agg(F.min("note").alias("trouble"))
    asked = requests.select(*by, F.size("units").alias("n_units"), "note")
    j = asked.join(scores, by, "left").join(trouble, by, "left")
    note = F.coalesce("note", F.when(F.col("score").isNull(), F.coalesce("trouble", F.lit(NO_VERDICT))))
    j = j.withColumn("note", note).drop("trouble").withColumn("n_verdicts", F.coalesce("n_verdicts", F.lit(0)))
    passed = with_pass(j, thresholds_table(requests.sparkSession))
    return passed.select(*by, "score", "n_units", "n_verdicts", "passed", "note")


def judge_cases(cases: DataFrame, judge_fn: Callable, criteria: Sequence[Criterion] = CRITERIA, keys: Sequence[str] = KEYS) -> DataFrame:
    """``criterion_scores`` of ``cases``; the judge's answers are kept in the shared folder, so each request is sent once."""
    from evalspark.session import materialize

    requests = unit_requests(cases, criteria, keys)
    return criterion_scores(requests, materialize(judge_units(requests, judge_fn, criteria, keys)), criteria, keys)
