"""The three entry flows as compositions of the operators.

1. ``intake``    request bodies → validated items, evaluation records, per-model work with prompts
2. ``respond``   work items → caller's model client → stored responses and status events
   ``complete``  evaluations + status events → status map, ready evaluations
   ``score``     ready evaluations + responses → final metric documents and state rows
3. ``dashboard`` result report → long scores, matrix, overall means, winner, per-prompt winners

Each returns DataFrames; materialise (``session.materialize``) where recomputation would change
results — after ``intake`` with random ids and after ``respond`` (model calls).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators import outcomes as oc
from evalspark.operators import report as rp
from evalspark.operators import requests as rq
from evalspark.operators import status as st
from evalspark.operators.invoke import invoke_models, response_events
from evalspark.operators.scoring import TEXT_METRICS, score_pairs, to_long


def intake(bodies: DataFrame, models: Column | None = None, keys=("batch_id",)) -> dict[str, DataFrame]:
    validated = rq.validate_requests(rq.parse_requests(bodies, "body", keys), models)
    evals = rq.initiate(rq.valid_requests(validated), keys)
    work = rq.fan_out(rq.with_prompt(evals)).select("evaluation_id", "model", "formatted_prompt")
    return {
        "validated": validated,
        "errors": rq.request_errors(validated, keys),
        "summary": rq.batch_summary(validated, keys),
        "evaluations": evals,
        "work": work,
    }


def respond(work: DataFrame, client_factory: Callable[[str], Callable[[str], str]]) -> dict[str, DataFrame]:
    results = invoke_models(work, client_factory)
    return {
        "results": results,
        "responses": results.where(F.col("status") == st.RECEIVED).select("evaluation_id", "model", "response", "prompt_sent"),
        "events": response_events(results),
    }


def complete(evals: DataFrame, events: DataFrame, count_failed: bool = True) -> dict[str, DataFrame]:
    withmap = st.status_map(evals, st.latest_status(events))
    return {"with_map": withmap, "ready": st.ready_evaluations(withmap, count_failed)}


def score(ready: DataFrame, withmap: DataFrame, responses: DataFrame, extra_scores: DataFrame | None = None) -> dict[str, DataFrame]:
    """Outcomes, scores and documents of the ready evaluations.  ``extra_scores``: long rows
    (evaluation_id, model, metric, score) of other metrics (judge, cosine) that go into the documents."""
    ev = withmap.join(ready.select("evaluation_id").distinct(), "evaluation_id")
    outcomes = oc.classify_outcomes(ev, responses)
    done = outcomes.where(F.col("outcome") == oc.COMPLETED).join(ev.select("evaluation_id", "reference_answer"), "evaluation_id")
    pairs = done.select(
        F.concat_ws("|", "evaluation_id", "model").alias("pair_id"),
        "evaluation_id",
        "model",
        F.col("response").alias("candidate"),
        F.col("reference_answer").alias("reference"),
    )
    long = to_long(score_pairs(pairs, ["pair_id", "evaluation_id", "model"]), ["evaluation_id", "model"], TEXT_METRICS)
    if extra_scores is not None:
        extra = extra_scores.join(ev.select("evaluation_id"), "evaluation_id", "left_semi")
        long = long.unionByName(extra.select("evaluation_id", "model", "metric", "score", F.lit(None).cast("string").alias("note")))
    docs = oc.to_final_metrics(outcomes, long.select("evaluation_id", "model", "metric", "score"), ev)
    return {"outcomes": outcomes, "scores": long, "documents": docs, "states": st.completion_rows(ready)}


def dashboard(report: DataFrame, models=None, metrics=None) -> dict[str, DataFrame]:
    long = rp.coerce_scores(rp.flatten_report(report))
    chosen = rp.filter_scores(long, models, metrics)
    metric_names = metrics if metrics is not None else None
    out = {
        "scores": long,
        "means": rp.mean_scores(chosen),
        "overall": rp.overall_mean(chosen),
        "winner": rp.overall_winner(chosen),
        "prompt_winners": rp.prompt_winners(chosen),
        "profile": rp.winner_profile(chosen),
    }
    if metric_names is not None:
        out["matrix"] = rp.score_matrix(chosen, metric_names)
    return out
