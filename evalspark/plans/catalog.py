"""Registered queries: name → (spark, sf_dir) → DataFrame.  Twins live in ``oracle.SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalspark.operators import overlap
from evalspark.operators.ledger import Transient
from evalspark.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


PAIR_KEYS = ["pair_id", "sno", "model"]


@register("rouge1")
def q_rouge1(spark, sf):
    return overlap.rouge_n(views.pairs(spark, sf), 1, key=PAIR_KEYS)


@register("rouge2")
def q_rouge2(spark, sf):
    return overlap.rouge_n(views.pairs_edit(spark, sf), 2, key=PAIR_KEYS)


@register("bleu")
def q_bleu(spark, sf):
    return overlap.bleu(views.pairs_edit(spark, sf), key=PAIR_KEYS)


@register("meteor_exact")
def q_meteor_exact(spark, sf):
    from evalspark.operators.meteor import meteor

    return meteor(views.pairs_edit(spark, sf), key=PAIR_KEYS)


@register("rouge_l")
def q_rouge_l(spark, sf):
    from evalspark.operators.lcs import rouge_l

    return rouge_l(views.pairs_edit(spark, sf), key=PAIR_KEYS)


@register("rouge_l_blocks")
def q_rouge_l_blocks(spark, sf):
    from evalspark.operators.lcs import rouge_l

    return rouge_l(views.pairs_edit(spark, sf), key=PAIR_KEYS, block_tokens=2048)


@register("tokenize")
def q_tokenize(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.functions.text import tokenize
    from evalspark.sources.tables import table

    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.size(tokenize("text", "ascii")).cast("long").alias("n_ascii"),
        F.size(tokenize("text", "word")).cast("long").alias("n_word"),
        F.array_join(tokenize("text", "word_lower"), " ").alias("words_lower"),
    )


@register("tokenize_treebank")
def q_tokenize_treebank(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.functions.text import tokenize
    from evalspark.functions.treebank import sentences

    p = views.pairs_quoted(spark, sf).where("model = 'm_swap'")
    words = tokenize("candidate", "treebank")
    return p.select(
        "pair_id", F.size(sentences("candidate")).cast("long").alias("n_sentences"), F.size(words).cast("long").alias("n_words"),
        F.array_join(words, " ").alias("words"),
    )


@register("bleu_treebank")
def q_bleu_treebank(spark, sf):
    return overlap.bleu(views.pairs_quoted(spark, sf), key=PAIR_KEYS, tokens="treebank")


@register("cosine")
def q_cosine(spark, sf):
    from evalspark.operators.vectors import cosine_scores

    return cosine_scores(views.vector_pairs(spark, sf), "embedding", "anchor_embedding", ["vec_id", "label", "anchor_id"])


# --- scores and the report family ---------------------------------------------------------------

def _r6(c):
    from pyspark.sql import functions as F

    return F.bround(c, 9)


def scores_long(spark, sf):
    """scores(sno, model, metric, score): ROUGE-1/2, BLEU, METEOR over pairs_edit."""
    from evalspark.operators.scoring import NATIVE_METRICS, score_pairs, to_long

    wide = score_pairs(views.pairs_edit(spark, sf), PAIR_KEYS, include_rouge_l=False)
    return to_long(wide, ["sno", "model"], NATIVE_METRICS).drop("note")


def flagship(spark, sf):
    """The overall winner under the text metrics of ``pairs_edit``."""
    from evalspark.operators import report

    w = report.overall_winner(report.filter_scores(scores_long(spark, sf)))
    return w.select("model", _r6("overall_mean").alias("overall_mean"))


@register("score_all")
def q_score_all(spark, sf):
    from evalspark.operators.scoring import score_all

    return score_all(views.pairs_edit(spark, sf), PAIR_KEYS, include_rouge_l=True)


@register("scores")
def q_scores(spark, sf):
    return scores_long(spark, sf)


def _unique_scores(spark, sf):
    """One row per (sno, model, metric): duplicates averaged, rounded so that a sum's order can't show."""
    from pyspark.sql import functions as F

    per = views.report_scores(spark, sf).groupBy("sno", "model", "metric")
    return per.agg(F.bround(F.avg("score"), 9).alias("score"))


def _report(spark, sf):
    from evalspark.operators import report

    return report.assemble_report(_unique_scores(spark, sf), views.prompts(spark, sf))


@register("assemble_report")
def q_assemble_report(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.functions.scalar import prompt_label

    rep = _report(spark, sf)
    n_scores = F.aggregate(F.map_values("models"), F.lit(0), lambda acc, m: acc + F.size(m))
    return rep.select("SNO", prompt_label("prompt").alias("label"), F.size("models").alias("n_models"), n_scores.alias("n_scores"))


@register("flatten_report")
def q_flatten_report(spark, sf):
    from evalspark.operators import report

    return report.coerce_scores(report.flatten_report(_report(spark, sf))).select("sno", "model", "metric", "score")


@register("read_report")
def q_read_report(spark, sf):
    from uuid import uuid4

    from evalspark.operators import report
    from evalspark.session import checkpoint_dir

    path = f"{checkpoint_dir(spark).rstrip('/')}/report-{uuid4().hex}"
    report.write_report(_report(spark, sf), path)
    return report.coerce_scores(report.flatten_report(report.read_report(spark, path, lines=True))).select("sno", "model", "metric", "score")


@register("resolve_label")
def q_resolve_label(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators import report

    prompts = views.prompts(spark, sf)
    chosen = report.prompt_labels(prompts.where(F.col("sno") % 3 == 0)).select("label").unionByName(
        prompts.where(F.col("sno") % 5 == 0).select(F.concat(F.lit("unknown "), F.col("sno").cast("string")).alias("label"))
    )
    return report.resolve_label(chosen, report.label_index(prompts)).select("label", "sno")


@register("coerce_score")
def q_coerce_score(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.functions.scalar import coerce_score
    from evalspark.sources.tables import table

    ev = table(spark, sf, "events")
    return ev.select(
        "event_id",
        coerce_score(F.get_json_object("props", "$.k")).alias("k_score"),
        coerce_score("props").alias("props_score"),
    )


@register("filter_scores")
def q_filter_scores(spark, sf):
    from evalspark.operators import report

    return report.filter_scores(views.report_scores(spark, sf), models=["click", "view", "error"], metrics=["BLEU", "METEOR"])


@register("prompt_scores")
def q_prompt_scores(spark, sf):
    from evalspark.operators import report

    return report.prompt_scores(views.report_scores(spark, sf), sno=7)


@register("mean_scores")
def q_mean_scores(spark, sf):
    from evalspark.operators import report

    m = report.mean_scores(report.filter_scores(views.report_scores(spark, sf), metrics=None))
    return m.select("model", "metric", _r6("mean_score").alias("mean_score"))


def _metrics():
    return views.REPORT_METRICS


@register("score_matrix")
def q_score_matrix(spark, sf):
    from evalspark.operators import report

    mx = report.score_matrix(report.filter_scores(views.report_scores(spark, sf)), _metrics())
    return mx.select("model", *[_r6(f"`{m}`").alias(m) for m in _metrics()])


@register("prompt_matrix")
def q_prompt_matrix(spark, sf):
    from evalspark.operators import report

    mx = report.prompt_matrix(views.report_scores(spark, sf), _metrics())
    return mx.select("sno", "model", *[_r6(f"`{m}`").alias(m) for m in _metrics()])


@register("overall_mean")
def q_overall_mean(spark, sf):
    from evalspark.operators import report

    om = report.overall_mean(report.filter_scores(views.report_scores(spark, sf)))
    return om.select("model", _r6("overall_mean").alias("overall_mean"))


@register("overall_winner")
def q_overall_winner(spark, sf):
    from evalspark.operators import report

    w = report.overall_winner(report.filter_scores(views.report_scores(spark, sf)))
    return w.select("model", _r6("overall_mean").alias("overall_mean"))


@register("prompt_winners")
def q_prompt_winners(spark, sf):
    from evalspark.operators import report

    w = report.prompt_winners(views.report_scores(spark, sf))
    return w.select("sno", "model", _r6("prompt_mean").alias("prompt_mean"))


@register("winner_profile")
def q_winner_profile(spark, sf):
    from evalspark.operators import report

    p = report.winner_profile(report.filter_scores(views.report_scores(spark, sf)))
    return p.select("model", "point_no", "metric", _r6("value").alias("value"), _r6("axis_max").alias("axis_max"))


@register("distinct_metrics")
def q_distinct_metrics(spark, sf):
    from evalspark.operators import report

    return report.distinct_metrics(views.report_scores(spark, sf))


@register("distinct_prompts")
def q_distinct_prompts(spark, sf):
    from evalspark.operators import report

    s = views.report_scores(spark, sf).select("sno").distinct().join(views.prompts(spark, sf), "sno")
    return report.distinct_prompts(s)


@register("prompt_labels")
def q_prompt_labels(spark, sf):
    from evalspark.operators import report

    return report.prompt_labels(views.prompts(spark, sf))


@register("label_index")
def q_label_index(spark, sf):
    from evalspark.operators import report

    return report.label_index(views.prompts(spark, sf)).select("label", "sno")


@register("prompt_text")
def q_prompt_text(spark, sf):
    from evalspark.operators import report

    s = views.report_scores(spark, sf).select("sno").distinct().join(views.prompts(spark, sf), "sno")
    return report.prompt_text(s)


@register("prompt_positions")
def q_prompt_positions(spark, sf):
    from evalspark.operators import report

    return report.prompt_positions(views.report_scores(spark, sf))


# --- requests family ------------------------------------------------------------------------------

def _validated(spark, sf):
    from evalspark.operators import requests as rq

    return rq.validate_requests(rq.parse_requests(views.request_bodies(spark, sf), "body", ["batch_id"]))


def _initiated(spark, sf):
    from evalspark.operators import requests as rq

    return rq.initiate(rq.valid_requests(_validated(spark, sf)), ["batch_id"])


@register("parse_requests")
def q_parse_requests(spark, sf):
    from evalspark.operators import requests as rq

    p = rq.parse_requests(views.request_bodies(spark, sf), "body", ["batch_id"])
    return p.select("batch_id", "item_index", "prompt", "reference_answer", "context")


@register("validate_requests")
def q_validate_requests(spark, sf):
    from pyspark.sql import functions as F

    return _validated(spark, sf).select("batch_id", "item_index", F.col("error").isNull().alias("is_valid"), "error")


@register("request_errors")
def q_request_errors(spark, sf):
    from evalspark.operators import requests as rq

    # an object is told by its error; other input is returned as it came
    from pyspark.sql import functions as F

    errors = rq.request_errors(_validated(spark, sf), ["batch_id"])
    return errors.withColumn("input", F.when(~F.col("input").startswith("{"), F.col("input")))


@register("initiate_evaluations")
def q_initiate(spark, sf):
    from pyspark.sql import functions as F

    e = _initiated(spark, sf)
    return e.select(
        "evaluation_id",
        "batch_id",
        "item_index",
        "status",
        F.array_join("requested_models", ",").alias("requested"),
        F.size(F.map_filter("responses_received", lambda k, v: v == "PENDING")).alias("n_pending"),
    )


@register("initiated_events")
def q_initiated_events(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators import requests as rq

    e = rq.initiated_events(_initiated(spark, sf))
    return e.withColumn("selected_llms", F.array_join("selected_llms", ","))


@register("model_list_errors")
def q_model_list_errors(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators import requests as rq

    # every other batch names no model
    models = F.when(F.length("batch_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m")))
    parsed = rq.parse_requests(views.request_bodies(spark, sf), "body", ["batch_id"])
    return rq.validate_requests(parsed, models).select("batch_id", "item_index", "error")


@register("fan_out")
def q_fan_out(spark, sf):
    from evalspark.operators import requests as rq

    return rq.fan_out(_initiated(spark, sf)).select("evaluation_id", "model")


@register("format_prompt")
def q_format_prompt(spark, sf):
    from evalspark.operators import requests as rq

    return rq.with_prompt(rq.valid_requests(_validated(spark, sf))).select("batch_id", "item_index", "formatted_prompt")


@register("response_key")
def q_response_key(spark, sf):
    from evalspark.operators import requests as rq

    return rq.with_response_key(rq.fan_out(_initiated(spark, sf))).select("evaluation_id", "model", "response_key")


@register("batch_summary")
def q_batch_summary(spark, sf):
    from evalspark.operators import requests as rq

    return rq.batch_summary(_validated(spark, sf), ["batch_id"])


@register("requested_only")
def q_requested_only(spark, sf):
    from evalspark.operators import requests as rq

    ev = views.status_events(spark, sf).select("evaluation_id", "model", "event_seq")
    return rq.requested_only(ev, views.evaluations(spark, sf))


@register("parse_model_list")
def q_parse_model_list(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.functions.scalar import parse_model_list
    from evalspark.sources.tables import table

    ev = table(spark, sf, "events")
    csv = F.concat(F.col("event_type"), F.lit(" ,\t"), F.upper("event_type"), F.lit(",, "), F.col("props"))
    lst = parse_model_list(csv)
    return ev.select("event_id", F.array_join(lst, "|").alias("models"), F.size(lst).alias("n_models"))


# --- status family --------------------------------------------------------------------------------

AS_OF = "2024-02-15 00:00:00"
TIMEOUT_SECONDS = 20 * 24 * 3600


def _withmap(spark, sf):
    from evalspark.operators import status as st

    evals = views.evaluations(spark, sf)
    return st.status_map(evals, st.latest_status(views.status_events(spark, sf)))


@register("parse_events")
def q_parse_events(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators import status as st

    p = st.parse_events(st.to_envelopes(views.status_events(spark, sf)))
    return p.select(
        "evaluation_id", "model", "detail_type", "status", "error",
        F.unix_micros("event_time").alias("event_us"), "event_seq",
    )


@register("latest_status")
def q_latest_status(spark, sf):
    from evalspark.operators import status as st

    return st.latest_status(views.status_events(spark, sf)).select("evaluation_id", "model", "status")


@register("status_map")
def q_status_map(spark, sf):
    from pyspark.sql import functions as F

    m = _withmap(spark, sf)
    entries = F.transform(F.map_entries("responses_received"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("evaluation_id", F.array_join(entries, ";").alias("entries"), F.size("responses_received").alias("n_entries"))


@register("open_evaluations")
def q_open_evaluations(spark, sf):
    from evalspark.operators import status as st

    return st.open_evaluations(views.evaluations(spark, sf)).select("evaluation_id", "status")


@register("received_count")
def q_received_count(spark, sf):
    from evalspark.operators import status as st

    return st.received_count(_withmap(spark, sf)).select("evaluation_id", "n_requested", "n_received")


@register("ready_evaluations")
def q_ready_evaluations(spark, sf):
    from evalspark.operators import status as st

    return st.ready_evaluations(_withmap(spark, sf)).select("evaluation_id", "new_status")


@register("evaluation_progress")
def q_evaluation_progress(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators import status as st

    return st.progress(_withmap(spark, sf)).select("evaluation_id", F.array_join("missing", ",").alias("missing"), "progress")


@register("timed_out")
def q_timed_out(spark, sf):
    from evalspark.operators import status as st

    # the reference's completion rule (only RECEIVED counts): evaluations with a failed model stay open
    return st.timed_out(_withmap(spark, sf), AS_OF, TIMEOUT_SECONDS, count_failed=False)


@register("lookup_evaluations")
def q_lookup_evaluations(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators import status as st
    from evalspark.sources.tables import table

    ids = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("evaluation_id")).distinct()
    return st.lookup(ids, views.evaluations(spark, sf)).select("evaluation_id", "found", "status")


@register("accepted_events")
def q_accepted_events(spark, sf):
    from evalspark.operators import status as st

    known = st.open_evaluations(views.evaluations(spark, sf))  # closed evaluations take no events
    return st.accepted_events(views.status_events(spark, sf), known).select("evaluation_id", "model", "event_seq")


@register("rejected_events")
def q_rejected_events(spark, sf):
    from evalspark.operators import status as st

    known = st.open_evaluations(views.evaluations(spark, sf))
    return st.rejected_events(views.status_events(spark, sf), known).select("evaluation_id", "model", "event_seq")


@register("evaluation_states")
def q_evaluation_states(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators import status as st

    wm = _withmap(spark, sf)
    ready = st.ready_evaluations(wm)
    t1, t2 = F.lit(AS_OF).cast("timestamp"), (F.lit(AS_OF).cast("timestamp") + F.expr("INTERVAL 1 HOUR"))
    rows = (
        wm.select("evaluation_id", "status", F.lit(None).cast("string").alias("final_key"), F.col("created_at").alias("state_time"))
        .unionByName(ready.select("evaluation_id", F.col("new_status").alias("status"), F.lit(None).cast("string").alias("final_key"), t1.alias("state_time")))
        .unionByName(st.completion_rows(ready).select("evaluation_id", "status", "final_key", t2.alias("state_time")))
    )
    return st.current_state(rows)


@register("drop_redelivered")
def q_drop_redelivered(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.streaming.routing import drop_redelivered

    d = drop_redelivered(views.deliveries(spark, sf), "1 hour")
    return d.select("evaluation_id", "model", "event_seq", F.unix_micros(F.col("event_time").cast("timestamp")).alias("event_us"))


@register("route_events")
def q_route_events(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.streaming.routing import route_events

    ev = views.status_events(spark, sf).withColumn("event_time", F.col("event_time").cast("timestamp"))
    known = views.evaluations(spark, sf).where(F.pmod(F.col("evaluation_id").cast("long"), F.lit(3)) != 0)
    r = route_events(ev, known, wait="0 seconds", before="20 days")
    return r.select("evaluation_id", "model", "event_seq", "route")


# --- outcomes and judge -----------------------------------------------------------------------------

@register("classify_outcomes")
def q_classify_outcomes(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators.outcomes import classify_outcomes

    o = classify_outcomes(_withmap(spark, sf), views.responses(spark, sf))
    return o.select("evaluation_id", "model", "outcome", F.col("response").isNotNull().alias("has_response"))


@register("response_store")
def q_response_store(spark, sf):
    from uuid import uuid4

    from pyspark.sql import functions as F

    from evalspark.session import checkpoint_dir
    from evalspark.sources.store import lookup_responses, store_responses

    path = f"{checkpoint_dir(spark).rstrip('/')}/responses-{uuid4().hex}"
    docs = views.prompts(spark, sf).select(F.concat(F.lit("doc-"), F.col("sno").cast("string")).alias("evaluation_id"), F.col("prompt").alias("response"))
    first = docs.withColumn("model", F.when(F.length("response") % 2 == 0, "Model One").otherwise("two"))
    again = first.where(F.length("response") % 5 == 0).withColumn("response", F.reverse("response"))
    store_responses(first, path, 0)
    store_responses(again, path, 1)
    found = lookup_responses(first.where(F.length("response") % 3 != 0), path)
    return found.select("evaluation_id", "model_key", F.sha2("response", 256).alias("response_sha256"), "batch_id")


@register("final_metrics_doc")
def q_final_metrics_doc(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators.outcomes import COMPLETED, flatten_final_metrics, to_final_metrics

    sc = _unique_scores(spark, sf).withColumn("evaluation_id", F.col("sno").cast("string"))
    outcomes = sc.select("evaluation_id", "model").distinct().select(
        "evaluation_id", "model", F.lit(COMPLETED).alias("outcome"), F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("string").alias("response"),
    )
    doc = to_final_metrics(outcomes, sc.select("evaluation_id", "model", "metric", "score"))
    return flatten_final_metrics(doc)


def _scored(spark, sf):
    """(path, batch): the ready evaluations of ``views`` and some without a record, scored and recorded once and replayed."""
    from uuid import uuid4

    from pyspark.sql import functions as F

    from evalspark.operators import status as st
    from evalspark.operators.completion import complete_batch
    from evalspark.session import checkpoint_dir
    from evalspark.sources.tables import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("evaluation_id"), F.col("text").alias("reference_answer"))
    prompt = F.concat(F.lit("question "), F.col("evaluation_id")).alias("prompt")
    wm = _withmap(spark, sf).join(docs, "evaluation_id", "left").select("*", prompt, F.element_at("requested_models", -1).alias("context"))
    lost = table(spark, sf, "conversations").where("turn = 0").select(F.concat(F.lit("lost-"), F.col("conv_id").cast("string")).alias("evaluation_id"))
    ready = st.ready_evaluations(wm).select("evaluation_id").unionByName(lost)
    path = f"{checkpoint_dir(spark).rstrip('/')}/final-{uuid4().hex}"
    for _ in range(2):
        complete_batch(ready, wm, views.responses(spark, sf), path, 0)
    return path


@register("completion_ledger")
def q_completion_ledger(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators.completion import open_documents, read_ledger, read_states

    path = _scored(spark, sf)
    states = read_states(spark, path)
    opened = open_documents(states, path).select("final_key", F.col("evaluation_id").alias("opens"))
    entry = read_ledger(spark, path).select("batch_id", "n_ready", "n_completed", "n_failed")
    rows = states.join(opened, "final_key", "left").join(entry, "batch_id")
    return rows.select("evaluation_id", "status", "final_key", "n_models", "n_scored", "error_message", "opens", "n_ready", "n_completed", "n_failed")


@register("final_documents")
def q_final_documents(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators.completion import open_documents, read_states

    path = _scored(spark, sf)
    docs = open_documents(read_states(spark, path), path)
    e = docs.select("evaluation_id", "prompt", "reference_answer", "context", F.explode("model_comparisons").alias("model", "r"))
    return e.select(
        "evaluation_id", "model", "prompt", F.length("reference_answer").alias("reference_chars"), "context", F.col("r.status").alias("status"),
        F.length("r.llm_response").alias("response_chars"), "r.error", "r.message",
        F.try_element_at("r.metrics", F.lit("ROUGE-1_F1")).alias("rouge1"), F.coalesce(F.size("r.metrics"), F.lit(0)).alias("n_metrics"),
    )


class CountingClient:
    """A client without a model: the answer names model and prompt length.  Prompts whose length is a multiple of 3 fail
    at the first attempt, those of 7 always, those of 11 for good."""

    def __init__(self, model: str):
        self.model, self.seen = model, {}

    def __call__(self, prompt: str) -> str:
        n = len(prompt)
        self.seen[prompt] = tries = self.seen.get(prompt, 0) + 1
        if n % 11 == 0:
            raise ValueError("refused")
        if n % 7 == 0 or (n % 3 == 0 and tries == 1):
            raise Transient("busy")
        return f"{self.model} {n}"


@register("call_ledger")
def q_call_ledger(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators import requests as rq
    from evalspark.operators.ledger import Policy, ledger_events, own_ledger, read_ledger, run_calls

    work = rq.fan_out(_initiated(spark, sf)).select("evaluation_id", "model", F.col("prompt").alias("formatted_prompt"))
    path, policy = own_ledger(spark), Policy(parallel=1, attempts=3, first_wait=0.0)
    # some first, then all of it, then all again: every call is made once
    run_calls(work.where(F.pmod(F.length("formatted_prompt"), F.lit(2)) == 0), path, CountingClient, policy)
    run_calls(work, path, CountingClient, policy)
    calls = run_calls(work, path, CountingClient, policy)
    times = read_ledger(spark, path).groupBy("call_id").agg(F.count("*").alias("n_calls"))
    ev = ledger_events(calls).select("evaluation_id", "model", "detail_type", "response_key", "event_seq")
    rows = calls.join(times, "call_id").join(ev, ["evaluation_id", "model"])
    return rows.select(
        "call_id", "evaluation_id", "model", rows.status, "response", rows.error, "attempts", "n_calls", "detail_type", "response_key", "event_seq"
    )


@register("verdict_ratio")
def q_verdict_ratio(spark, sf):
    from evalspark.operators.judge import verdict_ratio

    v = verdict_ratio(views.verdicts(spark, sf))
    return v.select("evaluation_id", "model", "criterion", _r6("score").alias("score"), "n_verdicts")


def lexical_judge(criterion: str, text: str, units: list[str], against: str | None) -> list:
    """A judge without a model: a unit is supported if at least half of its different words occur in the other
    text (for hallucination, the other way round, and a true verdict says that it is not); coherence is ten times the share
    of different words.  Without words there is no verdict."""
    import re

    def words(t):
        return set(re.findall("[a-z0-9]+", (t or "").lower()))

    out, opposite = [], words(against)
    for u in units:
        if criterion == "coherence":
            n = len(re.findall("[a-z0-9]+", u.lower()))
            out.append(10 * len(words(u)) / n if n else None)
        else:
            own, other = (opposite, words(u)) if criterion == "hallucination" else (words(u), opposite)
            held = 2 * len(own & other) >= len(own)
            out.append((held != (criterion == "hallucination")) if own else None)
    return out


@register("judge_scores")
def q_judge_scores(spark, sf):
    from evalspark.operators.judging import judge_cases

    s = judge_cases(views.judge_cases(spark, sf), lexical_judge)
    return s.withColumns({"score": _r6("score"), "n_verdicts": s.n_verdicts.cast("long"), "passed": s.passed.cast("int")})


@register("rubric_score")
def q_rubric_score(spark, sf):
    from pyspark.sql import functions as F

    from evalspark.operators.judge import rubric_score
    from evalspark.sources.tables import table

    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    ratings = lab.select(
        F.col("lang").alias("evaluation_id"), F.col("source").alias("model"), F.lit("coherence").alias("criterion"),
        (F.col("quality") * 2 + (1 - F.col("toxic"))).alias("rating"),
    )
    r = rubric_score(ratings, 3)
    return r.select("evaluation_id", "model", "criterion", _r6("score").alias("score"))


@register("metric_pass")
def q_metric_pass(spark, sf):
    from evalspark.operators.judge import thresholds_table, verdict_ratio, with_pass

    v = verdict_ratio(views.verdicts(spark, sf))
    p = with_pass(v, thresholds_table(spark))
    return p.select("evaluation_id", "model", "criterion", _r6("score").alias("score"), "passed")


@register("label_rate")
def q_label_rate(spark, sf):
    from evalspark.operators.judge import label_rate
    from evalspark.sources.tables import table

    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    r = label_rate(lab.withColumnRenamed("source", "model"), "toxic")
    return r.select("model", _r6("rate").alias("rate"), "n_units")


@register("meteor")
def q_meteor(spark, sf):
    from evalspark.operators.meteor import meteor

    return meteor(views.pairs_edit(spark, sf), key=PAIR_KEYS, stem=True)


@register("distinct_models")
def q_distinct_models(spark, sf):
    from evalspark.operators import report

    return report.distinct_models(views.report_scores(spark, sf, with_place=True), "place")


@register("display_metrics")
def q_display_metrics(spark, sf):
    from evalspark.operators import report

    return report.display_metrics(views.report_scores(spark, sf))
