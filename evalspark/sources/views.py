"""Views derived from the driver tables; each has a twin in ``evalspark.plans.oracle``.

pairs          documents vs benchmark items: sno = doc_id mod (number of items), 5 models per item
pairs_edit     each whole document (word tokens) is the reference; three deterministic edits of it
               are the candidates of models ``m_drop2``, ``m_drop7`` and ``m_swap``
pairs_quoted   each whole document with quotes, brackets, contractions and dashes put in by place; the same
               three edits, on words between blanks
report_scores  events as score rows of a result report: prompt = user, model = event type, ten metrics and
               ``generated_text``; with null scores, ties, duplicates and a metric that one model lacks
prompts        (sno, prompt) for ``pairs_edit``: the document text
requests       user turns of conversations with the next assistant turn as reference answer and the
               previous assistant turn as context
status_events  events as model-response events of evaluation = user, model = event type
deliveries     status_events, some of them again after minutes or hours
evaluations    one per user: requested models (3-5 event types), status by user
responses      response objects: the document whose id is the latest received event of (user, type)
verdicts       labels as judge verdicts (quality → faithfulness, toxic → toxicity); evaluation = lang,
               model = source
judge_cases    requests with three answers each: the reference answer without every seventh word, the prompt
               itself, and the context's second half with the reference answer's first half
vector_pairs   each embedding against the lowest-id embedding of its label
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions.text import tokenize
from evalspark.sources.tables import table

N_PAIR_MODELS = 5
# The ten metric names of a result report.
REPORT_METRICS = [
    "ROUGE-1_F1", "ROUGE-2_F1", "ROUGE-L_F1", "BLEU", "METEOR", "Cosine_Similarity_Score",
    "Coherence_Score", "Hallucination_Score", "Relevance_Score", "Faithfulness_Score",
]
# The event types, in the order used to build requested-model lists.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# Bad request bodies by the name of their batch.
BAD_BODIES = {"items": '[17, "text"]', "broken": '[{"prompt": "no end"'}
STATUS_BY_USER = ["INITIATED", "PROCESSING", "COMPLETED", "FAILED"]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("reference"))
    n_items = bench.select(F.count("*")).scalar()
    keyed = docs.select(
        F.col("doc_id").alias("pair_id"),
        F.pmod(F.col("doc_id"), n_items).alias("sno"),
        F.concat(F.lit("m"), F.pmod(F.floor(F.col("doc_id") / n_items), F.lit(N_PAIR_MODELS)).cast("string")).alias("model"),
        F.col("text").alias("candidate"),
    )
    return keyed.join(bench, keyed.sno == bench.item_id).select("pair_id", "sno", "model", "candidate", "reference")


def edit_candidates(tokens):
    """(model, candidate tokens) structs for the three edits of a reference token array."""
    drop2 = F.filter(tokens, lambda x, i: (i + 1) % 2 != 0)
    drop7 = F.filter(tokens, lambda x, i: (i + 1) % 7 != 0)
    swap = F.when(F.size(tokens) > 10, F.concat(F.slice(tokens, 11, F.size(tokens)), F.slice(tokens, 1, 10))).otherwise(tokens)
    return F.array(
        F.struct(F.lit("m_drop2").alias("model"), drop2.alias("toks")),
        F.struct(F.lit("m_drop7").alias("model"), drop7.alias("toks")),
        F.struct(F.lit("m_swap").alias("model"), swap.alias("toks")),
    )


def pairs_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokenize("text", "word").alias("r"))
    return docs.select("doc_id", "r", F.explode(edit_candidates(F.col("r"))).alias("e")).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("e.model")).alias("pair_id"),
        F.col("doc_id").alias("sno"),
        F.col("e.model").alias("model"),
        F.array_join("e.toks", " ").alias("candidate"),
        F.array_join("r", " ").alias("reference"),
    )


#: Fixed values: (period, place, before, after): what ``pairs_quoted`` puts around every so manyeth word of a text.
MARKS = [(9, 2, '"', ""), (9, 6, "", '"'), (14, 5, "'", "'"), (11, 4, "", "'s"), (13, 7, "can't ", ""), (17, 3, "(", ")"),
         (19, 9, "", " --"), (23, 11, "Dr. ", ""), (29, 8, "we'll ", "..."), (31, 12, "cannot ", "?"), (37, 13, "", "; gonna")]


def pairs_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    def marked(x, i):
        for period, place, before, after in MARKS:
            x = F.when((i + 1) % period == place, F.concat(F.lit(before), x, F.lit(after))).otherwise(x)
        return x

    raw = F.array_remove(F.split("text", " "), "")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(raw, marked).alias("r"))
    return docs.select("doc_id", "r", F.explode(edit_candidates(F.col("r"))).alias("e")).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("e.model")).alias("pair_id"),
        F.col("doc_id").alias("sno"),
        F.col("e.model").alias("model"),
        F.array_join("e.toks", " ").alias("candidate"),
        F.array_join("r", " ").alias("reference"),
    )


def report_scores(spark: SparkSession, sf_dir: str, with_place: bool = False) -> DataFrame:
    """(sno, model, metric, score[, place]): a report's long scores, one per event, without scoring any
    text; ``place`` (the event's id) is the row's place in the report."""
    ev = table(spark, sf_dir, "events")
    names = [*REPORT_METRICS, "generated_text"]
    at = F.pmod(F.col("event_id"), F.lit(len(names)))
    metric = F.element_at(F.array(*[F.lit(m) for m in names]), (at + 1).cast("int"))
    missing = (at == len(names) - 1) | (F.pmod(F.col("event_id"), F.lit(13)) == 0)
    score = F.when(~missing, F.pmod(F.col("event_id") * 37, F.lit(101)) / F.lit(100.0))
    uneven = (F.col("event_type") == "signup") & (at == 3)
    return ev.where(~uneven).select(
        F.col("user_id").alias("sno"), F.col("event_type").alias("model"), metric.alias("metric"), score.cast("double").alias("score"),
        *([F.col("event_id").alias("place")] if with_place else []),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sno"), F.col("text").alias("prompt"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the next / previous assistant turn, as equi-joins on (conv_id, turn ± 1).

    This holds where each conversation's turns are numbered without gaps or repeats, so that ``turn + 1``
    is the next turn; a small job checks it (one row per conversation) and other tables go through
    ``requests_windowed``.  The join keys include the turn, so a conversation holding a third of all
    turns is spread over many partitions (a per-conversation window would sort it in one task).
    """
    conv = table(spark, sf_dir, "conversations")
    turns = conv.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.count_distinct("turn").alias("d"), (F.max("turn") - F.min("turn") + 1).alias("span")
    )
    if not turns.where((F.col("n") != F.col("d")) | ~F.col("span").eqNullSafe(F.col("d"))).isEmpty():
        return requests_windowed(spark, sf_dir)
    users = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    assistant = conv.where(F.col("role") == "assistant")
    nxt = assistant.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference_answer"))
    prv = assistant.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    j = users.join(nxt, ["conv_id", "turn"], "left").join(prv, ["conv_id", "turn"], "left")
    return j.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("evaluation_id"),
        "conv_id",
        "turn",
        "prompt",
        "reference_answer",
        "context",
    )


def requests_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``requests`` with ``lead``/``lag`` per conversation (any turn numbering; one task per conversation)."""
    conv = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = conv.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.lead("role").over(w).alias("next_role"),
        F.lead("text").over(w).alias("next_text"),
        F.lag("role").over(w).alias("prev_role"),
        F.lag("text").over(w).alias("prev_text"),
    )
    return t.where(F.col("role") == "user").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("evaluation_id"),
        "conv_id",
        "turn",
        F.col("text").alias("prompt"),
        F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("reference_answer"),
        F.when(F.col("prev_role") == "assistant", F.col("prev_text")).alias("context"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    failed = F.pmod(F.col("event_id"), F.lit(10)) == 0
    return ev.select(
        F.col("user_id").cast("string").alias("evaluation_id"),
        F.col("event_type").alias("model"),
        F.when(failed, F.lit("LLMResponseFailed")).otherwise(F.lit("LLMResponseReceived")).alias("detail_type"),
        F.when(failed, F.lit(None).cast("string")).otherwise(F.lit("RECEIVED")).alias("status"),
        F.when(failed, F.concat(F.lit("error "), F.col("props"))).alias("error"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("event_seq"),
    )


#: Fixed values: (every so manyeth event, minutes later): the re-deliveries of ``deliveries``.
AGAIN = [(2, 10), (3, 50), (4, 70), (5, 100), (6, 125), (7, 3000)]


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = status_events(spark, sf_dir)
    later = F.array(F.lit(0), *[F.when(F.pmod(F.col("event_seq"), F.lit(k)) == 0, F.lit(m)) for k, m in AGAIN])
    all_of = ev.select("*", F.explode(F.array_compact(later)).alias("after"))
    at = F.timestamp_micros(F.unix_micros(F.col("event_time").cast("timestamp")) + F.col("after").cast("long") * 60_000_000)
    return all_of.withColumn("event_time", at).drop("after")


def requested_for_user(user_id):
    """3-5 event types per user, chosen by user_id mod 3."""
    k = F.pmod(user_id, F.lit(3))
    types = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return F.slice(types, 1, (k + 3).cast("int"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("created_at"))
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_BY_USER]), (F.pmod(F.col("user_id"), F.lit(4)) + 1).cast("int"))
    return users.select(
        F.col("user_id").cast("string").alias("evaluation_id"),
        requested_for_user(F.col("user_id")).alias("requested_models"),
        status.alias("status"),
        "created_at",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored response objects: for each received (user, type) the latest received event id names
    the document that is the response text; ids without a document have no object."""
    ev = status_events(spark, sf_dir).where(F.col("status") == "RECEIVED")
    latest = ev.groupBy("evaluation_id", "model").agg(F.max("event_seq").alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("response"))
    return latest.join(docs, "doc_id").select(
        "evaluation_id", "model", "response", F.lit(None).cast("string").alias("prompt_sent")
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    j = lab.join(docs, "doc_id")
    rows = F.explode(
        F.array(
            F.struct(F.lit("faithfulness").alias("criterion"), (F.col("quality") == 1).alias("verdict")),
            F.struct(F.lit("toxicity").alias("criterion"), (F.col("toxic") == 1).alias("verdict")),
        )
    )
    return j.select(
        F.col("lang").alias("evaluation_id"), F.col("source").alias("model"), F.col("doc_id").alias("unit_no"), rows.alias("v")
    ).select("evaluation_id", "model", "v.criterion", "unit_no", "v.verdict")


def judge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    def words(c):
        return F.array_remove(F.split(F.coalesce(c, F.lit("")), " "), "")

    ref, ctx = words(F.col("reference_answer")), words(F.col("context"))
    half = F.floor(F.size(ctx) / 2).cast("int")
    mixed = F.concat(F.slice(ctx, half + 1, F.size(ctx)), F.slice(ref, 1, F.floor(F.size(ref) / 2).cast("int")))
    answers = F.array(
        F.struct(F.lit("m_drop7").alias("model"), F.array_join(F.filter(ref, lambda x, i: (i + 1) % 7 != 0), " ").alias("response")),
        F.struct(F.lit("m_echo").alias("model"), F.col("prompt").alias("response")),
        F.struct(F.lit("m_mixed").alias("model"), F.array_join(mixed, " ").alias("response")),
    )
    req = requests(spark, sf_dir)
    return req.select("evaluation_id", "prompt", "reference_answer", "context", F.inline(answers))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors first (one row per label: min id, then its vector), then every embedding joins that
    table on label.  It has one row per label, so AQE broadcasts it when small; beyond the threshold
    a label holding a third of the rows is split by AQE's skew join against its single anchor row."""
    emb = table(spark, sf_dir, "embeddings")
    anchor = emb.groupBy("label").agg(F.min("vec_id").alias("anchor_id"))
    anchor_vec = anchor.join(
        emb.select(F.col("vec_id").alias("anchor_id"), F.col("embedding").alias("anchor_embedding")), "anchor_id"
    )
    return emb.join(anchor_vec, "label").select("vec_id", "label", "anchor_id", "embedding", "anchor_embedding")


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies as JSON text: the user turns of each block of 8 turns of a conversation form
    one array body (at most 4 items, so the collected group is bounded).

    Some are bad: in the first turns the prompt is missing (conv_id mod 5 = 0) or empty (mod 5 = 1), and
    every seventh conversation sends two more bodies, an array of items that are no objects and broken JSON.
    """
    req = requests(spark, sf_dir)
    first, kind = F.col("turn") < 2, F.pmod(F.col("conv_id"), F.lit(5))
    req = req.withColumn("prompt", F.when(first & (kind == 0), None).when(first & (kind == 1), F.lit("")).otherwise(F.col("prompt")))
    extra = (
        table(spark, sf_dir, "conversations").where(F.pmod(F.col("conv_id"), F.lit(7)) == 3).select("conv_id").distinct()
        .select("conv_id", F.explode(F.create_map(*[F.lit(x) for kv in BAD_BODIES.items() for x in kv])).alias("name", "body"))
        .select(F.concat_ws("-", F.col("conv_id").cast("string"), "name").alias("batch_id"), "body")
    )
    blk = F.floor(F.col("turn") / 8).cast("long")
    items = F.array_sort(F.collect_list(F.struct("turn", "prompt", "reference_answer", "context")))
    bodies = (
        req.groupBy("conv_id", blk.alias("blk"))
        .agg(F.to_json(F.transform(items, lambda s: s.dropFields("turn"))).alias("body"))
        .select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("blk").cast("string")).alias("batch_id"), "body")
    )
    return bodies.unionByName(extra)
