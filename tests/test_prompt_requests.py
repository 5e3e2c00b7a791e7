import json
import re
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.functions.prompt import TEMPLATE_QUESTION_ONLY, TEMPLATE_WITH_CONTEXT, format_prompt
from evalspark.functions.scalar import parse_model_list, response_key
from evalspark.operators import requests as rq


def expected_prompt(question, context):
    """The template filled by the standard library, then de-indented by it."""
    template = TEMPLATE_WITH_CONTEXT if (context or "").strip() else TEMPLATE_QUESTION_ONLY
    values = {"context": context, "question": question}
    return textwrap.dedent(re.sub(r"\{(context|question)\}", lambda m: values[m[1]], template))


def test_literal_prompts(spark):
    rows = [("Why?", "Because."), ("Why?", None), ("a\n    b", " ")]
    got = [r.f for r in spark.createDataFrame(rows, "q string, c string").select(format_prompt("q", "c").alias("f")).collect()]
    assert got[0] == (
        "\nUse the following context to answer the question:\n<context>\nBecause.\n</context>\n\n<question>\nWhy?\n</question>\n\n"
        "Your answer should be based solely on the provided context. If the answer cannot be found in the context, state that.\nAnswer:\n"
    )
    assert got[1] == "\nAnswer the following question:\n<question>\nWhy?\n</question>\n\nAnswer:\n"
    pad = " " * 8
    assert got[2] == f"\n{pad}Answer the following question:\n{pad}<question>\n{pad}a\nb\n{pad}</question>\n\n{pad}Answer:\n"


EDGE_CONTEXTS = [None, "", "   ", "\t", " ", " \t  ", "plain context"]
EDGE_QUESTIONS = [
    "one line",
    "first\nsecond at 0",
    "first\n    second at 4",
    "first\n            second at 12",
    "first\n                    second at 20",
    "first\n\ttab line",
    "first\n   \nblank-only line",
    "  lead\n  x",
]


def _check(spark, rows):
    df = spark.createDataFrame(rows, "q string, c string")
    got = df.select("q", "c", format_prompt("q", "c").alias("f")).collect()
    for r in got:
        assert r.f == expected_prompt(r.q, r.c), (r.q, r.c)


def test_format_prompt_edges(spark):
    _check(spark, [(q, c) for q in EDGE_QUESTIONS for c in EDGE_CONTEXTS] + [(q, q) for q in EDGE_QUESTIONS])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=" \t\nab ", max_size=30), st.one_of(st.none(), st.text(alphabet=" \t\nxy", max_size=30))), min_size=1, max_size=8))
def test_format_prompt_property(spark, rows):
    _check(spark, rows)


def test_parse_validate_edges(spark):
    bodies = [
        ("lone", json.dumps({"prompt": "p", "reference_answer": "r"})),
        ("array", json.dumps([{"prompt": "a", "context": None}, {"prompt": "b", "reference_answer": "rb", "context": "c"}])),
        ("empty", "[]"),
        ("nonobj", json.dumps([{"prompt": "ok"}, 5, "txt"])),
        ("broken", "{not json"),
        ("nullbody", "null"),
        ("prompts", json.dumps([{"prompt": None}, {"prompt": ""}, {"prompt": "   "}, {"reference_answer": "x"}])),
        ("none", None),
    ]
    df = spark.createDataFrame(bodies, "batch_id string, body string")
    v = rq.validate_requests(rq.parse_requests(df, "body", ["batch_id"]))
    rows = {(r.batch_id, r.item_index): r for r in v.collect()}
    assert rows[("lone", 0)].error is None and rows[("lone", 0)].prompt == "p"
    assert rows[("array", 1)].context == "c" and rows[("array", 0)].context is None
    assert not any(k[0] == "empty" for k in rows) and not any(k[0] == "none" for k in rows)
    assert rows[("nonobj", 0)].error is None
    assert rows[("nonobj", 1)].error and rows[("nonobj", 2)].error
    assert rows[("broken", 0)].error.endswith("item is not valid JSON") and rows[("nullbody", None)].error
    assert rows[("prompts", 0)].error == "Error processing item 0: Prompt is required for item 0."
    assert rows[("prompts", 1)].error and rows[("prompts", 3)].error
    assert rows[("prompts", 2)].error is None  # blanks are accepted
    summ = {r.batch_id: r for r in rq.batch_summary(v).collect()}
    assert summ["lone"].status_code == 200 and summ["prompts"].status_code == 207
    assert summ["prompts"].total_items_received == 4 and summ["prompts"].items_initiated_successfully == 1
    errs = rq.request_errors(v).collect()
    assert any(e.input == "5" for e in errs)


def test_initiate_fan_out_keys(spark):
    df = spark.createDataFrame([("b", json.dumps({"prompt": "p"}))], "batch_id string, body string")
    models = F.array(F.lit("Open AI"), F.lit("GEMINI"), F.lit("Open AI"))
    ev = rq.initiate(rq.valid_requests(rq.validate_requests(rq.parse_requests(df), models)))
    r = ev.collect()[0]
    assert r.status == "INITIATED" and dict(r.responses_received) == {"Open AI": "PENDING", "GEMINI": "PENDING"}
    fan = rq.with_response_key(rq.fan_out(ev)).collect()
    keys = sorted(x.response_key for x in fan)
    assert keys == sorted([f"{r.evaluation_id}/open__ai_response.json".replace("open__ai", "open_ai"), f"{r.evaluation_id}/gemini_response.json"])
    two = spark.createDataFrame([("e", "Open  AI")], "e string, m string").select(response_key("e", "m").alias("k")).collect()[0].k
    assert two == "e/open__ai_response.json"


def test_parse_model_list(spark):
    df = spark.createDataFrame([(" a, b ,,c ",)], "s string")
    assert df.select(parse_model_list("s").alias("l")).collect()[0].l == ["a", "b", "", "c"]
