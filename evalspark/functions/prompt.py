"""Prompt formatting (B7): template filled first, then de-indented like ``textwrap.dedent``.

The values are inserted *before* de-indenting, so a question or context whose later lines start
with fewer blanks than the template's 12 lowers the margin removed from every line.
Blank-only lines (spaces/tabs) become empty; the margin is the smallest count of leading spaces
over the remaining lines (a leading tab counts as 0, which matches the common-prefix rule because
every template line is indented with spaces only).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.scalar import has_visible_text

# The two prompt templates as written (before de-indenting).
# ``{context}`` and ``{question}`` mark where the values go.
TEMPLATE_WITH_CONTEXT = """
            Use the following context to answer the question:
            <context>
            {context}
            </context>

            <question>
            {question}
            </question>

            Your answer should be based solely on the provided context. If the answer cannot be found in the context, state that.
            Answer:
            """
TEMPLATE_QUESTION_ONLY = """
            Answer the following question:
            <question>
            {question}
            </question>

            Answer:
            """


def template_parts(template: str) -> list[tuple[str, bool]]:
    """The template in pieces: (text, False) as it is, (name, True) where a value goes."""
    return [(x, k % 2 == 1) for k, x in enumerate(re.split(r"\{(\w+)\}", template))]


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts = [F.coalesce(values[x], F.lit("None")) if is_value else F.lit(x) for x, is_value in template_parts(template)]
    return F.concat(*parts)


def dedent(raw: Column) -> Column:
    """``textwrap.dedent`` as native expressions."""
    lines = F.transform(
        F.split(raw, "\n", -1), lambda x: F.when(F.length(F.regexp_replace(x, "[ \t]", "")) == 0, F.lit("")).otherwise(x)
    )
    margin = F.array_min(
        F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))
    )
    k = F.coalesce(margin, F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(x == "", F.lit("")).otherwise(F.substring(x, k + 1, 1 << 30))), "\n")


def format_prompt(question: Column | str, context: Column | str | None = None) -> Column:
    """Formatted prompt for one (question, context) row; context is used when it has visible text."""
    q = F.col(question) if isinstance(question, str) else question
    if context is None:
        return dedent(_fill(TEMPLATE_QUESTION_ONLY, {"question": q}))
    c = F.col(context) if isinstance(context, str) else context
    return F.when(
        has_visible_text(c), dedent(_fill(TEMPLATE_WITH_CONTEXT, {"question": q, "context": c}))
    ).otherwise(dedent(_fill(TEMPLATE_QUESTION_ONLY, {"question": q})))
