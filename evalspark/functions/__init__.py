"""Column-valued helpers. Every function here returns a ``pyspark.sql.Column`` built from
built-in expressions, so callers stay inside Catalyst / whole-stage codegen."""

from evalspark.functions.text import ngrams, tokenize  # noqa: F401
from evalspark.functions.scalar import (  # noqa: F401
    coerce_score,
    has_visible_text,
    is_truthy,
    parse_model_list,
    prompt_label,
    response_key,
    round4,
)
from evalspark.functions.prompt import format_prompt  # noqa: F401
from evalspark.functions.vector import cosine  # noqa: F401
