"""Scalar helpers (B2, B16, B18, A7, M16 and the truthiness tests of §2.11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (``str.isspace``), as a regex class
# that both Java and RE2 accept.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Fixed value: length of a prompt label before the ellipsis.
LABEL_CHARS = 70


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round4(x: Column | str) -> Column:
    """Round to 4 digits, ties to even on the shortest decimal form."""
    return F.bround(_c(x).cast("double"), 4)


def is_truthy(x: Column | str) -> Column:
    """Python truthiness of an optional string: null and '' are false, blanks are true."""
    c = _c(x)
    return c.isNotNull() & (F.length(c) > 0)


def has_visible_text(x: Column | str) -> Column:
    """``bool(x and x.strip())`` with Python's notion of whitespace."""
    c = _c(x)
    return c.isNotNull() & (F.length(F.regexp_replace(c, PY_WHITESPACE_CLASS, "")) > 0)


def coerce_score(x: Column | str) -> Column:
    """Text or number → double; anything that is not a finite-or-infinite number becomes null (B2).

    ``try_cast('NaN' as double)`` yields NaN, so NaN is mapped to null as well.
    """
    d = _c(x).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def prompt_label(prompt: Column | str) -> Column:
    """First 70 characters (code points) followed by ``...`` — always appended."""
    return F.concat(F.substring(_c(prompt), 1, LABEL_CHARS), F.lit("..."))


def response_key(evaluation_id: Column | str, model: Column | str, replace_blanks: bool = True) -> Column:
    """Object key of a stored model response: ``{id}/{model lower, blanks → _}_response.json``.

    ``replace_blanks=False`` gives the one worker's variant that only lower-cases.
    """
    m = F.lower(_c(model))
    if replace_blanks:
        m = F.replace(m, F.lit(" "), F.lit("_"))
    return F.concat(_c(evaluation_id), F.lit("/"), m, F.lit("_response.json"))


def py_strip(x: Column | str) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    ws = PY_WHITESPACE_CLASS
    return F.regexp_replace(_c(x), f"^{ws}+|{ws}+$", "")


def parse_model_list(csv: Column | str) -> Column:
    """Comma list → array of stripped names; empty entries are kept, as the reference does."""
    return F.transform(F.split(_c(csv), ",", -1), lambda s: py_strip(s))
