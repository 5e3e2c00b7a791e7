"""Quality rules by host: document rules, failure rates per host under an empirical beta prior, verdicts.

Every stage is built-in DataFrame functions.  Word arrays are per row, so no word is shuffled; the host
table is a partial aggregation of one narrow row per document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import P, cut, words

#: Fixed value: the characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Bytes of names and verdicts up to which a host table is broadcast to whole documents (measured first).
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class HostRules:
    """``watch_rate``: a host whose shrunk failure rate reaches it has its failing documents rejected;
    ``reject_rate``: from here on all of its documents are rejected.  The other three are the rules:
    symbols per 100 words, mean characters of a word, repeated lines per 100 lines."""

    watch_rate: float = 0.02
    reject_rate: float = 0.8
    max_symbols: int = 30
    max_word_chars: int = 20
    max_dup_lines: int = 60


def _repeat_words(h: Column, has_repeats: Column) -> Column:
    """Words inside a 3-word window found twice or more; ``h`` holds a 64-bit hash per window."""
    s = F.col(f"{P}s")
    same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    at = F.transform(same, lambda x: x["p"])
    covered = F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))
    return F.when(has_repeats, F.size(F.array_distinct(covered))).otherwise(0).cast("long")


def document_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the five counts in ``STATS`` and ``n_lines`` (lines with a word).

    Null and empty texts count 0 everywhere.  A 3-word window is compared by the 64-bit hash of its
    words inside one document (a false match needs a collision there: about n² / 2^65).
    """
    w, h = F.col(f"{P}w"), F.col(f"{P}h")
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    with_words = docs.withColumns({f"{P}w": words(F.col(text)), f"{P}l": lines})
    windows = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    )
    joined = F.array_join(w, "")
    counted = with_words.withColumns(
        {
            f"{P}h": windows,
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": F.coalesce(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")), F.lit(0)).cast("long"),
            "n_dup_lines": (F.size(f"{P}l") - F.size(F.array_distinct(f"{P}l"))).cast("long"),
            "n_lines": F.size(f"{P}l").cast("long"),
        }
    )
    has = F.size(F.array_distinct(h)) < F.size(h)
    places = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1))
    zipped = F.sort_array(F.arrays_zip(h.alias("h"), places.alias("p")))
    named = counted.withColumns({f"{P}r": has, f"{P}s": F.when(has, zipped.cast("array<struct<h:bigint,p:int>>"))})
    return named.withColumn("n_repeat_words", _repeat_words(h, F.col(f"{P}r"))).drop(*[P + x for x in "wlhrs"])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failed(rules: HostRules) -> Column:
    """A document that breaks the base rules or one of the host rules' own."""
    return (
        base_failed()
        | (100 * F.col("n_symbols") > rules.max_symbols * F.col("n_words"))
        | (F.col("word_chars") > rules.max_word_chars * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > rules.max_dup_lines * F.col("n_lines"))
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of the beta prior over host failure rates, by moments of the hosts' rates weighted by
    documents, less the binomial variance.  One global row of five numbers reaches the driver."""
    r = F.col("failed") / F.col("docs")
    n, m, k, s, s2 = hosts.agg(
        F.sum("docs"), F.sum("failed") / F.sum("docs"), F.count("*"), F.sum(F.col("docs") * r), F.sum(F.col("docs") * r * r)
    ).first()
    if not n or not 0 < m < 1:
        m = 0.5 if not n else min(max(m, 1e-6), 1 - 1e-6)
        return 2 * m, 2 * (1 - m)
    between = max(s2 / n - (s / n) ** 2 - m * (1 - m) * k / n, m * (1 - m) / 1e4)
    strength = min(max(m * (1 - m) / between - 1, 2.0), 1e4)
    return m * strength, (1 - m) * strength


def host_verdicts(stats: DataFrame, host: str, rules: HostRules) -> DataFrame:
    """One row per host (a null host is a host): docs, failed, shrunk rate and verdict
    (``trusted``, ``watched`` or ``rejected``)."""
    hosts = cut(
        stats.groupBy(F.col(host).alias(f"{P}host")).agg(
            F.count("*").alias("docs"), F.count_if(rule_failed(rules)).alias("failed")
        )
    )
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b))
    verdict = F.when(rate >= rules.reject_rate, "rejected").when(rate >= rules.watch_rate, "watched").otherwise("trusted")
    return hosts.select(f"{P}host", rate.alias("host_rate"), verdict.alias("host_verdict"))


def judge(stats: DataFrame, host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """``stats`` plus host_rate, host_verdict, base_failed and kept.

    kept is false if base_failed, if the host is rejected, or if the host is watched and the document
    breaks a rule; a clean document of a trusted or watched host always stays.  The host table joins
    back null-safely; AQE broadcasts it when small and splits a hot host's documents otherwise.
    """
    v = host_verdicts(stats, host, rules)
    j = stats.join(v, stats[host].eqNullSafe(v[f"{P}host"]), "left").drop(f"{P}host")
    base = base_failed()
    bad = base | (F.col("host_verdict") == "rejected") | ((F.col("host_verdict") == "watched") & rule_failed(rules))
    return j.withColumns({"base_failed": base, "kept": ~bad})


def quality_rules(docs: DataFrame, host: str = "source", rules: HostRules = HostRules(), key: str = "doc_id") -> DataFrame:
    """One row per document row: key, host, the counts, base_failed, host_rate, host_verdict, kept.

    Empty table: no rows.  Repeated rows are judged each.  Null or empty texts have no words and fail
    the base rules.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("source"), F.col("text"))
    return judge(cut(document_stats(narrow).drop("text")), "source", rules)


def _small(verdicts: DataFrame) -> DataFrame:
    """``verdicts`` marked for broadcast if its names and verdicts are within the bound; else AQE joins them by shuffle."""
    name = F.coalesce(F.octet_length(F.col(f"{P}host").cast("string")), F.lit(0))
    size = verdicts.agg(F.sum(name + 64)).first()[0]  # 64: rate, verdict and the row itself
    return F.broadcast(verdicts) if (size or 0) <= BROADCAST_BYTES else verdicts


def keep_clean(docs: DataFrame, host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """``docs`` without the rejected documents, all of its columns unchanged.

    A document's counts need its own row only, so texts are not shuffled: the first pass makes the
    host table, the second filters each row by its own counts and its host's verdict.  Without the mark
    for broadcast the join would deal whole documents by host first and find out later that the host
    table is small; only a table of more than ``BROADCAST_BYTES`` is joined by shuffle.
    """
    mine = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(f"{P}row"), F.col(host).alias(f"{P}src"), "text")
    stats = document_stats(mine)
    v = host_verdicts(cut(stats.select(f"{P}src", "n_lines", *STATS)), f"{P}src", rules)
    # a generator in between: the optimizer would copy the counts' expressions into a filter pushed below them
    counts = F.explode(F.array(F.struct("n_lines", *STATS))).alias(f"{P}c")
    held = stats.select(f"{P}row", f"{P}src", counts).select(f"{P}row", f"{P}src", f"{P}c.*")
    bad = base_failed() | (F.col("host_verdict") == "rejected") | ((F.col("host_verdict") == "watched") & rule_failed(rules))
    j = held.join(_small(v), held[f"{P}src"].eqNullSafe(v[f"{P}host"]), "left")
    return j.where(~bad).select(*[F.col(f"{P}row")[c].alias(c) for c in docs.columns])
