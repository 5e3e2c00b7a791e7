"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied per page and language: the likelihood of the visible text under a
byte-trigram model, the language that the markup declares, the address (top-level domain and a
two-letter path segment), and the prior of the host, smoothed towards its domain and that towards all
pages.  How far each declaration, address and host can be trusted is counted from the pages themselves,
by grouped aggregation of the text posteriors; a page's own posterior is left out of its own priors.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import P, cut

BUCKETS = 1 << 15
#: Languages per shard of the trigram table: the driver and a task hold tables of this many at a time.
SHARD_LANGUAGES = 64
#: At most so many trigrams' worth of text evidence: neighbouring trigrams are far from independent.
TEXT_WEIGHT = 60.0
#: Pseudo-counts of the smoothing levels.
HOST_K, DOMAIN_K, VALUE_K = 5.0, 20.0, 1.0

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]{2,3})""", re.I)


def visible_text(page: str) -> str:
    return markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def declared_language(page: str) -> str | None:
    """Primary subtag of the html element's lang attribute."""
    m = _LANG.search(page)
    return m[1].lower() if m else None


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text; digits and blank runs are one blank."""
    raw = re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "surrogatepass")
    b = np.frombuffer(b" " + raw + b" ", dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    code = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def language_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], DataFrame]:
    """(languages, trigram counts (lang, bucket, n)) from all documents with a language.

    Tasks count trigrams per language; the sums stay a table, the driver gets the languages' names.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    grams = trigrams

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                g = grams(t.as_py())
                if name not in totals:
                    totals[name] = np.zeros(BUCKETS, dtype=np.int64)
                np.add.at(totals[name], g, 1) if len(g) < 2_000 else totals[name].__iadd__(np.bincount(g, minlength=BUCKETS))
        for name, c in totals.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"]
            )

    counts = cut(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    return sorted(r.lang for r in counts.select("lang").distinct().collect()), counts


def model_table(counts: DataFrame, names: list[str]) -> np.ndarray:
    """Log-probabilities [language, bucket] of the languages ``names``, at most a shard of them."""
    got = counts.where(F.col("lang").isin(names)).toPandas()
    table = np.full((len(names), BUCKETS), 0.5)
    index = {x: i for i, x in enumerate(names)}
    table[got["lang"].map(index).to_numpy(dtype=np.int64), got["bucket"].to_numpy()] += got["n"].to_numpy()
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def page_evidence(pages: DataFrame, names: list[str], counts: DataFrame | None) -> DataFrame:
    """(page_id, host, domain, address, declared, ll): narrow rows; ll is the weighted mean
    log-likelihood per language.  Missing parts are '' (a value of its own).

    Pages are read once; with more languages than one shard holds, their trigrams travel on and each
    further shard appends its languages to ll.
    """
    shards = [names[i : i + SHARD_LANGUAGES] for i in range(0, len(names), SHARD_LANGUAGES)]
    grams, seen, declares, weight = trigrams, visible_text, declared_language, TEXT_WEIGHT
    many = len(shards) > 1

    def likelihood(table: np.ndarray, g: np.ndarray) -> list[float]:
        n = len(g)
        ll = table[:, g].sum(axis=1, dtype=np.float64) if n else np.zeros(len(table))
        return (ll * (min(n, weight) / max(n, 1))).tolist()

    def table_of(own: list[str]):
        table = model_table(counts, own) if own else np.zeros((0, BUCKETS), dtype=np.float32)
        return pages.sparkSession.sparkContext.broadcast(table)

    def first(batches: Iterator[pa.RecordBatch], shared=table_of(shards[0] if shards else [])) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lls, langs, found = [], [], []
            for t in b.column(2):
                page = t.as_py() or ""
                g = grams(seen(page))
                lls.append(likelihood(shared.value, g))
                langs.append(declares(page) or "")
                found.append(g.astype(np.uint16).tobytes() if many else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(lls, pa.list_(pa.float64())), pa.array(found, pa.binary())],
                names=["page_id", "url", "declared", "ll", "grams"],
            )

    schema = "page_id long, url string, declared string, ll array<double>, grams binary"
    e = pages.select("page_id", "url", "html").mapInArrow(first, schema)
    for own in shards[1:]:

        def more(batches: Iterator[pa.RecordBatch], shared=table_of(own)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lls = [
                    x.as_py() + likelihood(shared.value, np.frombuffer(g.as_py(), dtype=np.uint16))
                    for x, g in zip(b.column(3), b.column(4), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(lls, pa.list_(pa.float64())), b.column(4)], names=b.schema.names)

        e = e.mapInArrow(more, schema)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    path = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1), F.lit("")))
    address = F.concat(F.element_at(labels, -1), F.lit("/"), path)
    return e.select("page_id", host.alias("host"), domain.alias("domain"), address.alias("address"), "declared", "ll")


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Sum of the text posteriors per value of ``key`` as array ``<key>_n``; partial sums before the shuffle."""
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"{P}{i}") for i in range(n)]
    c = rows.groupBy(key).agg(*sums)
    return c.select(F.col(key).alias(f"{P}{key}"), F.array(*[F.col(f"{P}{i}") for i in range(n)]).alias(f"{key}_n"))


def fuse(evidence: DataFrame, names: list[str]) -> DataFrame:
    """``evidence`` plus lang, confidence, text_lang and posterior (array in the order of ``names``).

    Grouped tables of declarations, addresses, hosts and domains join back on their key; AQE broadcasts
    a small table and splits a hot host otherwise.
    """
    n = len(names)
    rows = cut(evidence.withColumn("p", _softmax(F.col("ll"))))
    total = rows.agg(*[F.sum(F.get("p", F.lit(i))) for i in range(n)]).first()
    total = [x or 0.0 for x in total]
    whole = sum(total)
    base = F.array(*[F.lit((x + 1.0) / (whole + n)) for x in total])
    totals = F.array(*[F.lit(float(x)) for x in total])
    j = rows
    for key in ("declared", "address", "domain", "host"):
        c = _counts(rows, key, n)
        j = j.join(c, j[key] == c[f"{P}{key}"]).drop(f"{P}{key}")

    def without_own(counts: str) -> Column:
        return F.zip_with(F.col(counts), F.col("p"), lambda c, p: F.greatest(c - p, F.lit(0.0)))

    def add(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def shrunk(counts: str, prior: Column, k: float) -> Column:
        own = without_own(counts)
        return F.zip_with(own, prior, lambda c, q: (c + k * q) / (add(own) + k))

    def given(counts: str) -> Column:
        """P(value | language): the value's count in the language over the language's, value share as prior."""
        own = without_own(counts)
        share = (add(own) + F.lit(VALUE_K)) / F.lit(whole + VALUE_K)
        return F.zip_with(own, totals, lambda c, t: (c + VALUE_K * share) / (t + VALUE_K))

    j = j.withColumn(f"{P}dom", shrunk("domain_n", base, DOMAIN_K))
    j = j.withColumns({f"{P}host": shrunk("host_n", F.col(f"{P}dom"), HOST_K), f"{P}a": given("address_n"), f"{P}d": given("declared_n")})
    logs = [F.transform(F.col(c), F.ln) for c in (f"{P}host", f"{P}a", f"{P}d")]
    score = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), logs, F.col("ll"))
    fused = j.withColumn(f"{P}s", score).withColumn("posterior", _softmax(F.col(f"{P}s")))
    langs = F.array(*[F.lit(x) for x in names])
    best = F.array_position("posterior", F.array_max("posterior"))
    return fused.select(
        *evidence.columns,
        F.element_at(langs, best.cast("int")).alias("lang"),
        F.array_max("posterior").alias("confidence"),
        F.element_at(langs, F.array_position("ll", F.array_max("ll")).cast("int")).alias("text_lang"),
        "posterior",
    )


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page row: page_id, host, domain, address, declared, lang, confidence, text_lang, posterior.

    Pages without visible text, address or declaration are judged by what is left, in the end by the
    prior of all pages.  Ties go to the first language by name.  Without labelled documents there is no
    language to choose: lang, confidence and text_lang are null.  Repeated rows are judged each.
    """
    names, counts = language_model(docs)
    if not names:
        e = page_evidence(pages, [], None).drop("ll")
        empty = {"lang": "string", "confidence": "double", "text_lang": "string", "posterior": "array<double>"}
        return e.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})
    return fuse(page_evidence(pages, names, counts), names).drop("ll")
