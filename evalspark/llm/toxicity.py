"""Toxicity of documents: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates per word: words of a seed lexicon and of one learned from labelled documents (whole words and
word stems, after undoing disguises), such words near a second-person pronoun, capitals, punctuation, symbols and disguised
words.  Three disjoint parts of a bounded, hashed sample of the labelled documents teach the lexicon, the trees and the
calibration.  Trees and calibration are Spark ML models; documents are scored where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import cut, hashed_sample, stored

#: Insults of the seed lexicon.
SEED = frozenset(
    "idiot idiots stupid moron morons dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns fool fools "
    "dummkopf blöd arschloch abschaum crétin imbécile connard ordure estúpido idiota imbécil basura".split()
)
#: Second-person words.
SECOND = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner euch euer eure tu toi ton tes vous votre vos tú ti "
    "contigo usted ustedes vosotros".split()
)
#: Characters that stand for letters, and what is stripped from the ends of a word.
LETTER_FOR = str.maketrans("013457@$!", "oieastasi")
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’¿¡…–—"
STRETCHED = re.compile(r"(\w)\1\1+")
DISGUISED = re.compile(r"[^\W\d_][^\w'’-]+[^\W\d_]|[^\W\d_][\d_]+[^\W\d_]")
#: Lengths of the stems that the lexicon may hold beside whole words.
STEMS = (4, 5, 6)
#: Words between a lexicon word and a second-person word that count as near.
NEAR = 4
NAMES = (
    "log_words", "seed_rate", "lexicon_rate", "lexicon_weight", "lexicon_most", "lexicon_words", "near_second", "second_rate", "capital_share",
    "shouted_rate", "exclaimed_rate", "asked_rate", "doubled_rate", "symbol_rate", "disguised_rate", "disguised_lexicon_rate", "stretched_rate",
)
#: Word attributes: seed, weight, hit, second person, capitals, letters, shouted, !, ?, doubled, symbols, disguised, disguised hit, stretched.
N_ATTRIBUTES = 14


@dataclass(frozen=True)
class Sampling:
    """Bounds of what is learned from: labelled documents, words and stems of the lexicon, and its evidence
    (log-likelihood ratio) at least; rounds and depth of the trees."""

    documents: int = 20_000
    terms: int = 4_000
    evidence: float = 20.0
    rounds: int = 30
    depth: int = 3


def plain(word: str) -> tuple[str, bool, bool]:
    """(word without ends, disguises and stretches, was it disguised, was it stretched), lower-case."""
    core = word.strip(EDGES).lower()
    if not core.isalpha():
        disguised = DISGUISED.search(core) is not None
        core = "".join(c for c in (core.translate(LETTER_FOR) if disguised else core) if c.isalpha())
    else:
        disguised = False
    short = STRETCHED.sub(r"\1", core)
    return short, disguised, short != core


def terms(word: str) -> list[str]:
    """What the lexicon may hold of a plain word: ``=word`` and its stems."""
    return [f"={word}", *(word[:n] for n in STEMS if len(word) > n)] if len(word) > 1 else []


class Attributes(dict):
    """Word → row of ``table``; a word is looked at once."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.new, self.table = lexicon, [], np.zeros((0, N_ATTRIBUTES), dtype=np.float32)

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        core, disguised, stretched = plain(word)
        weight = max((self.lexicon.get(t, 0.0) for t in terms(core)), default=0.0)
        hit, marks = weight > 0 or core in SEED, word.count("!") + word.count("?")
        capitals, letters = sum(map(str.isupper, word)), sum(map(str.isalpha, word))
        row = (
            core in SEED, weight, hit, core in SECOND, capitals, letters, letters > 2 and capitals == letters, word.count("!"), word.count("?"),
            marks > 1, sum(map(word.count, "#*$%&@")), disguised, disguised and hit, stretched,
        )
        self.new.append(row)
        self[raw] = at = len(self)
        return at

    def rows(self) -> np.ndarray:
        if self.new:
            self.table = np.concatenate([self.table, np.array(self.new, dtype=np.float32)])
            self.new = []
        return self.table


def features(texts: list[str | None], words: Attributes) -> np.ndarray:
    """One row of NAMES per text; null and empty texts: zeros."""
    if len(words) > 400_000:
        words.clear()
        words.table = words.table[:0]
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    ids = [np.fromiter(map(words.__getitem__, w), dtype=np.int64, count=len(w)) for w in split]
    table, out = words.rows(), np.zeros((len(texts), len(NAMES)))
    for k, own in enumerate(ids):
        if not len(own):
            continue
        a, n = table[own], len(own)
        total = a.sum(axis=0, dtype=np.float64)
        hits, second = np.nonzero(a[:, 2])[0], np.nonzero(a[:, 3])[0]
        near = 0.0
        if len(hits) and len(second):
            right = np.searchsorted(second, hits)
            gap = np.minimum(
                np.abs(second[np.minimum(right, len(second) - 1)] - hits), np.abs(hits - second[np.maximum(right - 1, 0)])
            )
            near = float((gap <= NEAR).mean())
        out[k] = (
            np.log1p(n), total[0] / n, total[2] / n, total[1] / n, a[:, 1].max(), np.log1p(len(np.unique(own[hits]))), near, total[3] / n,
            total[4] / max(total[5], 1), *(total[[6, 7, 8, 9, 10, 11, 12, 13]] / n),
        )
    return out


def _slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batch in pieces of about ``most`` characters of text."""
    at, weight, texts = 0, 0, []
    for k in range(batch.num_rows):
        texts.append(batch.column(text)[k].as_py())
        weight += len(texts[-1] or "") + 256
        if weight >= most or k == batch.num_rows - 1:
            yield batch.slice(at, k + 1 - at), texts
            at, weight, texts = k + 1, 0, []


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _sample(docs: DataFrame, labels: DataFrame, how: Sampling) -> DataFrame:
    """(part, y, text) of about ``how.documents`` labelled rows outside the held-out fold, chosen by a hash of doc_id.

    A doc_id with several labels is toxic if any of them says so; null labels and null ids are left out.
    """
    lab = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = hashed_sample(lab.groupBy("doc_id").agg(F.max("toxic").alias("y")), ["doc_id"], how.documents).limit(2 * how.documents)
    picked = picked.select("doc_id", "y", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(10)).cast("int").alias("part"))
    # two numbers per row, and the rows are bounded
    return stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("part", "y", "doc_id", "text"))


def learn_lexicon(rows: DataFrame, how: Sampling) -> dict[str, float]:
    """Term → log-odds of toxic documents, for the ``how.terms`` terms with most evidence.

    ``rows`` has (y, text).  A term counts once per document; its evidence is the log-likelihood ratio of its
    two document counts against those expected without a connection.
    """
    plain_word, terms_of = plain, terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _slices(b, 1):
                found, label = [], []
                for t, y in zip(texts, part.column(0).to_pylist(), strict=True):
                    own = {x for w in set((t or "").split()) for x in terms_of(plain_word(w)[0])}
                    found.extend(own)
                    label.extend([y] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(found, pa.string())], names=["y", "term"])

    n1, n0 = rows.select(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n1 or not n0:
        return {}
    held = rows.select("y", "text").mapInArrow(run, "y int, term string")
    c = held.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a > 1")
    a, b = F.col("a"), F.col("b")
    expected = (a + b) * (n1 / (n1 + n0))
    ratio = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0.0))
    odds = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    best = c.select("term", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") >= how.evidence) & (F.col("odds") > 1))
    top = best.orderBy(F.desc("ratio"), "term").limit(how.terms).collect()
    return {r.term: float(r.odds) for r in top}


def with_features(rows: DataFrame, text: str, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` with the text column replaced by ``x``, the array of its features."""
    at, names = rows.columns.index(text), [c for c in rows.columns if c != text]
    look, work = Attributes, features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = look(lexicon)
        for b in batches:
            for part, texts in _slices(b, at):
                x = work(texts, words)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                cols = [part.column(i) for i, c in enumerate(part.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays([*cols, flat], names=[*names, "x"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text]
    return rows.mapInArrow(run, ", ".join([*kinds, "x array<double>"]))


@dataclass
class Model:
    """``trees`` None: every document scores ``prior``; ``steps`` None: the trees' own probability counts."""

    prior: float
    lexicon: dict[str, float]
    trees: object = None
    steps: object = None

    def margins(self, rows: DataFrame) -> DataFrame:
        m = self.trees.transform(rows.withColumn("features", array_to_vector("x")))
        return m.withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1))).select(*rows.columns, "margin")


def train(docs: DataFrame, labels: DataFrame, how: Sampling = Sampling()) -> Model:
    """Lexicon from half of the sample, trees from three tenths, calibration from a fifth.

    Without labels, or with one class only, every document scores the sample's share of toxic ones (0.5 without any).
    """
    sample = _sample(docs, labels, how)
    prior = sample.agg(F.avg("y")).first()[0]
    model = Model(0.5 if prior is None else float(prior), learn_lexicon(sample.where("part < 5"), how))
    rest = sample.where("part >= 5").select("part", "y", "doc_id", "text")
    rest = cut(with_features(rest, "text", model.lexicon).repartition(4, "doc_id").sortWithinPartitions("doc_id", "x"))
    two = rest.groupBy((F.col("part") < 8).alias("fit")).agg(F.min("y").alias("lo"), F.max("y").alias("hi")).collect()
    both = {r.fit for r in two if (r.lo, r.hi) == (0, 1)}
    if True not in both:
        return model
    gbt = GBTClassifier(labelCol="y", maxIter=how.rounds, maxDepth=how.depth, stepSize=0.2, minInstancesPerNode=2, seed=42)
    model.trees = gbt.fit(rest.where("part < 8").withColumn("features", array_to_vector("x")))
    if False in both:
        model.steps = IsotonicRegression(featuresCol="margin", labelCol="y").fit(model.margins(rest.where("part >= 8")))
    return model


def classify(docs: DataFrame, labels: DataFrame, how: Sampling = Sampling(), threshold: float = 0.3) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted and the features by name.

    Only the text is an input of the score.  Null, empty and blank texts have zero features and are scored like any other.
    Rows with null or equal doc_id are scored each; an empty table gives no rows.  Other columns play no part.
    """
    model = train(docs, labels, how)
    x = with_features(docs.select("doc_id", "text"), "text", model.lexicon)
    if model.trees is None:
        scored = x.withColumn("score", F.lit(model.prior))
    else:
        scored = model.margins(x)
        if model.steps is None:
            scored = scored.withColumn("score", 1 / (1 + F.exp(-2 * F.col("margin"))))
        else:
            scored = model.steps.setPredictionCol("score").transform(scored)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"),
        *[F.get("x", F.lit(k)).alias(n) for k, n in enumerate(NAMES)],
    )
