"""Toxicity: features by hand, held-out accuracy on planted documents, edge rows."""

import random
import zlib

import numpy as np
import pytest

from evalspark.llm import toxicity
from evalspark.llm.toxicity import NAMES, Attributes, Sampling, classify, features, plain

DOC = "doc_id long, text string, lang string, source string, n_chars long, x int, y string, score string"


def row(text, lexicon=None):
    return dict(zip(NAMES, features([text], Attributes(lexicon or {}))[0]))


def test_plain_words():
    assert plain("Idiot!!")[0] == "idiot" and plain("1d10t") == ("idiot", True, False)
    assert plain("st*pid") == ("stpid", True, False) and plain("m0r0n")[0] == "moron" and plain("$tupid")[0] == "tupid"
    assert plain("looooser") == ("loser", False, True) and plain("the&&&") == ("the", False, False) and plain("don't")[1] is False
    assert plain("###") == ("", False, False)


def test_features_by_hand():
    f = row("You are a STUPID m0r0n!! Really? #x it is fine and far away from there idiot")
    n = 16
    assert f["log_words"] == pytest.approx(np.log1p(n)) and f["seed_rate"] == pytest.approx(3 / n)
    assert f["near_second"] == pytest.approx(2 / 3) and f["second_rate"] == pytest.approx(1 / n)
    assert f["shouted_rate"] == pytest.approx(1 / n) and f["exclaimed_rate"] == pytest.approx(2 / n) and f["asked_rate"] == pytest.approx(1 / n)
    assert f["doubled_rate"] == pytest.approx(1 / n) and f["symbol_rate"] == pytest.approx(1 / n)
    assert f["disguised_rate"] == pytest.approx(1 / n) and f["disguised_lexicon_rate"] == pytest.approx(1 / n)
    learned = row("zorkig zorkun fine", {"zork": 3.0, "=fine": 1.0})
    assert learned["lexicon_rate"] == pytest.approx(1) and learned["lexicon_most"] == 3 and learned["lexicon_weight"] == pytest.approx(7 / 3)
    assert not any(row("").values()) and not any(row(None).values()) and not any(row(" \n\t").values())


def test_features_do_not_depend_on_company(monkeypatch):
    texts = ["you idiot", None, "fine words here", "a b c " * 500, "you idiot"]
    alone = np.concatenate([features([t], Attributes({"fine": 2.0})) for t in texts])
    words = Attributes({"fine": 2.0})
    assert np.array_equal(features(texts, words), alone) and np.array_equal(features(texts[::-1], words), alone[::-1])


def planted(n, seed=1):
    """Invented words in two languages; a toxic document has a few of ten insults or of words with two invented stems."""
    rng = random.Random(seed)
    part = ["ka", "lo", "mi", "ren", "tu", "sol", "ver", "an"]
    bad = ["idiot", "Moron!", "worthless", "scum", "gorbal", "gorbalen", "gorbalto", "vixtan", "vixtaro", "vixtami"]
    docs, labels = [], []
    for k in range(n):
        w = ["".join(rng.choice(part) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 150))]
        toxic = int(k % 8 == 0)
        if toxic:
            for _ in range(rng.randint(2, 8)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((k, " ".join(w), "en", "s", 1, 1, "y", "z"))
        labels.append((k, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = planted(1600)
    extra = [(None, "you idiot scum", "en", None, None, 1, "", ""), (None, None, None, None, None, 1, "", ""), (5000, "", "en", "s", 0, 1, "", "")]
    extra += [(5001, " \n ", "en", "s", 0, 1, "", ""), (8, docs[8][1], "en", "s", 1, 1, "", ""), (5002, "kalo miren " * 30_000, "en", "s", 1, 1, "", "")]
    lab = labels + [(16, 1, 0), (None, 1, 1), (24, None, None), (9999, 0, 1)]
    return spark.createDataFrame(docs + extra, DOC), spark.createDataFrame(lab, "doc_id long, quality int, toxic int"), labels


def test_held_out_documents_are_told_apart(spark, frames):
    docs, labels, truth = frames
    rows = classify(docs, labels).collect()
    assert len(rows) == 1606
    y = {i: t for i, _, t in truth}
    for r in rows:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert len(held) > 300
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.predicted for r in held if y[r.doc_id]]) > 0.9
    again = {(r.doc_id, r.score) for r in classify(docs, labels).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}
    blank = {r.score for r in rows if r.doc_id in (5000, 5001)}
    assert len(blank) == 1 and blank.pop() < 0.3
    twice = [r.score for r in rows if r.doc_id == 8]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_lexicon_holds_words_and_stems(spark, frames):
    docs, labels, _ = frames
    rows = docs.join(labels.where("toxic is not null"), "doc_id").selectExpr("toxic AS y", "text")
    lex = toxicity.learn_lexicon(rows, Sampling())
    assert {"=idiot", "=moron", "gorb", "vixta"} <= set(lex) and all(v > 1 for v in lex.values())
    assert len(toxicity.learn_lexicon(rows, Sampling(terms=3))) == 3


def test_labels_of_the_held_out_fold_are_never_read(spark, frames):
    docs, labels, _ = frames
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, r.score) for r in classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_without_labels_or_with_one_class(spark, frames):
    docs, labels, _ = frames
    few = docs.where("doc_id < 40")
    assert {r.score for r in classify(few, labels.where("toxic = 5")).collect()} == {0.5}
    assert {r.score for r in classify(few, labels.where("toxic = 0")).collect()} == {0.0}
    assert classify(spark.createDataFrame([], DOC), labels).count() == 0
