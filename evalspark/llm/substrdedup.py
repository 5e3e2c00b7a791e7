"""Substring dedup: word windows that start in a document with a smaller doc_id, removed as maximal spans.

A corpus-wide suffix automaton has no size bound, so the reference is cut into shards: one automaton per
reference passage, built where its queries are streamed.  Four steps lead there.

1. Exact copies of a text are settled by text hash; only the first document of each text goes on.
2. Anchors: of the 26 word 25-grams in a window of 50 words the one with the least hash.  Equal windows
   have equal anchors, so documents whose anchors all occur in one text only have nothing to remove.
3. The other documents' windows meet at their anchor; the first document of each window hash is found
   there.  Anchors in very many documents go by window hash with partial aggregation instead.
4. Runs of neighbouring windows with the same reference passage are verified: the passage's suffix
   automaton gives the matching statistics of the run's words, and stretches of at least 50 matching
   words are the spans removed.

Words are compared by 64-bit hash up to step 3 and as they are in step 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import cut, stored

WINDOW = 50
GRAM = 25
#: Rows of one anchor beyond which its windows are grouped by their own hash.
HOT_ANCHOR = 20_000
#: Rows of (doc_id, hash, kind) up to which the marks are broadcast (32 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
NO_ID = (1 << 63) - 1
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII blanks only


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * M1 + (b ^ (b >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words at each place, by doubling and one overlap."""
    n, cur, size = len(h) - k + 1, h, 1
    while 2 * size <= k:
        cur, size = mix(cur[:-size], cur[size:]), 2 * size
    return mix(cur[:n], cur[k - size : k - size + n]) if size < k else cur[:n]


def window_anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Anchor of each window of words: the least hash of its word grams (a sliding minimum by doubling)."""
    least, size, per = gram_hashes(h, gram), 1, window - gram + 1
    n = len(least) - per + 1
    while 2 * size <= per:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    return np.minimum(least[:n], least[per - size : per - size + n])


def build_automaton(words: list[bytes]) -> tuple[list[dict], list[int], list[int]]:
    """Suffix automaton of a word sequence: transitions, suffix links, longest lengths."""
    nxt, link, size, last = [{}], [-1], [0], 0
    for w in words:
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt, link, size


def matching_spans(words: list[bytes], automaton: tuple, window: int) -> list[tuple[int, int]]:
    """[start, end) spans of ``words`` covered by stretches of at least ``window`` words of the reference."""
    nxt, link, size = automaton
    spans: list[list[int]] = []
    state, length = 0, 0
    for i, w in enumerate(words):
        while state and w not in nxt[state]:
            state = link[state]
            length = size[state]
        if w in nxt[state]:
            state, length = nxt[state][w], length + 1
        if length >= window:
            start = i + 1 - length
            if spans and start <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])
    return [(a, b) for a, b in spans]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that what a task holds of whole texts is bounded."""
    for b in batches:
        for at in range(0, max(b.num_rows, 1), rows):
            yield b.slice(at, rows)


def first_windows(g: pd.DataFrame) -> pd.DataFrame:
    """Runs of windows (one anchor bucket) whose first document is another, smaller one."""
    sizes = g["wins"].map(len).to_numpy() // 8
    w = np.frombuffer(b"".join(g["wins"]), dtype=np.uint64)
    row = np.repeat(np.arange(len(g)), sizes)
    begin = np.cumsum(sizes) - sizes
    start = g["start"].to_numpy()[row] + np.arange(len(w)) - begin[row]
    doc, th = g["doc"].to_numpy()[row], g["th"].to_numpy()[row]
    order = np.lexsort((start, th, doc, w))
    w, start, doc, th = w[order], start[order], doc[order], th[order]
    head = np.ones(len(w), dtype=bool)
    head[1:] = w[1:] != w[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(w)), 0))
    own = np.nonzero(doc > doc[lead])[0]
    lead = lead[own]
    return merge_runs(doc[own], th[own], start[own], doc[lead], th[lead], start[lead])


def merge_runs(doc, th, start, ref, rth, rstart) -> pd.DataFrame:
    order = np.lexsort((start, th, doc))
    doc, th, start, ref, rth, rstart = (x[order] for x in (doc, th, start, ref, rth, rstart))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (
        (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (ref[1:] != ref[:-1]) | (rth[1:] != rth[:-1])
        | (start[1:] != start[:-1] + 1) | (rstart[1:] != rstart[:-1] + 1)
    )
    at = np.nonzero(new)[0]
    n = np.diff(np.append(at, len(doc)))
    return pd.DataFrame({"doc": doc[at], "th": th[at], "start": start[at], "n": n, "ref": ref[at], "rth": rth[at], "rstart": rstart[at]})


RUN = "doc long, th long, start long, n long, ref long, rth long, rstart long"


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, th, th2, text): a null doc_id sorts behind all others."""
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("th"),
        F.xxhash64(F.lit(1), "text").alias("th2"), "text",
    )


def _anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(a, th): the distinct anchors of each text."""
    split, anchors_of, hashes, pieces = split_words, window_anchors, word_hashes, slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found, owner = [], []
            for th, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = split(t.as_py())
                if len(w) < window:
                    continue
                h = hashes(w)
                a = np.unique(anchors_of(h, window, gram))
                found.append(a)
                owner.append(np.full(len(a), th, dtype=np.int64))
            if found:
                cols = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owner))]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "th"])

    return texts.select("th", "text").mapInArrow(run, "a long, th long")


def _window_rows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(a, doc, th, start, wins): neighbouring windows with one anchor, their hashes as packed 8-byte words."""
    split, anchors_of, hashes, grams, pieces = split_words, window_anchors, word_hashes, gram_hashes, slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "doc", "th", "start", "wins"]
        for b in pieces(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                w = split(t.as_py())
                if len(w) < window:
                    continue
                h = hashes(w)
                a = anchors_of(h, window, gram)
                raw = grams(h, window).tobytes()
                cuts = np.concatenate([[0], np.nonzero(a[1:] != a[:-1])[0] + 1, [len(a)]])
                out[0] += a[cuts[:-1]].view(np.int64).tolist()
                out[1] += [doc] * (len(cuts) - 1)
                out[2] += [th] * (len(cuts) - 1)
                out[3] += cuts[:-1].tolist()
                out[4] += [raw[8 * s : 8 * e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return texts.select("doc", "th", "text").mapInArrow(run, "a long, doc long, th long, start long, wins binary")


def _hot_runs(rows: DataFrame) -> DataFrame:
    """As ``first_windows`` for anchors of very many documents: first documents by partial aggregation."""
    places = F.sequence(F.lit(0), F.expr("int(octet_length(wins) / 8) - 1"))
    one = rows.select("doc", "th", "start", "wins", F.explode(places).alias("i")).select(
        "doc", "th", (F.col("start") + F.col("i")).alias("start"), F.expr("substring(wins, i * 8 + 1, 8)").alias("w")
    )
    first = one.groupBy("w").agg(F.min(F.struct("doc", "th", "start")).alias("f"), F.max("doc").alias("hi"))
    later = one.join(first.where(F.col("f.doc") < F.col("hi")), "w").where(F.col("doc") > F.col("f.doc"))
    r = later.select("doc", "th", "start", F.col("f.doc").alias("ref"), F.col("f.th").alias("rth"), F.col("f.start").alias("rstart"))
    same = ["doc", "th", "ref", "rth", "shift"]  # neighbouring windows on one shift are one run
    r = r.withColumn("shift", F.col("rstart") - F.col("start"))
    r = r.withColumn("k", F.col("start") - F.row_number().over(Window.partitionBy(*same).orderBy("start")))
    runs = r.groupBy(*same, "k").agg(F.min("start").alias("start"), F.count("*").alias("n"), F.min("rstart").alias("rstart"))
    return runs.select("doc", "th", "start", "n", "ref", "rth", "rstart")


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` marked for broadcast if their count is within the bound; else AQE joins them by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _marked(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """``texts`` left-joined with ``marks`` (doc, th, kind); broadcast only up to a checked number of rows."""
    return texts.join(_small(marks), ["doc", "th"], "left")


def _verified(need: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(doc, th, spans): removed word spans, by the suffix automata of the reference passages."""
    as_query = runs.select("doc", "th", "start", "n")
    as_reference = runs.select(F.col("ref").alias("doc"), F.col("rth").alias("th"), F.col("rstart").alias("start"), "n")
    wanted = as_query.unionByName(as_reference).groupBy("doc", "th").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))
    split, pieces = split_words, slices

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, th, t, cuts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                w = split(t)
                for c in cuts:
                    s, n = c["start"], c["n"]
                    for o, v in zip(out, (doc, th, s, n, b" ".join(w[s : s + n + window - 1])), strict=True):
                        o.append(v)
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc", "th", "start", "n", "words"])

    # repeated rows once; this deals the texts as the join does
    nth = F.row_number().over(Window.partitionBy("doc", "th").orderBy("th"))
    once = need.select("doc", "th", "text", nth.alias("nth")).where("nth = 1").drop("nth")
    cut_out = once.join(wanted, ["doc", "th"]).mapInArrow(
        passages, "doc long, th long, start long, n long, words binary"
    )
    keys = ["doc", "th", "start", "n"]
    parts = stored(cut_out)
    q = parts.withColumnRenamed("words", "q")
    r = parts.select(F.col("doc").alias("ref"), F.col("th").alias("rth"), F.col("start").alias("rstart"), "n", F.col("words").alias("r"))
    pairs = runs.join(q, keys).join(r, ["ref", "rth", "rstart", "n"]).select("doc", "th", "start", "q", "r")
    build, match = build_automaton, matching_spans

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[bytes, tuple] = {}
        for b in pieces(batches):
            out: list[list] = [[], [], [], []]
            for doc, th, start, words, ref in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if ref not in built:
                    if len(built) >= 16:
                        built.clear()
                    built[ref] = build(ref.split(b" "))
                for s, e in match(words.split(b" "), built[ref], window):
                    for o, v in zip(out, (doc, th, start + s, start + e), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc", "th", "s", "e"])

    spans = pairs.mapInArrow(verify, "doc long, th long, s long, e long")
    return spans.groupBy("doc", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<s:long,e:long>>"


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts_out: bool = True) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept (remaining words joined by one blank;
    with ``texts_out`` false its SHA-256) and the removed word spans.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller
    doc_id.  Null and empty texts and texts under ``window`` words lose nothing.  A null doc_id counts
    as larger than any other; rows with equal doc_id never remove each other's words, and repeated rows
    get equal results.
    """
    texts = _texts(docs)
    first = texts.groupBy("th", "th2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    firsts = cut(first)
    anchors = stored(_anchors(texts, window, gram))
    shared = cut(
        anchors.groupBy("a").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("a", "c")
    )
    hits = anchors.join(shared.select("a"), "a").select("th").distinct()
    need = firsts.join(hits, "th").select(F.col("least").alias("doc"), "th", F.lit("compare").alias("kind"))
    several = firsts.where(F.col("least") < F.col("most")).select("th", "th2", "least")
    narrow = texts.select("doc", "th", "th2")
    copies = narrow.join(several, ["th", "th2"]).where(F.col("doc") > F.col("least")).select("doc", "th", F.lit("copy").alias("kind")).distinct()
    marked = _marked(texts, cut(copies.unionByName(need.distinct())))
    compare = marked.where(F.col("kind") == "compare")
    rows = _window_rows(compare, window, gram)
    hot = shared.where(F.col("c") > HOT_ANCHOR).select("a")
    groups = max(1, anchors.count() // 20_000)
    work = first_windows

    def by_bucket(g: pd.DataFrame) -> pd.DataFrame:
        return work(g)

    bucket = F.pmod(F.xxhash64("a"), F.lit(groups))
    if hot.isEmpty():
        runs = rows.groupBy(bucket).applyInPandas(by_bucket, RUN)
    else:
        light = rows.join(_small(hot), "a", "left_anti")
        runs = light.groupBy(bucket).applyInPandas(by_bucket, RUN).unionByName(_hot_runs(rows.join(_small(hot), "a", "left_semi")))
    spans = _verified(compare, cut(runs), window)
    split, pieces = split_words, slices

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, kind, t, cuts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                w = split(t)
                n = len(w)
                gone: list[list[int]] = []
                if kind == "copy" and n >= window:
                    gone = [[0, n]]
                for c in sorted((c["s"], c["e"]) for c in cuts or ()):
                    if gone and c[0] <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], c[1])
                    else:
                        gone.append(list(c))
                at, kept = 0, []
                for s, e in gone:
                    kept += w[at:s]
                    at = e
                kept += w[at:]
                text = b" ".join(kept)
                shown = text.decode("utf-8", "surrogatepass") if texts_out else hashlib.sha256(text).hexdigest()
                row = (None if doc == NO_ID else doc, n, n - len(kept), shown, [{"s": s, "e": e} for s, e in gone])
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
            names = ["doc_id", "n_words", "n_removed", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    no_spans = F.lit(None).cast("array<struct<s:long,e:long>>").alias("spans")
    compared = compare.join(spans, ["doc", "th"], "left").select("doc", "kind", "text", "spans")
    others = marked.where(F.coalesce(F.col("kind"), F.lit("")) != "compare").select("doc", "kind", "text", no_spans)
    return compared.mapInArrow(finish, RESULT).unionByName(others.mapInArrow(finish, RESULT))
