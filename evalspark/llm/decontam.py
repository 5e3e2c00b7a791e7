"""Benchmark decontamination by the q-gram lemma: diagonal bands of shared q-grams, then banded alignment.

Texts and items are compared as UTF-8 bytes, A-Z lower-cased and runs of ASCII blanks made one space.
A document holds an item if some window of min(``window``, item length) bytes of the item lies within
floor(``edit_rate`` * window) edits of a substring of the document.  Such a window shares at least
w + 1 - q (e + 1) q-grams with that substring, all on diagonals at most 2 e apart.  Bands are 2 (2 e + 1)
diagonals wide and overlap by half, so one band holds them all: bands below the bound are dropped
without loss, the others are verified by alignment inside the band.

The benchmark travels to the tasks in shards of at most ``SHARD_BYTES``; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 8 << 20
CHUNK = 1 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MATCH = "doc_id long, item_id long, shared_grams long, edits int, match_start long, match_end long"


@dataclass(frozen=True)
class Leak:
    """q-gram length (8 to 16 bytes), window and edit rate; items under ``min_bytes`` are no evidence."""

    q: int = 10
    window: int = 100
    edit_rate: float = 0.08
    min_bytes: int = 40


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def gram_hashes(buf: bytes, q: int, start: int, stop: int) -> np.ndarray:
    """64-bit mix of the q bytes at each position of [start, stop)."""
    n = stop - start
    a = np.ndarray((n,), dtype="<u8", buffer=buf, offset=start, strides=(1,))
    b = np.ndarray((n,), dtype="<u8", buffer=buf, offset=start + q - 8, strides=(1,))
    h = a * M1
    return h ^ ((b * M2) >> np.uint64(7)) if q > 8 else h


@dataclass
class Index:
    """The q-grams of a benchmark shard with the places (item, offset) of each."""

    rule: Leak
    ids: list[int]
    items: list[bytes]
    grams: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    item_at: np.ndarray = field(init=False)
    offset_at: np.ndarray = field(init=False)
    seen: np.ndarray = field(init=False)
    edits: np.ndarray = field(init=False)
    need: np.ndarray = field(init=False)
    width: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        q = self.rule.q
        w = np.array([min(self.rule.window, len(x)) for x in self.items], dtype=np.int64)
        self.edits = np.floor(self.rule.edit_rate * w).astype(np.int64)
        self.need = np.maximum(1, w + 1 - q * (self.edits + 1))
        self.width = 2 * self.edits + 1
        hashes = [gram_hashes(x, q, 0, len(x) - q + 1) for x in self.items]
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(self.items)), [len(x) for x in hashes])
        offset = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, dtype=np.int64)
        order = np.argsort(h, kind="stable")
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.first = np.append(self.first, len(h))
        self.item_at, self.offset_at = item[order], offset[order]
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in buf, item, offset in item) of every shared q-gram."""
        q, out = self.rule.q, []
        for s in range(0, len(buf) - q + 1, CHUNK):
            h = gram_hashes(buf, q, s, min(s + CHUNK, len(buf) - q + 1))
            at = np.nonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])[0]
            g = np.searchsorted(self.grams, h[at])
            g[g == len(self.grams)] = 0
            real = self.grams[g] == h[at]
            at, g = at[real] + s, g[real]
            n = self.first[g + 1] - self.first[g]
            places = np.repeat(self.first[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append((np.repeat(at, n), self.item_at[places], self.offset_at[places]))
        if not out:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_edits(item: bytes, doc: bytes, windows: np.ndarray, low: int, high: int, w: int, e: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best of the w-byte ``windows`` (offsets in ``item``) against ``doc`` from diagonals
    [low, high): banded edit distance, free to start on any of them and to drift by e."""
    k = np.arange(low - e, high + e)
    text = np.frombuffer(doc, dtype=np.uint8)
    own = np.frombuffer(item, dtype=np.uint8)
    far = 10 * (w + 1)
    cost = np.where((k >= low) & (k < high), 0, far)[None, :].repeat(len(windows), axis=0)
    start = windows[:, None] + k[None, :]
    cost = np.where((start < 0) | (start > len(text)), far, cost)
    ramp = np.arange(len(k))
    for i in range(w):
        pos = start + i
        inside = (pos >= 0) & (pos < len(text))
        same = inside & (text[np.clip(pos, 0, max(len(text) - 1, 0))] == own[windows + i][:, None]) if len(text) else inside
        across = np.where(inside, cost + ~same, far)
        skip_item = np.concatenate([cost[:, 1:], np.full((len(windows), 1), far)], axis=1) + 1
        best = np.minimum(across, skip_item)
        # document bytes without an item byte: one diagonal further for one edit each
        cost = np.minimum.accumulate(best - ramp, axis=1) + ramp
        past = start + i + 1 > len(text)
        cost = np.where(past, far, cost)
    row, col = np.unravel_index(np.argmin(cost), cost.shape)
    end = int(windows[row] + k[col] + w)
    return int(cost[row, col]), max(0, end - w), end


def find(index: Index, docs: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, shared grams, edits, start, end), one per matching pair."""
    if not index.items or not docs:
        return []
    gap = b"\n" * 16  # no normalised text holds it, so no q-gram of an item spans two documents
    buf = gap.join(docs) + gap
    starts = np.cumsum([0] + [len(d) + len(gap) for d in docs[:-1]])
    pos, item, offset = index.hits(buf)
    doc = np.searchsorted(starts, pos, side="right") - 1
    diagonal = pos - starts[doc] - offset
    width = index.width[item]
    base = diagonal // width
    # band b covers diagonals [b * width, (b + 2) * width); every hit lies in two of them
    d2, i2, b2 = np.tile(doc, 2), np.tile(item, 2), np.concatenate([base, base - 1])
    g2 = np.tile(diagonal, 2)
    order = np.lexsort((g2, b2, i2, d2))
    d2, i2, b2, g2 = d2[order], i2[order], b2[order], g2[order]
    p2 = np.tile(offset, 2)[order]
    new = np.ones(len(d2), dtype=bool)
    new[1:] = (d2[1:] != d2[:-1]) | (i2[1:] != i2[:-1]) | (b2[1:] != b2[:-1])
    first = np.append(np.nonzero(new)[0], len(d2))
    count = np.diff(first)
    kept = np.nonzero(count >= index.need[i2[first[:-1]]])[0] if len(count) else []
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for r in kept:
        a, z = first[r], first[r + 1]
        key = (int(d2[a]), int(i2[a]))
        if key in best and best[key][0] == 0:
            continue
        found = _verify(index, docs[key[0]], key[1], int(b2[a]), g2[a:z], p2[a:z])
        if found and (key not in best or found[0] < best[key][0]):
            best[key] = (found[0], int(z - a), found[1], found[2])
    return [(d, i, n, e, s, t) for (d, i), (e, n, s, t) in sorted(best.items())]


def _verify(index: Index, doc: bytes, i: int, band: int, diagonals: np.ndarray, offsets: np.ndarray) -> tuple[int, int, int] | None:
    item, e, width = index.items[i], int(index.edits[i]), int(index.width[i])
    w, q = min(index.rule.window, len(item)), index.rule.q
    # w - q + 1 neighbouring q-grams on one diagonal are an exact window
    d, n = np.unique(diagonals, return_counts=True)
    for x in d[n >= w - q + 1]:
        at = np.sort(offsets[diagonals == x])
        runs = np.split(at, np.nonzero(np.diff(at) != 1)[0] + 1)
        longest = max(runs, key=len)
        if len(longest) >= w - q + 1:
            s, t = int(longest[0]), int(longest[-1]) + q
            if doc[x + s : x + t] == item[s:t]:
                return 0, int(x) + s, int(x) + t
    # the bound holds for each window by itself: only windows with enough shared q-grams are aligned
    own = np.unique(offsets)
    a = np.arange(len(item) - w + 1)
    count = np.searchsorted(own, a + w - q, side="right") - np.searchsorted(own, a)
    a = a[count >= index.need[i]]
    if not len(a):
        return None
    low = band * width
    edits, s, t = window_edits(item, doc, a, low, low + 2 * width, w, e)
    return (edits, s, t) if edits <= e else None


def shards_of(benchmark: DataFrame, rule: Leak) -> list[tuple[list[int], list[bytes]]]:
    """The benchmark (item_id, text) as (ids, normalised texts) of at most about ``SHARD_BYTES`` each;
    each task makes the ``Index`` of a shard once.

    Null, empty and short items (under ``rule.min_bytes`` normalised bytes) are left out.
    """
    total = benchmark.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // SHARD_BYTES) or 1
    out = []
    for k in range(n):
        own = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).select("item_id", "text").collect()
        rows = [(r.item_id, normalise(r.text)) for r in own]
        rows = [(a, b) for a, b in rows if len(b) >= max(rule.min_bytes, rule.q)]
        out.append(([a for a, _ in rows], [b for _, b in rows]))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rule: Leak = Leak()) -> DataFrame:
    """One row (columns ``MATCH``) per document row and benchmark item that it holds.

    shared_grams: q-grams in the best band; edits: the fewest found (0: an exact window); match_start,
    match_end: bytes in the normalised text.  Null and empty texts, an empty table or benchmark: no rows.
    Repeated rows are reported each; a null doc_id is reported as null.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select("doc_id", "text")
    make, search, clean = Index, find, normalise
    for shard in shards_of(benchmark, rule):
        shared = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = make(rule, *shared.value)
            for b in batches:
                texts = [clean(t.as_py()) for t in b.column(1)]
                found = search(index, texts)
                ids = b.column(0).to_pylist()
                cols = [
                    pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([index.ids[f[1]] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int32()),
                    pa.array([f[4] for f in found], pa.int64()), pa.array([f[5] for f in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "shared_grams", "edits", "match_start", "match_end"])

        part = rows.mapInArrow(run, MATCH)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rule: Leak = Leak()) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns and row places unchanged."""
    at = docs.columns.index("text")
    make, search, clean = Index, find, normalise
    for shard in shards_of(benchmark, rule):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = make(rule, *shared.value)
            for b in batches:
                held = {f[0] for f in search(index, [clean(t.as_py()) for t in b.column(at)])}
                yield b.filter(pa.array([i not in held for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
