"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  A line's score comes from its own features and those of its neighbours, and
a transition matrix ties neighbouring labels.  Training labels every line of a sampled document with the
document's label and maximises the conditional likelihood; scoring averages the forward-backward
marginals of the lines, weighted by length, and calibrates that share on the sample.  The model is a few
hundred numbers; documents are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import hashed_sample

#: Classes of bytes counted in a line.
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&|<>@^~=+\\{}[]_"
STOPS = b".,;:!?"
N_FEATURES = 13


@dataclass(frozen=True)
class Sampling:
    """Bounds of what training reads to the driver: labelled documents, lines of a document, text bytes."""

    documents: int = 3_000
    max_lines: int = 128
    max_bytes: int = 65_536
    iterations: int = 120


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, byte lengths) of the lines that hold a word; no such line: zero rows."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        w = line.split()
        if not w:
            continue
        n, size = len(w), len(line)
        chars = max(1, len(b"".join(w)))
        same = sum(a == b for a, b in zip(w, w[1:], strict=False))
        letters = size - len(line.translate(None, LETTERS))
        rows.append(
            (
                np.log1p(n),
                chars / n / 10,
                letters / chars,
                (size - len(line.translate(None, UPPER))) / max(1, letters),
                (size - len(line.translate(None, DIGITS))) / chars,
                (size - len(line.translate(None, SYMBOLS))) / n,
                (size - len(line.translate(None, STOPS))) / n,
                line.count(b"!") / n,
                line.count(b"|") / n,
                same / n,
                len(set(w)) / n,
                float(line in seen),
                max(map(len, w)) / 40,
            )
        )
        seen.add(line)
        sizes.append(size)
    return np.array(rows, dtype=np.float32).reshape(-1, N_FEATURES), np.array(sizes, dtype=np.float64)


def with_neighbours(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features of a line, the line before and the line after (zeros at the ends), and 1."""
    z = (x - mean) / scale
    out = np.zeros((len(z), 3 * N_FEATURES + 1))
    out[:, :N_FEATURES] = z
    out[1:, N_FEATURES : 2 * N_FEATURES] = z[:-1]
    out[:-1, 2 * N_FEATURES : 3 * N_FEATURES] = z[1:]
    out[:, -1] = 1
    return out


def padded(scores: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of like length together: (documents, line places, node scores [documents, lines])."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    width = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for k in np.unique(width[lengths > 0]):
        own = np.nonzero((width == k) & (lengths > 0))[0]
        for part in np.array_split(own, max(1, len(own) * (1 << k) // 2_000_000 + 1)):
            if not len(part):
                continue
            t = np.arange(lengths[part].max())
            at = first[part][:, None] + np.minimum(t[None, :], lengths[part][:, None] - 1)
            yield part, at, scores[at]


def forward_backward(node: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1 [documents, lines], expected transitions [2, 2] and log partition [documents].

    ``node`` is the score of label 1 (label 0 scores 0); places behind a document's end pass through.
    """
    d, t = node.shape
    live = np.arange(t)[None, :] < lengths[:, None]
    a, b = np.zeros((d, t, 2)), np.zeros((d, t, 2))
    a[:, 0, 1] = node[:, 0]
    for i in range(1, t):
        m = np.logaddexp(a[:, i - 1, 0, None] + trans[0], a[:, i - 1, 1, None] + trans[1])
        m[:, 1] += node[:, i]
        a[:, i] = np.where(live[:, i, None], m, a[:, i - 1])
    for i in range(t - 2, -1, -1):
        nxt = b[:, i + 1] + np.stack([np.zeros(d), node[:, i + 1]], axis=1)
        m = np.logaddexp(trans[None, :, 0] + nxt[:, 0, None], trans[None, :, 1] + nxt[:, 1, None])
        b[:, i] = np.where(live[:, i + 1, None], m, 0.0)
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    p = np.exp(np.clip(a[:, :, 1] + b[:, :, 1] - z[:, None], -700, 0)) * live
    pair = np.zeros((2, 2))
    if t > 1:
        for y in (0, 1):
            for v in (0, 1):
                s = a[:, :-1, y] + trans[y, v] + (node[:, 1:] if v else 0) + b[:, 1:, v] - z[:, None]
                pair[y, v] = (np.exp(np.clip(s, -700, 0)) * live[:, 1:]).sum()
    return p, pair, z


def good_share(x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of the label good per document; without lines: 0.5."""
    out = np.full(len(lengths), 0.5)
    node = x @ w if len(x) else np.zeros(0)
    for docs, at, n in padded(node, lengths):
        p, _, _ = forward_backward(n, lengths[docs], trans)
        live = np.arange(n.shape[1])[None, :] < lengths[docs][:, None]
        weight = sizes[at] * live
        out[docs] = (p * weight).sum(axis=1) / weight.sum(axis=1)
    return out


def fit(x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node weights, transitions, calibration) by Adam on the mean log-likelihood with a small ridge."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    line_y = np.repeat(y, lengths).astype(float)
    steps = np.maximum(lengths - 1, 0)
    seen = np.array([[steps[y == 0].sum(), 0.0], [0.0, steps[y == 1].sum()]])
    m, v, n = np.zeros(len(w) + 4), np.zeros(len(w) + 4), max(1, int(lengths.sum()))
    for r in range(1, rounds + 1):
        node, p, pair = x @ w, np.zeros(len(x)), np.zeros((2, 2))
        for docs, at, s in padded(node, lengths):
            q, e, _ = forward_backward(s, lengths[docs], trans)
            live = np.arange(s.shape[1])[None, :] < lengths[docs][:, None]
            p[at[live]] = q[live]
            pair += e
        g = np.concatenate([x.T @ (line_y - p) / n - 1e-4 * w, ((seen - pair) / n - 1e-4 * trans).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        w, trans = w + step[:-4], trans + step[-4:].reshape(2, 2)
    share = np.log((c := np.clip(good_share(x, sizes, lengths, w, trans), 1e-6, 1 - 1e-6)) / (1 - c))
    ab = np.zeros(2)
    z = np.stack([share, np.ones(len(share))], axis=1)
    for _ in range(30):  # Newton steps with a ridge, so that separable samples stay finite
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * len(y) / 1000 * np.eye(2) + 1e-6 * np.eye(2)
        ab = ab + np.linalg.solve(h, z.T @ (y - p) - 1e-2 * len(y) / 1000 * ab)
    return w, trans, ab


def held_out_column(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, how: Sampling) -> list:
    """About ``how.documents`` labelled rows outside the held-out fold, chosen by a hash of doc_id.

    A doc_id with several labels counts as good if any of them says so; null labels are left out.
    """
    lab = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_column("doc_id"))
    per_doc = lab.groupBy("doc_id").agg(F.max("quality").alias("y"))
    picked = hashed_sample(per_doc, ["doc_id"], how.documents).limit(2 * how.documents)
    d = docs.select("doc_id", "text").where(F.octet_length("text") <= how.max_bytes)
    rows = d.join(F.broadcast(picked), "doc_id").limit(4 * how.documents).collect()
    return sorted(rows, key=lambda r: (r.doc_id, r.text))


def train(docs: DataFrame, labels: DataFrame, how: Sampling = Sampling()) -> dict:
    """The model.  Without labels, or with one class only, every document scores the sample's mean (0.5 without any)."""
    xs, sizes, y = [], [], []
    for r in training_sample(docs, labels, how):
        x, s = line_features(r.text)
        if len(x) <= how.max_lines:
            xs.append(x), sizes.append(s), y.append(r.y)
    y = np.array(y, dtype=float)
    prior = float(y.mean()) if len(y) else 0.5
    flat = np.concatenate(xs) if xs else np.zeros((0, N_FEATURES), dtype=np.float32)
    if not len(flat) or prior in (0.0, 1.0):
        return {"prior": prior, "w": None}
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    lengths = np.array([len(x) for x in xs])
    x = np.concatenate([with_neighbours(a, mean, scale) for a in xs])
    w, trans, ab = fit(x, np.concatenate(sizes), lengths, y, how.iterations)
    return {"prior": prior, "w": w, "trans": trans, "ab": ab, "mean": mean, "scale": scale}


def score_texts(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, good share of the text, lines) of each text; texts without lines score the prior."""
    if model["w"] is None:
        lines = [len(line_features(t)[0]) for t in texts]
        return np.full(len(texts), model["prior"]), np.full(len(texts), 0.5), np.array(lines)
    pairs = [line_features(t) for t in texts]
    lengths = np.array([len(x) for x, _ in pairs], dtype=np.int64)
    parts = [with_neighbours(x, model["mean"], model["scale"]) for x, _ in pairs if len(x)]
    x = np.concatenate(parts) if parts else np.zeros((0, 3 * N_FEATURES + 1))
    sizes = np.concatenate([s for _, s in pairs]) if pairs else np.zeros(0)
    share = good_share(x, sizes, lengths, model["w"], model["trans"])
    c = np.clip(share, 1e-6, 1 - 1e-6)
    z = np.log(c / (1 - c)) * model["ab"][0] + model["ab"][1]
    score = np.where(lengths > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), model["prior"])
    return score, share, lengths


def classify(docs: DataFrame, labels: DataFrame, how: Sampling = Sampling(), threshold: float = 0.3) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, good_share, n_lines.

    Only the text is an input of the score.  Null, empty and blank texts have no lines and score the
    sample's share of good labels.  Repeated rows are scored each; an empty table gives no rows.
    """
    model = train(docs, labels, how)
    work = score_texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                score, share, lines = work(part.column(2).to_pylist(), model)
                cols = [part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(share), pa.array(lines.astype(np.int64))],
                    names=["doc_id", "held_out", "score", "predicted", "good_share", "n_lines"],
                )

    rows = docs.select("doc_id", held_out_column("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, good_share double, n_lines long")
