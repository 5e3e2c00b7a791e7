"""SimHash near-dedup: fingerprints, a forest of vantage-point trees for Hamming search, components.

By the pigeonhole principle a pair that differs in at most k bits differs in at most k // m bits inside
one of m bit blocks.  Each block has its own vantage-point tree under the block's Hamming distance (a
pseudo-metric that never exceeds the full one), built on the driver from a bounded sample; a
fingerprint's leaf is its shard.  With radius r = k // m in the block, the triangle inequality lets a
query skip the inner branch of a node if d - r > mu and the outer one if d + r <= mu; a query near a
boundary visits both shards.  With the default m = k + 1 blocks r is 0 and every query visits one shard
per tree.  Inside a shard all pairs are checked on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import P, cut, hashed_sample
from evalspark.llm.graph import components

#: Bounds of what the driver sees and of one group's work.
SAMPLE = 32_768
LEAF = 1_024
CHUNK = 4_096


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles (A-Z lower-cased, repeats included; XXH64, seed 42)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII blanks
    if not w:
        return 0
    if len(w) < shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*[w[i:] for i in range(shingle)], strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 65_536):
        bits = np.unpackbits(h[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, shingle: int = 4) -> DataFrame:
    """``rows`` with its ``text`` replaced by ``fp`` (the fingerprint's bits as a signed long)."""
    schema = rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema
    own = fingerprint

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            fps = np.fromiter((own(t.as_py(), shingle) for t in b.column(i)), dtype=np.uint64, count=b.num_rows)
            cols = [b.column(j) for j in range(b.num_columns) if j != i]
            names = [n for j, n in enumerate(b.schema.names) if j != i]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], names=[*names, "fp"])

    return rows.mapInArrow(run, schema)


def masks(max_bits: int, blocks: int) -> list[int]:
    """Bit masks of ``blocks`` blocks of nearly equal width."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def sub_metrics(max_bits: int, n: int) -> tuple[list[int], int]:
    """Masks and radius for ``n`` fingerprints.

    m = max_bits + 1 blocks leave one block equal.  When a block has too few bits to tell n
    fingerprints apart, more blocks are cut and every choice of m - max_bits of them is a mask: two
    fingerprints within max_bits agree on one of those choices.
    """
    m = max_bits + 1
    while m < 64 and (1 << (64 * (m - max_bits) // m)) * LEAF < n:
        m += 1
    blocks = masks(max_bits, m)
    return [sum(c) for c in combinations(blocks, m - max_bits)], 0


def vantage_tree(sample: np.ndarray, mask: int, leaf: int, seed: int) -> np.ndarray:
    """Nodes as rows (vantage, mu, inner, outer); a leaf has mu -1 and its number in ``inner``.

    The vantage point of a node is a sample point, mu the median of its distances; a node whose points
    are all at one distance is tried with other vantage points and else becomes a leaf.
    """
    rng = np.random.default_rng(seed)
    nodes: list[list[int]] = []
    leaves = 0
    todo = [(np.unique(sample & np.uint64(mask)) if leaf <= 1 else sample & np.uint64(mask), None, 0)]
    while todo:
        pts, parent, side = todo.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side] = me
        split = None
        if len(pts) > leaf:
            for v in rng.choice(pts, size=min(8, len(pts)), replace=False):
                d = np.bitwise_count(pts ^ v)
                mu = int(np.median(d))
                inner = d <= mu
                if inner.all():
                    mu -= 1
                    inner = d <= mu
                if 0 < inner.sum() < len(pts):
                    split = int(v), mu, inner
                    break
        if split is None:
            nodes.append([0, -1, leaves, 0])
            leaves += 1
        else:
            nodes.append([split[0], split[1], 0, 0])
            todo += [(pts[~split[2]], me, 3), (pts[split[2]], me, 2)]
    out = np.zeros((len(nodes), 4), dtype=np.uint64)
    for i, (v, mu, a, b) in enumerate(nodes):
        out[i] = (v, np.uint64(mu & 0xFFFFFFFFFFFFFFFF), a, b)
    return out


def route(fps: np.ndarray, mask: int, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the shards that each fingerprint must be compared in, its own one marked."""
    mu_of, inner, outer = tree[:, 1].view(np.int64), tree[:, 2].astype(np.int64), tree[:, 3].astype(np.int64)
    row, node, home = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), np.ones(len(fps), dtype=bool)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(row):
        at_leaf = mu_of[node] < 0
        done.append((row[at_leaf], inner[node[at_leaf]], home[at_leaf]))
        row, node, home = row[~at_leaf], node[~at_leaf], home[~at_leaf]
        d = np.bitwise_count((fps[row] ^ tree[node, 0]) & np.uint64(mask)).astype(np.int64)
        mu = mu_of[node]
        go_in, go_out = d - radius <= mu, d + radius > mu
        row, node, home = (
            np.concatenate([row[go_in], row[go_out]]),
            np.concatenate([inner[node[go_in]], outer[node[go_out]]]),
            np.concatenate([home[go_in] & (d <= mu)[go_in], home[go_out] & (d > mu)[go_out]]),
        )
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def linked_stars(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Edges (member, least member) that connect whatever pairs of ``a`` × ``b`` within ``max_bits`` connect.

    Pairs are found block by block and folded at once into labels, so a dense group yields one edge per
    member.  Signed longs in, rows (u, v) out.
    """
    pts = np.unique(np.concatenate([a, b]))
    label = np.arange(len(pts))
    ia, ib = np.searchsorted(pts, a), np.searchsorted(pts, b)
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    pairs = []
    for s in range(0, len(ua), 256):
        x, y = np.nonzero(np.bitwise_count(ua[s : s + 256, None] ^ ub[None, :]) <= max_bits)
        u, v = ia[s + x], ib[y]
        keep = u < v
        if not keep.any():
            continue
        pairs.append(np.stack([u[keep], v[keep]]))
        if sum(p.shape[1] for p in pairs) > 1_000_000:
            pairs = [_fold(label, np.concatenate(pairs, axis=1))]
    if pairs:
        _fold(label, np.concatenate(pairs, axis=1))
    moved = np.nonzero(label != np.arange(len(pts)))[0]
    return np.stack([pts[moved], pts[label[moved]]], axis=1)


def _fold(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Lower ``label`` in place until the pairs' ends agree (min-label with pointer jumping)."""
    u, v = pairs
    while True:
        lu, lv = label[u], label[v]
        low = np.minimum(lu, lv)
        if (lu == lv).all():
            return np.zeros((2, 0), dtype=np.int64)
        for end in (u, v, lu, lv):
            np.minimum.at(label, end, low)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label[:] = nxt


def near_links(distinct: DataFrame, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """(u, v): star edges between distinct fingerprints (column ``fp``) whose components are those of
    all pairs within ``max_bits``.

    ``blocks`` fixes the number of blocks (fewer than max_bits + 1 give a radius above 0 and shards
    that overlap at their boundaries).  A leaf of more than ``CHUNK`` fingerprints is cut into hashed
    chunks, and each pair of chunks is a task of its own.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if blocks:
        mask_list, radius = masks(max_bits, blocks), max_bits // blocks
    else:
        mask_list, radius = sub_metrics(max_bits, n)
    # bounded: about SAMPLE fingerprints chosen by hash, only to choose vantage points and medians
    few = hashed_sample(distinct.select("fp"), ["fp"], SAMPLE, n).limit(2 * SAMPLE)
    sample = np.array(sorted(r.fp for r in few.collect()), dtype=np.int64)
    per_leaf = max(1, int(LEAF * len(sample) / max(n, 1)))
    trees = spark.sparkContext.broadcast(
        [vantage_tree(sample.view(np.uint64), m, per_leaf, i) for i, m in enumerate(mask_list)]
    )
    to_shards = route

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for t, (m, tree) in enumerate(zip(mask_list, trees.value, strict=True)):
                row, leaf, home = to_shards(fps.view(np.uint64), m, tree, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), t, dtype=np.int32)), pa.array(leaf), pa.array(home), pa.array(fps[row])],
                    names=["tree", "leaf", "home", "fp"],
                )

    routed = cut(distinct.select("fp").mapInArrow(shards, "tree int, leaf long, home boolean, fp long"))
    sizes = routed.groupBy("tree", "leaf").agg(F.count("*").alias("c"))
    heavy = sizes.where(F.col("c") > CHUNK).select("tree", "leaf", F.ceil(F.col("c") / CHUNK).cast("int").alias("s"))
    salted = routed.join(heavy, ["tree", "leaf"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("s")).cast("int")
    # chunk c meets every chunk d: in task (c, d) if c <= d, else (d, c)
    others = F.transform(
        F.sequence(F.lit(0), F.col("s") - 1), lambda d: F.struct(F.least(d, F.col("c")).alias("i"), F.greatest(d, F.col("c")).alias("j"))
    )
    tasks = salted.withColumn("c", chunk).select("tree", "leaf", "fp", "home", "c", F.explode(others).alias("t"))
    edges_of = linked_stars

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        i, j = key[2], key[3]
        fp, c, home = g["fp"].to_numpy(), g["c"].to_numpy(), g["home"].to_numpy()
        if i == j:
            e = edges_of(fp[home], fp, max_bits) if radius else edges_of(fp, fp, max_bits)
        else:
            e = edges_of(fp[c == i], fp[c == j], max_bits)
            e2 = edges_of(fp[c == j], fp[c == i], max_bits)
            e = np.concatenate([e, e2])
        return pd.DataFrame({"u": e[:, 0], "v": e[:, 1]})

    return tasks.groupBy("tree", "leaf", F.col("t.i").alias("i"), F.col("t.j").alias("j")).applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, fp, text_hash (XXH64 of the text) and component_id, the least
    doc_id in the component of fingerprints linked at ``max_bits`` or fewer bits.

    Null and empty texts have fingerprint 0 and are linked like any other.  Rows with a null doc_id
    belong to their component but never name it (all null: null).  Repeated rows get equal results.
    """
    prints, labelled = _labelled(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), shingle, max_bits)
    least = labelled.groupBy("c").agg(F.min("least").alias("component_id"))
    named = labelled.select("fp", "c").join(least, "c").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def _labelled(docs: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) per row of ``docs``, and (fp, least, first, c) per fingerprint: its least
    doc_id, its first (doc_id is null, doc_id, text_hash) and the label of its component, the least
    fingerprint."""
    prints = cut(fingerprints(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    per_fp = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), first.alias("first"))
    comp = components(near_links(per_fp.select("fp"), max_bits)).select(F.col("node").alias("fp"), F.col("component").alias("c"))
    return prints, per_fp.join(comp, "fp", "left").withColumn("c", F.coalesce("c", "fp"))


def keep_first(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the least doc_id (null
    last, then the lower text hash); all columns unchanged.  Groups are told apart by their
    fingerprints, so a doc_id that is null or repeated in several groups stays once in each."""
    keep = _labelled(docs.select("doc_id", "text"), shingle, max_bits)[1].groupBy("c").agg(F.min("first").alias("k"))
    k = keep.select(F.col("k")["doc_id"].alias(f"{P}id"), F.col("k")["text_hash"].alias(f"{P}h"))
    th = F.xxhash64(docs["text"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(f"{P}row"), docs["doc_id"].alias(f"{P}d"), th.alias(f"{P}t"))
    j = rows.join(k, rows[f"{P}d"].eqNullSafe(k[f"{P}id"]) & (rows[f"{P}t"] == k[f"{P}h"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy(f"{P}d", f"{P}t").orderBy(f"{P}t"))
    one = j.withColumn(f"{P}n", nth).where(F.col(f"{P}n") == 1)
    return one.select(*[F.col(f"{P}row")[c].alias(c) for c in docs.columns])
