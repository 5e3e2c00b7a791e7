"""Merkle manifest of a dataset: one binary hash tree per language, one over their roots, a proof per row.

Trees are built in strides of eight levels, so that a group holds at most 256 nodes.  Proofs come from
pointer jumping: every inner node holds the sibling segment towards an ancestor; a self-join of the nodes
doubles the distance and concatenates the segments, and the leaves follow the pointers of each round.  Levels are
even, so the nodes that round r looks up are those at odd multiples of 2**r, and fewer remain each time.

Digests are kept as 32 bytes; inputs of a hash are their lowercase hex text, as the manifest's law says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import P, cut, running_totals

#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels per shuffle while a tree is built.
STRIDE = 8
#: A table of nodes or trees is broadcast up to so many rows (counted first), beyond that it is shuffled.
SMALL = 1 << 16
#: Fixed value: bytes of a digest.
SIZE = 32


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _encoded(c: Column) -> Column:
    """``-`` for null, else byte count, ``:``, value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row's FIELDS, with ``changed`` columns in their place."""
    return _digest(F.concat(*[_encoded(changed.get(f, F.col(f))) for f in FIELDS]))


def _parents(h: Column) -> Column:
    """Digests of every two consecutive nodes of a level; the last one may be alone."""
    pair = lambda i: _digest(F.concat(_hex(F.get(h, 2 * i)), F.coalesce(_hex(F.get(h, 2 * i + 1)), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(h) + 1) / 2).cast("int") - 1), pair)


def _nodes_of(k: int, top: int, base: int, own_type: str) -> Column:
    """Nodes of level ``base + k`` of a block: level, pos, the sibling's digest (empty if alone), own row.
    Levels above a tree's root are empty; the root itself is there only if it is a leaf."""
    h, wide = F.col(f"h{k}"), 1 << (STRIDE - k)

    def node(x: Column, i: Column) -> Column:
        own = F.get("own", i) if base + k == 0 else F.lit(None)
        return F.struct(
            F.lit(base + k).alias("level"),
            (F.col("block") * wide + i).alias("pos"),
            F.coalesce(F.get(h, i.bitwiseXOR(F.lit(1))), F.lit(b"")).alias("path"),
            own.cast(own_type).alias("own"),
        )

    return F.transform(h if base + k == 0 else F.when(F.col("n") > (1 << (base + k)), h).otherwise(F.array()), node)


def build(leaves: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of the trees over ``leaves`` (tree, pos, n, hash, own), of ``depth`` levels at most.

    ``pos`` counts from 0 to n - 1 within a tree; ``own`` is a struct that a leaf carries along.  Nodes are
    (tree, n, level, pos, path, own) without the roots, where path is the sibling; roots are (tree, root).
    A tree of one leaf has that leaf as its node (level 0, empty path) and as its root.
    """
    own_type = leaves.schema["own"].dataType.simpleString()
    nodes, roots, level = [], [], leaves
    for base in range(0, max(depth, 1), STRIDE):
        top = min(STRIDE, depth - base)
        item = F.sort_array(F.collect_list(F.struct("pos", "hash", "own"))).alias("at")
        blocks = level.groupBy("tree", "n", F.shiftright("pos", STRIDE).alias("block")).agg(item)
        blocks = blocks.select("tree", "n", "block", F.col("at")["own"].alias("own"), F.col("at")["hash"].alias("h0"))
        for k in range(top):
            blocks = blocks.withColumn(f"h{k + 1}", F.when(F.col("n") > (1 << (base + k)), _parents(F.col(f"h{k}"))))
        blocks = cut(blocks)
        levels = [_nodes_of(k, top, base, own_type) for k in range(max(top, 1))]
        nodes.append(blocks.select("tree", "n", F.inline(F.concat(*levels))))
        tops = F.coalesce(*[F.get(F.col(f"h{k}"), F.lit(0)) for k in range(top, -1, -1)])
        roots.append(blocks.where(F.col("n") <= (1 << (base + top))).select("tree", tops.alias("root")))
        rest = blocks.where(F.col("n") > (1 << (base + top)))
        last = F.get(F.col(f"h{top}"), F.lit(0)).alias("hash")
        level = rest.select("tree", "n", F.col("block").alias("pos"), last, F.lit(None).cast(own_type).alias("own"))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, roots)


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most ``rows`` rows: to be broadcast if that is no more than SMALL."""
    return F.broadcast(df) if rows <= SMALL else df


def _jump(rows: DataFrame, over: DataFrame, step: int) -> DataFrame:
    """``rows`` (at multiples of 2 * step) with the pointers of ``over`` (step levels above) behind their own."""
    o = over.select(*[F.col(c).alias(P + c) for c in ("tree", "level", "pos", "path")])
    on = [F.col("tree") == F.col(f"{P}tree"), F.col("level") + step == F.col(f"{P}level"), F.shiftright("pos", step) == F.col(f"{P}pos")]
    longer = F.concat(F.col("path"), F.coalesce(F.col(f"{P}path"), F.lit(b"")))
    return rows.join(o, on, "left").withColumn("path", longer).select(*rows.columns)


def proofs(nodes: DataFrame, depth: int, n_leaves: int, n_trees: int) -> DataFrame:
    """(tree, n, pos, own, path) of the leaves: path holds the siblings from leaf to root.

    After round r a pointer spans 2**r levels or ends at the root.  A node is the ancestor of at most
    2**(2**r) lookups; when that is many, few nodes are left at that height and the table is broadcast:
    at level l and above there are at most 2 * n_leaves / 2**l nodes and ``depth`` more per tree.
    """
    leaves = nodes.where("level = 0")
    inner = cut(nodes.where("level > 0").select("tree", "level", "pos", "path"))
    step = 1
    while step < depth:
        over = _bounded(inner.where(F.col("level") % (2 * step) == step), 2 * (n_leaves >> step) + n_trees * depth)
        leaves = _jump(leaves, over, step)
        if 2 * step < depth:
            inner = cut(_jump(inner.where(F.col("level") % (2 * step) == 0), over, step))
        step *= 2
    return leaves.select("tree", "n", "pos", "own", "path")


def folded(h: Column, pos: Column, n: Column, path: Column) -> Column:
    """Root recomputed from a leaf's digest, its place among ``n`` leaves and its siblings."""
    levels = F.when(n > 1, F.sequence(F.lit(0), F.length(F.bin(n - 1)) - 1)).otherwise(F.array().cast("array<int>"))

    def up(s: Column, k: Column) -> Column:
        here, last = F.call_function("shiftright", pos, k), F.call_function("shiftright", n - 1, k)
        right = here % 2 == 1
        alone = ~right & (here == last)
        own, other = _hex(s["h"]), _hex(F.substring(path, s["at"] + 1, F.lit(SIZE)))
        text = F.when(alone, own).when(right, F.concat(other, own)).otherwise(F.concat(own, other))
        return F.struct(_digest(text).alias("h"), F.when(alone, s["at"]).otherwise(s["at"] + SIZE).alias("at"))

    return F.aggregate(levels, F.struct(h.alias("h"), F.lit(0).alias("at")), up, lambda s: s["h"])


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """One row per document row: doc_id, lang, leaf, subroot, root, path, sub_path, folded_root, verified.

    ``altered`` is the digest of a row that someone may have changed (null: unchanged); ``folded_root`` is what
    it and the original siblings give, ``verified`` says whether that is the root.  ``path`` are the siblings inside the
    language's tree, ``sub_path`` those of its root among the languages' roots (32 bytes each); digests are binary.

    Leaves of a language are in the order of doc_id, null last; rows with equal doc_id in the order of their
    digests, so equal rows are neighbours and interchangeable.  Languages are in byte order, null first; the empty language is one
    of its own.  Null fields are part of the digest.  An empty table gives no rows.  Other columns play no part.
    """
    rows = docs.select("doc_id", "lang", leaf_digest().alias("hash"), (F.lit(None) if altered is None else altered).cast("binary").alias("altered"))
    rows = cut(rows)  # texts are read once
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), F.col("hash").asc()]
    placed = running_totals(rows, order, {"rank": F.lit(1)}).drop("rank_all")
    langs = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = cut(running_totals(langs, [F.col("lang").asc_nulls_first()], {"tree": F.lit(1), "start": F.col("n")}))
    total, most, trees = langs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1)), F.count("*")).first()
    depth, top_depth = (most - 1).bit_length(), (max(trees, 1) - 1).bit_length()

    t = _bounded(langs.select(F.col("lang").alias(f"{P}lang"), "n", F.col("tree_before").alias("tree"), "start_before"), trees)
    j = placed.join(t, F.col("lang").eqNullSafe(F.col(f"{P}lang")))
    own = F.struct("doc_id", "lang", "hash", "altered").alias("own")
    nodes, roots = build(j.select("tree", (F.col("rank_before") - F.col("start_before")).alias("pos"), "n", "hash", own), depth)
    proved = proofs(nodes, depth, total, trees)

    places = langs.select(F.col("tree_before").alias("pos"), F.col("tree_all").alias("n"))
    top_own = F.struct(F.col("root").alias("subroot")).alias("own")
    tops = places.join(roots, F.col("pos") == F.col("tree")).select(F.lit(0).alias("tree"), "pos", "n", F.col("root").alias("hash"), top_own)
    top_nodes, root = build(tops, top_depth)
    top = proofs(top_nodes, top_depth, trees, 1).crossJoin(F.broadcast(root.select("root")))  # one row
    top = cut(top.select(F.col("pos").alias(f"{P}tree"), F.col("n").alias("trees"), "own.subroot", F.col("path").alias("sub_path"), "root"))

    whole = proved.join(_bounded(top, trees), F.col("tree") == F.col(f"{P}tree"))
    start = F.coalesce("own.altered", "own.hash")
    whole = whole.withColumn(f"{P}sub", folded(start, F.col("pos"), F.col("n"), F.col("path")))
    whole = whole.withColumn("folded_root", folded(F.col(f"{P}sub"), F.col("tree"), F.col("trees"), F.col("sub_path")))
    return whole.select(
        "own.doc_id", "own.lang", F.col("own.hash").alias("leaf"), "subroot", "root", "path", "sub_path", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def with_tampering(docs: DataFrame, every: int = 7) -> DataFrame:
    """``manifest`` where ``every`` divides crc32 of the decimal doc_id and n_chars has been raised by one.

    A null doc_id has no decimal form and is never tampered with; a null n_chars stays null.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    return manifest(docs, F.when(hit, leaf_digest(n_chars=F.col("n_chars") + 1)))
