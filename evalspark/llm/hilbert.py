"""Sharding along a Hilbert curve over quantised metadata, cut into runs of equal row or byte counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import P, cut, running_totals


def quantise(rows: DataFrame, dims: list[str], bits: int, cells: list[str]) -> DataFrame:
    """``rows`` plus one column of ``cells`` per dimension: its 0 .. 2^bits - 1 quantile cell (null is
    the largest value).  Equal values share a cell, and cells keep the column's order.

    The distinct values of all dimensions with their counts (one pre-aggregated row each) are summed in
    one ordered pass, so a value that holds a third of the rows is one row here; AQE broadcasts the
    cells or splits the hot value's rows.  Whole numbers are ordered as zero-padded text.
    """
    kinds = dict(rows.dtypes)

    def sortable(d: str) -> Column:
        if kinds[d] == "string":
            return F.col(d)
        x = F.col(d).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
        return F.lpad(x.cast("decimal(20,0)").cast("string"), 20, "0")

    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), sortable(d).alias("v")) for i, d in enumerate(dims)]))
    counts = rows.select(pairs.alias("x")).groupBy(F.col("x.d").alias(f"{P}d"), F.col("x.v").alias(f"{P}v")).agg(F.count("*").alias(f"{P}c"))
    order = [F.col(f"{P}d").asc(), F.col(f"{P}v").isNull().asc(), F.col(f"{P}v").asc()]
    summed = running_totals(counts, order, {f"{P}t": F.col(f"{P}c")})
    # every row is counted once per dimension: dimension d starts after d times all rows
    cell = F.expr(f"(({P}t_before - {P}d * ({P}t_all div {len(dims)})) * {1 << bits}) div ({P}t_all div {len(dims)})")
    table = summed.select(f"{P}d", f"{P}v", cell.cast("long").alias(f"{P}cell"))
    for i, (d, c) in enumerate(zip(dims, cells, strict=True)):
        own = table.where(F.col(f"{P}d") == i).select(F.col(f"{P}v").alias(f"{P}v{i}"), F.col(f"{P}cell").alias(c))
        rows = rows.join(own, sortable(d).eqNullSafe(own[f"{P}v{i}"])).drop(f"{P}v{i}")
    return rows


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Position along the Hilbert curve through a grid of 2^bits cells per axis.

    Axes to transpose form (inverse undo, then Gray code), then the bits are interleaved from the
    highest, axis by axis; every step is a bit expression inside ``aggregate`` over a literal list.
    """
    n = len(axes)
    x = F.array(*[a.cast("long") for a in axes])

    def at(v: Column, i: Column) -> Column:
        return F.get(v, i)

    def undo(v: Column, s: Column) -> Column:
        p = s["q"] - 1
        mine, first = at(v, s["i"]), F.get(v, F.lit(0))
        swap = first.bitwiseXOR(mine).bitwiseAND(p)
        flip = mine.bitwiseAND(s["q"]) != 0
        new_first = F.when(flip, first.bitwiseXOR(p)).otherwise(first.bitwiseXOR(swap))
        return F.transform(
            v,
            lambda y, j: F.when(j == 0, new_first).when((j == s["i"]) & ~flip, y.bitwiseXOR(swap)).otherwise(y),
        )

    high = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q in high for i in range(n)])
    undone = F.aggregate(steps, x, undo) if high else x
    gray = F.transform(
        undone, lambda y, j: F.aggregate(F.slice(undone, 1, j + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    )
    last = F.element_at(gray, -1)
    t = reduce(lambda acc, q: acc.bitwiseXOR(F.when(last.bitwiseAND(q) != 0, F.lit(q - 1)).otherwise(0)), high, F.lit(0).cast("long"))
    flat = F.transform(gray, lambda y: y.bitwiseXOR(t))
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << b).cast("long").alias("q")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.aggregate(
        places,
        F.lit(0).cast("long"),
        lambda acc, s: acc * 2 + F.when(at(flat, s["i"]).bitwiseAND(s["q"]) != 0, F.lit(1)).otherwise(0).cast("long"),
    )


def hilbert_order(rows: DataFrame, dims: list[str], bits: int = 4) -> DataFrame:
    """``rows`` plus ``hilbert``, the curve position of the row's quantised ``dims``."""
    cells = [f"{P}cell{i}" for i in range(len(dims))]
    rows = quantise(rows, dims, bits, cells)
    # the index is a large expression: kept apart from the joins and computed once per distinct cell
    grid = rows.select(*cells).distinct()
    index = grid.select(*[F.col(c).alias(c + "g") for c in cells], hilbert_index([F.col(c) for c in cells], bits).alias("hilbert"))
    on = reduce(lambda a, b: a & b, [rows[c] == index[c + "g"] for c in cells])
    return rows.join(F.broadcast(index), on).drop(*cells, *[c + "g" for c in cells])  # at most 2^(bits * dims) rows


def cut_runs(rows: DataFrame, n_shards: int, law: str, tie: list[str], size: str = "size") -> DataFrame:
    """``rows`` (with ``hilbert``) plus shard and slot.

    ``rows``: row counts of shards differ by one at most.  ``bytes``: a row goes to the shard in which
    its first byte lies, so shards differ by one row's size at most.  Rows with equal curve position
    follow ``tie``.  Slots count from 0 in each shard along the curve.
    """
    order = [F.col("hilbert").asc(), *[F.col(c).asc() for c in tie]]
    r = running_totals(rows, order, {f"{P}n": F.lit(1), f"{P}z": F.col(size)})
    x = f"{P}n" if law == "rows" else f"{P}z"
    shard = F.expr(f"least(({x}_before * {n_shards}) div greatest({x}_all, 1), {n_shards - 1})").cast("int")
    placed = r.withColumn("shard", shard)
    names = [f"{P}{a}_{b}" for a in "nz" for b in ("before", "all")]
    if law == "rows":  # shard s starts at row ceil(s * n / n_shards)
        first = F.expr(f"(shard * {P}n_all + {n_shards - 1}) div {n_shards}")
        return placed.withColumn("slot", (F.col(f"{P}n_before") - first).cast("long")).drop(*names)
    first = placed.groupBy("shard").agg(F.min(f"{P}n_before").alias(f"{P}first"))
    j = placed.join(F.broadcast(first), "shard")  # one row per shard
    return j.withColumn("slot", (F.col(f"{P}n_before") - F.col(f"{P}first")).cast("long")).drop(f"{P}first", *names)


def shard_rows(
    rows: DataFrame, dims: list[str], n_shards: int = 40, law: str = "rows", tie: tuple[str, ...] = ("doc_id",), bits: int = 4
) -> DataFrame:
    """``rows`` (narrow; with a ``size``) plus hilbert, shard and slot.  An empty table gives no rows;
    with fewer rows than shards some shards stay empty; repeated rows get slots of their own."""
    return cut_runs(hilbert_order(cut(rows), dims, bits), n_shards, law, list(tie))


def payload_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shard_documents(docs: DataFrame, n_shards: int = 40, law: str = "rows", dims: tuple[str, ...] = ("lang", "source", "size")) -> DataFrame:
    """``docs`` plus _size, _hilbert, _shard and _slot, laid out so that each written file holds a run of the curve.

    Only narrow rows are ranked.  They meet the texts again by (doc_id, size, CRC-32 of the text);
    repeated rows of one key get that key's slots in turn.  Documents that were sharded before, or have columns of these
    names for another reason, lose them to the new ones.
    """
    key = {f"{P}id": docs["doc_id"], f"{P}size": payload_size(docs["text"]), f"{P}crc": F.crc32(F.coalesce(docs["text"], F.lit("")))}
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(f"{P}row"), *[v.alias(k) for k, v in key.items()])
    own = {"size": F.col(f"{P}size")}
    narrow = keyed.select(
        *[own[d].alias("size") if d in own else F.col(f"{P}row")[d].alias(d) for d in dict.fromkeys((*dims, "size"))],
        F.col(f"{P}id").alias("doc_id"), F.col(f"{P}crc").alias("crc"),
    )
    placed = shard_rows(narrow, list(dims), n_shards, law, ("doc_id", "crc"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "size", "crc").orderBy("shard", "slot"))
    left = placed.select("doc_id", "size", "crc", "hilbert", "shard", "slot", nth.alias("nth"))
    again = F.row_number().over(Window.partitionBy(*key).orderBy(f"{P}size"))
    right = keyed.withColumn(f"{P}nth", again)
    on = (
        right[f"{P}id"].eqNullSafe(left["doc_id"]) & (right[f"{P}size"] == left["size"])
        & (right[f"{P}crc"] == left["crc"]) & (right[f"{P}nth"] == left["nth"])
    )
    j = right.join(left, on)
    placed_as = {"_size", "_hilbert", "_shard", "_slot"}
    out = j.select(
        *[F.col(f"{P}row")[c].alias(c) for c in docs.columns if c.lower() not in placed_as],
        *[F.col(c).alias(f"_{c}") for c in ("size", "hilbert", "shard", "slot")],
    )
    return out.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
