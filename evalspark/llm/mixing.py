"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only narrow rows (key, source, size) are sorted and summed; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import P, cut

#: Fixed value: source weights in code-point order of the sources, repeating, the null source last.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Number of words; null and empty texts: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` has (source, size).  Water-filling: with sources in order of cap / weight, a source is
    clamped at its cap iff the water level left after clamping all before it reaches cap / weight; what
    they leave is shared by weight among the rest.  This is where the rounds "clamp, reshare the
    excess, again" end, in one pass.  If all sources are clamped, the mix is smaller than the total.
    The windows see the pre-aggregated table of one row per source, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = [F.col("source").isNull().asc(), F.col("source").asc()]
    rank = F.row_number().over(Window.orderBy(*named)) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), rank % len(weights) + 1)
    w = per.withColumns({"w": weight, "cap": F.col("source_size") * F.lit(float(max_epochs))})
    earlier = Window.orderBy((F.col("cap") / F.col("w")).asc(), *named).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    free = F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    level = w.withColumns({"left": left, "free": free})
    marked = level.withColumn("clamped", F.col("left") * F.col("w") >= F.col("cap") * F.col("free"))
    # clamped sources come first in that order, so the first free one sees the final level
    water = F.max(F.when(~F.col("clamped"), F.col("left"))).over(all_rows)
    shared = F.max(F.when(~F.col("clamped"), F.col("free"))).over(all_rows)
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(water * F.col("w") / shared)
    return marked.select("source", "source_size", target.alias("target"))


def copies(rows: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = 3.0) -> DataFrame:
    """``rows`` (doc_id, source, size) plus source_size, target and n_copies.

    Every document is taken floor(target / source_size) times whole.  The fraction that remains is met
    by one more copy of some documents: in the order of a seeded hash of doc_id, each document is taken
    if it fits what is left of the gap.  Then no document that is left fits; the smallest of them (ties:
    the first in that order) is taken too if that brings the source nearer its target.
    The result depends on the rows alone.  Empty documents are kept at the whole number of copies;
    a source without any word has target 0 and no copies.
    """
    rows = cut(rows)  # texts are read once
    targets = source_targets(rows.select("source", "size"), weights, max_epochs)
    t = targets.select(F.col("source").alias(f"{P}src"), "source_size", "target")
    j = rows.join(t, rows["source"].eqNullSafe(t[f"{P}src"])).drop(f"{P}src")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    gap = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    token = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    state = j.withColumns({f"{P}whole": whole, f"{P}gap": gap, f"{P}token": token})
    order = [F.col(c).asc() for c in ("source", f"{P}token", "doc_id", "size")]
    # range partitions are the blocks of the running sizes: a source with a third of all rows is many blocks
    ranged = state.repartitionByRange(*order)
    state = cut(ranged.withColumns({f"{P}block": F.spark_partition_id(), f"{P}row": F.monotonically_increasing_id()}))
    fits = F.coalesce((F.col("size") > 0) & (F.col("size") <= F.col(f"{P}gap")), F.lit(False))
    settled = state.where(~fits).withColumn(f"{P}extra", F.lit(0))
    left = state.where(fits)
    while not left.isEmpty():
        done = _fill(left, [*order[1:], F.col(f"{P}row").asc()])
        settled = settled.unionByName(done.where(~F.col(f"{P}open")).drop(f"{P}open"))
        left = done.where(F.col(f"{P}open")).drop(f"{P}open", f"{P}extra")
    n = F.col(f"{P}whole") + F.col(f"{P}extra") + F.coalesce((F.col(f"{P}row") == F.col(f"{P}last")).cast("int"), F.lit(0))
    last = _last(settled)
    s = settled.join(last, settled["source"].eqNullSafe(last[f"{P}s"]), "left")
    return s.withColumn("n_copies", n.cast("long")).select(*rows.columns, "source_size", "target", "n_copies")


def _fill(left: DataFrame, order: list[Column]) -> DataFrame:
    """One round over the documents that fit their source's gap: those taken have extra 1, those to be
    tried again are open, with the new gap.

    Documents are taken in order while their running size fits; the first that doesn't is settled, as are
    those behind it that are larger than the new gap.  Each round takes a document of every source, and
    rounds until nothing is open take just what trying one document after the other would.  Running
    sizes have two levels: totals per (source, block), then the order within a block.
    """
    key = ["source", f"{P}block"]
    blocks = left.groupBy(*key).agg(F.sum("size").alias(f"{P}total"))
    before = Window.partitionBy("source").orderBy(f"{P}block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.select(
        F.col("source").alias(f"{P}s"),
        F.col(f"{P}block").alias(f"{P}b"),
        F.coalesce(F.sum(f"{P}total").over(before), F.lit(0)).alias(f"{P}ahead"),
    )
    j = left.join(ahead, left["source"].eqNullSafe(ahead[f"{P}s"]) & (left[f"{P}block"] == ahead[f"{P}b"])).drop(f"{P}s", f"{P}b")
    within = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = j.withColumn(f"{P}run", F.col(f"{P}ahead") + F.sum("size").over(within)).drop(f"{P}ahead")
    fits = F.col(f"{P}run") <= F.col(f"{P}gap")
    taken = got.groupBy("source").agg(
        F.coalesce(F.sum(F.when(fits, F.col("size"))), F.lit(0)).alias(f"{P}got"), F.min(F.when(~fits, F.col(f"{P}run"))).alias(f"{P}stop")
    )
    t = taken.select(F.col("source").alias(f"{P}s"), f"{P}got", f"{P}stop")
    k = got.join(t, got["source"].eqNullSafe(t[f"{P}s"]))
    gap = F.col(f"{P}gap") - F.col(f"{P}got")
    still = (F.col(f"{P}run") > F.col(f"{P}stop")) & (F.col("size") <= gap)
    state = {f"{P}extra": fits.cast("int"), f"{P}open": F.coalesce(still, F.lit(False)), f"{P}gap": gap}
    return cut(k.withColumns(state).drop(f"{P}s", f"{P}got", f"{P}stop", f"{P}run"))


def _last(settled: DataFrame) -> DataFrame:
    """(s, last): per source the row that is taken beyond the gap, null if none brings it nearer its target."""
    words_got = F.sum(F.col("size") * (F.col(f"{P}whole") + F.col(f"{P}extra")))
    free = F.when((F.col("size") > 0) & (F.col(f"{P}extra") == 0), F.struct("size", f"{P}token", "doc_id", f"{P}row"))
    per = settled.groupBy("source").agg(words_got.alias("got"), F.max("target").alias("target"), F.min(free).alias("free"))
    gap = F.round(F.col("target") - F.col("got")).cast("long")
    near = F.when(F.col("free")["size"] < 2 * gap, F.col("free")[f"{P}row"])
    return per.select(F.col("source").alias(f"{P}s"), near.alias(f"{P}last"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as ``copies`` says, its columns unchanged.

    Documents are keyed by (doc_id, size); repeated rows of one key share the key's copies, which are
    given to them in turn.  Needs columns doc_id, source and text.
    """
    size = n_words(docs["text"])
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(f"{P}row"), "doc_id", "source", size.alias("size"))
    taken = copies(sized.select("doc_id", "source", "size"), **how)
    per_key = taken.groupBy(
        F.col("doc_id").alias(f"{P}id"), F.col("source").alias(f"{P}s"), F.col("size").alias(f"{P}z")
    ).agg(F.sum("n_copies").alias(f"{P}n"), F.count("*").alias(f"{P}rows"))
    k = per_key.where(F.col(f"{P}n") > 0)
    on = (
        sized["doc_id"].eqNullSafe(k[f"{P}id"]) & sized["source"].eqNullSafe(k[f"{P}s"]) & (sized["size"] == k[f"{P}z"])
    )
    j = sized.join(k, on)
    alone = j.where(F.col(f"{P}rows") == 1).withColumn(f"{P}k", F.col(f"{P}n"))
    turn = Window.partitionBy(f"{P}id", f"{P}s", f"{P}z").orderBy(F.xxhash64(F.col(f"{P}row")["text"]))
    share = F.floor(F.col(f"{P}n") / F.col(f"{P}rows")) + (
        F.row_number().over(turn) <= F.col(f"{P}n") % F.col(f"{P}rows")
    ).cast("long")
    shared = j.where(F.col(f"{P}rows") > 1).withColumn(f"{P}k", share)
    repeated = alone.unionByName(shared).where(F.col(f"{P}k") > 0)
    out = repeated.withColumn(f"{P}i", F.explode(F.sequence(F.lit(1), F.col(f"{P}k"))))
    return out.select(*[F.col(f"{P}row")[c].alias(c) for c in docs.columns])
