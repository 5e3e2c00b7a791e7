"""Line dedup: repeated runs of lines by a suffix array over line-ID sequences; later copies go.

The documents' lines are one sequence of numbered positions, in order of (doc_id with null last, text hash, line), and a
run never leaves its document.  Prefix doubling ranks every position by its next 1, 2, 4, ... lines: positions with
the same rank form an interval of the suffix array whose common prefix has that length, named by its first position.
A position alone in its interval is finished; doubling ends when no interval is left.  Of the intervals in which a position
is not the first, the deepest names its origin, and the length of the run is the longest common prefix of the
two suffixes: from the interval's own length on, the ranks at p + m and at the origin + m tell for each smaller power of two whether
the match goes on.  Names need equality and first position only, so no line is sorted globally; only one row per document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import P, cut, running_totals, stored

MIN_LINES = 1

#: A line with a word.
WORDED = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _document() -> list[Column]:
    """What tells documents apart: doc_id as a null flag and a number (null last), and the text's hash."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("th")]


DOC = ["no_id", "id", "th"]


def _positions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, starts).  Lines are (g, end, a, b): number of the position, number behind its document's last line, and
    the line's 128-bit identity; lines without a word have none.  Starts are (no_id, id, th, start, end)."""
    worded = F.filter(_lines(F.col("text")), lambda x: x.rlike(WORDED))
    d = docs.select(*_document(), F.posexplode(worded).alias("pos", "line"))
    d = d.select(*DOC, "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    # rows with equal doc_id and text are one document
    once = stored(d.repartition(*DOC).groupBy(*DOC, "pos").agg(F.min("a").alias("a"), F.min("b").alias("b")))
    sizes = once.groupBy(*DOC).agg((F.max("pos") + 1).cast("long").alias("n"))
    starts = running_totals(sizes, [F.col(c).asc() for c in DOC], {"start": F.col("n")})
    starts = cut(starts.select(*DOC, F.col("start_before").alias("start"), (F.col("start_before") + F.col("n")).alias("end")))
    return once.join(starts, DOC).select((F.col("start") + F.col("pos")).alias("g"), "end", "a", "b"), starts


def _intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(g, end, name) of the positions whose ``keys`` two positions or more share.

    First and last position per key are partial aggregates, so a hot line is one row per task; the join
    back is AQE's to split.
    """
    named = rows.groupBy(*keys).agg(F.min("g").alias("name"), F.max("g").alias("last"))
    found = named.where("name < last").select(*[F.col(k).alias(P + k) for k in keys], "name")
    joined = rows.join(found, [F.col(k) == F.col(P + k) for k in keys])
    return joined.select("g", "end", "name")


def _joined(names: DataFrame, h: int) -> DataFrame:
    """Intervals longer by ``h``, from the names at p and p + h of the same document."""
    ahead = Window.partitionBy("end").orderBy("g").rangeBetween(h, h)
    pairs = names.select("g", "end", F.col("name").alias("x"), F.max("name").over(ahead).alias("y")).where(F.col("y").isNotNull())
    return _intervals(pairs, ["x", "y"])


def _ranked(lines: DataFrame) -> list[DataFrame]:
    """Intervals of length 1, 2, 4, ... until none is left; at most the bits of the longest document's line count."""
    levels = [cut(_intervals(lines, ["a", "b"]))]
    while True:
        longer = cut(_joined(levels[-1], 1 << (len(levels) - 1)))
        if longer.isEmpty():
            return levels
        levels.append(longer)


def _name_at(rows: DataFrame, names: DataFrame, at: Column, name: str) -> DataFrame:
    there = names.select(F.col("g").alias(f"{P}at"), F.col("end").alias(f"{name}_end"), F.col("name").alias(name))
    return rows.withColumn(f"{P}k", at).join(there, F.col(f"{P}k") == F.col(f"{P}at"), "left").drop(f"{P}k", f"{P}at")


def runs(levels: list[DataFrame]) -> DataFrame:
    """(g, end, origin, length) of every position whose line stands at an earlier one too.

    With 2**k lines as the largest power of two that occurs earlier, ``origin`` is the first position with these lines
    and ``length`` the longest common prefix of the two suffixes.
    """
    later = [x.where("name < g").withColumn("h", F.lit(1 << k)) for k, x in enumerate(levels)]
    best = later[0]
    for x in later[1:]:
        best = best.unionByName(x)
    best = best.groupBy("g", "end").agg(F.max(F.struct("h", "name")).alias("x"))
    found = cut(best.select("g", "end", F.col("x.name").alias("origin"), "x.h", F.col("x.h").cast("long").alias("length")))
    short, long = found.where("h = 1"), found.where("h > 1")
    if len(levels) > 1:
        long = _name_at(long, levels[0], F.col("origin"), "o").withColumn("origin_end", F.col("o_end")).drop("o", "o_end")
    for k in range(len(levels) - 2, -1, -1):
        names, step = levels[k], 1 << k
        open_ = F.col("h") > step  # a match of h lines or more but less than 2 h
        j = _name_at(long, names, F.when(open_, F.col("g") + F.col("length")), "own")
        j = _name_at(j, names, F.when(open_, F.col("origin") + F.col("length")), "other")
        same = (F.col("own") == F.col("other")) & (F.col("own_end") == F.col("end")) & (F.col("other_end") == F.col("origin_end"))
        longer = F.col("length") + F.when(same, step).otherwise(0)
        long = cut(j.withColumn("length", longer).select("g", "end", "origin", "h", "length", "origin_end"))
    cols = ["g", "end", "origin", "length"]
    return short.select(*cols).unionByName(long.select(*cols))


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(no_id, id, th, removed, n_runs, longest_run) of the documents that lose lines: ``removed`` are the
    numbers, in order and among the lines with a word, of the lines inside a run of ``min_lines`` lines or more that
    also starts at an earlier position.  ``n_runs`` counts such runs that lie in no other one, ``longest_run`` is the longest one's lines."""
    lines, starts = _positions(docs)
    levels = _ranked(lines)
    found = runs(levels)
    if min_lines > 1:
        k = min(min_lines.bit_length(), len(levels)) - 1
        least, h = levels[k], 1 << k
        while h < min_lines:  # the length itself, where it is no power of two or longer than any run
            step = min(h, min_lines - h)
            least, h = cut(_joined(least, step)), h + step
        least = least.where("name < g").select(F.col("g").alias(f"{P}at"))
        found = found.join(least, F.col("g") == F.col(f"{P}at")).withColumn("length", F.greatest("length", F.lit(min_lines).cast("long")))
    before = Window.partitionBy("end").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.col("g") + F.col("length")
    ends = found.withColumn("reached", F.coalesce(F.max(reach).over(before), F.lit(-1)))
    ends = ends.select("end", F.greatest("g", "reached").alias("from"), reach.alias("to"), (reach > F.col("reached")).alias("own"), "length")
    new = F.when(F.col("own"), F.sequence(F.col("from"), F.col("to") - 1)).otherwise(F.array().cast("array<bigint>"))
    per = ends.groupBy("end").agg(
        F.sort_array(F.flatten(F.collect_list(new))).alias("gone"), F.sum(F.col("own").cast("long")).alias("n_runs"), F.max("length").alias("longest_run")
    )
    placed = per.join(starts, "end")
    return placed.select(*DOC, F.transform("gone", lambda g: (g - F.col("start")).cast("int")).alias("removed"), "n_runs", "longest_run")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per document row: doc_id, kept (the text without the deleted lines), n_lines, n_removed,
    n_runs and longest_run (see ``later_copies``; runs of different origin count each, and lines without a word neither
    break nor lengthen one).

    Positions are ordered by doc_id (null last), then the text's hash, then line; so the copy in the
    smallest doc_id stays, and of a run repeated inside one document the first.  Rows with equal doc_id
    and text count as one document: they get the same result.  Lines are compared as they are; lines
    without a word match nothing and stay.  A null text has one empty line and is kept as null.
    """
    removed = later_copies(docs, min_lines)
    r = removed.select(*[F.col(c).alias(P + c) for c in DOC], "removed", "n_runs", "longest_run")
    rows = docs.select("doc_id", "text", *_document())
    j = rows.join(r, [F.col(c) == F.col(P + c) for c in DOC], "left")
    gone = F.coalesce(F.col("removed"), F.array().cast("array<int>"))
    x = j.select("doc_id", "text", _lines(F.col("text")).alias(f"{P}l"), gone.alias(f"{P}g"), "n_runs", "longest_run")
    lines, g = F.col(f"{P}l"), F.col(f"{P}g")
    worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORDED))
    x = x.withColumn(f"{P}w", F.when(F.size(g) > 0, worded))
    gone_lines = F.transform(g, lambda v: F.get(F.col(f"{P}w"), v))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_lines)
    kept = F.when(F.size(g) == 0, F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    return x.select(
        "doc_id", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.size(g).cast("long").alias("n_removed"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_runs", "longest_run")],
    )
