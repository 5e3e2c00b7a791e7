"""Line dedup against all pairs of suffixes."""

import random

import pytest

from evalspark.llm.linededup import dedup_lines

KIND = "doc_id long, text string, id string, g int, end int, length string"


def prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def brute(rows, least):
    """doc_id, text → (lines gone, runs, longest): every suffix against every earlier one."""
    docs = sorted({(i, t) for i, t in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    worded = [[x for x in (t or "").split("\n") if x.split()] for _, t in docs]
    suffixes = [w[p:] for w in worded for p in range(len(w))]
    out, g = {}, 0
    for (i, t), w in zip(docs, worded):
        gone, reach, n_runs, longest = set(), -1, 0, 0
        for p in range(len(w)):
            own, earlier = suffixes[g + p], suffixes[: g + p]
            common = max((prefix(own, q) for q in earlier), default=0)
            if common < max(least, 1):
                continue
            h = 1 << (common.bit_length() - 1)
            origin = next(q for q in earlier if prefix(own, q) >= h)
            length = max(prefix(own, origin), least)
            gone |= set(range(p, p + length))
            n_runs += p + length > reach
            reach, longest = max(reach, p + length), max(longest, length)
        g += len(w)
        out[i, t] = (len(gone), n_runs, longest)
    return out


def corpus(seed):
    rng = random.Random(seed)
    line = lambda: f"line {rng.randint(0, 25)}"
    block = [f"block line {k}" for k in range(21)]
    docs = []
    for k in range(40):
        own = [line() for _ in range(rng.randint(0, 12))]
        if k % 3 == 0:
            lo = rng.randint(0, 15)
            own[len(own) // 2 : len(own) // 2] = block[lo : lo + rng.randint(1, 21)]
        if k % 4 == 0:
            own.insert(len(own) // 2, " ")
        docs.append((k, "\n".join(own)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, docs[3][1] + "\ntail"), (103, "\n".join(["same"] * 13)), (104, None), (105, "")]
    return docs + [(None, docs[6][1]), (7, docs[7][1]), (9, "another text\nof document nine")]


@pytest.mark.parametrize("seed, least", [(1, 1), (2, 1), (1, 2), (2, 3), (3, 5), (1, 40)])
def test_runs_equal_all_pairs_of_suffixes(spark, seed, least):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], KIND)
    exp = brute(rows, least)
    got = dedup_lines(df, least).collect()
    assert len(got) == len(rows)
    # two rows share doc_id 7 and their text; two texts share doc_id 9
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append((r.n_removed, r.n_runs, r.longest_run))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(exp[i, t])
    tied = [9]  # two texts of one id: their order is that of a hash, but they share no line
    assert {k: sorted(v) for k, v in per.items() if k not in tied} == {k: sorted(v) for k, v in want.items() if k not in tied}


def test_neighbouring_runs_of_different_origin_count_each(spark):
    rows = [(1, "a\nb\nc"), (2, "x\ny"), (3, "b\nc\nx\ny\nnew"), (4, "a\n \nb\n\nc")]
    got = {r.doc_id: (r.n_removed, r.n_runs, r.longest_run, r.kept) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0, 0, rows[0][1]), 2: (0, 0, 0, rows[1][1]), 3: (4, 2, 2, "new"), 4: (3, 1, 3, " \n")}
