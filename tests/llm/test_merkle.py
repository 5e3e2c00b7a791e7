"""Merkle manifest against a recursive version."""

import hashlib
import zlib

import pytest

from evalspark.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string, own int, hash string, level int"


def sha(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(r, extra=0):
    i, s, lang, n, t = r
    n = n if n is None else n + extra
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, lang, n, t)))


def tree(leaves):
    """(root, siblings of each leaf as (digest, leaf is right))."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, p in enumerate(at):
            if p ^ 1 < len(level):
                paths[k].append((level[p ^ 1], p & 1))
            else:
                paths[k].append((None, 0))
        at = [p // 2 for p in at]
        level = [sha(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], paths


def fold(h, path):
    for s, right in path:
        h = sha(h) if s is None else sha(s, h) if right else sha(h, s)
    return h


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own, subroots = {}, []
    for lang in langs:
        own[lang] = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        subroots.append(tree([leaf(r) for r in own[lang]]))
    root, high = tree([s for s, _ in subroots])
    out = []
    for k, lang in enumerate(langs):
        for r, path in zip(own[lang], subroots[k][1]):
            whole = path + high[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = fold(leaf(r, int(hit)), whole)
            out.append((r[0], leaf(r), subroots[k][0], root, sha(*(s for s, _ in whole if s)), folded, folded == root))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "t", 2, "h", 3) for r in rows], KIND)
    text = lambda b: bytes(b).hex()
    return sorted(
        (
            (r.doc_id, text(r.leaf), text(r.subroot), text(r.root), sha(text(r.path), text(r.sub_path)), text(r.folded_root), r.verified)
            for r in merkle.with_tampering(docs).collect()
        ),
        key=str,
    )


def edge_rows(n):
    rows = [(k, f"s{k % 3}", ("en", "de", None, "", "é", "zz")[0 if k % 3 else k % 6], k * 3, f"text {k} ü") for k in range(n)]
    rows += [(None, None, None, None, None), (None, "s", "en", 4, "x"), (5, "s5", "en", None, ""), (7, "a", "en", 1, "same"), (7, "a", "en", 1, "same")]
    return rows + [(9001, "s", "only", 2, "alone"), (9002, "s", "en", None, "w" * 70_000)]


@pytest.mark.parametrize("n", [0, 40, 700])
def test_manifest_equals_recursion(spark, n):
    rows = edge_rows(n)
    assert got(spark, rows) == brute(rows)


def test_small_and_uneven_trees(spark):
    for n in (1, 2, 3, 5):
        rows = [(k, "s", "en", k, f"t{k}") for k in range(n)]
        assert got(spark, rows) == brute(rows)


def test_shuffled_pointers_equal_broadcast_ones(spark, monkeypatch):
    rows = edge_rows(300)
    monkeypatch.setattr(merkle, "SMALL", -1)
    assert got(spark, rows) == brute(rows)


def test_tampering_is_found_and_nothing_else(spark):
    rows = [(k, "s", "en", k, f"t{k}") for k in range(200)]
    by = {r[0]: r for r in got(spark, rows)}
    for k in range(200):
        assert by[k][-1] == (zlib.crc32(str(k).encode()) % 7 != 0)


def test_empty_table(spark):
    assert merkle.with_tampering(spark.createDataFrame([], KIND)).count() == 0
