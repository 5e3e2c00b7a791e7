"""Plain-Python statements of the adopted metric definitions, used only as test oracles."""

from __future__ import annotations

import math
import re
from collections import Counter

WORD = re.compile(r"[^\W_]+|[^\w\s]|_", re.UNICODE)


def ascii_tokens(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower())


def grams(toks, n):
    return [" ".join(toks[i : i + n]) for i in range(len(toks) - n + 1)]


def rouge_n(c, r, n):
    cg, rg = Counter(grams(ascii_tokens(c), n)), Counter(grams(ascii_tokens(r), n))
    o = sum((cg & rg).values())
    p = o / max(sum(cg.values()), 1)
    q = o / max(sum(rg.values()), 1)
    return 0.0 if p + q == 0 else 2 * p * q / (p + q)


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def bleu(ct, rt, max_n=4):
    if len(rt) == 0:
        return None
    if len(ct) == 0:
        return 0.0
    ps = []
    for n in range(1, max_n + 1):
        cg, rg = Counter(grams(ct, n)), Counter(grams(rt, n))
        tot = sum(cg.values())
        ps.append(sum((cg & rg).values()) / tot if tot else 0.0)
    geo = math.exp(sum(0.25 * math.log(p) for p in ps)) if min(ps) > 0 else 0.0
    ratio = len(ct) / len(rt)
    bp = 1.0 if ratio > 1.0 else math.exp(1 - 1 / ratio)
    return geo * bp


def meteor_exact(ct, rt, alpha=0.9, beta=3.0, gamma=0.5):
    return meteor_staged(ct, rt, [], alpha, beta, gamma)


def meteor_staged(ct, rt, stages, alpha=0.9, beta=3.0, gamma=0.5):
    """Exact stage, then each ``stages`` function (word -> set of classes; a shared one matches) on the leftovers."""
    hyp = list(enumerate(ct))
    ref = list(enumerate(rt))
    matches = []
    for key in [lambda w: {w}] + list(stages):
        for i in range(len(hyp))[::-1]:
            for j in range(len(ref))[::-1]:
                if key(hyp[i][1]) & key(ref[j][1]):
                    matches.append((hyp[i][0], ref[j][0]))
                    hyp.pop(i)
                    ref.pop(j)
                    break
    m = len(matches)
    if m == 0:
        return 0.0
    matches.sort()
    chunks, i = 1, 0
    while i < m - 1:
        if matches[i + 1][0] == matches[i][0] + 1 and matches[i + 1][1] == matches[i][1] + 1:
            i += 1
            continue
        i += 1
        chunks += 1
    p, r = m / len(ct), m / len(rt)
    fmean = p * r / (alpha * p + (1 - alpha) * r)
    return (1 - gamma * (chunks / m) ** beta) * fmean
