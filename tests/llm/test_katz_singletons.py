import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quarrywise.llm import katz_lm
from quarrywise.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def good_turing(n, k):
    """Katz's ratios for counts up to k, written from his formula: d = (r*/r - a) / (1 - a), r* = (r + 1) n[r+1] / n[r], a = (k + 1) n[k+1] / n[1]."""
    d = {}
    for r in range(1, k + 1):
        a = (k + 1) * n[k + 1] / n[1] if n[1] else 2.0
        ratio = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if n[r] and a < 1 else 0.0
        d[r] = ratio if 0 < ratio <= 1 else (r - 0.5) / r
    return d


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def scores_brute(rows):
    """(doc_id, score) by a model that keeps every pair seen in training; nothing of the operator's module is used but its two marks."""
    toks = [(i, re.findall(rb"[^ \t-\r]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [katz_lm.END]) for i, t in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, w in toks:
        if not held(i):
            uni.update(w)
            bi.update(zip([katz_lm.BEGIN, *w[:-1]], w))
            ctx.update([katz_lm.BEGIN, *w[:-1]])
    n, k = sum(uni.values()), 6
    d1, d2 = (good_turing(Counter(c.values()), k) for c in (uni, bi))
    cut = lambda c, d: c * (d[c] if c <= k else 1)
    lost = sum((1 - d1[c]) * c for c in uni.values() if c <= k)
    p1 = lambda w: cut(uni[w], d1) / n if uni[w] else lost / n
    seen = defaultdict(list)
    for a, b in bi:
        seen[a].append(b)
    whole, bow = {}, {}
    for a, after in seen.items():
        m = sum(cut(bi[a, b], d2) for b in after)
        whole[a] = ctx[a] if m < ctx[a] - 1e-9 else ctx[a] + 1
        bow[a] = (1 - m / whole[a]) / (1 - sum(p1(b) for b in after))
    p = lambda a, b: cut(bi[a, b], d2) / whole[a] if bi[a, b] else bow.get(a, 1.0) * p1(b)
    for a in list(seen)[:5]:  # exactly normalised
        assert math.isclose(sum(p(a, b) for b in uni) + bow[a] * lost / n, 1, rel_tol=1e-9)
    return sorted(((i, sum(math.log10(p(a, b)) for a, b in zip([katz_lm.BEGIN, *w[:-1]], w))) for i, w in toks), key=repr)


def test_pairs_seen_once_are_in_the_model(spark, edge, edge_rows, small):
    for df, rows in ((edge, edge_rows), (small, [(r.doc_id, r.text) for r in small.collect()])):
        got = sorted(((r.doc_id, r.score) for r in katz_lm.lm_scores(df, chunk_bytes=20_000, bucket_grams=2_000, min_pair=1).collect()), key=repr)
        for g, x in zip(sorted(got, key=lambda r: (repr(r[0]), r[1])), sorted(scores_brute(rows), key=lambda r: (repr(r[0]), r[1])), strict=True):
            assert g[0] == x[0] and g[1] == pytest.approx(x[1], rel=1e-9)


def test_the_query_keeps_pairs_seen_once(spark, small):
    got = {r.doc_id: r.score for r in QUERIES["op10_lm_scoring"](spark, SMALL).collect()}
    assert got == pytest.approx(dict(scores_brute([(r.doc_id, r.text) for r in small.collect()])), rel=1e-9)
