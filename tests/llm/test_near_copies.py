"""Near copies against brute force over all pairs."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
from conftest import frame, words

from quarrywise.llm import near_copies
from quarrywise.llm.near_copies import BUDGET, PIECE_ERRORS, SURE


def brute_links(rows):
    """Pairs of places of (id, text) rows with a Jaccard similarity of 0.8 or more, by the shingles that they share."""
    sets, having = [], defaultdict(list)
    for k, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
        for s in sets[-1]:
            having[s].append(k)
    pairs = {p for at in having.values() for p in combinations(at, 2)}
    return {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def least_ids(rows, links):
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in links:
        up[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(rows))]


def edits(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


def test_edge_rows_are_brute_force(edge, edge_rows):
    links = brute_links(edge_rows)
    want = sorted(((i, c) for (i, _), c in zip(edge_rows, least_ids(edge_rows, links))), key=str)
    got = [(r.doc_id, r.component_id) for r in near_copies.near_copies(edge).collect()]
    assert sorted(got, key=str) == want
    kept = near_copies.drop_near_copies(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({i for i, c in want if i == c} | {None}, key=str)


def test_no_rows(empty):
    assert near_copies.near_copies(empty).count() == near_copies.drop_near_copies(empty).count() == 0


def test_a_large_group_of_edits_is_one_component(spark):
    """A third of the rows are edits of one text; others are alone or in pairs."""
    rng = random.Random(3)
    base = words(rng, 200)
    rows = [(i, edits(rng, base, 2)) for i in range(300)]
    for i in range(300, 900, 2):
        t = words(rng, 150)
        rows += [(i, t), (i + 1, edits(rng, t, 2) if i % 4 else edits(rng, t, 60))]
    want = dict(zip((i for i, _ in rows), least_ids(rows, brute_links(rows))))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, rows)).collect()}
    assert sum(got[i] != c for i, c in want.items()) <= 0.03 * 150 and all(got[i] in (i, c) for i, c in want.items()) and sum(c == 0 for c in got.values()) == 300


def test_given_table_recall(spark):
    """Every link that is found is right, and at least 0.95 of all are found."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    links = brute_links(rows)
    want, got = least_ids(rows, links), {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}
    assert all(got[i] >= c for (i, _), c in zip(rows, want))
    assert sum(got[rows[i][0]] == got[rows[j][0]] for i, j in links) >= 0.95 * len(links)


def random_sketches(rng, n):
    """Random sketches, each fourth a few bits from another, and some equal ones."""
    s = rng.integers(0, 1 << 63, (n, 3), dtype=np.uint64)
    for k in range(3, n, 4):
        s[k] = s[k - 1]
        for b in rng.integers(0, 192, rng.integers(0, 36)):
            s[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return s


def test_trie_finds_all_pairs_of_its_budget():
    rng = np.random.default_rng(1)
    s = random_sketches(rng, 1200)
    bits = np.bitwise_count(s[:, None, :] ^ s[None, :, :]).sum(2)
    for budget, spanning in ((SURE, True), (BUDGET, False)):
        got = set()
        for order, top in near_copies.layouts(len(s)):
            values = near_copies.laid_out(s, order)
            at = np.lexsort(values.T[::-1])
            key = values[at, 0] >> np.uint64(64 - top)
            for i, j in near_copies.trie_pairs(values[at], np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), top, np.arange(len(s)), budget, spanning):
                got |= {(min(a, b), max(a, b)) for a, b in zip(at[i].tolist(), at[j].tolist())}
        pieces = np.bitwise_count((s[:, None, :] ^ s[None, :, :]).view(np.uint32)).min(2)
        want = {(int(i), int(j)) for i, j in zip(*np.where((bits <= budget) & (pieces <= PIECE_ERRORS))) if i < j}
        assert got <= want and (spanning or got == want)
        rows = [(i, "") for i in range(len(s))]
        assert least_ids(rows, got) == least_ids(rows, want)
        if budget == SURE:
            assert want == {(int(i), int(j)) for i, j in zip(*np.where(bits <= SURE)) if i < j}


def test_texts_of_many_edits_do_not_meet_the_group_that_they_are_not_like(spark, monkeypatch):
    """The pairs that are sent to the exact check don't grow with the group's size times the number of such texts."""
    rng = random.Random(4)
    base = words(rng, 150)
    rows = [(i, edits(rng, base, 1 + i % 3)) for i in range(200)] + [(i, edits(rng, base, 7 + i % 3)) for i in range(200, 300)]
    sent, check = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: sent.append(pairs.count()) or check(pairs, *a))
    want = dict(zip((i for i, _ in rows), least_ids(rows, brute_links(rows))))
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, rows)).collect()} == want
    assert sum(sent) <= 10 * len(rows)


def test_parities_pass_all_pairs_that_are_alike():
    rng = np.random.default_rng(2)
    for n in (1, 5, 146, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for d in {0, n // 18, n // 9, n // 3}:
            b = np.r_[a[d:], rng.integers(0, 1 << 63, d, dtype=np.uint64)]
            alike = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            passed = near_copies.may_be_alike(near_copies.parities(a)[None], near_copies.parities(b)[None], 0.8)[0]
            assert passed or not alike
            assert n != 146 or d < n // 3 or not passed
