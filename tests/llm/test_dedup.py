import hashlib
import random
import re

import numpy as np
import xxhash

from quarrywise.llm import exact_dedup, simhash, substring_dedup


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def substring_brute(rows, width=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup_is_brute_force(edge, edge_rows, small):
    for df, rows in ((edge, edge_rows), (small, [(r.doc_id, r.text) for r in small.collect()])):
        got = substring_dedup.substring_dedup(df).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == substring_brute(rows)


def test_substring_dedup_without_rows(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_rolling_hashes_are_those_of_their_words():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 5, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = substring_dedup.Rolling(0x9E3779B97F4A7C15).hashes(w, 3)
    seen = {}
    for i in range(298):
        assert seen.setdefault(tuple(w[i : i + 3].tolist()), h[i]) == h[i]
    assert len(set(h.tolist())) == len(seen)


def test_exact_dedup(edge, edge_rows, empty):
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(edge).collect()), key=repr)
    want, taken = [], set()
    for i, t in edge_rows:
        same = [j for j, u in edge_rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        kept = i == keep and (t or "", i) not in taken
        taken.add((t or "", i))
        want.append((i, keep, len(same), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    kept = exact_dedup.drop_exact_copies(edge)
    assert kept.columns == edge.columns and sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr) == sorted(((i, t or "") for (i, t), w in zip(edge_rows, want) if w[3]), key=repr)
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.drop_exact_copies(empty).count() == 0


def test_grace_spills_until_a_bucket_fits():
    rng = random.Random(2)
    texts = [rng.choice("abc").encode() * rng.randint(0, 400) for _ in range(4000)]
    records = [(xxhash.xxh3_64_intdigest(t) >> 1, t, i, 1, 1) for i, t in enumerate(texts)]
    want = {}
    for _, t, i, _, _ in records:
        k, n = want.get(t, (i, 0))
        want[t] = (max(k, i), n + 1)
    for memory in (1 << 30, 20_000, 1_000):
        assert {t: (k, n) for _, t, k, n, _ in exact_dedup.grace_groups(iter(records), memory)} == want
    clash = [(7, b"a", 1, 1, 1), (7, b"b", 2, 1, 1), (7, b"a", 3, 1, 1)]
    assert sorted((t, k, n) for _, t, k, n, _ in exact_dedup.grace_groups(iter(clash), 100)) == [(b"a", 3, 2), (b"b", 2, 1)]


def fingerprint_brute(t):
    w = words(lower(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(f))]


def test_simhash_is_brute_force(edge, edge_rows, small, empty):
    for df, rows in ((edge, edge_rows), (small, [(r.doc_id, r.text) for r in small.collect()])):
        fps = [fingerprint_brute(t) for _, t in rows]
        roots = components_brute(fps)
        least = {}
        for (i, _), r in zip(rows, roots):
            if i is not None:
                least[r] = min(least.get(r, i), i)
        want = sorted(((i, format(f, "016x"), least.get(r)) for (i, _), f, r in zip(rows, fps, roots)), key=repr)
        assert sorted((tuple(r) for r in simhash.simhash_dedup(df).collect()), key=repr) == want
    assert simhash.simhash_dedup(empty).count() == simhash.drop_near_copies(empty).count() == 0
    kept = simhash.drop_near_copies(edge)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edge.columns and None in ids and 5 in ids and 9 not in ids and len(ids) == len(set(ids))


def test_trie_links_dense_and_sparse_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 62, 12, dtype=np.int64).astype(np.uint64)
    fps = set(rng.integers(0, 1 << 62, 300, dtype=np.int64).tolist())
    for c in centres:
        for _ in range(60):
            v = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                v ^= 1 << int(b)
            fps.add(v)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    for n in (10, 1 << 25, 1 << 35):  # each layout of the bits
        found = dict(simhash.components(simhash.links(spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, id long"), n)).collect())
        assert [found.get(i, i) for i in range(len(fps))] == components_brute(fps)


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = [(max(a, b), min(a, b)) for a, b in zip(order, order[1:])] + [(301, 300)]
    found = dict(simhash.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**{i: 0 for i in range(1, 200)}, 301: 300}
