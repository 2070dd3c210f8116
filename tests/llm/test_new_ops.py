"""Byte-level BPE, periodic runs and resampling against plain Python, and their edge cases."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as vocab
import pytest
import tiktoken
from conftest import frame
from pyspark.sql import functions as F

from quarrywise.llm import byte_bpe, resampling, runs
from quarrywise.llm.queries import QUERIES, RANKS

SMALL = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Byte-level BPE


def test_words_are_merged_as_the_library_does(reference):
    ranks, rng = byte_bpe.read_ranks(RANKS), random.Random(3)
    words = ["", "a", " the", "x" * 3000, "ab" * 700, "é" * 50, "漢字", " \n \t", "hello", "aaaaaaaaab"]
    words += ["".join(rng.choice("abcdeöü z'0189\n.;") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for w in words:
        if w:
            assert byte_bpe.encode_word(w.encode(), ranks) == reference.encode_single_piece(w) if hasattr(reference, "encode_single_piece") else reference._encode_single_piece(w)


def test_encoding_and_decoding_the_given_table(spark, small, reference):
    got = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, SMALL).collect()}
    assert len(got) == small.count()
    for r in small.collect():
        ids = reference.encode_ordinary(r.text or "")
        assert tuple(got[r.doc_id])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(r.text or ""))


@pytest.mark.parametrize("block_bytes", [1, 3000, 8 << 20])
def test_encoding_edge_rows(spark, edge, edge_rows, reference, block_bytes):
    got = sorted((repr(r.doc_id), list(r.ids)) for r in byte_bpe.encode(edge, RANKS, block_bytes=block_bytes).collect())
    assert got == sorted((repr(i), reference.encode_ordinary(t or "")) for i, t in edge_rows)


def test_encoding_twice_read_rows_and_none(spark, edge, edge_rows, empty):
    twice = byte_bpe.decode(byte_bpe.encode(edge.coalesce(1).union(edge.coalesce(1)), RANKS), RANKS)
    assert sorted((repr(r.doc_id), bytes(r.bytes)) for r in twice.collect()) == sorted(2 * [(repr(i), (t or "").encode()) for i, t in edge_rows])
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS), RANKS).collect() == []
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r.n_tokens, r.sha256) for r in byte_bpe.decode(none, RANKS).collect()] == [(0, sha(""))] * 2
    with pytest.raises(Exception, match="isn't in the table"):
        byte_bpe.decode(spark.createDataFrame([(1, [-1])], "doc_id long, ids array<int>"), RANKS).collect()


def test_each_distinct_word_is_encoded_once(spark, small):
    parts = byte_bpe.PARTS * 4
    sent = byte_bpe.blocks(small.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), vocab.PATTERN, parts, 20_000)
    per_block = sent.groupBy("block").agg(F.count("*").alias("n")).collect()
    assert len(per_block) > 1 and all(r.n <= parts + 1 for r in per_block)
    # A word's part depends on the word alone, so all blocks' rows of it meet.
    assert sent.where("part >= 0").where("key <> -1 - part").count() == 0


# Periodic runs


def runs_brute(w):
    """(start, length, period) by the definition: every stretch, its smallest period from a plain failure function."""
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and (i == 0 or w[i - 1] != w[i - 1 + q]):
                s = w[i : j + q]
                fail, k = [0] * len(s), 0
                for m in range(1, len(s)):
                    while k and s[m] != s[k]:
                        k = fail[k - 1]
                    k += s[m] == s[k]
                    fail[m] = k
                if len(s) - fail[-1] == q:
                    out.add((i, len(s), q))
            i = j + 1
    return sorted(out)


def kept_brute(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(x for i, x in enumerate(words) if i not in gone)


def periodic(rng, n):
    """Words with runs of all octaves, nested, neighbouring and broken ones."""
    out = []
    while len(out) < n:
        kind = rng.randint(0, 5)
        if kind == 0:
            out += [rng.randint(0, 3) for _ in range(rng.randint(1, 60))]
        elif kind == 1:
            out += [rng.randint(0, 1)] * rng.randint(1, 80)
        else:
            root = [rng.randint(0, 2 if kind < 4 else 500) for _ in range(rng.choice((1, 2, 3, 7, 8, 15, 16, 17, 31, 32, 33, 63, 64, 65, 130)))]
            out += (root * 12)[: rng.randint(len(root), 9 * len(root))]
            if kind == 5 and len(out) > 5:
                out[-rng.randint(1, 5)] = 7
    return out


def test_tiles_give_the_runs_of_the_definition():
    rng = random.Random(11)
    for trial in range(150):
        w = periodic(rng, rng.choice((5, 30, 200, 900)))
        advance = rng.choice((1, 64, 4096))
        spans = {}
        for step, origin, low, high, words in runs.tiles(np.array(w, np.int64), advance):
            for q, a, b in runs.solve(step, origin, low, high, runs.unpacked(words).tolist()):
                spans.setdefault(q, []).append((a, b))
        got = []
        for q, parts in spans.items():
            at = None
            for a, b in sorted(parts):
                if at and a <= at[1]:
                    at[1] = max(at[1], b)
                else:
                    at = [a, b]
                    got.append((q, at))
        assert sorted((a, b - a + q, q) for q, (a, b) in got if b - a + q >= max(24, 3 * q)) == runs_brute(w), (trial, w)


def test_z_function():
    rng = random.Random(2)
    for _ in range(50):
        x = [rng.randint(0, 1) for _ in range(rng.randint(0, 40))]
        assert runs.z_function(x) == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


def test_runs_query_is_the_definition(spark, small):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    for r in small.collect():
        words = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 2500:
            continue  # the definition takes the square of n; the SQL looks at these too
        found = runs_brute(words)
        best = max(found, key=lambda x: (np.longdouble(x[1]) / x[2], -x[0], -x[2]), default=None)
        want = (r.doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(kept_brute(words, found)))
        assert tuple(got[r.doc_id]) == want


@pytest.mark.parametrize("advance", [1, 4096])
def test_runs_of_edge_rows(spark, edge, edge_rows, empty, advance):
    got = runs.periodic_runs(edge, with_text=True, advance=advance).collect()
    want = []
    for i, t in edge_rows:
        words = (t or "").encode().split()
        found = runs_brute(words) if len(words) < 500 else []
        want.append((repr(i), len(words), found, kept_brute(words, found).decode()))
    assert sorted((repr(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in got) == sorted(want)
    assert all(r.kept_sha256 == sha(r.kept_text) for r in got)
    assert runs.run_digest(runs.periodic_runs(empty)).collect() == []


def test_one_long_run_is_stitched(spark):
    """A text of many tiles in several octaves, and one word a hundred thousand times."""
    rng = random.Random(7)
    root = [f"w{rng.randint(0, 10**6)}" for _ in range(5000)]
    rows = [(1, " ".join(root * 4)), (2, "a " * 100_000), (3, " ".join(root))]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.periodic_runs(frame(spark, rows)).collect()}
    assert got == {1: [(0, 20_000, 5000)], 2: [(0, 100_000, 1)], 3: []}


# Resampling


def test_quickselect_finds_every_key(spark):
    rng = random.Random(5)
    rows = [(rng.randint(-5, 5), rng.randint(0, 20), rng.random() < 0.9) for _ in range(300)]
    keys = spark.createDataFrame(rows, resampling._KEYS).cache()
    order = sorted(rows, key=lambda r: (-r[0], not r[2], r[1]))
    for k in (1, 2, 77, 150, 299, 300):
        assert tuple(resampling.kth_key(keys, k, pivots=2)) == order[k - 1]
    assert resampling.kth_key(keys, 301) is None


def resampled_brute(rows, items, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    def features(t):
        w = resampling.item_words((t or "").encode())
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t, held = np.zeros(buckets, int), np.zeros(buckets, int), [features(x) for _, x in rows]
    for _, f in held:
        for b in f:
            s[b] += 1
    for x in items:
        for b in features(x)[1]:
            t[b] += 1
    gains = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + buckets) / ((a + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for (i, _), (n, f) in zip(rows, held):
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        weight = sum(gains[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted(repr(tuple(r[:5])) for r in out)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 50), (1, 100), (1, 0)])
def test_resampling_edge_rows(spark, edge, edge_rows, empty, longest, percent):
    items = ["alpha1 beta2 gamma3 of4", None, ""]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = resampling.resample(edge, target, longest=longest, percent=percent)
    assert sorted(repr(tuple(r)) for r in got.collect()) == resampled_brute(edge_rows, items, longest, percent=percent)
    assert resampling.resample(empty, target).collect() == []
    assert resampling.resample(edge, target.limit(0)).count() == len(edge_rows)
