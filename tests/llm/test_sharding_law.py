"""Shards against a tree that is grown in plain Python, and their law on the given table."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarrywise.llm import sharding


def tree_brute(rows, shards, dims):
    """rows: (key, size, crc, spread, dims...). Cuts as kd_leaves does, with no group dealt out."""
    spans = [max(r[4 + d] for r in rows) - min(r[4 + d] for r in rows) for d in range(dims)]
    out = {}

    def grow(part, leaves):
        if len(leaves) == 1 or not part:
            out.update((r[0], leaves[0]) for r in part)
            return
        wide = [(max(r[4 + d] for r in part) - min(r[4 + d] for r in part)) / max(1, spans[d]) for d in range(dims)]
        d = 4 + wide.index(max(wide))
        half = len(leaves) // 2
        target = sum(r[1] for r in part) * half / len(leaves)
        groups = defaultdict(int)
        for r in part:
            groups[r[d], r[2]] += r[1]
        below, low = 0, set()
        for g in sorted(groups):
            if below + groups[g] / 2 <= target or (below + groups[g] < target):
                low.add(g)
            below += groups[g]
            if below >= target:
                break
        grow([r for r in part if (r[d], r[2]) in low], leaves[:half])
        grow([r for r in part if (r[d], r[2]) not in low], leaves[half:])

    grow(rows, list(range(shards)))
    return out


def test_leaves_are_those_of_a_plain_tree(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(8, 400), rng.randrange(300), zlib.crc32(str(i).encode()), rng.randint(0, 50), rng.randint(0, 9)) for i in range(700)]
    rows = [(i, 8 + c, c, s, a, b) for i, _, c, s, a, b in rows]
    meta = spark.createDataFrame(rows, "doc_id long, size long, crc long, spread long, a long, b long")
    for shards in (2, 7, 24):
        got = sharding.kd_leaves(meta, dict.fromkeys(range(shards), 1.0), ("a", "b"), 1e9)
        assert {r.doc_id: r.shard for r in got.collect()} == tree_brute(rows, shards, 2)


def test_weights_are_kept(spark):
    meta = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("size"), F.crc32(F.col("id").cast("string")).alias("crc"), F.col("id").alias("spread"), F.lit(0).cast("long").alias("spot"))
    n = Counter(r.shard for r in sharding.kd_leaves(meta, {3: 1.0, 5: 2.0, 9: 7.0}, ("spot",), 1e9).collect())
    assert sorted(n) == [3, 5, 9] and all(abs(n[s] - 300 * w) < 5 for s, w in ((3, 1), (5, 2), (9, 7)))


def test_law_on_the_given_table(spark):
    """Every shard is within a fiftieth of the mean, though its largest documents are as large as that; equal texts share one, and slots have no gaps."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.kd_shards(docs).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 24 and abs(size / size.mean() - 1).max() < 0.02
    groups = got.groupby(["text_crc32", "size"]).agg(bytes=("size", "sum"), shards=("shard", "nunique"))
    assert (groups["shards"][groups["bytes"] <= sharding.WHOLE_SHARE * size.mean()] == 1).all()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
