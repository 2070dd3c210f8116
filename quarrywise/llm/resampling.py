"""Target-distribution importance resampling: documents like a target's texts are drawn without replacement.

Hashed n-gram counts of the corpus and of the target give a gain for each bucket; a document's
weight is the mean gain of its features, read from one array. Gumbel noise by document makes the k
highest scores a weighted draw. The k-th key is found by distributed quickselect, so that nothing is
sorted but the winners.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, materialize, whole_text

#: Hash buckets, words in the longest feature, seed of the draw, words that a document needs to be drawn, and the share drawn, in percent.
BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Random pivots that a round of the selection counts against.
PIVOTS = 15

#: Bytes of words in lower case; all others are blanks.
WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in LOWER)

_KEYS = "score long, doc_id long, has_id boolean"


def item_words(text: bytes) -> list[bytes]:
    """Words of digits, ASCII letters in lower case and whatever is beyond ASCII."""
    return text.translate(WORD_BYTES).split()


class Buckets(dict):
    """Feature -> its bucket, remembered up to a bound."""

    def __init__(self, n: int, most: int = 400_000):
        super().__init__()
        self.n, self.most = n, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.n
        return b

    def of(self, words: list[bytes], longest: int) -> np.ndarray:
        """The buckets of all runs of 1 to `longest` words, repeats included."""
        runs = [b" ".join(words[i : i + k]) for k in range(2, longest + 1) for i in range(len(words) - k + 1)]
        return np.fromiter(map(self.__getitem__, [*words, *runs]), np.int64, len(words) + len(runs))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how many features of all texts are in each bucket that has any. A task folds its own first and sends `buckets` rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                n += np.bincount(of.of(item_words(text), longest), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the corpus. The driver sees `buckets` counts of each, however large they are."""
    counts = []
    for rows in (docs, target):
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(rows, text_col, buckets, longest).collect():
            n[r.bucket] = r.n
        counts.append(n)
    own, like = counts
    all_own, all_like = float(own.sum() + buckets), float(like.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(t + 1) * all_own) / (float(s + 1) * all_like))) for s, t in zip(own.tolist(), like.tolist())], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of each document's features, 0 without any."""
    buckets = len(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(buckets)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in as_bytes(batch.column(1)):
                words = item_words(text)
                at = of.of(words, longest)
                n_words.append(len(words))
                n_features.append(len(at))
                weight.append(int(gains[at].sum()) // max(1, len(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return whole_text(docs, id_col, text_col).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g), g the Gumbel deviate of the first 32 bits of sha256(`seed:doc_id`); a null id is no characters."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _before(a: tuple, b: tuple) -> Column:
    """Whether key a comes before b: a higher score, then a smaller doc_id, then none. Keys are (score, doc_id, has_id)."""
    (s, i, has), (t, j, had) = a, b
    return (s > t) | ((s == t) & ((has & ~had) | ((has == had) & (i < j))))


def _key(r) -> tuple:
    return F.lit(r.score).cast("long"), F.lit(r.doc_id).cast("long"), F.lit(r.has_id)


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS, seed: int = 0):
    """The key (score, doc_id, has_id) of keys that is k-th, from 1, in order, or None if there are fewer.

    A round draws random keys of those still open as pivots, counts exactly how many open keys are before and how many
    equal to each, and keeps the keys between the two pivots that enclose the k-th, until it is a pivot itself. A pivot is
    one of the open keys, so each round leaves fewer, and copies of one key, however many, leave together.
    keys is read once a round, so it should be a written table.
    """
    own, low, high, turn = (F.col("score"), F.col("doc_id"), F.col("has_id")), None, None, seed
    while True:
        rows = keys
        if low is not None:
            rows = rows.where(_before(_key(low), own))
        if high is not None:
            rows = rows.where(_before(own, _key(high)))
        drawn = sorted({(-r.score, not r.has_id, r.doc_id): r for r in rows.orderBy(F.xxhash64(F.lit(turn), *own), *own).limit(pivots).collect()}.items())
        if not drawn:
            return None
        drawn = [r for _, r in drawn]
        sums = [F.struct(F.count_if(_before(own, _key(r))).alias("before"), F.count_if((own[0] == r.score) & (own[1] == r.doc_id) & (own[2] == r.has_id)).alias("same")) for r in drawn]
        low_next, below = low, 0
        for r, n in zip(drawn, rows.agg(F.array(*sums).alias("n")).first().n):
            if n.before < k <= n.before + n.same:
                return r
            if k <= n.before:
                high = r
                break
            low_next, below = r, n.before + n.same
        low, k, turn = low_next, k - below, turn + 1


def ranked(winners: DataFrame) -> DataFrame:
    """winners with their rank, from 1, by key: sorted ranges are counted, and each range's ranks begin after those before it. The driver sees one count for each range."""
    order = (F.desc("score"), F.desc("has_id"), F.asc("doc_id"))
    ranged = materialize(winners.orderBy(*order).withColumn("part", F.spark_partition_id()))
    starts, total = [], 0
    for part, n in sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, total))
        total += n
    first = F.lit(0).cast("long") if not starts else F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("part")).cast("long")
    return ranged.withColumn("rank", first + F.row_number().over(Window.partitionBy("part").orderBy(*order))).drop("part")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (of those drawn, from 1; null for others).

    Of the rows with at least `least_words` words the floor of `percent` percent with the highest scores are
    drawn, ties to the smaller doc_id and a null id last; of rows that repeat an id and a score as many
    as fit. A null or empty text has no features and weight 0. target's texts are in the column of the same name. Other
    columns are left out. No rows give no rows; a target without texts leaves the smoothed shares alone.
    """
    gains = bucket_gains(docs, target, text_col, buckets, longest)
    scored = weights(docs, gains, id_col, text_col, longest).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))
    rows = materialize(scored.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "n_words", "n_features", "weight", "score"))
    fit = rows.where(F.col("n_words") >= least_words)
    k = fit.count() * percent // 100
    last = kth_key(fit.select("score", "doc_id", "has_id"), k) if k else None
    out = lambda df, rank: df.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "n_features", "weight", "score", rank.cast("long").alias("rank"))
    if last is None:
        return out(rows, F.lit(None))
    won = (F.col("n_words") >= least_words) & ~_before(_key(last), (F.col("score"), F.col("doc_id"), F.col("has_id")))
    # Copies of the last key may be more than fit; those beyond k have no rank.
    return out(ranked(rows.where(won)), F.when(F.col("rank") <= k, F.col("rank"))).unionByName(out(rows.where(~won), F.lit(None)))
