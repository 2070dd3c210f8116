"""LM scoring: a Katz backoff model of words and pairs of words, with Good-Turing discounts and exactly normalised backoff weights.

Counting and lookups travel packed. Documents are dealt to chunks by a hash of their id. A chunk
sends its distinct n-grams once, as sorted arrays of 64-bit hashes cut by hash range into buckets,
so a frequent n-gram is one entry for each chunk and no key is hot. A bucket adds the counts up
and answers every chunk with an array in the order of what it sent. Count tables are written by
order and bucket; backoff weights are a table by context. Nothing of a size that follows the data
is broadcast or collected: the driver sees counts of counts, N and V.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, as_bytes, materialize, whole_text

#: Rows whose crc32(id) modulo FOLDS is HELD aren't learned from.
FOLDS, HELD = 7, 2
#: Counts up to this are discounted; pairs seen less often than MIN_PAIR, or a caller's min_pair, leave their mass to backoff, as Katz proposed for singletons. 1 keeps every pair.
DISCOUNTED, MIN_PAIR = 6, 2
#: Bytes of text in a chunk, and n-grams in a bucket.
CHUNK_BYTES, BUCKET_GRAMS = 6 << 20, 2_000_000
#: Marks of a text's end, which is a token, and of its beginning, which is only a context.
END, BEGIN = b" end", b" begin"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SENT = "ord int, bucket int, chunk int, keys binary, counts binary"
_TOTALS = "ord int, bucket int, chunk int, keys binary, totals binary"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * _ODD + w
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def discounts(n: np.ndarray, least: int = 1) -> np.ndarray:
    """Good-Turing ratios d[r] for r = 0 .. DISCOUNTED from counts of counts n[r]; d is 0 under least, and r - 1/2 over r where the counts of counts give none in (0, 1]."""
    k = DISCOUNTED
    d = np.zeros(k + 1)
    common = (k + 1) * n[k + 1] / n[1] if n[1] else np.inf
    for r in range(least, k + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else -1.0
        d[r] = good if 0 < good <= 1 else (r - 0.5) / r
    return d


@dataclass(frozen=True)
class Totals:
    """What the driver knows of the model: tokens, distinct tokens, discounts of words and pairs, and the share of unseen words."""

    tokens: int
    types: int
    d1: np.ndarray
    d2: np.ndarray
    unseen: float
    scale: float

    @classmethod
    def of(cls, tokens: int, types: int, n1: np.ndarray, n2: np.ndarray, min_pair: int = MIN_PAIR) -> Totals:
        d1, d2 = discounts(n1), discounts(n2, min_pair)
        lost = sum((1 - d1[r]) * r * n1[r] for r in range(1, DISCOUNTED + 1))
        # Words that are all frequent lose nothing; one more token then stands for the unseen.
        whole = tokens + (1 if lost <= 0 else 0)
        unseen = (lost if lost > 0 else 1) / max(1, whole)
        return cls(tokens, types, d1, d2, unseen, 1 / max(1, whole))

    def word(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word with count c; all unseen words together are one event."""
        return np.where(c > 0, _discounted(c, self.d1) * self.scale, self.unseen)


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= DISCOUNTED, d[np.minimum(c, DISCOUNTED)], 1.0) * c


class Chunk:
    """The tokens of some documents, as hashes, and their distinct words and pairs."""

    def __init__(self, ids: list, texts: list[bytes]):
        words = WordHashes(most=200_000)
        end, begin = words[END], words[BEGIN]
        per = [words.of([*t.translate(LOWER).split(), END]) for t in texts]
        self.ids, self.lengths = ids, np.array([len(p) for p in per])
        self.w = np.concatenate([np.empty(0, np.uint64), *per])
        self.v = np.r_[np.uint64(begin), self.w[:-1]] if len(self.w) else self.w
        self.v[np.cumsum(self.lengths)[:-1]] = begin
        self.train = np.repeat(np.array([not held_out(i) for i in ids], bool), self.lengths)
        # Contexts are words too but for the beginning, so one array of words serves both.
        self.words, at = np.unique(np.r_[self.w, np.uint64(begin)], return_inverse=True)
        self.w_at = at.astype(np.int32)
        self.begin_at = self.w_at[-1]
        self.w_at = self.w_at[:-1]
        self.v_at = np.r_[self.begin_at, self.w_at[:-1]]
        self.v_at[np.cumsum(self.lengths)[:-1]] = self.begin_at
        self.pairs, at = np.unique(pair_keys(self.v, self.w), return_inverse=True)
        self.p_at = at.astype(np.int32)
        self.v = self.w = None  # places say all that is needed from here on
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        assert end != begin

    def counts(self, order: int) -> np.ndarray:
        """Training counts; the beginning counts once for each training document, but not as a token."""
        at, n = (self.w_at, len(self.words)) if order == 1 else (self.p_at, len(self.pairs))
        c = np.bincount(at[self.train], minlength=n)
        if order == 1:
            c[self.begin_at] = sum(not held_out(i) for i in self.ids)
        return c.astype(np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)


def _edges(buckets: int) -> np.ndarray:
    """The least hash of each bucket."""
    step = np.uint64((1 << 64) // buckets) if buckets > 1 else np.uint64(0)
    return np.arange(buckets, dtype=np.uint64) * step


def _bounds(keys: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket begins in sorted keys, and their end."""
    return [*np.searchsorted(keys, _edges(buckets)).tolist(), len(keys)]


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


def _chunk(table: pa.Table) -> Chunk:
    return Chunk(table.column("doc_id").to_pylist(), as_bytes(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())))


def _answers(table: pa.Table, order: int, column: str, kind: str) -> np.ndarray:
    """Buckets' answers of an order, in the order of the chunk's n-grams."""
    got = sorted((b, a) for o, b, a in zip(table.column("ord").to_pylist(), table.column("bucket").to_pylist(), table.column(column).to_pylist()) if o == order)
    return np.concatenate([np.empty(0, kind), *(_unpacked(a, kind) for _, a in got)])


_INTS = [("ord", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32())]


class Katz:
    """A model of docs' training rows and what it takes to score docs."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_grams: int = BUCKET_GRAMS, min_pair: int = MIN_PAIR):
        self.min_pair = min_pair
        rows = whole_text(docs, id_col, text_col)
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.chunks, self.buckets = max(1, -(-size // chunk_bytes)), max(1, -(-size // (6 * bucket_grams)))
        self.docs = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.chunks)).cast("int"))
        self.counts = materialize(self._counted(), "ord")
        self.totals = self._summed()
        self.backoff = materialize(self._weights())

    def _counted(self) -> DataFrame:
        """Counts by order and bucket. A row with a chunk answers it; one without holds the bucket's counts of counts, tokens and types."""
        buckets = self.buckets

        def send(table: pa.Table) -> pa.Table:
            c, chunk, rows = _chunk(table), table.column("chunk")[0].as_py(), []
            for order, keys in ((1, c.words), (2, c.pairs)):
                counts, at = c.counts(order), _bounds(keys, buckets)
                if order == 1:  # the beginning is told from words by a count under zero
                    counts[c.begin_at] = -1 - counts[c.begin_at]
                for b in np.flatnonzero(np.diff(at)).tolist():
                    rows.append((order, b, chunk, keys[at[b] : at[b + 1]].tobytes(), _packed(counts[at[b] : at[b + 1]].astype("<i8"))))
            return _table(rows, [*_INTS, ("keys", pa.binary()), ("counts", pa.binary())])

        def add(table: pa.Table) -> pa.Table:
            order, bucket = table.column("ord")[0].as_py(), table.column("bucket")[0].as_py()
            chunks, sent = table.column("chunk").to_pylist(), table.column("keys").to_pylist()
            keys = np.frombuffer(b"".join(sent), np.uint64)
            counts = np.concatenate([_unpacked(x, "<i8") for x in table.column("counts").to_pylist()])
            begins = counts < 0
            distinct, at = np.unique(keys, return_inverse=True)
            totals = np.bincount(at, np.where(begins, -1 - counts, counts), len(distinct)).astype(np.int64)
            real = np.ones(len(distinct), bool)
            real[at[begins]] = False
            seen = totals[real]
            facts = np.r_[np.bincount(seen[seen <= DISCOUNTED + 1], minlength=DISCOUNTED + 2), seen.sum(), (seen > 0).sum()].astype("<i8")
            # One chunk owns each n-gram; its answer is under zero.
            owner = np.zeros(len(keys), bool)
            owner[np.unique(at, return_index=True)[1]] = True
            answer = np.where(owner, -1 - totals[at], totals[at]).astype("<i8")
            rows, edge = [(order, bucket, None, b"", facts.tobytes())], 0
            for chunk, k in zip(chunks, sent):
                n = len(k) // 8
                rows.append((order, bucket, chunk, k if order == 1 else b"", _packed(answer[edge : edge + n])))
                edge += n
            return _table(rows, [*_INTS, ("keys", pa.binary()), ("totals", pa.binary())])

        return self.docs.groupBy("chunk").applyInArrow(send, _SENT).groupBy("ord", "bucket").applyInArrow(add, _TOTALS)

    def _summed(self) -> Totals:
        facts = {1: np.zeros(DISCOUNTED + 4, np.int64), 2: np.zeros(DISCOUNTED + 4, np.int64)}
        for r in self.counts.where("chunk IS NULL").select("ord", "totals").toLocalIterator():
            facts[r.ord] += np.frombuffer(r.totals, "<i8")
        return Totals.of(int(facts[1][-2]), int(facts[1][-1]), facts[1][:-2], facts[2][:-2], self.min_pair)

    def _replies(self) -> DataFrame:
        return self.counts.where("chunk IS NOT NULL")

    def _weights(self) -> DataFrame:
        """(v, bucket, log_bow, extra): for each context with pairs of its own, log10 of its backoff weight, and what its count grows by to divide its pairs' discounted counts."""
        totals, buckets, min_pair = self.totals, self.buckets, self.min_pair

        def own(key, left: pa.Table, right: pa.Table) -> pa.Table:
            c = _chunk(left)
            words, pairs = _answers(right, 1, "totals", "<i8"), _answers(right, 2, "totals", "<i8")
            words = np.where(words < 0, -1 - words, words)
            owned = pairs < 0
            pairs = np.where(owned, -1 - pairs, pairs)
            first = np.unique(c.p_at, return_index=True)[1]
            mine = owned & (pairs >= min_pair)
            v, w, n = c.v_at[first[mine]], c.w_at[first[mine]], pairs[mine]
            at, place = np.unique(v, return_inverse=True)
            sums = [np.bincount(place, x, len(at)).astype(float) for x in (_discounted(n, totals.d2), totals.word(words[w]))]
            bucket = np.searchsorted(_edges(buckets), c.words[at], "right") - 1
            return pa.table([pa.array(c.words[at].view(np.int64)), pa.array(bucket.astype(np.int32)), pa.array(words[at]), pa.array(sums[0]), pa.array(sums[1])], names=["v", "bucket", "n", "mass", "low"])

        parts = self.docs.groupBy("chunk").cogroup(self._replies().drop("keys").groupBy("chunk")).applyInArrow(own, "v long, bucket int, n long, mass double, low double")
        sums = parts.groupBy("v", "bucket").agg(F.max("n").alias("n"), F.sum("mass").alias("mass"), F.sum("low").alias("low"))
        # A context whose pairs keep all of its mass gives one more count to the others.
        extra = F.when(F.col("mass") < F.col("n") - 1e-9, 0).otherwise(1)
        bow = F.log10((1 - F.col("mass") / (F.col("n") + F.col("extra"))) / (1 - F.col("low")))
        return sums.withColumn("extra", extra).select("v", "bucket", bow.alias("log_bow"), "extra")

    def _weight_replies(self) -> DataFrame:
        """For each chunk's words the weight (order 3) and extra count (order 4) of the context that they are."""

        def reply(key, left: pa.Table, right: pa.Table) -> pa.Table:
            v = right.column("v").to_numpy().view(np.uint64)
            order = np.argsort(v)
            v, values = v[order], [(o, right.column(c).to_numpy()[order], kind) for o, c, kind in ((3, "log_bow", "<f8"), (4, "extra", "u1"))]
            rows = []
            for chunk, bucket, sent in zip(left.column("chunk").to_pylist(), left.column("bucket").to_pylist(), left.column("keys").to_pylist()):
                keys = np.frombuffer(sent, np.uint64)
                at = np.minimum(np.searchsorted(v, keys), max(0, len(v) - 1))
                hit = v[at] == keys if len(v) else np.zeros(len(keys), bool)
                for o, x, kind in values:
                    out = np.zeros(len(keys), kind)
                    out[hit] = x[at[hit]]
                    rows.append((o, bucket, chunk, _packed(out)))
            return _table(rows, [*_INTS, ("totals", pa.binary())])

        asked = self._replies().where("ord = 1").select("chunk", "bucket", "keys")
        return asked.groupBy("bucket").cogroup(self.backoff.groupBy("bucket")).applyInArrow(reply, "ord int, bucket int, chunk int, totals binary")

    def score(self) -> DataFrame:
        totals, min_pair = self.totals, self.min_pair

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            c = _chunk(left)
            words, pairs = (_answers(right, o, "totals", "<i8") for o in (1, 2))
            words, pairs = (np.where(x < 0, -1 - x, x) for x in (words, pairs))
            log_bow, whole = _answers(right, 3, "totals", "<f8"), words + _answers(right, 4, "totals", "u1")
            cw, cp = words[c.w_at], pairs[c.p_at]

            def log_p(order: int, at: np.ndarray) -> np.ndarray:
                """log10 P of the tokens at these places: of the highest order if the n-gram was seen, else the context's backoff weight times P of the next lower order."""
                if order == 1:
                    return np.log10(totals.word(cw[at]))
                seen = cp[at] >= min_pair
                own, rest, out = at[seen], at[~seen], np.empty(len(at))
                out[seen] = np.log10(_discounted(cp[own], totals.d2) / whole[c.v_at[own]])
                out[~seen] = log_bow[c.v_at[rest]] + log_p(order - 1, rest)
                return out

            logs = log_p(2, np.arange(len(c.w_at)))
            base = np.log10((cw + 1) / (totals.tokens + totals.types + 1))
            held = [held_out(i) for i in c.ids]
            return pa.table(
                [pa.array(c.ids, pa.int64()), pa.array(held), pa.array(c.lengths), pa.array(c.sums((cw > 0).astype(np.int64))), pa.array(np.full(len(held), totals.tokens)), pa.array(c.sums(base)), pa.array(c.sums(logs))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        replies = self._replies().select("ord", "bucket", "chunk", "totals").unionByName(self._weight_replies())
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return self.docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_grams: int = BUCKET_GRAMS, min_pair: int = MIN_PAIR) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased words and one end. score is log10 of the model's probability of the text:
    P(w|v) is the discounted share of v's pairs that are vw if that pair was seen min_pair times, else
    v's backoff weight times P(w). Words never seen in training share one event, as in base_score, which is the
    add-one unigram. Null and empty texts are the end alone. A null id is not held out. Repeated rows
    count, and are scored, each. With nothing to learn from, each token is the unseen event. Other
    columns are left out. No rows give no rows.
    """
    return Katz(docs, id_col, text_col, chunk_bytes, bucket_grams, min_pair).score()
