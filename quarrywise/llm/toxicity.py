"""Toxicity: a factorization machine over hashed terms.

Besides a weight each term has a factor vector; the products of factors say how much two terms
mean together, such as an insult with a group, which a sum of weights can't say. Terms are words, the
beginnings of words, and how often they occur, hashed to a fixed number of buckets. The model is fitted to a bounded sample of labelled rows;
every row is scored, in one pass that broadcasts the model, whose size is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, materialize, whole_text

#: At most so many labelled rows are learned from, those of least hashed id, and so many of their buckets. Part of the operator's interface.
SAMPLE_ROWS, SAMPLE_PLACES = 20_000, 20_000_000
#: Terms are hashed to 2**BITS buckets; a term that occurs so often in a text has further buckets.
BITS, OFTEN = 18, (2, 3, 5)
#: Settings were chosen on a fold of the rows that may be learned from, not on the held-out ones. Passes over the sample are within EPOCHS, and enough for STEPS batches.
FACTORS, EPOCHS, STEPS, BATCH, RATE, L1, L2, SEED = 8, (8, 30), 4000, 32, 0.05, 1e-3, 1e-4, 7
#: Score from which a row is predicted toxic.
THRESHOLD = 0.3
#: So many texts are scored at a time.
SCORED = 500
#: Labels are learned from rows whose crc32(id) modulo FOLDS isn't HELD.
FOLDS, HELD = 4, 2

#: ASCII other than letters and digits parts words.
_ODD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
_PARTS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


class Terms(dict):
    """Word -> hashes of its terms: itself, and its first four and five letters if it is longer. Remembered up to a bound."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        text = word.decode("utf-8", "ignore")
        found = self[word] = (xxhash.xxh64_intdigest(word), *(xxhash.xxh64_intdigest(str(n) + text[:n]) for n in (4, 5) if len(text) > n))
        return found

    def of(self, text: bytes) -> np.ndarray:
        """Places of a text's terms, ascending: the bucket of a term, and a bucket of its own for each of OFTEN that its count reaches."""
        hashes = np.fromiter(chain.from_iterable(map(self.__getitem__, text.translate(_PARTS).split())), np.uint64)
        terms, counts = np.unique(hashes, return_counts=True)
        found = [terms, *(terms[counts >= n] * _ODD + np.uint64(n) for n in OFTEN)]
        return np.unique((np.concatenate(found) * _ODD >> _SHIFT).astype(np.int32))


def _segments(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; an empty run sums to zero."""
    out = np.zeros((len(starts), *values.shape[1:]))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[some])
    return out


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of buckets of the product of their factors); a bucket counts once in a text."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, idx: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
        v = self.factors[idx]
        total = _segments(v, starts, counts)
        pairs = 0.5 * (total**2 - _segments(v * v, starts, counts)).sum(1)
        return self.bias + _segments(self.weights[idx], starts, counts) + pairs, total

    def scores(self, texts: list[bytes], terms: Terms) -> np.ndarray:
        """Scores of texts, SCORED at a time whatever the size of a batch."""
        out = np.zeros(len(texts))
        for at in range(0, len(texts), SCORED):
            block = [terms.of(t) for t in texts[at : at + SCORED]]
            z, _ = self.raw(np.concatenate(block), np.array([len(r) for r in block], np.int64))
            out[at : at + SCORED] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_machine(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """AdaGrad on small batches of rows, with more passes over fewer rows; weights shrink towards zero by L1, so that buckets that say nothing say exactly nothing in texts of any length. The machine is the mean of those after the later passes."""
    rng, n = np.random.default_rng(SEED), 1 << BITS
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(n), rng.normal(0, 0.01, (n, FACTORS)))
    squares, v_squares, b_square = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    if not len(labels) or labels.min() == labels.max():
        m.factors[:] = 0
        return m
    fewest, most = EPOCHS
    passes = min(most, max(fewest, -(-STEPS * BATCH // len(rows))))
    mean = Machine(0.0, np.zeros_like(m.weights), np.zeros_like(m.factors))
    for k in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            counts = np.array([len(rows[i]) for i in pick])
            idx = np.concatenate([np.empty(0, np.int64), *(rows[i] for i in pick)])
            z, total = m.raw(idx, counts)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            per = np.repeat(g, counts)
            used, place = np.unique(idx, return_inverse=True)
            gw = np.bincount(place, per, len(used))
            spread = np.repeat(total, counts, axis=0) - m.factors[idx]
            gv = np.stack([np.bincount(place, per * spread[:, f], len(used)) for f in range(FACTORS)], 1) + L2 * m.factors[used]
            squares[used] += gw * gw
            v_squares[used] += gv * gv
            step = RATE / np.sqrt(squares[used])
            w = m.weights[used] - step * gw
            m.weights[used] = np.sign(w) * np.maximum(0, np.abs(w) - step * L1)
            m.factors[used] -= 0.3 * RATE * gv / np.sqrt(v_squares[used])
            b_square += g.sum() ** 2
            m.bias -= RATE * g.sum() / np.sqrt(b_square)
        if k >= passes // 2:
            share = 1 / (passes - passes // 2)
            mean.bias += share * m.bias
            mean.weights += share * m.weights
            mean.factors += share * m.factors
    return mean


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_places: int = SAMPLE_PLACES) -> Machine:
    """A machine fitted to at most sample_rows labelled rows of docs (doc_id, text) that aren't held out, and to no more of them than have sample_places buckets together. labels: doc_id, label 0 or 1."""
    given = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    # Labelled documents that are here, by the order of a hash; the sample's bound is also the broadcast's.
    here = given.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = here.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            places = [terms.of(t).tobytes() for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(places, pa.binary())], ["label", "h", "doc_id", "places"])

    found = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label", "h", F.col("doc_id").alias("d"))
    rows = materialize(found.mapInArrow(hashed, "label int, h long, doc_id long, places binary"))
    places, said, held = [], [], 0
    for r in rows.orderBy("h", "doc_id", "places").toLocalIterator():
        places.append(np.frombuffer(bytes(r.places), np.int32))
        said.append(r.label)
        held += len(places[-1])
        if held >= sample_places:
            break
    return fit_machine(places, np.array(said, float))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns label_col only from rows that aren't held out; only the text enters a score. Null and empty
    texts have no terms and score what the bias says. No labels, or labels of one kind, give every
    text the same score. Of labels that repeat an id the largest counts. A null id is not held out.
    Other columns of docs are left out.
    """
    own = whole_text(docs, id_col, text_col)
    machine = learn(own, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label")), sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, terms = sent.value, Terms()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(as_bytes(b.column(1)), terms))], ["doc_id", "score"])

    rows = own.mapInArrow(score, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs that toxicity doesn't predict toxic, with docs' own columns. The text is scored where it is read, so nothing is shuffled."""
    machine = learn(whole_text(docs, id_col, text_col), labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label")))
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, terms = sent.value, Terms()
        for b in batches:
            yield b.filter(pa.array(m.scores(as_bytes(b.column(at)), terms) < THRESHOLD))

    return docs.mapInArrow(clean, docs.schema)
