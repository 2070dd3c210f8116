"""Byte-level BPE: a global shuffle of distinct words, each encoded once.

Documents are taken in blocks. A block explodes to its distinct pre-tokens, in parts by their hash, and the
sequence of their numbers, which holds their positions. All blocks' rows of a part meet in one
partition, where each distinct word is encoded once; its ids join back to the blocks that have it, and a block's
documents are put together again by position. Decoding joins ids with the token-byte table.

What travels is packed: a row holds a block's words of one part, so there are never more rows than
distinct words of blocks. A frequent word costs each block one entry, however often it occurs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, whole_text

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Parts of words for each shuffle partition, so that partitions come out even.
PARTS = 4

_SENT = "key long, part int, block long, doc_ids array<long>, lengths array<long>, parts binary, body binary"
_NAMES = ["key", "part", "block", "doc_ids", "lengths", "parts", "body"]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, of a rank file: lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: bytes by id. It's as large as the vocabulary, whatever the corpus."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of neighbours whose joined bytes are a token, those of the least rank are joined first, the leftmost of equals; a heap of pairs keeps long words cheap."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part begins at its place and ends at end[place]
    due: list[int | None] = [None] * n  # the rank of a part with the next one
    heap: list[tuple[int, int]] = []

    def pair(at: int) -> None:
        e = end[at]
        due[at] = ranks.get(word[at : end[e]]) if e < n else None
        if due[at] is not None:
            heapq.heappush(heap, (due[at], at))

    for at in range(n - 1):
        pair(at)
    while heap:
        rank, at = heapq.heappop(heap)
        if due[at] != rank:
            continue
        gone = end[at]
        end[at], due[gone] = end[gone], None
        if end[at] < n:
            before[end[at]] = at
        pair(at)
        if before[at] >= 0:
            pair(before[at])
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


class Numbers(dict):
    """Word -> its number, in the order in which words first come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Block:
    """Documents that are taken together: their pre-tokens by number."""

    def __init__(self):
        self.numbers, self.digest = Numbers(), xxhash.xxh3_64()
        self.ids: list[int | None] = []
        self.sequences: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str, found: list[str]) -> None:
        self.ids.append(doc_id)
        self.sequences.append(np.fromiter(map(self.numbers.__getitem__, found), np.uint32, len(found)))
        raw = text.encode()
        self.digest.update(f"{doc_id}:{len(raw)}:".encode() + raw)
        self.bytes += len(raw)

    def rows(self, parts: int) -> pa.RecordBatch:
        """One row of sequences, and one for the words of each part. A block is named by its contents, so that a task that is run again names it the same."""
        name, words = self.digest.intdigest() >> 1, [w.encode() for w in self.numbers]
        part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words), np.int64, len(words))
        order = np.argsort(part, kind="stable")
        held, first = np.unique(part[order], return_index=True)
        sizes = np.array([len(s) for s in self.sequences])
        out = [(name, -1, name, self.ids, sizes.tolist(), packed(part.astype(np.uint32)), packed(np.concatenate(self.sequences)))]
        for p, a, b in zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            mine = [words[i] for i in order[a:b].tolist()]
            out.append((-1 - p, p, name, None, None, packed(np.array([len(w) for w in mine])), zstandard.compress(b"".join(mine), 3)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], _NAMES)


def blocks(docs: DataFrame, pattern: str, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) as packed rows: of each block its documents' sequences (key: the block) and its words of each part (key: -1 - part)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, block = regex.compile(pattern).findall, Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block.ids and block.bytes + len(text) > block_bytes:
                    yield block.rows(parts)
                    block = Block()
                block.add(doc_id, text, find(text))
        if block.ids:
            yield block.rows(parts)

    # In one order, so that a task that is run again makes the same blocks even if its rows come by a shuffle.
    return docs.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(explode, _SENT)


def _encoded(sent: DataFrame, ranks_path: str) -> DataFrame:
    """(key, part, body): for each block and part the ids of its words. Rows of a part come one after another, and each of its distinct words is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known, now = read_ranks(ranks_path), {}, None
        for batch in batches:
            out = []
            for part, block, lengths, body in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "parts", "body"))):
                if part < 0:
                    continue
                if part != now:
                    now, known = part, {}
                text, at, ids = zstandard.decompress(body), 0, []
                for n in unpacked(lengths).tolist():
                    word = text[at : at + n]
                    at += n
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode_word(word, ranks)
                    ids.append(got)
                flat = np.array([i for x in ids for i in x], np.uint32)
                out.append((block, part, packed(np.array([len(x) for x in ids])), packed(flat)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["key", "part", "counts", "ids"])

    return sent.sortWithinPartitions("part").mapInArrow(run, "key long, part int, counts binary, ids binary")


def _ragged(starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[start : start + count] of each, joined."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


def _assembled(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents as ids: the numbers of words in its sequences, replaced by the words' ids."""
    rows = left.to_pylist() if key[0].as_py() >= 0 else []  # a part's words met for their encoding only
    if not rows:
        return _ids_table([])
    replies = {r["part"]: r for r in right.to_pylist()}
    part = unpacked(rows[0]["parts"])
    order = np.argsort(part, kind="stable")
    ids = [replies[p] for p in np.unique(part).tolist()]  # a part without a reply ends the job rather than leaving words out
    sizes = np.concatenate([np.empty(0, np.int64), *(unpacked(r["counts"]) for r in ids)]).astype(np.int64)
    values = np.concatenate([np.empty(0, np.uint32), *(unpacked(r["ids"]) for r in ids)])
    counts, starts = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    counts[order], starts[order] = sizes, np.cumsum(sizes) - sizes
    out = []
    for r in rows:  # the same documents may have been read twice
        sequence, at = unpacked(r["body"]), 0
        for doc_id, n in zip(r["doc_ids"], r["lengths"]):
            words = sequence[at : at + n]
            at += n
            out.append((doc_id, _ragged(starts[words], counts[words], values).astype(np.int32)))
    return _ids_table(out)


def _ids_table(rows: list[tuple]) -> pa.Table:
    offsets = np.cumsum([0, *(len(x) for _, x in rows)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *(x for _, x in rows)])
    return pa.table([pa.array([i for i, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids array<int>), one row per input row: each match of pattern encoded by the ranks of a file, without special tokens.

    A null or empty text has no ids; characters that pattern doesn't match have none either. Repeated rows come as often
    as they are, a null id stays null, other columns are left out, and no rows give no rows. The rank file is read where words are encoded.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One shuffle serves both: blocks' sequences wait where their ids will come, and words meet by part.
    sent = blocks(whole_text(docs, id_col, text_col), pattern, PARTS * partitions, block_bytes).repartition(partitions, "key")
    return sent.groupBy("key").cogroup(_encoded(sent, ranks_path).groupBy("key")).applyInArrow(_assembled, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, bytes, sha256): the bytes of each row's ids, joined with the token-byte table.

    The table is bounded by the vocabulary, so every task has all of it, and as its ids are dense the join is by place. ids_sha256 is of the
    decimal ids with blanks between. No ids are no bytes, null ids too; an id that isn't in the table ends the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(read_ranks(ranks_path))
        names = [str(i).encode() for i in range(len(table))]
        for batch in batches:
            column, out = batch.column(1), []
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                ids = flat[a:b].tolist()
                if ids and min(ids) < 0:
                    raise ValueError(f"token {min(ids)} isn't in the table")
                raw = b"".join(map(table.__getitem__, ids))
                out.append((doc_id, len(ids), hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest(), raw, hashlib.sha256(raw).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()))], ["doc_id", "n_tokens", "ids_sha256", "bytes", "sha256"])

    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))
    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), ids.alias("ids")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, bytes binary, sha256 string")
