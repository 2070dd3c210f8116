"""What several operators need: whole texts, rows kept apart from columns, and word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, spread

__all__ = ["LOWER", "WordHashes", "WordPairs", "as_bytes", "materialize", "packed", "spread", "unpacked", "whole_text", "with_row"]

#: Lower-cases A-Z in UTF-8 bytes and leaves all other bytes alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def whole_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; every other column is left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_row(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs with all of its columns inside one named `row`, so that no name of theirs clashes with those of columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32 as compressed planes of their bytes, as many as the largest needs."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width]
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpacked(said: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(said[1:]), np.uint8).reshape(said[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : said[0]] = planes.T
    return out.view("<u4").ravel()


class WordPairs(dict):
    """Word -> its place in two arrays of 64-bit hashes with seeds of their own, remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most, self.hashes = most, np.empty((2, 1024), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at >= self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)], axis=1)
        self.hashes[0, at], self.hashes[1, at] = xxhash.xxh64_intdigest(word, 0), xxhash.xxh64_intdigest(word, 1)
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two rows of hashes. What is remembered is dropped between texts only, so that places stay true within one."""
        if len(self) >= self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[:, at]


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound so that memory does not follow the vocabulary."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
