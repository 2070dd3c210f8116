"""Words counted in the row that holds their text: nothing is shuffled, and what is handed to Python is taken a few megabytes at a time."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of a batch that are Python objects at one time, about.
PIECE = 1 << 22


def small(batches: Iterable[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about so many bytes, at least a row each, so that not all of a large one is Python objects at once."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_said(df: DataFrame, columns: list[str], say: Callable, out: str, kind: str) -> DataFrame:
    """df without columns and with a column `out` of type kind: what say makes of them, row by row."""
    kept = [c for c in df.columns if c not in columns]
    schema = StructType([*(df.schema[c] for c in kept), StructField(out, DataType.fromDDL(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(schema[out].dataType)
        for batch in small(batches):
            said = [say(*x) for x in zip(*(batch.column(c).to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(said, arrow)], [*kept, out])

    return df.select(*kept, *columns).mapInArrow(run, schema)


def stands_alone(ids: DataFrame) -> bool:
    """Whether no id of one column is null or there twice, so that a row's counts are its id's. Only ids are read and shuffled."""
    (name,) = ids.columns
    return ids.groupBy(name).count().where(F.col(name).isNull() | (F.col("count") > 1)).isEmpty()


def top_words(low: str, stop: frozenset[str], limit: int) -> list[dict]:
    """The most frequent words of four letters or more of a text in lower case, without stop words; ties by letter."""
    counts = Counter(w.strip("-' ") for w in re.findall(r"[a-z][a-z\-']{3,}", low))
    found = sorted((-n, w) for w, n in counts.items() if len(w) >= 4 and w not in stop)
    return [{"word": w, "n": -n} for n, w in found[:limit]]
