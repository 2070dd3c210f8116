"""The cleaner and the HTML reader over DataFrames. Each step that later ones use more than once is a column of its own, so that it is computed once."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import markdown as md
from ..functions.strings import stripped
from .counted import small


def clean_markdown(df: DataFrame, raw: str, out: str, profile: md.Profile = md.EPUB) -> DataFrame:
    """df with a column `out`: the Markdown in `raw`, cleaned; its front matter is set aside and put back."""
    p = profile
    yaml, body = md.front_matter(F.col(raw))
    rows = df.withColumn("__yaml", yaml).withColumn("__body", body).withColumn("__body", md.without_noise(F.col("__body"), p))
    if p.inline:
        rows = rows.withColumn("__body", md.without_escapes(F.col("__body")))
    if p.pre_content:
        rows = rows.withColumn("__lines", F.split("__body", r"\r\n|\r|\n")).withColumn("__bare", F.transform("__lines", stripped))
        rows = rows.withColumn("__starts", md.content_starts(F.col("__bare"))).withColumn("__at", F.array_position("__starts", F.lit(True)).cast("int"))
        rows = rows.withColumn("__body", F.when(F.col("__at") > 0, F.array_join(F.slice("__lines", F.greatest("__at", F.lit(1)), F.size("__lines")), "\n")).otherwise(F.col("__body")))
    if p.join_lines:
        rows = rows.withColumn("__body", md.joined_lines(F.col("__body"), p))
    if p.headings:
        rows = rows.withColumn("__lines", F.transform(F.split("__body", "\n"), stripped)).withColumn("__takes", md.title_takers(F.col("__lines"), p))
        rows = rows.withColumn("__body", md.marked_headings(F.col("__lines"), F.col("__takes")))
    rows = rows.withColumn("__body", md.tidy(F.col("__body")))
    done = F.when(F.col("__yaml") != "", F.concat(F.lit("---\n"), "__yaml", F.lit("\n---\n\n"), "__body")).otherwise(F.col("__body"))
    return rows.withColumn(out, done).drop("__yaml", "__body", "__lines", "__bare", "__starts", "__at", "__takes")


def html_to_markdown(df: DataFrame, raw: str, out: str) -> DataFrame:
    """df with a column `out`: the HTML in `raw` as simple Markdown; entities, which SQL doesn't know by name, are read in Arrow batches."""
    rows = df.withColumn(out, md.bare_html(F.col(raw)))
    at = rows.columns.index(out)

    def tidy(x: str) -> str:
        x = re.sub(r"[ \t]+", " ", html.unescape(x).replace("\u00a0", " "))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+", "\n", x)).strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.set_column(at, out, pa.array([tidy(x or "") for x in b.column(at).to_pylist()], pa.string()))

    return rows.mapInArrow(run, StructType([*(f for f in rows.schema if f.name != out), StructField(out, StringType())]) if at == len(rows.columns) - 1 else rows.schema)
