"""Records in formats that a table of fields describes: text, JSON and XML engines, YAML, notes and drawings. A record is a string column; Spark's own writers make the files."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.strings import author_parts, text, year
from ..sources.tables import materialize
from .exports import bibtex_key

_TEX = ("title", "author", "publisher", "place", "edition", "isbn", "book_id")


def _some(c: Column | str) -> Column:
    return F.nullif(text(F.col(c) if isinstance(c, str) else c), F.lit(""))


def reference_context(books: DataFrame) -> DataFrame:
    """books (book_id, title, author, year, publisher, place, edition, isbn, primary_class) with what format fields name: raw, display, BibTeX and CSL forms."""
    family, given = author_parts(F.col("author"))
    tex = lambda c: F.replace(F.replace(F.replace(text(F.col(c)), F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    named = {
        "author_raw": text(F.col("author")), "year_raw": F.coalesce(year(text(F.col("year"))), F.lit("")), "bibtex_key": bibtex_key(), **{f"{c}_bibtex": tex(c) for c in _TEX},
        "author_csl": F.when(_some("author").isNotNull(), F.to_json(F.array(F.struct(family.alias("family"), F.nullif(given, F.lit("")).alias("given"))))),
        "issued_csl": F.when(year(text(F.col("year"))).isNotNull(), F.to_json(F.struct(F.array(F.array(year(text(F.col("year"))).cast("int"))).alias("date-parts")))),
        "categories_csl": F.when(_some("primary_class").isNotNull(), F.to_json(F.array(F.concat(F.lit("BMDC "), "primary_class")))),
    }
    return books.withColumns(named)


def enabled(field: dict) -> Column:
    """Whether a field takes part: `when` and all of `all_when` are there, some of `any_when`, none of `none_when`."""
    there = lambda name: _some(name).isNotNull()
    out = F.lit(True)
    for name in [*filter(None, [field.get("when")]), *field.get("all_when", [])]:
        out = out & there(name)
    if field.get("any_when"):
        out = out & F.greatest(*[there(n) for n in field["any_when"]], F.lit(False))
    for name in field.get("none_when", []):
        out = out & ~there(name)
    return out


def rendered(template: str) -> Column:
    """A template with {name} for columns, and {{ and }} for braces."""
    parts = []
    for piece in re.findall(r"\{\{|\}\}|\{[^{}]*\}|[^{}]+", template):
        parts.append(F.lit(piece[0]) if piece in ("{{", "}}") else text(F.col(piece[1:-1])) if piece.startswith("{") else F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def text_record(form: dict) -> Column:
    """A header, the fields that take part and say something, and a footer, a line each."""
    record = form.get("record", {})
    ends = lambda k: [rendered(record[k].strip())] if record.get(k, "").strip() else []
    lines = [F.when(enabled(f), F.nullif(rendered(str(f.get("template", "")).rstrip()), F.lit(""))) for f in record.get("fields", [])]
    return F.concat_ws("\n", *ends("header"), *lines, *ends("footer"))


def _value(field: dict) -> Column:
    return F.lit(str(field["literal"])) if "literal" in field else rendered(field["template"]) if "template" in field else text(F.col(field["source"]))


def json_record(form: dict) -> Column:
    """An object of the fields that take part; what is empty is left out. Sources whose names end in _csl are JSON already."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)
    items = []
    for f in form.get("fields", []):
        value = F.nullif(_value(f), F.lit(""))
        said = value if str(f.get("source", "")).endswith("_csl") else quoted(value)
        items.append(F.when(enabled(f) & value.isNotNull() & ~value.isin("[]", "{}"), F.concat(F.lit(json.dumps(str(f["key"])) + ": "), said)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}"))


def escaped_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_record(form: dict) -> Column:
    """An element of the fields that take part; those whose paths begin alike share their elements, in the order in which they first come."""
    name = form.get("record_element", "record")

    def inside(fields: list[tuple[list[str], dict]]) -> list[Column]:
        out, done = [], set()
        for path, _ in fields:
            if path[0] in done:
                continue
            done.add(path[0])
            mine = [(p[1:], f) for p, f in fields if p[0] == path[0]]
            leaf = next((f for p, f in mine if not p), None)
            deeper = [(p, f) for p, f in mine if p]
            attributes = "".join(f' {k}="{v}"' for k, v in (leaf or {}).get("attributes", {}).items())
            value = F.when(enabled(leaf), F.nullif(_value(leaf), F.lit(""))) if leaf else F.lit(None).cast("string")
            body = F.nullif(F.concat_ws("", escaped_xml(value), *inside(deeper)), F.lit(""))
            out.append(F.when(body.isNotNull(), F.concat(F.lit(f"<{path[0]}{attributes}>"), body, F.lit(f"</{path[0]}>"))))
        return out

    return F.concat(F.lit(f"<{name}>"), F.concat_ws("", *inside([(f["path"].split("/"), f) for f in form.get("fields", [])])), F.lit(f"</{name}>"))


ENGINES = {"text_records": text_record, "json_records": json_record, "xml_records": xml_record}


def records(books: DataFrame, form: dict) -> DataFrame:
    """(book_id, record) of books in a format."""
    return reference_context(books).select("book_id", ENGINES[form["engine"]](form).alias("record"))


@F.pandas_udf(StringType())
def yaml_text(x: pd.Series) -> pd.Series:
    """JSON as YAML, keys in their order."""
    return x.map(lambda raw: yaml.safe_dump(json.loads(raw or "{}"), sort_keys=False, allow_unicode=True))


def yaml_record(*columns: str) -> Column:
    """Columns as a YAML mapping, in their order: an entry of a review queue, a group of duplicates, a saved query."""
    return yaml_text(F.to_json(F.struct(*columns)))


def brief() -> Column:
    """A brief of an answer pack (text, aliases, passages, themes, citations) in Markdown."""
    none = F.array().cast("array<string>")
    bullets = lambda c: F.coalesce(F.nullif(F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")), F.lit("- None."))
    quotes = F.coalesce(F.nullif(F.array_join(F.transform("passages", lambda p: F.concat(F.lit("> "), F.replace(p["excerpt"], F.lit("\n"), F.lit("\n> ")), F.lit("\n> — "), p["citation"])), "\n\n"), F.lit("")), F.lit("No passages."))
    return F.concat(F.lit("# "), text(F.col("text")), F.lit("\n\n## Route\n\n"), bullets("aliases"), F.lit("\n\n## Passages\n\n"), quotes, F.lit("\n\n## Themes\n\n"), bullets(F.coalesce("themes", none)), F.lit("\n\n## Citations\n\n"), bullets(F.coalesce("citations", none)), F.lit("\n"))


def format_problems(form: dict) -> list[str]:
    """What is wrong with a format's table of fields."""
    engine = form.get("engine")
    if engine not in ENGINES:
        return [f"unknown engine: {engine}"]
    fields = form.get("record", {}).get("fields", []) if engine == "text_records" else form.get("fields", [])
    needs = {"text_records": ("template",), "json_records": ("key",), "xml_records": ("path",)}[engine]
    out = [f"field {i} has no {n}" for i, f in enumerate(fields) for n in needs if not f.get(n)]
    return out + [f"field {i} says nothing" for i, f in enumerate(fields) if not {"template", "literal", "source"} & set(f)] + (["no fields"] if not fields else [])


def with_front_matter(block_json: Column, body: Column) -> Column:
    """A Markdown file: the front matter as YAML between lines of dashes, and the body."""
    return F.concat(F.lit("---\n"), yaml_text(block_json), F.lit("---\n\n"), F.regexp_replace(text(body), r"\A\s+", ""))


def chunk_json() -> Column:
    """A chunk as a line of JSON: everything but its vector."""
    keys = ("chunk_id", "book_id", "title", "author", "source_path", "chunk_index", "heading_path", "chapter_title", "section_title", "start_line", "end_line", "text", "citation")
    return F.to_json(F.struct(*keys))


def passage_record(kind: str) -> Column:
    """A passage (passage_id, book_id, title, author, quote, citation, tags) as jsonl, yaml or a Markdown note."""
    whole = F.to_json(F.struct("passage_id", "book_id", "title", "author", "quote", "citation", "tags"))
    if kind == "jsonl":
        return whole
    if kind == "yaml":
        return yaml_text(whole)
    tagged = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), F.translate(t, " ", "-"))), " ")
    lines = [F.concat(F.lit("# "), F.coalesce(_some("title"), F.lit("Untitled"))), F.lit(""), F.concat(F.lit("> "), F.replace(text(F.col("quote")), F.lit("\n"), F.lit("\n> "))), F.lit(""), F.concat(F.lit("Source: "), text(F.col("citation"))), F.nullif(tagged, F.lit(""))]
    return F.concat_ws("\n", *lines)


def book_note() -> Column:
    """A note of a book (book_id, title, author, primary_class, thesis, ideas, best_for): front matter, thesis, ideas as a list and links."""
    block = yaml_text(F.to_json(F.struct("book_id", "title", "author", "primary_class", F.lit("book-note").alias("type"))))
    bullets = lambda c: F.coalesce(F.nullif(F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")), F.lit("- None recorded."))
    return F.concat(
        F.lit("---\n"), block, F.lit("---\n\n# "), F.coalesce(_some("title"), F.lit("Untitled")), F.lit("\n\n## Core thesis\n\n"), F.coalesce(_some("thesis"), F.lit("No summary yet.")),
        F.lit("\n\n## Major ideas\n\n"), bullets("ideas"), F.lit("\n\n## Best for\n\n"), bullets("best_for"), F.lit("\n"),
    )


def index_lines(books: DataFrame) -> DataFrame:
    """(place, line) of a Markdown index of books: the number of books of each class, then the books by class and title. Sections are told by place; no group is gathered."""
    per = books.groupBy("primary_class").agg(F.count("*").alias("n"))
    heads = per.select(F.struct(F.lit(0).alias("part"), text(F.col("primary_class")).alias("code"), F.lit("").alias("name")).alias("place"), F.concat(F.lit("- "), text(F.col("primary_class")), F.lit(": "), F.col("n").cast("string")).alias("line"))
    rows = books.select(
        F.struct(F.lit(1).alias("part"), text(F.col("primary_class")).alias("code"), text(F.col("title")).alias("name")).alias("place"),
        F.concat(F.lit("- "), F.coalesce(_some("title"), F.lit("Untitled")), F.coalesce(F.concat(F.lit(" — "), _some("author")), F.lit("")), F.lit(" ("), text(F.col("primary_class")), F.lit(")")).alias("line"),
    )
    return heads.unionByName(rows).orderBy("place", "line")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their number `nth`, from 0, in an order: sorted ranges are counted, and each range's numbers begin after those before it."""
    ranged = materialize(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    # A range is told by its part; the driver sees one count for each.
    counts = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect())
    first, total = {}, 0
    for part, n in counts:
        first[part] = total
        total += n
    if not counts:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    starts = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("nth", (F.element_at(starts, F.col("__part")) + inner).cast("long")).drop("__part")


def canvas_nodes(books: DataFrame) -> DataFrame:
    """(book_id, node) of books (book_id, title, author, primary_class, topics, path) on a circle in order of id, as canvas JSON."""
    n = books.count()
    radius, at = max(600, n * 35), 2 * math.pi * F.col("nth") / max(n, 1)
    place = lambda f: (f(at) * radius).cast("int")
    said = F.concat_ws(
        "\n", F.concat(F.lit("# "), F.coalesce(_some("title"), F.lit("Untitled"))), F.lit(""), F.concat(F.lit("Author: "), F.coalesce(_some("author"), F.lit("Unknown"))), F.rtrim(F.concat(F.lit("Class: "), text(F.col("primary_class")))),
        F.when(F.size("topics") > 0, F.concat(F.lit("Topics: "), F.array_join(F.slice("topics", 1, 8), ", "))),
    )
    node = F.to_json(
        F.struct(
            F.col("book_id").cast("string").alias("id"), F.when(_some("path").isNotNull(), "file").otherwise("text").alias("type"), place(F.cos).alias("x"), place(F.sin).alias("y"), F.lit(420).alias("width"), F.lit(220).alias("height"),
            _some("path").alias("file"), F.when(_some("path").isNull(), said).alias("text"),
        )
    )
    return numbered(books, "book_id").select("book_id", node.alias("node"))


def canvas_edges(edges: DataFrame) -> DataFrame:
    """(book_id, other_id, edge) of edges (book_id, other_id, score), numbered from 1, as canvas JSON."""
    edge = F.to_json(F.struct(F.concat(F.lit("edge-"), (F.col("nth") + 1).cast("string")).alias("id"), F.col("book_id").cast("string").alias("fromNode"), F.col("other_id").cast("string").alias("toNode"), F.col("score").cast("string").alias("label")))
    return numbered(edges, "book_id", "other_id").select("book_id", "other_id", edge.alias("edge"))


def sidecar() -> Column:
    """A library sidecar of a book (title, author, isbn, primary_class, topics, description) as JSON."""
    authors = F.filter(F.transform(F.split(text(F.col("author")), r"\s*(?:;|\band\b|&)\s*"), F.trim), lambda a: a != "")
    return F.to_json(F.struct(F.struct("title", authors.alias("authors"), _some("isbn").alias("isbn"), F.col("topics").alias("categories"), _some("description").alias("description")).alias("metadata")))
