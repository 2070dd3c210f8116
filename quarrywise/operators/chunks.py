"""Sections and chunks of documents, in the row that holds the document: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import once, slug, squeezed, stripped, text

TARGET, OVERLAP = 3500, 500

#: Fixed: titles of chapters.
CHAPTER_TITLE = r"(?i)\A(chapter\s+\d+|chapter\s+[ivxlcdm]+|preface|introduction|prologue|epilogue|conclusion|afterword|appendix\b.*)\z"

#: Fixed: a whole line that is a heading, told within a text. What it parts are the texts of sections.
HEADING_LINE = r"(?dm)^#{1,6}[ \t\x0B\f\r]+[^\n\r\u0085\u2028\u2029]+?[ \t\x0B\f\r]*$"

_STACK = "array<struct<level:int,title:string>>"


def line_of(x: Column, offset: Column) -> Column:
    """The line, from 1, in which the character after so many stands."""
    before = F.substr(x, F.lit(1), offset.cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def clean_title(x: Column) -> Column:
    return F.btrim(squeezed(x), F.lit("# "))


def with_sections(df: DataFrame, body: str, out: str = "sections") -> DataFrame:
    """df with a column `out`: array<struct<heading_path, chapter_id, chapter_title, section_id, section_title, text, start_line, end_line>>.

    A section is a heading with the text up to the next; headings without text have none, and what
    stands before the first heading has none. A body without headings is one section. The path is the
    headings above, each of a lower level than the next; the chapter is the first of them that is titled
    like one, else the topmost. Lines and headings are columns of their own, so that they are found once.
    """
    form = r"\A(#{1,6})\s+(.+?)\s*\z"
    push = lambda stack, m: F.concat(F.filter(stack, lambda s: s["level"] < m["level"]), F.array(F.struct(m["level"].alias("level"), m["title"].alias("title"))))
    found = F.transform(
        F.filter(F.transform("__lines", lambda s, i: F.struct(s.alias("line"), i.alias("at"))), lambda m: m["line"].rlike(form)),
        lambda m: F.struct(F.length(F.regexp_extract(m["line"], form, 1)).alias("level"), clean_title(F.regexp_extract(m["line"], form, 2)).alias("title"), m["line"].alias("line"), m["at"].alias("at")),
    )
    marks, lines, raw = F.col("__marks"), F.col("__lines"), F.col("__raw")
    # One fold carries the stack and hands it on, so that no heading looks at all before it again.
    grown = lambda acc, m: F.transform(F.array(push(acc["stack"], m)), lambda s: F.struct(s.alias("stack"), F.concat(acc["all"], F.array(s)).alias("all")))[0]
    stacks = F.aggregate(marks, F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(f"array<{_STACK}>").alias("all")), grown)["all"]

    def section(m: Column, j: Column) -> Column:
        stack = F.col("__stacks")[j]
        end = F.coalesce(F.try_element_at(marks, j + 2)["at"], F.size(lines))
        path = F.array_join(F.transform(stack, lambda s: s["title"]), " > ")
        chapter = F.coalesce(F.try_element_at(F.filter(stack, lambda s: s["title"].rlike(CHAPTER_TITLE)), F.lit(1)), stack[0])["title"]
        return F.struct(
            path.alias("heading_path"), slug(chapter).alias("chapter_id"), chapter.alias("chapter_title"), slug(path).alias("section_id"), m["title"].alias("section_title"),
            F.rtrim(m["line"]).alias("line"), stripped(F.col("__bodies")[j + 1]).alias("inner"),
            (m["at"] + 1).cast("long").alias("start_line"), F.least(end + 1, F.size(lines)).cast("long").alias("end_line"),
        )

    start, bare = F.length(F.regexp_extract(raw, r"(?U)\A\s*", 0)), F.col("__bare")
    whole = F.struct(
        F.lit("").alias("heading_path"), F.lit("body").alias("chapter_id"), F.lit("Body").alias("chapter_title"), F.lit("body").alias("section_id"), F.lit("Body").alias("section_title"),
        F.lit("").alias("line"), bare.alias("inner"), line_of(raw, start).alias("start_line"), line_of(raw, start + F.length(bare)).alias("end_line"),
    )
    rows = df.withColumn("__raw", text(F.col(body))).withColumn("__bare", stripped(F.col("__raw"))).withColumn("__lines", F.split("__raw", "\n")).withColumn("__bodies", F.split("__raw", HEADING_LINE, -1)).withColumn("__marks", found).withColumn("__stacks", stacks)
    rows = rows.withColumn("__all", F.when(F.size(marks) > 0, F.transform(marks, section)).otherwise(F.array(whole)))
    named = lambda s: F.struct(
        *[s[c].alias(c) for c in ("heading_path", "chapter_id", "chapter_title", "section_id", "section_title")],
        F.when(s["line"] == "", s["inner"]).otherwise(F.concat(s["line"], F.lit("\n\n"), s["inner"])).alias("text"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"),
    )
    rows = rows.withColumn(out, F.transform(F.filter("__all", lambda s: s["inner"] != ""), named))
    return rows.drop("__raw", "__bare", "__lines", "__bodies", "__marks", "__stacks", "__all")


def unrolled(rows: DataFrame, keep: tuple[str, ...], array: str, place: str) -> DataFrame:
    """A row for each element of an array column, with its place. The outer form keeps Spark from testing the array's size first, a filter that it would push below the columns that the array is made of, making them again in it for each element."""
    return rows.select(*keep, F.posexplode_outer(array).alias(place, array)).where(F.col(place).isNotNull())


def pieces(section_text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """array<struct<text, start, end, start_line, end_line>>: windows of target characters that overlap, stripped; blank ones are left out.

    Lines are counted from 1 within the text. The line in which each window begins comes from one fold
    over the steps between windows, so that no window counts all lines before it again.
    """
    target = max(1, target)
    step = target - max(0, min(overlap, target - 1))
    # Inside a function over an array an expression is made again wherever it is named, so what is named twice is bound.
    ends = lambda x: once(x, lambda y: (F.length(y) - F.length(F.replace(y, F.lit("\n"), F.lit("")))).cast("long"))

    def piece(raw: Column, start: Column, line: Column, whole: Column) -> Column:
        def said(bare: Column) -> Column:
            lead = F.when(whole, F.lit(0)).otherwise(F.length(F.regexp_extract(raw, r"(?U)\A\s*", 0)))
            placed = lambda p: F.struct(
                bare.alias("text"), (start + p["lead"]).alias("start"), (start + p["lead"] + p["n"]).alias("end"), p["line"].alias("start_line"), (p["line"] + p["ends"]).alias("end_line"),
            )
            return once(lead, lambda x: once(F.struct(x.alias("lead"), (line + ends(F.left(raw, x))).alias("line"), F.length(bare).alias("n"), ends(bare).alias("ends")), placed))

        return once(F.when(whole, raw).otherwise(stripped(raw)), said)

    def windows(t: Column, count: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(t, i * step + 1, F.lit(target)))

        def placed(raws: Column) -> Column:
            passed = lambda acc, raw: F.struct((acc["line"] + ends(F.left(raw, F.lit(step)))).alias("line"), F.concat(acc["all"], F.array(acc["line"])).alias("all"))
            lines = F.aggregate(raws, F.struct(F.lit(1).cast("long").alias("line"), F.array().cast("array<bigint>").alias("all")), passed)["all"]
            return once(lines, lambda at: F.transform(raws, lambda raw, i: piece(raw, i * step, at[i], count == 1)))

        return once(cut, placed)

    count = lambda t: F.greatest(F.lit(1), F.ceil((F.length(t) - (target - step)) / F.lit(step)).cast("int"))
    return F.filter(once(section_text, lambda t: once(count(t), lambda n: windows(t, n))), lambda p: p["text"] != "")


def chunk_documents(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """docs (book_id, title, author, source_path, text) as chunks, with links to the chunks before and after and a citation."""
    each = F.transform(F.col("s"), lambda s: F.transform(pieces(s["text"], target, overlap), lambda p: F.struct(s.alias("section"), p.alias("piece"))))
    rows = with_sections(docs, "text", "s").withColumn("c", F.flatten(each)).withColumn("n", F.size("c"))
    rows = unrolled(rows, ("book_id", "title", "author", "source_path", "n"), "c", "i")
    name = lambda i: F.concat(F.col("book_id").cast("string"), F.lit("_"), F.lpad(i.cast("string"), 6, "0"))
    s, p = F.col("c.section"), F.col("c.piece")
    first, last = s["start_line"] + p["start_line"] - 1, s["start_line"] + p["end_line"] - 1
    rows = rows.select(
        "book_id", "title", "author", "source_path", F.col("i").cast("long").alias("chunk_index"), name(F.col("i")).alias("chunk_id"),
        F.when(F.col("i") > 0, name(F.col("i") - 1)).alias("previous_chunk_id"), F.when(F.col("i") + 1 < F.col("n"), name(F.col("i") + 1)).alias("next_chunk_id"),
        s["heading_path"].alias("heading_path"), s["chapter_id"].alias("chapter_id"), s["chapter_title"].alias("chapter_title"), s["section_id"].alias("section_id"), s["section_title"].alias("section_title"),
        first.alias("start_line"), last.alias("end_line"), p["text"].alias("text"), F.sha2(p["text"], 256).alias("content_hash"),
    )
    return rows.withColumn("citation", chunk_citation())


def chunk_citation() -> Column:
    """title — author — headings — lines a-b — path; what is empty is left out."""
    some = lambda c: F.nullif(text(F.col(c)), F.lit(""))
    lines = F.concat(F.lit("lines "), F.col("start_line"), F.lit("-"), F.col("end_line"))
    return F.concat_ws(" — ", "title", some("author"), some("heading_path"), lines, "source_path")


def markdown_citation() -> Column:
    some = lambda c: F.nullif(text(F.col(c)), F.lit(""))
    lines = F.concat(F.lit("lines "), F.col("start_line"), F.lit("-"), F.col("end_line"))
    return F.concat_ws(
        "; ", F.concat(F.lit("*"), F.coalesce(some("title"), F.lit("Untitled")), F.lit("*")), F.coalesce(some("author"), F.lit("Unknown author")), F.coalesce(some("heading_path"), some("chapter_title")),
        lines, F.concat(F.lit("chunk `"), "chunk_id", F.lit("`")), some("source_path"),
    )


def source_location() -> Column:
    some = lambda c: F.nullif(text(F.col(c)), F.lit(""))
    place = F.nullif(F.concat_ws(" · ", some("chapter_title"), F.when(~some("section_title").eqNullSafe(some("chapter_title")), some("section_title")), F.concat(F.lit("lines "), F.col("start_line"), F.lit("-"), F.col("end_line"))), F.lit(""))
    return F.concat_ws(" — ", F.coalesce(some("title"), F.lit("Untitled")), F.coalesce(some("author"), F.lit("Unknown author")), place, "source_path")


def around(chunks: DataFrame, hits: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """The chunks of the same book within some places of each hit (book_id, chunk_index), by an equi-join on the places asked for."""
    wanted = hits.select("book_id", F.col("chunk_index").alias("hit_index"), F.explode(F.sequence(F.col("chunk_index") - before, F.col("chunk_index") + after)).alias("chunk_index"))
    return chunks.join(wanted, ["book_id", "chunk_index"])


def chapters(chunks: DataFrame) -> DataFrame:
    """The chapters of each book in order: their first chunk and how many they have."""
    return chunks.groupBy("book_id", "chapter_id").agg(F.min("chunk_index").alias("first_index"), F.min_by("chapter_title", "chunk_index").alias("chapter_title"), F.count("*").alias("n_chunks"))


def of_chapter(chunks: DataFrame, book: str, chapter: str) -> DataFrame:
    """Chunks of a book whose chapter is named by id, by title, or by a part of its title or headings."""
    low = F.lit(chapter.lower())
    fits = (F.col("chapter_id") == slug(F.lit(chapter))) | (F.lower("chapter_title") == low) | F.contains(F.lower("chapter_title"), low) | F.contains(F.lower("heading_path"), low)
    return chunks.where(((F.col("title") == book) | (F.col("book_id").cast("string") == book)) & fits).orderBy("chunk_index")
