import random
import re

from quarrywise.operators import chunks, library, search


def stack_sections(text):
    """Sections by a stack of headings."""
    lines, stack, out, at = text.split("\n"), [], [], None
    for i, line in enumerate([*lines, None]):
        m = re.fullmatch(r"(#{1,6})\s+(.+?)\s*", line) if line is not None else None
        if m or line is None:
            if at is not None:
                body = "\n".join(lines[at + 1 : i]).strip()
                if body:
                    out.append((" > ".join(t for _, t in stack), body))
            if m:
                while stack and stack[-1][0] >= len(m[1]):
                    stack.pop()
                stack.append((len(m[1]), m[2].strip("# ")))
                at = i
    return out


def test_sections_follow_the_stack(spark):
    rng = random.Random(3)
    texts = ["\n".join(f"{'#' * rng.randint(1, 4)} H{j}" if rng.random() < 0.4 else rng.choice(["words here", "", "more"]) for j in range(40)) for _ in range(20)]
    texts += ["", "plain\ntext"]
    rows = chunks.with_sections(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", "s").collect()
    for r in rows:
        want = stack_sections(texts[r.id]) if "#" in texts[r.id] else [("", texts[r.id])] if texts[r.id] else []
        assert [(s.heading_path, s.text.split("\n\n", 1)[-1] if s.heading_path else s.text) for s in r.s] == want


def test_windows_advance(spark):
    text = " ".join(f"word{i}" for i in range(500))
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(chunks.pieces(df.t, 100, 30).alias("p")).first().p
    want, start = [], 0
    while start < len(text):
        end = min(start + 100, len(text))
        want.append(text[start:end].strip())
        if end == len(text):
            break
        start = end - 30
    assert [p.text for p in got] == want and all(text[p.start : p.end] == p.text for p in got)


def test_duplicates_and_merges(spark):
    books = spark.createDataFrame([(1, "The Book", "A", ["9"], "x  y"), (2, "book", "a", ["9"], "x y"), (3, "Other", None, [], "z")], "book_id int, title string, author string, isbns array<string>, text string")
    assert {(r.reason, r.n_books) for r in library.duplicate_groups(books).collect()} == {("isbn", 2), ("content", 2), ("title_author", 2)}
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, h string, v int"), spark.createDataFrame([(2, "c", None), (3, "d", 4)], "k int, h string, v int")
    assert sorted(library.upserted(old, new, "k").collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 4)]
    assert {r.k for r in library.appended(old, new, "k").collect()} == {1, 2, 3}
    assert dict(library.index_status(old, new, "k", ("h",)).collect()) == {1: "gone", 2: "changed", 3: "new"}


def test_search_ties_and_nan(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 0.0]), (4, None)], "id int, v array<double>")
    got = search.vector_search(rows, rows.where("id = 1").selectExpr("id AS query_id", "v AS vec"), "id", "v", 3).collect()
    assert sorted((r["rank"], r.id, r.score) for r in got) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]
