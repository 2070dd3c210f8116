import pytest
from pyspark.sql import functions as F

from quarrywise.functions import isbn, strings
from quarrywise.operators import cleaning, extract


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "f, x, want",
    [
        (strings.slug, "  A Tale: of Two--Cities ", "a_tale_of_two_cities"), (strings.slug, "???", "untitled"), (strings.slug_without_the, "The  Hobbit", "hobbit"),
        (strings.normal_author, "Tolkien, J. R. R.", "j r r tolkien"), (strings.normal_title, "The Art & Science, Third Edition", "art and science"),
        (strings.canonical_title, "Refactoring: Second Edition", "Refactoring"), (strings.edition_number, "Deep Work (3rd edition)", 3), (strings.edition_label, "X, second edition", "Second Edition"),
        (strings.author_apa, "Jane Mary Example", "Example, J. M."), (strings.author_apa, None, "Unknown author"), (strings.year, "published 1984, again 2001", "1984"),
        (strings.class_number, "about 658.4/02", "658.4"), (isbn.normal_isbn, "ISBN 978-0-306-40615-7", "9780306406157"), (isbn.normal_isbn, "0306406152", "0306406152"), (isbn.normal_isbn, "9780306406158", None),
        (isbn.isbns, "no 0306406152 here ............................ ISBN: 978-0-306-40615-7", ["9780306406157"]), (isbn.isbns, "the ISBN is 0306406152", ["0306406152"]),
        (extract.stance, "It is useful", "supports"), (extract.stance, "It never works", "challenges"), (extract.stance, "It never works but may help", "qualifies"), (extract.stance, "Go", "neutral"),
    ],
)
def test_strings(spark, f, x, want):
    assert value(spark, f(F.lit(x))) == want


def test_permission_order(spark):
    p = lambda a: value(spark, strings.permission(F.lit(a), ("delete*",), ("write?x",), ("*",)))
    assert [p("delete all"), p("write.x"), p("write.xx")] == ["deny", "confirm", "allow"]


MESSY = """---
title: X
---
![](cover.jpg){width="1200"}

::: {#cover}
<svg><image href="cover.jpg"/></svg>
:::

[]{#_id1}
Copyright page

Preface

A [messy [nested]{.b}]{.a} book.
It has hard-wrapped
prose and a [link](http://x).

- item

Chapter 1
Systems

Text&nbsp;two.
"""


def test_cleaner(spark):
    got = cleaning.clean_markdown(spark.createDataFrame([(MESSY,)], "raw string"), "raw", "out").first().out
    assert got == (
        "---\ntitle: X\n---\n\n# Preface\n\nA messy nested book. It has hard-wrapped prose and a link.\n\n- item\n\n## Chapter 1\n\nSystems\n\nText&nbsp;two.\n"
    )


def test_html(spark):
    page = "<html><style>p{}</style><h2 class=a>T &amp; U</h2><p>one<br>two&nbsp;&eacute;</p></html>"
    assert cleaning.html_to_markdown(spark.createDataFrame([(page,), (None,)], "h string"), "h", "m").select("m").collect() == [("## T & U\n\none\n\ntwo é",), ("",)]
