"""Lookups by runs and first words against holding each against each."""

import random

from pyspark.sql import functions as F

from quarrywise import catalog
from quarrywise.operators import contained, knowledge, library, taxonomy

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_containing_is_containing(spark):
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcé 漢-.") for _ in range(rng.randint(0, n)))
    texts = [say(40) for _ in range(60)] + [None, "", "aaa", "x" * 5000]
    needles = [say(6) for _ in range(60)] + [None, "", "aa", "xx", "xxxx", "zz", "abc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, low string")
    got = {(r.id, r.needle) for r in contained.containing(rows, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) if t is not None for n in needles if n is not None and n in t}
    none = contained.containing(rows, spark.createDataFrame([], "needle string"))
    assert none.columns == ["id", "needle"] and none.count() == 0


def test_phrases_are_found_by_their_first_word(spark):
    queries = spark.createDataFrame([(1, "the red ring of steel"), (2, "red"), (3, ""), (4, "ring red ring")], "query_id int, q string")
    phrases = spark.createDataFrame([("red ring",), ("ring",), ("steel ring",), ("",), ("red",)], "phrase string")
    got = {(r.query_id, r.phrase) for r in contained.said_phrases(queries, phrases).collect()}
    assert got == {(1, "red ring"), (1, "ring"), (1, "red"), (2, "red"), (4, "red ring"), (4, "ring"), (4, "red")}


def test_names_and_words_are_looked_up(spark):
    """No plan holds all queries against all names, concepts, classes or words."""
    queries = spark.createDataFrame([(i, f"goals and money {i}") for i in range(20)], "query_id int, text string")
    concepts = spark.createDataFrame([(f"c{i}", f"n{i}", f"money said {i}", "1") for i in range(20)], "concept_id string, name string, said string, primary_class string")
    rows = spark.createDataFrame([(i, f"money {i} goal") for i in range(20)], "id int, text string")
    names = spark.createDataFrame([(f"goals_{i}", "goals money") for i in range(20)], "alias string, label string")
    for df in (knowledge.concept_search(concepts, queries), knowledge.term_hits(rows, queries), library.route(queries, names), catalog.QUERIES["query_intents"](spark, SMALL), catalog.QUERIES["query_routes"](spark, SMALL)):
        said = plan(df)
        assert "NestedLoop" not in said and "CartesianProduct" not in said


def concept_brute(concepts, queries, limit):
    norm = lambda x: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (x or "").lower()).split())
    out = []
    for q, t in queries:
        a, hits = norm(t), []
        for c, name, said in concepts:
            low = norm(said)
            s = round(min(1.0, 0.7 * (a in low) + min(0.5, 0.1 * len(set(a.split()) & set(low.split())))), 3) if a else 0
            if s:
                hits.append((-s, name, c))
        out += [(q, c, -s, k + 1) for k, (s, name, c) in enumerate(sorted(hits)[:limit])]
    return sorted(out)


def test_concepts_are_found_by_words_and_runs(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(("habit", "habits", "money", "a", "deep", "work", "workshop")) for _ in range(rng.randint(0, n)))
    concepts = [(f"c{i}", f"n{i % 7}", say(8)) for i in range(40)]
    queries = [(i, say(3)) for i in range(30)] + [(30, None), (31, "abit"), (32, "o"), (33, "!!")]
    df = spark.createDataFrame([(*c, "1") for c in concepts], "concept_id string, name string, said string, primary_class string")
    got = knowledge.concept_search(df, spark.createDataFrame(queries, "query_id int, text string"), 5).collect()
    assert sorted((r.query_id, r.concept_id, r.score, r["rank"]) for r in got) == concept_brute(concepts, queries, 5)


def test_filters_of_every_kind(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(("A", "B", None, "3")), rng.choice(("332", "158", None)), rng.choice(("158|658", "65", "", None))) for i in range(30)]
    filters = [(k, rng.choice((None, "A", "3", "7")), rng.choice((None, [], ["158"], ["65", "332"], ["658", "658"]))) for k in range(40)]
    got = taxonomy.allowed(spark.createDataFrame(rows, "book_id int, title string, primary_class string, secondary_class_text string"), spark.createDataFrame(filters, "query_id int, book string, codes array<string>"))
    want = [(k, r[0]) for k, book, codes in filters for r in rows if (book is None or r[1] == book or str(r[0]) == book) and (not codes or r[2] in codes or any(c in (r[3] or "") for c in codes))]
    assert sorted((r.query_id, r.book_id) for r in got.collect()) == sorted(want)
    assert got.columns == ["query_id", "book_id", "title", "primary_class", "secondary_class_text"] and got.where(F.col("query_id") < 0).count() == 0
