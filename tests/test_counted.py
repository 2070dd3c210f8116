"""Words are counted in the row that holds their text; rows of one id still count together."""

import pytest
from pyspark.sql import functions as F

from quarrywise.operators import extract, summaries
from quarrywise.operators.counted import small

TEXT = "# One\nHabits and money. Habits and money again, slow habits.\n# Two\nGreen parks and habits of mind versus slow trains.\n"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def keyed(spark, ids):
    return spark.createDataFrame([(i, TEXT) for i in ids], "id long, text string")


def test_themes_shuffle_nothing(spark):
    rows = keyed(spark, (1, 2)).withColumn("query", F.lit("habits"))
    found = summaries.themes(rows)
    assert exchanges(found) == 0
    (a, b) = found.orderBy("id").collect()
    assert a.themes == b.themes and "habits and money" in a.themes[:3], a.themes


def test_themes_of_one_id_are_put_together(spark):
    rows = keyed(spark, (1, 1, 2, None)).withColumn("query", F.lit("habits"))
    got = sorted(((r.id, r.themes) for r in summaries.themes(rows).collect()), key=str)
    assert [i for i, _ in got] == [1, 1, 2, None] and got[0][1] == got[1][1] and got[0][1][:2] == got[2][1][:2] and got[3][1] == []


def test_chapters_shuffle_no_words(spark):
    books = keyed(spark, (1, 2)).withColumnRenamed("id", "book_id")
    found = summaries.chapter_summaries(books)
    assert exchanges(found) == 1
    assert [(r.title, r.keywords) for r in found.where("book_id = 2").orderBy("place").collect()] == [("One", ["habits", "money", "again", "slow"]), ("Two", ["green", "habits", "mind", "parks", "slow", "trains", "versus"])]


def test_keywords_are_those_of_a_shuffle(spark):
    docs = keyed(spark, (1, 2)).withColumnRenamed("id", "book_id")
    found = extract.keywords(docs, 4)
    assert exchanges(found) == 0
    assert sorted(found.collect()) == sorted(extract.merged_keywords(docs, 4).collect())
    twice = keyed(spark, (1, 1, None)).withColumnRenamed("id", "book_id")
    assert {(r.word, r.n) for r in extract.keywords(twice, 2).where("book_id = 1").collect()} == {("habits", 8), ("money", 4)}


def test_batches_are_taken_in_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": ["a" * 1000] * 100})
    pieces = list(small([batch], 10_000))
    assert len(pieces) > 9 and pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))


def test_sets_that_are_alike_meet_in_any_order():
    """Whatever shingles a sample calls common, two sets of which four fifths are shared have one of their first in common."""
    import numpy as np

    from quarrywise.operators.near import rarest

    rng = np.random.default_rng(3)
    for _ in range(200):
        shared, n = rng.integers(-(1 << 40), 1 << 40, rng.integers(1, 60)), rng.integers(0, 15)
        a, b = np.r_[shared, rng.integers(-(1 << 40), 1 << 40, n)], np.r_[shared, rng.integers(-(1 << 40), 1 << 40, n // 3)]
        common = np.unique(rng.choice(np.r_[a, b], rng.integers(0, 40)))
        hot = (common, rng.permutation(len(common)))
        alike = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        first_a, first_b = rarest(a.tolist(), hot, 0.8), rarest(b.tolist(), hot, 0.8)
        assert len(first_a) <= len(a) // 5 + 1 and (not alike or len(np.intersect1d(first_a, first_b)))


def test_terms_of_chunks_are_not_shuffled_by_chunk(spark):
    import re

    from quarrywise.operators import notes

    books = spark.createDataFrame([(1, "Habits", ["money"]), (2, "Parks", ["green", "walks"])], "book_id long, title string, topics array<string>")
    chunks = spark.createDataFrame([(1, "1_0", "", "", "money habits money"), (1, "1_1", "", "", "green parks"), (2, "2_0", "", "", "green money walks"), (2, "2_1", "", "", None)], "book_id long, chunk_id string, citation string, heading_path string, text string")
    found = notes.useful_passages(books, chunks)
    assert [(r.book_id, r["rank"], r.chunk_id) for r in found.orderBy("book_id", "rank").collect()] == [(1, 1, "1_0"), (2, 1, "2_0")]
    assert not re.search(r"Exchange hashpartitioning\(id#\d+, dl#\d+, term#\d+", found._jdf.queryExecution().executedPlan().toString())


def test_keyword_search_shuffles_no_terms(spark):
    """Terms are counted where their row is; rows of one id and length still count together, as a search of everything by SQL has it."""
    import re

    from quarrywise.operators import search

    queries = spark.createDataFrame([(1, "green parks"), (2, "absent"), (3, None)], "query_id int, text string")
    alone = spark.createDataFrame([(1, "green Green parks"), (2, "habits"), (3, None), (4, "parks")], "id long, text string")
    found = search.keyword_search(alone, queries, "id", "text")
    assert [(r.query_id, r.id) for r in found.orderBy("rank").collect()] == [(1, 1), (1, 4)]
    assert not re.search(r"Exchange hashpartitioning\(id#\d+, dl#\d+, term#\d+|Exchange hashpartitioning\(term#\d+, \d+\).*\n.*(Filter|Project).*id#", found._jdf.queryExecution().executedPlan().toString())
    twice = alone.unionByName(spark.createDataFrame([(1, "green x parks"), (None, "parks")], "id long, text string"))
    got = {r.id: r.score for r in search.keyword_search(twice, queries, "id", "text").collect()}
    old = search.postings(twice, "id", "text", queries.select(F.explode(search.terms(F.col("text"))).alias("term")))
    assert set(got) == {None, 1, 4} and {(r.id, r.term, r.tf) for r in old.collect()} == {(1, "green", 3), (1, "parks", 2), (4, "parks", 1), (None, "parks", 1)}
    df, n, mean = {"green": 1, "parks": 3}, 6, 9 / 6
    from math import log1p

    w = lambda t, tf, dl: log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
    mean = (3 + 1 + 0 + 1 + 3 + 1) / n
    assert abs(got[1] - round(w("green", 3, 3) + w("parks", 2, 3), 6)) < 2e-6


def test_vectors_are_scored_some_at_a_time(spark, monkeypatch):
    import random

    import pytest

    from quarrywise.operators import search

    monkeypatch.setattr(search, "SCORES", 9)
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1), None if i == 7 else rng.gauss(0, 1)]) for i in range(30)]
    df = spark.createDataFrame([*rows, (None, [1.0, 2.0]), (90, None), (91, [])], "id long, vec array<double>")
    got = sorted((r.query_id, r["rank"], r.id) for r in search.vector_search(df, df.where("id % 3 = 0").withColumnRenamed("id", "query_id"), "id", "vec", 3).collect())
    dot = lambda a, b: 0.0 if None in a or None in b else round(a[0] * b[0] + a[1] * b[1], 6)
    want = [(q, k + 1, i) for q, a in rows[::3] for k, (_, i) in enumerate(sorted((-dot(a, b), i) for i, b in rows)[:3])]
    assert got == want
    with pytest.raises(Exception, match="several lengths|must match"):
        search.vector_search(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vec array<double>").coalesce(1), df.limit(1).withColumnRenamed("id", "query_id"), "id", "vec").collect()


@pytest.mark.parametrize("most", [0, 10_000])
def test_words_of_passages_are_not_shuffled(spark, monkeypatch, most):
    """Words meet the terms of queries where their text is, unless these are too many; what is found is the same."""
    from quarrywise.operators import knowledge

    plans, write = [], knowledge.materialize
    monkeypatch.setattr(knowledge, "WORDS", most)
    monkeypatch.setattr(knowledge, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    rows = spark.createDataFrame([(1, "Green parks are greener"), (2, "evergreen"), (3, None), (4, "parks")], "id long, text string")
    queries = spark.createDataFrame([(1, "green parks"), (2, "par"), (3, "of"), (4, None)], "query_id int, text string")
    found = knowledge.term_hits(rows, queries)
    assert sorted((r.query_id, r.id, r.score) for r in found.where("query_id < 3").collect()) == [(1, 1, 5), (1, 2, 1), (1, 4, 1), (2, 1, 4), (2, 4, 4)]
    assert ("Exchange hashpartitioning(word#" in plans[-1]) == (most == 0)
