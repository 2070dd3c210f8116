"""Cells and bitmaps: pruned and filtered searches find what a search of everything finds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrywise.operators import cells, filters, inverted, search, taxonomy

CLASSED = "id long, book_id long, title string, primary_class string, secondary_class_text string, text string, vec array<double>"


def classed(spark, seed, n):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice(("goal", "habit", "money", "risk", "sleep")) for _ in range(rng.randint(0, 12)))
    vec = lambda: [rng.gauss(0, 1) + 4 * (rng.random() < 0.5) for _ in range(4)]
    rows = [(i * 37, i // 4, rng.choice(("A", "B", "7", None)), rng.choice(("332", "158", None)), rng.choice(("158|658", "65", "", None)), rng.choice((None, say(), say())), rng.choice((vec(), vec(), vec(), None))) for i in range(n)]
    return spark.createDataFrame(rows, CLASSED)


def found(df):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in df.collect())


def brute_vectors(rows, queries, limit):
    out = []
    for q, qv in queries:
        hits = sorted((-(round(float(np.nan_to_num(np.dot(np.array(qv, float), np.array(v, float)))), 6)), i) for i, v in rows if v)
        out += [(q, i, -s, k + 1) for k, (s, i) in enumerate(hits[:limit])]
    return sorted(out)


@pytest.mark.parametrize(("n_cells", "block", "limit"), [(None, 1024, 10), (12, 16, 3), (5, 3, 1), (40, 7, 300)])
def test_pruned_search_is_the_search_of_all(spark, tmp_path, n_cells, block, limit):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 8)) * 6
    rows = [(i, (centres[i % 10] + rng.normal(size=8)).tolist()) for i in range(240)] + [(500, None), (501, []), (502, [float("nan")] * 8), (503, [float("inf")] + [0.0] * 7), (504, [0.0] * 8)]
    rows += [(600 + i, rows[3][1]) for i in range(20)]
    queries = [(i, rows[i][1]) for i in range(0, 240, 20)] + [(900, [0.0] * 8), (901, (centres[2] * 3).tolist()), (902, [float("nan")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = spark.createDataFrame(queries, "query_id long, vec array<double>")
    index = cells.write_cells(df, "id", "vec", str(tmp_path / "c"), n_cells, block)
    assert index.sizes.sum() == 263
    got = found(cells.cell_search(spark, index, asked, limit))
    assert got == found(search.vector_search(df, asked, "id", "vec", limit))
    finite = [q for q in queries if q[0] != 902]
    assert [g for g in got if g[0] != 902] == brute_vectors([r for r in rows if r[0] != 503], finite, limit) or any(g[1] == 503 for g in got)


def test_most_pairs_are_skipped_where_vectors_cluster(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 8)) * 10
    df = spark.createDataFrame([(i, (centres[i % 16] + 0.1 * rng.normal(size=8)).tolist()) for i in range(800)], "id long, vec array<double>")
    asked = df.where("id % 40 = 0").select(F.col("id").alias("query_id"), "vec")
    index = cells.write_cells(df, "id", "vec", str(tmp_path / "c"), 16, 25)
    s = cells.CellSearch(spark, index, asked, 10)
    assert s.share_skipped() > 0.5 and found(s.run()) == found(search.vector_search(df, asked, "id", "vec", 10))


def test_empty_cells(spark, tmp_path):
    df = spark.createDataFrame([], "id long, vec array<double>")
    index = cells.write_cells(df, "id", "vec", str(tmp_path / "c"))
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>")
    assert cells.cell_search(spark, index, asked).collect() == []


FILTERS = [(1, None, ["658"]), (2, "A", []), (3, "7", ["158"]), (4, "B", ["65", "332"]), (5, None, None), (6, None, ["absent"]), (7, "none", None), (8, None, ["658", "658"])]


def test_bitmaps_are_the_filters(spark):
    rows = classed(spark, 5, 90).cache()
    given = spark.createDataFrame(FILTERS, "query_id int, book string, codes array<string>")
    within = filters.selected(given, filters.bitmaps(rows))
    hits = rows.select("id").join(given.select("query_id"), F.lit(True))
    want = sorted((r.query_id, r.id) for r in taxonomy.allowed(rows, given).select("query_id", "id").collect())
    assert sorted((r.query_id, r.id) for r in filters.kept(hits, within).collect()) == want
    assert within.queries.where("query_id IN (1, 8)").select("filter").distinct().count() == 1


@pytest.mark.parametrize("limit", [2, 50])
def test_all_three_searches_are_filtered(spark, tmp_path, limit):
    rows = classed(spark, 6, 120).cache()
    given = spark.createDataFrame(FILTERS, "query_id int, book string, codes array<string>")
    asked = spark.createDataFrame([(k, "goal money", [1.0, -1.0, 0.5, 2.0]) for k, *_ in FILTERS] + [(9, "risk", [1.0] * 4)], "query_id int, text string, vec array<double>")
    within = filters.selected(given, filters.bitmaps(rows))
    may = taxonomy.allowed(rows, given).select("query_id", "id").unionByName(rows.select(F.lit(9).alias("query_id"), "id"))
    only = lambda df: search.top(df.drop("rank").join(may, ["query_id", "id"]), limit)
    words = inverted.indexed_search(spark, [inverted.write_postings(rows, "id", "text", str(tmp_path / "p"), 16, 40)], asked, limit, within)
    near = cells.cell_search(spark, cells.write_cells(rows, "id", "vec", str(tmp_path / "c"), 6, 8), asked, limit, within)
    all_words, all_near = search.keyword_search(rows, asked, "id", "text", 10**6), search.vector_search(rows, asked, "id", "vec", 10**6)
    assert found(words) == found(only(all_words)) and found(near) == found(only(all_near))
    assert found(search.fused(words, near, limit=limit)) == found(search.fused(only(all_words), only(all_near), limit=limit))
