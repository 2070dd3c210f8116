"""The query router at size: terms found by one lookup, what is found shuffled once, and rows that share an id."""

import random
import re

import duckdb
from against import same
from pyspark.sql import functions as F

from quarrywise import catalog
from quarrywise.operators import taxonomy

SMALL = "/root/testdata/sf0.001"


def test_only_what_is_found_is_shuffled_and_by_query(spark):
    said = catalog.QUERIES["query_intents"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", said)
    assert 1 <= len(keys) <= 2 and all(re.fullmatch(r"query_id#\d+L", k) for k in keys), keys
    assert said.count("RLIKE") <= 1  # no pattern for each term of the domains


def test_rows_that_share_an_id_add_up_as_in_sql(spark, tmp_path):
    names = "CASE k % 5 WHEN 0 THEN 'small ring' WHEN 1 THEN 'Red steel goods' WHEN 2 THEN '' WHEN 3 THEN 'hot stock gear' ELSE 'shot stocks, finance' END"
    duckdb.sql(f"COPY (SELECT CASE WHEN k % 17 = 3 THEN NULL ELSE k // 2 END AS p_partkey, {names} AS p_name FROM range(120) t(k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    same(spark, catalog.QUERIES["query_intents"], catalog.ORACLE["query_intents"], str(tmp_path))


def test_scores_tie_only_where_those_of_the_sql_do(spark, tmp_path):
    """finance has 1.2 as an alias and 5.4 as a domain, in doubles more than the 6.6 of business."""
    duckdb.sql(f"COPY (SELECT k AS p_partkey, 'old gear management growth' AS p_name FROM range(16) t(k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    same(spark, catalog.QUERIES["query_intents"], catalog.ORACLE["query_intents"], str(tmp_path))


def met_brute(q, terms):
    norm = lambda x: re.sub(r"\s+", " ", (x or "").lower().replace("_", "-"), flags=re.ASCII).strip(" ")
    q, out = norm(q), []
    for t in terms:
        n = norm(t)
        if n and ((n in q or n.replace("-", " ") in q) if " " in n or "-" in n else re.search(rf"\b{re.escape(n)}\b", q)):
            out.append(t)
    return out


def test_terms_of_any_characters_are_met_once(spark):
    rng = random.Random(23)
    say = lambda n: "".join(rng.choice(("a", "b", "é", "漢", "-", " ", "+", ".", "_", "😀")) for _ in range(rng.randint(1, n)))
    terms = sorted({say(5) for _ in range(150)} | {"c++", ".net", "e-book", "e book", "-x", "-", "hot stock", "", " ", "Hot_Gear", "it's", "word"})
    asked = [say(25) for _ in range(60)] + ["shot stocks e-book, e book", "c++ c+ .net x.net.y", "a -x", "hot gear hot-gear", "it's a word", "words sword", "", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string").withColumn("q", taxonomy.normal_query(F.col("q")))
    got = sorted((r.query_id, r.term) for r in taxonomy.terms_met(queries, spark.createDataFrame([(t,) for t in terms], "term string")).collect())
    want = sorted((i, t) for i, q in enumerate(asked) for t in met_brute(q, terms))
    assert got == want and len(want) > 200
    words = spark.createDataFrame([("word",), ("stock",)], "term string")  # no term needs a piece
    assert [(r.query_id, r.term) for r in taxonomy.terms_met(queries, words).collect()] == [(i, t) for i, q in enumerate(asked) for t in met_brute(q, ["word", "stock"])]


def test_a_taxonomy_too_large_for_a_broadcast(spark, monkeypatch):
    classes, aliases = taxonomy.taxonomy_tables(spark, "classes: {'1': {label: money matters, aliases: [cash flow]}}\nrouting_aliases: {cash: {primary_class: ['1']}, e_book: {secondary_class: ['1']}}")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["cash flow of an e-book", "money matters", "sleep", "none", None])], "query_id int, text string")
    want = sorted(map(tuple, taxonomy.route_queries(queries, classes, aliases).collect()))
    monkeypatch.setattr(taxonomy, "broadcast_if_small", lambda rows: rows)
    assert sorted(map(tuple, taxonomy.route_queries(queries, classes, aliases).collect())) == want and want[0][1][0] == "cash"
