from pyspark.sql import functions as F

from quarrywise.operators import library
from quarrywise.plans import evidence

#: More than are broadcast.
MANY = 10_050


def test_no_query_is_left_out(spark):
    queries = spark.range(MANY).select(F.col("id").alias("query_id"), F.lit("steel bolt").alias("text"))
    passages = spark.createDataFrame([(1, "a Steel bolt"), (2, "bolt"), (3, "none")], "id long, text string")
    got = evidence.passage_search(passages, queries).groupBy("id", "score", "rank").agg(F.countDistinct("query_id").alias("n")).collect()
    assert sorted((r.id, r.score, r["rank"], r.n) for r in got) == [(1, 5, 1, MANY), (2, 1, 2, MANY)]


def test_no_name_is_left_out(spark):
    names = spark.range(MANY).select(F.concat(F.lit("name"), "id").alias("alias"), F.concat(F.lit("label"), "id").alias("label"))
    queries = names.select(F.substring("alias", 5, 9).cast("long").alias("query_id"), F.replace("alias", F.lit("_"), F.lit(" ")).alias("text")).where("query_id % 1000 = 0 OR query_id >= 10000")
    got = {(r.query_id, r.alias) for r in library.route(queries, names).collect()}
    assert got == {(r.query_id, f"name{r.query_id}") for r in queries.collect()}
