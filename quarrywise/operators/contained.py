"""Which texts contain which strings, and which queries say which phrases: found by an index, not by holding each against each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .search import broadcast_if_small

#: Characters in the runs by which strings are found; shorter strings are runs themselves.
RUN = 3


def _runs(characters: str, n: int) -> Column:
    """The distinct runs of n characters of a column that holds an array of characters."""
    c = F.col(characters)
    run = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[c[i + k] for k in range(n)]))
    return F.when(F.size(c) >= n, F.array_distinct(run))


def containing(rows: DataFrame, needles: DataFrame, short: bool = False) -> DataFrame:
    """rows (id, low), needles (needle): (id, needle), every pair of which the text has the needle in it, inside words too.

    A text that has a needle has all of its runs of three characters. So texts are looked up by the needle's rarest
    run and then read for the needle itself; a needle that has a run that no text has is done with. Needles
    of one or two characters are runs of that length. An empty needle is in every text, so its pairs are all of them.
    Repeated rows and needles count once; nulls have no pairs. short: ids are the texts themselves, words or lines, which go along
    with their runs, so rows are read once; longer ones are read again for the pairs that runs give.
    """
    wanted = materialize(needles.select("needle").where(F.col("needle").isNotNull()).distinct().withColumn("n", F.least(F.length("needle"), F.lit(RUN))))
    texts = rows.select("id", "low").where(F.col("low").isNotNull()).withColumn("chars", F.split("low", "", -1))
    sizes = {r.n for r in wanted.select("n").distinct().collect()}
    out = None
    for n in sorted(sizes):
        own = wanted.where(F.col("n") == n).select("needle")
        if n == 0:
            found = texts.select("id", F.lit("").alias("needle"))
        else:
            parts = own.withColumn("chars", F.split("needle", "", -1)).select("needle", F.explode(_runs("chars", n)).alias("run"))
            posted = texts.select("low" if short else "id", F.explode(_runs("chars", n)).alias("run")).join(broadcast_if_small(parts.select("run").distinct()), "run", "left_semi")
            if n < RUN:
                found = posted.select(F.col("low" if short else "id").alias("id"), F.col("run").alias("needle"))
            else:
                posted = materialize(posted)
                often = posted.groupBy("run").agg(F.count("*").alias("often"))
                rare = parts.join(often, "run", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "run")).alias("r")).where("r.often > 0")
                met = posted.join(rare.select("needle", F.col("r.run").alias("run")), "run").drop("run")
                found = (met.withColumn("id", F.col("low")) if short else met.join(texts.select("id", "low"), "id")).where(F.contains("low", "needle")).select("id", "needle")
        out = found if out is None else out.unionByName(found)
    return (rows.select("id", F.lit(None).cast("string").alias("needle")).limit(0) if out is None else out).distinct()


def phrase_words(x: Column) -> Column:
    return F.filter(F.split(x, "[^a-z0-9]+"), lambda w: w != "")


def said_phrases(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """queries (query_id, q), phrases (phrase), both in lower case: (query_id, phrase), where the words of the phrase stand in the query one after another. Phrases are looked up by their first word; one without words is never said."""
    places = queries.select("query_id", phrase_words(F.col("q")).alias("words")).select("query_id", "words", F.posexplode("words").alias("at", "first"))
    known = phrases.select("phrase").distinct().withColumn("of", phrase_words(F.col("phrase"))).where(F.size("of") > 0).withColumn("first", F.col("of")[0])
    met = places.join(broadcast_if_small(known), "first").where(F.slice("words", F.col("at") + 1, F.size("of")) == F.col("of"))
    return met.select("query_id", "phrase").distinct()
