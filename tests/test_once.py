"""What is dear to find is written once in an expression, as each place that names it makes it again."""

from pyspark.sql import functions as F

from quarrywise.functions import isbn
from quarrywise.operators import extract, knowledge, metadata, summaries


def test_headings_and_words_of_topics_are_found_once(spark):
    column = metadata.topics_of(F.col("text"))
    assert str(column).count("regexp_extract_all") == 1 and str(column).count("left(") == 1
    texts = [("# Chapter 1: Money\n# money\n# Own-Place\n# own place\nsystems",), ("",), (None,)]
    assert [r.t for r in spark.createDataFrame(texts, "text string").select(column.alias("t")).collect()] == [["money", "own-place", "systems"], [], []]


def test_concepts_and_queries_that_are_alike_meet_once(spark, monkeypatch):
    said = ("steel bolt", "steel ring", "Ring!")
    concepts = spark.createDataFrame([(i, said[i % 3], said[i % 3], "") for i in range(90)], "concept_id long, name string, said string, primary_class string")
    queries = spark.createDataFrame([(i, ("steel", "ring")[i % 2]) for i in range(40)], "query_id long, text string")
    met, containing = [], knowledge.containing
    monkeypatch.setattr(knowledge, "containing", lambda rows, needles: met.append((rows.count(), needles.count())) or containing(rows, needles))
    got = [tuple(r) for r in knowledge.concept_search(concepts, queries, 40).orderBy("query_id", "rank").collect()]
    assert met == [(3, 2)]
    want = []
    for q in range(40):
        fits = sorted(((said[i % 3], i) for i in range(90) if ("steel", "ring")[q % 2] in said[i % 3].lower()), key=lambda x: (x[0], x[1]))[:40]
        want += [(q, i, name, 0.8, n) for n, (name, i) in enumerate(fits, 1)]
    assert got == want


def test_numbers_and_claims_are_found_once(spark):
    assert str(metadata.parsed_name(F.col("name"))).count("split(") == 1
    assert str(isbn.normal_isbn(F.col("x"))).count("ISBN") == 1
    assert str(extract.concept_candidates(F.col("x"))).count("regexp_extract_all") == 5
    assert str(summaries.heading_ideas(F.col("paths"), None, 8)).count("flatten") == 1
    text = "The plan should help the team because focus improves with practice. the PLAN should help the team because focus improves with practice. "
    rows = extract.claims(spark.createDataFrame([(1, text), (2, None)], "book_id long, text string"))
    assert [(r.book_id, r.claim_index, r.claim) for r in rows.collect()] == [(1, 0, text.split(". ")[0] + ".")]
    assert "size(" not in "".join(line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip(" :+-").startswith("Filter"))


def test_claims_are_not_sent_to_the_driver(spark):
    claims = spark.createDataFrame([(f"c{i}", "a plan of money", None, "t", "a", None, None, [], "supports") for i in range(40)], "claim_id string, claim string, citation string, title string, author string, heading_path string, evidence string, tags array<string>, stance string")
    plan = knowledge.claim_search(claims, spark.createDataFrame([(1, "money plan")], "query_id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 4


def test_windows_are_stripped_once(spark):
    """What strips a window, and what measures its lead, are in its expression once."""
    from quarrywise.operators import chunks

    said = spark.range(1).select(F.lit("a").alias("t")).select(chunks.pieces(F.col("t")).alias("p"))._jdf.queryExecution().logical().toString()
    assert said.count("regexp_replace") <= 1 and said.count("regexp_extract") <= 1, said
