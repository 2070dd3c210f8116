import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quarrywise.operators import knowledge, summaries
from quarrywise.plans import evidence

BOOK = """# Preface
A first paragraph of the preface that is long enough to be the thesis of the whole book, as it has far more than one hundred and twenty characters in it.

# Chapter 2: Habits and goals
## Small steps
Habits habits habits systems systems money.

# Chapter 1: Money
## Saving
### Deep saving
Interest compounds.
## Small steps
Again.
# Preface
More preface words."""


def test_chapters_and_books_are_summarised(spark):
    df = spark.createDataFrame([(1, BOOK, ["Saving", "risk taking"], ["self_help"]), (2, "plain words here", None, None), (3, None, [], [])], "book_id int, text string, topics array<string>, routing_aliases array<string>")
    got = summaries.chapter_summaries(df).orderBy("book_id", "place").collect()
    assert [(r.book_id, r.title, r.n_sections, r.headings) for r in got] == [
        (1, "Preface", 2, []), (1, "Chapter 1: Money", 2, ["Deep saving", "Small steps"]), (1, "Chapter 2: Habits and goals", 1, ["Small steps"]), (2, "Unheaded content", 1, []),
    ]
    assert got[1].ideas == ["Saving", "Deep saving", "Money", "Small steps"] and got[2].keywords[:2] == ["habits", "systems"] and got[0].summary.startswith("A first paragraph")
    one, two, three = summaries.book_summaries(df).orderBy("book_id").collect()
    assert one.ideas == ["Saving", "risk taking", "Preface", "Habits and goals", "Small steps", "Deep saving", "Money"] and one.n_chapters == 3
    assert one.best_for[:4] == ["self help", "Saving", "risk taking", "Preface"] and len(one.best_for) == 10
    assert (two.thesis, two.n_chapters, three.thesis, three.ideas) == ("plain words here", 1, "", [])


def themes_brute(body, query, limit):
    low = re.sub(r"\s+", " ", re.sub(r"[*_~>#{}\[\]()]", " ", body)).strip().lower()
    asked, w = set(re.findall(r"[a-z][a-z0-9\-]{2,}", query.lower())) - set(summaries.THEME_STOP_WORDS), defaultdict(float)
    for f in summaries.THEME_FORMS:
        for p in re.findall(f, low):
            own = [x for x in p.split() if x not in summaries.THEME_STOP_WORDS]
            if len(p) >= 6 and own and not re.search("chapter|summary|unknown", p):
                w[p] += 1 + 0.75 * len(asked & set(own))
    for x in re.findall(r"[a-z][a-z\-']{3,}", low):
        x = x.strip("-' ")
        if x and x not in summaries.THEME_STOP_WORDS:
            w[x] += 1.3 if x in asked else 0.3
    out = []
    for p in sorted(w, key=lambda p: (-round(w[p], 6), p)):
        if p.replace("-", "_").replace(" ", "_") in {o.replace("-", "_").replace(" ", "_") for o in out} or (" " not in p and p not in asked and len(out) >= 6):
            continue
        out.append(p)
        if len(out) == limit:
            break
    return out


def test_themes_are_brute_force(spark):
    rng = random.Random(2)
    words = "habits over goals and systems versus money of time this chapter deep-work work deep focus risk vs. reward the a".split()
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 3, 40, 200)]
    got = {r.id: r.themes for r in summaries.themes(spark.createDataFrame([(i, t, "deep focus on goals") for i, t in enumerate(texts)], "id int, text string, query string"), 9).collect()}
    assert got == {i: themes_brute(t, "deep focus on goals", 9) for i, t in enumerate(texts)}


def hits_brute(rows, queries):
    out = {}
    for q, asked in queries:
        low = asked.lower()
        for i, t in rows:
            t = (t or "").lower()
            n = sum(w in t for w in {w for w in re.findall(r"\w+", low) if len(w) > 2})
            if s := n + (3 if low in t else 0):
                out[q, i] = s
    return out


def test_texts_are_found_by_parts_of_words(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["habits", "goal-setting", "Über", "goals", "an", "is", "münze", "x_y", "a.b"], k=rng.randint(0, 6)))) for i in range(40)] + [(90, None), (91, "")]
    queries = [(1, "goal habit"), (2, "is"), (3, "habits goals"), (4, "ÜBER"), (5, "a.b"), (6, "none at all"), (7, "nze"), (8, "goal goal-setting")]
    a, b = spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(queries, "query_id int, text string")
    assert {(r.query_id, r.id): r.score for r in knowledge.term_hits(a, b).collect()} == hits_brute(rows, queries)
    best = evidence.passage_search(a, b, 3).collect()
    want = hits_brute(rows, queries)
    for q, _ in queries:
        assert [(r.id, r.score) for r in sorted((r for r in best if r.query_id == q), key=lambda r: r["rank"])] == [(i, s) for s, i in sorted(((-s, i) for (k, i), s in want.items() if k == q))[:3] for s in (-s,)]


def test_claims_and_concepts_are_found(spark):
    rows = [("c1", "Goals help focus", "B", "supports", ["goals"]), ("c2", "Goals fail without systems", "A", "challenges", []), ("c3", "It depends on goals", None, "qualifies", ["risk"]), ("c4", "Nothing", "C", None, [])]
    claims = spark.createDataFrame([(i, c, None, t, "Ann", "", "", g, s) for i, c, t, s, g in rows], "claim_id string, claim string, citation string, title string, author string, heading_path string, evidence string, tags array<string>, stance string")
    q = spark.createDataFrame([(1, "goals focus"), (2, "compound risk"), (3, "zzz")], "query_id int, text string")
    assert [(r.claim_id, r.score) for r in knowledge.claim_search(claims, q).where("query_id = 1").orderBy("rank").collect()] == [("c1", 2), ("c3", 1), ("c2", 1)]
    assert [r.claim_id for r in knowledge.claim_search(claims, q, stance="challenges").where("query_id = 1").collect()] == ["c2"]
    buckets, tensions = knowledge.compared_claims(claims, q, 1)
    assert {(r.stance, r.claim_id) for r in buckets.where("query_id = 1").collect()} == {("supports", "c1"), ("challenges", "c2"), ("qualifies", "c3")}
    t = {r.query_id: r.tensions for r in tensions.collect()}
    assert len(t[1]) == 3 and t[2] == ["Some claims treat 'compound risk' as context-dependent rather than simply true or false.", knowledge.COMPOUND, knowledge.RISK] and t[3] == ["No strong claim-level disagreement was detected for 'zzz'."]
    concepts = spark.createDataFrame([("a", "Habit Loop", "Habit loop: cue, routine", "158", "model", "T"), ("b", "Loop", "a loop", "332", "concept", "S"), ("c", "Other", "other", None, "model", None)], "concept_id string, name string, said string, primary_class string, type string, title string")
    got = knowledge.concept_search(concepts, spark.createDataFrame([(1, "Habit-loop"), (2, "??")], "query_id int, text string")).orderBy("rank").collect()
    assert [(r.concept_id, r.score) for r in got] == [("a", 0.9), ("b", 0.1)]
    assert [r.concept_id for r in knowledge.listed_concepts(concepts, kind="model").collect()] == ["c", "a"] and knowledge.listed_concepts(concepts, code="332").count() == 1


def test_listings_and_samples(spark):
    rows = [("1", "T", "Ann Lee", "332", "p", 1, "s1", "Saving", "A > Saving"), ("1", "T", "Ann Lee", "332", "p", 0, "s2", "Start", "A"), ("2", "U", None, None, "q", 0, None, None, None)]
    chunks = spark.createDataFrame(rows, "book_id string, title string, author string, primary_class string, source_path string, chunk_index int, section_id string, section_title string, heading_path string")
    assert {(r.book_id, r.n_chunks) for r in knowledge.listed_books(chunks).collect()} == {("1", 2), ("2", 1)} and knowledge.listed_books(chunks, author="LEE").count() == 1 and knowledge.listed_books(chunks, code="9").count() == 0
    assert [r.chunk_index for r in knowledge.of_section(chunks, "T", "A").collect()] == [0, 1] and [r.section_id for r in knowledge.of_section(chunks, "1", "saving").collect()] == ["s1"]
    assert [(r.book_id, r.chunk_index) for r in knowledge.in_order(chunks).collect()] == [("1", 0), ("1", 1), ("2", 0)]
    ids = [sorted(r.id for r in knowledge.sampled(spark.range(100).repartition(n), "id", 10, 7).collect()) for n in (1, 5)]
    assert ids[0] == ids[1] and len(ids[0]) == 10 and ids[0] != list(range(10))
    found = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (1, "x", 2), (1, "", 1), (1, None, 1)], "query_id int, v string, rank int")
    assert [(r.v, r.place) for r in knowledge.first_seen(found, "v").orderBy("place").collect()] == [("y", 1), ("x", 2)]
    got = spark.createDataFrame([("5",), ("0",), ("999",), ("x",), (None,)], "v string").select(knowledge.clamped(F.col("v"), 50, 8).alias("n")).collect()
    assert [r.n for r in got] == [5, 1, 50, 8, 8]
