"""Bodies that are alike, told by their shingles, against all comparisons; chapters that stay in their rows."""

import random
import re

import pytest

from quarrywise.operators import near, summaries


def shingles_of(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    sets = [(i, shingles_of(t)) for i, t in rows]
    first = {}
    for i, s in sets:
        first[s] = min(first.get(s, i), i)
    reps = sorted((i, s) for s, i in first.items())
    pairs = {(i, j): round(len(s & t) / len(s | t), 6) for k, (i, s) in enumerate(reps) for j, t in reps[k + 1 :] if s and t and 5 * len(s & t) >= 4 * len(s | t)}
    return pairs, {i: first[s] for i, s in sets}


def bodies(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(("new", "Word", "x"))
            out.append((i, " ".join(w[rng.randint(0, 1) :])))
        else:
            out.append((i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.choice((0, 1, 3, 5, 6, 12, 60, 150))))))
    return out + [(n, None), (n + 1, " \n"), (n + 2, "A b"), (n + 3, "a  B"), (n + 4, "é É")]


@pytest.mark.parametrize("block", [1000, 3])
def test_pairs_are_those_of_all_comparisons(spark, block):
    rows = bodies(7, 160)
    pairs, members = near.similar_bodies(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    want, of = brute(rows)
    assert {(r.a, r.b): r.similarity for r in pairs.collect()} == want and len(want) > 20
    assert {r.doc_id: r.class_id for r in members.collect()} == of


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want, of = brute(rows)
    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    got = near.body_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, c, links.get(c, 0)) for i, c in of.items())
    assert near.body_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_text_of_chapters_is_exchanged(spark):
    df = spark.createDataFrame([(1, "# A\nbody words here\n# B\nmore words\n# A\nagain", ["t"], ["r"])], "book_id int, text string, topics array<string>, routing_aliases array<string>")
    for rows in (summaries.chapter_summaries(df), summaries.book_summaries(df)):
        said = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
        sent = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", said)
        assert sent and not any(re.search(r"\b(combined|text|s|__chapters)#", x) for x in sent), sent
