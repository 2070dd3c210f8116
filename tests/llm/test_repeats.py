"""Rows that repeat an id with other texts, and callers' columns that bear the operators' own names."""

import random

import pytest
from conftest import words
from test_dedup import components_brute, fingerprint_brute, substring_brute

from quarrywise.llm import exact_dedup, simhash, substring_dedup


def test_windows_belong_to_a_row_not_to_an_id(spark):
    rng = random.Random(12)
    w, tail, x = words(rng, 70), words(rng, 9), words(rng, 80)
    rows = [(1, w), (2, f"{w} {tail}"), (2, x), (3, x), (3, f"{tail} {x} {w}"), (3, f"{tail} {x} {w}"), (4, f"{w} {w}")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == substring_brute(rows)
    assert [r.n_removed for r in got if r.kept_text == x] == [0]


def test_texts_whose_windows_are_all_alone(spark):
    """Each task sees rows without any open window."""
    rng = random.Random(13)
    shared = words(rng, 55)
    rows = [(i, words(rng, 60)) for i in range(6)] + [(9, shared), (8, f"x {shared}")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == substring_brute(rows)


INNER = ("row", "__key", "__copy", "__nth", "__kept", "nth", "keep_id", "group_size", "text_sha256", "n_bytes", "text_key", "fp", "component_id", "id", "a.b")


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, simhash.drop_near_copies])
def test_callers_columns_keep_their_names_and_values(spark, drop):
    rows = [(i, t, *[f"{c}{i}" for c in INNER]) for i, t in [(1, "one two three"), (2, "one two three"), (3, "else entirely here"), (4, None), (5, "")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in INNER))
    out = drop(df)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows) and len(got) == 3


def test_near_copies_of_a_repeated_id(spark):
    """Of the texts under one id each stands in its own component; none is lost with another's."""
    rng = random.Random(14)
    a, b = words(rng, 200), words(rng, 200)
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b)]
    fps = [fingerprint_brute(t) for _, t in rows]
    roots = components_brute(fps)
    assert roots[0] != roots[2]
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted([(3, a), (5, b)])


def test_subtrees_are_joined_in_pieces(spark, monkeypatch):
    rng = random.Random(15)
    fps = sorted({(c ^ (1 << rng.randrange(62))) for c in [rng.getrandbits(62) for _ in range(40)] for _ in range(30)})
    df = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, id long")
    want = components_brute(fps)
    for most in (50, 500_000):
        monkeypatch.setattr(simhash, "SUBTREES", most)
        found = dict(simhash.components(simhash.links(df, len(fps))).collect())
        assert [found.get(i, i) for i in range(len(fps))] == want
