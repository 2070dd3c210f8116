from itertools import combinations

from quarrywise import catalog
from quarrywise.operators import exports, library

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    by, out = {}, {}
    for r in rows:
        by.setdefault(r.book_id, set()).add((r.kind, r.trait))
    for a, b in combinations(sorted(by), 2):
        kinds = [k for k, _ in by[a] & by[b]]
        score = round(min(1.0, sum(min(most, each * kinds.count(k)) for k, (each, most) in library.EDGE.items())), 3)
        if score >= 0.2:
            out[a, b] = score
    return out


def test_the_graph_has_all_pairs(spark):
    books = catalog.books(spark, SMALL)
    want = brute(library.traits(books).collect())
    for block in (library.HOT_BLOCK, 3):
        got = library.edges(books, block=block).collect()
        assert {(r.book_id, r.other_id): r.score for r in got} == want and len(got) == len(want)
    records = catalog.graph_records(spark, SMALL)
    assert {(r.book_id, r.other_id) for r in records.collect()} == set(want)


def test_aliases_and_terms_make_edges(spark):
    rows = [(1, ["A one", "b", "c"], None), (2, ["c", "b", "a  ONE", "b"], None), (3, None, ["x", "y", "z"]), (4, ["b"], ["z", "y", "x"])]
    books = spark.createDataFrame([(i, f"t{i}", f"a{i}", None, [], a, t) for i, a, t in rows], "book_id long, title string, author string, primary_class string, topics array<string>, routing_aliases array<string>, summary_terms array<string>")
    assert {tuple(r) for r in library.edges(books).collect()} == {(1, 2, 0.3), (3, 4, 0.24)}
    assert {(r.book_id, r.other_id, r.score) for r in library.related(books, books).collect()} == {(1, 2, 0.3), (2, 1, 0.3), (3, 4, 0.24), (4, 3, 0.24)}


def test_copies_meet_once_and_lose_no_edge(spark):
    rows = [(i, ("red bolt", "red ring", "old rod", "x")[i % 4], ("A", "B", "A", None)[i % 4], ("s", "s", "t", None)[i % 4], (["red", "bolt"], ["red", "ring"], ["old", "rod"], [])[i % 4]) for i in range(240)]
    books = spark.createDataFrame(rows, "book_id long, title string, author string, primary_class string, topics array<string>")
    want = brute(library.traits(books).collect())
    sets = library.trait_classes(books, 12)
    assert sets.count() == 4 and library._met(sets, sets, 0.2, 3).count() <= 16
    assert {(r.book_id, r.other_id): r.score for r in library.edges(books, block=7).collect()} == want
    best = sorted((-s, a, b) for (a, b), s in want.items())
    for n in (1, 11, 3000):
        assert [(-r.score, r.book_id, r.other_id) for r in library.best_edges(books, n).collect()] == best[:n]
    got = [(r.book_id, -r.score, r.other_id) for r in library.related(books, books).orderBy("book_id", "rank").collect()]
    both = {**want, **{(b, a): s for (a, b), s in want.items()}}
    assert got == [(a, *t) for a in range(240) for t in sorted((-s, b) for (x, b), s in both.items() if x == a)[:10]]


def test_ids_of_edges_are_shown_once_for_a_pair_of_sets(spark):
    """What shows an id stands below the rows of pairs, not in them, and says what the edge writers say."""
    say = [exports.graphml_edges().alias("graphml"), exports.mermaid_edges().alias("mermaid"), exports.cytoscape_edges().alias("cytoscape")]
    names = ("a<&1", '"q"', "9 b", "-", "5", "é'", "x\\y", "-7")
    for whole, ids in ((False, list(names)), (True, [-7, 0, 5, 12, 9007199254740993, 3, 4, 8])):
        rows = [(i, ("t", "u")[j % 2], "A", "s", ["red"]) for j, i in enumerate(ids)]
        books = spark.createDataFrame(rows, f"book_id {'long' if whole else 'string'}, title string, author string, primary_class string, topics array<string>")
        want = {tuple(r) for r in library.edges(books).select("book_id", "other_id", *say).collect()}
        got = library.edges(books, shown=lambda i: exports.shown_id(i, whole)).select("book_id", "other_id", *exports.edge_records()).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) == 28
    plan = catalog.graph_records(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Generate")]
    assert "to_json" not in top and "regexp" not in top and "RLIKE" not in top and "cast(" not in top, top
