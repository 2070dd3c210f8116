import random

import pytest

#: Names that operators use inside; tables may have columns of these names.
CLASHES = ("keep_id", "kept", "removed", "shard", "score", "fp", "component_id", "node", "part", "chunk", "length", "segments", "h1", "__key", "spans", "label")


def words(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "of", "the", "and")) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, blank and very long texts, copies, near copies, shared passages, repeated rows, a null id."""
    rng = random.Random(5)
    a, passage = words(rng, 130), words(rng, 60)
    near = a.split()
    near[-1] = "changed"
    rows = [(1, None), (2, ""), (3, "one Two three"), (4, "one Two three"), (5, a), (5, a), (6, f"intro {passage} outro"), (7, f"{words(rng, 30)}\n{passage}\tend"), (8, " \n\t "), (9, a), (10, " ".join(near))]
    rows += [(11, words(rng, 9000)), (12, "x" * 30_000), (13, "ñ é 漢字 <|endoftext|> \u00a0 \u2028"), (14, f"{passage} {passage}"), (None, "no id"), (15, " ".join(["again"] * 120)), (16, " ".join(["again"] * 120))]
    return rows


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, None, None, None, *["x"] * len(CLASHES)) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return frame(spark, edge_rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
