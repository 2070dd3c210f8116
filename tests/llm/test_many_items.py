"""More benchmark items than the automata of one group take give what one group gives."""

import random

import pytest

from quarrywise.llm import decontaminate


@pytest.mark.parametrize("parts", [1, 3])
def test_groups_of_automata_are_one(spark, edge, monkeypatch, parts):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 99999)}" for _ in range(20)) for _ in range(40)]
    bench = spark.createDataFrame([*enumerate(texts), (90, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{t} {texts[(i + 1) % 40]}") for i, t in enumerate(texts)] + [(50, "x " * 300 + texts[0]), (51, None), (52, f"A {texts[3]} {texts[3]}"), (53, "x " * 900 + texts[0])], "doc_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    want = {k: sorted((repr(r) for r in decontaminate.decontaminate(d, bench).select(*cols).collect())) for k, d in (("docs", docs), ("edge", edge))}
    left = {k: sorted((repr(r) for r in decontaminate.drop_contaminated(d, bench).collect())) for k, d in (("docs", docs), ("edge", edge))}
    monkeypatch.setattr(decontaminate, "PART_BYTES", 500)
    monkeypatch.setattr(decontaminate, "PARTS", parts)
    for k, d in (("docs", docs), ("edge", edge)):
        assert decontaminate._hits(d, bench, "text", 13)[1] is not None
        assert sorted((repr(r) for r in decontaminate.decontaminate(d, bench).select(*cols).collect())) == want[k]
        out = decontaminate.drop_contaminated(d, bench)
        assert out.columns == d.columns and sorted((repr(r) for r in out.collect())) == left[k]
