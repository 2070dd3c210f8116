"""The registered queries without SQL, and the pipeline, against plain Python over the given table."""

import zlib
from collections import defaultdict

import numpy as np
from test_dedup import components_brute, fingerprint_brute
from test_near_copies import brute_links, least_ids
from test_text_ops import item_words

import corpus_pipeline
from quarrywise.llm import packing
from quarrywise.llm.queries import QUERIES, TOKENIZER

SMALL = "/root/testdata/sf0.001"


def near_brute(rows):
    """(fingerprint, least id of the component) of each (id, text)."""
    fps = [fingerprint_brute(t) for _, t in rows]
    roots, least = components_brute(fps), {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, i), i)
    return {i: (format(f, "016x"), least[r]) for (i, _), f, r in zip(rows, fps, roots)}


def contaminated_brute(rows, items):
    windows = {tuple(w[k : k + 13]) for t in items for w in [item_words(t)] if w for k in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}
    bad = set()
    for i, t in rows:
        w, hit = item_words(t), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            bad.add(i)
    return bad


def packed_well(rows, docs):
    """Pieces hold all ids of the documents in order, sequences have no gaps and no more than 1024 tokens, and there are few."""
    from tokenizers import Tokenizer

    tok, by = Tokenizer.from_file(TOKENIZER), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == {i for i, _ in docs}
    for i, t in docs:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids) and (len(by[i]) == 1) == (len(ids) <= 1024) and all(r.length == 1024 for r in by[i] if r.piece)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    histogram = defaultdict(int)
    for r in rows:
        histogram[r.length] += 1
    assert packing.dual_bound(histogram) <= len(seqs) <= sum(packing.best_fit(histogram).values())


def test_sharding_query(spark, small):
    got = {r.doc_id: r for r in QUERIES["op2_sharding"](spark, SMALL).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in small.collect()}
    assert {i: (r["size"], r.text_crc32, r.law, r.grown_shard) for i, r in got.items()} == {i: (len(t) + 8, zlib.crc32(t), "bytes", None) for i, t in texts.items()}
    slots = defaultdict(list)
    for r in got.values():
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_simhash_query(spark, small):
    want = near_brute([(r.doc_id, r.text) for r in small.collect()])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_dedup"](spark, SMALL).collect()} == want


def test_toxicity_query(spark, small):
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, SMALL).collect()}
    assert set(got) == {r.doc_id for r in small.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())


def test_packing_query(spark, small):
    packed_well(QUERIES["op8_packing"](spark, SMALL).collect(), [(r.doc_id, r.text) for r in small.collect()])


def test_pipeline_is_plain_python(spark, small, tmp_path):
    """All but the first stage, whose machine is learned, are done again in plain Python on what the stage before kept."""
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in QUERIES["op7_toxicity"](spark, SMALL).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in small.collect() if r.doc_id not in toxic]
    last = {}
    for i, t in rows:
        last[t or ""] = max(last.get(t or "", i), i)
    rows = [(i, t) for i, t in rows if last[t or ""] == i]
    rows = [r for r, least in zip(rows, least_ids(rows, brute_links(rows))) if r[0] == least]
    bad = contaminated_brute(rows, items)
    rows = [(i, t) for i, t in rows if i not in bad]
    packed_well(corpus_pipeline.run(spark, SMALL).collect(), rows)
