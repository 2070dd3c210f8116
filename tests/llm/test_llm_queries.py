import pytest
from against import same
from pyspark.sql import functions as F

import corpus_pipeline
from quarrywise.llm import decontaminate, exact_dedup, near_copies, toxicity
from quarrywise.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_is_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name], SMALL)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    says = [
        lambda d: toxicity.toxicity(d, labels).where("predicted = 0"),
        lambda d: exact_dedup.exact_dedup(d).where("kept"),
        lambda d: near_copies.near_copies(d).where("doc_id = component_id"),
        lambda d: decontaminate.decontaminate(d, bench).where("NOT contaminated"),
    ]
    for k, ((_, stage), said) in enumerate(zip(corpus_pipeline.STAGES, says)):
        want = sorted(r.doc_id for r in said(docs).collect())
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert sorted(r.doc_id for r in docs.collect()) == want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert sorted(r.doc_id for r in packed.select("doc_id").distinct().collect()) == sorted(r.doc_id for r in docs.collect())
    run = corpus_pipeline.run(spark, SMALL)
    assert run.agg(F.countDistinct("doc_id")).first()[0] == docs.count()
