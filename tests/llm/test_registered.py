"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest

from lectern.llm import exact_dedup, languages, mixing, neardup, registry
from tests.oracle import same, tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    same(spark, tables(SMALL), SMALL, registry.QUERIES[name], registry.ORACLES[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, sizes = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        kept = stage(spark, before, SMALL)
        kept.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(kept.count())
        if k < 4:
            assert kept.columns == docs.columns
    stages = [spark.read.parquet(f"{tmp_path}/{k}") for k in range(5)]
    told = languages.identify(docs).where(f"lang_pred <> 'und' and score >= {languages.LEAST_SCORE}")
    assert {r.doc_id for r in stages[0].collect()} == {r.doc_id for r in told.collect()}
    exact = exact_dedup.exact_groups(stages[0]).where("kept")
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r.doc_id for r in exact.collect())
    near = neardup.near_groups(stages[1]).where("kept")
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(r.doc_id for r in near.collect())
    mix = {r.doc_id: (r.taken, r.size) for r in mixing.mixture(stages[2]).collect()}
    times = {}
    for r in stages[3].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(times.get(i, 0) == int(t / n + 0.5) for i, (t, n) in mix.items() if n)
    assert sizes[4] == sizes[3] and sorted(r.doc_id for r in stages[4].collect()) == sorted(r.doc_id for r in stages[3].collect())
    final = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, stages[4].collect()))
