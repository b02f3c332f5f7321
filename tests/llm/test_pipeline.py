import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == columns
            docs = docs.cache()
            n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[2] < n[1] and n[4] < n[3]
    packed = docs.collect()
    assert packed and {r.doc_id for r in packed} <= set(range(10_000)) and max(r.offset + r.length for r in packed) <= 2048


def test_empty(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
