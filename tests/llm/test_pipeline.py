"""The pipeline's stages on a small corpus, against plain Python."""

import os

import pytest

import corpus_pipeline
from graphloom.llm import simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(n))
        stage(spark, docs.withColumn("score", docs["text"]), FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        if n == 3:
            break
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "SimHash near-dedup":
            sets = {i: frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in before.items()}
            for i, t in before.items():
                same = [j for j, u in before.items() if u == t]
                assert i == min(same) or i not in after
            for i in set(before) - set(after):  # what went has a near copy
                assert any(j != i and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) for j in before), i
        elif name == "substring dedup":
            assert all(len((t or "").split()) <= len((before[i] or "").split()) for i, t in after.items())
        else:
            assert all(t == before[i] for i, t in after.items())
            assert len(after) >= 0.7 * len(before)
        before = after
    assert {r["doc_id"] for r in docs.collect()} == set(before)


def test_run_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
