"""The pipeline's stages, one after the other."""

import os
import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def test_stages_chain(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert 0 < docs.count() <= before, name
        before = docs.count()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, again.select("doc_id", "n_tokens", "bucket").collect())) == sorted(map(str, docs.select("doc_id", "n_tokens", "bucket").collect()))


def test_stages_take_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_near_duplicates_drops_longer_versions_of_a_family(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = [base] + [base[:i] + ["edit"] + base[i + 1 :] for i in range(20, 380, 30)]
    texts += [base + [f"own{r.randrange(10**9)}" for _ in range(97)] for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert [x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [0]
