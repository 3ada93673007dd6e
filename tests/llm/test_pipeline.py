"""Stages of the pipeline and the registry."""

import re

import corpus_pipeline
import __spark_entry__ as E
from retentio.llm.queries import ORACLE, QUERIES
from tests.llm.cases import EDGE, frame, prose


def tables(spark, path, rows):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1), (9, 1), (12, 1), (600, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "a tiny item"), (2, prose(2, 80))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rows = EDGE + [(30, "here is a tiny item of it"), (600, "X!! " * 200)]
    sf_dir = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{re.sub('[^a-z]', '', name.lower())}"
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0 < out.count() <= docs.count()
        docs = out
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 30 not in texts and 12 in texts  # the leak goes; one of the texts of id 12 has none
    assert not any("tiny item" in (t or "") for t in texts.values())
    assert sum(t is not None and t.startswith(prose(1, 120)[:40]) for t in texts.values()) <= 1  # copies go
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == final.count()


def test_stages_on_empty_tables(spark, tmp_path):
    sf_dir = tables(spark, tmp_path, EDGE)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(QUERIES)
    assert [s for s, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
