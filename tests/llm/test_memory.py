"""What an executor's workers hold: the batches that reach them and what they keep between stages."""

import gc
import os
import weakref

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from retentio.llm import importance, jaccard_join, packing, tokens
from retentio.llm.common import small_batches
from tests.llm.cases import prose

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST = 9 << 20


def select(docs, labels):
    return importance.select_rows(docs, labels).count()


def drop_copies(docs, labels):
    return jaccard_join.drop_copies(docs).count()


def pack(docs, labels):
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count()


@pytest.mark.parametrize("module,work", [(importance, select), (jaccard_join, drop_copies), (packing, pack)])
def test_whole_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch, module, work):
    text = prose(3, 1300)
    spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.lit(" "), F.col("id").cast("string")).alias(
        "text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert docs.agg(F.sum(F.octet_length("text"))).first()[0] > 2 * MOST
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    seen, chunks = f"{tmp_path}/seen", tokens.text_chunks
    os.mkdir(seen)

    def spy(batch, *args):
        with open(f"{seen}/{os.getpid()}", "a") as f:
            f.write(f"{batch.nbytes if 'row' not in batch.schema.names else batch.column('row').nbytes} {batch.num_rows}\n")
        return chunks(batch, *args)

    monkeypatch.setattr(module, "text_chunks", spy)
    assert work(docs, labels) > 0
    sizes = [tuple(map(int, line.split())) for name in os.listdir(seen) for line in open(f"{seen}/{name}")]
    assert sum(n for _, n in sizes) >= 3000 and max(b for b, _ in sizes) <= MOST
    assert spark.conf.get(KEY, None) is None


def test_a_size_set_by_the_session_stays(spark):
    spark.conf.set(KEY, "3m")
    try:
        with small_batches(spark):
            assert spark.conf.get(KEY) == "3m"
        assert spark.conf.get(KEY) == "3m"
    finally:
        spark.conf.unset(KEY)
    with pytest.raises(ValueError), small_batches(spark):
        assert spark.conf.get(KEY) == "8m"
        raise ValueError
    assert spark.conf.get(KEY, None) is None


def test_weights_take_the_text_from_the_row(spark):
    rows = [(1, prose(1, 40), 5), (2, None, 6), (None, "", 7), (2, prose(2, 9), 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int")
    ratios = importance.log_ratios(importance.counts(docs, importance.np.asarray([2])))
    plan = importance.weighted(docs, ratios)._jdf.queryExecution().optimizedPlan()
    assert [plan.children().apply(0).output().apply(i).name() for i in range(plan.children().apply(0).output().size())] == ["row"]
    got = lambda d: [(r.row[0], r.n_ngrams, r.log_weight) for r in importance.weighted(d, ratios).collect()]
    want = got(docs)
    assert [n for _, n, _ in want] == [len(importance.features(importance.pa.array([t]))[0]) for _, t, _ in rows]
    assert got(docs.withColumn("text", F.col("text").cast("binary"))) == want
    assert got(docs.select("more", "doc_id", F.col("text").alias("TEXT")).select("doc_id", "TEXT")) == want


def test_state_of_a_stage_goes_in_the_next(monkeypatch):
    class Big:
        pass

    monkeypatch.setattr(tokens, "stage_id", lambda: 1)
    big = tokens.stage_state("big", Big)
    tokens.leave_stage()
    assert tokens.stage_state("big", Big) is big
    gone = weakref.ref(big)
    del big
    monkeypatch.setattr(tokens, "stage_id", lambda: 2)
    list(tokens.text_chunks(tokens.pa.RecordBatch.from_pydict({"text": ["a"]}), "text"))
    gc.collect()
    assert gone() is None
