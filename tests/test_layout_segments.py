"""Bucketed layouts, text segments, one-file export, salted oversampling and folds fitted together."""

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from retentio.operators import features as feat
from retentio.operators import sampling, segments
from retentio.operators.lsa import EMBEDDING
from retentio.operators.views import customer_detail, customer_feedback
from retentio.plans.training import run_together
from retentio.sources.layout import publish_bucketed
from retentio.sources.tables import export_csv, read_table


def plan_of(df):
    return df._jdf.queryExecution().toString()


# --- layout -------------------------------------------------------------------------------------

def test_join_and_aggregates_by_key_need_no_exchange(spark):
    o = spark.range(3000).select((F.col("id") % 700).cast("string").alias("customer_id"), F.col("id").alias("order_id"),
                                 (F.col("id") % 90).cast("double").alias("order_value"),
                                 F.lit("2024-05-05").cast("timestamp").alias("order_date"))
    d = spark.range(9000).select((F.col("id") % 800).cast("string").alias("customer_id"), (F.col("id") % 3 == 0).alias("on_time"),
                                 (F.col("id") % 50).cast("double").alias("delay_hours"))

    def both(orders, delivery):
        a, b = feat.orders_aggregate(orders, as_of="2024-08-02"), feat.delivery_metrics(delivery)
        return a.join(b, "customer_id", "left")

    plain, laid = both(o, d), both(publish_bucketed(o, "customer_id", 8), publish_bucketed(d, "customer_id", 8))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" in plan_of(plain.select("*")) and "Exchange" not in plan_of(laid.select("*"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, laid.collect()))


def spoil_other_buckets(table, folder, key):
    """Overwrite every file of the table but the one that holds the key."""
    kept = {os.path.basename(r[0]) for r in table.where(F.col("customer_id") == key).select(F.input_file_name()).distinct().collect()}
    assert len(kept) == 1
    files = [x for x in os.listdir(folder) if x.endswith(".parquet")]
    for x in set(files) - kept:
        (folder / x).write_bytes(b"no parquet")
    for x in os.listdir(folder):
        if x.endswith(".crc"):
            (folder / x).unlink()
    return len(files)


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    scored = spark.range(2000).select(F.col("id").cast("string").alias("customer_id"), (F.col("id") / 2000).alias("risk_score"),
                                      F.lit("High").alias("risk_label"), F.lit(1.0).alias("recency"), F.lit(2.0).alias("avg_rating"))
    table = publish_bucketed(scored, "customer_id", 16, path=str(tmp_path / "scored"))
    want = sorted(map(tuple, customer_detail(scored, "1234").collect()))
    assert len(want) > 3 and customer_detail(table, "none").collect() == []
    assert spoil_other_buckets(table, tmp_path / "scored", "1234") > 10
    assert sorted(map(tuple, customer_detail(table, "1234").collect())) == want
    fb = spark.range(500).select((F.col("id") % 90).cast("string").alias("customer_id"), F.col("id").alias("feedback_id"),
                                 F.lit("t").alias("feedback_text"))
    laid = publish_bucketed(fb, "customer_id", 16, order_by=["feedback_id"], path=str(tmp_path / "feedback"))
    spoil_other_buckets(laid, tmp_path / "feedback", "17")
    assert [tuple(r) for r in customer_feedback(laid, "17").collect()] == [tuple(r) for r in customer_feedback(fb, "17").collect()] != []
    with pytest.raises(Exception):
        laid.count() and laid.select(F.max("feedback_id")).collect()


# --- segments -----------------------------------------------------------------------------------

def test_segments_are_the_whole_string(spark):
    r = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"c{i % 40}", i, None if i % 17 == 0 else "".join(r.choice("abé😀 ") for _ in range(r.randint(0, 30))))
            for i in range(900)]
    rows += [("nulls", 1, None), ("nulls", 2, None), ("empty", 1, ""), ("empties", 1, ""), ("empties", 2, ""), (None, 5, "x"),
             ("long", 1, "z" * 1000), ("late", -5, "first"), ("late", 3, "second")]
    fb = spark.createDataFrame(rows, "customer_id string, feedback_id long, feedback_text string").repartition(5)
    whole = {r["customer_id"]: r["feedback_text"] for r in feat.feedback_text(fb).collect()}
    for limit in (1, 7, 64):
        got = {}
        for s in segments.feedback_segments(fb, limit=limit).collect():
            assert len(s["segment_text"]) <= limit and s["start"] == s["segment"] * limit
            got.setdefault(s["customer_id"], {})[s["segment"]] = s["segment_text"]
        assert {k: "".join(v[i] for i in sorted(v)) for k, v in got.items()} == whole
        for v in got.values():  # no gap, all full but the last
            assert sorted(v) == list(range(len(v))) and all(len(v[i]) == limit for i in range(len(v) - 1))


def test_an_encoder_folds_over_segments_in_order(spark):
    class Fold:
        """Length and a hash that depends on the order."""

        def start(self):
            return 0, 7

        def step(self, state, text):
            n, h = state
            for c in text:
                n, h = n + 1, (h * 31 + ord(c)) % 65521
            return n, h

        def finish(self, state):
            return state

    fb = spark.createDataFrame([(f"c{i % 9}", i, f"text {i} " * (i % 5)) for i in range(200)],
                               "customer_id string, feedback_id long, feedback_text string")
    fold, want = Fold(), {}
    for r in feat.feedback_text(fb).collect():
        want[r["customer_id"]] = [float(x) for x in fold.step(fold.start(), r["feedback_text"])]
    got = segments.fold_texts(segments.feedback_segments(fb, limit=50), Fold)
    assert {r["customer_id"]: r[EMBEDDING] for r in got.collect()} == want
    assert segments.fold_texts(segments.feedback_segments(fb.where("false")), Fold).collect() == []


# --- one file -----------------------------------------------------------------------------------

def test_one_file_in_order_with_one_header(spark, tmp_path):
    rows = [(f"{i:04d}", i / 3, 'say "hi", ok\nnext' if i % 5 == 0 else None if i % 7 == 0 else f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "customer_id string, `risk, score` double, note string").repartition(6)
    path = str(tmp_path / "out.csv")
    export_csv(df, path)
    assert os.path.isfile(path) and sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["out.csv"]
    back = read_table(spark, path, infer_types=False, row_id="place")
    assert back.columns[:3] == ["customer_id", "risk, score", "note"]
    got = [(r[0], float(r[1]), r[2]) for r in back.orderBy("place").collect()]
    assert got == sorted(rows)
    export_csv(df.limit(0), path)  # over the old one
    assert read_table(spark, path, infer_types=False).count() == 0


def test_a_failed_export_leaves_the_old_file(spark, tmp_path):
    path = tmp_path / "out.csv"
    path.write_text("old")
    bad = spark.range(10).select(F.col("id").cast("string").alias("customer_id"), F.expr("raise_error('no')").cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        export_csv(bad, str(path))
    assert path.read_text() == "old" and sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["out.csv"]
    with pytest.raises(ValueError):
        export_csv(spark.range(1).select(F.array("id").alias("customer_id")), str(path))


# --- oversampling and folds ---------------------------------------------------------------------

def test_a_class_of_one_row_is_drawn_through_many_keys(spark, monkeypatch):
    df = spark.range(600).select(F.col("id").cast("string").alias("customer_id"),
                                 F.when(F.col("id") == 5, 1).when(F.col("id") < 20, 2).when(F.col("id") == 30, None).otherwise(0).alias("is_at_risk"))
    want = sorted(map(tuple, sampling.oversample(df).collect()), key=repr)
    monkeypatch.setattr(sampling, "DRAWS_PER_COPY", 10)
    keys = []
    real = sampling.null_safe_join
    monkeypatch.setattr(sampling, "null_safe_join", lambda a, b, on, *r: (keys.append((b, on)), real(a, b, on, *r))[1])
    got = sampling.oversample(df)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == 4 * max(
        r["count"] for r in df.groupBy("is_at_risk").count().collect())
    draws, on = keys[-1]
    assert on == ["is_at_risk", "_rk", "_salt"]
    assert draws.groupBy(*on).count().agg({"count": "max"}).first()[0] <= 30


def test_tasks_run_together_and_the_first_failure_ends_all(spark):
    at_once, most, lock = [0], [0], threading.Lock()

    def task(k):
        with lock:
            at_once[0] += 1
            most[0] = max(most[0], at_once[0])
        n = spark.range(1000 + k).count()
        time.sleep(0.3)
        with lock:
            at_once[0] -= 1
        return n, spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    out = run_together(spark, [lambda k=k: task(k) for k in range(4)], 4)
    assert [n for n, _ in out] == [1000, 1001, 1002, 1003] and len({p for _, p in out}) == 4 and most[0] > 1

    def fails():
        time.sleep(0.5)
        raise ValueError("fold")

    def endless():
        while True:
            spark.range(50_000_000).selectExpr("sum(sin(id))").collect()

    t0 = time.time()
    with pytest.raises(ValueError, match="fold"):
        run_together(spark, [endless, fails, endless], 3)
    assert time.time() - t0 < 60 and spark.range(3).count() == 3


def test_folds_fitted_together_score_as_in_sequence(spark):
    from retentio.operators.model import ModelOptions
    from retentio.plans.training import train
    r = random.Random(6)
    df = spark.createDataFrame([(f"c{i}", r.random() + (i % 4 == 0), r.random(), int(i % 4 == 0)) for i in range(160)],
                               "customer_id string, recency double, frequency double, is_at_risk int")
    got = []
    for width in (1, 3):
        opts = ModelOptions(n_estimators=4, max_depth=3, cv=True, folds=3, parallel_folds=width)
        _, metrics = train(df, ["recency", "frequency"], opts)
        got.append(sorted(map(tuple, metrics["cv_scores"].collect())))
    assert got[0] == got[1] and len(got[0]) == 160


def test_the_final_fit_runs_beside_the_folds(spark, monkeypatch):
    from retentio.operators.model import ModelOptions
    from retentio.plans import training
    calls, together = [], training.run_together
    monkeypatch.setattr(training, "run_together", lambda s, tasks, width: calls.append((len(tasks), width)) or together(s, tasks, width))
    df = spark.createDataFrame([(f"c{i}", float(i % 9), int(i % 4 == 0)) for i in range(60)], "customer_id string, recency double, is_at_risk int")
    model, metrics = training.train(df, ["recency"], ModelOptions(n_estimators=2, max_depth=2, cv=True, folds=3, parallel_folds=3))
    assert calls == [(4, 4)] and model.stages and metrics["cv_scores"].count() == 60


def test_statistics_of_an_executors_tasks_fit_its_memory():
    from retentio.operators.model import ModelOptions
    assert 4 * ModelOptions().max_memory_mb <= 1024
