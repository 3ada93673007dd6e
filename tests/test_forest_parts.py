"""A forest that is fitted some trees at a time: what the driver holds, its scores and its artifact."""

import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import functions as F

from retentio.operators import model as mod
from retentio.operators.metrics import roc_auc

COLS = ["recency", "monetary"]


def _rows(spark, n=400):
    """Keys that repeat and are null, labels that need many nodes."""
    return spark.range(n).select(
        F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise((F.col("id") % 390).cast("string")).alias("customer_id"),
        (F.col("id") * 37 % 101).cast("double").alias("recency"), (F.col("id") * 61 % 89).cast("double").alias("monetary"),
        F.when(F.col("id") * 37 % 101 + F.col("id") * 61 % 89 % 7 > 60, 1).otherwise(0).alias("is_at_risk"))


def _fitted(spark, monkeypatch, nodes=900, **options):
    monkeypatch.setattr(mod, "NODES_AT_ONCE", nodes)
    held, plain = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: held.append(self.getNumTrees()) or plain(self, rows))
    return mod.fit(_rows(spark), COLS, mod.ModelOptions(**({"n_estimators": 9} | options))), held


def test_the_driver_holds_some_trees_at_a_time(spark, monkeypatch):
    model, held = _fitted(spark, monkeypatch)
    assert held == [3, 3, 3]
    parts = [RandomForestClassificationModel.load(p) for p in model.paths]
    assert [p.getNumTrees for p in parts] == held
    # other draws in each part
    assert len({t.toDebugString.split("\n", 1)[1] for p in parts for t in p.trees}) == 9


def test_trees_that_fit_are_fitted_together(spark, monkeypatch):
    _, held = _fitted(spark, monkeypatch, nodes=1_000_000)
    assert held == [9]
    _, held = _fitted(spark, monkeypatch, nodes=9 * 16, max_depth=3)
    assert held == [9]


@pytest.mark.parametrize("trees, nodes, sizes", [(5, 1, [3, 2]), (1, 1, [1]), (2, 1, [2]), (200, 9_000, [40] * 5), (200, 43_000, None)])
def test_no_part_of_one_tree(spark, trees, nodes, sizes, monkeypatch):
    # one tree alone would be grown on all features
    monkeypatch.setattr(mod, "NODES_AT_ONCE", nodes)
    df = spark.range(1000).select((F.col("id") % 7 == 0).cast("double").alias("y"))
    assert mod.trees_at_once(df, "y", mod.ModelOptions(n_estimators=trees)) == sizes


def test_fits_that_run_together_share_the_room(spark, monkeypatch):
    monkeypatch.setattr(mod, "NODES_AT_ONCE", 43_000)
    df = spark.range(1000).select((F.col("id") % 7 == 0).cast("double").alias("y"))
    # each forest has room, all six have not: they are fitted in turn, the same trees
    assert [mod.trees_at_once(df, "y", mod.ModelOptions(n_estimators=200), n) for n in (1, 6)] == [None, [200]]


def test_a_forest_in_one_written_part_is_the_same(spark, monkeypatch):
    got = []
    for beside, nodes in ((1, 1_000_000), (6, 3_000)):
        monkeypatch.setattr(mod, "NODES_AT_ONCE", nodes)
        m = mod.fit(_rows(spark), COLS, mod.ModelOptions(n_estimators=6), beside=beside)
        assert isinstance(m, mod.ForestParts) == (beside > 1)
        got.append(sorted(str(tuple(r)) for r in mod.predict(m, _rows(spark), COLS, prediction_col="guess").collect()))
    assert got[0] == got[1]


def test_parts_score_as_all_trees(spark, monkeypatch):
    model, _ = _fitted(spark, monkeypatch)
    df = _rows(spark)
    got = mod.predict(model, df, COLS, prediction_col="guess")
    assert got.columns == [*df.columns, "risk_score", "guess"]
    # every row once, also those of repeated and null keys
    assert sorted(map(str, got.drop("risk_score", "guess").collect())) == sorted(map(str, df.collect()))
    ready = model.head.transform(mod.fill_features(df, COLS)).select("recency", "monetary", "_scaled").collect()
    trees = [t for p in model.paths for t in RandomForestClassificationModel.load(p).trees]
    want = {(r.recency, r.monetary): sum(t.predictProbability(r._scaled)[1] for t in trees) / len(trees) for r in ready[:40]}
    for r in got.collect():
        assert r.guess == int(r.risk_score > 0.5)
        if (r.recency, r.monetary) in want:
            assert r.risk_score == pytest.approx(want[r.recency, r.monetary], abs=1e-12)
    assert roc_auc(got, "is_at_risk", "risk_score").first()[0] > 0.9


def test_parts_are_saved_and_reloaded(spark, monkeypatch, tmp_path):
    model, _ = _fitted(spark, monkeypatch)
    path = f"{tmp_path}/model"
    mod.save_model(model, mod.ModelMeta(COLS, None), path)
    loaded, meta = mod.load_model(spark, path)
    assert meta.forest_parts == 3 and all(p.startswith(path) for p in loaded.paths)
    a, b = (sorted((str(tuple(r)) for r in mod.predict(m, _rows(spark), COLS).collect())) for m in (model, loaded))
    assert a == b
    # a smaller forest in the same folder does not take up the old parts
    small, _ = _fitted(spark, monkeypatch, nodes=1_000_000, n_estimators=2)
    mod.save_model(small, mod.ModelMeta(COLS, None), path)
    again, meta = mod.load_model(spark, path)
    assert meta.forest_parts == 0 and again.stages[-1].getNumTrees == 2


def test_cross_validation_in_parts_does_not_depend_on_what_runs_at_a_time(spark, monkeypatch):
    from retentio.plans.training import train
    monkeypatch.setattr(mod, "NODES_AT_ONCE", 1_000)
    df = _rows(spark).withColumn("customer_id", F.monotonically_increasing_id().cast("string"))
    got = []
    for width in (1, 3):
        model, metrics = train(df, COLS, mod.ModelOptions(n_estimators=6, cv=True, folds=2, parallel_folds=width))
        assert len(model.paths) > 1
        got.append(sorted(map(tuple, metrics["cv_scores"].collect())))
    assert got[0] == got[1] and len(got[0]) == 400
