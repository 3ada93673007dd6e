"""Property checks against brute force: percentiles vs numpy, running
totals vs a plain cumulative sum, PR/ROC AUC vs direct formulas."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from retentio.operators import metrics as met
from retentio.operators.quantiles import exact_percentiles

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e3, 1e3, allow_nan=False)),
                  min_size=1, max_size=300)


@SETTINGS
@given(values, st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_percentiles_equal_numpy(spark, vals, probs):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = exact_percentiles(df, "v", probs, names=[f"q{i}" for i in range(len(probs))], buckets=16).first()
    want = np.quantile(np.array(vals), probs)
    assert np.allclose(list(got), want, rtol=1e-9, atol=1e-9)


def _brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y != 1]
    if not pos or not neg:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def _brute_pr_auc(scores, labels):
    thresholds = sorted(set(scores), reverse=True)
    P = sum(labels)
    pts = [(0.0, 1.0)]
    for t in thresholds:
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        fp = sum(1 for s, y in zip(scores, labels) if s >= t and y != 1)
        pts.append((tp / P, tp / (tp + fp)))
    return sum((r1 - r0) * (p0 + p1) / 2 for (r0, p0), (r1, p1) in zip(pts, pts[1:]))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 20).map(lambda x: x / 20), st.integers(0, 1)), min_size=2, max_size=200))
def test_auc_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "score double, label int")
    scores, labels = [r[0] for r in rows], [r[1] for r in rows]
    want = _brute_auc(scores, labels)
    got = met.roc_auc(df, digits=9).first()[0]
    assert (got is None and want is None) or abs(got - want) < 1e-8
    if sum(labels) > 0:
        assert abs(met.pr_auc(df, digits=9).first()[0] - _brute_pr_auc(scores, labels)) < 1e-8


@SETTINGS
@given(st.lists(st.integers(0, 3), min_size=1, max_size=300))
def test_rank_based_split_sizes(spark, labels):
    from retentio.operators.sampling import stratified_split
    df = spark.createDataFrame([(str(i), y) for i, y in enumerate(labels)], "customer_id string, is_at_risk int")
    got = {r.is_at_risk: r["count"] for r in stratified_split(df).where("split = 'test'").groupBy("is_at_risk").count().collect()}
    for y in set(labels):
        n = labels.count(y)
        assert got.get(y, 0) == int(np.floor(n * 0.2 + 0.5))
    assert stratified_split(df).count() == len(labels)
