"""Percentiles by narrowing equal those over all values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import selection
from retentio.operators.quantiles import exact_percentiles

PROBS = [0.0, 0.013, 0.25, 0.5, 0.9, 0.9999, 1.0]
NAMES = [f"q{i}" for i in range(len(PROBS))]


def values(kind, n, r):
    return {"ties": lambda: [float(r.choice([1, 1, 1, 2, 7])) for _ in range(n)],
            "one": lambda: [4.25] * n,
            "wide": lambda: [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(n)],
            "hot": lambda: [3.5 if r.random() < 0.6 else r.gauss(3.5, 1e-9) for _ in range(n)],
            "uniform": lambda: [r.random() for _ in range(n)]}[kind]()


def brute(v, p):
    v = sorted(v)
    at = p * (len(v) - 1)
    lo = math.floor(at)
    hi = min(lo + 1, len(v) - 1)
    return v[lo] + (at - lo) * (v[hi] - v[lo])


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (
        a == b or math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-14)))


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(3)
    rows = [(g, v) for g, n in (("ties", 900), ("one", 300), ("wide", 1500), ("hot", 2000), ("uniform", 40), (None, 700))
            for v in values(g or "uniform", n, r)]
    rows += [("ties", None), ("none", None), ("single", 1.5), ("hot", float("nan")), ("hot", float("inf")), ("hot", -0.0)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(6).persist()


def test_groups(spark, table, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 8)
    rows, df = table
    got = {r["g"]: r for r in selection.narrowed_percentiles(df, "v", PROBS, ["g"], NAMES, exact_rows=20, bins=8).collect()}
    old = {r["g"]: r for r in exact_percentiles(df, "v", PROBS, by=["g"], names=NAMES).collect()}
    assert set(got) == {g for g, v in rows if v is not None} == set(old)
    for g, row in got.items():
        own = [v for x, v in rows if x == g and v is not None]
        for p, n in zip(PROBS, NAMES):
            assert same(row[n], old[g][n]), (g, n, row[n], old[g][n])
            if not any(math.isnan(v) or math.isinf(v) for v in own):
                assert same(row[n], brute(own, p)), (g, n)


@pytest.mark.parametrize("ranges", [0, 50_000])
def test_without_groups_and_without_broadcast(spark, monkeypatch, ranges):
    monkeypatch.setattr(selection, "BROADCAST_RANGES", ranges)
    v = np.random.default_rng(1).normal(size=5000)
    df = spark.createDataFrame([(float(x), i % 2) for i, x in enumerate(v)], "v double, b int")
    got = exact_percentiles(df, "v", [0.1, 0.5], narrowing=True, names=["a", "b"], exact_rows=50).collect()
    assert len(got) == 1 and np.allclose(list(got[0]), np.quantile(v, [0.1, 0.5]), rtol=0, atol=1e-15)
    by = {r["b"]: r["m"] for r in exact_percentiles(df, "v", [0.5], by=["b"], names=["m"], narrowing=True, exact_rows=50).collect()}
    assert all(math.isclose(by[k], float(np.median(v[k::2])), rel_tol=1e-14) for k in (0, 1))
    none = exact_percentiles(df.where(F.lit(False)), "v", [0.5], narrowing=True, names=["m"]).collect()
    assert [r["m"] for r in none] == [None]


def test_what_is_shuffled_does_not_grow_with_the_values(spark):
    """Only the sketch, bin counts and ranges of at most ``exact_rows`` rows meet in an exchange."""
    seen = {}
    for n in (20_000, 80_000):
        path_rows = []
        real = selection._with_ranges

        def spy(values, ranges, by, count):
            out = real(values, ranges, by, count)
            path_rows.append(out)
            return out
        selection._with_ranges = spy
        try:
            exact_percentiles(spark.range(n).select(F.rand(5).alias("v")), "v", [0.5], narrowing=True, names=["m"], exact_rows=500).collect()
        finally:
            selection._with_ranges = real
        seen[n] = path_rows[-1].count()  # what is ranked in the end
    assert max(seen.values()) <= 2 * 500
