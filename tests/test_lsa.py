"""The fitted text encoder against NumPy on whole small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from retentio.operators import lsa
from retentio.operators.text import feedback_embeddings

WORDS = "good bad late früh schön delivery box été broken great again never 42 über".split()


def table(n=90, seed=4):
    r = random.Random(seed)
    rows = [(f"c{i % 17}", " ".join(r.choice(WORDS[:4 + i % 11]) for _ in range(r.randint(1, 12))) + r.choice([".", "!", " "]), i)
            for i in range(n)]
    return rows + [("c1", None, 900), ("c2", "", 901), ("null", None, 902), ("dots", "... !", 903), (None, "good", 904)]


def brute(rows, buckets):
    def terms(t):
        return [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) % buckets
                for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    x = np.array([np.bincount(terms(t), minlength=buckets) for k, t, _ in rows if k is not None], float)
    n = (x.sum(1) > 0).sum()
    df = (x > 0).sum(0)
    return [k for k, _, _ in rows if k is not None], x, df, np.log((n + 1) / (df + 1))


@pytest.fixture(scope="module")
def feedback(spark):
    return spark.createDataFrame(table(), "customer_id string, feedback_text string, feedback_id long").repartition(5)


def test_document_frequencies(spark, feedback):
    _, _, df, idf = brute(table(), 64)
    got = {r["bucket"]: (r["df"], r["idf"]) for r in
           lsa.inverse_document_frequencies(lsa.feedback_terms(feedback, 64), 64).collect()}
    assert len(got) == 64 and all(got[b][0] == df[b] and math.isclose(got[b][1], idf[b], abs_tol=1e-12) for b in range(64))


def test_directions_are_the_right_singular_vectors(spark, feedback):
    _, x, _, idf = brute(table(), 64)
    w = x * idf
    length = np.linalg.norm(w, axis=1)
    unit = w[length > 0] / length[length > 0, None]
    _, s, vt = np.linalg.svd(unit, full_matrices=False)
    enc = lsa.TextSvd.fit(feedback, 6, 64)
    assert enc.name == "svd-6" and np.allclose(enc.singular_values, s[:6], atol=1e-8)
    v = np.asarray(enc.directions)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-8)
    # the best approximation of rank 6, and the same span
    assert np.isclose(np.linalg.norm(unit - unit @ v @ v.T) ** 2, (s[6:] ** 2).sum(), atol=1e-8)
    assert np.allclose(v @ v.T, vt[:6].T @ vt[:6], atol=1e-6)


def test_vectors_are_projections_of_a_customers_whole_text(spark, feedback):
    keys, x, _, idf = brute(table(), 64)
    enc = lsa.TextSvd.fit(feedback, 6, 64)
    got = {r["customer_id"]: np.array(r["emb_vector"]) for r in feedback_embeddings(feedback, enc).collect()}
    assert set(got) == set(keys)
    for k in set(keys):
        want = (x[[j for j, o in enumerate(keys) if o == k]].sum(0) * idf) @ np.asarray(enc.directions)
        n = np.linalg.norm(want)
        assert np.allclose(got[k], want / n if n > 0 else want, atol=1e-5), k
    assert not got["null"].any() and not got["dots"].any()
    norms = {r["customer_id"]: r for r in lsa.weighted_norms(feedback, 64).collect()}
    for k in set(keys):
        own = x[[j for j, o in enumerate(keys) if o == k]].sum(0)
        assert norms[k]["n_terms"] == own.sum() and math.isclose(norms[k]["norm"], np.linalg.norm(own * idf), abs_tol=1e-9)


def test_a_saved_encoder_gives_the_same_vectors(spark, feedback):
    import json
    enc = lsa.TextSvd.fit(feedback, 4, 32)
    again = lsa.TextSvd.from_dict(json.loads(json.dumps(enc.to_dict())))
    rows = lambda e: sorted((r["customer_id"], r["emb_vector"]) for r in e.encode(feedback).collect())
    one, two = rows(enc), rows(again)
    assert [k for k, _ in one] == [k for k, _ in two] and np.allclose([v for _, v in one], [v for _, v in two], atol=1e-6)


def test_more_directions_than_rank_and_no_text(spark):
    few = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", "three")], "customer_id string, feedback_text string")
    enc = lsa.TextSvd.fit(few, 8, 16)
    assert enc.dim == 8 and sum(v > 1e-6 for v in enc.singular_values) <= 2
    none = spark.createDataFrame([("a", None), ("b", "")], "customer_id string, feedback_text string")
    enc = lsa.TextSvd.fit(none, 3, 16)
    assert sorted((r["customer_id"], r["emb_vector"]) for r in enc.encode(none).collect()) == [("a", [0.0] * 3), ("b", [0.0] * 3)]
    assert lsa.TextSvd.fit(spark.createDataFrame([(1,)], "x int"), 3) is None
    assert lsa.TextSvd.fit(none.where("false"), 3, 16).encode(none.where("false")).count() == 0


def test_training_and_scoring_carry_the_fitted_encoder(spark, tmp_path):
    from retentio.operators.model import ModelOptions, load_model
    from retentio.plans import training
    from retentio.plans.scoring import scored_customers
    r = random.Random(1)
    fb = spark.createDataFrame([(f"c{i}", "late broken bad" if i % 4 == 0 else r.choice(["great box", "good delivery again"]), i,
                                 1.0 if i % 4 == 0 else 5.0) for i in range(80)],
                               "customer_id string, feedback_text string, feedback_id long, rating double")
    orders = spark.createDataFrame([(i, f"c{i}", float(i % 7), f"2001-07-2{i % 8}") for i in range(80)],
                                   "order_id long, customer_id string, order_value double, order_date string")
    path = str(tmp_path / "model")
    training.run(spark, orders, None, fb, path, ModelOptions(n_estimators=5, max_depth=4), as_of="2001-08-02", encoder="svd-4")
    _, meta = load_model(spark, path)
    assert meta.embedder_name == "svd-4" and meta.embedding_dim == 4 and len(meta.embedder_state["idf"]) == lsa.BUCKETS
    scored = scored_customers(spark, orders, None, fb, path, as_of="2001-08-02")
    by = {x["customer_id"]: x["risk_score"] for x in scored.select("customer_id", "risk_score").collect()}
    assert len(by) == 80 and min(by[f"c{i}"] for i in range(0, 80, 4)) > max(by[f"c{i}"] for i in range(1, 80, 4))


def test_terms_are_hashed_once_a_batch(monkeypatch):
    """A term that comes up often is hashed once; empty strings are no terms."""
    import pyarrow as pa
    hashed, md5 = [], hashlib.md5
    monkeypatch.setattr(lsa.hashlib, "md5", lambda t: hashed.append(t) or md5(t))
    got = lsa.term_buckets(pa.array([["x", "a", "", "a"], [""], [], ["b", "a"] * 50]).slice(1), 64).to_pylist()
    own = [int(md5(t).hexdigest()[:15], 16) % 64 for t in (b"b", b"a")]
    assert got == [[], [], own * 50] and sorted(hashed) == [b"a", b"b"]


def test_document_frequencies_read_the_feedback_once(spark, tmp_path, capsys):
    spark.createDataFrame(table(), "customer_id string, feedback_text string, feedback_id long").write.parquet(f"{tmp_path}/f")
    lsa.inverse_document_frequencies(lsa.feedback_terms(spark.read.parquet(f"{tmp_path}/f"))).explain()
    assert capsys.readouterr().out.count("FileScan") == 1
