"""Sampled range splitters and numbering over awkward keys."""

import datetime

import pytest
from pyspark.sql import functions as F

from retentio.operators.features import unkeyed_orders
from retentio.operators.ranking import range_bucket

N = 4000


def keys(spark, kind):
    i = F.col("id")
    col = {"prefix": F.concat(F.lit("ORDER-2024-EU-000000"), F.lpad(i.cast("string"), 9, "0")),
           "hot": F.when(i % 2 == 0, F.lit("same")).otherwise(F.concat(F.lit("k"), i.cast("string"))),
           "nulls": F.when(i % 3 == 0, None).otherwise(F.concat(F.lit("é"), i.cast("string"))),
           "binary": F.concat(F.lit("x"), i.cast("string")).cast("binary"),
           "date": F.date_add(F.lit(datetime.date(2024, 1, 1)), (i % 40).cast("int")),
           "double": F.when(i % 100 == 0, F.lit(float("nan"))).otherwise(F.exp(i % 700) * F.when(i % 2 == 0, 1).otherwise(-1)),
           "boolean": i % 2 == 0, "decimal": (i * i).cast("decimal(20,3)")}[kind]
    return spark.range(N).select(col.alias("k"), (i * 7 % 1000).cast("double").alias("order_value"), i.alias("other"))


@pytest.mark.parametrize("kind", ["prefix", "hot", "nulls", "binary", "date", "double", "boolean", "decimal"])
def test_buckets_keep_the_order_and_are_of_like_size(spark, kind):
    b = range_bucket(keys(spark, kind).repartition(4), ["k"], buckets=16, sample_per_bucket=32).select(
        "_b", F.struct("k", "_tie").alias("place"))
    per = b.groupBy("_b").agg(F.count("*").alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi")).orderBy("_b")
    rows = per.collect()
    assert sum(r["n"] for r in rows) == N and 12 <= len(rows) <= 17
    assert max(r["n"] for r in rows) < 2.5 * N / 16
    meets = per.alias("a").join(per.alias("b"), F.col("a._b") < F.col("b._b")).where("a.hi >= b.lo")
    assert meets.count() == 0


def test_numbers_follow_text_keys(spark):
    o = keys(spark, "prefix").repartition(5)
    got = {r["k"]: r["customer_id"] for r in unkeyed_orders(o, "k").select("k", "customer_id").collect()}
    assert got == {k: str(i + 1) for i, k in enumerate(sorted(got))} and len(got) == N


def test_numbers_over_ties_and_nulls_are_whole_and_repeatable(spark):
    o = keys(spark, "nulls").unionByName(keys(spark, "nulls").limit(5))
    one, two = ({(r["customer_id"], r["k"], r["other"]) for r in unkeyed_orders(x, "k").collect()} for x in (o, o.repartition(3)))
    assert one == two and sorted(int(c) for c, _, _ in one) == list(range(1, N + 6))
    by_number = [k for _, k in sorted((int(c), k) for c, k, _ in one)]
    assert by_number == sorted(by_number, key=lambda k: (k is not None, k or ""))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    assert sorted(r["customer_id"] for r in unkeyed_orders(keys(spark, "prefix").limit(n), "k").collect()) == [str(i + 1) for i in range(n)]
