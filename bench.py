"""Benchmark the headline jobs at one scale factor; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_RUNS (timed runs per query, median reported; default 3).
Every query is fully executed with the no-op sink (nothing collected).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from retentio.functions.columns import AS_OF_DEFAULT  # noqa: E402
from retentio.operators import features as feat  # noqa: E402
from retentio.operators.model import ModelOptions  # noqa: E402
from retentio.operators.views import orders_trend, top_interventions  # noqa: E402
from retentio.plans import catalog  # noqa: E402
from retentio.plans.scoring import publish_scored  # noqa: E402
from retentio.session import get_spark  # noqa: E402
from retentio.sources import driver  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark(f"local[{cpus}]", app_name="retentio-bench", shuffle_partitions=cpus * 2,
                      extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    state = {}

    def tabular():
        run(catalog.features_wide(spark, sf_dir))

    def feedback():
        fb = driver.feedback(spark, sf_dir)
        run(feat.feedback_text(fb))
        run(feat.rating_metrics(fb))

    def train():
        model, meta, metrics = catalog.train_model(spark, sf_dir, ModelOptions(n_estimators=200, max_depth=10))
        run(metrics["roc_auc"])
        state["model"] = (model, meta)

    def score():
        model, meta = state["model"]
        scored = catalog.score_all(spark, sf_dir, model, meta)
        state["scored"] = publish_scored(scored, f"{state['tmp']}/scored-{time.time_ns()}")

    def top20():
        run(top_interventions(state["scored"], 20))

    def trend():
        run(orders_trend(driver.orders(spark, sf_dir)))

    from retentio.session import scratch_dir
    state["tmp"] = scratch_dir(spark, "bench")
    # warm-up: JVM, Python workers, parquet footers
    run(feat.orders_aggregate(driver.orders(spark, sf_dir), as_of=AS_OF_DEFAULT).where(F.lit(True)))

    def query(name):
        return lambda: run(catalog.QUERIES[name](spark, sf_dir))

    plan = [("tabular_features", tabular), ("feedback_text_ratings", feedback),
            ("train_rf200_depth10", train), ("score_all_customers", score),
            ("top20_interventions", top20), ("orders_trend", trend),
            ("csv_scan", query("csv_scan")), ("monetary_box", query("monetary_box")),
            ("stratified_split", query("stratified_split")), ("oversample", query("oversample")),
            ("cv_folds_together", query("cross_validated_facts"))]
    times = {}
    for name, fn in plan:
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    total = round(sum(times.values()), 3)
    sf_name = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf_name)
    except ValueError:
        sf = sf_name
    print(json.dumps({"metric": "headline_jobs_total", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "runs": runs,
                      "shuffle_partitions": cpus * 2}))


if __name__ == "__main__":
    main()
