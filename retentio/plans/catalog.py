"""The query catalogue: one Spark query per operator over the driver tables,
with the matching DuckDB SQL in ``ORACLE`` (absent for model-dependent
queries, which get a rows-only check).  Each query takes (spark, sf_dir)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.functions.columns import AS_OF_DEFAULT, exact_mean, unparsable_dates
from retentio.operators import features as feat
from retentio.operators import label as lab
from retentio.operators import lsa
from retentio.operators import metrics as met
from retentio.operators import sampling as smp
from retentio.operators import segments
from retentio.operators import text as txt
from retentio.operators import views as vw
from retentio.operators.model import ModelOptions, align_features, fill_features, load_model, median_imputer, save_model
from retentio.operators.quantiles import exact_percentiles
from retentio.operators.risk import SCORE, score_customers, score_with, with_suggestion
from retentio.plans import oracle as sql
from retentio.session import SESSION_DEFAULTS, scratch_dir
from retentio.sources import driver
from retentio.sources.layout import publish_bucketed
from retentio.sources.tables import export_csv, preview, read_table, write_predictions

AS_OF = AS_OF_DEFAULT
KEY = "customer_id"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a catalogue query; the session gets the library defaults
    (UTC above all: day arithmetic and truncation depend on it)."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for k, v in SESSION_DEFAULTS.items():
                spark.conf.set(k, v)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- shared inputs

def features_wide(spark, d) -> DataFrame:
    return feat.tabular_features(driver.orders(spark, d), driver.delivery(spark, d), as_of=AS_OF, wide=True,
                                 materialize=True)


def features(spark, d) -> DataFrame:
    return feat.tabular_features(driver.orders(spark, d), driver.delivery(spark, d), as_of=AS_OF, materialize=True)


def target(spark, d) -> DataFrame:
    return lab.create_target(features(spark, d), driver.feedback(spark, d))


def pseudo_scored(spark, d) -> DataFrame:
    """Scored customers (D-3 shape) with the deterministic stand-in score."""
    return score_with(features_wide(spark, d), driver.pseudo_score(KEY), driver.feedback(spark, d))


def filtered(spark, d) -> DataFrame:
    return vw.filter_customers(pseudo_scored(spark, d))


SCORED_COLS = ["customer_id", "recency", "frequency", "monetary", "on_time_rate", "avg_delay_hours",
               "num_orders_90d", "avg_order_value", "days_since_last_order", "risk_score", "risk_label",
               "avg_rating", "negative_feedback_count"]

# ---------------------------------------------------------------- sources (S1, S4, S5)


@query("csv_scan", sql.with_(sql.ORDERS) + "SELECT * FROM o")
def q_csv_scan(spark, d):
    path = scratch_dir(spark, "orders-csv")
    o = driver.orders(spark, d)
    o.write.mode("overwrite").option("header", "true").option("escape", '"') \
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    back = read_table(spark, path, fmt="csv")
    from retentio.functions.columns import parse_date
    return back.select(KEY, "order_id", "order_value", parse_date("order_date").alias("order_date"))


SPLIT_CSV_SQL = """SELECT doc_id, lang, source,
       CASE WHEN text NOT IN ('', 'NA', 'NULL', 'null', 'nan', 'NaN', 'None', 'N/A', 'n/a')
            THEN regexp_replace(text, '\\r\\n?', chr(10), 'g') END AS text
FROM documents"""


@query("csv_scan_split", SPLIT_CSV_SQL)
def q_csv_scan_split(spark, d):
    """One quoted CSV file with all texts, line feeds inside fields included, read in byte ranges."""
    path = scratch_dir(spark, "documents-csv")
    docs = driver.table(spark, d, "documents")
    docs = docs.select("doc_id", F.regexp_replace("text", r"\r\n?", "\n").alias("text"), "lang", "source")
    export_csv(docs, f"{path}/all.csv", order_by=["doc_id"])
    return read_table(spark, path, fmt="csv", key=None, split_bytes=0).select("doc_id", "lang", "source", "text")


@query("raw_preview", sql.with_(sql.ORDERS) + "SELECT * FROM o ORDER BY order_id LIMIT 200")
def q_raw_preview(spark, d):
    return preview(driver.orders(spark, d), "order_id", 200)


@query("raw_preview_feedback", sql.with_(sql.FEEDBACK) + "SELECT * FROM f ORDER BY feedback_id LIMIT 200")
def q_raw_preview_feedback(spark, d):
    return preview(driver.feedback(spark, d), "feedback_id", 200)


@query("raw_preview_delivery", sql.with_(sql.DELIVERY) + "SELECT * FROM d ORDER BY order_id, line_number LIMIT 200")
def q_raw_preview_delivery(spark, d):
    return preview(driver.delivery(spark, d), ["order_id", "line_number"], 200)


@query("predictions_export", sql.FULL_SCORED + f"SELECT {', '.join(SCORED_COLS)} FROM sc")
def q_predictions_export(spark, d):
    path = scratch_dir(spark, "predictions")
    write_predictions(pseudo_scored(spark, d).select(*SCORED_COLS), path)
    back = read_table(spark, path, fmt="csv")
    return back.select(*SCORED_COLS)


@query("predictions_one_file", sql.FULL_SCORED + f"SELECT {', '.join(SCORED_COLS)} FROM sc")
def q_predictions_one_file(spark, d):
    path = f"{scratch_dir(spark, 'predictions')}/predictions.csv"
    export_csv(pseudo_scored(spark, d).select(*SCORED_COLS), path)
    return read_table(spark, path, fmt="csv").select(*SCORED_COLS)


# ---------------------------------------------------------------- orders / delivery / feedback aggregates

ORDERS_RFM_COLS = "customer_id, recency, frequency, monetary, num_orders_90d, avg_order_value, days_since_last_order"


@query("orders_rfm", sql.with_(sql.ORDERS, sql.AGG) + f"""
SELECT customer_id, coalesce(days_since_last_order, 999) AS recency, coalesce(num_orders_90d, 0) AS frequency,
       coalesce(avg_order_value, (SELECT median(avg_order_value) FROM agg)) AS monetary,
       num_orders_90d, avg_order_value, days_since_last_order FROM agg""")
def q_orders_rfm(spark, d):
    f = feat.tabular_features(driver.orders(spark, d), None, as_of=AS_OF, wide=True)
    return f.select(*[c.strip() for c in ORDERS_RFM_COLS.split(",")])


@query("orders_rfm_no_order_id", sql.with_(sql.ORDERS) + f"""
SELECT customer_id, CAST(count(order_date) AS BIGINT) AS num_orders_90d,
       {sql.mean('order_value')} AS avg_order_value, {sql.DAYS_SINCE} AS days_since_last_order
FROM o WHERE customer_id IS NOT NULL GROUP BY customer_id""")
def q_orders_rfm_no_order_id(spark, d):
    return feat.orders_aggregate(driver.orders(spark, d).drop("order_id"), as_of=AS_OF)


@query("orders_strict_dates", sql.with_(sql.ORDERS, sql.AGG) + "SELECT * FROM agg")
def q_orders_strict_dates(spark, d):
    """Dates given as text, of which none may fail to parse."""
    o = driver.orders(spark, d)
    text = o.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))
    return feat.orders_aggregate(text, as_of=AS_OF, strict_dates=True)


@query("orders_rfm_no_value", sql.with_(sql.ORDERS) + f"""
SELECT customer_id, CAST(count(order_id) AS BIGINT) AS num_orders_90d,
       CAST(count(order_id) AS DOUBLE) AS avg_order_value, {sql.DAYS_SINCE} AS days_since_last_order
FROM o WHERE customer_id IS NOT NULL GROUP BY customer_id""")
def q_orders_rfm_no_value(spark, d):
    import warnings
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return feat.orders_aggregate(driver.orders(spark, d).drop("order_value"), as_of=AS_OF)


@query("unkeyed_orders", sql.with_(sql.ORDERS) + """, h AS (SELECT order_id, order_value, order_date FROM o)
SELECT order_id, order_value, order_date,
       CAST(row_number() OVER (ORDER BY order_id) AS VARCHAR) AS customer_id,
       CAST(1 AS BIGINT) AS num_orders_90d, CAST(order_value AS DOUBLE) AS avg_order_value,
       CAST(30 AS BIGINT) AS days_since_last_order FROM h""")
def q_unkeyed_orders(spark, d):
    return feat.unkeyed_orders(driver.orders(spark, d).drop(KEY), order_key="order_id")


@query("unkeyed_orders_text", sql.with_(sql.ORDERS) + """, h AS (
  SELECT 'ORD-' || lpad(CAST(order_id AS VARCHAR), 12, '0') AS code, order_value, order_date FROM o)
SELECT code, order_value, order_date, CAST(row_number() OVER (ORDER BY code) AS VARCHAR) AS customer_id,
       CAST(1 AS BIGINT) AS num_orders_90d, CAST(order_value AS DOUBLE) AS avg_order_value,
       CAST(30 AS BIGINT) AS days_since_last_order FROM h""")
def q_unkeyed_orders_text(spark, d):
    code = F.concat(F.lit("ORD-"), F.lpad(F.col("order_id").cast("string"), 12, "0"))
    return feat.unkeyed_orders(driver.orders(spark, d).select(code.alias("code"), "order_value", "order_date"), order_key="code")


@query("delivery_metrics", sql.with_(sql.DELIVERY, sql.DM) + "SELECT * FROM dm")
def q_delivery_metrics(spark, d):
    return feat.delivery_metrics(driver.delivery(spark, d))


@query("delivery_delay_only", sql.with_(sql.DELIVERY) + f"""
SELECT customer_id, {sql.mean('CASE WHEN delay_hours = 0 THEN 1 ELSE 0 END')} AS on_time_rate,
       {sql.mean('delay_hours')} AS avg_delay_hours FROM d WHERE customer_id IS NOT NULL GROUP BY customer_id""")
def q_delivery_delay_only(spark, d):
    return feat.delivery_metrics(driver.delivery(spark, d).drop("on_time"))


@query("delivery_on_time_only", sql.with_(sql.DELIVERY) + f"""
SELECT customer_id, {sql.mean('CAST(on_time AS INTEGER)')} AS on_time_rate, CAST(0.0 AS DOUBLE) AS avg_delay_hours
FROM d WHERE customer_id IS NOT NULL GROUP BY customer_id""")
def q_delivery_on_time_only(spark, d):
    return feat.delivery_metrics(driver.delivery(spark, d).drop("delay_hours"))


@query("tabular_features", sql.with_(sql.FEATURE_CTES) +
       "SELECT customer_id, recency, frequency, monetary, on_time_rate, avg_delay_hours FROM feat")
def q_tabular_features(spark, d):
    return features(spark, d)


@query("features_wide", sql.with_(sql.FEATURE_CTES) + "SELECT * FROM feat")
def q_features_wide(spark, d):
    return features_wide(spark, d)


@query("monetary_median", sql.with_(sql.ORDERS, sql.AGG) +
       "SELECT round(median(avg_order_value), 4) AS median_monetary FROM agg")
def q_monetary_median(spark, d):
    agg = feat.orders_aggregate(driver.orders(spark, d), as_of=AS_OF)
    m = exact_percentiles(agg, "avg_order_value", [0.5], names=["m"])
    return m.select(F.round("m", 4).alias("median_monetary"))


FEEDBACK_TEXT_SQL = sql.with_(sql.FEEDBACK) + """
SELECT customer_id, md5(coalesce(string_agg(feedback_text, ' ' ORDER BY feedback_id), '')) AS text_md5,
       CAST(length(coalesce(string_agg(feedback_text, ' ' ORDER BY feedback_id), '')) AS BIGINT) AS n_chars
FROM f WHERE customer_id IS NOT NULL GROUP BY customer_id"""


def _text_digest(t: DataFrame) -> DataFrame:
    return t.select(KEY, F.md5("feedback_text").alias("text_md5"),
                    F.length("feedback_text").cast("bigint").alias("n_chars"))


@query("feedback_text", FEEDBACK_TEXT_SQL)
def q_feedback_text(spark, d):
    return _text_digest(feat.feedback_text(driver.feedback(spark, d)))


@query("feedback_segments", sql.with_(sql.FEEDBACK) + """, j AS (
  SELECT customer_id, coalesce(string_agg(feedback_text, ' ' ORDER BY feedback_id), '') AS t FROM f
  WHERE customer_id IS NOT NULL GROUP BY customer_id),
s AS (SELECT customer_id, t, unnest(range(0, greatest(length(t), 1), 1000)) AS start FROM j)
SELECT customer_id, CAST(start // 1000 AS BIGINT) AS segment, CAST(start AS BIGINT) AS start,
       substring(t, CAST(start AS BIGINT) + 1, 1000) AS segment_text FROM s""")
def q_feedback_segments(spark, d):
    return segments.feedback_segments(driver.feedback(spark, d), limit=1000)


@query("feedback_text_alias", FEEDBACK_TEXT_SQL)
def q_feedback_text_alias(spark, d):
    fb = driver.feedback(spark, d).withColumnRenamed("feedback_text", "text")
    return _text_digest(feat.feedback_text(fb))


@query("rating_metrics", sql.with_(sql.FEEDBACK, sql.RM) + "SELECT * FROM rm")
def q_rating_metrics(spark, d):
    return feat.rating_metrics(driver.feedback(spark, d))


# ---------------------------------------------------------------- label, diagnostics

@query("customer_target", sql.FULL + "SELECT * FROM tgt")
def q_customer_target(spark, d):
    return target(spark, d)


@query("class_distribution", sql.FULL + "SELECT is_at_risk, CAST(count(*) AS BIGINT) AS count FROM tgt GROUP BY is_at_risk")
def q_class_distribution(spark, d):
    return lab.class_distribution(target(spark, d))


@query("training_diagnostics", sql.FULL + """
SELECT CAST(count(*) AS BIGINT) AS total_samples, CAST(5 AS BIGINT) AS n_features,
       CAST(count(*) FILTER (WHERE is_at_risk = 1) AS BIGINT) AS n_positive,
       CAST(count(*) FILTER (WHERE is_at_risk = 0) AS BIGINT) AS n_negative,
       CAST(count(DISTINCT is_at_risk) AS BIGINT) AS n_classes FROM tgt""")
def q_training_diagnostics(spark, d):
    t = target(spark, d)
    return lab.training_diagnostics(t, ["recency", "frequency", "monetary", "on_time_rate", "avg_delay_hours"])


@query("feature_sample", sql.FULL + """
SELECT customer_id, coalesce(CAST(recency AS DOUBLE), 0.0) AS recency, coalesce(CAST(frequency AS DOUBLE), 0.0) AS frequency,
       coalesce(monetary, 0.0) AS monetary, coalesce(on_time_rate, 0.0) AS on_time_rate,
       coalesce(avg_delay_hours, 0.0) AS avg_delay_hours, is_at_risk
FROM tgt ORDER BY customer_id LIMIT 5""")
def q_feature_sample(spark, d):
    """First rows of the filled feature matrix with the label (M14's sample)."""
    cols = ["recency", "frequency", "monetary", "on_time_rate", "avg_delay_hours"]
    t = fill_features(target(spark, d), cols)
    return preview(t.select(KEY, *cols, lab.LABEL), KEY, 5)


# ---------------------------------------------------------------- embeddings and feature alignment

@query("features_without_inputs", sql.with_(sql.ORDERS, sql.AGG) + """
SELECT customer_id, coalesce(days_since_last_order, 999) AS recency, coalesce(num_orders_90d, 0) AS frequency,
       coalesce(avg_order_value, (SELECT median(avg_order_value) FROM agg)) AS monetary,
       CAST(NULL AS DOUBLE) AS on_time_rate, CAST(NULL AS DOUBLE) AS avg_delay_hours,
       CAST(0.0 AS DOUBLE) AS risk_score, 'Unknown' AS risk_label,
       CAST(NULL AS DOUBLE) AS avg_rating, CAST(0 AS BIGINT) AS negative_feedback_count FROM agg""")
def q_features_without_inputs(spark, d):
    """Orders only: no delivery table, no feedback table, no model (P18, P10)."""
    f = feat.tabular_features(driver.orders(spark, d), None, as_of=AS_OF)
    return score_customers(f, None, feedback=None)


@query("embedding_widen", "SELECT CAST(vec_id AS VARCHAR) AS customer_id, " + sql.emb_cols(64, "embedding") +
       " FROM embeddings")
def q_embedding_widen(spark, d):
    return txt.widen(txt.precomputed_embeddings(driver.embeddings(spark, d)), 64)


@query("embedding_join", sql.with_(sql.FEATURE_CTES) + """, ev AS (
  SELECT CAST(vec_id AS VARCHAR) AS customer_id, embedding FROM embeddings)
SELECT feat.customer_id, recency, frequency, monetary, on_time_rate, avg_delay_hours, """ +
       sql.emb_cols(64, "ev.embedding", fill=True) +
       " FROM feat LEFT JOIN ev ON feat.customer_id = ev.customer_id")
def q_embedding_join(spark, d):
    j = txt.join_embeddings(features(spark, d), txt.precomputed_embeddings(driver.embeddings(spark, d)), 64)
    return txt.widen(j, 64)


@query("feature_alignment", sql.with_(sql.ORDERS, sql.AGG) + """
SELECT customer_id, CAST(coalesce(days_since_last_order, 999) AS DOUBLE) AS recency,
       CAST(coalesce(num_orders_90d, 0) AS DOUBLE) AS frequency,
       coalesce(avg_order_value, (SELECT median(avg_order_value) FROM agg)) AS monetary,
       CAST(0.0 AS DOUBLE) AS on_time_rate, CAST(0.0 AS DOUBLE) AS avg_delay_hours FROM agg""")
def q_feature_alignment(spark, d):
    base = feat.tabular_features(driver.orders(spark, d), None, as_of=AS_OF).select(
        KEY, "recency", "frequency", "monetary")
    cols = ["recency", "frequency", "monetary", "on_time_rate", "avg_delay_hours"]
    aligned, _ = align_features(base, cols)
    return fill_features(aligned, cols).select(KEY, *cols)


@query("feedback_embeddings")
def q_feedback_embeddings(spark, d):
    return txt.feedback_embeddings(driver.feedback(spark, d))


# ---------------------------------------------------------------- sampling

TERMS_SQL = """fb AS (
  SELECT row_number() OVER () AS i, customer_id,
         [t FOR t IN regexp_split_to_array(lower(coalesce(feedback_text, '')), '[^\\p{L}\\p{N}]+') IF t <> ''] AS terms FROM f),
tb AS (SELECT i, customer_id, CAST(('0x' || substr(md5(t), 1, 15)) AS BIGINT) % 512 AS bucket
       FROM (SELECT i, customer_id, unnest(terms) AS t FROM fb)),
dfs AS (SELECT bucket, count(DISTINCT i) AS df FROM tb GROUP BY bucket),
idf AS (SELECT CAST(range AS INTEGER) AS bucket, CAST(coalesce(df, 0) AS BIGINT) AS df,
               ln(((SELECT count(DISTINCT i) FROM tb) + 1) / (coalesce(df, 0) + 1)) AS idf
        FROM range(512) LEFT JOIN dfs ON bucket = range)"""


@query("encoder_plugin", sql.with_(sql.FEEDBACK) + """, j AS (
  SELECT customer_id, coalesce(string_agg(feedback_text, ' ' ORDER BY feedback_id), '') AS t FROM f
  WHERE customer_id IS NOT NULL GROUP BY customer_id)
SELECT customer_id, CAST(length(t) AS FLOAT) AS emb_0, CAST(len(string_split(t, ' ')) - 1 AS FLOAT) AS emb_1 FROM j""")
def q_encoder_plugin(spark, d):
    """An encoder of one's own: characters and spaces of a customer's joined text."""
    def counts():
        import numpy as np
        return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], np.float32)

    return txt.widen(txt.feedback_embeddings(driver.feedback(spark, d), counts, dim=2), 2)


@query("text_idf", sql.with_(sql.FEEDBACK, TERMS_SQL) + "SELECT bucket, df, round(idf, 9) AS idf FROM idf")
def q_text_idf(spark, d):
    idf = lsa.inverse_document_frequencies(lsa.feedback_terms(driver.feedback(spark, d)))
    return idf.select("bucket", "df", F.round("idf", 9).alias("idf"))


@query("text_norms", sql.with_(sql.FEEDBACK, TERMS_SQL) + """, tf AS (
  SELECT customer_id, bucket, count(*) AS tf FROM tb GROUP BY 1, 2),
w AS (SELECT customer_id, sum(tf) AS n, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tf JOIN idf USING (bucket) GROUP BY 1)
SELECT k.customer_id, CAST(coalesce(n, 0) AS BIGINT) AS n_terms, round(coalesce(norm, 0), 6) AS norm
FROM (SELECT DISTINCT customer_id FROM f WHERE customer_id IS NOT NULL) k LEFT JOIN w USING (customer_id)""")
def q_text_norms(spark, d):
    return lsa.weighted_norms(driver.feedback(spark, d)).withColumn("norm", F.round("norm", 6))


@query("text_svd", sql.with_(sql.FEEDBACK, TERMS_SQL) + """, w AS (
  SELECT customer_id, sum(idf) AS weight FROM tb JOIN idf USING (bucket) GROUP BY 1)
SELECT k.customer_id, 64 AS dim, coalesce(weight, 0) > 0 AS has_vector, coalesce(weight, 0) > 0 AS unit_length
FROM (SELECT DISTINCT customer_id FROM f WHERE customer_id IS NOT NULL) k LEFT JOIN w USING (customer_id)""")
def q_text_svd(spark, d):
    """The fitted encoder's vectors, told by their length."""
    fb = driver.feedback(spark, d)
    x = lsa.TextSvd.fit(fb, 64).encode(fb)
    square = F.aggregate(lsa.EMBEDDING, F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    return x.select(KEY, F.size(lsa.EMBEDDING).alias("dim"), (square > 0).alias("has_vector"),
                    (F.abs(square - 1) < 1e-5).alias("unit_length"))


@query("class_weights", sql.FULL + """, cnt AS (SELECT is_at_risk, count(*) AS n FROM tgt GROUP BY 1),
w AS (SELECT is_at_risk, (SELECT sum(n) FROM cnt) / ((SELECT count(*) FROM cnt) * n) AS weight FROM cnt)
SELECT customer_id, tgt.is_at_risk, round(weight, 6) AS weight FROM tgt JOIN w ON tgt.is_at_risk = w.is_at_risk""")
def q_class_weights(spark, d):
    w = smp.class_weights(target(spark, d))
    return w.select(KEY, lab.LABEL, F.round("weight", 6).alias("weight"))


@query("oversample", sql.OVERSAMPLE)
def q_oversample(spark, d):
    return smp.oversample(target(spark, d).select(KEY, lab.LABEL))


@query("stratified_split", sql.FULL + f""", b AS (
  SELECT customer_id, is_at_risk, {sql.rank_by_hash('customer_id', 'is_at_risk')} AS rk,
         count(*) OVER (PARTITION BY is_at_risk) AS n FROM tgt)
SELECT customer_id, is_at_risk, CASE WHEN rk < floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM b""")
def q_stratified_split(spark, d):
    return smp.stratified_split(target(spark, d).select(KEY, lab.LABEL))


@query("stratified_folds", sql.FULL + f"""
SELECT customer_id, is_at_risk, CAST({sql.rank_by_hash('customer_id', 'is_at_risk')} % 5 AS INTEGER) AS fold FROM tgt""")
def q_stratified_folds(spark, d):
    return smp.stratified_folds(target(spark, d).select(KEY, lab.LABEL))


# ---------------------------------------------------------------- preprocessing stages

@query("median_impute", sql.FULL + """
SELECT customer_id,
       round(coalesce(on_time_rate, (SELECT median(on_time_rate) FROM tgt)), 6) AS on_time_rate,
       round(coalesce(avg_delay_hours, (SELECT median(avg_delay_hours) FROM tgt)), 6) AS avg_delay_hours,
       round(coalesce(avg_rating, (SELECT median(avg_rating) FROM tgt)), 6) AS avg_rating FROM tgt""")
def q_median_impute(spark, d):
    t = target(spark, d)
    cols = ["on_time_rate", "avg_delay_hours", "avg_rating"]
    return t.select(KEY, *[F.round(F.coalesce(F.col(c), exact_percentiles(t, c, [0.5], names=["m"])
                                              .select("m").scalar()), 6).alias(c) for c in cols])


@query("median_imputer_stage", sql.FULL + """
SELECT customer_id,
       round(coalesce(on_time_rate, (SELECT median(on_time_rate) FROM tgt)), 6) AS on_time_rate,
       round(coalesce(avg_delay_hours, (SELECT median(avg_delay_hours) FROM tgt)), 6) AS avg_delay_hours,
       round(coalesce(avg_rating, (SELECT median(avg_rating) FROM tgt)), 6) AS avg_rating FROM tgt""")
def q_median_imputer_stage(spark, d):
    t = target(spark, d)
    cols = ["on_time_rate", "avg_delay_hours", "avg_rating"]
    stage, imputed = median_imputer(t, cols)
    return stage.transform(t).select(KEY, *[F.round(imputed[c], 6).alias(c) for c in cols])


@query("standardize", sql.with_(sql.FEATURE_CTES) + """
SELECT customer_id,
       round((recency - (SELECT avg(recency) FROM feat)) / (SELECT stddev_pop(recency) FROM feat), 6) AS recency,
       round((frequency - (SELECT avg(frequency) FROM feat)) / (SELECT stddev_pop(frequency) FROM feat), 6) AS frequency,
       round((monetary - (SELECT avg(monetary) FROM feat)) / (SELECT stddev_pop(monetary) FROM feat), 6) AS monetary
FROM feat""")
def q_standardize(spark, d):
    from retentio.operators.model import standardize
    f = features(spark, d)
    z = standardize(f, ["recency", "frequency", "monetary"])
    return z.select(KEY, *[F.round(c, 6).alias(c) for c in ["recency", "frequency", "monetary"]])


# ---------------------------------------------------------------- metrics on the stand-in score

def _scored_target(spark, d) -> DataFrame:
    t = target(spark, d)
    return t.select(lab.LABEL, driver.pseudo_score(KEY).alias("score")).withColumn(
        "prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


@query("pr_auc", sql.PR_AUC)
def q_pr_auc(spark, d):
    return met.pr_auc(_scored_target(spark, d), lab.LABEL, "score")


@query("pr_curve", sql.PR_CURVE)
def q_pr_curve(spark, d):
    c = met.pr_curve(_scored_target(spark, d), lab.LABEL, "score")
    return c.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("roc_auc", sql.ROC_AUC)
def q_roc_auc(spark, d):
    return met.roc_auc(_scored_target(spark, d), lab.LABEL, "score")


@query("classification_report", sql.CLASS_REPORT)
def q_classification_report(spark, d):
    return met.classification_report(_scored_target(spark, d), lab.LABEL, "prediction")


# ---------------------------------------------------------------- model (rows-only checks)

def train_model(spark, d, opts: ModelOptions | None = None):
    """Training job over the driver tables with the precomputed 64-dim vectors."""
    from retentio.plans.training import run
    opts = opts or ModelOptions()
    vectors = txt.precomputed_embeddings(driver.embeddings(spark, d))
    return run(spark, driver.orders(spark, d), driver.delivery(spark, d), driver.feedback(spark, d),
               None, opts, as_of=AS_OF, dim=64, vectors=vectors)


def score_all(spark, d, model, meta) -> DataFrame:
    """Every customer of the driver tables scored by ``model``."""
    vectors = txt.precomputed_embeddings(driver.embeddings(spark, d))
    feats = txt.join_embeddings(features_wide(spark, d), vectors, meta.embedding_dim)
    return score_customers(feats, model, meta.feature_columns, meta.embedding_dim, driver.feedback(spark, d))


@query("train_and_score")
def q_train_and_score(spark, d):
    model, meta, _ = train_model(spark, d)
    return score_all(spark, d, model, meta).select(KEY, SCORE, "risk_label")


@query("cross_validated_scores")
def q_cross_validated_scores(spark, d):
    model, meta, metrics = train_model(spark, d, ModelOptions(cv=True))
    return metrics["cv_scores"]


@query("scored_facts", sql.with_(sql.FEATURE_CTES) +
       "SELECT customer_id, true AS in_range, true AS band_agrees, CAST(1 AS BIGINT) AS times FROM feat")
def q_scored_facts(spark, d):
    """What holds of every model's scores: each customer once, a probability, and its band."""
    model, meta, _ = train_model(spark, d, ModelOptions(n_estimators=20, max_depth=5))
    s = score_all(spark, d, model, meta)
    return s.groupBy(KEY).agg(
        F.every(F.col(SCORE).between(0.0, 1.0)).alias("in_range"),
        F.every(F.col("risk_label") == F.when(F.col(SCORE) >= 0.7, "High").when(F.col(SCORE) >= 0.4, "Medium")
                .otherwise("Low")).alias("band_agrees"), F.count(F.lit(1)).alias("times"))


@query("cross_validated_facts", sql.FULL + "SELECT customer_id, is_at_risk, CAST(1 AS BIGINT) AS times, true AS in_range FROM tgt")
def q_cross_validated_facts(spark, d):
    """What holds of all out-of-fold scores: each customer is scored in one fold, with its label and a probability."""
    _, _, metrics = train_model(spark, d, ModelOptions(cv=True, n_estimators=20, max_depth=5))
    return metrics["cv_scores"].groupBy(KEY, lab.LABEL).agg(
        F.count(F.lit(1)).alias("times"), F.every(F.col("score").between(0.0, 1.0)).alias("in_range"))


@query("model_roundtrip", sql.with_(sql.FEATURE_CTES) + "SELECT customer_id, true AS same FROM feat")
def q_model_roundtrip(spark, d):
    model, meta, _ = train_model(spark, d)
    path = scratch_dir(spark, "model")
    save_model(model, meta, path)
    loaded, meta2 = load_model(spark, path)
    a = score_all(spark, d, model, meta).select(KEY, F.col(SCORE).alias("score_before"))
    b = score_all(spark, d, loaded, meta2).select(KEY, F.col(SCORE).alias("score_after"))
    return a.join(b, KEY, "inner").select(KEY, (F.col("score_before") == F.col("score_after")).alias("same"))


# ---------------------------------------------------------------- risk bands and interventions

@query("risk_labels", sql.FULL_SCORED + "SELECT customer_id, risk_score, risk_label FROM sc")
def q_risk_labels(spark, d):
    return pseudo_scored(spark, d).select(KEY, SCORE, "risk_label")


@query("unknown_labels", sql.with_(sql.FEATURE_CTES) +
       "SELECT customer_id, CAST(0.0 AS DOUBLE) AS risk_score, 'Unknown' AS risk_label FROM feat")
def q_unknown_labels(spark, d):
    return score_customers(features_wide(spark, d), None).select(KEY, SCORE, "risk_label")


@query("interventions", sql.FULL_SCORED + f"SELECT customer_id, risk_label, {sql.SUGGESTION} AS suggestion FROM sc")
def q_interventions(spark, d):
    return with_suggestion(pseudo_scored(spark, d)).select(KEY, "risk_label", "suggestion")


@query("scored_customers", sql.FULL_SCORED + f"SELECT {', '.join(SCORED_COLS)} FROM sc")
def q_scored_customers(spark, d):
    return pseudo_scored(spark, d).select(*SCORED_COLS)


# ---------------------------------------------------------------- dashboard datasets

@query("filtered_customers", sql.FULL_FILTERED + "SELECT customer_id, risk_label, recency, monetary FROM flt")
def q_filtered_customers(spark, d):
    return filtered(spark, d).select(KEY, "risk_label", "recency", "monetary")


@query("filter_domain", sql.FULL_SCORED + """
SELECT string_agg(DISTINCT risk_label, ',' ORDER BY risk_label) AS labels,
       min(recency) AS min_recency, max(recency) AS max_recency,
       min(monetary) AS min_monetary, max(monetary) AS max_monetary,
       CAST(count(*) AS BIGINT) AS n_customers FROM sc""")
def q_filter_domain(spark, d):
    return vw.filter_domain(pseudo_scored(spark, d))


@query("filter_ids", sql.FULL_SCORED + "SELECT DISTINCT customer_id FROM sc")
def q_filter_ids(spark, d):
    return vw.filter_ids(pseudo_scored(spark, d))


@query("risk_distribution", sql.FULL_FILTERED +
       "SELECT risk_label, CAST(count(*) AS BIGINT) AS count FROM flt GROUP BY risk_label")
def q_risk_distribution(spark, d):
    return vw.risk_distribution(filtered(spark, d))


@query("scatter_sample", sql.FULL_FILTERED + """
SELECT customer_id, recency, frequency, monetary, risk_label FROM flt
ORDER BY md5(customer_id || ':42') LIMIT 2000""")
def q_scatter_sample(spark, d):
    return vw.scatter_sample(filtered(spark, d))


@query("orders_trend_monthly", sql.with_(sql.ORDERS) + """
SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS order_period, CAST(count(order_id) AS BIGINT) AS num_orders
FROM o WHERE order_date IS NOT NULL GROUP BY 1""")
def q_orders_trend_monthly(spark, d):
    return vw.orders_trend(driver.orders(spark, d))


@query("orders_trend_daily", sql.with_(sql.ORDERS) + f"""
SELECT CAST(date_trunc('day', order_date) AS TIMESTAMP) AS order_period, CAST(count(order_id) AS BIGINT) AS num_orders
FROM o WHERE order_date IS NOT NULL GROUP BY 1""")
def q_orders_trend_daily(spark, d):
    return vw.orders_trend(driver.orders(spark, d), granularity="day")


@query("monetary_box", sql.FULL_FILTERED + """, q AS (
  SELECT risk_label, CAST(count(*) AS BIGINT) AS n, min(monetary) AS mn, max(monetary) AS mx,
         quantile_cont(monetary, 0.25) AS q1, quantile_cont(monetary, 0.5) AS med, quantile_cont(monetary, 0.75) AS q3
  FROM flt GROUP BY risk_label)
SELECT risk_label, n, round(mn, 4) AS min, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
       round(mx, 4) AS max, round(q1 - 1.5 * (q3 - q1), 4) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 4) AS upper_fence
FROM q""")
def q_monetary_box(spark, d):
    b = vw.monetary_box(filtered(spark, d))
    return b.select("risk_label", "n", *[F.round(c, 4).alias(c) for c in
                                         ["min", "q1", "median", "q3", "max", "lower_fence", "upper_fence"]])


def _corr_sql() -> str:
    cols = list(vw.CORRELATION_COLUMNS)
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, round(corr({a}, {b}), 6) AS corr FROM flt")
    return sql.FULL_FILTERED + "\nUNION ALL\n".join(parts)


@query("correlation", _corr_sql())
def q_correlation(spark, d):
    return vw.correlation(filtered(spark, d))


TOP_SQL = sql.FULL_SCORED + """, top AS (SELECT * FROM sc ORDER BY risk_score DESC, customer_id LIMIT 20)"""


@query("top_at_risk", TOP_SQL + "SELECT customer_id, risk_score, risk_label, recency, frequency, monetary FROM top")
def q_top_at_risk(spark, d):
    return vw.top_at_risk(pseudo_scored(spark, d), 20)


@query("top_interventions", TOP_SQL + f"SELECT customer_id, risk_label, risk_score, {sql.SUGGESTION} AS suggestion FROM top")
def q_top_interventions(spark, d):
    return vw.top_interventions(pseudo_scored(spark, d), 20)


DETAIL_FIELDS = SCORED_COLS


def _detail_sql() -> str:
    dbl = {"monetary", "on_time_rate", "avg_delay_hours", "avg_order_value", "risk_score", "avg_rating"}
    parts = []
    for c in DETAIL_FIELDS:
        v = (f"CAST(CAST(round({c}, 6) AS DECIMAL(38,6)) AS VARCHAR)" if c in dbl else f"CAST({c} AS VARCHAR)")
        parts.append(f"SELECT '{c}' AS field, {v} AS value FROM pick")
    parts.append(f"SELECT 'suggestion' AS field, {sql.SUGGESTION} AS value FROM pick")
    return (sql.FULL_SCORED + ", pick AS (SELECT * FROM sc ORDER BY risk_score DESC, customer_id LIMIT 1)\n"
            + "\nUNION ALL\n".join(parts))


@query("customer_detail", _detail_sql())
def q_customer_detail(spark, d):
    scored = pseudo_scored(spark, d).select(*DETAIL_FIELDS)
    chosen = scored.orderBy(F.col(SCORE).desc(), F.col(KEY)).select(KEY).first()[0]
    return vw.customer_detail(scored, chosen)


@query("customer_detail_lookup", _detail_sql())
def q_customer_detail_lookup(spark, d):
    """The same from a table laid out by customer: one bucket is read."""
    scored = publish_bucketed(pseudo_scored(spark, d).select(*DETAIL_FIELDS), KEY)
    chosen = scored.orderBy(F.col(SCORE).desc(), F.col(KEY)).select(KEY).first()[0]
    return vw.customer_detail(scored, chosen)


@query("features_bucketed", sql.with_(sql.FEATURE_CTES) + "SELECT * FROM feat")
def q_features_bucketed(spark, d):
    """Features from inputs laid out by customer: neither aggregates nor their join exchange rows."""
    return feat.tabular_features(publish_bucketed(driver.orders(spark, d), KEY), publish_bucketed(driver.delivery(spark, d), KEY),
                                 as_of=AS_OF, wide=True)


@query("order_lines_bucketed", """SELECT o_orderkey AS order_id, CAST(count(*) AS BIGINT) AS lines,
       CAST(sum(CASE WHEN l_shipdate <= o_orderdate THEN 1 ELSE 0 END) AS BIGINT) AS on_time
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_order_lines_bucketed(spark, d):
    li = publish_bucketed(driver.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_shipdate"), "order_id")
    o = publish_bucketed(driver.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderdate"), "order_id")
    return li.join(o, "order_id").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_shipdate") <= F.col("o_orderdate")).alias("on_time"))


@query("customer_feedback", sql.with_(sql.FEATURE_CTES, sql.SCORED) + """, pick AS (
  SELECT customer_id FROM sc WHERE customer_id IN (SELECT customer_id FROM f)
  ORDER BY risk_score DESC, customer_id LIMIT 1)
SELECT feedback_id, feedback_text, rating FROM f WHERE customer_id = (SELECT customer_id FROM pick)""")
def q_customer_feedback(spark, d):
    fb = driver.feedback(spark, d)
    scored = pseudo_scored(spark, d)
    with_fb = scored.join(fb.select(KEY).distinct(), KEY, "left_semi")
    chosen = with_fb.orderBy(F.col(SCORE).desc(), F.col(KEY)).select(KEY).first()[0]
    return vw.customer_feedback(fb, chosen)


# ---------------------------------------------------------------- inputs with awkward values
# The driver tables hold no missing order values, odd dates or NaN; these views derive them from
# the whole tables, so that every branch is taken.

DIRTY_ORDERS_SQL = """dirty AS (
  SELECT CASE WHEN order_id % 97 <> 0 THEN customer_id END AS customer_id,
         CASE WHEN order_id % 101 <> 0 THEN order_id END AS order_id,
         CASE WHEN CAST(customer_id AS BIGINT) % 11 = 0 OR order_id % 13 = 0 THEN NULL
              WHEN order_id % 17 = 0 THEN 'NaN'::DOUBLE ELSE CAST(order_value AS DOUBLE) / 1e7 END AS order_value,
         CASE WHEN CAST(customer_id AS BIGINT) % 7 = 0 THEN 'no date' WHEN order_id % 5 = 0 THEN NULL
              WHEN order_id % 3 = 0 THEN strftime(order_date, '%d-%m-%Y') ELSE strftime(order_date, '%Y/%m/%d') END AS order_date,
         CAST(order_date AS DATE) AS real_date
  FROM o),
clean AS (
  SELECT customer_id, order_id, CASE WHEN NOT isnan(order_value) THEN order_value END AS order_value, order_date AS text_date,
         CASE WHEN order_date <> 'no date' THEN CAST(real_date AS TIMESTAMP) END AS order_date FROM dirty)"""


def dirty_orders(spark, d) -> DataFrame:
    o = driver.orders(spark, d)
    key, num = F.col(KEY).cast("bigint"), F.col("order_id")
    value = (F.when((key % 11 == 0) | (num % 13 == 0), None).when(num % 17 == 0, F.lit(float("nan")))
             .otherwise(F.col("order_value").cast("double") / 1e7))
    date = (F.when(key % 7 == 0, F.lit("no date")).when(num % 5 == 0, None)
            .when(num % 3 == 0, F.date_format("order_date", "dd-MM-yyyy")).otherwise(F.date_format("order_date", "yyyy/MM/dd")))
    return o.select(F.when(num % 97 != 0, F.col(KEY)).alias(KEY), F.when(num % 101 != 0, num).alias("order_id"),
                    value.alias("order_value"), date.alias("order_date"))


DIRTY_AGG = f"""dagg AS (
  SELECT customer_id, CAST(count(order_id) AS BIGINT) AS num_orders_90d, avg(order_value) AS avg_order_value,
         {sql.DAYS_SINCE} AS days_since_last_order
  FROM clean WHERE customer_id IS NOT NULL GROUP BY customer_id)"""


@query("orders_rfm_dirty", sql.with_(sql.ORDERS, DIRTY_ORDERS_SQL, DIRTY_AGG) + """
SELECT customer_id, coalesce(days_since_last_order, 999) AS recency, coalesce(num_orders_90d, 0) AS frequency,
       round(coalesce(avg_order_value, (SELECT median(avg_order_value) FROM dagg)) * 1e7, 6) AS monetary,
       days_since_last_order IS NULL AS no_date, avg_order_value IS NULL AS no_value FROM dagg""")
def q_orders_rfm_dirty(spark, d):
    """Null and NaN values below 1e-6 of a unit, text dates in two formats, unreadable dates."""
    f = feat.tabular_features(dirty_orders(spark, d), as_of=AS_OF, wide=True)
    return f.select(KEY, "recency", "frequency", F.round(F.col("monetary") * 1e7, 6).alias("monetary"),
                    F.col("days_since_last_order").isNull().alias("no_date"), F.col("avg_order_value").isNull().alias("no_value"))


@query("unparsable_dates", sql.with_(sql.ORDERS, DIRTY_ORDERS_SQL) + """
SELECT count(text_date) AS n_values, CAST(count(*) FILTER (WHERE text_date = 'no date') AS BIGINT) AS n_unparsable FROM clean""")
def q_unparsable_dates(spark, d):
    return unparsable_dates(dirty_orders(spark, d), "order_date")


@query("orders_trend_dirty", sql.with_(sql.ORDERS, DIRTY_ORDERS_SQL) + """
SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS order_period, CAST(count(order_id) AS BIGINT) AS num_orders
FROM clean WHERE text_date IS NOT NULL AND order_date IS NOT NULL GROUP BY 1""")
def q_orders_trend_dirty(spark, d):
    return vw.orders_trend(dirty_orders(spark, d))


@query("frequency_window", sql.with_(sql.ORDERS) + f"""
SELECT customer_id, CAST(count(order_id) FILTER (WHERE order_date > {sql.AS_OF} - INTERVAL 365 DAY) AS BIGINT) AS orders_last_year
FROM o WHERE customer_id IS NOT NULL GROUP BY customer_id""")
def q_frequency_window(spark, d):
    agg = feat.orders_aggregate(driver.orders(spark, d), as_of=AS_OF, frequency_window_days=365)
    return agg.select(KEY, F.col("num_orders_90d").alias("orders_last_year"))


@query("mean_precision", sql.with_(sql.ORDERS) + """
SELECT customer_id, round(avg(CAST(order_value AS DOUBLE) * 1e-12) * 1e12, 6) AS tiny,
       round(avg(CAST(order_value AS DOUBLE) * 1e25) / 1e25, 6) AS huge,
       CAST(sum(CASE WHEN order_id % 2 = 0 THEN 2.0 ELSE 2.000001 END) / count(*) <= 2 AS BOOLEAN) AS at_most_two
FROM o WHERE customer_id IS NOT NULL GROUP BY customer_id""")
def q_mean_precision(spark, d):
    """Means of values far below and above the exact range, and a mean just above a threshold."""
    v, near = F.col("order_value").cast("double"), F.when(F.col("order_id") % 2 == 0, 2.0).otherwise(2.000001)
    return driver.orders(spark, d).groupBy(KEY).agg(
        F.round(exact_mean(v * 1e-12) * 1e12, 6).alias("tiny"), F.round(exact_mean(v * 1e25) / 1e25, 6).alias("huge"),
        (exact_mean(near) <= 2).alias("at_most_two"))


KEYS_SQL = """k AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN '00' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN CAST(c_custkey // 3 AS VARCHAR)
  ELSE '12345678901234567' || right('0000' || CAST(c_custkey AS VARCHAR), 4) END AS customer_id, c_custkey AS order_id FROM customer)"""


@query("csv_scan_keys", f"WITH {KEYS_SQL} SELECT customer_id, order_id FROM k")
def q_csv_scan_keys(spark, d):
    """Keys with leading zeros and of 21 digits come back from CSV as they were written."""
    c = F.col("c_custkey")
    key = (F.when(c % 3 == 0, F.concat(F.lit("00"), c.cast("string"))).when(c % 3 == 1, F.floor(c / 3).cast("string"))
           .otherwise(F.concat(F.lit("12345678901234567"), F.substring(F.concat(F.lit("0000"), c.cast("string")), -4, 4))))
    path = scratch_dir(spark, "keys-csv")
    driver.table(spark, d, "customer").select(key.alias(KEY), c.alias("order_id")).write.option("header", "true").csv(path)
    return read_table(spark, path, fmt="csv").select(KEY, "order_id")


NULL_LABEL_SQL = """n AS (SELECT customer_id, monetary, CASE WHEN CAST(customer_id AS BIGINT) % 5 <> 0 THEN is_at_risk END AS is_at_risk FROM tgt)"""


def null_labels(spark, d) -> DataFrame:
    t = target(spark, d)
    return t.withColumn(lab.LABEL, F.when(F.col(KEY).cast("bigint") % 5 != 0, F.col(lab.LABEL)))


@query("stratified_split_null_label", sql.with_(sql.FEATURE_CTES, sql.TARGET, NULL_LABEL_SQL) + f"""
SELECT customer_id, is_at_risk, CASE WHEN {sql.rank_by_hash('customer_id', 'is_at_risk')} <
       floor(count(*) OVER (PARTITION BY is_at_risk) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM n""")
def q_stratified_split_null_label(spark, d):
    return smp.stratified_split(null_labels(spark, d)).select(KEY, lab.LABEL, "split")


@query("percentiles_null_group", sql.with_(sql.FEATURE_CTES, sql.TARGET, NULL_LABEL_SQL) + """
SELECT is_at_risk, round(quantile_cont(monetary, 0.1), 4) AS p10, round(quantile_cont(monetary, 0.9), 4) AS p90 FROM n GROUP BY is_at_risk""")
def q_percentiles_null_group(spark, d):
    p = exact_percentiles(null_labels(spark, d), "monetary", [0.1, 0.9], by=[lab.LABEL], names=["p10", "p90"])
    return p.select(lab.LABEL, F.round("p10", 4).alias("p10"), F.round("p90", 4).alias("p90"))


@query("percentiles_narrowed", """SELECT l_returnflag, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.999) AS p99_9
FROM (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem) GROUP BY l_returnflag""")
def q_percentiles_narrowed(spark, d):
    """Ranges of more than 256 rows are narrowed, so that small tables go through the rounds, too."""
    return exact_percentiles(driver.table(spark, d, "lineitem"), "l_extendedprice", [0.01, 0.5, 0.999], by=["l_returnflag"],
                             names=["p1", "p50", "p99_9"], narrowing=True, exact_rows=256)


@query("monetary_outliers", sql.FULL_FILTERED + """, q AS (
  SELECT risk_label, quantile_cont(monetary, 0.25) AS q1, quantile_cont(monetary, 0.75) AS q3 FROM flt GROUP BY risk_label)
SELECT customer_id, risk_label, monetary FROM flt JOIN q USING (risk_label)
WHERE monetary < q1 - 1.5 * (q3 - q1) OR monetary > q3 + 1.5 * (q3 - q1)""")
def q_monetary_outliers(spark, d):
    f = filtered(spark, d)
    return vw.monetary_outliers(f, vw.monetary_box(f))


@query("filter_bounds", sql.FULL_SCORED + """
SELECT customer_id, risk_label, recency, monetary FROM sc WHERE risk_label IN ('High', 'Low') AND recency BETWEEN 10 AND 400 AND monetary <= 180000""")
def q_filter_bounds(spark, d):
    f = vw.filter_customers(pseudo_scored(spark, d), ["High", "Low"], (10, 400), (None, 180000))
    return f.select(KEY, "risk_label", "recency", "monetary")
