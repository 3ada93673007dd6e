"""ANSI SQL (DuckDB dialect) for every deterministic catalogue query, over the
driver's tables.  Each string is self-contained: the driver registers the
tables as views and runs it as is."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"


def mean(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(38,6))) AS DOUBLE) / count({x})"


def rank_by_hash(key: str, part: str, seed: int = 42) -> str:
    return f"(row_number() OVER (PARTITION BY {part} ORDER BY md5({key} || ':{seed}'), {key}) - 1)"


def hash_int(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 15)) AS BIGINT)"


ORDERS = """o AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, o_orderkey AS order_id,
         o_totalprice AS order_value, o_orderdate AS order_date
  FROM orders)"""

DELIVERY = """d AS (
  SELECT CAST(od.o_custkey AS VARCHAR) AS customer_id,
         (l.l_shipdate <= od.o_orderdate) AS on_time,
         CAST(greatest(date_diff('day', CAST(od.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)), 0) * 24 AS DOUBLE) AS delay_hours,
         l.l_orderkey AS order_id, l.l_linenumber AS line_number
  FROM lineitem l JOIN orders od ON l.l_orderkey = od.o_orderkey)"""

FEEDBACK = """f AS (
  SELECT CAST(dc.doc_id // 2 AS VARCHAR) AS customer_id, dc.doc_id AS feedback_id, dc.text AS feedback_text,
         CAST(CASE WHEN lb.toxic = 1 THEN 1 WHEN lb.quality = 0 THEN 2
                   WHEN lb.quality = 1 THEN 3 + dc.doc_id % 3 END AS DOUBLE) AS rating
  FROM documents dc LEFT JOIN labels lb ON dc.doc_id = lb.doc_id)"""

DAYS_SINCE = (f"CAST(floor((epoch_us({AS_OF}) - epoch_us(max(order_date))) / 86400000000.0) AS BIGINT)")

AGG = f"""agg AS (
  SELECT customer_id, CAST(count(order_id) AS BIGINT) AS num_orders_90d,
         {mean('order_value')} AS avg_order_value,
         {DAYS_SINCE} AS days_since_last_order
  FROM o WHERE customer_id IS NOT NULL GROUP BY customer_id)"""

DM = f"""dm AS (
  SELECT customer_id, {mean('CAST(on_time AS INTEGER)')} AS on_time_rate,
         {mean('delay_hours')} AS avg_delay_hours
  FROM d WHERE customer_id IS NOT NULL GROUP BY customer_id)"""

RM = f"""rm AS (
  SELECT customer_id, {mean('rating')} AS avg_rating,
         CAST(count(*) FILTER (WHERE rating <= 2) AS BIGINT) AS negative_feedback_count
  FROM f WHERE customer_id IS NOT NULL GROUP BY customer_id)"""

FEAT = """feat AS (
  SELECT a.customer_id,
         coalesce(a.days_since_last_order, 999) AS recency,
         coalesce(a.num_orders_90d, 0) AS frequency,
         coalesce(a.avg_order_value, (SELECT median(avg_order_value) FROM agg)) AS monetary,
         dm.on_time_rate, dm.avg_delay_hours,
         a.num_orders_90d, a.avg_order_value, a.days_since_last_order
  FROM agg a LEFT JOIN dm ON a.customer_id = dm.customer_id)"""

TARGET = """tgt AS (
  SELECT feat.customer_id, recency, frequency, monetary, on_time_rate, avg_delay_hours, rm.avg_rating,
         CAST(CASE WHEN (recency > 60 AND frequency <= 1) OR coalesce(rm.avg_rating <= 2, false)
                   THEN 1 ELSE 0 END AS INTEGER) AS is_at_risk
  FROM feat LEFT JOIN rm ON feat.customer_id = rm.customer_id)"""

PSEUDO = "CAST(CAST(customer_id AS BIGINT) * 37 % 101 AS DOUBLE) / 100.0"

SCORED = f"""sc0 AS (
  SELECT feat.*, greatest(0.0, least(1.0, {PSEUDO})) AS risk_score FROM feat),
sc AS (
  SELECT sc0.customer_id, recency, frequency, monetary, on_time_rate, avg_delay_hours,
         num_orders_90d, avg_order_value, days_since_last_order, risk_score,
         CASE WHEN risk_score >= 0.7 THEN 'High' WHEN risk_score >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_label,
         rm.avg_rating, rm.negative_feedback_count
  FROM sc0 LEFT JOIN rm ON sc0.customer_id = rm.customer_id)"""

FILTERED = "flt AS (SELECT * FROM sc WHERE recency IS NOT NULL AND monetary IS NOT NULL AND recency >= 0)"

SUGGESTION = """CASE
  WHEN risk_label = 'High' AND avg_rating <= 2 THEN 'Personal outreach: call from CS + refund/priority support'
  WHEN risk_label = 'High' AND recency > 90 THEN 'Win-back: targeted discount + reminder email'
  WHEN risk_label = 'High' AND negative_feedback_count > 0 THEN 'Escalate to retention team + offer credit'
  WHEN risk_label = 'High' THEN 'Loyalty offer + curated recommendations'
  WHEN risk_label = 'Medium' AND avg_rating <= 3 THEN 'Automated survey + coupon for next order'
  WHEN risk_label = 'Medium' THEN 'Email nudge with recommendations'
  ELSE 'Monitor' END"""

FEATURE_CTES = ",\n".join([ORDERS, DELIVERY, FEEDBACK, AGG, DM, RM, FEAT])


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def emb_cols(n: int = 64, src: str = "e.embedding", fill: bool = False) -> str:
    if fill:
        return ", ".join(f"coalesce({src}[{i + 1}], CAST(0.0 AS FLOAT)) AS emb_{i}" for i in range(n))
    return ", ".join(f"{src}[{i + 1}] AS emb_{i}" for i in range(n))


FULL = with_(FEATURE_CTES, TARGET)
FULL_SCORED = with_(FEATURE_CTES, SCORED)
FULL_FILTERED = with_(FEATURE_CTES, SCORED, FILTERED)

PR_AUC = f"""{with_(FEATURE_CTES, TARGET)}, s AS (
  SELECT {PSEUDO} AS sc, is_at_risk FROM tgt),
g AS (
  SELECT sc, CAST(count(*) FILTER (WHERE is_at_risk = 1) AS BIGINT) AS pos,
         CAST(count(*) FILTER (WHERE is_at_risk <> 1) AS BIGINT) AS neg FROM s GROUP BY sc),
c AS (
  SELECT sc, pos, neg, sum(pos) OVER (ORDER BY sc DESC) AS tp, sum(neg) OVER (ORDER BY sc DESC) AS fp FROM g),
tot AS (SELECT sum(pos) AS p FROM g)
SELECT round(sum(pos / tot.p * (
         (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END)
       + (CASE WHEN (tp - pos) + (fp - neg) > 0 THEN (tp - pos) / ((tp - pos) + (fp - neg)) ELSE 1.0 END)) / 2.0), 4) AS pr_auc
FROM c, tot"""

ROC_AUC = f"""{with_(FEATURE_CTES, TARGET)}, s AS (
  SELECT {PSEUDO} AS sc, is_at_risk FROM tgt),
g AS (
  SELECT sc, CAST(count(*) FILTER (WHERE is_at_risk = 1) AS BIGINT) AS pos,
         CAST(count(*) FILTER (WHERE is_at_risk <> 1) AS BIGINT) AS neg FROM s GROUP BY sc),
c AS (SELECT sc, pos, neg, sum(neg) OVER (ORDER BY sc) AS cn FROM g),
u AS (SELECT sum(pos) AS p, sum(neg) AS n, sum(pos * ((cn - neg) + neg * 0.5)) AS u FROM c)
SELECT CASE WHEN p > 0 AND n > 0 THEN round(u / (p * n), 4) END AS roc_auc FROM u"""

CLASS_REPORT = f"""{with_(FEATURE_CTES, TARGET)}, s AS (
  SELECT CAST(is_at_risk AS VARCHAR) AS l,
         CAST(CAST(CASE WHEN {PSEUDO} >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS VARCHAR) AS p FROM tgt),
cls AS (SELECT l AS class FROM s UNION SELECT p FROM s),
per AS (
  SELECT class,
         (SELECT count(*) FROM s WHERE s.l = cls.class) AS support,
         (SELECT count(*) FROM s WHERE s.p = cls.class) AS npred,
         (SELECT count(*) FROM s WHERE s.l = cls.class AND s.p = cls.class) AS tp
  FROM cls),
m AS (
  SELECT class, support, tp,
         CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
m2 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m),
allrows AS (
  SELECT class, precision, recall, f1 AS f1_score, support FROM m2
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM m2
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m2
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM m2)
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score,
       CAST(support AS BIGINT) AS support FROM allrows"""

OVERSAMPLE = f"""{with_(FEATURE_CTES, TARGET)}, b AS (
  SELECT customer_id, is_at_risk, {rank_by_hash('customer_id', 'is_at_risk')} AS rk FROM tgt),
cnt AS (SELECT is_at_risk, count(*) AS n FROM b GROUP BY is_at_risk),
mx AS (SELECT max(n) AS m FROM cnt),
major AS (SELECT min(is_at_risk) AS lab FROM cnt, mx WHERE cnt.n = mx.m),
need AS (SELECT cnt.is_at_risk AS cls, cnt.n AS ncls, mx.m - cnt.n AS deficit FROM cnt, mx WHERE cnt.n < mx.m),
draws AS (
  SELECT need.cls, b.rk AS j, {hash_int("CAST(need.cls AS VARCHAR) || ':' || CAST(b.rk AS VARCHAR) || ':42'")} % need.ncls AS pick
  FROM b JOIN major ON b.is_at_risk = major.lab JOIN need ON b.rk < need.deficit)
SELECT customer_id, is_at_risk, CAST(NULL AS BIGINT) AS draw FROM b
UNION ALL
SELECT b.customer_id, b.is_at_risk, CAST(draws.j AS BIGINT) AS draw
FROM draws JOIN b ON b.is_at_risk = draws.cls AND b.rk = draws.pick"""

PR_CURVE = f"""{with_(FEATURE_CTES, TARGET)}, s AS (
  SELECT {PSEUDO} AS sc, is_at_risk FROM tgt),
g AS (
  SELECT sc, CAST(count(*) FILTER (WHERE is_at_risk = 1) AS BIGINT) AS pos,
         CAST(count(*) FILTER (WHERE is_at_risk <> 1) AS BIGINT) AS neg FROM s GROUP BY sc),
c AS (SELECT sc, sum(pos) OVER (ORDER BY sc DESC) AS tp, sum(neg) OVER (ORDER BY sc DESC) AS fp FROM g)
SELECT sc AS threshold, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(tp / (SELECT sum(pos) FROM g), 6) AS recall FROM c"""
