"""The query catalogue: one entry per operator or view, with the same in SQL.

SQL is stated over the raw tables: ``ENTITIES_SQL`` builds the canonical entities,
``STAR_SQL`` the star schema on top (keys by their natural keys, as hashes are not
the same in every engine). Money is decimal until the last step, where both sides
turn it into double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from ..functions.columns import share
from ..operators import checks, cleaning, rules, scd2, star
from ..streaming import events
from . import ops, scenarios, views
from .views import AS_OF, Mart

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ENTITIES_SQL = f"""
c_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderkey AS VARCHAR) AS customer_id, CAST(o_custkey AS VARCHAR) AS customer_unique_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'canceled' END AS order_status,
    CAST(o_orderdate AS TIMESTAMP) AS order_purchase_timestamp,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_hours(o_orderkey % 48) END AS order_approved_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 30 + 1 AS INTEGER)) END AS order_delivered_customer_date,
    o_orderdate + to_days(20) AS order_estimated_delivery_date, o_custkey, o_orderkey, o_orderpriority, o_totalprice
  FROM orders
), c_customers AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS customer_id, CAST(c_custkey AS VARCHAR) AS customer_unique_id, c_nationkey AS customer_zip_code_prefix,
    lower(n_name) AS customer_city, lower(r_name) AS customer_state
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), c_raw_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
    l_shipdate AS shipping_limit_date, CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
    CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS freight_value
  FROM lineitem
), c_items AS (
  SELECT * EXCLUDE (nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id, order_item_id ORDER BY shipping_limit_date DESC NULLS LAST, product_id NULLS LAST, seller_id NULLS LAST, price NULLS LAST, freight_value NULLS LAST) AS nth FROM c_raw_items
  ) WHERE nth = 1
), c_payments AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(seq AS INTEGER) AS payment_sequential,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'boleto' WHEN '3-MEDIUM' THEN 'voucher' WHEN '4-NOT SPECIFIED' THEN 'not_defined' WHEN '5-LOW' THEN 'debit_card' END AS payment_type,
    CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderkey % 10 + 1 AS INTEGER) ELSE 1 END AS payment_installments,
    CAST((cents // n + CASE WHEN seq = 1 THEN cents % n ELSE 0 END)::DECIMAL(18,0) * 0.01 AS DECIMAL(10,2)) AS payment_value
  FROM (SELECT *, unnest(range(1, n + 1)) AS seq FROM (SELECT o_orderkey, o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS cents, o_orderkey % 3 + 1 AS n FROM orders))
), c_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_size <> 1 THEN lower(p_type) END AS product_category_name, p_size AS product_weight_g FROM part
), c_translation AS (
  SELECT n AS product_category_name, replace(n, ' ', '_') AS product_category_name_english FROM (SELECT DISTINCT lower(p_type) AS n FROM part) WHERE n > (SELECT min(lower(p_type)) FROM part)
), c_sellers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, lower(n_name) AS seller_city, upper(substr(n_name, 1, 2)) AS seller_state FROM supplier JOIN nation ON s_nationkey = n_nationkey
), c_changes AS (
  SELECT op, who AS customer_unique_id, city AS customer_city, 'moved' AS customer_state, TIMESTAMP '{AS_OF} 00:00:00' + to_hours(h) AS updated_at FROM (
    SELECT 'U' AS op, CAST(o_custkey AS VARCHAR) AS who, 'first-move' AS city, 1 AS h FROM p WHERE o_custkey % 11 = 0 AND o_custkey % 37 <> 0
    UNION ALL SELECT 'U', CAST(o_custkey AS VARCHAR), 'last-move', 5 FROM p WHERE o_custkey % 22 = 0 AND o_custkey % 37 <> 0
    UNION ALL SELECT 'D', CAST(o_custkey AS VARCHAR), NULL, 2 FROM p WHERE o_custkey % 37 = 0
    UNION ALL SELECT 'I', CAST(o_custkey + 10000000 AS VARCHAR), 'arrival', 3 FROM p WHERE o_custkey % 101 = 0)
), c_events AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts, user_id, event_type, value FROM events
  UNION ALL SELECT CAST(event_id AS VARCHAR), ts, user_id, event_type, value FROM events WHERE event_id % 10 = 0
  UNION ALL SELECT CAST(event_id AS VARCHAR) || '-late', ts - INTERVAL 72 HOUR, user_id, event_type, value FROM events WHERE event_id % 25 = 0
)"""
_PERSONS_SQL = f"p AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING min(o_orderdate) < TIMESTAMP '{AS_OF} 00:00:00')"

STAR_SQL = f"""
totals AS (
  SELECT o.order_id, o.customer_id, o.customer_unique_id, o.order_purchase_timestamp, coalesce(sum(i.price), 0) AS items_total, coalesce(sum(i.freight_value), 0) AS freight_total,
    coalesce(sum(i.price), 0) + coalesce(sum(i.freight_value), 0) AS order_total, count(i.order_item_id) AS items_count, count(DISTINCT i.seller_id) AS distinct_sellers
  FROM c_orders o LEFT JOIN c_items i USING (order_id) GROUP BY ALL
), segment AS (
  SELECT *, CASE WHEN lifetime_value >= 1000 THEN 'high_value' WHEN days_since_last_order > 180 THEN 'lapsed' WHEN order_count > 1 THEN 'returning' ELSE 'new' END AS customer_segment
  FROM (SELECT customer_unique_id, count(*) AS order_count, sum(order_total) AS lifetime_value, max(order_purchase_timestamp) AS last_order_ts, min(order_purchase_timestamp) AS first_order_ts,
      date_diff('day', CAST(max(order_purchase_timestamp) AS DATE), DATE '{AS_OF}') AS days_since_last_order
    FROM totals WHERE order_purchase_timestamp <= TIMESTAMP '{AS_OF} 00:00:00' GROUP BY customer_unique_id)
), attributes AS (
  SELECT a.customer_unique_id, a.customer_city, a.customer_state, a.customer_zip_code_prefix, coalesce(s.customer_segment, 'unknown') AS customer_segment, coalesce(s.order_count, 0) AS order_count,
    s.lifetime_value, s.last_order_ts, f.first_order_ts
  FROM (SELECT DISTINCT customer_unique_id, customer_city, customer_state, customer_zip_code_prefix FROM c_customers) a
  LEFT JOIN segment s USING (customer_unique_id) LEFT JOIN (SELECT customer_unique_id, min(order_purchase_timestamp) AS first_order_ts FROM c_orders GROUP BY 1) f USING (customer_unique_id)
), latest_change AS (
  SELECT * FROM c_changes QUALIFY row_number() OVER (PARTITION BY customer_unique_id ORDER BY updated_at DESC) = 1
), whole AS (
  SELECT l.op, l.customer_unique_id, coalesce(l.customer_city, a.customer_city) AS customer_city, coalesce(l.customer_state, a.customer_state) AS customer_state, a.customer_segment,
    a.customer_zip_code_prefix, a.order_count, a.lifetime_value, a.first_order_ts, a.last_order_ts, a.customer_city AS was_city, a.customer_state AS was_state, a.customer_unique_id AS known
  FROM latest_change l LEFT JOIN attributes a USING (customer_unique_id)
), classified AS (
  SELECT *, CASE WHEN op = 'D' AND known IS NOT NULL THEN 'deleted' WHEN op = 'D' THEN 'unchanged' WHEN known IS NULL THEN 'new'
    WHEN customer_city IS DISTINCT FROM was_city OR customer_state IS DISTINCT FROM was_state THEN 'changed' ELSE 'unchanged' END AS action FROM whole
), dim_customer AS (
  SELECT a.customer_unique_id, a.customer_city, a.customer_state, a.customer_segment, a.customer_zip_code_prefix, a.order_count, a.lifetime_value, a.first_order_ts, a.last_order_ts,
    a.first_order_ts AS effective_from, CASE WHEN c.action IN ('changed', 'deleted') THEN TIMESTAMP '{AS_OF} 00:00:00' ELSE TIMESTAMP '9999-12-31 00:00:00' END AS effective_to,
    coalesce(c.action, '') NOT IN ('changed', 'deleted') AS is_current, false AS is_deleted, 'initial_load' AS _change_reason
  FROM attributes a LEFT JOIN classified c USING (customer_unique_id)
  UNION ALL
  SELECT customer_unique_id, customer_city, customer_state, customer_segment, customer_zip_code_prefix, order_count, lifetime_value, first_order_ts, last_order_ts,
    TIMESTAMP '{AS_OF} 00:00:00', TIMESTAMP '9999-12-31 00:00:00', true, action = 'deleted', action FROM classified WHERE action <> 'unchanged'
), dim_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, CAST(d AS DATE) AS date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
    strftime(d, '%Y-%m') AS year_month, CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayname(d) AS day_name, CAST(weekofyear(d) AS INTEGER) AS week_of_year, dayofweek(d) IN (0, 6) AS is_weekend
  FROM (SELECT unnest(generate_series(CAST((SELECT min(o_orderdate) FROM orders) AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE) + 365, INTERVAL 1 DAY)) AS d)
), dim_product AS (
  SELECT product_id, coalesce(p.product_category_name, 'unknown') AS category_pt, coalesce(t.product_category_name_english, 'unknown') AS category, product_weight_g
  FROM c_products p LEFT JOIN c_translation t USING (product_category_name)
), versioned AS (
  SELECT o.*, d.customer_city AS v_city, d.customer_state AS v_state, d.customer_segment AS v_segment, d.effective_from, d.effective_to
  FROM c_orders o LEFT JOIN dim_customer d ON o.customer_unique_id = d.customer_unique_id AND o.order_purchase_timestamp >= d.effective_from AND o.order_purchase_timestamp < d.effective_to
), fact_order AS (
  SELECT v.*, t.items_total, t.freight_total, t.order_total, t.items_count, t.distinct_sellers, CAST(strftime(v.order_purchase_timestamp, '%Y%m%d') AS INTEGER) AS order_date_sk,
    CAST(strftime(v.order_delivered_customer_date, '%Y%m%d') AS INTEGER) AS delivered_date_sk,
    round(CAST(date_diff('second', v.order_purchase_timestamp, v.order_approved_at) AS DECIMAL(18,0)) / 3600, 2) AS approval_lag_hours,
    date_diff('day', CAST(v.order_purchase_timestamp AS DATE), CAST(v.order_delivered_customer_date AS DATE)) AS delivery_days,
    date_diff('day', CAST(v.order_estimated_delivery_date AS DATE), CAST(v.order_delivered_customer_date AS DATE)) AS delivery_delay_days,
    v.order_delivered_customer_date > v.order_estimated_delivery_date AS is_late, v.order_status IN ('canceled', 'unavailable') AS is_cancelled, v.order_status = 'delivered' AS is_delivered
  FROM versioned v JOIN totals t USING (order_id)
), fact_order_item AS (
  SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, CAST(strftime(o.order_purchase_timestamp, '%Y%m%d') AS INTEGER) AS order_date_sk, CAST(strftime(i.shipping_limit_date, '%Y%m%d') AS INTEGER) AS ship_limit_date_sk,
    p.category, 1 AS quantity, i.price AS item_price, i.freight_value, i.price + i.freight_value AS item_revenue, o.order_status, o.order_status IN ('canceled', 'unavailable') AS is_cancelled
  FROM c_items i JOIN c_orders o USING (order_id) LEFT JOIN dim_product p USING (product_id)
), fact_payment AS (
  SELECT y.*, CAST(strftime(o.order_purchase_timestamp, '%Y%m%d') AS INTEGER) AS order_date_sk, o.order_status = 'delivered' AS order_completed FROM c_payments y JOIN c_orders o USING (order_id)
)"""
_WITH = f"WITH {_PERSONS_SQL}, {ENTITIES_SQL}, {STAR_SQL}\n"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that every engine's rows compare."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name) for f in df.schema])


def query(name: str, sql: str | None = None):
    """Register a function of a Mart; ``sql`` follows the entities and the star."""

    def take(make: Callable[[Mart], DataFrame]) -> Callable[[Mart], DataFrame]:
        QUERIES[name] = lambda spark, folder: plain(make(views.mart(spark, folder)))
        if sql is not None:
            ORACLE_SQL[name] = _WITH + sql
        return make

    return take


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _pct(a: str, b: str) -> str:
    return f"CAST(round(100.0 * {a} / nullif({b}, 0), 2) AS DOUBLE)"


def _mean(x: str, digits: int = 2) -> str:
    return f"CAST(round(CAST(sum(CAST({x} AS DECIMAL(12,2))) / count({x}) AS DECIMAL(18,6)), {digits}) AS DOUBLE)"


# --- views ----------------------------------------------------------------
_MONTHLY = f"""SELECT year_month, year, month, count(DISTINCT order_id) AS orders, {_d('sum(CASE WHEN NOT is_cancelled THEN item_revenue ELSE 0 END)')} AS revenue,
  {_d('sum(CASE WHEN is_cancelled THEN item_revenue ELSE 0 END)')} AS cancelled_value, count(*) AS order_lines,
  {_d('round(CAST(sum(CASE WHEN NOT is_cancelled THEN item_revenue ELSE 0 END) AS DECIMAL(20,2)) / count(DISTINCT order_id), 2)')} AS avg_order_value
FROM fact_order_item JOIN dim_date ON order_date_sk = date_sk GROUP BY year_month, year, month"""
_CATEGORY = f"""SELECT category, {_d('revenue')} AS revenue, orders, order_lines, avg_item_price, rank() OVER (ORDER BY revenue DESC) AS revenue_rank,
  {_d('round(100.0 * revenue / sum(revenue) OVER (), 2)')} AS pct_of_revenue, {_d('round(100.0 * sum(revenue) OVER (ORDER BY revenue DESC) / sum(revenue) OVER (), 2)')} AS cumulative_pct
FROM (SELECT coalesce(category, 'unknown') AS category, sum(item_revenue) AS revenue, count(*) AS order_lines, count(DISTINCT order_id) AS orders, {_mean('item_price')} AS avg_item_price FROM fact_order_item WHERE NOT is_cancelled GROUP BY 1)"""
_PAYMENTS = f"""SELECT payment_type, count(*) AS payment_records, count(DISTINCT order_id) AS orders, {_d('sum(payment_value)')} AS total_paid, {_mean('payment_value')} AS avg_payment_value,
  {_mean('payment_installments')} AS avg_installments, count(DISTINCT CASE WHEN order_completed THEN order_id END) AS completed_orders,
  {_pct('count(DISTINCT CASE WHEN order_completed THEN order_id END)', 'count(DISTINCT order_id)')} AS completion_rate_pct FROM fact_payment GROUP BY payment_type"""
_PERSONS = f"""SELECT customer_unique_id, count(DISTINCT order_id) AS orders, {_d('sum(order_total)')} AS lifetime_value, {_mean('order_total')} AS avg_order_value, min(order_purchase_timestamp) AS first_order_ts,
  max(order_purchase_timestamp) AS last_order_ts, CAST(date_diff('day', CAST(min(order_purchase_timestamp) AS DATE), CAST(max(order_purchase_timestamp) AS DATE)) AS INTEGER) AS customer_lifespan_days, count(DISTINCT order_id) > 1 AS is_repeat_customer
FROM fact_order WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id"""
_DELIVERY = f"""SELECT year_month, v_state AS customer_state, count(*) AS orders, CAST(count_if(is_delivered) AS BIGINT) AS delivered_orders, {_mean('delivery_days')} AS avg_delivery_days,
  CAST(quantile_disc(delivery_days, 0.5) AS INTEGER) AS median_delivery_days, CAST(quantile_disc(delivery_days, 0.95) AS INTEGER) AS p95_delivery_days, coalesce(CAST(count_if(is_late) AS BIGINT), 0) AS late_orders,
  {_pct('count_if(is_late)', 'count_if(is_delivered)')} AS late_rate_pct, {_mean('delivery_delay_days')} AS avg_delay_vs_estimate, {_mean('approval_lag_hours')} AS avg_approval_lag_hours
FROM fact_order JOIN dim_date ON order_date_sk = date_sk GROUP BY year_month, v_state"""

query("v_revenue_monthly", _MONTHLY)(views.revenue_monthly)
query("v_revenue_by_category", _CATEGORY)(views.revenue_by_category)
query("v_seller_monthly_performance", f"""SELECT seller_id, seller_state, year_month, {_d('sum(item_revenue)')} AS revenue, count(DISTINCT order_id) AS orders, count(*) AS order_lines,
  rank() OVER (PARTITION BY year_month ORDER BY sum(item_revenue) DESC) AS rank_in_month, {_mean('item_price')} AS avg_item_price
FROM fact_order_item JOIN c_sellers USING (seller_id) JOIN dim_date ON order_date_sk = date_sk WHERE NOT is_cancelled GROUP BY seller_id, seller_state, year_month""")(views.seller_monthly)
query("v_customer_metrics", _PERSONS)(views.customer_metrics)
query("v_repeat_purchase_rate", f"""SELECT count(*) AS customers, CAST(count_if(orders > 1) AS BIGINT) AS repeat_customers, {_pct('count_if(orders > 1)', 'count(*)')} AS repeat_rate_pct,
  {_d('round(CAST(CAST(sum(orders) AS DECIMAL(18,0)) / count(*) AS DECIMAL(18,6)), 3)')} AS avg_orders_per_customer, {_d('round(CAST(CAST(sum(v) AS DECIMAL(20,2)) / count(*) AS DECIMAL(20,6)), 2)')} AS avg_lifetime_value
FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS orders, sum(order_total) AS v FROM fact_order GROUP BY 1)""")(views.repeat_purchase_rate)
query("v_delivery_performance", _DELIVERY)(views.delivery_performance)
query("v_cancellation_by_category", f"""SELECT coalesce(category, 'unknown') AS category, count(DISTINCT order_id) AS orders, count(DISTINCT CASE WHEN is_cancelled THEN order_id END) AS cancelled_orders,
  {_d('sum(CASE WHEN is_cancelled THEN item_revenue ELSE 0 END)')} AS cancelled_value, {_pct('count(DISTINCT CASE WHEN is_cancelled THEN order_id END)', 'count(DISTINCT order_id)')} AS cancellation_rate_pct
FROM fact_order_item GROUP BY 1 HAVING count(DISTINCT order_id) >= 30""")(views.cancellation_by_category)
query("v_payment_method_completion", _PAYMENTS)(views.payment_method_completion)
query("v_order_point_in_time", f"""SELECT f.order_id, f.order_purchase_timestamp, {_d('f.order_total')} AS order_total, f.customer_unique_id, f.v_city AS city_at_order_time, f.v_state AS state_at_order_time, f.v_segment AS segment_at_order_time,
  f.effective_from AS version_effective_from, f.effective_to AS version_effective_to, n.customer_city AS city_current, n.customer_segment AS segment_current, f.v_city <> n.customer_city AS customer_has_moved_since
FROM fact_order f LEFT JOIN dim_customer n ON f.customer_unique_id = n.customer_unique_id AND n.is_current AND NOT n.is_deleted""")(views.order_point_in_time)
query("v_repeat_rate_key_comparison", f"""SELECT a.n AS customers_correct_key, b.n AS customers_naive_key, a.r AS repeat_rate_pct_correct, b.r AS repeat_rate_pct_naive
FROM (SELECT count(*) AS n, {_pct('count_if(k > 1)', 'count(*)')} AS r FROM (SELECT count(DISTINCT order_id) AS k FROM fact_order GROUP BY customer_unique_id)) a,
  (SELECT count(*) AS n, {_pct('count_if(k > 1)', 'count(*)')} AS r FROM (SELECT count(DISTINCT order_id) AS k FROM c_orders GROUP BY customer_id)) b""")(views.repeat_rate_key_comparison)
query("v_fanout_demo", f"""SELECT {_d('(SELECT sum(order_total) FROM fact_order)')} AS revenue_correct, {_d('(SELECT sum(order_total) FROM fact_order JOIN fact_payment USING (order_id))')} AS revenue_inflated_by_fanout,
  (SELECT count(*) FROM fact_order) AS orders, (SELECT count(*) FROM fact_payment) AS payment_records, {_d('(SELECT round(CAST(count(*) AS DECIMAL(18,0)) / count(DISTINCT order_id), 3) FROM fact_payment)')} AS avg_payments_per_order""")(views.fanout_demo)
query("v_reconciliation", f"""SELECT 'order_items rows' AS check_name, {_d('(SELECT count(*) FROM c_items)')} AS silver_value, {_d('(SELECT count(*) FROM fact_order_item)')} AS gold_value
UNION ALL SELECT 'orders rows', {_d('(SELECT count(*) FROM c_orders)')}, {_d('(SELECT count(*) FROM fact_order)')}
UNION ALL SELECT 'item revenue (rounded)', {_d('(SELECT round(sum(price + freight_value)) FROM c_items)')}, {_d('(SELECT round(sum(item_revenue)) FROM fact_order_item)')}
UNION ALL SELECT 'payment records', {_d('(SELECT count(*) FROM c_payments)')}, {_d('(SELECT count(*) FROM fact_payment)')}""")(views.reconciliation)
query("v_scd2_integrity", """SELECT customer_unique_id, count(*) AS versions, CAST(count_if(is_current) AS BIGINT) AS current_versions, CAST(0 AS BIGINT) AS overlapping_pairs, 'expected exactly 1 current version' AS violation
FROM dim_customer GROUP BY customer_unique_id HAVING count_if(is_current) <> 1""")(views.scd2_integrity)

# --- dashboards and questions ---------------------------------------------
query("dashboard_monthly", f"SELECT * FROM ({_MONTHLY}) WHERE orders >= 100")(views.dashboard_monthly)
query("dashboard_top_categories", f"SELECT * FROM ({_CATEGORY}) WHERE revenue_rank <= 10")(views.dashboard_top_categories)
query("dashboard_payments", f"SELECT * FROM ({_PAYMENTS}) WHERE payment_type <> 'not_defined'")(views.dashboard_payments)
query("dashboard_delivery_by_state", f"""SELECT customer_state, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(delivered_orders) AS BIGINT) AS delivered_orders,
  {_d('round(CAST(sum(CAST(avg_delivery_days AS DECIMAL(12,2)) * orders) AS DECIMAL(20,2)) / sum(CASE WHEN avg_delivery_days IS NOT NULL THEN orders END), 1)')} AS avg_days_by_orders,
  {_d('round(CAST(sum(CAST(avg_delivery_days AS DECIMAL(12,2)) * delivered_orders) AS DECIMAL(20,2)) / sum(delivered_orders), 1)')} AS avg_days_by_deliveries,
  {_pct('sum(late_orders)', 'sum(orders)')} AS late_pct_of_orders, {_pct('sum(late_orders)', 'sum(delivered_orders)')} AS late_pct_of_delivered
FROM ({_DELIVERY}) GROUP BY customer_state HAVING sum(orders) >= 500""")(views.delivery_by_state)
query("dashboard_measures", f"""SELECT order_status, {_d('sum(item_revenue)')} AS total_revenue, {_d('max(item_revenue)')} AS largest_line, count(*) AS lines, count(DISTINCT order_id) AS orders,
  {_d('round(CAST(sum(item_revenue) AS DECIMAL(20,2)) / count(DISTINCT order_id), 2)')} AS revenue_per_order FROM fact_order_item GROUP BY order_status""")(lambda s: views.measured(s.order_lines, ["order_status"], list(views.MEASURES)))
query("question_repeat_by_segment", f"""SELECT v_segment AS segment, count(DISTINCT customer_unique_id) AS customers, count(*) AS orders, {_d('sum(order_total)')} AS revenue FROM fact_order GROUP BY 1""")(
    lambda s: views.order_point_in_time(s).groupBy(F.col("segment_at_order_time").alias("segment")).agg(F.count_distinct("customer_unique_id").alias("customers"), F.count(F.lit(1)).alias("orders"), F.sum("order_total").alias("revenue"))
)
query("question_city_at_order_time", "SELECT v_city AS city, count(*) AS orders, CAST(count_if(v_city <> n.customer_city) AS BIGINT) AS moved_since FROM fact_order f LEFT JOIN dim_customer n ON f.customer_unique_id = n.customer_unique_id AND n.is_current AND NOT n.is_deleted GROUP BY 1")(views.city_at_order_time)

# --- dimensions and facts -------------------------------------------------
query("dim_date", "SELECT * FROM dim_date")(lambda s: s.fresh("dim_date"))
query("dim_product", "SELECT product_id, category_pt, category, product_weight_g FROM dim_product")(lambda s: s.fresh("dim_product").select("product_id", "category_pt", "category", "product_weight_g"))
query("dim_seller", "SELECT seller_id, seller_city, seller_state FROM c_sellers")(lambda s: s.fresh("dim_seller").select("seller_id", "seller_city", "seller_state"))
query("dim_order_status", "SELECT DISTINCT order_status, order_status = 'delivered' AS is_completed, order_status IN ('canceled', 'unavailable') AS is_cancelled FROM c_orders")(lambda s: s.fresh("dim_order_status").drop("order_status_sk"))
query("dim_payment_type", "SELECT DISTINCT payment_type, payment_type = 'credit_card' AS supports_installments FROM c_payments")(lambda s: s.fresh("dim_payment_type").drop("payment_type_sk"))
query("dim_customer", f"SELECT * REPLACE ({_d('lifetime_value')} AS lifetime_value) FROM dim_customer")(lambda s: s.fresh("dim_customer").drop("customer_sk", "_row_hash"))
query("fact_order", f"""SELECT order_id, customer_unique_id, order_date_sk, delivered_date_sk, order_status, order_purchase_timestamp, order_approved_at, {_d('items_total')} AS items_total, {_d('freight_total')} AS freight_total, {_d('order_total')} AS order_total,
  items_count, distinct_sellers, {_d('approval_lag_hours')} AS approval_lag_hours, CAST(delivery_days AS INTEGER) AS delivery_days, CAST(delivery_delay_days AS INTEGER) AS delivery_delay_days, is_late, is_cancelled, is_delivered FROM fact_order""")(
    lambda s: s.fresh("fact_order").drop("customer_sk", "order_status_sk", "order_delivered_customer_date", "order_estimated_delivery_date")
)
query("fact_order_item", f"""SELECT order_id, order_item_id, order_date_sk, ship_limit_date_sk, category, quantity, {_d('item_price')} AS item_price, {_d('freight_value')} AS freight_value, {_d('item_revenue')} AS item_revenue, order_status, is_cancelled FROM fact_order_item""")(
    lambda s: s.fresh("fact_order_item").drop("product_sk", "seller_sk", "customer_sk")
)
query("fact_payment", f"SELECT order_id, payment_sequential, order_date_sk, payment_type, payment_installments, {_d('payment_value')} AS payment_value, order_completed FROM fact_payment")(lambda s: s.fresh("fact_payment").drop("payment_type_sk", "customer_sk"))

# --- cleaning and business transforms -------------------------------------
query("clean_dedupe_latest", f"SELECT * REPLACE ({_d('price')} AS price, {_d('freight_value')} AS freight_value) FROM c_items")(lambda s: s.fresh("items"))
query("clean_normalise_strings", r"SELECT p_partkey, nullif(lower(trim(regexp_replace('  ' || p_name || '   ' || p_brand || ' ', '\s+', ' ', 'g'))), '') AS t, CAST(NULL AS VARCHAR) AS blank FROM part")(
    lambda s: cleaning.normalise_strings(s.source.table("part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", F.lit(" ")).alias("t"), F.lit("   ").alias("blank")), ("t", "blank", "absent"))
)
query("clean_parse_timestamps", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS t FROM orders")(
    lambda s: cleaning.parse_timestamps(s.source.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "31.12.1999").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("t")), ("t",))
)
query("clean_cast_numerics", f"SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN {_d('CAST(p_retailprice AS DECIMAL(10,2))')} END AS price FROM part")(
    lambda s: cleaning.cast_numerics(s.source.table("part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("decimal(10,2)").cast("string")).alias("price")), {"price": "decimal(10,2)"})
)
query("geolocation_centres", f"""SELECT n_regionkey AS geolocation_zip_code_prefix, {_d('sum(c_custkey % 90)')} / count(*) AS latitude, {_d('sum(c_custkey % 180)')} / count(*) AS longitude, m.city, m.city AS state, count(*) AS reading_count
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT n_regionkey AS k, lower(n_name) AS city FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, lower(n_name) QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY count(*) DESC, lower(n_name)) = 1) m ON n_regionkey = m.k GROUP BY n_regionkey, m.city""")(
    lambda s: cleaning.geolocation_centres(s.source.geolocation())
)
query("order_totals", f"SELECT order_id, customer_id, order_purchase_timestamp, {_d('items_total')} AS items_total, {_d('freight_total')} AS freight_total, {_d('order_total')} AS order_total, items_count FROM totals")(lambda s: star.order_totals(s.orders, s.items))
query("first_orders", "SELECT customer_unique_id, min(order_purchase_timestamp) AS first_order_ts FROM c_orders GROUP BY 1")(lambda s: star.first_orders(s.orders.join(s.customers, "customer_id")))
query("customer_segments", f"SELECT * REPLACE ({_d('lifetime_value')} AS lifetime_value, CAST(days_since_last_order AS INTEGER) AS days_since_last_order) FROM segment")(lambda s: star.segments(star.order_totals(s.orders, s.items).join(s.customers, "customer_id"), s.day))
query("customer_attributes", f"SELECT * REPLACE ({_d('lifetime_value')} AS lifetime_value) FROM attributes")(lambda s: s.fresh("attributes"))

# --- data quality ---------------------------------------------------------
_BAD = "CASE WHEN CAST(order_id AS BIGINT) % 50 = 0 THEN -price WHEN CAST(order_id AS BIGINT) % 51 = 0 THEN NULL ELSE price END"


def _dirty(s: Mart) -> DataFrame:
    k = F.col("order_id").cast("long")
    return s.items.withColumns({"price": F.when(k % 50 == 0, -F.col("price")).when(k % 51 != 0, F.col("price")), "product_id": F.when(k % 100 != 0, F.col("product_id"))}).select("order_id", "order_item_id", "product_id", "price", "freight_value")


_DIRTY_SQL = f"dirty AS (SELECT order_id, order_item_id, CASE WHEN CAST(order_id AS BIGINT) % 100 <> 0 THEN product_id END AS product_id, {_BAD} AS price, freight_value FROM c_items)"
_FAILED = "list_filter([CASE WHEN product_id IS NULL THEN 'order_items.product_id_not_null' END, CASE WHEN NOT coalesce(price >= 0, false) THEN 'order_items.price_non_negative' END], lambda x: x IS NOT NULL)"


def dirty_query(name: str, sql: str):
    def take(make):
        query(name)(make)
        ORACLE_SQL[name] = f"{_WITH}, {_DIRTY_SQL} {sql}"
        return make

    return take


_joined = lambda df: df.withColumn(rules.FAILED, F.array_join(rules.FAILED, ","))
dirty_query("dq_tag_failures", f"SELECT * REPLACE ({_d('price')} AS price, {_d('freight_value')} AS freight_value), array_to_string({_FAILED}, ',') AS _dq_failed_rules FROM dirty")(lambda s: _joined(rules.tag(_dirty(s), rules.rules_for("order_items"))))
dirty_query("dq_split_clean", f"SELECT * REPLACE ({_d('price')} AS price, {_d('freight_value')} AS freight_value) FROM dirty WHERE len({_FAILED}) = 0")(lambda s: rules.split(_dirty(s), rules.rules_for("order_items"))[0])
dirty_query("dq_split_quarantine", f"SELECT * REPLACE ({_d('price')} AS price, {_d('freight_value')} AS freight_value), array_to_string({_FAILED}, ',') AS _dq_failed_rules FROM dirty WHERE len({_FAILED}) > 0")(lambda s: _joined(rules.split(_dirty(s), rules.rules_for("order_items"))[1]))
dirty_query("dq_count_failures", f"SELECT rule_id, count(*) AS rows_failed FROM (SELECT unnest({_FAILED}) AS rule_id FROM dirty) GROUP BY 1")(lambda s: rules.count_failures(_dirty(s), rules.rules_for("order_items")))


@query("dq_results", """SELECT t AS table_name, r AS rule_id, s AS severity, CAST(f AS BIGINT) AS rows_failed, CAST(n AS BIGINT) AS rows_checked, round(CAST(f AS DOUBLE) / n, 6) AS failure_rate FROM (
  SELECT 'products' AS t, 'products.category_present' AS r, 'warn' AS s, count_if(product_category_name IS NULL) AS f, count(*) AS n FROM c_products
  UNION ALL SELECT 'products', 'products.product_id_not_null', 'reject', 0, count(*) FROM c_products UNION ALL SELECT 'products', 'products.weight_non_negative', 'reject', 0, count(*) FROM c_products
  UNION ALL SELECT 'sellers', 'sellers.seller_id_not_null', 'reject', 0, count(*) FROM c_sellers
  UNION ALL SELECT 'customers', 'customers.state_two_letters', 'warn', count(*), count(*) FROM c_customers
  UNION ALL SELECT 'customers', 'customers.customer_id_not_null', 'reject', 0, count(*) FROM c_customers UNION ALL SELECT 'customers', 'customers.unique_id_not_null', 'reject', 0, count(*) FROM c_customers)""")
def _dq_results(s: Mart) -> DataFrame:
    return rules.all_results({"products": s.source.products(), "sellers": s.source.sellers(), "customers": s.customers}).select("table_name", "rule_id", "severity", "rows_failed", "rows_checked", "failure_rate")


# --- SCD2 -----------------------------------------------------------------
query("scd2_overlay", f"SELECT op, customer_unique_id, customer_city, customer_state, customer_segment, order_count, {_d('lifetime_value')} AS lifetime_value FROM whole")(
    lambda s: scd2.completed(s.met).select("op", "customer_unique_id", "customer_city", "customer_state", "customer_segment", "order_count", "lifetime_value")
)
query("scd2_classify", "SELECT customer_unique_id, action AS scd_action FROM classified")(lambda s: scd2.completed(s.met).select("customer_unique_id", F.col(scd2.ACTION).alias("scd_action")))
query("scd2_action_counts", "SELECT action AS scd_action, count(*) AS n FROM classified GROUP BY 1")(lambda s: scd2.action_counts(s.met).withColumnRenamed(scd2.ACTION, "scd_action"))
query("scd2_new_versions", "SELECT customer_unique_id, customer_city, customer_state, is_deleted, _change_reason FROM dim_customer WHERE _change_reason <> 'initial_load'")(lambda s: scd2.opened(s.met, scd2.CUSTOMER, s.day).select("customer_unique_id", "customer_city", "customer_state", "is_deleted", "_change_reason"))
query("scd2_keys_to_close", "SELECT customer_unique_id FROM classified WHERE action IN ('changed', 'deleted')")(lambda s: scd2.closed(s.met, scd2.CUSTOMER, s.day).select("customer_unique_id"))
query("scd2_seed", f"SELECT customer_unique_id, customer_city, {_d('lifetime_value')} AS lifetime_value, first_order_ts AS effective_from FROM attributes")(lambda s: s.fresh("seeded").select("customer_unique_id", "customer_city", "lifetime_value", "effective_from"))
query("scd2_live_population", "SELECT customer_unique_id, customer_city FROM dim_customer WHERE is_current AND NOT is_deleted")(lambda s: scd2.live(s.dim_customer).select("customer_unique_id", "customer_city"))


@query("scd2_replay", "SELECT 'unchanged' AS scd_action, count(*) AS n FROM classified")
def _replay(s: Mart) -> DataFrame:
    """The same feed again, against what it made: nothing to do."""
    return scd2.action_counts(views.meet_feed(s.dim_customer, s.source.changes(s.as_of))).withColumnRenamed(scd2.ACTION, "scd_action")


query("scd2_point_in_time_join", "SELECT order_id, v_city AS customer_city, effective_from, effective_to FROM versioned")(
    lambda s: scd2.at_time(s.orders.join(s.customers.select("customer_id", "customer_unique_id"), "customer_id", "left"), s.dim_customer.withColumnsRenamed({"effective_from": "f", "effective_to": "t"}).withColumns({"effective_from": F.col("f"), "effective_to": F.col("t")}), "customer_unique_id", F.col("order_purchase_timestamp"), ["customer_city", F.col("f"), F.col("t")]).select("order_id", "customer_city", F.col("f").alias("effective_from"), F.col("t").alias("effective_to"))
)

# --- aggregates, joins, windows, sets, each by itself ---------------------
_li = lambda s: s.source.table("lineitem")
_or = lambda s: s.source.table("orders")
_cents = lambda c: F.col(c).cast("decimal(12,2)")


def simple(name: str, sql: str):
    def take(make):
        query(name)(make)
        ORACLE_SQL[name] = sql
        return make

    return take


simple("agg_sum_count", f"SELECT l_returnflag, {_d('sum(CAST(l_extendedprice AS DECIMAL(12,2)))')} AS total, count(*) AS n, count(CASE WHEN l_discount > 0 THEN 1 END) AS n_discounted FROM lineitem GROUP BY 1")(
    lambda s: _li(s).groupBy("l_returnflag").agg(F.sum(_cents("l_extendedprice")).alias("total"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_discount") > 0, 1)).alias("n_discounted"))
)
simple("agg_count_distinct", "SELECT l_linestatus, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned FROM lineitem GROUP BY 1")(
    lambda s: _li(s).groupBy("l_linestatus").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"))
)
simple("agg_conditional", f"SELECT o_orderpriority, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS done, {_d('''sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(12,2)) ELSE 0 END)''')} AS done_value, {_pct('''count_if(o_orderstatus = 'F')''', 'count(*)')} AS done_pct FROM orders GROUP BY 1")(
    lambda s: _or(s).groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.sum(F.when(F.col("o_orderstatus") == "F", _cents("o_totalprice")).otherwise(0)).alias("done_value"), share(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("done_pct"))
)
simple("agg_avg_min_max", f"SELECT o_orderstatus, {_mean('o_totalprice')} AS mean, {_d('min(CAST(o_totalprice AS DECIMAL(12,2)))')} AS least, {_d('max(CAST(o_totalprice AS DECIMAL(12,2)))')} AS most FROM orders GROUP BY 1")(
    lambda s: _or(s).groupBy("o_orderstatus").agg(views.mean("o_totalprice").alias("mean"), F.min(_cents("o_totalprice")).alias("least"), F.max(_cents("o_totalprice")).alias("most"))
)
simple("agg_percentile", "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1")(
    lambda s: views.percentiles(_or(s), ["o_orderstatus"], "o_totalprice", {"p50": 0.5, "p95": 0.95})
)
simple("agg_mode", "SELECT o_custkey % 10 AS k, o_orderpriority AS commonest FROM orders GROUP BY o_custkey % 10, o_orderpriority QUALIFY row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY count(*) DESC, o_orderpriority) = 1")(
    lambda s: _or(s).groupBy((F.col("o_custkey") % 10).alias("k")).agg(F.mode("o_orderpriority", deterministic=True).alias("commonest"))
)
simple("agg_global_two_level", f"SELECT count(*) AS customers, CAST(count_if(n > 10) AS BIGINT) AS frequent, {_d('round(CAST(sum(n) AS DECIMAL(18,0)) / count(*), 3)')} AS mean_orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")(
    lambda s: _or(s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("n") > 10).alias("frequent"), F.round(F.avg(F.col("n").cast("decimal(12,0)")), 3).alias("mean_orders"))
)
simple("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")(lambda s: _or(s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 12"))
simple("agg_weighted_mean", f"SELECT {_d('round(CAST(sum(m * n) AS DECIMAL(24,2)) / sum(n), 2)')} AS weighted, {_d('round(CAST(sum(m) AS DECIMAL(24,2)) / count(*), 2)')} AS unweighted FROM (SELECT o_orderpriority, CAST({_mean('o_totalprice')} AS DECIMAL(12,2)) AS m, count(*) AS n FROM orders GROUP BY 1)")(
    lambda s: _or(s).groupBy("o_orderpriority").agg(views.mean("o_totalprice").cast("decimal(12,2)").alias("m"), F.count(F.lit(1)).alias("n")).agg(F.round(F.sum(F.col("m") * F.col("n")).cast("decimal(24,2)") / F.sum("n"), 2).alias("weighted"), F.round(F.sum("m").cast("decimal(24,2)") / F.count(F.lit(1)), 2).alias("unweighted"))
)
simple("agg_explode_count", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY 1")(lambda s: s.source.table("part").select(F.explode(F.split("p_type", " ")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")))
simple("set_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda s: _li(s).select("l_returnflag", "l_linestatus").distinct())
simple("set_union_all", "SELECT 'customer' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")(
    lambda s: s.source.table("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k")).unionAll(s.source.table("supplier").select(F.lit("supplier"), "s_suppkey"))
)
simple("set_array_intersect", "SELECT p_partkey, len(list_intersect(string_split(p_type, ' '), string_split(upper(p_name), ' '))) AS n FROM part")(lambda s: s.source.table("part").select("p_partkey", F.size(F.array_intersect(F.split("p_type", " "), F.split(F.upper("p_name"), " "))).cast("long").alias("n")))
simple("join_left_default", "SELECT coalesce(o_orderstatus, 'none') AS status, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY 1")(
    lambda s: s.source.table("customer").join(_or(s), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 400000), "left").groupBy(F.coalesce("o_orderstatus", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
)
simple("join_inner_star", f"SELECT r_name, {_d('sum(CAST(o_totalprice AS DECIMAL(12,2)))')} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")(
    lambda s: _or(s).join(s.source.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(s.source.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(s.source.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sum(_cents("o_totalprice")).alias("total"))
)
simple("join_orphans", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")(lambda s: checks.orphans(s.source.table("part").select("p_partkey"), "p_partkey", _li(s).filter("l_quantity > 45"), "l_partkey"))
simple("join_interval_overlap", "SELECT a.l_orderkey, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey AND a.l_shipdate < b.l_shipdate + INTERVAL 30 DAY AND b.l_shipdate < a.l_shipdate + INTERVAL 30 DAY GROUP BY 1")(
    lambda s: _li(s).alias("a").join(_li(s).alias("b"), F.expr("a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey AND a.l_shipdate < b.l_shipdate + INTERVAL 30 DAY AND b.l_shipdate < a.l_shipdate + INTERVAL 30 DAY")).groupBy("a.l_orderkey").agg(F.count(F.lit(1)).alias("pairs"))
)
_ranked = lambda order, *by: Window.partitionBy(*by).orderBy(*order)
simple("window_row_number", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")(
    lambda s: _or(s).withColumn("n", F.row_number().over(_ranked([F.col("o_orderdate").desc(), F.col("o_orderkey")], "o_custkey"))).filter("n = 1").select("o_custkey", "o_orderkey")
)
simple("window_rank_of_groups", "SELECT p_brand, p_size, count(*) AS n, rank() OVER (PARTITION BY p_brand ORDER BY count(*) DESC) AS place FROM part GROUP BY p_brand, p_size")(
    lambda s: s.source.table("part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.rank().over(_ranked([F.col("n").desc()], "p_brand")))
)
simple("window_running_share", f"SELECT o_orderpriority, {_d('round(100.0 * sum(t) OVER (ORDER BY t DESC) / sum(t) OVER (), 2)')} AS cumulative FROM (SELECT o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS t FROM orders GROUP BY 1)")(
    lambda s: _or(s).groupBy("o_orderpriority").agg(F.sum(_cents("o_totalprice")).alias("t")).select("o_orderpriority", share(F.sum("t").over(Window.orderBy(F.col("t").desc())), F.sum("t").over(Window.partitionBy())).alias("cumulative"))
)
simple("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda s: _or(s).select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25))
simple("date_parts", "SELECT o_orderkey, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, CAST(weekofyear(o_orderdate) AS INTEGER) AS w, strftime(o_orderdate, '%Y-%m') AS ym, dayname(o_orderdate) AS dn FROM orders")(
    lambda s: _or(s).select("o_orderkey", F.quarter("o_orderdate").alias("q"), F.dayofweek("o_orderdate").alias("dow"), F.weekofyear("o_orderdate").alias("w"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.date_format("o_orderdate", "EEEE").alias("dn"))
)
simple("json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(lambda s: s.source.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))

# --- constraints and fingerprints -----------------------------------------
query("constraint_report", "SELECT c AS constraint_name, CAST(0 AS BIGINT) AS violations FROM (SELECT unnest([" + ", ".join([f"'pk_{t}'" for t in checks.PRIMARY_KEYS] + [f"'fk_{t}_{c}'" for t, c, _, _ in checks.FOREIGN_KEYS]) + "]) AS c)")(lambda s: checks.constraint_report(*s.checked()))
query("fingerprint", f"""SELECT 'fact_order' AS table_name, count(*) AS row_count, {_d('sum(order_total)')} AS measure FROM fact_order UNION ALL SELECT 'fact_order_item', count(*), {_d('sum(item_revenue)')} FROM fact_order_item
UNION ALL SELECT 'fact_payment', count(*), {_d('sum(payment_value)')} FROM fact_payment UNION ALL SELECT 'dim_customer', count(*), {_d('sum(CAST(lifetime_value AS DECIMAL(20,2)))')} FROM dim_customer""")(
    lambda s: ops.fingerprint({k: v for k, v in s.tables().items() if k in ("fact_order", "fact_order_item", "fact_payment", "dim_customer")}).select("table_name", "row_count", F.coalesce(*[F.col("measure_sums")[m] for m in ("order_total", "item_revenue", "payment_value", "lifetime_value")]).alias("measure"))
)

# --- events ---------------------------------------------------------------
_ONCE = "(SELECT DISTINCT ON (event_id) * FROM c_events)"
_VALUE = _d("sum(CAST(value AS DECIMAL(18,4)))")
query("events_once", "SELECT DISTINCT event_id, ts, user_id, event_type FROM c_events")(lambda s: events.once(events.timed(s.source.events())).select("event_id", "ts", "user_id", "event_type"))
query("events_tumbling", f"SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, {_VALUE} AS value FROM {_ONCE} GROUP BY 1, 2")(lambda s: events.tumbling(s.source.events()))
query("events_sliding", f"SELECT b - to_days(k) AS start, event_type, count(*) AS events, {_VALUE} AS value FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS b, CAST(unnest([0, 1]) AS INTEGER) AS k FROM {_ONCE}) GROUP BY 1, 2")(lambda s: events.sliding(s.source.events()))
query("events_sessions", f"""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS events, {_VALUE} AS value FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM {_ONCE})) GROUP BY user_id, g""")(lambda s: events.sessions(s.source.events()))

# --- violations, so that checks are seen to find them ---------------------
def _doubled(s: Mart) -> DataFrame:
    """Versions of which some are there twice: every 13th person's current one again
    under another key, every 17th's none."""
    k = F.col("customer_unique_id").cast("long")
    again = s.dim_customer.filter((k % 13 == 0) & F.col("is_current")).withColumns({"customer_sk": F.col("customer_sk") + 1, "is_current": F.lit(False)})
    return s.dim_customer.unionByName(again).withColumn("is_current", F.col("is_current") & (k % 17 != 0))


query("scd2_integrity_violations", """, wrong AS (
  SELECT customer_unique_id, effective_from, effective_to, is_current AND CAST(customer_unique_id AS BIGINT) % 17 <> 0 AS is_current, row_number() OVER () AS v FROM (
    SELECT * FROM dim_customer UNION ALL SELECT * REPLACE (false AS is_current) FROM dim_customer WHERE CAST(customer_unique_id AS BIGINT) % 13 = 0 AND is_current)
), per AS (SELECT customer_unique_id, count(*) AS versions, CAST(count_if(is_current) AS BIGINT) AS current_versions FROM wrong GROUP BY 1
), laps AS (SELECT a.customer_unique_id, count(*) AS n FROM wrong a JOIN wrong b ON a.customer_unique_id = b.customer_unique_id AND a.v <> b.v AND a.effective_from < b.effective_to AND b.effective_from < a.effective_to GROUP BY 1)
SELECT customer_unique_id, versions, current_versions, coalesce(n, 0) AS overlapping_pairs, CASE WHEN current_versions <> 1 THEN 'expected exactly 1 current version' ELSE 'validity windows overlap' END AS violation
FROM per LEFT JOIN laps USING (customer_unique_id) WHERE current_versions <> 1 OR n > 0""")(lambda s: scd2.integrity(_doubled(s)))


def _spoilt(s: Mart) -> tuple[dict[str, DataFrame], dict[tuple[str, str], DataFrame]]:
    """Tables with keys that repeat or are null, and references to nothing."""
    tables, references = s.checked()
    tables["dim_date"] = tables["dim_date"].unionByName(tables["dim_date"].filter("day_of_month = 1"))
    k = F.col("order_id").cast("long")
    tables["fact_order"] = tables["fact_order"].withColumns({"customer_sk": F.when(k % 7 == 0, F.lit(-1)).otherwise(F.col("customer_sk")), "order_id": F.when(k % 11 != 0, F.col("order_id"))})
    tables["dim_seller"] = tables["dim_seller"].filter(F.col("seller_id").cast("long") % 5 != 0)
    return tables, references


query("constraint_violations", """SELECT * FROM (
  SELECT 'pk_dim_date' AS constraint_name, (SELECT count(*) FROM dim_date WHERE day_of_month = 1) AS violations
  UNION ALL SELECT 'pk_fact_order', (SELECT CAST(count(*) > 0 AS BIGINT) FROM c_orders WHERE CAST(order_id AS BIGINT) % 11 = 0)
  UNION ALL SELECT 'fk_fact_order_customer_sk', (SELECT count(*) FROM c_orders WHERE CAST(order_id AS BIGINT) % 7 = 0)
  UNION ALL SELECT 'fk_fact_order_item_seller_sk', (SELECT count(*) FROM c_items JOIN c_sellers USING (seller_id) WHERE CAST(seller_id AS BIGINT) % 5 = 0)) WHERE violations > 0""")(
    lambda s: checks.constraint_report(*_spoilt(s)).filter("violations > 0")
)

# --- ingestion, tables, streams, generated feeds, from end to end ----------
query("ingest_latest_landed", "SELECT seller_id, CASE WHEN CAST(seller_id AS BIGINT) % 3 = 0 THEN 'corrected ' || seller_city ELSE seller_city END AS seller_city, lower(seller_state) AS seller_state FROM c_sellers")(lambda s: scenarios.landed_twice(s.source))
query("ingest_rescue", "SELECT seller_id, CASE WHEN CAST(seller_id AS BIGINT) % 3 = 0 THEN 'note ' || seller_id END AS note FROM c_sellers")(lambda s: scenarios.rescued(s.source))
query("table_versions", """SELECT 'first' AS version, count(*) AS n, CAST(0 AS BIGINT) AS widened FROM supplier UNION ALL SELECT 'appended', 2 * count(*), 0 FROM supplier
UNION ALL SELECT 'evolved', 2 * count(*) + (SELECT count(*) FROM nation), (SELECT count(*) FROM nation) FROM supplier UNION ALL SELECT 'restored', count(*), 0 FROM supplier""")(lambda s: scenarios.versions(s.source))
simple("dq_probe", "SELECT * FROM (VALUES ('order_items.order_id_not_null', 1::BIGINT), ('order_items.product_id_not_null', 1), ('order_items.price_non_negative', 3), ('order_items.freight_non_negative', 2), ('order_items.item_sequence_positive', 1)) t(rule_id, rows_failed)")(lambda s: scenarios.probed(s.source))
query("events_stream_tumbling", f"SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, {_VALUE} AS value FROM {_ONCE} GROUP BY 1, 2")(lambda s: scenarios.streamed(s.source))
query("events_matched", f"SELECT a.event_id AS event_id, b.event_id AS later_id, a.user_id FROM {_ONCE} a JOIN {_ONCE} b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")(
    lambda s: events.matched(events.once(events.timed(s.source.events())), events.once(events.timed(s.source.events())), "1 hour")
)
query("generated_changes", "SELECT day, op, CASE op WHEN 'U' THEN 41 WHEN 'D' THEN 5 ELSE 3 END::BIGINT AS n, CASE op WHEN 'U' THEN 40 WHEN 'D' THEN 5 ELSE 3 END::BIGINT AS keys FROM (SELECT unnest([1, 2, 3])::INTEGER AS day), (SELECT unnest(['U', 'D', 'I']) AS op)")(lambda s: scenarios.generated(s.source))
query("batch_pipeline", f"""SELECT 'gold.dim_date' AS what, (SELECT count(*) FROM dim_date) AS n UNION ALL SELECT 'gold.dim_product', (SELECT count(*) FROM dim_product) UNION ALL SELECT 'gold.dim_seller', (SELECT count(*) FROM c_sellers)
UNION ALL SELECT 'gold.dim_order_status', (SELECT count(DISTINCT order_status) FROM c_orders) UNION ALL SELECT 'gold.dim_payment_type', (SELECT count(DISTINCT payment_type) FROM c_payments) UNION ALL SELECT 'gold.dim_customer', (SELECT count(*) FROM dim_customer)
UNION ALL SELECT 'gold.fact_order', (SELECT count(*) FROM fact_order) UNION ALL SELECT 'gold.fact_order_item', (SELECT count(*) FROM fact_order_item) UNION ALL SELECT 'gold.fact_payment', (SELECT count(*) FROM fact_payment)
UNION ALL SELECT 'gold tables that the second run changed', 0 UNION ALL SELECT 'differences of fingerprints', 0 UNION ALL SELECT 'tasks that succeeded', 12
UNION ALL SELECT 'first run: rows ingested', 2 * (SELECT count(*) FROM c_orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM c_payments) + (SELECT count(*) FROM c_products) + (SELECT count(*) FROM c_sellers) + (SELECT count(*) FROM c_translation)
UNION ALL SELECT 'second run: rows ingested', 0 UNION ALL SELECT 'first run: changes written', (SELECT count(*) FROM classified WHERE action <> 'unchanged') UNION ALL SELECT 'second run: changes written', 0
UNION ALL SELECT 'duplicate lines', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM c_items) UNION ALL SELECT 'rows with their file and time', (SELECT count(*) FROM c_orders)
UNION ALL SELECT 'rules logged', {sum(r.table != 'order_reviews' for r in rules.RULES)} UNION ALL SELECT 'views', 13""")(lambda s: scenarios.batch_runs(s.source, AS_OF))
query("scd2_row_hashes", "SELECT count(*) AS versions, count(DISTINCT (coalesce(customer_city, '<null>'), coalesce(customer_state, '<null>'), customer_segment)) AS kinds FROM dim_customer")(
    lambda s: s.dim_customer.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("_row_hash").alias("kinds"))
)
query("scd2_version_keys", "SELECT count(*) AS versions, count(*) AS keys FROM dim_customer")(lambda s: s.dim_customer.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("customer_sk").alias("keys")))
simple("project_renamed_and_conformed", "SELECT CAST(s_suppkey AS VARCHAR) AS seller, CAST(s_acctbal AS DECIMAL(12,1))::DOUBLE AS balance FROM supplier")(
    lambda s: cleaning.conform(cleaning.rename(s.source.table("supplier"), {"s_suppkey": "seller", "s_acctbal": "balance", "absent": "x"}), StructType.fromDDL("seller string, balance decimal(12,1)"))
)
simple("filter_between_and_latest", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice BETWEEN 50000 AND 100000 AND CAST(o_orderdate AS DATE) <> DATE '1996-01-02' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")(
    lambda s: _or(s).filter(F.col("o_totalprice").between(50000, 100000) & (F.to_date("o_orderdate") != F.lit("1996-01-02").cast("date"))).orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(1).select("o_orderkey", "o_orderdate")
)
simple("empty_with_schema", "SELECT n_nationkey, n_name FROM nation LIMIT 0")(lambda s: s.source.table("nation").select("n_nationkey", "n_name").limit(0))
simple("rule_registry", "SELECT * FROM (VALUES ('customers', 'reject', 2::BIGINT), ('customers', 'warn', 1), ('order_items', 'reject', 5), ('order_payments', 'reject', 4), ('order_reviews', 'reject', 2), ('orders', 'reject', 4), ('orders', 'warn', 1), ('products', 'reject', 2), ('products', 'warn', 1), ('sellers', 'reject', 1)) t(table_name, severity, n)")(
    lambda s: s.source.spark.createDataFrame([(r.table, r.severity) for r in rules.RULES], "table_name string, severity string").groupBy("table_name", "severity").agg(F.count(F.lit(1)).alias("n"))
)
query("chart_categories", f"SELECT category, row_number() OVER (ORDER BY revenue DESC, category) AS place FROM ({_CATEGORY})")(lambda s: views.charted(views.revenue_by_category(s), "revenue", "category").select("category", "place"))
query("chart_payments_reversed", f"SELECT payment_type, row_number() OVER (ORDER BY total_paid, payment_type) AS place FROM ({_PAYMENTS})")(lambda s: views.charted(views.payment_method_completion(s), "total_paid", "payment_type", True).select("payment_type", "place"))
