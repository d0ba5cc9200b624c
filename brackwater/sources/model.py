"""The lakehouse's inputs, derived from the given tables by fixed expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "placed").otherwise("shipped")
    campaign = F.when(F.col("o_orderkey") % 10 < 3, F.expr("(o_orderkey div 10) % 50 + 1"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_date"), status.alias("status"), campaign.alias("campaign_id"))


def order_items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS order_item_id", "l_orderkey AS order_id", "l_partkey AS product_id", "CAST(l_quantity AS INT) AS quantity", "CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price")


def noisy_items(spark, sf_dir):
    """Order lines with the kinds of noise that the gate is there for."""
    return order_items(spark, sf_dir).selectExpr("order_item_id", "order_id", "IF(order_id % 89 = 0, NULL, product_id) AS product_id", "IF(order_id % 97 = 0, -quantity, quantity) AS quantity", "CAST(IF(order_id % 83 = 0, -unit_price, unit_price) AS DECIMAL(10,2)) AS unit_price")


def products(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS product_id", "concat(p_brand, '-', p_partkey) AS sku", "p_name AS name", "p_type AS category", "CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price")


def customers(spark, sf_dir):
    """The first snapshot of the customers."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS customer_id", "c_name AS full_name", "concat(lower(c_name), '@shop.test') AS email", "c_mktsegment AS segment", "concat('nation ', c_nationkey) AS address", "timestamp_ntz'1990-01-01 00:00:00' AS updated_at")


def changed_customers(spark, sf_dir):
    """The second snapshot: another segment for every seventh customer, and nothing new for the rest."""
    seventh = F.col("customer_id") % 7 == 0
    return customers(spark, sf_dir).withColumn("segment", F.when(seventh, "VIP").otherwise(F.col("segment"))).withColumn("updated_at", F.expr("timestamp_ntz'1998-01-01 00:00:00'"))


def campaigns(spark, sf_dir):
    """One campaign per supplier."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey + 1 AS campaign_id", "s_name AS name", "CASE s_suppkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'search' ELSE 'social' END AS channel",
        "date_add(date'1995-01-01', CAST(s_suppkey % 1000 AS INT)) AS start_date", "date_add(date'1995-02-01', CAST(s_suppkey % 1000 AS INT)) AS end_date",
        "CAST(1000 + s_suppkey * 10 AS DOUBLE) AS budget", "CAST(IF(s_suppkey % 10 = 0, 0, 100 + s_suppkey) AS DOUBLE) AS spend", "s_suppkey * 37 AS clicks", "IF(s_suppkey % 7 = 0, 0, s_suppkey * 3) AS conversions")


def noisy_tables(spark, sf_dir):
    """The seven tables that have a quarantine, with the noise that the gate is there for."""
    return {
        "fact_order_items": noisy_items(spark, sf_dir).join(orders(spark, sf_dir).select("order_id", "customer_id", "order_date"), "order_id"),
        "orders": orders(spark, sf_dir).withColumn("captured_at", F.col("order_date")).withColumn("customer_id", F.when(F.col("order_id") % 79 != 0, F.col("customer_id"))),
        "campaigns": campaigns(spark, sf_dir).withColumn("budget", F.when(F.col("campaign_id") % 11 == 0, -F.col("budget")).otherwise(F.col("budget"))),
        "reviews": reviews(spark, sf_dir).withColumn("rating", F.when(F.col("review_id") % 13 == 0, F.lit(7)).otherwise(F.col("rating"))),
        "customers": customers(spark, sf_dir).withColumn("captured_at", F.col("updated_at")).withColumn("customer_id", F.when(F.col("customer_id") % 17 != 0, F.col("customer_id"))),
        "products": products(spark, sf_dir).withColumn("updated_at", F.expr("date_add(date'1995-01-01', CAST(product_id % 100 AS INT))")).withColumn("sku", F.when(F.col("product_id") % 19 != 0, F.col("sku"))).withColumn("unit_price", F.when(F.col("product_id") % 23 == 0, -F.col("unit_price")).otherwise(F.col("unit_price"))),
        "clickstream": clickstream(spark, sf_dir),
    }


KINDS = {"view": "page_view", "click": "add_to_cart", "signup": "checkout_start", "purchase": "checkout_complete"}


def clickstream(spark, sf_dir):
    kind = F.col("event_type")
    for old, new in KINDS.items():
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    kind = F.when((F.col("event_type") == "click") & (F.col("event_id") % 5 == 0), "remove_from_cart").otherwise(kind)
    return table(spark, sf_dir, "events").select("event_id", F.expr("concat(user_id, '-', date_format(ts, 'yyyyMMdd'))").alias("session_id"), kind.alias("event_type"), (F.col("event_id") % 200).alias("product_id"), F.col("user_id").alias("customer_id"), "ts")


def reviews(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").selectExpr(
        "doc_id AS review_id", "doc_id % 200 AS product_id", "CAST(1 + doc_id % 5 AS INT) AS rating", "text AS body", "quality = 1 AS verified_purchase", "timestampadd(MINUTE, CAST(doc_id % 100000 AS INT), timestamp_ntz'2024-01-01 00:00:00') AS submitted_at")


def change_log(spark, sf_dir):
    """A CDC log of orders: an insert for each, a later update for every third, and one that comes
    late with an older time for every ninth."""
    base = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderdate AS created_at", "o_orderdate AS updated_at", "'placed' AS status", "CASE WHEN o_orderkey % 10 < 3 THEN (o_orderkey div 10) % 50 + 1 END AS campaign_id")
    later = base.filter("order_id % 3 = 0").withColumn("status", F.lit("shipped")).withColumn("updated_at", F.expr("updated_at + INTERVAL 2 DAYS"))
    stale = base.filter("order_id % 9 = 0").withColumn("status", F.lit("cancelled")).withColumn("updated_at", F.expr("updated_at + INTERVAL 1 DAY"))
    return base.unionByName(later).unionByName(stale)


#: The same inputs for DuckDB, as common table expressions.
MODEL_SQL = """WITH
m_orders AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'placed' ELSE 'shipped' END AS status,
  CASE WHEN o_orderkey % 10 < 3 THEN (o_orderkey // 10) % 50 + 1 END AS campaign_id FROM orders),
m_items AS (SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
  CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price FROM lineitem),
m_noisy AS (SELECT order_item_id, order_id, CASE WHEN order_id % 89 <> 0 THEN product_id END AS product_id,
  CASE WHEN order_id % 97 = 0 THEN -quantity ELSE quantity END AS quantity,
  CASE WHEN order_id % 83 = 0 THEN -unit_price ELSE unit_price END AS unit_price FROM m_items),
m_products AS (SELECT p_partkey AS product_id, p_brand || '-' || p_partkey AS sku, p_name AS name, p_type AS category,
  CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price FROM part),
m_customers AS (SELECT c_custkey AS customer_id, c_name AS full_name, lower(c_name) || '@shop.test' AS email, c_mktsegment AS segment,
  'nation ' || c_nationkey AS address FROM customer),
m_dim_customer AS (
  SELECT *, TIMESTAMP '1990-01-01' AS valid_from, CASE WHEN customer_id % 7 = 0 AND segment <> 'VIP' THEN TIMESTAMP '1998-01-01' END AS valid_to FROM m_customers
  UNION ALL SELECT customer_id, full_name, email, 'VIP', address, TIMESTAMP '1998-01-01', NULL FROM m_customers WHERE customer_id % 7 = 0 AND segment <> 'VIP'),
m_campaigns AS (SELECT s_suppkey + 1 AS campaign_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'search' ELSE 'social' END AS channel,
  DATE '1995-01-01' + CAST(s_suppkey % 1000 AS INTEGER) AS start_date, DATE '1995-02-01' + CAST(s_suppkey % 1000 AS INTEGER) AS end_date,
  CAST(1000 + s_suppkey * 10 AS DOUBLE) AS budget, CAST(CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 100 + s_suppkey END AS DOUBLE) AS spend,
  s_suppkey * 37 AS clicks, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey * 3 END AS conversions FROM supplier),
m_clicks AS (SELECT event_id, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'remove_from_cart' ELSE 'add_to_cart' END WHEN 'signup' THEN 'checkout_start' WHEN 'purchase' THEN 'checkout_complete' ELSE event_type END AS event_type,
  event_id % 200 AS product_id, user_id AS customer_id, ts FROM events),
m_reviews AS (SELECT doc_id AS review_id, doc_id % 200 AS product_id, CAST(1 + doc_id % 5 AS INTEGER) AS rating, text AS body, quality = 1 AS verified_purchase,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id % 100000) AS submitted_at FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
m_base AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS created_at, o_orderdate AS updated_at, 'placed' AS status,
  CASE WHEN o_orderkey % 10 < 3 THEN (o_orderkey // 10) % 50 + 1 END AS campaign_id FROM orders),
m_log AS (SELECT * FROM m_base UNION ALL SELECT order_id, customer_id, created_at, updated_at + INTERVAL 2 DAY, 'shipped', campaign_id FROM m_base WHERE order_id % 3 = 0
  UNION ALL SELECT order_id, customer_id, created_at, updated_at + INTERVAL 1 DAY, 'cancelled', campaign_id FROM m_base WHERE order_id % 9 = 0),
m_fact AS (SELECT i.order_item_id, o.order_id, o.customer_id, o.order_date, o.status, o.campaign_id, i.product_id, i.quantity, i.unit_price, i.quantity * i.unit_price AS line_total, c.segment, c.valid_from
  FROM m_items i JOIN m_orders o USING (order_id) JOIN m_products p ON p.product_id = i.product_id
  JOIN m_dim_customer c ON c.customer_id = o.customer_id AND o.order_date >= c.valid_from AND (c.valid_to IS NULL OR o.order_date < c.valid_to))
"""
