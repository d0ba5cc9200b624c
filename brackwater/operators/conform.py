"""Bronze rows made to fit silver: casts, JSON payloads, latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brackwater.functions.schemas import fields
from brackwater.operators.merge import latest_per_key

ORDER_PAYLOAD = fields("order_id bigint, customer_id bigint, order_date string, status string, campaign_id bigint")
CUSTOMER_PAYLOAD = fields("customer_id bigint, full_name string, email string, segment string, address string, updated_at string")
# fixed values: the events that silver knows
EVENT_TYPES = ("page_view", "add_to_cart", "remove_from_cart", "checkout_start", "checkout_complete")


def conform_products(df: DataFrame) -> DataFrame:
    return df.select(F.col("product_id").cast("long").alias("product_id"), "sku", "name", "category", F.col("unit_price").cast("decimal(10,2)").alias("unit_price")).filter("product_id is not null and sku is not null")


def conform_order_items(df: DataFrame, *order) -> DataFrame:
    """The latest row per order line, cast; rows without an id are left out."""
    latest = latest_per_key(df, ["order_item_id"], *order)
    return latest.selectExpr("CAST(order_item_id AS BIGINT) order_item_id", "CAST(order_id AS BIGINT) order_id", "CAST(product_id AS BIGINT) product_id", "CAST(quantity AS INT) quantity", "CAST(unit_price AS DECIMAL(10,2)) unit_price").filter("order_item_id is not null and order_id is not null and product_id is not null")


def payloads(log: DataFrame, table: str, schema: StructType) -> DataFrame:
    """The log's rows of one table with their JSON payload as columns; bad JSON gives nulls."""
    return log.filter(F.col("table_name") == table).select("op", "captured_at", F.from_json("data_json", schema).alias("p")).select("op", "captured_at", "p.*")


def latest_orders(log: DataFrame) -> DataFrame:
    """Current orders from the change log."""
    rows = payloads(log, "orders", ORDER_PAYLOAD).withColumn("order_date", F.try_to_timestamp("order_date").cast("timestamp_ntz"))
    return latest_per_key(rows.filter("order_id is not null"), ["order_id"], F.desc("captured_at"), F.asc("status")).drop("op")


def latest_customers(log: DataFrame) -> DataFrame:
    rows = payloads(log, "customers", CUSTOMER_PAYLOAD).withColumn("updated_at", F.try_to_timestamp("updated_at").cast("timestamp_ntz"))
    return latest_per_key(rows.filter("customer_id is not null"), ["customer_id"], F.desc("captured_at"), F.asc("segment")).drop("op")


def distinct_events(df: DataFrame) -> DataFrame:
    """Known events, each once however often it came: the earliest, and of equal times the least session."""
    return latest_per_key(df.filter(F.col("event_type").isin(list(EVENT_TYPES))), ["event_id"], F.asc_nulls_last("ts"), F.asc("session_id"))


def latest_campaigns(df: DataFrame) -> DataFrame:
    """The row of each campaign that was ingested last; equal times are settled by the larger spend."""
    return latest_per_key(df.filter("campaign_id is not null"), ["campaign_id"], F.desc_nulls_last("ingested_at"), F.desc("spend"))
