"""Dimensions and the order-line fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.functions.keys import composite_key, surrogate_key
from brackwater.operators.merge import point_in_time


def dim_date(spark, start: str = "2025-01-01", end: str = "2027-12-31") -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("calendar_date"))
    d = F.col("calendar_date")
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "calendar_date", F.dayofweek(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).alias("week_of_year"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).alias("quarter"), F.year(d).alias("year"), F.dayofweek(d).isin(1, 7).alias("is_weekend"))


def dim_product(products: DataFrame) -> DataFrame:
    return products.select(surrogate_key("postgres", F.col("product_id")).alias("sk_product_id"), "product_id", "sku", F.col("name").alias("product_name"), "category", F.col("unit_price").cast("double").alias("current_price"))


def dim_campaign(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(surrogate_key("csv", F.col("campaign_id")).alias("sk_campaign_id"), "campaign_id", "name", "channel", "start_date", "end_date")


def dim_customer(versions: DataFrame) -> DataFrame:
    """The customers' versions with the key that facts refer to them by."""
    key = composite_key("postgres", F.col("customer_id"), F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss"))
    return versions.select(key.alias("sk_customer_id"), "customer_id", "full_name", "email", "segment", "address", "valid_from", "valid_to", "is_current")


def fact_lines(items: DataFrame, orders: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Order lines with their order, their product and the customer's version at order time: all that the fact is
    made of, without what can be reckoned from it.

    Lines of unknown products or orders, and orders before the first version, have no row here;
    ``unmatched_items`` finds them. The version is found by order, before its lines come to it, and the lines of an
    order end up together.
    """
    dated = point_in_time(orders, customers.select("customer_id", "segment", "valid_from", "valid_to"), "customer_id", "order_date").drop("valid_to")
    lines = items.join(products.select("product_id"), "product_id").join(dated, "order_id")
    return lines.select("order_item_id", "order_id", "customer_id", "order_date", "status", "product_id", "campaign_id", "segment", "valid_from", "quantity", "unit_price")


def with_keys(lines: DataFrame) -> DataFrame:
    """The fact of ``fact_lines``. The line's key is its own id, as an order may repeat a product."""
    return lines.select(
        composite_key("postgres", F.col("order_item_id")).alias("sk_order_id"),
        composite_key("postgres", F.col("order_id"), F.col("product_id")).alias("sk_order_product"),
        composite_key("postgres", F.col("customer_id"), F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss")).alias("sk_customer_id"),
        surrogate_key("postgres", F.col("product_id")).alias("sk_product_id"),
        surrogate_key("csv", F.col("campaign_id")).alias("sk_campaign_id"),
        "order_item_id", "order_id", "customer_id", "order_date", F.date_format("order_date", "yyyyMMdd").cast("int").alias("date_key"), "status", "product_id", "campaign_id", "segment",
        "quantity", "unit_price", (F.col("quantity") * F.col("unit_price")).alias("line_total"))


def fact_order_items(items: DataFrame, orders: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Order lines of known products and orders with their keys (see ``fact_lines``)."""
    return with_keys(fact_lines(items, orders, products, customers))


def unmatched_items(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines that no fact can be made of, with the reason."""
    no_product = items.join(products.select("product_id"), "product_id", "left_anti").withColumn("_quarantine_reason", F.lit("unknown_product"))
    no_order = items.join(orders.select("order_id"), "order_id", "left_anti").withColumn("_quarantine_reason", F.lit("unknown_order"))
    return no_product.select(*items.columns, "_quarantine_reason").unionByName(no_order.select(*items.columns, "_quarantine_reason"))
