"""The tables' contracts: columns, types and keys of bronze, silver, gold and quarantine."""

from __future__ import annotations

from pyspark.sql import types as T

from brackwater.functions.schemas import fields

#: Columns by table, as fixed values; ``!`` marks a column that is never null, which is the table's key.
BRONZE = {
    "campaigns": "campaign_id! bigint, name string, channel string, start_date date, end_date date, budget double, spend double, clicks bigint, conversions bigint, ingested_at timestamp",
    "clickstream": "event_id string, session_id string, event_type string, product_id bigint, customer_id bigint, ts timestamp",
    "dead_letters": "value string, source_topic string, failed_at timestamp",
    "order_items": "order_item_id! bigint, order_id bigint, product_id bigint, quantity int, unit_price money, ingested_at timestamp",
    "orders_cdc": "table_name string, op string, pk_column string, pk_value string, data_json string, captured_at timestamp",
    "products": "product_id! bigint, sku string, name string, category string, unit_price money, created_at timestamp, updated_at timestamp, ingested_at timestamp",
    "reviews": "review_id! string, product_id bigint, customer_id bigint, rating int, title string, body string, verified_purchase boolean, submitted_at timestamp, ingested_at timestamp",
}
SILVER = {
    "campaigns": "campaign_id! bigint, name string, channel string, start_date date, end_date date, budget double, spend double, clicks bigint, conversions bigint, ingested_at timestamp",
    "clickstream": "event_id string, session_id string, event_type string, product_id bigint, customer_id bigint, ts timestamp",
    "customers": "customer_id! bigint, full_name string, email string, segment string, address string, updated_at timestamp, captured_at timestamp",
    "order_items": "order_item_id! bigint, order_id bigint, product_id bigint, quantity int, unit_price money",
    "orders": "order_id! bigint, customer_id bigint, order_date timestamp, status string, campaign_id bigint, captured_at timestamp",
    "products": "product_id! bigint, sku string, name string, category string, unit_price money, updated_at timestamp",
    "reviews": "review_id! string, product_id bigint, customer_id bigint, rating int, title string, body string, verified_purchase boolean, submitted_at timestamp, ingested_at timestamp, sentiment_score double",
}
GOLD = {
    "campaign_effectiveness": "campaign_id! bigint, name string, channel string, spend double, clicks bigint, conversions bigint, cost_per_conversion double",
    "conversion_rate": "activity_date date, sessions bigint, checkout_completions bigint, conversion_rate double",
    "customer_clv": "customer_id! bigint, full_name string, total_orders bigint, total_spend double, first_order_date date, last_order_date date, avg_order_value double, days_since_last_order int, segment string",
    "customer_segments": "segment string, customer_count bigint, total_revenue double, avg_order_value double",
    "daily_sales": "sales_date date, order_count bigint, total_revenue double, revenue_7d_avg double, revenue_30d_avg double",
    "dim_campaign": "sk_campaign_id! string, campaign_id bigint, name string, channel string, start_date date, end_date date",
    "dim_customer": "sk_customer_id! string, customer_id bigint, full_name string, email string, segment string, address string, valid_from timestamp, valid_to timestamp, is_current boolean",
    "dim_date": "date_key! int, calendar_date date, day_of_week int, day_name string, week_of_year int, month int, month_name string, quarter int, year int, is_weekend boolean",
    "dim_product": "sk_product_id! string, product_id bigint, sku string, product_name string, category string, current_price double",
    "fact_order_items": "sk_order_id! string, order_id bigint, sk_customer_id string, customer_id bigint, order_date timestamp, date_key int, status string, product_id bigint, sk_product_id string, quantity bigint, unit_price double, line_total double, campaign_id bigint, sk_campaign_id string",
    "fact_orders": "sk_order_id string, order_id bigint, customer_id bigint, order_date timestamp, date_key int, status string, product_id bigint, sk_product_id string, quantity bigint, unit_price double, line_total double, campaign_id bigint, sk_campaign_id string",
    "funnel_conversion": "activity_date date, page_view bigint, add_to_cart bigint, checkout_start bigint, checkout_complete bigint, cart_to_checkout_rate double, checkout_to_purchase_rate double",
    "product_sentiment": "product_id! bigint, review_count bigint, avg_rating double, avg_sentiment double, pct_verified double, product_name string, category string",
    "quality_gate_summary": "batch_date date, table_name string, passed_count bigint, quarantined_count bigint",
    "quarantine_summary": "batch_date date, table_name string, failure_reason string, row_count bigint",
    "roas": "campaign_id bigint, name string, channel string, start_date date, end_date date, spend double, attributed_revenue double, roas double",
    "top_products": "product_id bigint, product_name string, sku string, category string, units_sold bigint, revenue double, rank_in_category int",
}
#: Quarantines hold the columns of these tables and the reason.
QUARANTINE = {"campaigns": SILVER, "clickstream": SILVER, "customers": SILVER, "fact_order_items": GOLD, "order_items": SILVER, "orders": SILVER, "products": SILVER, "reviews": SILVER}
#: The quarantine of a table that no job fills any more, and a time that quarantine keeps as it came.
LEFT_OVER = {"order_facts": GOLD["fact_orders"].replace("order_id bigint", "order_id! bigint", 1)}
AS_IT_CAME = {"customers": ("updated_at timestamp", "updated_at string")}


def _text(name: str) -> str:
    layer, _, table = name.partition(".")
    if layer != "quarantine":
        return {"bronze": BRONZE, "silver": SILVER, "gold": GOLD}[layer][table]
    own = LEFT_OVER[table] if table in LEFT_OVER else QUARANTINE[table][table]
    return own.replace(*AS_IT_CAME.get(table, ("", ""))) + ", _quarantine_reason string"


def names() -> list[str]:
    """All tables that have a contract."""
    layers = {"bronze": BRONZE, "silver": SILVER, "gold": GOLD, "quarantine": QUARANTINE | LEFT_OVER}
    return sorted(f"{layer}.{t}" for layer, tables in layers.items() for t in tables)


def contract(name: str) -> T.StructType:
    """The contract of ``layer.table``."""
    return fields(_text(name))


def key_of(name: str) -> str | None:
    """The key of ``layer.table``; None where it has none."""
    return next((f.name for f in contract(name) if not f.nullable), None)
