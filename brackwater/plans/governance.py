"""Registered queries of contracts over gold, and of files that are routed by their header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.functions import contracts
from brackwater.operators import marts, quality, star
from brackwater.plans import catalog
from brackwater.plans.registry import register
from brackwater.sources import model, readers, sinks


def gold_tables(spark, d) -> dict[str, DataFrame]:
    """Every gold table that a job makes."""
    fact, dim, clicks, products, campaigns = catalog._fact(spark, d), catalog._dim(spark, d), catalog._clicks(spark, d), model.products(spark, d), model.campaigns(spark, d)
    as_of = F.lit("2000-01-01").cast("date")
    return {
        "campaign_effectiveness": marts.campaign_effectiveness(campaigns),
        "conversion_rate": marts.conversion_rate(clicks),
        "customer_clv": marts.customer_clv(fact, dim.filter("is_current"), as_of),
        "customer_segments": marts.customer_segments(fact),
        "daily_sales": marts.daily_sales(fact),
        "dim_campaign": star.dim_campaign(campaigns),
        "dim_customer": star.dim_customer(dim),
        "dim_date": star.dim_date(spark),
        "dim_product": star.dim_product(products),
        "fact_order_items": fact,
        "funnel_conversion": marts.funnel_conversion(clicks),
        "product_sentiment": marts.product_sentiment(marts.silver_reviews(model.reviews(spark, d)), products),
        "quality_gate_summary": catalog.quality_gate_summary(spark, d),
        "quarantine_summary": catalog.quarantine_summary(spark, d),
        "roas": marts.roas(campaigns, fact),
        "top_products": marts.top_products(fact, products),
    }


ROWS_SQL = {
    "campaign_effectiveness": "m_campaigns", "conversion_rate": "conv", "customer_clv": "clv", "customer_segments": "seg", "daily_sales": "sales", "dim_campaign": "m_campaigns", "dim_customer": "m_dim_customer",
    "dim_date": "range(1095)", "dim_product": "m_products", "fact_order_items": "m_fact", "funnel_conversion": "funnel", "product_sentiment": "(SELECT DISTINCT product_id FROM m_reviews)", "quality_gate_summary": "range(3)",
    "quarantine_summary": "qs", "roas": "ro", "top_products": "top",
}
PARTS_SQL = ", ".join((catalog.DAILY_SQL, catalog.TOP_SQL, catalog.SEGMENT_SQL, catalog.CONVERSION_SQL, catalog.CLV_SQL, catalog.FUNNEL_SQL, catalog.ROAS_SQL, catalog.QUARANTINE_SQL))
TWICE_SQL = "".join(f" UNION ALL SELECT * FROM (SELECT 'fact_order_items', 'duplicate:sk_order_id', count(*) - count(DISTINCT order_item_id) AS n FROM m_fact) AS {x} WHERE n > 0" for x in ("t", "u"))
LAST = {name: contracts.contract(f"gold.{name}").fieldNames()[-1] for name in ROWS_SQL}


@register(f", {PARTS_SQL} " + " UNION ALL ".join(f"SELECT '{name}' AS dataset, 'missing:{LAST[name]}' AS violation, count(*) AS row_count FROM {rows}" for name, rows in ROWS_SQL.items()) + TWICE_SQL)
def gold_contracts(spark, d):
    """All gold tables against their contracts, twice: as they are, and without their last column. The given order
    lines repeat some line numbers, so the fact's key is found to be repeated each time."""
    tables = gold_tables(spark, d)
    checks = {name: (df, contracts.contract(f"gold.{name}"), contracts.key_of(f"gold.{name}")) for name, df in tables.items()}
    schemas = {name: df.schema for name, df in tables.items()}
    schemas["fact_order_items"] = T.StructType([T.StructField(f.name, f.dataType) for f in schemas["fact_order_items"]])  # a table's columns may be null
    return quality.contract_report(checks, {name: [whole, T.StructType([f for f in whole if f.name != LAST[name]])] for name, whole in schemas.items()})


@register("SELECT * FROM m_campaigns WHERE campaign_id % 2 = 0")
def header_routing(spark, d):
    """Campaign files by their first line: those with the known header are read, those with another are left."""
    path, campaigns = sinks.scratch(spark, "routed"), model.campaigns(spark, d)
    campaigns.filter("campaign_id % 2 = 0").write.option("header", True).csv(f"{path}/in")
    odd = campaigns.filter("campaign_id % 2 = 1")
    odd.select(*reversed(odd.columns)).write.mode("append").option("header", True).csv(f"{path}/in")
    known, _ = readers.route_by_header(spark, f"{path}/in", ",".join(campaigns.columns))
    files = [r[0] for r in known.collect()]  # paths of one drop folder
    return readers.read_csv(spark, files).drop("ingested_at")
