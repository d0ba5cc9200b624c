"""Quality rules, the gate with its quarantine, contracts and summaries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REASON = "_quarantine_reason"

#: Rules by dataset: required columns, and inclusive bounds. Fixed values.
RULES: dict[str, tuple[tuple[str, ...], dict[str, tuple[float | None, float | None]]]] = {
    "campaigns": (("campaign_id", "name", "start_date", "end_date"), {"budget": (0, None), "spend": (0, None), "clicks": (0, None), "conversions": (0, None)}),
    "customers": (("customer_id",), {}),
    "orders": (("order_id", "customer_id", "order_date"), {}),
    "reviews": (("review_id", "product_id", "rating"), {"rating": (1, 5)}),
    "order_items": (("order_item_id", "order_id", "product_id"), {"quantity": (1, None), "unit_price": (0, None)}),
    "products": (("product_id", "sku"), {"unit_price": (0, None)}),
    "clickstream": (("session_id", "event_type", "ts"), {}),
    "fact_order_items": (("order_id", "customer_id", "product_id"), {"unit_price": (0, None), "quantity": (1, None)}),
    "bronze.order_items": (("order_item_id", "order_id", "ingested_at"), {"quantity": (1, None), "unit_price": (0, None)}),
    "bronze.products": (("product_id", "sku", "ingested_at"), {"unit_price": (0, None)}),
    "silver.order_items": (("order_item_id", "order_id"), {"quantity": (1, None), "unit_price": (0, None)}),
}
NONE = ((), {})
#: Layers whose tables share the rules of their plain name; all other tables pass whole.
SHARED = {"bronze": ("campaigns",), "silver": ("clickstream", "customers", "orders", "products", "reviews"), "gold": ("fact_order_items",)}


def rules_of(dataset: str) -> tuple[tuple[str, ...], dict[str, tuple[float | None, float | None]]]:
    """The rules of ``layer.table`` or of a plain table name; a table that has none passes whole."""
    if dataset in RULES:
        return RULES[dataset]
    layer, _, name = dataset.partition(".")
    return RULES[name] if name in SHARED.get(layer, ()) else NONE


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def fails_null(columns) -> Column:
    return _any([F.col(c).isNull() for c in columns])


def fails_range(bounds, null_fails: bool = False) -> Column:
    """A value outside its inclusive bounds. A null passes, unless ``null_fails``: it is never lost."""
    tests = []
    for name, (low, high) in bounds.items():
        if low is not None:
            tests.append(F.coalesce(F.col(name) < low, F.lit(null_fails)))
        if high is not None:
            tests.append(F.coalesce(F.col(name) > high, F.lit(null_fails)))
    return _any(tests)


def tagged(df: DataFrame, dataset: str, null_fails: bool = False) -> DataFrame:
    """``df`` with the reason of its quarantine: null for a row that passes."""
    required, bounds = rules_of(dataset)
    missing = {*required, *bounds} - set(df.columns)
    if missing:
        raise ValueError(f"{dataset} lacks the columns of its rules: {sorted(missing)}")
    reasons = F.concat_ws(",", F.when(fails_null(required), "null_check_failed"), F.when(fails_range(bounds, null_fails), "range_check_failed"))
    return df.withColumn(REASON, F.when(reasons != "", reasons))


def gate(df: DataFrame, dataset: str, null_fails: bool = False) -> tuple[DataFrame, DataFrame]:
    """(passed, quarantined): every row is in exactly one of them."""
    marked = tagged(df, dataset, null_fails)
    return marked.filter(F.col(REASON).isNull()).drop(REASON), marked.filter(F.col(REASON).isNotNull())


def in_domain(df: DataFrame, column: str, values, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a known value, and the others (nulls too) with a reason."""
    known = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.filter(known), df.filter(~known).withColumn(REASON, F.lit(reason))


def reconcile(source: DataFrame, *landed: DataFrame) -> DataFrame:
    """One row: how many rows came, how many landed, and whether the counts agree."""
    sides = [source.select(F.lit(0).alias("side"))] + [d.select(F.lit(1).alias("side")) for d in landed]
    both = reduce(DataFrame.unionAll, sides).agg(F.count_if(F.col("side") == 0).alias("source_rows"), F.count_if(F.col("side") == 1).alias("landed_rows"))
    return both.withColumn("ok", F.col("source_rows") == F.col("landed_rows"))


def gate_summary(marked: dict[str, DataFrame], batch_date: Column) -> DataFrame:
    """One row per dataset: passed and quarantined counts, in one aggregation over all of them."""
    rows = reduce(DataFrame.unionAll, [d.select(F.lit(n).alias("table_name"), F.col(REASON)) for n, d in marked.items()])
    return rows.groupBy("table_name").agg(F.count_if(F.col(REASON).isNull()).alias("passed_count"), F.count_if(F.col(REASON).isNotNull()).alias("quarantined_count")).withColumn("batch_date", batch_date)


def quarantine_summary(quarantined: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows by date, table and reason; each table has its own date column."""
    rows = reduce(DataFrame.unionAll, [d.select(F.to_date(c).alias("batch_date"), F.lit(n).alias("table_name"), F.col(REASON).alias("failure_reason")) for n, (d, c) in quarantined.items()])
    return rows.groupBy("batch_date", "table_name", "failure_reason").agg(F.count("*").alias("row_count"))


def held_rows(quarantined: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """(table_name, row_key, batch_date, failure_reason) of quarantined rows; each table has its key and its own date."""
    return reduce(DataFrame.unionAll, [d.select(F.lit(n).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.to_date(date).alias("batch_date"), F.col(REASON).alias("failure_reason")) for n, (d, key, date) in quarantined.items()])


WIDENS = {("int", "bigint"), ("float", "double")}


def schema_violations(schema: T.StructType, contract: T.StructType, evolution: str = "backward") -> list[str]:
    """What a schema has against a contract: types (widening allowed), missing and extra columns."""
    own = {f.name: f for f in schema.fields}
    wrong = []
    for f in contract.fields:
        if f.name not in own:
            wrong.append(f"missing:{f.name}")
            continue
        a, b = own[f.name].dataType.simpleString(), f.dataType.simpleString()
        if a != b and (a, b) not in WIDENS and not (a.startswith("decimal") and b in ("double", "float")) and not (a.startswith("timestamp") and b.startswith("timestamp")):
            wrong.append(f"type:{f.name}:{a}:{b}")
    for name in sorted(own.keys() - {f.name for f in contract.fields}):
        if evolution == "none" or not own[name].nullable:
            wrong.append(f"extra:{name}")
    return wrong


def contract_violations(df: DataFrame, required, keys) -> DataFrame:
    """(rule, violations): nulls in required columns, and rows beyond the first of a primary key."""
    nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required))
    stacked = nulls.select(F.inline(F.array(*(F.struct(F.lit(f"null:{c}").alias("rule"), F.col(c).alias("violations")) for c in required))))
    again = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations"))
    return stacked.unionByName(again.select(F.lit("duplicate:" + ",".join(keys)).alias("rule"), "violations"))


def contract_report(checks: dict[str, tuple[DataFrame, T.StructType, str | None]], schemas: dict[str, list[T.StructType]] | None = None) -> DataFrame:
    """(dataset, violation, row_count): what each frame's schema has against its contract, with the rows that it
    concerns, and rows without a key or with one that came before. A dataset that keeps its contract has no row;
    one without a key, or whose key column is missing, is checked by its schema only. With ``schemas`` (of some of its
    columns each) a frame is checked as each of them in the place of its own, and its rows are counted once for all."""

    def rows(name: str, df: DataFrame, contract: T.StructType, key: str | None) -> DataFrame:
        wrong, seen = [], (schemas or {}).get(name, [df.schema])
        for schema in seen:
            wrong += [F.struct(F.lit(v).alias("violation"), F.col("n").alias("row_count")) for v in schema_violations(schema, contract)]
            if key in schema.names:
                wrong.append(F.struct(F.lit(f"null:{key}").alias("violation"), F.col("nulls").alias("row_count")))
                wrong.append(F.struct(F.lit(f"duplicate:{key}").alias("violation"), (F.col("n") - F.col("nulls") - F.col("keys")).alias("row_count")))
        if not any(key in schema.names for schema in seen):
            counts = df.agg(F.count("*").alias("n"))
        else:
            counts = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count(key).alias("keys"))
        none = F.array().cast("array<struct<violation:string,row_count:bigint>>")
        return counts.select(F.lit(name).alias("dataset"), F.inline(F.array(*wrong) if wrong else none))

    return reduce(DataFrame.unionAll, [rows(n, *check) for n, check in checks.items()]).filter("row_count > 0")
