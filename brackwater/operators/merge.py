"""Latest-state collapse, keyed upserts and slowly changing dimensions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "valid_to"


def latest_per_key(df: DataFrame, keys, *order: Column) -> DataFrame:
    """The row of each key that comes first in ``order``; give enough columns to break all ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def merge_upsert(target: DataFrame, source: DataFrame, keys, version: str | None = None) -> DataFrame:
    """Rows of the source replace rows of the target with their key, others stay or are added.

    With a version column, a source row older than the target's row is left out. Of source rows with
    one key the newest version is taken, and of equal ones the greatest by all other columns.
    """
    rest = [F.desc(c) for c, kind in source.dtypes if c not in keys and c != version and not kind.startswith(("map", "struct", "array", "variant"))]
    source = latest_per_key(source, keys, *([F.desc(version)] if version else []), *(rest or [F.asc(k) for k in keys]))
    if version:
        held = target.select(*keys, F.col(version).alias("held_"))
        source = source.join(held, list(keys), "left").filter(F.col("held_").isNull() | (F.col(version) >= F.col("held_"))).drop("held_")
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source)


def scd2_merge(dim: DataFrame, incoming: DataFrame, key: str, tracked, valid_time: str) -> DataFrame:
    """``dim`` (key, tracked, valid_from, valid_to, is_current) after one row per key has come in.

    A new key is inserted, an equal row changes nothing, a changed one closes the current version
    and opens another; a key without a current version gets one; a change that isn't later than
    the current version is ignored (see ``stale_changes``).
    """
    current = dim.filter("is_current").select(F.col(key), F.col("valid_from").alias("from_"), *(F.col(c).alias(f"{c}_") for c in tracked))
    joined = incoming.select(key, *tracked, F.col(valid_time).alias("at_")).join(current, key, "left")
    changed = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"{c}_")) for c in tracked])
    opens = joined.filter(F.col("from_").isNull() | (changed & (F.col("at_") > F.col("from_"))))
    closing = opens.filter(F.col("from_").isNotNull()).select(key, F.col("at_").alias("closed_"))
    kept = dim.join(closing, key, "left")
    ends = F.col("is_current") & F.col("closed_").isNotNull()
    kept = kept.withColumn("valid_to", F.when(ends, F.col("closed_")).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & ~ends).drop("closed_")
    new = opens.select(key, *tracked, F.col("at_").alias("valid_from"), F.lit(None).cast(dim.schema["valid_to"].dataType).alias("valid_to"), F.lit(True).alias("is_current"))
    return kept.select(new.columns).unionByName(new)


def with_valid_time(incoming: DataFrame, run_time: Column, *candidates: str) -> DataFrame:
    """``incoming`` with valid_at: the first of the candidate columns that it has and that isn't null, else
    the time of the run."""
    return incoming.withColumn("valid_at", F.coalesce(*(F.col(c) for c in candidates if c in incoming.columns), run_time))


def scd2_start(incoming: DataFrame, key: str, tracked, valid_time: str) -> DataFrame:
    """A dimension of first versions."""
    at = F.col(valid_time)
    return incoming.select(key, *tracked, at.alias("valid_from"), F.lit(None).cast(incoming.schema[valid_time].dataType).alias("valid_to"), F.lit(True).alias("is_current"))


def stale_changes(dim: DataFrame, incoming: DataFrame, key: str, valid_time: str) -> DataFrame:
    """One row: how many incoming rows aren't later than the current version of their key."""
    current = dim.filter("is_current").select(key, "valid_from")
    return incoming.join(current, key).filter(F.col(valid_time) <= F.col("valid_from")).agg(F.count("*").alias("stale"))


def current_invariant(dim: DataFrame, key: str, evidence: int = 5) -> DataFrame:
    """Keys with more than one current version; a few of them, as evidence."""
    return dim.filter("is_current").groupBy(key).agg(F.count("*").alias("versions")).filter("versions > 1").orderBy(key).limit(evidence)


def point_in_time(facts: DataFrame, dim: DataFrame, key: str, at: str, how: str = "inner") -> DataFrame:
    """Facts with the version of their dimension row that held at their time: [from, to)."""
    held = dim.withColumnRenamed(key, "dim_key_")
    on = (facts[key] == held["dim_key_"]) & (facts[at] >= held["valid_from"]) & (held["valid_to"].isNull() | (facts[at] < held["valid_to"]))
    return facts.join(held, on, how).drop("dim_key_")
