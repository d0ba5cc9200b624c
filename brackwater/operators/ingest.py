"""Incremental ingest, change capture and backfill windows."""

from __future__ import annotations

import uuid
from datetime import date, timedelta
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.sources import files, readers

PAGE = 5_000


def incremental(source: DataFrame, landed: DataFrame | None, column: str) -> DataFrame:
    """Source rows beyond the largest value that has landed; all of them where nothing has.

    The watermark is one scalar, so the filter can be pushed into the scan. Where the source has
    nothing beyond it, no row is read.
    """
    mark = landed.agg(F.max(column)).first()[0] if landed is not None else None
    return source if mark is None else source.filter(F.col(column) > F.lit(mark))


def max_id(source: DataFrame, column: str, allowed) -> DataFrame:
    """One row: the largest id of an allowed column as upper_bound, 1 for an empty source."""
    if column not in allowed:
        raise ValueError(f"{column} is not one of {sorted(allowed)}")
    return source.agg(F.coalesce(F.max(column), F.lit(1)).alias("upper_bound"))


def extract_changes(df: DataFrame, watermark, updated: str = "updated_at", pk: str | None = None, after_pk=None) -> DataFrame:
    """Rows changed after the watermark; with a key, also those of the same instant and a larger key."""
    newer = F.col(updated) > F.lit(watermark)
    if pk is not None and after_pk is not None:
        newer = newer | ((F.col(updated) == F.lit(watermark)) & (F.col(pk) > F.lit(after_pk)))
    return df.filter(newer)


class ChangePoll:
    """Pages of changed rows in the order of (updated, key), each landed whole before the watermark moves.

    A page is the first ``page`` rows behind the watermark, which is the last row of the page before. It is
    written to a folder of its own number, and then the watermark file of that number is moved into place:
    a run that breaks off between the two lands the same page again in the same place, so nothing is lost
    or doubled. Readers see pages up to the watermark. Rows that share both time and key with the
    watermark have been landed; rows without either are never polled.

    One page costs a scan of the source, so a backlog isn't taken page by page: ``land_all`` sorts what is
    behind the watermark once, cuts it into the same pages and lands them together.
    """

    def __init__(self, source: DataFrame, root: str, updated: str, key: str, page: int = PAGE):
        if "page" in source.columns:
            raise ValueError("page is the name of the pages' folders")
        self.source, self.root, self.updated, self.key, self.page = source, root.rstrip("/"), updated, key, page
        self.spark = source.sparkSession

    def _with(self, name: str, kind: T.DataType) -> T.StructType:
        return T.StructType([*self.source.schema.fields, T.StructField(name, kind)])

    def mark(self) -> dict:
        """The watermark: page, and the time and key of the last row that has landed, as text."""
        there = files.numbers(self.spark, f"{self.root}/marks")
        return files.read_json(self.spark, files.numbered(f"{self.root}/marks", there[-1])) if there else {"page": 0}

    def behind(self, mark: dict) -> DataFrame:
        rows = self.source.filter(F.col(self.updated).isNotNull() & F.col(self.key).isNotNull())
        if not mark["page"]:
            return rows
        at, key = (F.lit(mark[c]).cast(self.source.schema[n].dataType) for c, n in (("at", self.updated), ("key", self.key)))
        # the first condition alone can be pushed into the scan
        return rows.filter((F.col(self.updated) >= at) & ((F.col(self.updated) > at) | (F.col(self.key) > key)))

    def land(self) -> dict | None:
        """Writes the next page, and gives the watermark that goes with it; None where nothing is new."""
        mark = self.mark()
        path = f"{self.root}/pages/page={mark['page'] + 1}"
        self.behind(mark).orderBy(self.updated, self.key).limit(self.page).write.mode("overwrite").parquet(path)
        last = self.spark.read.schema(self.source.schema).parquet(path).agg(F.max(F.struct(self.updated, self.key)).alias("m")).select(*(F.col(f"m.{c}").cast("string") for c in (self.updated, self.key))).first()
        return None if last[0] is None else {"page": mark["page"] + 1, "at": last[0], "key": last[1]}

    def land_all(self) -> dict | None:
        """Writes all pages behind the watermark, and gives the watermark of the last; None where nothing is new.

        The backlog is dealt out in ranges of time and key and written aside in their order. The rows of the
        ranges before tell each row's place, and so its page.
        """
        mark, aside = self.mark(), f"{self.root}/backlog-{uuid.uuid4().hex}"
        order, place = (self.updated, self.key), F.monotonically_increasing_id()  # the range above bit 33, the place in it below
        try:
            self.behind(mark).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", place).write.parquet(aside)
            held = self.spark.read.schema(self._with("at_", T.LongType())).parquet(aside)
            part = F.shiftright("at_", 33)
            last = F.max(F.struct(*order)).alias("m")
            counts = held.groupBy(part.alias("part_")).agg(F.count("*").alias("n"), last).select("part_", "n", *(F.col(f"m.{c}").cast("string").alias(a) for c, a in zip(order, ("at", "key"), strict=True))).orderBy("part_").collect()  # a row a range
            if not counts:
                return None
            before = [0, *accumulate(r["n"] for r in counts)]
            first = F.element_at(F.create_map(*(F.lit(x).cast("long") for r, n in zip(counts, before, strict=False) for x in (r["part_"], n))), part)
            page = F.expr(f"cast((place_ div {self.page}) + {mark['page'] + 1} as int)")
            paged = held.withColumn("place_", first + F.col("at_").bitwiseAND((1 << 33) - 1)).withColumn("page", page).drop("at_", "place_")
            paged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page").parquet(f"{self.root}/pages")
        finally:
            files.delete(self.spark, aside)
        return {"page": mark["page"] + -(-before[-1] // self.page), "at": counts[-1]["at"], "key": counts[-1]["key"]}

    def commit(self, mark: dict) -> None:
        files.commit_json(self.spark, f"{self.root}/marks", mark["page"], mark)

    def run(self, pages: int | None = None) -> int:
        """Lands and commits pages until nothing is new, or so many; gives their number."""
        done, before = 0, self.mark()["page"]
        if pages is None:
            while mark := self.land_all():
                self.commit(mark)
            return self.mark()["page"] - before
        while done < pages and (mark := self.land()):
            self.commit(mark)
            done += 1
        return done

    def landed(self) -> DataFrame:
        last = self.mark()["page"]
        if not last:
            return self.source.limit(0)
        return self.spark.read.schema(self._with("page", T.IntegerType())).parquet(f"{self.root}/pages").filter(F.col("page") <= last).drop("page")


def incremental_jdbc(spark: SparkSession, url: str, table: str, driver: str, column: str, mark: int | None, parts: int = 8) -> DataFrame | None:
    """Rows of a JDBC table beyond the watermark, in ranges of the id; None where there is nothing to read.

    One row of bounds is asked for first, which the database answers from its index. The ranges span the new
    ids only, and the guard against the watermark goes to the database with each range.
    """
    beyond = f" WHERE \"{column}\" > {int(mark)}" if mark is not None else ""
    low, high = readers.read_jdbc(spark, url, f'(SELECT MIN("{column}") AS lo, MAX("{column}") AS hi FROM {table}{beyond}) AS bounds', driver).first()
    if high is None:
        return None
    rows = readers.read_jdbc(spark, url, table, driver, column, low, high + 1, parts)
    return rows if mark is None else rows.filter(F.col(column) > F.lit(mark))


def envelope(df: DataFrame, table: str, pk: str, created: str = "created_at", updated: str = "updated_at", data=None) -> DataFrame:
    """Changed rows as a flat log: an insert where both times are less than a second apart."""
    apart = F.abs(F.unix_micros(F.col(updated).cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp")))
    payload = F.to_json(F.struct(*(data or df.columns)), {"ignoreNullFields": "false"})
    return df.select(F.lit(table).alias("table_name"), F.when(apart < 1_000_000, "insert").otherwise("update").alias("op"), F.lit(pk).alias("pk_column"), F.col(pk).cast("string").alias("pk_value"), payload.alias("data_json"), F.col(updated).alias("captured_at"))


def window_scan(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows of the days start..end, both of them whole; either side may be open."""
    if start:
        df = df.filter(F.col(column) >= F.lit(date.fromisoformat(start)))
    if end:
        df = df.filter(F.col(column) < F.lit(date.fromisoformat(end) + timedelta(days=1)))
    return df


def backfill_windows(spark, start: str, end: str, days: int) -> DataFrame:
    """(window_start, window_end): the range cut into windows of some days; one where days <= 0."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if a > b:
        raise ValueError(f"{start} is after {end}")
    step = days if days > 0 else (b - a).days + 1
    starts = F.explode(F.sequence(F.lit(a), F.lit(b), F.expr(f"INTERVAL {step} DAYS"))).alias("window_start")
    return spark.range(1).select(starts).withColumn("window_end", F.least(F.date_add("window_start", step - 1), F.lit(b)))


def backfill(spark, start: str, end: str, days: int, run_window) -> int:
    """Runs each window in turn and stops at the first failure; gives the number of windows."""
    windows = backfill_windows(spark, start, end, days).orderBy("window_start").collect()
    for w in windows:
        run_window(w["window_start"].isoformat(), w["window_end"].isoformat())
    return len(windows)
