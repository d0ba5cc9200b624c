"""A keyed table in hash buckets that streams merge their batches into.

A batch reads and rewrites only the buckets that its keys fall in. Its files go below a folder of its
own; then one small version file, which names the files of every bucket, is moved into place. Until then
readers see the version before, whole, and after it the new one; so a batch that broke off leaves
nothing, and one that is delivered again is known by its number and skipped. The version before the last
stays for readers that have begun.

A store belongs to one checkpoint, since batch numbers are its own. The number of buckets is fixed by the
first batch; choose it so that a bucket is a few files' worth.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.functions.schemas import fields
from brackwater.sources import files

BUCKET = "bucket_"


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, keys, schema, buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = fields(schema) if isinstance(schema, str) else schema
        self.log = f"{self.path}/versions"

    def versions(self) -> list[int]:
        """The batches that have been committed and are still kept, oldest first."""
        return files.numbers(self.spark, self.log)

    def version(self, number: int) -> dict:
        return files.read_json(self.spark, files.numbered(self.log, number))

    def head(self) -> dict:
        there = self.versions()
        return self.version(there[-1]) if there else {"batch": -1, "buckets": {}}

    def read(self, head: dict | None = None, only=None) -> DataFrame:
        """The rows of a version, the last one by default; of some buckets where they are given."""
        held = (head or self.head())["buckets"]
        paths = [f"{self.path}/{where}" for b, where in held.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.head().get("of", self.buckets))).cast("int"))

    def merge(self, batch: DataFrame, number: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Puts ``combine(held, batch)`` in the place of the buckets that the batch's keys fall in; False where
        this batch has been committed before."""
        head = self.head()
        if head["batch"] >= number:
            return False
        batch = batch.persist()
        try:
            touched = {r[0] for r in self.with_bucket(batch).select(BUCKET).distinct().collect()}  # as many as buckets at most
            held = dict(head["buckets"])
            if touched:
                new = f"data/batch={number}-{uuid.uuid4().hex[:8]}"
                rows = self.with_bucket(combine(self.read(head, touched), batch))
                rows.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{new}")
                written = {int(n.split("=")[1]): f"{new}/{n}" for n in files.names(self.spark, f"{self.path}/{new}") if n.startswith(f"{BUCKET}=")}
                held = {b: where for b, where in held.items() if int(b) not in touched} | {str(b): where for b, where in written.items()}
            files.commit_json(self.spark, self.log, number, {"batch": number, "of": head.get("of", self.buckets), "buckets": held})
        finally:
            batch.unpersist()
        self._tidy()
        return True

    def _tidy(self) -> None:
        """Deletes versions older than the last two, and batches' files that neither of these names."""
        there = self.versions()
        named = {where.split("/")[1] for n in there[-2:] for where in self.version(n)["buckets"].values()}
        for n in there[:-2]:
            files.delete(self.spark, files.numbered(self.log, n))
        for name in files.names(self.spark, f"{self.path}/data"):
            if name not in named:
                files.delete(self.spark, f"{self.path}/data/{name}")


def upsert(keys, version: str | None = None, live: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows of the batch replace those of their key; with ``live``, rows where it is false remove theirs."""
    from brackwater.operators.merge import merge_upsert

    def combine(held: DataFrame, batch: DataFrame) -> DataFrame:
        rows = merge_upsert(held, batch, keys, version)
        return rows.filter(live) if live else rows

    return combine


def summed(keys, sums, sketches=()) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Partial sums and distinct-count sketches of a key added up."""

    def combine(held: DataFrame, batch: DataFrame) -> DataFrame:
        both = held.unionByName(batch.select(*held.columns))
        return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.hll_union_agg(c).alias(c) for c in sketches))

    return combine
