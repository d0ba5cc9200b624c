"""Streaming operators; each takes and gives a DataFrame and works on batches as well."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from brackwater.functions.schemas import fields
from brackwater.streaming.store import BucketStore, summed, upsert

CHANGE = fields("table string, op string, pk_column string, data string, captured_at string")
EVENT = fields("event_id string, session_id string, event_type string, product_id bigint, customer_id bigint, ts string")
REVENUE_PER_ORDER = 55.5
SKETCH_BITS = 12  # 4,096 registers: a standard error of 1.6 %


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files: int | None = None, archive: str | None = None) -> DataFrame:
    """New files below a folder; so many a batch where ``files`` is given. With ``archive``, a file is moved there
    when the batch after its own is planned, so not before its rows have landed."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


def parse(messages: DataFrame, schema: StructType, topic: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead): dead where the value is null, or its first field is after parsing."""
    text = F.col("value").cast("string")
    parsed = messages.withColumn("parsed", F.from_json(text, schema))
    bad = F.col("value").isNull() | F.col(f"parsed.{schema.fields[0].name}").isNull()
    dead = parsed.filter(bad).select(text.alias("value"), F.lit(topic).alias("source_topic"), F.current_timestamp().alias("failed_at"))
    return parsed.filter(~bad), dead


def clicks(good: DataFrame) -> DataFrame:
    return good.select("parsed.*").withColumn("ts", F.try_to_timestamp("ts"))


def changes(good: DataFrame) -> DataFrame:
    key = F.col("key").cast("string")
    return good.select(F.col("parsed.table").alias("table_name"), "parsed.op", "parsed.pk_column", key.alias("pk_value"), F.col("parsed.data").alias("data_json"), F.try_to_timestamp("parsed.captured_at").alias("captured_at"))


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", within: str = "10 minutes") -> DataFrame:
    if time not in events.columns:
        raise ValueError("deduplication needs an event time")
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def live_activity(events: DataFrame, late: str = "2 minutes", exact: bool = False) -> DataFrame:
    sessions = F.count_distinct("session_id") if exact else F.approx_count_distinct("session_id")
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("events"), sessions.alias("sessions"), F.count_if(F.col("event_type") == "checkout_complete").alias("completions")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "events", "sessions", "completions")


def checkout_anomalies(events: DataFrame, late: str = "10 minutes", least: float = 0.01, window: str = "1 minute") -> DataFrame:
    sums = events.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count_if(F.col("event_type") == "checkout_start").alias("starts"), F.count_if(F.col("event_type") == "checkout_complete").alias("completions"))
    rate = F.col("completions") / F.col("starts")
    return sums.filter("starts > 0").filter(rate < least).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "starts", "completions", rate.alias("completion_rate"))


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Key and JSON value for a message sink."""
    return alerts.select(F.col("window_start").cast("string").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))


def current_orders(log: DataFrame) -> DataFrame:
    """The order row with the latest capture, for orders with a positive id."""
    rows = log.filter("order_id > 0")
    return rows.groupBy("order_id").agg(F.max_by(F.struct("status", "customer_id", "order_date", "captured_at"), F.struct("captured_at", "status")).alias("r")).select("order_id", "r.*")


def per_minute(inserts: DataFrame, time: str = "order_date") -> DataFrame:
    return inserts.groupBy(F.date_trunc("minute", time).alias("minute")).agg(F.count("*").alias("orders"))


def revenue_estimate(minutes: DataFrame) -> DataFrame:
    return minutes.select("minute", (F.col("orders") * F.lit(REVENUE_PER_ORDER)).cast("double").alias("estimated_revenue"))


def status_counts(inserts: DataFrame) -> DataFrame:
    return inserts.groupBy("status").agg(F.count("*").alias("orders"))


def merged(partials: DataFrame, keys, column: str = "orders") -> DataFrame:
    """Partial counts of any number of batches, summed by key."""
    return partials.groupBy(*keys).agg(F.sum(column).alias(column))


def retained(df: DataFrame, time: str, now, days: int) -> DataFrame:
    return df.filter(F.col(time) >= now - F.expr(f"INTERVAL {days} DAYS"))


class _Dropped(StreamingQueryListener):
    """Adds up the rows that stateful operators of one query dropped as too late."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ended: dict[str, bool] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        n = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        self.rows[str(event.progress.runId)] = self.rows.get(str(event.progress.runId), 0) + n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)] = True

    def count(self, run: str, patience: float = 60.0) -> int:
        """The rows that a run which has ended dropped; its events come in order, but some time after it."""
        until = time.monotonic() + patience
        while run not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return self.rows.get(run, 0)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available: bool = True, every: str = "30 seconds", options: dict | None = None) -> int:
    """Writes a stream as Parquet with a checkpoint; by default all that is there, then it ends. Gives the
    number of rows that came behind the watermark and were dropped."""
    listener, streams = _Dropped(), stream.sparkSession.streams
    streams.addListener(listener)
    try:
        writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).options(**(options or {}))
        query = (writer.trigger(availableNow=True) if available else writer.trigger(processingTime=every)).start(path)
        query.awaitTermination()
        return listener.count(str(query.runId))
    finally:
        streams.removeListener(listener)


def run_merges(stream: DataFrame, store: BucketStore, checkpoint: str, combine, mode: str = "update", prepare=None) -> DataFrame:
    """Each batch, after ``prepare``, is merged into the store; all that is there, then it ends. The store's
    newest version is the result, also where a run finds no new data."""

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(prepare(batch) if prepare else batch, number, combine)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return store.read()


def run_upserts(stream: DataFrame, path: str, checkpoint: str, keys, mode: str = "update", version: str | None = None, live: str | None = None, buckets: int = 16) -> DataFrame:
    """Each batch is merged by key into a store of hash buckets (``store.BucketStore``)."""
    return run_merges(stream, BucketStore(stream.sparkSession, path, keys, stream.schema, buckets), checkpoint, upsert(keys, version, live), mode)


def run_partials(stream: DataFrame, partial, path: str, checkpoint: str, keys, sums=("orders",), sketches=(), buckets: int = 4) -> DataFrame:
    """The partial sums (and distinct-count sketches) of every batch, added up by key in a store of buckets."""
    spark = stream.sparkSession
    schema = partial(spark.createDataFrame([], stream.schema)).schema
    return run_merges(stream, BucketStore(spark, path, keys, schema, buckets), checkpoint, summed(keys, sums, sketches), "append", partial)


def live_partials(events: DataFrame) -> DataFrame:
    """By minute: events, completions and a sketch of the sessions, which can be added up over batches."""
    return events.groupBy(F.date_trunc("minute", "ts").alias("window_start")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "checkout_complete").alias("completions"), F.hll_sketch_agg("session_id", F.lit(SKETCH_BITS)).alias("sketch"))


def with_sessions(partials: DataFrame) -> DataFrame:
    return partials.withColumn("sessions", F.hll_sketch_estimate("sketch")).drop("sketch")


def run_topics(messages: DataFrame, outputs: dict, root: str, checkpoint: str) -> None:
    """One query, one checkpoint and several tables: each batch's part of a table is a folder under the batch's
    number below ``root``, which a batch that runs again replaces.

    ``outputs``: from a table's name to a function from a batch of messages to its rows.
    """

    def land(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, rows in outputs.items():
                rows(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        finally:
            batch.unpersist()

    messages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(land).start().awaitTermination()


def landed(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{name}/batch=*")


def of_topic(messages: DataFrame, topic: str) -> DataFrame:
    return messages.filter(F.col("topic") == topic)


def dead_letters(messages: DataFrame, schemas: dict[str, StructType]) -> DataFrame:
    """What can't be parsed of any topic, as one table."""
    return reduce(DataFrame.unionByName, (parse(of_topic(messages, topic), schema, topic)[1] for topic, schema in schemas.items()))
