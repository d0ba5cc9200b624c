"""Helpers shared by the training-data operators: shared scratch tables and Arrow text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and runs on one machine (tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brackwater-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls give the same one."""
    return f"{shared_dir(spark)}/brackwater/{name}-{uuid.uuid4().hex}"


#: Scratch tables of the blocks that are open in this thread of work.
_BLOCKS: ContextVar[tuple[list[str], ...]] = ContextVar("blocks", default=())


def _note(path: str) -> None:
    if open_ := _BLOCKS.get():
        open_[-1].append(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: it cuts the lineage and
    outlives any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What ``make`` gives, once in a Python worker for as long as no other name is asked for: a worker that goes
    on to another operator's tasks doesn't hold on to what the one before remembered."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """A worker's first task of an operator that remembers nothing lets go of what others have kept."""
    _KEPT.clear()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables, wherever the shared folder is."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """What ``make`` returns, stored; the scratch tables that it made on the way are deleted."""
    own: list[str] = []
    token = _BLOCKS.set((*_BLOCKS.get(), own))
    try:
        path = scratch_path(spark, name)
        df = make()
        df.write.parquet(path)
        schema = df.schema
    finally:
        _BLOCKS.reset(token)
        discard(spark, *own)
    _note(path)
    return spark.read.schema(schema).parquet(path)


def fresh(df: DataFrame, name: str, *more: str) -> str:
    """``name`` and as many underscores as no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    name = "_".join((name, *more)) + "_"
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a key of each row that is the same whenever it is read: the hash of its file and its
    place there, or, where ``df`` is no plain scan of files, a number stored with its rows."""
    scan = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if scan and "_metadata" not in {c.lower() for c in df.columns}:
        return df.withColumn(name, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_slices(rows: int = 512) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Cuts an Arrow batch into batches of some rows, so that a task's Python lists stay small."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

    return cut


def by_bytes(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch into batches with some ``size`` bytes of text; a longer text is alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, batch.num_rows] if batch.num_rows else []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, z - a)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Each round takes the smallest label among neighbours and then the label of that label
    (pointer jumping), so the rounds grow with the logarithm of a chain's length. Labels are
    written to the shared folder after each round; the driver sees only the count of changes.
    """
    both = stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("label"), F.lit(True).alias("moved")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{name}-hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = stored(hooked.join(up, "label").select("node", F.least("label", "top").alias("label"), (F.least("label", "top") != F.col("old")).alias("moved")), f"{name}-labels")
        if not labels.filter("moved").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
