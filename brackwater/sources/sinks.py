"""Sinks: appends, overwrites by partition, snapshots, serving swaps, partitioned layouts."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.sources import files

LAYERS = ("bronze", "silver", "gold", "quarantine")


def layer_table(layer: str, name: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"{layer} is not one of {LAYERS}")
    return f"{layer}.{name}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a temporary one only on one machine that has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp()
    return f"{root.rstrip('/')}/lakehouse/{name}-{uuid.uuid4().hex}"


def scratch_name() -> str:
    """A name that no other call gives."""
    return uuid.uuid4().hex


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replaces the partitions that ``df`` has rows of, and no others; without columns, the table."""
    writer = df.write.mode("overwrite")
    if columns:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*columns)
    writer.parquet(path)


def overwrite_window(df: DataFrame, path: str, column: str, at: str, start: str, end: str) -> None:
    """Replaces the rows of the days start..end of a table in partitions of ``column``, which is derived from the
    time ``at``.

    A window may cover a partition in part: its rows of other days are kept, and so are partitions that lose
    all rows of the window. The kept rows are written aside first, since a partition can't be read and
    replaced at once. Rows of ``df`` outside the window are refused.
    """
    spark = df.sparkSession
    since, until = F.lit(date.fromisoformat(start)), F.lit(date.fromisoformat(end) + timedelta(days=1))
    within = (F.col(at) >= since) & (F.col(at) < until)
    aside = f"{path.rstrip('/')}__kept-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{aside}/new")
        new = spark.read.schema(df.schema).parquet(f"{aside}/new")
        if not new.filter(~F.coalesce(within, F.lit(False))).isEmpty():
            raise ValueError(f"rows outside {start}..{end}")
        old = spark.read.schema(df.schema).parquet(path) if files.names(spark, path) else new.limit(0)
        touched = old.filter(within).select(column).union(new.select(column)).distinct()
        kept = old.filter(~F.coalesce(within, F.lit(False))).join(touched, old[column].eqNullSafe(touched[column]), "left_semi")
        kept.write.parquet(f"{aside}/old")
        whole = spark.read.schema(df.schema).parquet(f"{aside}/old").unionByName(new)
        emptied = [r[0] for r in touched.join(whole.select(column).distinct(), column, "left_anti").collect()]  # partitions of a window
        overwrite_partitions(whole, path, column)
        for value in emptied:
            files.delete(spark, f"{path.rstrip('/')}/{column}={value}")
    finally:
        files.delete(spark, aside)


def replace_run(df: DataFrame, path: str, run_id: str) -> None:
    """Puts ``df`` in the place of all rows that this run wrote before; an empty one too, so a repeated run that
    finds nothing leaves nothing."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def replace_snapshot(df: DataFrame, path: str) -> bool:
    """Replaces the snapshot; an empty source leaves the old one.

    The source is evaluated once, beside the snapshot. Only a whole new one is moved into its place, so a
    write that fails leaves the old one there.
    """
    spark = df.sparkSession
    hadoop, new, old = spark._jvm.org.apache.hadoop.fs, f"{path}__new-{uuid.uuid4().hex}", f"{path}__old-{uuid.uuid4().hex}"
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new)
        if spark.read.schema(df.schema).parquet(new).isEmpty():
            return False
        held = files.exists(hadoop.Path(path))
        if held and not files.rename(hadoop.Path(path), hadoop.Path(old)):
            raise OSError(f"{path} can't be moved")
        if not files.rename(hadoop.Path(new), hadoop.Path(path)):
            if held:
                files.rename(hadoop.Path(old), hadoop.Path(path))
            raise OSError(f"{new} can't be moved")
        files.delete(hadoop.Path(old), True)
        return True
    finally:
        files.delete(hadoop.Path(new), True)


def swap_view(df: DataFrame, root: str, view: str) -> str:
    """Writes a new version beside the live one, and only then points the view at it."""
    spark, path = df.sparkSession, f"{root}/version-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    except Exception:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        raise
    spark.read.parquet(path).createOrReplaceTempView(view)
    return path


def _statements(spark: SparkSession, url: str, driver: str, *statements: str) -> None:
    """Runs statements on a database in one transaction: all of them, or none."""
    spark._jvm.java.lang.Class.forName(driver)
    link = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        link.setAutoCommit(False)
        try:
            run = link.createStatement()
            for s in statements:
                run.execute(s)
            link.commit()
        except Exception:
            link.rollback()
            raise
    finally:
        link.close()


def swap_jdbc(df: DataFrame, url: str, driver: str, table: str) -> None:
    """Makes and fills the staging table of ``table`` over JDBC, whatever it was before; ``serve_jdbc`` exchanges
    tables that exist."""
    df.write.mode("overwrite").jdbc(url, f"{table}_staging", properties={"driver": driver})


def serve_jdbc(df: DataFrame, url: str, driver: str, table: str) -> None:
    """Replaces the rows that a database serves: fills ``table``_staging, then exchanges the two tables by
    renaming them in one transaction.

    Both tables must exist, with the same columns. Whatever fails, ``table`` has its old rows and the staging
    table is emptied; an error of the emptying doesn't hide the first one.
    """
    spark, staging, aside = df.sparkSession, f"{table}_staging", f"{table}_aside"
    try:
        _statements(spark, url, driver, f"DELETE FROM {staging}")
        df.write.mode("append").jdbc(url, staging, properties={"driver": driver})
        _statements(spark, url, driver, f"RENAME TABLE {table} TO {aside}", f"RENAME TABLE {staging} TO {table}", f"RENAME TABLE {aside} TO {staging}")
    except Exception:
        with contextlib.suppress(Exception):
            _statements(spark, url, driver, f"DELETE FROM {staging}")
        raise
    _statements(spark, url, driver, f"DELETE FROM {staging}")


def replace_table(df: DataFrame, name: str, root: str, keep: int = 2) -> str:
    """Creates or replaces a catalog table: its rows are written beside those it has, and then its location is
    switched in one step of the catalog, so a reader always finds one whole version.

    Readers that have begun go on with the version that they have; the last ``keep`` stay, older ones are
    deleted. A write that fails changes nothing. Gives the version's path.
    """
    spark, version = df.sparkSession, f"version={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    path = f"{root.rstrip('/')}/{version}"
    try:
        df.write.parquet(path)
    except Exception:
        files.delete(spark, path)
        raise
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{path}'")
    else:
        if [(f.name, f.dataType) for f in spark.table(name).schema] != [(f.name, f.dataType) for f in df.schema]:
            files.delete(spark, path)
            raise ValueError(f"{name} has other columns")
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        spark.catalog.refreshTable(name)
    for old in [n for n in files.names(spark, root) if n.startswith("version=")][:-keep]:
        files.delete(spark, f"{root.rstrip('/')}/{old}")
    return path


def bucketed_table(df: DataFrame, name: str, path: str, key: str, buckets: int = 16) -> None:
    """A catalog table in hash buckets of a key, sorted within each: tables that are bucketed alike join and
    aggregate by that key without an exchange. Rows are dealt to the buckets first, so each has one file."""
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def partitioned_layout(df: DataFrame, path: str, time: str, key: str, buckets: int = 16) -> None:
    """Days of a time and hash buckets of a key as partitions, dealt out before the write."""
    laid = df.withColumn("day", F.to_date(time)).withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
    laid.repartition("day", "bucket").write.mode("overwrite").partitionBy("day", "bucket").parquet(path)


def clustered(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in ranges of the columns, sorted within each: what a global sort before a write is for."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)
