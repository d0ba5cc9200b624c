"""Keyed state with expiry: the current row of each order, for as long as the order is young."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ORDER = "order_id long, status string, customer_id long, order_date timestamp, captured_at timestamp"
#: What a state holds of an order; times are microseconds since 1970, which no time zone of a worker changes, and
#: a missing customer is a flag, since numbers with nulls would become floats.
HELD = pa.schema([("order_id", pa.int64()), ("status", pa.string()), ("customer_id", pa.int64()), ("no_customer", pa.bool_()), ("order_date", pa.int64()), ("captured_at", pa.int64())])
EMITTED = "order_id long, status string, customer_id long, no_customer boolean, order_date long, captured_at long, live boolean"
DAYS = 30
GROUPS = 512


class CurrentOrders(StatefulProcessor):
    """Holds the row with the latest capture of each order, and lets it go some days after the order's date.

    The clock is the watermark, not the machine's: an order whose date lies ``days`` behind it is
    emitted once more with live false, and its state is cleared. A change of an order that is too old
    already opens no state. Of captures at one time the greater status counts.

    A key is a group of orders, dealt by a hash, and its state one block of rows: a call of the state store a group
    and batch, not several an order, with one timer a group at the first order that ends.
    """

    def __init__(self, days: int = DAYS):
        self.span = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("orders", "rows binary")

    def _ends(self, rows: pd.DataFrame) -> np.ndarray:
        """The milliseconds at which orders end."""
        return (rows["order_date"].to_numpy(np.int64) + self.span) // 1000

    def _held(self) -> pd.DataFrame:
        held = self.block.get()
        table = HELD.empty_table() if held is None else pa.ipc.open_stream(bytes(held[0])).read_all()
        return table.to_pandas()

    def _hold(self, before: pd.DataFrame, rows: pd.DataFrame) -> None:
        """``rows`` in the place of those ``before``; the timer goes with them."""
        if len(rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, HELD) as out:
                out.write_table(pa.Table.from_pandas(rows[HELD.names], HELD, preserve_index=False))
            self.block.update((sink.getvalue().to_pybytes(),))
        elif len(before):
            self.block.clear()
        set_for, ends = (int(self._ends(x).min()) if len(x) else None for x in (before, rows))
        if set_for != ends:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            if ends is not None:
                self.handle.registerTimer(ends)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._held()
        # of rows that are equal in time and status the held one stays, or the one that came first: the last one here
        parts = [x[HELD.names].assign(new=n) for x, n in [*((r, True) for r in rows), (before, False)] if len(x)]
        both = pd.concat([*(p.iloc[::-1] for p in reversed(parts[:-1])), parts[-1]] if len(before) else [p.iloc[::-1] for p in reversed(parts)], ignore_index=True)
        status, _ = pd.factorize(both["status"].astype(object).where(both["status"].notna(), ""), sort=True)
        order = np.lexsort((status, both["captured_at"].to_numpy(np.int64), both["order_id"].to_numpy(np.int64)))
        both = both.iloc[order]
        ids = both["order_id"].to_numpy(np.int64)
        last = np.r_[ids[1:] != ids[:-1], True]
        first = np.flatnonzero(np.r_[True, last[:-1]])
        best = both[last].assign(new=np.logical_or.reduceat(both["new"].to_numpy(bool), first))
        live = self._ends(best) > timerValues.getCurrentWatermarkInMs()
        self._hold(before, best[live])
        said = best["new"].to_numpy(bool) | ~live
        yield best.loc[said, HELD.names].assign(live=live[said])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._held()
        live = self._ends(before) > timerValues.getCurrentWatermarkInMs()
        self._hold(before, before[live])
        yield before.loc[~live, HELD.names].assign(live=False)

    def close(self) -> None:
        pass


def current_orders(changes: DataFrame, late: str = "1 day", days: int = DAYS, groups: int = GROUPS) -> DataFrame:
    """The changes of each order's current row, ``live`` false where it has expired; a stream in update mode.

    ``changes`` has ORDER's columns; orders without a positive id, a date or a capture are left out. Changes that
    come later than ``late`` behind the newest are dropped. A worker holds one of the ``groups`` of orders at a
    time, with its changes of a batch; their number is part of the checkpoint.
    """
    times = ("order_date", "captured_at")
    rows = changes.filter("order_id > 0 and order_date is not null and captured_at is not null").withWatermark("captured_at", late)
    micros = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in times]
    customer = F.coalesce("customer_id", F.lit(0)).cast("long").alias("customer_id")
    group = F.pmod(F.xxhash64("order_id"), F.lit(groups)).cast("int").alias("group")
    rows = rows.select(group, F.col("order_id").cast("long").alias("order_id"), "status", customer, F.col("customer_id").isNull().alias("no_customer"), *micros)
    held = rows.groupBy("group").transformWithStateInPandas(CurrentOrders(days), EMITTED, "Update", "EventTime")
    customer = F.when(~F.col("no_customer"), F.col("customer_id")).alias("customer_id")
    return held.select("order_id", "status", customer, *(F.timestamp_micros(c).alias(c) for c in times), "live")


def on_rocks(spark, run, partitions: int | None = None):
    """``run()`` with states in the RocksDB store, which keeps them on disk and not in the heap.

    The number of state partitions is fixed when a query first starts; ``partitions`` sets it apart from the
    session's shuffles.
    """
    wanted = {PROVIDER: ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
