"""Stores, states, pages and tables that are switched whole: what happens between the steps."""

import threading
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brackwater.operators import conform, ingest, quality
from brackwater.sources import files, sinks
from brackwater.streaming import state, store, streams

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    own = store.BucketStore(spark, f"file://{tmp_path}/s", ["id"], "id bigint, v string", buckets=32)
    big = spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    assert own.merge(big, 0, store.upsert(["id"]))
    whole = size(tmp_path)
    assert own.merge(spark.createDataFrame([(7, "seven"), (60_000, "new")], "id long, v string"), 1, store.upsert(["id"]))
    assert size(tmp_path) - whole < 0.1 * whole
    got = own.read()
    assert got.count() == 50_001 and got.filter("id = 7").first()["v"] == "seven"


def test_a_repeated_batch_is_skipped_and_a_broken_one_leaves_nothing(spark, tmp_path):
    own = store.BucketStore(spark, f"file://{tmp_path}/s", ["k"], "k string, n bigint", buckets=4)
    add, batch = store.summed(["k"], ["n"]), spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    assert own.merge(batch, 0, add) and not own.merge(batch, 0, add)
    with pytest.raises(Exception, match="boom|BOOM"):
        own.merge(batch, 1, lambda held, new: add(held, new).withColumn("n", F.expr("if(k = 'b', raise_error('boom'), n)")))
    assert rows(own.read()) == [("a", 1), ("b", 2)] and own.versions() == [0]
    assert own.merge(batch, 1, add)
    assert rows(own.read()) == [("a", 2), ("b", 4)]
    named = {w.split("/")[1] for n in own.versions() for w in own.version(n)["buckets"].values()}
    assert set(files.names(spark, f"{own.path}/data")) == named  # what the broken batch wrote is gone


def test_readers_keep_their_version_and_old_ones_go(spark, tmp_path):
    own = store.BucketStore(spark, f"file://{tmp_path}/s", ["k"], "k int, n int", buckets=2)
    put = lambda n: own.merge(spark.createDataFrame([(1, n)], "k int, n int"), n, store.upsert(["k"]))
    put(0)
    before = own.read()
    put(1)
    assert rows(before) == [(1, 0)] and rows(own.read()) == [(1, 1)]
    put(2)
    assert own.versions() == [1, 2] and rows(own.read()) == [(1, 2)]


def test_rows_that_are_not_live_go_from_the_store(spark, tmp_path):
    own = store.BucketStore(spark, f"file://{tmp_path}/s", ["k"], "k int, at int, live boolean", buckets=2)
    own.merge(spark.createDataFrame([(1, 5, True), (2, 5, True)], own.schema), 0, store.upsert(["k"], "at", "live"))
    own.merge(spark.createDataFrame([(1, 5, False), (3, 1, False)], own.schema), 1, store.upsert(["k"], "at", "live"))
    assert rows(own.read()) == [(2, 5, True)]
    own.merge(spark.createDataFrame([(2, 6, False)], own.schema), 2, store.upsert(["k"], "at", "live"))
    assert own.read().count() == 0


def test_sketches_add_up_over_batches(spark, tmp_path):
    at = datetime(2024, 1, 1, 12)
    events = [(f"s{i % 700}", "checkout_complete" if i % 9 == 0 else "page_view", at + timedelta(seconds=i % 120)) for i in range(4000)]
    schema = "session_id string, event_type string, ts timestamp"
    for part in range(3):
        spark.createDataFrame(events[part::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: streams.run_partials(streams.file_stream(spark, f"{tmp_path}/in", schema, files=1), streams.live_partials, f"file://{tmp_path}/s", f"{tmp_path}/c", ["window_start"], ("events", "completions"), ("sketch",))
    run()
    got = {r.window_start.minute: r for r in streams.with_sessions(run()).collect()}
    for minute in (0, 1):
        own = [e for e in events if e[2].minute == minute]
        assert got[minute].events == len(own) and got[minute].completions == sum(e[1] == "checkout_complete" for e in own)
        assert abs(got[minute].sessions - len({e[0] for e in own})) <= 0.05 * len({e[0] for e in own})


def test_orders_expire_by_the_watermark(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    batches = [
        [(1, "placed", 9, day(0), day(0)), (2, "placed", None, day(5), day(5)), (0, "placed", 9, day(5), day(5)), (-3, "x", 9, day(5), day(5)), (8, "x", 9, None, day(5))],
        [(1, "shipped", 9, day(0), day(2)), (1, "cancelled", 9, day(0), day(1)), (3, "placed", 7, day(20), day(20))],
        [(4, "placed", 7, day(40), day(40)), (5, "placed", 7, day(1), day(40)), (2, "moved", None, day(30), day(39))],
    ]
    live = []
    for batch in batches:
        spark.createDataFrame(batch, state.ORDER).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes = state.current_orders(streams.file_stream(spark, f"{tmp_path}/in", state.ORDER), late="4 days")
        out = state.on_rocks(spark, lambda c=changes: streams.run_upserts(c, f"file://{tmp_path}/s", f"{tmp_path}/c", ["order_id"], "update", "captured_at", "live", 2))
        live.append([(r.order_id, r.status, r.customer_id) for r in out.orderBy("order_id").collect()])
    assert live[0] == [(1, "placed", 9), (2, "placed", None)]
    assert live[1] == [(1, "shipped", 9), (2, "placed", None), (3, "placed", 7)]
    # the watermark is day 36: order 1 has gone, order 5 was too old when it came, order 2 has another date now
    assert live[2] == [(2, "moved", None), (3, "placed", 7), (4, "placed", 7)]


def test_orders_are_held_in_blocks(spark, tmp_path):
    """A call of the state store a group and batch, not several an order; orders of one group end one by one."""
    calls = []

    class Cell:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    class Timers:
        at = set()

        def registerTimer(self, ms):
            calls.append("register")
            self.at.add(ms)

        def deleteTimer(self, ms):
            self.at.remove(ms)

    class Clock:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    day = 86_400_000_000
    own = state.CurrentOrders(30)
    own.handle, own.block = Timers(), Cell()
    frame = lambda data: pd.DataFrame(data, columns=state.HELD.names)
    big = [(i, "placed", 2**60 + 1, False, i * day, i * day) for i in range(1, 1001)]
    out = pd.concat(own.handleInputRows((3,), iter([frame(big[:600]), frame(big[600:])]), Clock(0)))
    assert len(out) == 1000 and out["live"].all() and (out["customer_id"] == 2**60 + 1).all()
    assert len(calls) <= 3 and own.handle.at == {31 * 86_400_000}
    out = pd.concat(own.handleExpiredTimer((3,), Clock(35 * 86_400_000), None))
    assert sorted(out["order_id"]) == [1, 2, 3, 4, 5] and not out["live"].any() and own.handle.at == {36 * 86_400_000}
    # order 6 has expired at day 36; of order 7's captures at one time the greater status counts, an older one doesn't
    new = [(7, "b", 5, False, 7 * day, 9 * day), (7, "c", 0, True, 7 * day, 9 * day), (7, None, 5, False, 7 * day, 9 * day), (8, "z", 5, False, 8 * day, 0), (2000, None, 5, False, 0, 0)]
    out = pd.concat(own.handleInputRows((3,), iter([frame(new)]), Clock(36 * 86_400_000)))
    assert sorted((r.order_id, r.status or "", bool(r.no_customer), bool(r.live)) for r in out.itertuples()) == [(6, "placed", False, False), (7, "c", True, True), (8, "placed", False, True), (2000, "", False, False)]


def test_pages_lose_and_double_nothing(spark, tmp_path):
    at = datetime(2024, 1, 1)
    data = [(i, at + timedelta(minutes=i // 4), f"v{i}") for i in range(23)] + [(None, at, "no key"), (99, None, "no time")]
    source, schema = None, "id long, updated_at timestamp_ntz, v string"
    source = spark.createDataFrame(data, schema)
    poll = lambda df=source: ingest.ChangePoll(df, f"file://{tmp_path}/p", "updated_at", "id", 5)
    assert poll().landed().count() == 0
    assert poll().run(2) == 2
    assert poll().land()["page"] == 3  # landed, not committed: a run that broke off
    assert poll().landed().count() == 10
    assert poll().run() == 3 and poll().run() == 0
    assert sorted(r.id for r in poll().landed().collect()) == list(range(23))
    more = source.unionByName(spark.createDataFrame([(3, at + timedelta(days=1), "changed")], schema))
    assert poll(more).run() == 1 and poll(more).landed().count() == 24
    assert poll(source.limit(0)).run() == 0


def test_a_backlog_is_scanned_once_for_all_its_pages(spark, tmp_path):
    at, schema = datetime(2024, 1, 1), "id long, updated_at timestamp_ntz, v string"
    source = spark.createDataFrame([(i, at + timedelta(minutes=(i * 37) % 50), f"v{i}") for i in range(203)], schema).repartition(5)
    poll = ingest.ChangePoll(source, f"file://{tmp_path}/p", "updated_at", "id", 10)
    assert poll.run(1) == 1
    landed = []
    land = poll.land
    poll.land = lambda: landed.append(1) or land()
    poll.land_all()  # lands, but breaks off before the watermark moves
    assert poll.landed().count() == 10 and poll.run() == 20 and not landed
    wanted = sorted((r.updated_at, r.id) for r in source.collect())
    pages = [sorted((r.updated_at, r.id) for r in spark.read.parquet(f"{tmp_path}/p/pages/page={n}").collect()) for n in range(1, 22)]
    assert [r for page in pages for r in page] == wanted and {len(page) for page in pages[:-1]} == {10}
    assert sorted((r.updated_at, r.id) for r in poll.landed().collect()) == wanted
    assert [n for n in files.names(spark, poll.root) if n.startswith("backlog")] == []


def test_jdbc_watermark_goes_to_the_database(spark):
    url = f"jdbc:derby:memory:{sinks.scratch_name()};create=true"
    spark.range(1, 101).selectExpr("id", "concat('v', id) AS v").coalesce(1).write.jdbc(url, "t", properties={"driver": DERBY})
    new = ingest.incremental_jdbc(spark, url, "t", DERBY, "id", 60, parts=4)
    assert new.rdd.getNumPartitions() == 4 and sorted(r.id for r in new.collect()) == list(range(61, 101))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,60)" in plan and "numPartitions=4" in plan
    assert ingest.incremental_jdbc(spark, url, "t", DERBY, "id", 100) is None
    assert ingest.incremental_jdbc(spark, url, "t", DERBY, "id", None).count() == 100


def test_a_failed_load_leaves_what_is_served(spark):
    url = f"jdbc:derby:memory:{sinks.scratch_name()};create=true"
    served = lambda t="LIVE": rows(spark.read.jdbc(url, t, properties={"driver": DERBY}))
    for t in ("LIVE", "LIVE_staging"):
        spark.createDataFrame([], "k int, v string").write.jdbc(url, t, properties={"driver": DERBY, "createTableColumnTypes": "v VARCHAR(5)"})
    load = lambda data: sinks.serve_jdbc(spark.createDataFrame(data, "k int, v string"), url, DERBY, "LIVE")
    load([(1, "a"), (2, "b")])
    assert served() == [(1, "a"), (2, "b")] and served("LIVE_staging") == []
    with pytest.raises(Exception, match="(?i)truncat"):
        load([(3, "c"), (4, "far too long")])
    assert served() == [(1, "a"), (2, "b")] and served("LIVE_staging") == []
    load([(5, "e")])
    assert served() == [(5, "e")]
    # the exchange itself fails: the transaction takes nothing of it
    with pytest.raises(Exception, match="(?i)already exists|MISSING"):
        sinks._statements(spark, url, DERBY, "RENAME TABLE LIVE TO GONE", "RENAME TABLE MISSING TO LIVE")
    assert served() == [(5, "e")]


def test_readers_see_one_whole_version(spark, tmp_path):
    name, root = f"t_{sinks.scratch_name()}", f"file://{tmp_path}/t"
    version = lambda n: spark.range(2000).select("id", F.lit(n).alias("version"))
    sinks.replace_table(version(0), name, root)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(tuple(spark.table(name).agg(F.count("*"), F.min("version"), F.max("version")).first()))

    reader = threading.Thread(target=read)
    reader.start()
    for n in (1, 2, 3):
        sinks.replace_table(version(n), name, root, keep=4)
    stop.set()
    reader.join()
    assert seen and all(n == 2000 and low == high for n, low, high in seen)
    assert [s[1] for s in seen] == sorted(s[1] for s in seen)
    with pytest.raises(Exception, match="boom"):
        sinks.replace_table(version(4).withColumn("id", F.expr("if(id = 9, raise_error('boom'), id)")), name, root)
    with pytest.raises(ValueError):
        sinks.replace_table(spark.range(1), name, root)
    assert spark.table(name).agg(F.max("version")).first()[0] == 3 and len([n for n in files.names(spark, root) if n.startswith("version=")]) == 4


def test_bucketed_tables_join_without_exchange(spark, sf_dir):
    from brackwater.plans import live

    joined = live.bucketed_join(spark, sf_dir)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_windows_within_partitions(spark, tmp_path):
    path, schema = f"{tmp_path}/w", "id int, at timestamp_ntz, month string"
    make = lambda days: spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(days=i), (datetime(2024, 1, 1) + timedelta(days=i)).strftime("%Y-%m")) for i in days], schema)
    sinks.overwrite_window(make(range(0, 91)), path, "month", "at", "2024-01-01", "2024-03-31")
    assert spark.read.parquet(path).count() == 91
    sinks.overwrite_window(make([20]), path, "month", "at", "2024-01-15", "2024-02-29")
    assert sorted(r.id for r in spark.read.schema(schema).parquet(path).collect()) == [*range(14), 20, *range(60, 91)]
    assert sorted(n for n in files.names(spark, path) if n.startswith("month=")) == ["month=2024-01", "month=2024-03"]
    with pytest.raises(ValueError):
        sinks.overwrite_window(make([20, 80]), path, "month", "at", "2024-01-15", "2024-02-29")
    assert spark.read.parquet(path).count() == 46


def test_all_known_events_and_no_other(spark):
    kinds = ["page_view", "add_to_cart", "remove_from_cart", "checkout_start", "checkout_complete", "product_view", None]
    df = spark.createDataFrame(list(enumerate(kinds)), "event_id int, event_type string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("session_id", F.lit("s"))
    good, bad = quality.in_domain(df, "event_type", conform.EVENT_TYPES, "invalid_event_type")
    assert sorted(r.event_id for r in good.collect()) == [0, 1, 2, 3, 4] and sorted(r.event_id for r in bad.collect()) == [5, 6]
    assert sorted(r.event_id for r in conform.distinct_events(df).collect()) == [0, 1, 2, 3, 4]


def test_inserts_in_many_files_are_all_counted(spark, sf_dir, tmp_path):
    """Rows of any time in any file, as in a large table: the watermark of one file drops none of another."""
    from brackwater.plans import catalog

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.repartition(6).write.parquet(f"{tmp_path}/orders.parquet")
    assert sum(r.orders for r in catalog.stream_status_counts(spark, str(tmp_path)).collect()) == orders.count()


def test_the_stored_fact_has_no_hashes(spark, sf_dir):
    from brackwater.plans import catalog

    fact = catalog._fact(spark, sf_dir)
    stored = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in fact.inputFiles()})
    assert not [c for c in stored.columns if c.startswith("sk_")]
    assert fact.exceptAll(catalog._made_fact(spark, sf_dir)).isEmpty() and fact.count() == stored.count()


def test_a_frame_is_counted_once_for_all_its_schemas(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, v string")
    contract = quality.T.StructType([quality.T.StructField("k", quality.T.LongType(), False), quality.T.StructField("v", quality.T.StringType()), quality.T.StructField("w", quality.T.StringType())])
    got = quality.contract_report({"t": (df, contract, "k")}, {"t": [df.schema, df.drop("v").schema, df.drop("k").schema]})
    apart = [quality.contract_report({"t": (x, contract, "k")}) for x in (df, df.drop("v"), df.drop("k"))]
    assert rows(got) == sorted(r for x in apart for r in rows(x)) and len(rows(got)) == 9
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_messages_come_in_the_files_of_their_input(spark, sf_dir, tmp_path):
    """No fixed number of tasks for all messages: more splits of the input make more files, in four batches."""
    from brackwater.plans import live

    for t in ("events", "orders"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(12).write.parquet(f"{tmp_path}/{t}.parquet")
    root = live._land_topics(spark, str(tmp_path))
    assert len([n for n in files.names(spark, f"{root}/in") if n.endswith(".parquet")]) > 12
    assert files.names(spark, f"{root}/dead_letters") == [f"batch={n}" for n in range(4)]
    assert all(not spark.read.parquet(f"{root}/orders_cdc/batch={n}").isEmpty() for n in range(4))


def test_the_gate_passes_once_for_all_runs(spark, sf_dir, monkeypatch):
    from brackwater.plans import catalog

    seen, replace = [], sinks.replace_run
    monkeypatch.setattr(sinks, "replace_run", lambda df, path, run: seen.append(len(df.inputFiles()) and all("/gate/" in f for f in df.inputFiles())) or replace(df, path, run))
    catalog.quarantine_runs(spark, sf_dir)
    assert seen == [True] * 3


def test_the_store_is_rewritten_three_times_whatever_the_files(spark, sf_dir, tmp_path, monkeypatch):
    from brackwater.plans import catalog

    spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(12).write.parquet(f"{tmp_path}/orders.parquet")
    merges, merge = [], store.BucketStore.merge
    monkeypatch.setattr(store.BucketStore, "merge", lambda self, batch, number, combine: merges.append(number) or merge(self, batch, number, combine))
    got = catalog.stream_orders_current(spark, str(tmp_path))
    assert merges == [0, 1, 2] and rows(got) == rows(catalog.stream_orders_current(spark, sf_dir))


def test_dropped_rows_are_counted(spark, tmp_path):
    schema, at = "event_id string, ts timestamp", datetime(2024, 1, 1, 12)
    dropped = []
    for batch in ([("a", at), ("b", at + timedelta(minutes=30))], [("c", at + timedelta(minutes=5)), ("d", at + timedelta(minutes=25)), ("e", at)], [("f", at + timedelta(hours=1))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        dropped.append(streams.run_to_table(streams.deduplicated(streams.file_stream(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/out", f"{tmp_path}/c"))
    assert dropped == [0, 2, 0]
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "d", "f"]
