"""Ordered operators over streams equal their row forms; the bus as a source; control of queries."""

import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import state
from lodestar.sources.bus import Bus, Folder
from lodestar.streaming import stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before)


def streamed(spark, tmp_path, rows, fold, late="100 seconds"):
    """The fold over the rows as a stream of three files, the last of which only moves the watermark."""
    parts = [rows.filter("file = 0"), rows.filter("file = 1"), rows.filter("file = 2")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "t" + tmp_path.name.replace("-", "_")
    run = fold(source.withWatermark("ts", late)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    assert run.exception() is None
    return spark.table(name)


def test_quota_over_a_late_stream(rocks, tmp_path):
    """Rows that arrive after later ones, and null costs, get the answers of the row form."""
    spark = rocks
    rows = [("a", 10, 60.0, 0), ("a", 30, 50.0, 0), ("a", 20, 30.0, 1), ("b", 5, None, 1), ("b", 6, 101.0, 0), ("a", 40, 10.0, 1), ("z", 5000, 1.0, 2)]
    df = spark.createDataFrame(rows, "k string, at long, cost double, file int").withColumn("ts", F.timestamp_seconds(F.col("at") + 1000))
    fold = lambda x: state.quota(x, 100.0, ["k"], ["at"], "cost")
    told = lambda x: sorted((r.k, r.at, r.accepted, r.used) for r in x.filter("k <> 'z'").collect())
    got = told(streamed(spark, tmp_path, df, fold))
    assert got == told(fold(df)) and ("a", 30, False, 90.0) in got and ("b", 5, True, 0.0) in got


def test_delivery_over_a_late_stream(rocks, tmp_path):
    spark = rocks
    rows = [(0, "publish", "m1", 0), (2, "call", None, 0), (1, "publish", "m2", 1), (3, "call", None, 1), (4, "ack", "m2", 0), (8, "call", None, 0), (14, "call", None, 1), (20, "call", None, 1), (9000, "call", None, 2)]
    df = spark.createDataFrame([("r", float(x), *y) for x, *y in rows], "r string, at double, kind string, msg string, file int").withColumn("ts", F.timestamp_seconds(F.col("at") + 1000))
    fold = lambda x: state.consumed(x, ["r"], "at", [])
    told = lambda x: sorted((r.at, r.given or "", r.tries or 0, r.dead) for r in x.filter("kind = 'call' AND at < 9000").collect())
    got = told(streamed(spark, tmp_path, df, fold))
    assert got == told(fold(df)) and [g[1] for g in got] == ["m1", "m2", "m1", "m1", "m1"] and got[-1][3]


def test_cache_over_a_late_stream(rocks, tmp_path):
    spark = rocks
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(0.0, False, a, 0), (2.0, False, b, 0), (1.0, False, a, 1), (11.0, False, a, 0), (12.0, False, a, 1), (13.0, True, None, 1), (14.0, False, a, 1), (9000.0, False, a, 2)]
    df = spark.createDataFrame([("x", *r) for r in rows], "tenant_id string, at double, invalidates boolean, v array<double>, file int").withColumn("ts", F.timestamp_seconds(F.col("at") + 1000))
    fold = lambda x: state.cached(x, ["tenant_id"], "at", "v", 0.9, 10, 50)
    told = lambda x: sorted((r.at, -1.0 if r.hit_at is None else r.hit_at, r.held) for r in x.filter("at < 9000").collect())
    assert told(streamed(spark, tmp_path, df, fold)) == told(fold(df))


def test_a_stream_without_a_watermark_is_refused(spark, tmp_path):
    source = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="watermark"):
        state.quota(source, 1.0, ["value"], ["value"], "value")


def messages(spark, ids):
    return spark.createDataFrame([(f"m{i}", "s", f"r{i % 2}", "task", "{}", float(i), 60) for i in ids], "msg_id string, sender string, recipient string, type string, payload string, sent double, ttl int")


def test_bus_loses_and_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(Bus)
    bus, out, at = str(tmp_path / "bus"), str(tmp_path / "out"), str(tmp_path / "at")

    def publish(batch, ids):
        messages(spark, ids).write.format("lodestar_bus").mode("append").option("path", bus).option("batch", batch).save()

    def consume():
        source = spark.readStream.format("lodestar_bus").option("path", bus).load()
        run = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
        return sorted(r.msg_id for r in spark.read.parquet(out).collect())

    publish("a", range(3))
    publish("a", range(3))  # sent again
    assert consume() == ["m0", "m1", "m2"] == consume()
    publish("b", range(3, 5))
    publish("c", [])
    assert consume() == [f"m{i}" for i in range(5)]  # a restarted query goes on
    table = spark.read.format("lodestar_bus").option("path", bus).load()
    assert sorted(r.msg_id for r in table.collect()) == [f"m{i}" for i in range(5)] and Folder(bus).count() == 3


def test_bus_as_a_sink_of_a_stream(spark, tmp_path):
    spark.dataSource.register(Bus)
    messages(spark, range(4)).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        source = spark.readStream.schema(messages(spark, []).schema).parquet(str(tmp_path / "in"))
        run = source.writeStream.format("lodestar_bus").option("path", str(tmp_path / "bus")).option("writer", "w").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
    folder = Folder(str(tmp_path / "bus"))
    assert not folder.commit("w", 0, ["other"])  # a batch that a restarted writer repeats
    assert sorted(r.msg_id for r in spark.read.format("lodestar_bus").option("path", str(tmp_path / "bus")).load().collect()) == ["m0", "m1", "m2", "m3"]


def test_control_stops_a_running_query_and_progress_is_told(spark, tmp_path):
    progress = stateful.Progress()
    spark.streams.addListener(progress)
    try:
        work = spark.readStream.format("rate").option("rowsPerSecond", 5).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "w")).start()
        schema = "agent string, at double, kind string, until double"
        folder = str(tmp_path / "control")
        spark.createDataFrame([("a", 1.0, "cleared", None), ("b", 1.0, "set", None)], schema).write.parquet(folder)
        stopped = []
        control = stateful.watch(spark.readStream.schema(schema).parquet(folder), {"a": work}, stopped, str(tmp_path / "c"))
        control.processAllAvailable()
        assert work.isActive and not stopped
        spark.createDataFrame([("a", 2.0, "set", None)], schema).write.mode("append").parquet(folder)
        began = time.time()
        control.processAllAvailable()
        assert not work.isActive and [a for a, _ in stopped] == ["a"] and time.time() - began < 20
        control.stop()
        for _ in range(50):
            if sum(e == "result" for _, e, _ in progress.events) >= 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    kinds = [e for q, e, _ in progress.events if q == str(work.id)]
    assert kinds[0] == "start" and kinds[-1] == "result" and all(f.endswith("\n\n") for f in progress.frames())


def test_last_message_of_control_counts(spark):
    rows = [("a", 1.0, "set", None), ("a", 2.0, "cleared", None), ("b", 1.0, "set", 50.0), ("c", 1.0, "set", 5.0), ("d", 3.0, "set", None)]
    assert sorted(stateful.killed(spark.createDataFrame(rows, "agent string, at double, kind string, until double"), 10.0)) == ["b", "d"]
