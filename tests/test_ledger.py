"""Upserts that come again, and budgets whose reservations run out."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gatewright.sources.fixtures import requests
from gatewright.streaming import ledger as lg

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = StructType().add("email", "string").add("last_seen", "timestamp").add("first_path", "string").add("first_ts", "timestamp").add("requests", "long")
WAYS = {"last_seen": "max", "first_path": "keep", "first_ts": "min", "requests": "sum"}


def as_rows(log):
    return log.select("email", F.col("ts").cast("timestamp").alias("last_seen"), F.col("path").alias("first_path"), F.col("ts").cast("timestamp").alias("first_ts"), F.lit(1).cast("long").alias("requests"))


def keyed(spark, path):
    return lg.KeyedTable(spark, path, SCHEMA, ["email"], WAYS, order="first_ts", buckets=4)


def test_stream_stopped_and_started_gives_the_batch_result(spark, tmp_path):
    log = requests(spark, SF_DIR).orderBy("ts", "event_id")
    into, source, state = keyed(spark, str(tmp_path / "users")), str(tmp_path / "log"), str(tmp_path / "state")
    n, parts = log.count(), 3
    placed = log.withColumn("__k", F.row_number().over(Window.orderBy("ts", "event_id")))
    stream = None
    for k in range(parts):
        placed.where((F.col("__k") > k * n // parts) & (F.col("__k") <= (k + 1) * n // parts)).drop("__k").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        lg.upserting(stream, into, state, as_rows).trigger(availableNow=True).start().awaitTermination()
    assert len(into.versions()) == parts
    got = {r["email"]: r for r in into.read().collect()}
    want = log.groupBy("email").agg(F.max("ts").alias("last"), F.min("ts").alias("first"), F.min_by("path", F.struct("ts", "path")).alias("path"), F.count("*").alias("n")).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r["email"]]
        assert (g["last_seen"], g["first_ts"], g["first_path"], g["requests"]) == (r["last"], r["first"], r["path"], r["n"])


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    into = keyed(spark, str(tmp_path / "t"))
    t = datetime.datetime(2024, 1, 1)
    rows = lambda *x: spark.createDataFrame([(e, t + datetime.timedelta(hours=h), p, t + datetime.timedelta(hours=h), 1) for e, h, p in x], SCHEMA)
    assert into.read().count() == 0
    into.upsert(rows(("a", 1, "/x"), ("b", 2, "/y"), (None, 3, "/z")), 0)
    into.upsert(rows(("a", 0, "/early"), ("c", 5, "/c")), 1)
    once = sorted(map(str, into.read().collect()))
    into.upsert(rows(("a", 0, "/early"), ("c", 5, "/c")), 1)
    assert sorted(map(str, into.read().collect())) == once and into.versions() == [0, 1]
    got = {r["email"]: r for r in into.read().collect()}
    assert (got["a"]["requests"], got["a"]["first_path"], got["a"]["last_seen"].hour) == (2, "/early", 1) and set(got) == {"a", "b", "c", None}
    # a batch that failed before its manifest is not seen, and is written anew
    rows(("d", 1, "/d")).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "t/2"))
    assert sorted(map(str, into.read().collect())) == once
    into.upsert(rows(("d", 1, "/d")), 2)
    assert into.read().where("email = 'd'").count() == 1 and into.read().count() == 5
    with pytest.raises(ValueError):
        lg.KeyedTable(spark, "x", SCHEMA, ["email"], {**WAYS, "requests": "keep"})


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run_ledger(spark, tmp_path, batches, cap, hold):
    source, out = str(tmp_path / "events"), []
    start = datetime.datetime(2024, 1, 1)
    schema = "account string, event_id long, ts timestamp, kind string, ref string, amount double"
    for k, rows in enumerate(batches):
        made = [(a, i, start + datetime.timedelta(seconds=s), kind, ref, amount) for a, i, s, kind, ref, amount in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = lg.ledger(stream, cap, hold).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def test_reservations_run_out(spark, tmp_path, rocks):
    batches = [
        [("x", 1, 0, "reserve", "a", 6.0), ("x", 2, 1, "reserve", "b", 3.0), ("x", 3, 2, "reserve", "c", 2.0), ("x", 4, 3, "settle", "b", 1.0), ("x", 5, 4, "reserve", "c", 3.0)],
        [("y", 6, 1000, "reserve", "far", 1.0)],  # moves the watermark on: x's open reservations run out
        [("x", 7, 1001, "reserve", "d", 9.0), ("x", 8, 1002, "settle", "a", 5.0), ("x", 9, 1003, "reserve", "e", 0.5)],
    ]
    got = run_ledger(spark, tmp_path, batches, cap=10.0, hold=60)
    said = {r["event_id"]: r["outcome"] for r in got if r["event_id"] is not None}
    assert said == {1: "granted", 2: "granted", 3: "refused", 4: "settled", 5: "granted", 6: "granted", 7: "granted", 8: "late", 9: "refused"}
    assert any(r["outcome"] == "given back" and r["account"] == "x" for r in got)
    last = [r for r in got if r["event_id"] == 9][0]
    assert (last["spent"], last["reserved"]) == (6.0, 9.0)


def test_cap_is_never_exceeded(spark, tmp_path, rocks):
    """Whatever is asked, what is granted stays within the cap, reservations counted."""
    rng = random.Random(2)
    rows, open_ = [], []
    for i in range(200):
        if open_ and rng.random() < 0.4:
            ref, most = open_.pop(rng.randrange(len(open_)))
            rows.append(("x", i, i, "settle", ref, most * rng.random()))
        else:
            rows.append(("x", i, i, "reserve", f"r{i}", rng.random() * 4))
            open_.append((f"r{i}", rows[-1][5]))
    granted = {r["event_id"]: r for r in run_ledger(spark, tmp_path, [rows[:90], rows[90:]], cap=25.0, hold=100_000)}
    assert {r["outcome"] for r in granted.values()} == {"granted", "refused", "settled", "late"}
    assert all(r["spent"] + r["reserved"] <= 25.0 + 1e-6 for r in granted.values() if r["outcome"] == "granted")
