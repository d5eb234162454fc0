"""Drained streams give what the batch queries give."""

import pytest
from pyspark.sql import functions as F

from gatewright.operators import usage
from gatewright.sources.fixtures import requests
from gatewright.streaming import usage as streams

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def feed(spark, tmp_path):
    """The request log in event order as a stream of files, and as a table."""
    log = requests(spark, SF_DIR).orderBy("ts").coalesce(1)
    log.write.parquet(str(tmp_path / "log"))
    table = spark.read.parquet(str(tmp_path / "log"))
    return spark.readStream.schema(table.schema).parquet(str(tmp_path / "log")), table, str(tmp_path / "state")


def drain(df, name, state, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_daily_counts(feed):
    stream, table, state = feed
    got = {r["day"]: r["requests"] for r in drain(streams.daily_counts(stream), "daily", state, "complete").collect()}
    assert got == {r["day"]: r["requests"] for r in usage.daily(table).collect() if r["requests"]}


def test_once(feed):
    stream, table, state = feed
    twice = stream.unionByName(stream.where("event_id % 2 = 0"))
    assert drain(streams.once(twice, "event_id"), "once", state).count() == table.count()


def test_quota(feed):
    stream, table, state = feed
    got = drain(streams.quota(stream, 2), "quota", state)
    want = usage.quota(table, 2).select("event_id", "refused")
    assert got.count() == want.count()
    assert got.where("refused").count() == want.where("refused").count()


def test_sessions(feed):
    stream, table, state = feed
    got = drain(streams.sessions(stream, "30 minutes"), "sessions", state)
    want = usage.sessions(table, "30 minutes")
    end = table.agg(F.max("ts")).first()[0]
    assert got.count() <= want.count() and got.exceptAll(want.withColumn("start", F.col("start").cast("timestamp")).withColumn("end", F.col("end").cast("timestamp"))).isEmpty() and end is not None
