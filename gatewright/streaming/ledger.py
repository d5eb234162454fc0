"""Keyed tables that a stream upserts into, and a budget with reservations.

A keyed table is a folder of buckets by a hash of the key. A batch rewrites the buckets that it touches, each in a folder of
its own version, and then commits a manifest that names every bucket's version. Readers see whole manifests alone. The batch
id is the version: a batch that comes again after a failure finds its manifest and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: How columns of old and new rows of a key become one: `keep` has the first seen (insert or ignore), the others what they say.
WAYS = {"max": F.max, "min": F.min, "sum": F.sum}


class KeyedTable:
    """A table with one row for each key. ways: for every other column `max`, `min`, `sum` or `keep`. Null keys are a key.
    With `keep`, `order` names the column whose least value was first; of equal ones the least row holds."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], ways: dict[str, str], order: str | None = None, buckets: int = 16):
        if set(schema.names) != {*keys, *ways} or set(ways.values()) - {*WAYS, "keep"} or ("keep" in ways.values()) != (order is not None):
            raise ValueError("every column is a key or has a way, and `keep` needs an order")
        self.spark, self.path, self.schema, self.keys, self.ways, self.order, self.buckets = spark, path.rstrip("/"), schema, keys, ways, order, buckets

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def versions(self) -> list[int]:
        """Committed batch ids."""
        fs, path = self._folder("_manifest/*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()) for s in fs.globStatus(path) or [])

    def _manifest(self, version: int) -> dict[int, int]:
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/_manifest/{version}").collect()}  # a row a bucket

    def _rows(self, manifest: dict[int, int], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{v}/bucket={b}" for b, v in manifest.items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        found = self.versions()
        return self._rows(self._manifest(found[-1]) if found else {})

    def _merged(self, rows: DataFrame) -> DataFrame:
        kept = [c for c, w in self.ways.items() if w == "keep"]
        whole = [WAYS[w](c).alias(c) for c, w in self.ways.items() if w != "keep"]
        if kept:
            first = F.min(F.struct(F.col(self.order).alias("__o"), *[F.col(c).alias(f"__{c}") for c in kept])).alias("__first")
            return rows.groupBy(*self.keys).agg(*whole, first).select(*self.keys, *[c for c in self.ways if c not in kept], *[F.col(f"__first.__{c}").alias(c) for c in kept]).select(*self.schema.names)
        return rows.groupBy(*self.keys).agg(*whole).select(*self.schema.names)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. A committed batch id changes nothing; one that failed half-way is written anew."""
        done = self.versions()
        if batch_id in done:
            return
        before = self._manifest(done[-1]) if done else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = self._merged(batch.select(*self.schema.names)).persist()
        touched = {r[0] for r in fresh.select(bucket).distinct().collect()}  # buckets at most
        every = self._merged(self._rows(before, touched).unionByName(fresh)).withColumn("bucket", bucket)
        every.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{batch_id}")
        fresh.unpersist()
        after = before | dict.fromkeys(touched, batch_id)
        self.spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifest/{batch_id}")


def upserting(stream: DataFrame, into: KeyedTable, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda x: x):
    """A writer of the stream into the table; start() it. change: from a batch to rows of the table."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: into.upsert(change(batch), batch_id)).option("checkpointLocation", checkpoint)


class _Budget(StatefulProcessor):
    """State of one account: what is spent, and each open reservation's amount."""

    def __init__(self, cap: float, hold_ms: int):
        self.cap, self.hold_ms = cap, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "amount double")
        self.open = handle.getMapState("open", "ref string", "amount double, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        spent = self.spent.get()[0] if self.spent.exists() else 0.0
        held = {k[0]: (v[0], v[1]) for k, v in self.open.iterator()} if self.open.exists() else {}
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable").itertuples():
            reserved = sum(a for a, _ in held.values())
            if r.kind == "reserve":
                if r.ref in held:
                    said = "repeated"
                elif spent + reserved + r.amount > self.cap + 1e-9:
                    said = "refused"
                else:
                    said = "granted"
                    until = int(r.ts.timestamp() * 1000) + self.hold_ms
                    held[r.ref] = (r.amount, until)
                    self.open.updateValue((r.ref,), (r.amount, until))
                    self.handle.registerTimer(until)
            else:
                said = "settled" if r.ref in held else "late"
                if r.ref in held:
                    del held[r.ref]
                    self.open.removeKey((r.ref,))
                spent += r.amount
            out.append((key[0], r.event_id, said, spent, sum(a for a, _ in held.values())))
        self.spent.update((spent,))
        yield pd.DataFrame(out, columns=["account", "event_id", "outcome", "spent", "reserved"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(k[0], v[0]) for k, v in self.open.iterator() if v[1] <= at] if self.open.exists() else []
        for ref, _ in gone:
            self.open.removeKey((ref,))
        left = sum(v[0] for _, v in self.open.iterator()) if self.open.exists() else 0.0
        spent = self.spent.get()[0] if self.spent.exists() else 0.0
        yield pd.DataFrame([(key[0], None, "given back", spent, left)] * bool(gone), columns=["account", "event_id", "outcome", "spent", "reserved"]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def ledger(events: DataFrame, cap: float, hold: int, late: str = "1 minute") -> DataFrame:
    """account, event_id, outcome, spent, reserved: a stream of reservations and settlements under a cap.

    events: account, event_id, ts, kind (`reserve` or `settle`), ref, amount (an estimate, or what it cost). A reservation is
    granted if what is spent, what is reserved and its estimate stay within the cap. Settling gives the estimate back and
    spends the amount. A reservation that is not settled for `hold` seconds of event time is given back by a timer; if it is
    settled after that, it has cost what it has cost, and is booked as late. An open ref that is reserved again changes
    nothing. Rows of a batch are taken in order of time. The session needs the RocksDB state store."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("account").transformWithStateInPandas(_Budget(cap, hold * 1000), "account string, event_id long, outcome string, spent double, reserved double", "append", "EventTime")
