"""Reading tables, cutting lineage in the shared folder, distributed components."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this subpackage: space and \t \n \v \f \r.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that a worker's cache keeps: two generations of this many.
CACHED_WORDS = 150_000

#: Seconds between two calls of the garbage collectors that let Spark find shuffle files nobody needs.
CLEAN_SECONDS = 4

_own: dict[str, str] = {}
_cleaned = [0.0]


#: Bytes of an Arrow batch that a Python worker is handed, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Texts differ in length by orders of magnitude, so a batch is bounded by bytes and not by its rows alone."""
    if spark.conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a single local JVM gets a
    temporary folder that goes when Python ends; a cluster has no such folder, so there it is an error."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="gatewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends at files that survive lost executors."""
    bound_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/gatewright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more, and have Spark drop the shuffle files of plans that are gone."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if time.monotonic() - _cleaned[0] > CLEAN_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _cleaned[0] = time.monotonic()


#: Words of 64 bits of the filter that keeps texts where they lie: 262,144 rows, whatever the number of keys.
FILTER_WORDS = 1 << 18


def maybe_among(df: DataFrame, key: str, wanted: DataFrame, flag: str | None = None) -> DataFrame:
    """The rows of df whose key may be among `wanted` (its first column): none that is is lost, few others stay as long
    as the keys are fewer than the filter's 16 million bits; beyond that it thins out less. With a flag: all rows, marked.
    The filter is broadcast, so that a join with few keys need not shuffle all texts."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS * 64))
    at = place(F.col(wanted.columns[0]))
    bits = wanted.select(at.alias("p")).selectExpr("p div 64 AS __w", "shiftleft(1L, CAST(p % 64 AS INT)) AS b")
    words = bits.groupBy("__w").agg(F.bit_or("b").alias("__bits"))
    own = df.withColumn("__p", place(F.col(key))).withColumn("__w", F.expr("__p div 64"))
    hit = F.expr("(shiftright(__bits, CAST(__p % 64 AS INT)) & 1L) = 1L")
    if flag is None:
        return own.join(F.broadcast(words), "__w").where(hit).select(*df.columns)  # at most FILTER_WORDS rows
    return own.join(F.broadcast(words), "__w", "left").select(*df.columns, F.coalesce(hit, F.lit(False)).alias(flag))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def _starred(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges (u, v), v < u: u's smaller neighbours and u itself joined to the least of them."""
    rows = edges.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return rows.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges (bigint columns a, b) as rows (id, component), component being the
    smallest id reachable; only ids that have an edge occur.

    Alternating large-star and small-star steps: each is a min() per node (combined map-side) and a join, so a node
    of any degree is never gathered in one task, and the number of rounds grows with the logarithm of the longest
    path. Every round ends in a table in the shared folder. Loops and repeated edges change nothing; no edges: no rows.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    # a first small-star step joins what shares a node
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    e = _starred(e, low)
    before = last = None
    while True:
        e = cut(e, "star")
        if last is not None:
            release(edges.sparkSession, last)
        # read from the table, not observed: an Observation stays in the session, and plans that hold the session can't be sent then
        now, last = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()), e
        if now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every u has only smaller neighbours now
        e = _starred(large, large.groupBy("u").agg(F.min("v").alias("m")))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


class WordCache:
    """word -> make(word), keeping the words of the last two generations."""

    def __init__(self, make: Callable[[str], object], size: int = CACHED_WORDS):
        self.make, self.size, self.new, self.old = make, size, {}, {}

    def one(self, word: str) -> object:
        found = self.new.get(word)
        if found is None:
            found = self.old.get(word)
            self.new[word] = found = self.make(word) if found is None else found
        return found

    def all(self, words: list[str]) -> list:
        new = self.new
        out = list(map(new.get, words))
        missing = [k for k, v in enumerate(out) if v is None]
        if missing:
            one = self.one
            for k in missing:
                out[k] = one(words[k])
            if len(new) > self.size:
                self.old, self.new = new, {}
        return out
