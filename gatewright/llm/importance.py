"""Target-distribution importance resampling over bucket-partitioned inverted postings.

A document's features are its runs of one to three consecutive words; each falls into one of `buckets` buckets by its
CRC-32. Postings (bucket, document, count) are shuffled to ranges of buckets, packed for a block of documents at a time.
There they are co-grouped with both corpora's counts of the range's buckets, each bucket's gain (the logarithm of how much
more frequent it is in the target) is worked out on the spot, and what the range adds to each document is emitted and
summed by document. A range whose postings outgrow a task is dealt to several by block. The highest scores (weight plus
Gumbel noise from the id) are drawn: a sample without replacement in proportion to the importance weights.

Null and blank texts have no words, no features and weight 0; they are scored but not eligible where `least_words` is above
0. Null ids are hashed as empty text and come last among ties. Rows with equal ids are rows of their own, in any order among
equal scores. An empty target is a target of no features; no documents: no rows. A long text is read whole, in one task.
Extra columns are left alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from gatewright.llm.common import cut, partitions, release, table
from gatewright.llm.words import PATTERN, checksums, words

BUCKETS, RANGES, MOST_WORDS = 10_000, 16, 3

#: Bytes of packed postings of a range that one task takes; a larger range is dealt to several tasks.
TASK_BYTES = 32 << 20

_BLANK = zlib.crc32(b" ")


def _one_zero(c: np.ndarray) -> np.ndarray:
    """The checksum register after one more zero byte: eight shifts by the polynomial of CRC-32."""
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


class Shifts:
    """crc(a + b) = shift(crc(a), len(b)) ^ crc(b): the shift is linear, so it is looked up byte by byte. Tables for up to
    `most` bytes; longer words go through zlib's own work on zero bytes."""

    def __init__(self, most: int = 64):
        at = np.arange(256, dtype=np.uint32)
        rows = [np.concatenate([at << np.uint32(8 * k) for k in range(4)])]
        for _ in range(most):
            rows.append(_one_zero(rows[-1]))
        self.most, self.table = most, np.concatenate(rows)

    def __call__(self, sums: np.ndarray, by: np.ndarray) -> np.ndarray:
        base = np.minimum(by, self.most).astype(np.int64) * 1024
        out = self.table[base + (sums & 255)]
        for k in (1, 2, 3):
            out ^= self.table[base + (k * 256 + ((sums >> np.uint32(8 * k)) & 255))]
        for i in np.flatnonzero(by > self.most):
            zeros = bytes(int(by[i]))
            out[i] = zlib.crc32(zeros, int(sums[i])) ^ zlib.crc32(zeros)
        return out


_shifts: list[Shifts] = []


def feature_buckets(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each feature its text's place and its bucket; of each text how many words it has."""
    if not _shifts:
        _shifts.append(Shifts())
    lists = [words(t) for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = list(chain.from_iterable(lists))
    long = np.fromiter(map(len, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(lists)), n)
    sums = checksums(flat)
    after = _shifts[0](np.full(len(flat), _BLANK, np.uint32), long) ^ sums  # of a blank and the word
    docs, found, run = [doc], [sums], sums
    for k in range(1, MOST_WORDS):
        run = _shifts[0](run[:-1], long[k:] + 1) ^ after[k:]
        inside = doc[k:] == doc[:-k]
        docs.append(doc[k:][inside])
        found.append(run[inside])
    return np.concatenate(docs), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), n


def pack(sorted_keys: np.ndarray) -> bytes:
    """Ascending whole numbers as their differences, byte by byte of their four, compressed."""
    steps = np.diff(sorted_keys, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


#: Texts of a block: with ranges of 625 buckets their keys stay within four bytes.
BLOCK_TEXTS = 1024


def _postings(df: DataFrame, key: str, text: str, target: bool, buckets: int, ranges: int) -> DataFrame:
    """For each block of texts a row with their keys, features and words (range -1) and a row for each range with its
    packed postings and its counts of the range's buckets."""
    kind = df.schema[key].dataType
    width = -(-buckets // ranges)
    arrow = [("block", pa.int64()), ("target", pa.bool_()), ("range", pa.int32()), ("keys", pa.list_(to_arrow_type(kind))), ("n_features", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("postings", pa.binary()), ("size", pa.int64()), ("counts", pa.list_(pa.int64()))]
    schema = StructType([StructField("block", LongType()), StructField("target", BooleanType()), StructField("range", IntegerType()), StructField("keys", ArrayType(kind)), StructField("n_features", ArrayType(LongType())), StructField("n_words", ArrayType(LongType())), StructField("postings", BinaryType()), StructField("size", LongType()), StructField("counts", ArrayType(LongType()))])

    def block(name: int, keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        docs, at, n = feature_buckets(texts, buckets)
        spread = np.sort((at // width * len(texts) + docs) * width + at % width)
        edges = np.searchsorted(spread, np.arange(ranges + 1) * len(texts) * width)
        rows: list[tuple] = [(name, target, -1, keys.to_pylist(), np.bincount(docs, minlength=len(texts)).tolist(), n.tolist(), None, None, None)]
        for r in range(ranges):
            own = spread[edges[r] : edges[r + 1]] - r * len(texts) * width
            if len(own):
                data = pack(own)
                rows.append((name, target, r, None, None, None, data, len(data), np.bincount(own % width, minlength=width).tolist()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), arrow, strict=True)], [x for x, _ in arrow])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(i, BLOCK_TEXTS)
                yield block(part.column(0)[0].as_py(), part.column(1), part.column(2).to_pylist())

    # the first row's number names the block
    return df.select(F.monotonically_increasing_id().alias("block"), F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan, schema)


def _contribute(width: int, buckets: int):
    def contribute(posted: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(posted):
            return pd.DataFrame({"block": [], "target": [], "adds": []}, dtype=object)
        s, t = np.zeros(width), np.zeros(width)
        s[counts["bucket"]], t[counts["bucket"]] = counts["s"], counts["t"]
        every = counts.iloc[0]
        gain = np.floor(1000 * np.log((t + 1) * (every["all_s"] + buckets) / ((s + 1) * (every["all_t"] + buckets))))
        out = []
        for data in posted["postings"]:
            keys = unpack(data)
            # whole numbers far below 2^53: their sums in doubles are exact
            out.append(np.bincount(keys // width, weights=gain[keys % width]).astype(np.int64))
        return pd.DataFrame({"block": posted["block"], "target": posted["target"], "adds": out})

    return contribute


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """The block's documents with the sum of what the ranges add."""
    own = rows[rows["keys"].notna()].iloc[0]
    weight = np.zeros(len(own["keys"]), np.int64)
    for adds in rows["adds"]:
        if adds is not None:
            weight[: len(adds)] += adds
    return pd.DataFrame({"block": own["block"], "place": np.arange(len(weight)), "key": pd.Series(list(own["keys"]), dtype=object), "n_features": own["n_features"], "n_words": own["n_words"], "weight": weight})


def weights(docs: DataFrame, key: str, text: str, target: DataFrame, target_text: str, buckets: int = BUCKETS, ranges: int = RANGES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """block and place (of a row), key, n_features, n_words and weight of every row of docs."""
    width = -(-buckets // ranges)
    posts = cut(_postings(docs, key, text, False, buckets, ranges), "postings")
    wanted = _postings(target.select(F.lit(0).alias("k"), F.col(target_text).alias("t")), "k", "t", True, buckets, ranges)
    counted = lambda df: df.where("range >= 0").select("range", F.posexplode("counts").alias("bucket", "n")).where("n > 0").groupBy("range", "bucket").agg(F.sum("n").alias("n"))
    s, t = (counted(x).withColumnRenamed("n", c) for x, c in ((posts, "s"), (wanted, "t")))
    counts = cut(s.join(t, ["range", "bucket"], "full").na.fill(0, ["s", "t"]), "counts")  # a row a bucket
    sums = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    largest = posts.where("range >= 0").groupBy("range").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = max(1, math.ceil(largest / task_bytes))
    dealt = posts.where("range >= 0").select("block", "target", "range", "postings", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    here = counts.crossJoin(F.broadcast(sums)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))  # sums: one row
    added = dealt.groupBy("range", "salt").cogroup(here.groupBy("range", "salt")).applyInPandas(_contribute(width, buckets), "block long, target boolean, adds array<bigint>")
    own = posts.where("range < 0").select("block", "keys", "n_features", "n_words", F.lit(None).cast("array<bigint>").alias("adds"))
    rows = own.unionByName(added.drop("target"), allowMissingColumns=True)
    kind = docs.schema[key].dataType
    out = cut(rows.groupBy("block").applyInPandas(_summed, StructType([StructField("block", LongType()), StructField("place", LongType()), StructField("key", kind), StructField("n_features", LongType()), StructField("n_words", LongType()), StructField("weight", LongType())])), "weights")
    release(docs.sparkSession, posts, counts)
    return out


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """block, place, rank of the `most` highest scores, ties to the smaller key: ranges of scores are sorted on their own,
    and the rows before a range are added."""
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("block"), F.asc("place")]
    dealt = rows.select("block", "place", "key", "score").repartitionByRange(partitions(rows.sparkSession), *order)
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    some = dealt.join(F.broadcast(before.where(F.col("before") < most)), "part")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return some.select("block", "place", rank.alias("rank")).where(F.col("rank") <= most)


def resample(docs: DataFrame, key: str, text: str, target: DataFrame, target_text: str, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """One row per row of docs: key, n_features, weight, score and, for the floor(percent * N / 100) highest scores of the N
    documents with at least `least_words` words, rank."""
    scored = weights(docs, key, text, target, target_text)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = _ranked(eligible, percent * eligible.count() // 100)
    return scored.join(drawn, ["block", "place"], "left").select(F.col("key").alias(key), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")


QUERIES = {"op11_importance": op11_importance}

_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')"

ORACLE_SQL = {
    "op11_importance": f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS c FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
items AS (SELECT {_SPLIT} AS w FROM benchmark),
every AS (SELECT r, w FROM docs UNION ALL SELECT NULL AS r, w FROM items),
features AS MATERIALIZED (
  SELECT r, unnest(w) AS f FROM every
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM every
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM every),
placed AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(c[(xor(a, b) & 255) + 1], a >> 8))) % {BUCKETS} AS b
  FROM (SELECT DISTINCT f FROM features), crc_table),
counted AS MATERIALIZED (SELECT r, b, count(*) AS n FROM features JOIN placed USING (f) GROUP BY r, b),
sums AS (SELECT b, coalesce(sum(n) FILTER (r IS NOT NULL), 0)::BIGINT AS s, coalesce(sum(n) FILTER (r IS NULL), 0)::BIGINT AS t FROM counted GROUP BY b),
gains AS (
  SELECT b, floor(1000.0::DOUBLE * ln(((t + 1) * (all_s + {BUCKETS}))::DOUBLE / ((s + 1) * (all_t + {BUCKETS}))::DOUBLE))::BIGINT AS g
  FROM sums, (SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM sums)),
summed AS (SELECT r, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS weight FROM counted JOIN gains USING (b) WHERE r IS NOT NULL GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) >= 20 AS able, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN summed USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place FROM scored WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * 5 // 100 FROM scored WHERE able) THEN place END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
}
