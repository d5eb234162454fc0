"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `n` consecutive words; an item of fewer words is one window. A window's set is that of
its shingles (runs of `k` words, or all of a shorter window), and a place of a document holds the window if it holds the
whole set in the window's places. As all shingles are required, the necessary prefix of a window in the order of rarity
is its rarest shingle alone: an occurrence of the window must hold that one. So windows and documents are joined on that
shingle; the place of the shingle in the window and in the document gives the only place where the window can begin
(positional bound), which must leave room for all of its words (length bound); and the words there are compared one by one.

One scan of the documents gives the counts that make rarity (every occurrence of an item's shingle in any document) and
the segments: runs of words all of whose shingles may be an item's, long enough for a window. What no segment holds can
hold no window. Equal segments are one class, so a passage that many documents share is joined once.

Null and blank texts, of documents or items, have no words; they are clean and hit nothing. Items without an id count
under the empty id; items with one id are one item. Repeated documents are rows of their own. A long text is read whole,
in one task. An empty table of items leaves all documents clean; one of documents gives no rows. Extra columns are left
alone. A segment's words are held by one task at a time, as is one document's list of segments.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from gatewright.llm.common import FILTER_WORDS, cut, release, table
from gatewright.llm.words import PATTERN, checksums, run_hashes, words

WINDOW, SHINGLE = 10, 3

#: Counted hashes that a task holds before it hands them on.
HELD_COUNTS = 200_000


def _windows(items: DataFrame, item: str, text: str, n: int, k: int) -> DataFrame:
    """item, window (its words joined by blanks), m (how many), size and hashes of its shingles: a row per window of an item."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(t)
                m = min(n, len(w))
                if not m:
                    continue
                size = min(k, m)
                hashes = run_hashes(checksums(w), size)
                out += [(name, b" ".join(w[i : i + m]).decode("utf-8", "surrogatepass"), m, size, hashes[i : i + m - size + 1].tolist()) for i in range(len(w) - m + 1)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["item", "window", "m", "size", "hashes"])

    named = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(cut_up, "item string, window string, m int, size int, hashes array<bigint>")


def _filter(windows: DataFrame) -> Broadcast:
    """A filter of fixed size (FILTER_WORDS words of 64 bits) of the windows' shingles."""
    place = F.pmod("h", F.lit(FILTER_WORDS * 64))
    bits = windows.select(F.explode("hashes").alias("h")).select(place.alias("p")).selectExpr("p div 64 AS w", "shiftleft(1L, CAST(p % 64 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(FILTER_WORDS, np.int64)
    for r in bits.collect():  # at most FILTER_WORDS rows
        out[r["w"]] = r["b"]
    return windows.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _scan(docs: DataFrame, key: str, text: str, bits: Broadcast, least: dict[int, int]) -> DataFrame:
    """Rows of three kinds: a document's (row, key, n_words), a segment's (row, start, segment), a shingle's (hash, n).
    least: for each size of shingles, how many in a row a window has at least."""
    kind = docs.schema[key].dataType
    arrow = [("row", pa.int64()), ("key", to_arrow_type(kind)), ("n_words", pa.int64()), ("segment", pa.string()), ("hash", pa.int64()), ("n", pa.int64())]
    schema = StructType([StructField("row", LongType()), StructField("key", kind), StructField("n_words", LongType())]).add("segment", "string").add("hash", "long").add("n", "long")

    def segments(w: list[bytes], sums: np.ndarray, counts: Counter) -> list[tuple[int, int]]:
        spans = []
        for size, run in least.items():
            h = run_hashes(sums, size)
            at = h & (FILTER_WORDS * 64 - 1)
            hit = np.flatnonzero(bits.value[at >> 3] >> (at & 7) & 1)
            if not len(hit):
                continue
            counts.update(h[hit].tolist())
            cuts = np.flatnonzero(np.diff(hit) > 1) + 1
            for a, b in zip([0, *cuts], [*cuts, len(hit)], strict=True):
                if b - a >= run:
                    spans.append((int(hit[a]), int(hit[b - 1]) + size))
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), arrow, strict=True)], [x for x, _ in arrow])

        for batch in batches:
            out = []
            for row, name, t in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                w = words(t)
                out.append((row, name, len(w), None, None, None))
                for a, b in segments(w, checksums(w), counts):
                    out.append((row, None, None, b" ".join(w[a:b]).decode("utf-8", "surrogatepass"), None, None))
            if len(counts) > HELD_COUNTS:
                out += [(None, None, None, None, h, c) for h, c in counts.items()]
                counts.clear()
            if out:
                yield made(out)
        if counts:
            yield made([(None, None, None, None, h, c) for h, c in counts.items()])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan, schema)


def _candidates(windows: DataFrame, segments: DataFrame, counts: DataFrame, sizes: list[int]) -> DataFrame:
    """segment id, start, m, window of every place where a window's rarest shingle stands with room for the window."""
    shingles = windows.select("window", "m", "size", F.posexplode("hashes").alias("o", "hash")).join(counts, "hash", "left")
    rarest = shingles.groupBy("window", "m", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "o")).alias("r")).select("window", "m", "size", "r.hash", "r.o")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(t)
                sums = checksums(w)
                for size in sizes:
                    h = run_hashes(sums, size)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(h)), pa.array([len(w)] * len(h), pa.int32()), pa.array([size] * len(h), pa.int32()), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], ["id", "words", "size", "p", "hash"])

    places = segments.select("id", "segment").mapInArrow(hashed, "id string, words int, size int, p int, hash bigint")
    start = F.col("p") - F.col("o")
    return places.join(rarest, ["hash", "size"]).where((start >= 0) & (start + F.col("m") <= F.col("words"))).select("id", start.alias("start"), "m", "window")


def contaminated(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, n: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit (words inside any occurrence of a window), n_items and items_sha256 (of
    the items with occurring windows: their ids as strings, sorted, joined by commas), contaminated."""
    windows = cut(_windows(items, item, item_text, n, k), "windows")
    runs = {r["size"]: r["least"] for r in windows.groupBy("size").agg(F.min(F.col("m") - F.col("size") + 1).alias("least")).collect()}  # at most k rows
    bits = _filter(windows)
    scanned = cut(_scan(docs, key, text, bits, runs), "scanned")
    counts = scanned.where("hash IS NOT NULL").groupBy("hash").agg(F.sum("n").alias("n"))
    held = scanned.where("segment IS NOT NULL").select("row", "segment", F.md5("segment").alias("id"))
    classes = cut(held.groupBy("id").agg(F.min("segment").alias("segment")), "segments")
    distinct = windows.dropDuplicates(["window"])
    words_there = F.expr("concat_ws(' ', slice(split(segment, ' '), start + 1, m))")
    found = cut(_candidates(distinct, classes, counts, sorted(runs)).join(classes, "id").where(words_there == F.col("window")).select("id", "start", "m", "window").distinct(), "found")
    covered = found.select("id", F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("p")).distinct().groupBy("id").agg(F.count("*").alias("n_hit"))
    # what each document holds: its classes of segments; documents with the same ones share the list of items
    per_row = cut(held.join(covered, "id").groupBy("row").agg(F.sum("n_hit").alias("n_hit"), F.sort_array(F.collect_set("id")).alias("ids")).withColumn("holds", F.md5(F.concat_ws(",", "ids"))), "rows")
    class_items = found.select("id", "window").distinct().join(windows.select("window", "item").distinct(), "window").select("id", "item").distinct()
    lists = per_row.groupBy("holds").agg(F.min("ids").alias("ids")).select("holds", F.explode("ids").alias("id")).join(class_items, "id").select("holds", "item").distinct()
    lists = cut(lists.groupBy("holds").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256")), "lists")
    release(docs.sparkSession, windows, classes, found)
    hits = per_row.select("row", "n_hit", "holds").join(lists, "holds")
    zero = F.lit(0).cast("long")
    out = scanned.where("n_words IS NOT NULL").select("row", "key", "n_words").join(hits, "row", "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


QUERIES = {"op12_decontamination": op12_decontamination}

_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')"

ORACLE_SQL = {
    "op12_decontamination": f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_SPLIT} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), {WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)),
grams AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows))),
found AS MATERIALIZED (SELECT r, i, m, item FROM grams JOIN windows USING (g, m)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM found)) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(h, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""
}
