"""Filter interaction audit: what each filter of a sequence removes alone, with and before the others, in every order.

Exact repetition is found by an RDD routed by fingerprint: texts go to partitions by their xxhash, sorted by it, so that
one fingerprint's collision chain (full texts with their least id) is held at a time. Each partition of the input first
keeps the least id of each of its texts and passes on the others as repeated, so a text goes on once for each partition
however many copies it has. Ids that are not the least of their text are emitted. combineByKey then merges vectors that
count, for each part, the documents of every set of failed filters.

Null texts are empty; empty texts are equal to each other. Words are separated by ASCII white space; a text without words
has none and so fails A. Rows with one id and one text are not smaller than each other: if no smaller id has the text,
neither is repeated. A null id is larger than all others, and equal to other nulls. Null parts are the empty part. A
document that the labels list several times is good (toxic) if any of its rows says so. Long texts are whole in one task.
Extra columns are left alone. No documents: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from gatewright.llm.common import cut, table

#: Bytes of texts that the first pass holds before it hands its chains on.
HELD_BYTES = 32 << 20

#: Rows of the input for one partition of fingerprints; there are as many partitions as the input has, at least.
PARTITION_ROWS = 20_000

_UPPER, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(rb"[#$%&*|]")
REPEATED = "E"
FILTERS = "ABCD" + REPEATED


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    found = text.split()
    few = len(found) < 200
    same = 100 * len(set(found)) < 50 * len(found)
    code_points = len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))
    loud = 100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * code_points
    return few | same << 1 | loud << 2 | bool(_MARKS.search(text)) << 3


class Chains:
    """Fingerprint -> texts with that fingerprint, each with its mask, its least id and the parts of the rows with it, counted.
    Rows with a larger id are handed out as soon as that is known."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, fingerprint: int, text: bytes, mask: Callable[[bytes], int] | int, key: object, parts: dict[str, int]) -> tuple[int, object, dict[str, int]] | None:
        """The rows now known to repeat a smaller id's text: their mask, id and parts."""
        chain = self.of.setdefault(fingerprint, [])
        for entry in chain:
            if entry[0] == text:
                break
        else:
            chain.append([text, mask(text) if callable(mask) else mask, key, parts])
            self.bytes += len(text)
            return None
        if key == entry[2]:
            entry[3] = {p: parts.get(p, 0) + entry[3].get(p, 0) for p in parts | entry[3]}
            return None
        if entry[2] is None or key is not None and key < entry[2]:
            out = entry[1], entry[2], entry[3]
            entry[2:] = [key, parts]
            return out
        return entry[1], key, parts

    def drain(self) -> Iterator[tuple[int, list]]:
        yield from ((fp, entry) for fp, chain in self.of.items() for entry in chain)
        self.__init__()


def _fingerprint(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def _local(rows: Iterator[tuple], mask: Callable[[bytes], int], hold: int) -> Iterator[tuple[int, tuple]]:
    """Of each text the rows of the least id, with the text; other rows without one, routed by their id."""
    chains = Chains()
    for key, text, part in rows:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if known := chains.add(_fingerprint(data), data, mask, key, {part: 1}):
            yield _fingerprint(repr(known[1]).encode()), (None, *known)
        if chains.bytes > hold:
            yield from ((fp, tuple(entry)) for fp, entry in chains.drain())
    yield from ((fp, tuple(entry)) for fp, entry in chains.drain())


def _settled(rows: Iterator[tuple[int, tuple]], repeated: int) -> Iterator[tuple]:
    """id, part and mask of every row; rows come sorted by fingerprint."""
    def rows_of(mask: int, key: object, parts: dict[str, int]) -> Iterator[tuple]:
        return ((key, p, mask) for p, n in parts.items() for _ in range(n))

    def least() -> Iterator[tuple]:
        for _, (_, mask, key, parts) in chains.drain():
            yield from rows_of(mask, key, parts)

    chains, last = Chains(), None
    for fp, (text, mask, key, parts) in rows:
        if fp != last:
            yield from least()
            last = fp
        known = (mask, key, parts) if text is None else chains.add(fp, text, mask, key, parts)
        if known:
            yield from rows_of(known[0] | repeated, *known[1:])
    yield from least()


def masks(df: DataFrame, key: str, text: str, part: Column, mask: Callable[[bytes], int] = failures, repeated: int = 1 << FILTERS.index(REPEATED), hold: int = HELD_BYTES) -> DataFrame:
    """A row for every row of df: key, part (a string) and mask, the bits of the filters that it fails: those that `mask`
    finds in the text, and `repeated` if a smaller id has the same text."""
    wanted = -(-df.count() // PARTITION_ROWS)
    rows: RDD = df.select(key, text, F.coalesce(part, F.lit("")).alias("__part")).rdd.map(tuple)
    parts = max(1, wanted, rows.getNumPartitions())
    routed = rows.mapPartitions(lambda x: _local(x, mask, hold)).repartitionAndSortWithinPartitions(parts, lambda fp: fp)
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("part", StringType()), StructField("mask", IntegerType())])
    return df.sparkSession.createDataFrame(routed.mapPartitions(lambda x: _settled(x, repeated)), schema, verifySchema=False)


def non_minimum_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """The ids of the rows whose text a smaller id has, a row for each."""
    return masks(df, key, text, F.lit(""), lambda _: 0, 1).where("mask = 1").select(key)


def _audited(part: str, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """A row for every order and step from counts[mask, good, toxic]."""
    sets = np.arange(1 << len(letters))
    total, good, toxic = counts.sum((1, 2)), counts[:, 1].sum(1), counts[:, :, 1].sum(1)
    rows, removed_by = [], dict.fromkeys(letters, 0)
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            fails, gone = sets & bit > 0, sets & before > 0
            here = fails & ~gone
            removed = int(total[here].sum())
            rows.append(("".join(order), step, letter, int(total[(sets & (before | bit)) == 0].sum()), removed, int(total[fails & gone].sum()), int(total[bit]), int(good[here].sum()), int(toxic[here].sum())))
            removed_by[letter] += removed
            before |= bit
    for order, step, letter, *numbers in rows:
        yield part, order, step, *numbers, removed_by[letter]


def interactions(marked: DataFrame, letters: str) -> DataFrame:
    """For every part, every order of the filters and every step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. marked: part, mask (bit k: fails the k-th letter), good, toxic."""
    size = 4 << len(letters)

    def one(cell: int) -> np.ndarray:
        return add(np.zeros(size, np.int64), cell)

    def add(vector: np.ndarray, cell: int) -> np.ndarray:
        vector[cell] += 1
        return vector

    cells = marked.select("part", (F.col("mask") * 4 + F.col("good").cast("int") * 2 + F.col("toxic").cast("int")).alias("cell")).rdd.map(tuple)
    vectors = cells.combineByKey(one, add, np.add)
    rows = vectors.flatMap(lambda x: _audited(x[0], x[1].reshape(-1, 2, 2), letters))
    schema = StructType([StructField("part", StringType()), StructField("filter_order", StringType()), StructField("step", IntegerType())])
    for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"):
        schema.add(StructField(c, LongType()))
    return marked.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = masks(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("lang"))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    known = marked.join(labels, "doc_id", "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return interactions(cut(known, "masks"), FILTERS)


QUERIES = {"op13_filter_audit": op13_filter_audit}

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op13_filter_audit": f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, {_WORDS} AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS again FROM texts),
failed AS (
  SELECT doc_id, part, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN again THEN 'E' END) AS fails
  FROM split),
known AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT concat(a.l, b.l, c.l, d.l, e.l) AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, s, o[s] AS l, o[1:s - 1] AS p FROM orders, (SELECT unnest(range(1, 6)) AS s)),
crossed AS (SELECT *, contains(fails, l) AS here, translate(p, fails, '') <> p AS gone FROM cells, steps),
sums AS (
  SELECT part, o, s, l, sum(CASE WHEN here OR gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = l THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM crossed GROUP BY part, o, s, l)
SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM sums
"""
}
