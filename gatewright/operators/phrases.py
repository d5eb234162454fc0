"""Many phrases at once: all whole-word occurrences by an automaton and a join, and longest-match tagging by joins.

Phrases come from a table. Words are runs of letters and digits, lower-cased; a phrase occurs where its words stand in a
row, whatever is between them (`occurrences`) or with no clause break between them (`tags`). Null and blank texts and
phrases have no words: they hold nothing and occur nowhere. Repeated phrases are one phrase; repeated rows of documents are
rows of their own. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from gatewright.sources.scratch import cut

#: Bytes of phrases that the automaton is built from: the shortest, as they occur most. Longer ones are joined.
PART_BYTES = 4 << 20

#: Bits for a phrase in the filter before that join, and all bits at most (32 MB); more phrases let more other runs pass.
BITS_EACH, BITS_MOST = 16, 1 << 28

#: Bits of one row of the filter while it is made.
BLOCK_BITS = 1 << 19

#: Texts that are hashed at a time.
HASHED_ROWS = 256

_BASE = 0x9E3779B97F4A7C15

#: 64-bit words of the filter that drops runs of words that can be no phrase: fixed, whatever the number of phrases.
FILTER_WORDS = 1 << 18


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))


def _normal(phrases: DataFrame, phrase: str) -> DataFrame:
    """phrase: the distinct phrases as words joined by blanks."""
    return phrases.select(F.array_join(tokens(F.col(phrase)), " ").alias("phrase")).where("phrase <> ''").distinct()


def automaton(found: list[str]) -> ahocorasick.Automaton:
    """Of the phrases between blanks, so that only whole words match."""
    out = ahocorasick.Automaton()
    for p in found:
        out.add_word(f" {p} ", p)
    if found:
        out.make_automaton()
    return out


def _run_hashes(words: pa.Array, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each length with the 64-bit digests of all runs of so many words, by the first word's place."""
    coded = words.dictionary_encode()
    each = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()], np.uint64)
    n = len(words)
    steps = np.full(n + 1, _BASE, np.uint64)
    back = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    steps[:1] = back[:1] = 1
    steps, back = np.cumprod(steps), np.cumprod(back)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(each[coded.indices.to_numpy()] * steps[:n], out=upto[1:])
    for m in lengths:
        h = (upto[m:] - upto[: n + 1 - m]) * back[: n + 1 - m] if m <= n else upto[:0]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield m, h ^ (h >> np.uint64(29))


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a digest in a filter of size bits, a power of two."""
    return h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)


def _filter(phrases: DataFrame, size: int) -> np.ndarray:
    """The bits (packed, size / 8 bytes) of all phrases: made in blocks by tasks, put together on the driver."""
    width = min(BLOCK_BITS, size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.split_pattern(batch.column(0), " ")
            words, counts = split.flatten(), pc.list_value_length(split).to_numpy()
            first = np.cumsum(counts) - counts
            for m, h in _run_hashes(words, np.unique(counts).tolist()):
                bits = np.concatenate(_bits(h[first[counts == m]], size)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bits // width), pa.array(bits % width)], ["block", "bit"])

    def pack(part: pa.Table) -> pa.Table:
        block = np.zeros(width, bool)
        block[part.column("bit").to_numpy()] = True
        return pa.table({"block": part.column("block")[:1], "bits": pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())})

    rows = phrases.select("phrase").mapInArrow(place, "block long, bit long").groupBy("block").applyInArrow(pack, "block long, bits binary").collect()  # size / 8 bytes
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        at = r["block"] * (width // 8)
        out[at : at + width // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _joined(rows: DataFrame, key: str, known: DataFrame, lengths: list[int], count: int, kinds: StructType) -> DataFrame:
    """occurrences() of the phrases known, of these lengths: runs of words that pass the filter, joined with them."""
    size = min(BITS_MOST, max(BLOCK_BITS, 1 << (BITS_EACH * count - 1).bit_length()))
    sent = rows.sparkSession.sparkContext.broadcast(_filter(known, size))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, HASHED_ROWS):
                batch = whole.slice(at, HASHED_ROWS)
                split = pc.split_pattern(batch.column(1), " ")
                words, counts = split.flatten(), pc.list_value_length(split).to_numpy()
                row, ends = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts)
                for m, h in _run_hashes(words, lengths):
                    found = np.flatnonzero(np.arange(len(h)) + m <= ends[row[: len(h)]])
                    for bit in _bits(h, size):
                        b = bit[found]
                        found = found[(held[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
                    texts = pc.binary_join_element_wise(*[words.take(pa.array(found + j)) for j in range(m)], " ")
                    of = row[found]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), texts.cast(pa.string()), pa.array(found - (ends - counts)[of], pa.int64())], [key, "phrase", "start"])

    return rows.mapInArrow(runs, kinds).join(known.select("phrase"), "phrase").select(*kinds.names)


def occurrences(df: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """key, phrase, start (the place of its first word, from 0): a row for every occurrence of every phrase, those that
    overlap too. The shortest phrases, up to part_bytes, are found by one pass of an automaton over the texts, in Arrow
    batches. Of more, those of more words are joined with the texts' runs of as many words, in one further pass, whatever
    their number; a filter drops most of the runs before they are shuffled."""
    spark = df.sparkSession
    known = cut(_normal(phrases, phrase).withColumn("m", F.size(F.split("phrase", " "))), "phrases")
    sizes = known.groupBy("m").agg(F.sum(F.octet_length("phrase")).alias("bytes"), F.count("*").alias("n")).orderBy("m").collect()  # the distinct lengths
    upto = total = 0
    for r in sizes:
        total += r["bytes"]
        if total > part_bytes:
            break
        upto = r["m"]
    kinds = StructType().add(key, df.schema[key].dataType).add("phrase", StringType()).add("start", LongType())
    rows = df.select(key, F.array_join(tokens(F.col(text)), " ").alias("__text"))
    sent = spark.sparkContext.broadcast([r["phrase"] for r in known.where(F.col("m") <= upto).collect()])  # at most part_bytes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(sent.value)
        for batch in batches:
            took, found, starts = [], [], []
            for row, words in enumerate(batch.column(1).to_pylist()):
                line = f" {words} "
                before = [0, 0]  # how many blanks stand before a character
                for end, p in sorted((e - len(p) - 1, p) for e, p in machine.iter(line)):
                    before = [before[0] + line.count(" ", before[1], end + 1), end + 1]
                    took.append(row)
                    found.append(p)
                    starts.append(before[0] - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.int64())], [key, "phrase", "start"])

    longer = [r for r in sizes if r["m"] > upto]
    out = [rows.mapInArrow(scan, kinds)] if upto else []
    if longer:
        out.append(_joined(rows, key, known.where(F.col("m") > upto), [r["m"] for r in longer], sum(r["n"] for r in longer), kinds))
    if not out:
        return spark.createDataFrame([], kinds)
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _may_be(runs: DataFrame, phrases: DataFrame) -> DataFrame:
    """The runs (column run) that may be a phrase, by a filter of fixed size."""
    place = F.pmod(F.xxhash64(F.col("run")), F.lit(FILTER_WORDS * 64))
    known = phrases.select(F.pmod(F.xxhash64("phrase"), F.lit(FILTER_WORDS * 64)).alias("p")).selectExpr("p div 64 AS __w", "shiftleft(1L, CAST(p % 64 AS INT)) AS b").groupBy("__w").agg(F.bit_or("b").alias("__bits"))
    placed = runs.withColumn("__p", place).withColumn("__w", F.expr("__p div 64"))
    return placed.join(F.broadcast(known), "__w").where(F.expr("(shiftright(__bits, CAST(__p % 64 AS INT)) & 1L) = 1L")).select(*runs.columns)  # at most FILTER_WORDS rows


def tags(df: DataFrame, key: str, text: str, phrases: DataFrame, breaks: str = ".,;:!?", stop: tuple[str, ...] = (), neutral: str = "NEUTRAL") -> DataFrame:
    """key, start, end (places of words and breaks, from 0; end is the first after), kind, name: from left to right the
    longest phrase that begins at a place, else the word (kind WORD) unless it is in `stop`, else the clause break (BREAK).
    Phrases of the kind `neutral` take their words and leave no tag. phrases: phrase, kind, name; of equal phrases the
    first kind and name in alphabetical order hold.

    Runs of as many words as phrases have are joined with the phrases, thinned out by a filter before the shuffle; the
    sweep over the longest match of each place runs on chains of overlapping matches. No Python worker."""
    listed = phrases.select(F.array_join(tokens(F.col("phrase")), " ").alias("phrase"), "kind", "name").where("phrase <> ''")
    known = cut(listed.groupBy("phrase").agg(F.min(F.struct("kind", "name")).alias("x")).select("phrase", "x.kind", "x.name", F.size(F.split("phrase", " ")).alias("m")), "phrases")
    lengths = sorted(r["m"] for r in known.select("m").distinct().collect())  # the distinct lengths of phrases
    signs = "".join("\\" + c for c in breaks)
    pieces = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(rf"([\p{{L}}\p{{N}}]+|[{signs}])"))
    rows = cut(df.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), pieces.alias("__t")), "pieces")
    width = F.explode(F.array(*[F.lit(m) for m in lengths])) if lengths else F.lit(None).cast("int")
    sized = rows.select("__row", "__t", width.alias("m")).where(F.col("m") <= F.size("__t"))
    runs = sized.select("__row", "m", F.posexplode(F.expr("transform(sequence(1, size(__t) - m + 1), i -> array_join(slice(__t, i, m), ' '))")).alias("start", "run"))
    held = _may_be(runs, known).join(known.withColumnRenamed("phrase", "run"), ["run", "m"]).repartition("__row")  # the sweep's one shuffle
    longest = held.groupBy("__row", "start").agg(F.max(F.struct("m", "kind", "name")).alias("x")).select("__row", "start", (F.col("start") + F.col("x.m")).alias("end"), "x.kind", "x.name")
    none = F.expr("CAST(array() AS array<struct<start: int, end: int, kind: string, name: string>>)")
    # where no earlier match reaches, the sweep starts afresh: the matches between two such places are swept on their own
    so_far = Window.partitionBy("__row").orderBy("start")
    fresh = F.col("start") >= F.coalesce(F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    linked = longest.withColumn("__fresh", fresh.cast("int")).withColumn("__link", F.sum("__fresh").over(so_far))
    sorted_ = linked.groupBy("__row", "__link").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "name"))).alias("x"))
    took = lambda a, e: F.when(e["start"] >= a["at"], F.struct(e["end"].alias("at"), F.concat(a["got"], F.array(e)).alias("got"))).otherwise(a)
    swept = F.aggregate("x", F.struct(F.lit(0).alias("at"), none.alias("got")), took, lambda a: a["got"])
    taken = sorted_.select("__row", F.inline(swept)).groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "name"))).alias("__s"))
    # a row's words and breaks between its matches come out of its own array: places are never rows of a shuffle
    both = rows.join(taken, "__row", "left").select("__key", "__t", F.coalesce("__s", none).alias("__s"))
    ends, starts = F.concat(F.array(F.lit(0)), F.transform("__s", lambda e: e["end"])), F.concat(F.transform("__s", lambda e: e["start"]), F.array(F.size("__t")))
    gaps = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = lambda w: w.isin(*breaks) | ~w.isin(*stop) if stop else F.lit(True)
    one = lambda w, i: F.struct(i.alias("start"), (i + 1).alias("end"), F.when(w.isin(*breaks), "BREAK").otherwise("WORD").alias("kind"), w.alias("name"))
    between = F.flatten(F.transform(gaps, lambda g: F.transform(F.slice("__t", g["a"] + 1, g["b"] - g["a"]), lambda w, i: one(w, g["a"] + i))))
    alone, tagged = F.filter(between, lambda e: kept(e["name"])), F.filter("__s", lambda e: e["kind"] != neutral)
    return both.select(F.col("__key").alias(key), F.explode(F.concat(alone, tagged)).alias("x")).select(key, "x.*")
