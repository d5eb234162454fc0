"""Substring deduplication of paragraphs.

Paragraphs are lines of at least `least_words` words, which is a full shingle. Bands of MinHash signatures of their five-word shingles, tuned
for high recall, bring paragraphs together; colliding ones are verified by the exact Jaccard coefficient, and links
join them into components. A component's first paragraph (smallest key, then place) stays, all others go.

A passage inside longer paragraphs is caught by its windows in what the paragraphs leave: of all windows of 24 words
without a word of a line that goes, those with the smallest hash among 24 neighbours are kept, so that any 47 words that two places share have a kept window in common (a paragraph of
its own, equal word for word, within the other). Kept windows that several documents hold are seeds: around each of
them, in every document that has it, all windows less than 24 words away are compared, so the whole of such a run is
found, and no word of it stays. Very long texts are read whole. The first place of a window (smallest key, then place) stays, all others go, in the same
document too; a place that overlaps the first one in the same document loses what is beyond that. Overlapping spans
are one, and go if a seed in them goes.

Words are as in the shingles module. Null and empty texts have no paragraphs. Paragraphs and windows that repeat within a
document are members like any others. Rows without a key have paragraphs but no windows. Rows with equal keys and texts count as one document for windows. Extra columns
stay. White space between what is left of a text is left alone, but for lines that go as a whole with their line end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm import shingles as sh
from gatewright.llm.common import cut, maybe_among, release, table

LEAST_WORDS = 5
WINDOW = 24
MISS = 1e-5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def lines(text: str) -> list[sh.Unit]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line), sh.words_of(line)))
        at += len(line) + 1
    return out


def paragraph_plan(miss: float = MISS) -> sh.Plan:
    return sh.tune(5, 80, 100, miss)


def _sliding(x: np.ndarray, size: int, fn) -> np.ndarray:
    """fn over all windows of `size`, by doubling."""
    out, done = x, 1
    while done * 2 <= size:
        out, done = fn(out[:-done], out[done:]), done * 2
    rest = size - done
    return fn(out[: len(out) - rest], out[rest:]) if rest else out


def window_hashes(hashes: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hashes of all windows of a text's word hashes."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = hashes
        done = 1
        while done * 2 <= size:
            h, done = sh.mix(h[:-done] * sh._C1 + h[done:]), done * 2
        rest = size - done
        if rest:
            h = sh.mix(h[: len(h) - rest] * sh._C1 + h[rest:])
    return h


def window_places(hashes: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept windows of a text's word hashes, and the windows' hashes."""
    h = window_hashes(hashes, size)
    if not len(h):
        return np.empty(0, np.int64), h
    if len(h) <= size:
        kept = np.flatnonzero(h == h.min())
        return kept, h[kept]
    least = _sliding(h, size, np.minimum)
    # h[i] is kept if it is the least of a window that holds it
    padded = np.concatenate([np.zeros(size - 1, np.uint64), least, np.zeros(size - 1, np.uint64)])
    kept = np.flatnonzero(_sliding(padded, size, np.maximum) == h)
    return kept, h[kept]


def near_places(seeds: np.ndarray, n: int, size: int = WINDOW) -> np.ndarray:
    """Places of a text's n windows that are less than `size` words from a seed."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(seeds - (size - 1), 0), 1)
    np.add.at(step, np.minimum(seeds + size, n), -1)
    return np.flatnonzero(np.cumsum(step[:n]))


def _lines_of(text: str) -> tuple[list[bytes], np.ndarray]:
    """A text's words, and how many of them stand before the end of each line."""
    words, ends = [], []
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
        words += line.split()
        ends.append(len(words))
    return words, np.array(ends)


def windows(df: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """key, digest of the text, place (in words), first and last line and hash of the kept windows of whole texts."""
    slim = df.select(key, F.xxhash64(text).alias("digest"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [np.empty(0, np.int64)], [[np.empty(0, np.int64)] for _ in range(4)]
            for k, value in enumerate(batch.column(2)):
                words, ends = _lines_of(value.as_py() or "")
                p, h = window_places(sh.word_hashes(words), size)
                if len(h):
                    at.append(np.full(len(h), k))
                    for column, x in zip(found, (p, np.searchsorted(ends, p, "right"), np.searchsorted(ends, p + size - 1, "right"), h.view(np.int64)), strict=True):
                        column.append(x)
            rows = pa.array(np.concatenate(at), pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(np.concatenate(c), t) for c, t in zip(found, kinds, strict=True)]], [key, "digest", "at", "first", "last", "window"])

    return slim.mapInArrow(run, f"`{key}` {dict(slim.dtypes)[key]}, digest long, at int, first int, last int, window long")


def windows_near(df: DataFrame, key: str, text: str, seeds: DataFrame, lost: DataFrame, size: int = WINDOW) -> DataFrame:
    """key, digest, start and end (code points) and hash of all windows near the seeds (key, digest, at, late), and
    whether they are late seeds. Windows with a word of a lost line (key, parts) are left out."""
    mark = F.shiftleft("at", 1).bitwiseOR(F.col("late").cast("int"))
    asked = seeds.groupBy(F.col(key).alias("__key"), "digest").agg(F.collect_list(mark).alias("__at"))  # a document's own seeds
    asked = cut(asked.join(lost.select(F.col(key).alias("__key"), F.col("parts").alias("__lost")), "__key", "left"), "asked")
    slim = df.select(key, F.xxhash64(text).alias("__digest"), text)
    rows = maybe_among(slim, key, asked).join(asked, (F.col(key) == F.col("__key")) & (F.col("__digest") == F.col("digest"))).select(key, "digest", text, "__at", "__lost")

    def flush(keys: pa.Array, digests: pa.Array, at: list, starts: list, ends: list, found: list, late: list) -> pa.RecordBatch:
        take = pa.array(np.concatenate(at), pa.int64())
        return pa.RecordBatch.from_arrays([keys.take(take), digests.take(take), pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(late))], [key, "digest", "start", "end", "window", "late"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = ([], [], [], [], []), 0
            for k, (value, seen, gone) in enumerate(zip(batch.column(2), batch.column(3), batch.column(4), strict=True)):
                t = value.as_py()
                words, ends = _lines_of(t)
                h = window_hashes(sh.word_hashes(words), size)
                seeds = seen.values.to_numpy().astype(np.int64)
                late = np.zeros(len(h), bool)
                late[seeds[seeds & 1 > 0] >> 1] = True
                places = near_places(seeds >> 1, len(h), size)
                if gone.is_valid:
                    lines = np.unique(gone.values.to_numpy())
                    lines = lines[lines < len(ends)]
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, np.where(lines > 0, ends[lines - 1], 0), 1)
                    np.add.at(step, ends[lines], -1)
                    before = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]))))
                    places = places[before[places + size] == before[places]]
                spans = np.array([m.span() for m in _WORD.finditer(t)], np.int64).reshape(-1, 2)
                for column, x in zip(out, (np.full(len(places), k), spans[places, 0], spans[places + (size - 1), 1], h[places].view(np.int64), late[places]), strict=True):
                    column.append(x)
                held += len(places)
                if held > 300_000:
                    yield flush(batch.column(0), batch.column(1), *out)
                    out, held = ([], [], [], [], []), 0
            if held:
                yield flush(batch.column(0), batch.column(1), *out)

    return rows.mapInArrow(run, f"`{key}` {dict(slim.dtypes)[key]}, digest long, start int, end int, window long, late boolean")


def repeated_paragraphs(df: DataFrame, key: str, text: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, part, start, end (code points), component_id, kept: paragraphs that have a near duplicate."""
    plan, spark = paragraph_plan(), df.sparkSession
    banded = cut(sh.units(df, key, text, lines, plan, signed=False, least_words=least_words), "paragraphs")
    every = sh.classes(banded, key, signed=False)
    found = cut(banded.drop("bands"), "found")
    release(spark, banded)
    groups = sh.linked_classes(every, plan, lambda wanted: sh.full_sets(df, key, text, lines, plan, wanted)).withColumnRenamed("id", "cls")
    sizes = found.where("set_key is not null").groupBy("set_key").agg(F.count("*").alias("copies"))
    named = every.select("cls", "set_key", "place").join(groups, "cls", "left").join(sizes, "set_key").where("component is not null or copies > 1").withColumn("component", F.coalesce("component", "cls"))
    first = named.groupBy("component").agg(F.min("place").alias("first"))
    labels = cut(named.join(first, "component").select("set_key", F.col("component").alias("component_id"), "first"), "labels")
    release(spark, every)
    out = found.select(key, "part", "start", "end", "set_key").join(labels, "set_key")
    return out.select(key, "part", "start", "end", "component_id", (F.col(key).eqNullSafe(F.col("first.key")) & (F.col("part") == F.col("first.part"))).alias("kept"))


def repeated_windows(df: DataFrame, key: str, text: str, lost: DataFrame, size: int = WINDOW) -> DataFrame:
    """key, digest and spans (array of start and end in code points) of windows that stand at an earlier place too;
    rows of the documents that have any. lost: the lines (key, parts) that go anyway, whose words take no part. Rows
    without a key take no part."""
    spark = df.sparkSession
    every = windows(df, key, text, size).where(F.col(key).isNotNull()).join(lost, key, "left")
    free = F.col("parts").isNull() | ~F.exists("parts", lambda p: p.between(F.col("first"), F.col("last")))
    kept = cut(every.where(free).select(key, "digest", "at", "window"), "windows")
    # few windows come more than once; only theirs are first places looked for
    shared = cut(kept.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "shared")
    held = cut(maybe_among(kept, "window", shared).join(shared, "window"), "held")
    release(spark, kept, shared)
    place = F.struct(F.col(key).alias("key"), "digest", "at")
    seeds = held.join(cut(held.groupBy("window").agg(F.min(place).alias("first")), "first"), "window").withColumn("late", place != F.col("first")).drop("first")
    found = cut(windows_near(df, key, text, seeds, lost, size), "near")
    release(spark, held)
    place = F.struct(F.col(key).alias("key"), "digest", "start", "end")
    owners = found.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    again = found.join(cut(owners.select("window", "first"), "owners"), "window").where(place != F.col("first"))
    own = (F.col(key) == F.col("first.key")) & (F.col("digest") == F.col("first.digest"))
    again = again.withColumn("start", F.when(own, F.greatest("start", "first.end")).otherwise(F.col("start"))).where("start < end")
    place = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("end").cast("long"), 1)).bitwiseOR(F.col("late").cast("long"))
    rows = again.groupBy(key, "digest").agg(F.collect_list(place).alias("places"))  # a document's own windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for value in batch.column(2):
                x = np.sort(value.values.to_numpy())
                start, end, late = x >> 32, (x & 0xFFFFFFFF) >> 1, x & 1
                reach = np.maximum.accumulate(end)
                first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
                go = np.maximum.reduceat(late, first) > 0
                spans.append([{"start": a, "end": b} for a, b in zip(start[first][go].tolist(), np.maximum.reduceat(end, first)[go].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS)], [key, "digest", "spans"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, digest long, spans array<struct<start:int,end:int>>")


def removals(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Repeated paragraphs (kept ones too), and per document the spans of repeated windows."""
    paragraphs = cut(repeated_paragraphs(df, key, text), "repeated")
    lost = cut(paragraphs.where("not kept").groupBy(key).agg(F.collect_set("part").alias("parts")), "lost")  # a document's own lines
    release(df.sparkSession)
    return paragraphs, cut(repeated_windows(df, key, text, lost), "again")


def _spans(text: str, paragraphs: list[tuple[int, int]], windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged spans of code points to remove. Paragraphs take their line end with them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([*[(a, min(b + 1, len(text))) for a, b in paragraphs], *windows]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def clean(df: DataFrame, key: str, text: str, out: str = "removed") -> DataFrame:
    """df with `text` cleaned and `out` (in place of a column of this name): the removed spans (start, end in code points
    of the old text).

    Rows that lose nothing keep their text and get an empty array; rows with equal keys lose the same paragraphs, and
    with equal texts the same windows.
    """
    df = df.drop(*[c for c in (out,) if c not in (key, text)])
    paragraphs, places = removals(df, key, text)
    lost = paragraphs.where("not kept").groupBy(F.col(key).alias("__k")).agg(F.collect_set(F.struct("start", "end")).alias("__p"))
    found = places.groupBy(F.col(key).alias("__k")).agg(F.collect_list(F.struct("digest", "spans")).alias("__w"))  # one for each of its texts
    plan = cut(lost.join(found, "__k", "full_outer"), "plan")
    marked = maybe_among(df, key, plan, "__maybe")  # texts that lose nothing stay where they are
    rows = marked.where("__maybe").join(plan, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k", "__maybe")
    others = marked.where("not __maybe").drop("__maybe")
    own = F.filter("__w", lambda x: x["digest"] == F.xxhash64(text))
    rows = rows.withColumn("__w", F.flatten(F.transform(own, lambda x: x["spans"])))
    names = [c for c in rows.columns if c not in ("__p", "__w")]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in names) + f", `{out}` array<struct<start:int,end:int>>"
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(len(names))]
            p, w = batch.column(len(names)), batch.column(len(names) + 1)
            texts, spans = [], []
            for k, value in enumerate(columns[at]):
                t = value.as_py()
                found = _spans(t, *([(x["start"], x["end"]) for x in c[k].as_py() or []] for c in (p, w))) if t else []
                spans.append([{"start": a, "end": b} for a, b in found])
                if found:
                    parts, last = [], 0
                    for a, b in found:
                        parts.append(t[last:a])
                        last = b
                    t = "".join([*parts, t[last:]])
                texts.append(t)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, _SPANS)], [*names, out])

    same = others.withColumn(out, F.array().cast("array<struct<start:int,end:int>>"))
    return rows.select(*names, "__p", "__w").mapInArrow(run, schema).unionByName(same)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs and passages that repeat across all documents, one row each: paragraphs with their component
    (kept: the one that stays), passages (component -1) where they are removed, as spans of code points."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paragraphs, places = removals(docs, "doc_id", "text")
    own = paragraphs.select("doc_id", F.lit("paragraph").alias("kind"), "start", "end", F.col("component_id").cast("long").alias("component_id"), "kept")
    passages = places.select("doc_id", F.inline("spans"))
    return own.unionByName(passages.select("doc_id", F.lit("passage").alias("kind"), "start", "end", F.lit(-1).cast("long").alias("component_id"), F.lit(False).alias("kept")))


QUERIES = {"op5_passages": op5_passages}
