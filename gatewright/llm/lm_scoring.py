"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts: for each context of at most ORDER bytes the counts of the bytes that followed.
A text is coded as its lower-cased words, each followed by a blank, then one end byte; contexts run over blanks into
earlier words, back to the blank that every text begins with. A byte is coded in the longest context that was seen; an
escape leads to the next shorter one without the bytes just excluded, down to a uniform choice of the bytes left. The
escape's probability is estimated from the corpus itself: of all contexts of a length with as many occurrences and
distinct bytes, the share in which an occurrence that is left out is a byte the others don't show. Where no context is
alike, it is method C: q / (n + q) for q distinct bytes among n. The result is a proper distribution over word sequences.

Nothing is gathered that grows with the corpus. Documents are dealt into groups of bounded size by a digest. A group
gives sorted arrays of its codes (context and byte) and of its words' hashes with their counts, cut into buckets; a
bucket's arrays are merged one after the other, so a task holds the distinct codes of one bucket. The merged trie is cut
into ranges of equal size in the order of the reversed contexts; contexts that reach over a boundary are repeated behind
it, those of at most one byte (65,792 rows at most) are handed to every task. One sweep over a range with a stack of
ancestors codes what its groups ask for, and the answers go back to them.

Null and blank texts have the end token alone. Very long texts are read whole, one at a time. Repeated rows are scored
and learned from as often as they come; rows equal in key and text are in one group. An empty table gives no rows; without
training documents the model is uniform. Words are counted by 64-bit hashes. Extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm.common import cut, release, remainder, table
from gatewright.llm.shingles import mix, word_hashes, words_of

ORDER = 5
#: Symbols of the ends of words and texts; both are white space and never in a word.
WORD_END, TEXT_END = 0x20, 0x0A
#: Bytes of text in a group of documents, and of those that are coded at once; codes of a range; most buckets; groups
#: whose questions are answered in one task.
GROUP_BYTES, CODED_BYTES, RANGE_CODES, MOST_BUCKETS, ASKING_GROUPS = 32 << 20, 1 << 20, 1 << 20, 4096, 64
#: Classes of occurrences and of distinct bytes in the table of escapes.
N_BINS, Q_BINS = 32, 32
_LEN_SHIFT, _CTX_SHIFT = 8, 11
_U = np.uint64
CODES, WORDS = 0, 1


def text_codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, byte) for every coded byte of documents' words, one document after the other, and how many
    each has. A code holds the context reversed (nearest byte first, zero-padded to ORDER bytes), its length and the
    byte."""
    spelt = [b" " + b" ".join(w) + b" \n" if w else b" \n" for w in texts]
    sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
    buf = np.frombuffer(b"".join(spelt), np.uint8).astype(_U)
    place = np.arange(len(buf)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    context = np.zeros(len(buf), _U)
    for back in range(1, ORDER + 1):
        context[back:] |= buf[:-back] << _U(8 * (ORDER - back))
    depth = np.minimum(place, ORDER)
    short = np.flatnonzero(place < ORDER)  # not into the document before
    context[short] &= np.array([((1 << 8 * k) - 1) << (8 * (ORDER - k)) for k in range(ORDER + 1)], _U)[depth[short]]
    codes = (context << _U(_CTX_SHIFT)) | (depth.astype(_U) << _U(_LEN_SHIFT)) | buf
    return codes[place > 0], sizes - 1


def depths(codes: np.ndarray) -> np.ndarray:
    return ((codes >> _U(_LEN_SHIFT)) & _U(7)).astype(np.int64)


def shorten(codes: np.ndarray, to: int) -> np.ndarray:
    """The codes with their contexts cut to the nearest `to` bytes."""
    mask = _U(((1 << (8 * to)) - 1) << (8 * (ORDER - to)))
    return (((codes >> _U(_CTX_SHIFT)) & mask) << _U(_CTX_SHIFT)) | _U(to << _LEN_SHIFT) | (codes & _U(255))


def summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their weights."""
    if not len(keys):
        return keys, *weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *[np.add.reduceat(w[order], first) for w in weights]


class Sums:
    """Keys with weights, added array by array; no more is held than a few times the distinct keys."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, _U), np.empty(0, np.int64))]

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.held.append((keys, weights))
        if sum(len(k) for k, _ in self.held[1:]) > max(1_000_000, len(self.held[0][0])):
            self.held = [self.total()]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*map(np.concatenate, zip(*self.held, strict=True)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.concatenate((first, [len(keys)])))


def with_suffixes(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the longest contexts with their counts, and those of all shorter ones: the trie."""
    depth, every, weights = depths(codes), [codes], [counts]
    for to in range(ORDER):
        longer = depth > to
        c, w = summed(shorten(codes[longer], to), counts[longer])
        every.append(c)
        weights.append(w)
    return summed(np.concatenate(every), np.concatenate(weights))


def n_bin(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n)
    return np.where(n < 6, n, np.minimum(6 + np.floor(2 * np.log2(np.maximum(n, 6) / 6)), N_BINS - 1)).astype(np.int64)


def escape_events(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For all contexts of sorted codes (of whole contexts): how often, with one occurrence left out, the byte left out
    is new to the others (first half) or not (second half), by length, occurrences and distinct bytes of the others."""
    out = np.zeros((2, ORDER + 1, N_BINS, Q_BINS), np.int64)
    some = counts > 0
    codes, counts = codes[some], counts[some]
    if not len(codes):
        return out
    place = codes >> _U(_LEN_SHIFT)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    n, once = np.add.reduceat(counts, first), np.add.reduceat((counts == 1).astype(np.int64), first)
    q, depth = np.diff(np.concatenate((first, [len(codes)]))), depths(codes[first])
    for which, events, others in ((0, once, q - 1), (1, n - once, q)):
        at = (n > 1) & (events > 0)
        np.add.at(out[which], (depth[at], n_bin(n[at] - 1), np.minimum(others[at], Q_BINS - 1)), events[at])
    return out


class Escapes:
    """Escape probabilities by context length, occurrences and distinct bytes, from summed escape_events."""

    def __init__(self, events: np.ndarray):
        new, old = events.reshape(2, ORDER + 1, N_BINS, Q_BINS).astype(float)
        self.share = np.where(new + old > 0, (new + 0.5) / (new + old + 1.5), np.nan)

    def of(self, depth: int, n: int, q: int) -> float:
        k = n if n < 6 else min(6 + int(2 * math.log2(n / 6)), N_BINS - 1)
        share = self.share[depth, k, min(q, Q_BINS - 1)]
        return q / (n + q) if share != share else float(share)


NO_ESCAPES = Escapes(np.zeros((2, ORDER + 1, N_BINS, Q_BINS), np.int64))


class Node:
    """Counts after one context; `shared` is what its parent counts of the same bytes."""

    __slots__ = ("counts", "depth", "escape", "parent", "prefix", "shared", "total")

    def __init__(self, prefix: int, depth: int, counts: dict[int, int], parent: Node | None, escapes: Escapes):
        self.prefix, self.depth, self.counts, self.parent = prefix, depth, counts, parent
        self.total = sum(counts.values())
        self.shared = sum(map(parent.counts.__getitem__, counts)) if parent else 0
        self.escape = escapes.of(depth, self.total, len(counts)) if counts else 1.0


def code_length(node: Node | None, byte: int) -> float:
    """log10 of the byte's probability after the node's context."""
    out, below = 0.0, None
    while node is not None:
        # what the longer context holds is excluded; it is a part of what this one holds
        total = node.total - (below.shared if below else 0)
        if total:
            e = node.escape
            e = e / (e + (1 - e) * total / node.total)
            count = node.counts.get(byte)
            if count is not None:
                return out + math.log10((1 - e) * count / total)
            out += math.log10(e)
        below, node = node, node.parent
    return out - math.log10(256 - (len(below.counts) if below else 0))


def low_nodes(rows: list[tuple[int, int]], escapes: Escapes) -> dict[tuple[int, int], Node]:
    """Nodes of contexts of at most one byte from (code, count) rows."""
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for code, n in rows:
        counts.setdefault((code >> _CTX_SHIFT, (code >> _LEN_SHIFT) & 7), {})[code & 255] = n
    root = Node(0, 0, counts.get((0, 0), {}), None, escapes)
    return {(0, 0): root} | {k: Node(k[0], 1, c, root, escapes) for k, c in counts.items() if k[1] == 1}


def sweep(rows: Iterator[tuple[int, int, bool]], low: dict[tuple[int, int], Node], escapes: Escapes) -> Iterator[tuple[int, float]]:
    """(code, log10 probability) of the asked codes among rows (code, count, asked) sorted by code."""
    stack: list[Node] = []
    current, counts, asked = None, {}, []

    def leave() -> Iterator[tuple[int, float]]:
        prefix, depth = current
        while stack and not (stack[-1].depth < depth and (prefix ^ stack[-1].prefix) >> (8 * (ORDER - stack[-1].depth)) == 0):
            stack.pop()
        if depth <= 1:
            node = low.get(current, low[(0, 0)])
        else:
            top = prefix >> (8 * (ORDER - 1)) << (8 * (ORDER - 1))
            node = stack[-1] if stack else low.get((top, 1), low[(0, 0)])
            if counts:
                node = Node(prefix, depth, counts, node, escapes)
                stack.append(node)
        for code in asked:
            yield code, code_length(node, code & 255)

    for code, n, wanted in rows:
        place = (code >> _CTX_SHIFT, (code >> _LEN_SHIFT) & 7)
        if place != current:
            if current is not None:
                yield from leave()
            current, counts, asked = place, {}, []
        if n:
            counts[code & 255] = n
        if wanted:
            asked.append(code)
    if current is not None:
        yield from leave()


def _numbers(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _runs(keys: list[str], one: Callable[[tuple, Iterator[dict]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands rows that follow each other with equal keys to `one`, a row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({n: c[k] for n, c in zip(b.schema.names, b.columns, strict=True)} for b in batches for k in range(b.num_rows))
        held = [next(rows, None)]

        def same(key: tuple) -> Iterator[dict]:
            while held[0] is not None and tuple(held[0][k].as_py() for k in keys) == key:
                yield held[0]
                held[0] = next(rows, None)

        while held[0] is not None:
            key = tuple(held[0][k].as_py() for k in keys)
            group = same(key)
            yield from one(key, group)
            for _ in group:
                pass

    return run


def _chunks(texts: pa.ChunkedArray) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Documents' words, about CODED_BYTES of text at a time."""
    at, words, held = [], [], 0
    for k, value in enumerate(texts):
        t = value.as_py() or ""
        at.append(k)
        words.append(words_of(t))
        held += len(t)
        if held > CODED_BYTES:
            yield at, words
            at, words, held = [], [], 0
    if at:
        yield at, words


_STATS = "kind int, bucket long, group long, keys binary, counts binary, asked binary"


def _stats(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        """A group's codes and words with their counts in training documents, cut into buckets."""
        group = rows.column("group")[0].as_py()
        learned = ~rows.column("held_out").to_numpy(zero_copy_only=False)
        found, words = Sums(), Sums()
        for at, texts in _chunks(rows.column("text")):
            codes, sizes = text_codes(texts)
            own = np.repeat(learned[at], sizes)
            for part, n in ((codes[own], 1), (codes[~own], 0)):
                c, w = distinct(part)
                found.add(c, w * n)
            for want in (True, False):
                c, w = distinct(word_hashes([x for k, t in zip(at, texts, strict=True) if learned[k] == want for x in t]))
                words.add(c, w * int(want))
        codes, counts = found.total()
        trie, n = with_suffixes(codes[counts > 0], counts[counts > 0])
        keys, n, asked = summed(np.concatenate([trie, codes]), np.concatenate([n, np.zeros(len(codes), np.int64)]), np.concatenate([np.zeros(len(trie), np.int8), np.ones(len(codes), np.int8)]))
        hashes, times = words.total()
        out: dict[str, list] = {c: [] for c in ("kind", "bucket", "keys", "counts", "asked")}
        # codes of one context in one bucket
        for kind, k, w, a, spread in ((CODES, keys, n, asked, mix(keys >> _U(_LEN_SHIFT))), (WORDS, hashes, times, np.ones(len(hashes), np.int8), hashes)):
            bucket = (spread % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    for c, x in zip(out, (kind, int(bucket[part[0]]), k[part], w[part].astype(np.int64), (a[part] > 0).astype(np.int8)), strict=True):
                        out[c].append(x)
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int64()), "group": pa.array([group] * len(out["kind"]), pa.int64()), **{c: _blobs(out[c]) for c in ("keys", "counts", "asked")}})

    return run


_MERGED = "kind int, bucket long, size long, learned long, tokens long, marks array<long>, events array<long>, keys binary, counts binary, asked binary"
#: Evenly spaced codes of a bucket from which the ranges' boundaries are chosen.
MARKS = 64


def _merge(key: tuple, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Sums of a bucket, a group at a time."""
    kind, bucket = key
    total = np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int8)
    held: list[tuple[np.ndarray, ...]] = []

    def settle() -> tuple[np.ndarray, ...]:
        keys, n, asked = summed(*[np.concatenate(x) for x in zip(total, *held, strict=True)])
        return keys, n, np.minimum(asked, 1).astype(np.int8)

    for row in rows:
        held.append((_numbers(row["keys"], _U), _numbers(row["counts"], np.int64), _numbers(row["asked"], np.int8)))
        if sum(len(h[0]) for h in held) > max(len(total[0]), 200_000) or len(held) == 100:
            total, held = settle(), []
    keys, n, asked = settle()
    events = escape_events(keys, n) if kind == CODES else np.zeros(0, np.int64)
    marks = keys[np.linspace(0, len(keys) - 1, MARKS).astype(np.int64)] if kind == CODES and len(keys) else keys[:0]
    columns = [pa.array([kind], pa.int32()), pa.array([bucket]), pa.array([len(keys)]), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), pa.array([marks.view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([events.ravel().tolist()], pa.list_(pa.int64())), _blobs([keys]), _blobs([n]), _blobs([asked])]
    yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "size", "learned", "tokens", "marks", "events", "keys", "counts", "asked"])


def _ranges(bounds: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts a bucket's trie at the bounds; contexts that reach over one are repeated in the ranges behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, n, asked = (_numbers(batch.column(c)[row], t) for c, t in (("keys", _U), ("counts", np.int64), ("asked", np.int8)))
                at = np.searchsorted(bounds, keys, "right")
                depth = depths(keys)
                reach = np.array([(1 << 8 * (ORDER - k)) - 1 for k in range(ORDER + 1)], _U)[depth]
                last = np.searchsorted(bounds, (((keys >> _U(_CTX_SHIFT)) | reach) << _U(_CTX_SHIFT)) | _U((1 << _CTX_SHIFT) - 1), "right")
                over = np.flatnonzero((depth > 1) & (last > at) & (n > 0))
                again = np.repeat(over, last[over] - at[over])
                ahead = np.concatenate([np.arange(a + 1, b + 1) for a, b in zip(at[over].tolist(), last[over].tolist(), strict=True)]) if len(over) else np.empty(0, np.int64)
                k, w, q, r = np.concatenate([keys, keys[again]]), np.concatenate([n, n[again]]), np.concatenate([asked, np.zeros(len(again), np.int8)]), np.concatenate([at, ahead])
                order = np.argsort(r, kind="stable")
                parts = [p for p in np.split(order, np.flatnonzero(np.diff(r[order])) + 1) if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array([int(r[p[0]]) for p in parts], pa.int64()), _blobs([k[p] for p in parts]), _blobs([w[p] for p in parts]), _blobs([q[p] for p in parts])], ["part", "keys", "counts", "asked"])

    return run


def score_documents(df: DataFrame, key: str, text: str, held_out: str) -> DataFrame:
    """One row per row of df: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). held_out: a
    boolean column; documents with it are scored but not learned from."""
    spark = df.sparkSession
    docs = df.select(F.col(key), F.col(text).alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    facts = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.count_if(~F.col("held_out")).alias("ends")).first()
    ends, groups = facts["ends"], (facts["size"] or 0) // GROUP_BYTES + 1
    buckets = min(2 * groups + 6, MOST_BUCKETS)
    docs = docs.withColumn("group", F.pmod(F.xxhash64(key, "text"), F.lit(groups)))
    stats = cut(docs.groupBy("group").applyInArrow(_stats(buckets), _STATS), "stats")
    release(spark)

    merged = cut(stats.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_runs(["kind", "bucket"], _merge), _MERGED), "merged")
    release(spark)
    words = merged.where(F.col("kind") == WORDS).agg(F.sum("tokens"), F.sum("learned")).first()
    train_tokens, kinds = (words[0] or 0) + ends, (words[1] or 0) + (ends > 0)
    trie = merged.where(F.col("kind") == CODES)
    events = np.zeros(2 * (ORDER + 1) * N_BINS * Q_BINS, np.int64)
    for r in trie.select(F.posexplode("events").alias("at", "n")).where("n > 0").groupBy("at").agg(F.sum("n").alias("n")).collect():  # the cells of the table
        events[r["at"]] = r["n"]
    escapes = Escapes(events)
    size = trie.agg(F.sum("size")).first()[0] or 0
    marks = np.sort(np.array([m for r in trie.select("marks").collect() for m in r["marks"]], np.int64).astype(_U))  # MARKS x MOST_BUCKETS at most
    parts = size // RANGE_CODES + 1
    # a context's codes stay together
    bounds = np.unique(marks[np.linspace(0, len(marks) - 1, parts + 1).astype(np.int64)[1:-1]] >> _U(_LEN_SHIFT) << _U(_LEN_SHIFT)) if len(marks) else marks

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, n = _numbers(batch.column(0)[row], _U), _numbers(batch.column(1)[row], np.int64)
                at = (depths(keys) <= 1) & (n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(n[at])], ["code", "n"])

    low = [(r["code"], r["n"]) for r in trie.select("keys", "counts").mapInArrow(short, "code long, n long").collect()]  # 65,792 rows at most
    shared = spark.sparkContext.broadcast((low, escapes))

    def coded(key: tuple, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        low, escapes = shared.value
        columns = [(_numbers(r["keys"], _U), _numbers(r["counts"], np.int64), _numbers(r["asked"], np.int8)) for r in rows]
        keys, n, asked = map(np.concatenate, zip(*columns, strict=True))
        order = np.argsort(keys, kind="stable")
        found = list(sweep(zip(keys[order].tolist(), n[order].tolist(), asked[order].tolist(), strict=True), low_nodes(low, escapes), escapes))
        codes, values = np.array([c for c, _ in found], _U), np.array([v for _, v in found], float)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), _blobs([codes]), _blobs([values])], ["part", "keys", "counts"])

    pieces = trie.select("keys", "counts", "asked").mapInArrow(_ranges(bounds), "part long, keys binary, counts binary, asked binary")
    lengths = cut(pieces.repartition("part").sortWithinPartitions("part").mapInArrow(_runs(["part"], coded), "part long, keys binary, counts binary"), "lengths")
    release(spark)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each group asks of each range, and of each bucket of words."""
        for batch in batches:
            for row in range(batch.num_rows):
                kind, bucket, group = (batch.column(c)[row].as_py() for c in range(3))
                keys = _numbers(batch.column(3)[row], _U)
                if kind == CODES:
                    keys = keys[_numbers(batch.column(4)[row], np.int8) > 0]
                    at = np.searchsorted(bounds, keys, "right")  # sorted as the keys are
                    cuts = [x for x in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(at)) + 1) if len(x)]
                    places = [int(at[x[0]]) for x in cuts]
                    keys = [keys[x] for x in cuts]
                else:
                    places, keys = [bucket], [keys]
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(places, pa.int64()), pa.array([group] * n, pa.int64()), _blobs(keys)], ["kind", "part", "group", "keys"])

    salts = -(-groups // ASKING_GROUPS)
    asked = stats.select("kind", "bucket", "group", "keys", "asked").mapInArrow(asking, "kind int, part long, group long, keys binary")
    asked = asked.select("kind", "part", F.pmod("group", F.lit(salts)).alias("salt"), "group", "keys", F.lit(None).cast("binary").alias("values"))
    facts = lengths.select(F.lit(CODES).alias("kind"), "part", "keys", F.col("counts").alias("values")).unionByName(merged.where(F.col("kind") == WORDS).select("kind", F.col("bucket").alias("part"), "keys", F.col("counts").alias("values")))
    facts = facts.select("kind", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(-1).cast("long").alias("group"), "keys", "values")

    def answered(key: tuple, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        kind = float if key[0] == CODES else np.int64
        fact = next(rows)
        keys, values = _numbers(fact["keys"], _U), _numbers(fact["values"], kind)
        for row in rows:
            own = _numbers(row["keys"], _U)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([row["group"].as_py()]), _blobs([own]), _blobs([values[np.searchsorted(keys, own)].astype(float)])], ["kind", "group", "keys", "values"])

    both = asked.unionByName(facts).repartition("kind", "part", "salt").sortWithinPartitions("kind", "part", "salt", "group")
    answers = cut(both.mapInArrow(_runs(["kind", "part", "salt"], answered), "kind int, group long, keys binary, values binary"), "answers")
    release(spark, stats, merged, lengths)
    plain = math.log10(train_tokens + kinds + 1)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for kind in (CODES, WORDS):
            rows = right.filter(pa.compute.equal(right.column("kind"), kind))
            keys, values = (np.concatenate([np.empty(0, t), *[_numbers(x, t) for x in rows.column(c)]]) for c, t in (("keys", _U), ("values", float)))
            order = np.argsort(keys)
            known[kind] = keys[order], values[order]
        end_base = math.log10(ends + 1) - plain
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for _, texts in _chunks(left.column("text")):
            codes, sizes = text_codes(texts)
            each, inverse = np.unique(codes, return_inverse=True)
            cost = known[CODES][1][np.searchsorted(known[CODES][0], each)][inverse]
            out["score"] += np.add.reduceat(cost, np.cumsum(sizes) - sizes).tolist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            c = known[WORDS][1][np.searchsorted(known[WORDS][0], word_hashes([w for t in texts for w in t]))]
            base, seen, some = np.zeros(len(texts)), np.zeros(len(texts), np.int64), lengths > 0
            if some.any():
                starts = (np.cumsum(lengths) - lengths)[some]
                base[some], seen[some] = np.add.reduceat(np.log10(c + 1) - plain, starts), np.add.reduceat((c > 0).astype(np.int64), starts)
            out["n_tokens"] += (lengths + 1).tolist()
            out["n_known"] += (seen + (ends > 0)).tolist()
            out["base_score"] += (base + end_base).tolist()
        return pa.table({key: left.column(key), "held_out": left.column("held_out"), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "train_tokens": pa.array([train_tokens] * left.num_rows, pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    schema = f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(scored, schema)


def adaptive_score(text: str | None) -> float:
    """log10 probability of one text under a model that starts empty and learns each byte after it is coded (escape
    method C)."""
    total, counts = 0.0, {}
    for code in text_codes([words_of(text or "")])[0].tolist():
        depth, chain = (code >> _LEN_SHIFT) & 7, None
        places = [int(shorten(np.array([code], _U), to)[0]) >> _LEN_SHIFT for to in range(depth + 1)]
        for to, place in enumerate(places):
            if place in counts:
                chain = Node(0, to, counts[place], chain, NO_ESCAPES)
        total += code_length(chain, code & 255)
        for place in places:
            own = counts.setdefault(place, {})
            own[code & 255] = own.get(code & 255, 0) + 1
    return total


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    return score_documents(docs, "doc_id", "text", "held_out")


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
