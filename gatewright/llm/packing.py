"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and an end id; those over the capacity are cut into pieces, the first of them the shorter
one. A full piece is a sequence of its own. The other pieces are dealt into blocks of bounded size. On each island of
a block a population of packings evolves: a crossover injects well-filled bins of one parent into the other, drops the
bins that hold the same pieces again and best-fits the displaced pieces. After each epoch every island's elite moves
to the next island. The best packing of a block keeps its well-filled bins; the pieces of all others are dealt
again into fewer blocks, until one block is left. Ties are settled by item numbers and seeded draws.

Very long texts are encoded whole, one at a time. Null text: empty, one piece that holds the end id. Repeated documents are packed as often as they come. Extra columns
are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm.common import cut, table

CAPACITY = 1024
END_ID = 2
#: Pieces of a block, islands of a block, packings of an island, children an epoch, epochs a round.
BLOCK, ISLANDS, POPULATION, CHILDREN, EPOCHS = 4096, 3, 4, 24, 2
#: A bin that lacks at most this many tokens is kept as it is.
SLACK = 4

#: The words that a byte-level tokenizer with its own pattern takes a text apart into.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters outside long-settled blocks, which two libraries may class by different Unicode versions.
_RARE = re.compile("[^\\x00-\\u052f\\u1e00-\\u1eff\\u2000-\\u2063\\u20a0-\\u20bf\\u2190-\\u22ff\\u2500-\\u257f\\u3000-\\u3096\\u30a0-\\u30fe\\u4e00-\\u9fa5\\uac00-\\ud7a3]")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in
    order, for those from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class BytePairIds:
    """Ids of texts as little-endian unsigned 32-bit numbers, those of the tokenizers library. For a plain byte-level
    vocabulary whose merges give all its pieces, the merges are applied by a faster library; texts with special tokens or
    rare characters, and other vocabularies, are encoded by the tokenizers library itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            self.fast, self.ids_of = self._fast(json.load(file))

    def _fast(self, spec: dict) -> tuple[object, np.ndarray] | tuple[None, None]:
        import tiktoken

        model, words = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None, None
        byte_of = _byte_of()
        pieces = {bytes(byte_of[c] for c in piece): k for piece, k in model["vocab"].items() if piece not in self.special}
        rank = {bytes([b]): k for k, b in enumerate(byte_of.values())}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            rank.setdefault(bytes(byte_of[c] for c in a + b), len(rank))
        if set(rank) != set(pieces):
            return None, None
        ids = np.zeros(len(rank), "<u4")
        for piece, k in rank.items():
            ids[k] = pieces[piece]
        return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=rank, special_tokens={}), ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(t in text for t in self.special) or not (text.isascii() or not _RARE.search(text)):
            return self.whole(text)
        return self.ids_of[self.fast.encode_to_numpy(text, disallowed_special=())].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairIds:
    """A worker process's encoder, shared by its tasks."""
    return BytePairIds(path)


def tokenize(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32."""
    slim = df.select(key, text)
    schema = f"`{key}` {dict(slim.dtypes)[key]}, piece int, start long, length long, ids_crc32 long"
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for k, value in enumerate(batch.column(1)):
                ids = memoryview(encoder(path).ids(value.as_py() or "") + end)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    at.append(k)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [key, "piece", "start", "length", "ids_crc32"])

    return slim.mapInArrow(run, schema)


class Packing:
    """Bins of item numbers with their fill; open bins are found by what they lack."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self.room: dict[int, list[int]] = {}
        self.mask = 0  # bit r: an open bin lacks r

    def add_bin(self, items: list[int], fill: int | None = None) -> None:
        self.bins.append(items)
        self.fill.append(sum(map(self.lengths.__getitem__, items)) if fill is None else fill)
        self._open(len(self.bins) - 1)

    def _open(self, k: int) -> None:
        lack = self.capacity - self.fill[k]
        if lack:
            self.room.setdefault(lack, []).append(k)
            self.mask |= 1 << lack

    def best_fit(self, items: list[int]) -> None:
        """Longest first, each into the open bin that it fills best."""
        for i in sorted(items, key=self.lengths.__getitem__, reverse=True):
            n = self.lengths[i]
            fits = self.mask >> n
            if not fits:
                self.add_bin([i])
                continue
            lack = (fits & -fits).bit_length() - 1 + n
            held = self.room[lack]
            k = held.pop()
            if not held:
                self.mask &= ~(1 << lack)
            self.bins[k].append(i)
            self.fill[k] += n
            self._open(k)

    @cached_property
    def score(self) -> tuple[int, float]:
        """Fewer bins first, then more uneven fill. Asked for when the packing is done."""
        return -len(self.bins), float(np.square(np.asarray(self.fill, float) / self.capacity).sum())

    def labels(self) -> np.ndarray:
        out = np.zeros(len(self.lengths), np.int32)
        for k, items in enumerate(self.bins):
            out[items] = k
        return out

    @staticmethod
    def of(labels: np.ndarray, lengths: list[int], capacity: int) -> Packing:
        out = Packing(lengths, capacity)
        order = np.argsort(labels, kind="stable")
        for items in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
            out.add_bin(items.tolist())
        return out


def first_packing(lengths: list[int], capacity: int, rng: np.random.Generator, share: float) -> Packing:
    """A share of random items first, the rest by best fit."""
    out, order = Packing(lengths, capacity), rng.permutation(len(lengths)).tolist()
    k = int(len(order) * share)
    for i in order[:k]:
        out.best_fit([i])
    out.best_fit(order[k:])
    return out


def crossover(giver: Packing, taker: Packing, rng: np.random.Generator) -> Packing:
    """Well-filled bins of giver, the bins of taker that share no item with them, the displaced items by best fit.
    Of taker's bins some of the worst filled are opened too."""
    capacity, lengths = giver.capacity, giver.lengths
    fill = np.asarray(giver.fill)
    full = np.flatnonzero(fill >= capacity - rng.integers(0, 8))
    chosen = full if len(full) < 4 else rng.choice(full, max(2, len(full) // int(rng.integers(2, 6))), replace=False)
    child, taken = Packing(lengths, capacity), bytearray(len(lengths))
    for k in chosen.tolist():
        items = giver.bins[k]
        child.add_bin(items[:], giver.fill[k])
        for i in items:
            taken[i] = 1
    loose: list[int] = []
    limit = capacity * (1 - 0.25 * rng.random())
    dropped = (rng.random(len(taker.bins)) < 0.3).tolist()
    for items, filled, drop in zip(taker.bins, taker.fill, dropped, strict=True):
        if drop and filled < limit:
            loose += [i for i in items if not taken[i]]
            continue
        for i in items:
            if taken[i]:
                loose += [i for i in items if not taken[i]]
                break
        else:
            child.add_bin(items[:], filled)
    child.best_fit(loose)
    return child


def evolve(lengths: list[int], capacity: int, seed: int, start: list[np.ndarray], children: int = CHILDREN, population: int = POPULATION) -> Packing:
    """The best packing after an epoch that begins with the packings in start (labels of items)."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    pool = [Packing.of(s, lengths, capacity) for s in start]
    while len(pool) < population:
        pool.append(first_packing(lengths, capacity, rng, 0.0 if not pool else 0.15 * len(pool)))
        if len(pool[-1].bins) <= least:
            break
    pool.sort(key=lambda p: p.score, reverse=True)
    for _ in range(children):
        if len(pool[0].bins) <= least or len(pool) < 2:
            break
        a, b = rng.choice(len(pool), 2, replace=False).tolist()
        child = crossover(pool[min(a, b)], pool[max(a, b)], rng)
        if child.score > pool[-1].score:
            pool[-1] = child
            pool.sort(key=lambda p: p.score, reverse=True)
    return pool[0]


_STATE = "block long, island int, items array<long>, lengths array<int>, labels array<int>, bins int, fitness double"


def _epoch(capacity: int, round_no: int, epoch: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        if epoch == 0:
            rows = rows.sort_values("item", kind="stable")
            items, lengths, start = rows["item"].to_numpy(), rows["length"].astype(int).tolist(), []
        else:
            rows = rows.sort_values(["bins", "fitness"], ascending=[True, False], kind="stable")
            items, lengths = rows["items"].iloc[0], [int(x) for x in rows["lengths"].iloc[0]]
            start = [np.asarray(x, np.int32) for x in rows["labels"]]
        seed = ((round_no * 31 + epoch) * 1_000_003 + block) * 64 + island
        best = evolve(lengths, capacity, seed, start)
        bins, fitness = best.score
        return pd.DataFrame({"block": [block], "island": [island], "items": [np.asarray(items)], "lengths": [np.asarray(lengths, np.int32)], "labels": [best.labels()], "bins": [-bins], "fitness": [fitness]})

    return run


def pack(items: DataFrame, item: str, length: str, capacity: int = CAPACITY, block_size: int = BLOCK, slack: int = SLACK) -> DataFrame:
    """item, sequence_id (from 0 on, not gapless), offset for items (unique longs) of lengths 1 to capacity."""
    left = cut(items.select(F.col(item).cast("long").alias("item"), F.col(length).cast("int").alias("length")), "items")
    placed: DataFrame | None = None
    round_no = 0
    while True:
        n = left.count()
        if n == 0:
            break
        blocks = -(-n // block_size)
        dealt = left.withColumn("block", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(blocks)))
        isles = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
        state = isles.groupBy("block", "island").applyInPandas(_epoch(capacity, round_no, 0), _STATE)
        for epoch in range(1, EPOCHS):
            moved = cut(state, "elites").withColumn("island", F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
            state = moved.groupBy("block", "island").applyInPandas(_epoch(capacity, round_no, epoch), _STATE)
        best = state.groupBy("block").agg(F.max_by(F.struct("items", "lengths", "labels"), F.struct(-F.col("bins"), F.col("fitness"))).alias("b"))
        rows = best.select("block", F.explode(F.arrays_zip("b.items", "b.lengths", "b.labels")).alias("r")).select("block", F.col("r.items").alias("item"), F.col("r.lengths").alias("length"), F.col("r.labels").alias("label"))
        bins = rows.groupBy("block", "label").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("held"), F.sum("length").alias("fill"))  # at most `capacity` items
        bins = cut(bins, "bins")
        open_bins = F.col("fill") < capacity - slack
        loose = bins.where(open_bins).agg(F.sum(F.size("held"))).first()[0] or 0
        # where few bins could be kept, dealing again would only repeat this
        last = blocks == 1 or loose == 0 or loose > 0.9 * n
        keep = bins if last else bins.where(~open_bins)
        starts = F.expr("transform(held, (h, k) -> struct(h.item as item, aggregate(slice(held, 1, k), 0L, (s, x) -> s + x.length) as offset))")
        number = F.lit(round_no) * F.lit(1 << 56) + F.col("block") * F.lit(1 << 24) + F.col("label")
        kept = keep.select(number.alias("sequence_id"), F.explode(starts).alias("h")).select("h.item", "sequence_id", "h.offset")
        placed = kept if placed is None else placed.unionByName(kept)
        if last:
            break
        left = cut(bins.where(open_bins).select(F.explode("held").alias("h")).select("h.item", "h.length"), "items")
        round_no += 1
    if placed is None:
        return left.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed


def pack_documents(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(tokenize(df, key, text, path, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -F.col("item") - 1, "offset": F.lit(0).cast("long")})
    part = pieces.where(F.col("length") < capacity)
    return full.unionByName(part.join(pack(part, "item", "length", capacity), "item")).drop("item")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_packing": op2_packing}
