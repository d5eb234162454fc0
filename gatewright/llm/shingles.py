"""Word shingles, MinHash signatures, bands and clustering by verified candidates, shared by operators 3 and 5.

A unit is a part of a document's text (a whole text or a paragraph). Words are runs of bytes other than white space,
A-Z lower-cased. A unit's set holds 64-bit hashes of its distinct n-word shingles; with fewer words, one hash of the
whole sequence; without words it is empty, and empty units are linked with nothing.

Units with equal sets form a class, and everything after that works on classes: candidates come from bands of MinHash
signatures, a candidate is verified on the full sets, and links merge classes into components. A bucket of equal
bands is not expanded into all its pairs: its members are compared with its leader (a join on an aggregate), links are
merged, and what is still in different components is compared in blocks, which give only links that join components.
So no link between two components is lost, whatever the group's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import components, cut, maybe_among, release

#: Offsets of units in code points, and their words: what a splitter makes of a text.
Unit = tuple[int, int, list[bytes]]
Splitter = Callable[[str], list[Unit]]

#: Bands whose buckets are looked for at once; classes and shingles of a block that is compared in one task.
BANDS_AT_ONCE, BLOCK_CLASSES, BLOCK_SHINGLES = 6, 1024, 1 << 20
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII letters and ASCII white space alone, as is wanted here."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def whole_text(text: str) -> list[Unit]:
    return [(0, len(text), words_of(text))]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; hashing a word takes less time than looking it up."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def distinct_shingles(hashes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of many units, one unit after the other, and how many each unit has.
    hashes: the word hashes of all units, lengths: their words."""
    starts, total = np.cumsum(lengths) - lengths, len(hashes)
    found, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    if total >= n:
        g = mix(hashes[: total - n + 1] + _C1)
        for i in range(1, n):
            g = mix(g * _C1 + hashes[i : total - n + 1 + i])
        owner = np.repeat(np.arange(len(lengths)), lengths)[: total - n + 1]
        whole = (starts + lengths)[owner] - np.arange(len(g)) >= n
        found.append(g[whole])
        owners.append(owner[whole])
    for k in range(1, n):
        at = np.flatnonzero(lengths == k)
        if len(at):
            g = np.full(len(at), k, np.uint64)
            for j in range(k):
                g = mix(g * _C1 + hashes[starts[at] + j])
            found.append(g)
            owners.append(at)
    g, owner = np.concatenate(found), np.concatenate(owners)
    # equal shingles of a unit stand together in the order of one number for both
    order = np.argsort(g ^ mix(owner.astype(np.uint64) * _C2 + _C3))
    same = (g[order[1:]] == g[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    keep = np.sort(order[np.concatenate(([True], ~same))]) if len(g) else order
    g, owner = g[keep], owner[keep]
    if len(owners) > 2:
        by = np.argsort(owner, kind="stable")
        g, owner = g[by], owner[by]
    return g, np.bincount(owner, minlength=len(lengths))


def set_keys(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16 bytes (units x 2 numbers) that equal sets share and others don't: two sums over the members. counts: all above 0."""
    starts = np.cumsum(counts) - counts
    return np.column_stack([np.add.reduceat(mix(x + _C2), starts), np.add.reduceat(mix(x ^ _C3), starts)])


def unit_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one unit."""
    return np.sort(distinct_shingles(hashes, np.array([len(hashes)]), n)[0])


@dataclass(frozen=True)
class Plan:
    """Shingle length, similarity (over / of), bands and rows of a band, hashes of a signature."""

    n: int
    over: int
    of: int
    bands: int
    rows: int
    hashes: int

    @property
    def similarity(self) -> float:
        return self.over / self.of


def tune(n: int, over: int, of: int, miss: float, hashes: int = 0, background: float = 0.2) -> Plan:
    """The cheapest bands that lose a pair of the similarity with at most the probability `miss`; a band costs itself
    and the pairs of similarity `background` that it lets through."""
    s = over / of
    best = min(((b := math.ceil(math.log(miss) / math.log(1 - s**r))) * (1 + 100 * background**r), r, b) for r in range(2, 9))
    _, rows, bands = best
    return Plan(n, over, of, bands, rows, max(hashes, rows * bands))


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def signatures(x: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """MinHash signatures (units x k, 32 bits) of non-empty sets: permutations of the shingles' upper 32 bits."""
    a, b = _coefficients(k)
    x, starts = (x >> np.uint64(32)).astype(np.uint32), np.cumsum(counts) - counts
    out, h = np.empty((len(counts), k), np.uint32), np.empty_like(x)
    for i in range(k):
        np.multiply(x, a[i], out=h)
        np.add(h, b[i], out=h)
        out[:, i] = np.minimum.reduceat(h, starts)
    return out


def band_keys(sig: np.ndarray, plan: Plan) -> np.ndarray:
    """64-bit keys (units x bands), unlike from band to band."""
    out = np.empty((len(sig), plan.bands), np.uint64)
    for band in range(plan.bands):
        key = np.full(len(sig), band + 1, np.uint64)
        for row in range(plan.rows):
            key = mix(key * _C1 + sig[:, band * plan.rows + row])
        out[:, band] = key
    return out.view(np.int64)


def _binary(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values; null where not valid (rows: the valid ones)."""
    width = rows.shape[1] * rows.itemsize if rows.size else 0
    offsets = np.concatenate(([0], np.cumsum(np.where(valid, width, 0)))).astype(np.int32)
    mask = pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(valid), [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def units(df: DataFrame, key: str, text: str, split: Splitter, plan: Plan, signed: bool, least_words: int = 0) -> DataFrame:
    """One row per unit: key, part, start, end, n_shingles, set_key (16 bytes; null for an empty set), bands (none for an
    empty set) and, if signed, the signature."""
    slim = df.select(key, text)
    schema = f"`{key}` {dict(slim.dtypes)[key]}, part int, start int, end int, n_shingles long, set_key binary, bands array<long>" + ", sig binary" * signed
    names = [key, "part", "start", "end", "n_shingles", "set_key", "bands", *["sig"] * signed]

    def flush(keys: pa.Array, at: list, places: list, words: list, lengths: list) -> pa.RecordBatch:
        x, counts = distinct_shingles(word_hashes(words), np.array(lengths, np.int64), plan.n)
        some = counts > 0
        full = counts[some]
        sig = signatures(x, full, plan.hashes) if len(full) else np.empty((0, plan.hashes), np.uint32)
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * plan.bands))), pa.int32()), pa.array(band_keys(sig, plan).ravel()))
        place = np.array(places, np.int32).reshape(-1, 3)
        own = _binary(set_keys(x, full) if len(full) else np.empty((0, 2), np.uint64), some)
        columns = [keys.take(pa.array(at, pa.int64())), *[pa.array(place[:, i]) for i in range(3)], pa.array(counts, pa.int64()), own, bands]
        return pa.RecordBatch.from_arrays(columns + [_binary(sig, some)] * signed, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, words, lengths = [], [], [], []
            for k, value in enumerate(batch.column(1)):
                for part, (start, end, own) in enumerate(split(value.as_py() or "")):
                    if len(own) >= least_words:
                        at.append(k)
                        places.append((part, start, end))
                        lengths.append(len(own))
                        words += own
                if len(words) > 200_000:
                    yield flush(batch.column(0), at, places, words, lengths)
                    at, places, words, lengths = [], [], [], []
            if at:
                yield flush(batch.column(0), at, places, words, lengths)

    return slim.mapInArrow(run, schema)


def classes(found: DataFrame, key: str, signed: bool) -> DataFrame:
    """One row per distinct set: cls (a number, fixed as the table is written), set_key, its place (key, part), ..."""
    place = F.min(F.struct(F.col(key).alias("key"), F.col("part").alias("part"))).alias("place")
    # of equal sets any row's bands are the same
    same = [F.first(c).alias(c) for c in ("n_shingles", "bands", *["sig"] * signed)]
    return cut(found.where("set_key is not null").groupBy("set_key").agg(place, *same).withColumn("cls", F.monotonically_increasing_id()), "classes")


def full_sets(df: DataFrame, key: str, text: str, split: Splitter, plan: Plan, wanted: DataFrame) -> DataFrame:
    """cls with its full set (sorted 64-bit hashes), read again from the documents that hold the wanted classes."""
    # a document's own units; a table of known size, so that few of them are broadcast and the texts stay where they are
    asked = cut(wanted.select(F.col("place.key").alias("__key"), F.struct("place.part", "cls", "set_key").alias("u")).groupBy("__key").agg(F.collect_list("u").alias("__units")), "asked")
    rows = maybe_among(df.select(key, text), key, asked).join(asked, F.col(key).eqNullSafe(F.col("__key"))).select(text, "__units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for value, asked in zip(batch.column(0), batch.column(1), strict=True):
                parts = split(value.as_py() or "")
                for u in asked.as_py():
                    if u["part"] >= len(parts):
                        continue
                    s = unit_set(word_hashes(parts[u["part"]][2]), plan.n)
                    # another text under a repeated key has another set
                    if len(s) and set_keys(s, np.array([len(s)])).tobytes() == u["set_key"]:
                        out.append((u["cls"], s.tobytes()))
                        held += len(s)
                if held > 1_000_000:
                    yield _pairs_batch(out)
                    out, held = [], 0
            if out:
                yield _pairs_batch(out)

    return cut(rows.mapInArrow(run, "cls long, members binary").dropDuplicates(["cls"]), "sets")


def _pairs_batch(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([m for _, m in out], pa.binary())], ["cls", "members"])


def posterior_table(plan: Plan, batch: int, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on). With a uniform prior, the similarity after m matches of n has the
    law Beta(m + 1, n - m + 1); a pair is pruned as P(similarity >= t) < miss, which is the chance of at most m hits
    in n + 1 draws of probability t."""
    t, out = plan.similarity, []
    for n in range(batch, plan.hashes + 1, batch):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _both(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    left = side.select(F.col("cls").alias("a"), F.col(column).alias("left"))
    return pairs.join(left, "a").join(side.select(F.col("cls").alias("b"), F.col(column).alias("right")), "b").select("a", "b", "left", "right")


def bayes_prune(pairs: DataFrame, signed: DataFrame, plan: Plan, batch: int = 16, miss: float = 1e-7) -> DataFrame:
    """Pairs (a, b) that survive the comparison of signatures, a batch of hashes at a time."""
    steps = posterior_table(plan, batch, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(rows.column(k).to_pylist()), np.uint32).reshape(rows.num_rows, -1) for k in (2, 3))
            alive, matches, before = np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64), 0
            for n, least in steps:
                matches[alive] += (left[alive, before:n] == right[alive, before:n]).sum(1)
                alive, before = alive[matches[alive] >= least], n
            keep = pa.array(alive, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(keep), rows.column(1).take(keep)], ["a", "b"])

    return _both(pairs, signed, "sig").mapInArrow(run, "a long, b long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def exact(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) whose full sets have of * intersection >= over * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for k, (x, y) in enumerate(zip(rows.column(2), rows.column(3), strict=True)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = _common(a, b)
                if plan.of * common >= plan.over * (len(a) + len(b) - common):
                    keep.append(k)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take)], ["a", "b"])

    return _both(pairs, sets, "members").mapInArrow(run, "a long, b long")


@dataclass
class Block:
    """Classes of one bucket that are compared at once: numbers, components, signatures (or None) and full sets."""

    cls: np.ndarray
    g: np.ndarray
    sig: np.ndarray | None
    sets: list[np.ndarray]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets], np.int64)


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the shingles that both sides have."""
    out = np.zeros((len(a), len(b)), np.float32)
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    places = []
    for side in (a, b):
        at, row = np.searchsorted(both, np.concatenate(side)), np.repeat(np.arange(len(side)), [len(s) for s in side])
        at[at == len(both)] = 0
        hit = both[at] == np.concatenate(side) if len(both) else np.zeros(len(at), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], row[hit][order]))
    for lo in range(0, len(both), 2048):
        dense = []
        for (at, row), side in zip(places, (a, b), strict=True):
            x, y = np.searchsorted(at, [lo, lo + 2048])
            m = np.zeros((len(side), 2048), np.float32)
            m[row[x:y], at[x:y] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def block_links(left: Block, right: Block, plan: Plan, steps: list[tuple[int, int]], own: bool) -> list[tuple[int, int]]:
    """Links (a, b) that join components of two blocks (own: of one block): pairs of different components are compared
    by signatures, a batch of hashes at a time, and survivors exactly. Of links between the same components one is
    enough."""
    alive = (left.g[:, None] != right.g[None, :]) & (plan.of * np.minimum(left.sizes[:, None], right.sizes[None, :]) >= plan.over * np.maximum(left.sizes[:, None], right.sizes[None, :]))
    if own:
        alive = np.triu(alive, 1)
    if left.sig is not None:
        matches, before = np.zeros(alive.shape, np.int16), 0
        for n, least in steps:
            if not alive.any():
                return []
            for k in range(before, n):
                matches += left.sig[:, k][:, None] == right.sig[:, k][None, :]
            alive &= matches >= least
            before = n
    i, j = np.nonzero(alive)
    if not len(i):
        return []
    if len(i) <= 4 * (len(left.cls) + len(right.cls)):
        common = np.array([_common(left.sets[p], right.sets[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        p, q = np.unique(i), np.unique(j)
        counts = _intersections([left.sets[k] for k in p], [right.sets[k] for k in q])
        common = counts[np.searchsorted(p, i), np.searchsorted(q, j)].astype(np.int64)
    hit = plan.of * common >= plan.over * (left.sizes[i] + right.sizes[j] - common)
    i, j = i[hit], j[hit]
    out, up = [], {}

    def find(g: int) -> int:
        while up.get(g, g) != g:
            g = up[g]
        return g

    pairs, first = np.unique(np.column_stack([left.g[i], right.g[j]]), axis=0, return_index=True)
    for (x, y), k in zip(pairs.tolist(), first.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((int(left.cls[i[k]]), int(right.cls[j[k]])))
    return out


def _compared(plan: Plan, steps: list[tuple[int, int]], signed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the blocks of each task; a task's rows follow each other, the left block first."""

    def blocks(rows: pa.Table) -> list[Block]:
        out = []
        side = rows.column("side").to_numpy()
        for which in np.unique(side).tolist():
            at = pa.array(np.flatnonzero(side == which))
            part = rows.take(at)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(part.num_rows, -1) if signed else None
            out.append(Block(part.column("cls").to_numpy(), part.column("g").to_numpy(), sig, [np.frombuffer(x.as_py(), np.uint64) for x in part.column("members")]))
        return out

    def links(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        table = pa.Table.from_batches(rows)
        if table.num_rows < 2:
            return []
        b = blocks(table)
        alone = bool(table.column("own")[0].as_py())
        return block_links(b[0], b[0], plan, steps, True) if alone else block_links(b[0], b[1], plan, steps, False) if len(b) == 2 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            tasks = list(zip(*[batch.column(c).to_pylist() for c in ("bucket", "i", "j", "own")], strict=True))
            found: list[tuple[int, int]] = []
            at = 0
            for k in range(len(tasks) + 1):
                if k == len(tasks) or tasks[k] != last:
                    if k > at:
                        held.append(batch.slice(at, k - at))
                    at = k
                    if k < len(tasks):
                        if held:
                            found += links(held)
                            held = []
                        last = tasks[k]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
        if held:
            found = links(held)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return run


def linked_classes(every: DataFrame, plan: Plan, sets_of: Callable[[DataFrame], DataFrame], miss: float | None = None) -> DataFrame:
    """(id, component) of the classes that have a verified link. sets_of: the full sets of wanted classes. miss: compare
    signatures first and prune pairs whose posterior chance of a link is below this.

    Buckets are found a few bands at a time, so that only a part of all (class, band) rows is shuffled at once, and those
    of one class are dropped before anything else moves. Each class of a bucket is compared with its leader, the least
    class, and links are merged. Buckets whose other classes still are in several components are compared in blocks of
    bounded size: all classes outside a bucket's largest component with all its classes, so no link is lost; a block gives
    only links that join components.
    """
    spark = every.sparkSession
    found: DataFrame | None = None
    tables = []
    for lo in range(0, plan.bands, BANDS_AT_ONCE):
        spread = every.select("cls", F.col("n_shingles").alias("n"), F.explode(F.slice("bands", lo + 1, BANDS_AT_ONCE)).alias("bucket"))
        heads = cut(spread.groupBy("bucket").agg(F.count("*").alias("c"), F.min("cls").alias("lead")).where("c > 1").select("bucket", "lead"), "heads")
        # the members are not sorted: a hash join with the heads, which are few
        part = cut(maybe_among(spread, "bucket", heads).join(heads.hint("shuffle_hash"), "bucket").select("bucket", "cls", "n", "lead"), "buckets")
        found = part if found is None else found.unionByName(part)
        tables.append(part)
        release(spark, heads)
    # similar sets are of similar sizes
    alike = plan.of * F.least("n", "n_shingles") >= plan.over * F.greatest("n", "n_shingles")
    pairs = found.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b"), "n").distinct()
    stars = cut(pairs.join(every.select(F.col("cls").alias("a"), "n_shingles"), "a").where(alike).select("a", "b"), "pairs")
    survivors = stars
    if miss is not None:
        survivors = cut(bayes_prune(stars, every, plan, miss=miss), "survivors")
    place = every.select("cls", "place", "set_key")
    asked = survivors.select(F.col("a").alias("cls")).union(survivors.select("b")).distinct()
    sets = sets_of(place.join(asked, "cls", "left_semi"))
    links = cut(exact(survivors, sets, plan), "links")
    groups = cut(components(links), "components")

    # a bucket's leader has met all of its classes already
    rows = found.where("cls <> lead").select("bucket", "cls", "n").join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn("g", F.coalesce("component", F.col("cls"))).drop("component")
    by_g = rows.groupBy("bucket", "g").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    mixed = by_g.groupBy("bucket").agg(F.max(F.struct("c", "s", "g")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("kinds")).where("kinds > 1")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK_CLASSES), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    one = blocks(F.col("c"), F.col("s")) == 1
    mixed = mixed.select("bucket", F.when(one, F.lit(0)).otherwise(blocks(F.col("top.c"), F.col("top.s"))).alias("bigs"), F.when(one, F.lit(1)).otherwise(blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s"))).alias("rests"), F.col("top.g").alias("top"))
    rest = cut(rows.join(mixed, "bucket").select("bucket", "cls", "g", "bigs", "rests", ((F.col("bigs") > 0) & (F.col("g") == F.col("top"))).alias("big")), "mixed")
    release(spark, *tables, stars)
    if rest.isEmpty():
        return groups
    lacking = rest.select("cls").distinct().join(sets.select("cls"), "cls", "left_anti")
    sets = sets.unionByName(sets_of(place.join(lacking, "cls", "left_semi")))
    payload = sets if miss is None else sets.join(every.select("cls", "sig"), "cls")
    block = F.pmod(F.xxhash64("cls"), F.when(F.col("big"), F.col("bigs")).otherwise(F.col("rests"))).cast("int")
    # the tasks of a row: (i, j) with another block of the rest, i <= j, or (block of the rest, block of the largest)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda i, j, own, side: F.struct(i.alias("i"), j.alias("j"), own.alias("own"), side.alias("side"))
    no = F.lit(False)
    among = F.transform(upto(F.col("rests")), lambda j: task(F.least("block", j), F.greatest("block", j), F.col("block") == j, (F.col("block") > j).cast("int")))
    beside = F.transform(upto(F.col("bigs")), lambda j: task(F.col("block"), -1 - j, no, F.lit(0)))
    large = F.transform(upto(F.col("rests")), lambda i: task(i, -1 - F.col("block"), no, F.lit(1)))
    work = rest.withColumn("block", block).withColumn("t", F.explode(F.when(F.col("big"), large).otherwise(F.concat(among, beside)))).select("bucket", "t.*", "cls", "g").join(payload, "cls")
    work = work.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    steps = [] if miss is None else posterior_table(plan, 16, miss)
    late = cut(work.mapInArrow(_compared(plan, steps, miss is not None), "a long, b long").distinct(), "links")
    out = groups if late.isEmpty() else cut(components(links.unionByName(late)), "components")
    release(spark, rest, links, late)
    return out
