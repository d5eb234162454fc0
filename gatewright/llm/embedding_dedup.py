"""Embedding near-deduplication by dual traversal of cover trees.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so pairs of cosine >= t are pairs of at most that distance. Vectors
are dealt to the nearest of a few pivots (a net of a bounded sample) and each cell into chunks of bounded size. Each
chunk becomes a cover tree: nested levels of centres whose radii halve, every node with its true covering radius. A
pair of cells, of chunks or of nodes is pruned when its centres are further apart than both radii and the distance
together, and taken whole when even its furthest points are near enough; what is left is compared point by point in
double precision, so the pairs are exact. A pair of chunks returns link counts and the edges of a spanning forest, so
a large group of near copies yields rows in proportion to its size, not to its square.

Chunks are sent to pairs of blocks, and not to pairs of chunks: a block holds the chunks of BLOCK vectors, cells side by
side, and a chunk goes once to every block that it has a partner in. So n vectors are sent at most n / BLOCK + 1 times.

Pairs at the threshold itself are linked if the cosine in double precision is not below it; equal cosines need no other
rule. In many dimensions random vectors are all about equally far apart, and no bound of a tree prunes there: then pairs of
chunks are compared point by point, and the work grows with the square of the distinct vectors.

Equal vectors are one class that counts as often as it occurs. Vectors that are null, empty, zero or hold a null or
non-finite component link with nothing; vectors of unlike lengths aren't linked. Repeated ids stay rows of their own. An empty table
gives no rows. Extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm.common import components, cut, table

#: Vectors of a chunk, points of a leaf, pivots, and vectors of the sample that pivots are drawn from.
CHUNK, LEAF, MOST_PIVOTS, SAMPLE = 4096, 16, 256, 4096

#: Vectors of a block at most (a task holds two of them), and blocks at least, so that all cores have work.
BLOCK, LEAST_BLOCKS = 1 << 16, 12
_TINY = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def net(x: np.ndarray, radius: float, most: int | None = None) -> tuple[list[int], np.ndarray]:
    """Centres (positions, the first one 0) that cover all rows within radius, and each row's centre number."""
    least = 1 - radius * radius / 2  # as a cosine
    own, near = np.full(len(x), -1), np.full(len(x), -2.0)
    centres: list[int] = []
    left = np.arange(len(x))
    while len(left) and (most is None or len(centres) < most):
        c = int(left[0])
        dot = x @ x[c]
        closer = dot > np.maximum(near, least)
        own[closer] = len(centres)
        near[closer] = dot[closer]
        own[c] = len(centres)
        centres.append(c)
        left = left[own[left] < 0]
    return centres, own


class CoverTree:
    """Nodes over unit vectors in tree order: centre, radius, first and last row, children (first and last node)."""

    def __init__(self, x: np.ndarray):
        order = np.arange(len(x))
        self.nodes: list[list[float]] = []
        # breadth first, so that a node's children are neighbours; a slot of order per node
        queue = [(0, len(x), 2.0)]
        slots: list[tuple[int, int, float]] = []
        self.nodes.append(self._node(x, order, 0, len(x)))
        slots.append(queue[0])
        k = 0
        while k < len(slots):
            a, b, radius = slots[k]
            centre_radius = self.nodes[k][1]
            if b - a > LEAF and centre_radius > _TINY:
                radius = min(radius, 2.0 ** math.ceil(math.log2(centre_radius)))
                part = order[a:b].copy()
                while True:
                    radius /= 2
                    centres, own = net(x[part], radius)
                    if len(centres) > 1:
                        break
                by = np.argsort(own, kind="stable")
                order[a:b] = part[by]
                sizes = np.bincount(own, minlength=len(centres))
                ends = a + np.cumsum(sizes)
                self.nodes[k][4:6] = [len(self.nodes), len(self.nodes) + len(centres)]
                for e, s, c in zip(ends.tolist(), sizes.tolist(), centres, strict=True):
                    self._lead(order, e - s, e, part[c])
                    self.nodes.append(self._node(x, order, e - s, e))
                    slots.append((e - s, e, radius))
            k += 1
        self.order = order
        self.table = np.array(self.nodes, float)

    @staticmethod
    def _lead(order: np.ndarray, a: int, b: int, centre: int) -> None:
        """The centre first, so that it is the centre of the node's first child too."""
        at = a + int(np.flatnonzero(order[a:b] == centre)[0])
        order[a], order[at] = order[at], order[a]

    @staticmethod
    def _node(x: np.ndarray, order: np.ndarray, a: int, b: int) -> list[float]:
        own = x[order[a:b]]
        far = float(np.sqrt(max(0.0, float((2 - 2 * (own @ own[0])).max())))) if b - a > 1 else 0.0
        return [a, far, a, b, 0, 0]


class Forest:
    """Union-find over the rows of two chunks; edges that joined something."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def dual_links(x: np.ndarray, s: np.ndarray, wx: np.ndarray, y: np.ndarray, t: np.ndarray, wy: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Linked weight of each row of x and of y, and a spanning forest of the links as edges (row of x, row of y), rows
    of y counted on after those of x unless both are the same chunk. s and t: the trees' node tables."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    nx, ny = np.zeros(len(x)), np.zeros(len(y))
    shift = 0 if same else len(x)
    forest = Forest(len(x) + (0 if same else len(y)))
    # pairs of lists of nodes: all of the left against all of the right; `own`: only pairs i <= j of the same list
    todo: list[tuple[np.ndarray, np.ndarray, bool]] = []

    def push(left: np.ndarray, right: np.ndarray, own: bool) -> None:
        """Nodes with and without a radius apart: for those without, one bound holds for all pairs."""
        a, b = ([n[r[n, 1] == 0], n[r[n, 1] > 0]] for n, r in ((left, s), (right, t)))
        if own:
            todo.extend((n, n, True) for n in a if len(n))
            if len(a[0]) and len(a[1]):
                todo.append((a[0], a[1], False))
        else:
            todo.extend((m, n, False) for m in a for n in b if len(m) and len(n))

    def rows(nodes: np.ndarray, k: int) -> tuple[int, int]:
        return int(nodes[k, 2]), int(nodes[k, 3])

    def points(i: int, j: int) -> None:
        """Links within a leaf."""
        (a, b), (c, d) = rows(s, i), rows(t, j)
        p, q = np.nonzero(np.triu(x[a:b] @ y[c:d].T >= cosine, 1))
        np.add.at(nx, a + p, wy[c + q])
        np.add.at(ny, c + q, wx[a + p])
        for u, v in zip((a + p).tolist(), (c + q).tolist(), strict=True):
            forest.join(u, shift + v)

    def leaves(left: np.ndarray, right: np.ndarray) -> None:
        """Pairs of leaves (left[k], right[k]): the rows of one against the rows of all that it is paired with."""
        flip = len(np.unique(left)) > len(np.unique(right))
        if flip:
            left, right = right, left
        (p, u, w_u, near_u), (q, v, w_v, near_v) = ((t, y, wy, ny), (s, x, wx, nx)) if flip else ((s, x, wx, nx), (t, y, wy, ny))
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        for others in np.split(np.arange(len(left)), np.flatnonzero(np.diff(left)) + 1):
            a, b = rows(p, int(left[others[0]]))
            first, size = q[right[others], 2].astype(np.int64), (q[right[others], 3] - q[right[others], 2]).astype(np.int64)
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            i, j = np.nonzero(u[a:b] @ v[at].T >= cosine)
            if not len(i):
                continue
            i, j = a + i, at[j]
            np.add.at(near_u, i, w_v[j])
            np.add.at(near_v, j, w_u[i])
            for e, f in zip(*((j, i) if flip else (i, j)), strict=True):
                forest.join(int(e), shift + int(f))

    def whole(i: int, j: int) -> None:
        (a, b), (c, d) = rows(s, i), rows(t, j)
        nx[a:b] += wy[c:d].sum()
        ny[c:d] += wx[a:b].sum()
        for u in range(a, b):
            forest.join(u, shift + c)
        for v in range(c, d):
            forest.join(a, shift + v)

    def dense() -> None:
        """All points against all: single precision with slack finds the candidates, double precision decides."""
        p, q = x.astype(np.float32), y.astype(np.float32)
        for lo in range(0, len(x), 1024):
            i, j = np.nonzero(p[lo : lo + 1024] @ q.T >= cosine - 1e-5)
            i += lo
            some = i < j if same else np.ones(len(i), bool)
            i, j = i[some], j[some]
            some = np.einsum("kd,kd->k", x[i], y[j]) >= cosine
            i, j = i[some], j[some]
            np.add.at(nx, i, wy[j])
            np.add.at(ny, j, wx[i])
            for u, v in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(u, shift + v)

    # trees whose root falls apart into nearly as many nodes as rows bound nothing
    flat = lambda t, n: t[0, 5] - t[0, 4] >= 0.75 * n
    if flat(s, len(x)) and flat(t, len(y)):
        dense()
    else:
        push(np.array([0]), np.array([0]), same)
    while todo:
        left, right, own = todo.pop()
        point = s[left[0], 1] == 0 and t[right[0], 1] == 0
        for lo in range(0, len(left), 1024):
            part = left[lo : lo + 1024]
            xs = x[s[part, 0].astype(np.int64)]
            for at in range(lo if own else 0, len(right), 1024):
                some = right[at : at + 1024]
                dots = xs @ y[t[some, 0].astype(np.int64)].T
                if point:
                    alive = dots >= 1 - (eps + _TINY) ** 2 / 2
                else:
                    alive = dots >= 1 - np.square(s[part, 1][:, None] + (t[some, 1][None, :] + eps + _TINY)) / 2
                if own and lo == at:
                    alive = np.triu(alive)
                p, q = np.nonzero(alive)
                i, j = part[p], some[q]
                self_pair = (i == j) if own else np.zeros(len(i), bool)
                apart = np.sqrt(np.maximum(2 - 2 * dots[p, q], 0))
                near = ~self_pair & (apart + s[i, 1] + t[j, 1] < eps - 1e-7)
                leaf_i, leaf_j = s[i, 5] == 0, t[j, 5] == 0
                for k in np.flatnonzero(near).tolist():
                    whole(int(i[k]), int(j[k]))
                both = ~near & leaf_i & leaf_j
                for k in np.flatnonzero(both & self_pair & (s[i, 3] - s[i, 2] > 1)).tolist():
                    points(int(i[k]), int(j[k]))
                if (flat := both & ~self_pair).any():
                    leaves(i[flat], j[flat])
                rest = ~near & ~both
                down = lambda nodes, k: np.arange(int(nodes[k, 4]), int(nodes[k, 5]))
                for k in np.flatnonzero(rest & ~leaf_i & ~leaf_j).tolist():
                    push(down(s, i[k]), down(t, j[k]), bool(self_pair[k]))
                # the leaves that meet one wider node go down with it together
                for k in np.unique(j[rest & leaf_i]).tolist():
                    push(i[rest & leaf_i & (j == k)], down(t, k), False)
                for k in np.unique(i[rest & leaf_j]).tolist():
                    push(down(s, k), j[rest & leaf_j & (i == k)], False)
    if same:
        nx = nx + ny
        ny = nx
    return nx, ny, forest.edges


def _chunk_row(rows: pa.Table) -> pa.Table:
    """A chunk as one row: its tree, its vectors in tree order, classes and weights."""
    raw = np.array(rows.column("vector").to_pylist(), np.float32)
    x = unit(raw)
    tree = CoverTree(x)
    order = tree.order
    cls = rows.column("cls").to_numpy()[order]
    weight = rows.column("weight").to_numpy()[order].astype(float)
    return pa.table({
        **{c: rows.column(c).slice(0, 1) for c in ("chunk", "block", "cell", "space", "dim")}, "radius": pa.array([float(tree.table[0, 1])]), "centre": pa.array([x[order[0]].tolist()], pa.list_(pa.float64())),
        "payload": pa.array([raw[order].tobytes()], pa.binary()), "tree": pa.array([tree.table.tobytes()], pa.binary()), "cls": pa.array([cls.tobytes()], pa.binary()), "weight": pa.array([weight.tobytes()], pa.binary()),
    })


_CHUNK_SCHEMA = "chunk string, block long, cell int, space string, dim int, radius double, centre array<double>, payload binary, tree binary, cls binary, weight binary"


def _pivots(vectors: DataFrame, n: int, spaces: int) -> dict[int, np.ndarray]:
    """Per length of vector: centres of a net of a sample of at most about SAMPLE vectors."""
    share = min(1.0, SAMPLE / max(n, 1))
    u = F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    by_dim: dict[int, list] = {}
    for r in vectors.where(u < share).select("dim", "vector").limit(4 * SAMPLE).collect():
        by_dim.setdefault(r["dim"], []).append(r["vector"])
    out = {}
    most = max(1, min(MOST_PIVOTS, n // (CHUNK * max(spaces, 1))))
    for dim, rows in by_dim.items():
        x = unit(np.array(sorted(rows), float))
        radius = 2.0
        centres = [0]
        while len(centres) < min(most, len(x)) and radius > _TINY:
            radius /= 2
            centres, _ = net(x, radius, most)
        out[dim] = x[centres]
    return out


def link_vectors(df: DataFrame, key: str, vector: str, cosine: float = 0.9, chunk: int = CHUNK, by: str | None = None) -> DataFrame:
    """One row per row of df: key, n_links, component_id (smallest key reachable), kept. by: a column of few values; only
    vectors of one value are linked, and none where it is null."""
    sound = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("vector", lambda e: e != 0)
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"), (F.col(by).cast("string") if by else F.lit("")).alias("by"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("by").isNotNull())
    # -0.0 and 0.0 are one number
    rows = rows.withColumn("vector", F.when(F.col("sound"), F.transform("vector", lambda e: e + F.lit(0.0).cast("float"))))
    classes = cut(rows.where("sound").groupBy("by", "vector").agg(F.count("*").alias("weight"), F.min("key").alias("least")).withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")).withColumn("space", F.concat_ws("/", "dim", "by")), "vectors")
    spaces = [r["n"] for r in classes.groupBy("space").agg(F.count("*").alias("n")).collect()]  # a row a length and value of `by`
    pivots = _pivots(classes, sum(spaces), len(spaces))
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors a length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                p = shared.value.get(dim)
                if p is None:
                    far[at] = 2.0
                    continue
                x = unit(np.array(batch.column(0).take(pa.array(at)).to_pylist(), float))
                near = x @ p.T
                cells[at] = near.argmax(1)
                far[at] = np.sqrt(np.maximum(2 - 2 * near.max(1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(far)], ["vector", "cls", "dim", "space", "weight", "cell", "far"])

    placed = cut(classes.select("vector", "cls", "dim", "space", "weight").mapInArrow(place, "vector array<float>, cls long, dim int, space string, weight long, cell int, far double"), "placed")
    sizes = placed.groupBy("space", "dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("reach"))
    bounds = sorted(tuple(r) for r in sizes.where("dim is not null").collect())  # cells: pivots of each length
    if not bounds:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    block = max(chunk, min(BLOCK, sum(spaces) // LEAST_BLOCKS))
    # of each cell: its chunks, and how many vectors stand in cells before it; a space begins in a block of its own
    starts: list[tuple[str, int, int, int]] = []
    at, before = 0, bounds[0][0]
    for space, _, cell, n, _ in bounds:
        at = at if space == before else -(-at // block) * block
        starts.append((space, cell, -(-n // chunk), at))
        at, before = at + -(-n // chunk) * chunk, space
    cells = F.broadcast(df.sparkSession.createDataFrame(starts, "space string, cell int, parts int, at long"))
    dealt = placed.join(cells, ["space", "cell"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    dealt = dealt.withColumn("chunk", F.concat_ws("/", "space", "cell", "part")).withColumn("block", F.floor((F.col("at") + F.col("part") * chunk) / block))
    chunks = cut(dealt.select("chunk", "block", "cell", "space", "dim", "vector", "cls", "weight").groupBy("chunk").applyInArrow(_chunk_row, _CHUNK_SCHEMA), "chunks")

    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    by_space: dict[str, list[tuple[int, int, float]]] = {}
    for space, dim, cell, _, reach in bounds:
        by_space.setdefault(space, []).append((dim, cell, reach))
    near_cells = [(space, a, b) for space, own in by_space.items() for d, a, ra in own for _, b, rb in own if a <= b and (d not in pivots or float(np.linalg.norm(pivots[d][a] - pivots[d][b])) <= ra + rb + eps + _TINY)]
    cell_pairs = df.sparkSession.createDataFrame(near_cells, "space string, cell_a int, cell_b int")
    side = chunks.select("space", "cell", "chunk", "block", "radius", "centre")
    a = side.select("space", F.col("cell").alias("cell_a"), F.col("chunk").alias("a"), F.col("block").alias("block_a"), F.col("radius").alias("ra"), F.col("centre").alias("ca"))
    b = side.select("space", F.col("cell").alias("cell_b"), F.col("chunk").alias("b"), F.col("block").alias("block_b"), F.col("radius").alias("rb"), F.col("centre").alias("cb"))
    apart = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = cell_pairs.join(a, ["space", "cell_a"]).join(b, ["space", "cell_b"]).where((F.col("cell_a") < F.col("cell_b")) | (F.col("a") <= F.col("b")))
    pairs = cut(pairs.where(apart <= F.col("ra") + F.col("rb") + F.lit(eps + _TINY)).select(F.least("block_a", "block_b").alias("left"), F.greatest("block_a", "block_b").alias("right"), "a", "b"), "pairs")
    partners = pairs.groupBy("left", "right", F.col("a").alias("chunk")).agg(F.collect_list("b").alias("partners"))  # chunks of one block
    others = pairs.select("left", "right", F.col("b").alias("chunk"), F.array().cast("array<string>").alias("partners")).distinct()
    sent = partners.unionByName(others).groupBy("left", "right", "chunk").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    work = sent.join(chunks.select("chunk", "dim", "payload", "tree", "cls", "weight"), "chunk")

    def traverse(rows: pa.Table) -> pa.Table:
        """The pairs of chunks of a pair of blocks."""
        held = {}
        for name, dim, payload, tree, cls, weight in zip(*(rows.column(c).to_pylist() for c in ("chunk", "dim", "payload", "tree", "cls", "weight")), strict=True):
            held[name] = unit(np.frombuffer(payload, np.float32).reshape(-1, dim)), np.frombuffer(tree, float).reshape(-1, 6), np.frombuffer(cls, np.int64), np.frombuffer(weight, float)
        out = [np.zeros((0, 3), np.int64)]
        for a, most in zip(rows.column("chunk").to_pylist(), rows.column("partners").to_pylist(), strict=True):
            for b in most:
                (x, s, cx, wx), (y, t, cy, wy) = held[a], held[b]
                nx, ny, edges = dual_links(x, s, wx, y, t, wy, cosine, a == b)
                every, counts = (cx, nx) if a == b else (np.concatenate([cx, cy]), np.concatenate([nx, ny]))
                hit = np.flatnonzero(counts)
                e = np.array(edges, np.int64).reshape(-1, 2)
                out.append(np.column_stack([every[hit], np.full(len(hit), -1), counts[hit].astype(np.int64)]))
                out.append(np.column_stack([every[e[:, 0]], every[e[:, 1]], np.zeros(len(e), np.int64)]))
        all_ = np.concatenate(out)
        return pa.table({c: all_[:, i] for i, c in enumerate(("cls", "other", "links"))})

    found = cut(work.groupBy("left", "right").applyInArrow(traverse, "cls long, other long, links long"), "found")
    linked = found.where("other < 0").groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.where("other >= 0").select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cls")
    named = classes.select("by", "vector", "cls", "weight", "least").join(groups, "cls", "left").join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    labels = cut(named.join(smallest, "component").select("by", "vector", "smallest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")), "labels")
    out = rows.join(labels, ["by", "vector"], "left")
    component = F.coalesce("smallest", "key")
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
