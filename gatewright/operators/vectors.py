"""Nearest neighbours over a stated query set, centroids, novelty."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Vectors of a block of the corpus and of one of the queries: what a task compares at a time.
CORPUS_BLOCK, QUERY_BLOCK = 1 << 15, 1 << 14


def _sound(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf"))) & F.exists(vector, lambda e: e != 0), F.lit(False))


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed element by element in order, as dot() does."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


def _best(query: np.ndarray, x: np.ndarray, key: np.ndarray, y: np.ndarray, k: int, digits: int, ties: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query (row of x) the rows of y that may be among its k best by rounded cosine, itself left out: places in
    query and key, and cosines that are not rounded yet. ties: all that are as near as the k-th."""
    nx, ny = np.sqrt(_in_order(x, x)), np.sqrt(_in_order(y, y))
    u, v = x / nx[:, None], y / ny[:, None]
    rows, cols, cos = [], [], []
    slack = 1.01 * 10.0**-digits + 1e-9
    for lo in range(0, len(x), 256):
        near = u[lo : lo + 256] @ v.T
        near[query[lo : lo + 256, None] == key[None, :]] = -2
        least = np.partition(near, -k, axis=1)[:, -k] if len(y) > k else np.full(len(near), -2.0)
        i, j = np.nonzero((near >= least[:, None] - slack) & (near > -2))
        i += lo
        c = _in_order(x[i], y[j]) / (nx[i] * ny[j])
        if not ties:
            # the first k by rounded cosine and key; what is within a hair of a rounding's edge stays for Spark's own rounding
            scaled = c * 10.0**digits
            order = np.lexsort((key[j], -np.floor(scaled + 0.5), i))
            i, j, c, scaled = i[order], j[order], c[order], scaled[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            stay = (place < k) | (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)
            i, j, c = i[stay], j[stay], c[stay]
        rows.append(i)
        cols.append(j)
        cos.append(c)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(cos)


def _compared(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, digits: int, ties: bool = False) -> DataFrame:
    """query, neighbour, cosine: a superset of each query's k best, from blocks of queries against blocks of the corpus.
    Both are dealt by a hash; a block is sent once for every block of the other side, so n vectors with n / 100 queries
    send n / (100 QUERY_BLOCK) + 1 copies of the corpus. What a cosine with a vector that is null, zero, holds a null or is
    not finite, or is of another length comes to (null or NaN) is worked out row by row."""
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("__q"))
    c = corpus.select(F.col(key).alias("neighbour"), F.col(vector).alias("__c"))
    sizes = corpus.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).collect()  # a row a length of vectors
    asked = queries.count()
    wide, deep = max(1, -(-asked // QUERY_BLOCK)), max(1, -(-sum(r["n"] for r in sizes) // CORPUS_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda k_, n: F.pmod(F.xxhash64(k_), F.lit(n)).cast("int")
    left = q.where(_sound("__q")).withColumn("__d", F.size("__q")).withColumn("__i", dealt("query", wide)).withColumn("__j", every(deep))
    right = c.where(_sound("__c")).withColumn("__d", F.size("__c")).withColumn("__j", dealt("neighbour", deep)).withColumn("__i", every(wide))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query": a.column("query").slice(0, 0), "neighbour": b.column("neighbour").slice(0, 0), "cosine": pa.array([], pa.float64())})
        dim = a.column("__d")[0].as_py()
        x, y = (t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) for t, name in ((a, "__q"), (b, "__c")))
        i, j, cos = _best(a.column("query").to_numpy(), x, b.column("neighbour").to_numpy(), y, k, digits, ties)
        return pa.table({"query": a.column("query").take(pa.array(i)), "neighbour": b.column("neighbour").take(pa.array(j)), "cosine": cos})

    kind = queries.schema[key].dataType
    schema = StructType().add("query", kind).add("neighbour", kind).add("cosine", "double")
    found = left.groupBy("__d", "__i", "__j").cogroup(right.groupBy("__d", "__i", "__j")).applyInArrow(best, schema)
    odd_q, odd_c = q.where(~_sound("__q")), c.where(~_sound("__c"))
    odd = odd_q.join(c, F.col("query") != F.col("neighbour")).unionByName(q.where(_sound("__q")).join(odd_c, F.col("query") != F.col("neighbour")))
    if len(sizes) > 1:
        odd = odd.unionByName(q.where(_sound("__q")).join(c.where(_sound("__c")), (F.size("__q") != F.size("__c")) & (F.col("query") != F.col("neighbour"))))
    norms = F.sqrt(dot("__q", "__q")) * F.sqrt(dot("__c", "__c"))
    return found.unionByName(odd.select("query", "neighbour", F.when(norms == 0, float("nan")).otherwise(dot("__q", "__c") / norms).alias("cosine")))


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, digits: int = 9) -> DataFrame:
    """Per query its k nearest corpus rows by cosine, itself left out; similarities rounded, ties to the lowest key.

    The queries are a stated set; every pair of blocks keeps its own k best before anything is shuffled (then a window over
    what is left)."""
    pairs = _compared(queries, corpus, key, vector, k, digits).select("query", "neighbour", F.round("cosine", digits).alias("similarity"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= k)


def nearest_with_ties(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, digits: int = 9) -> DataFrame:
    """As nearest, but equal similarities share a rank and all rows up to rank k stay: ties are never split."""
    pairs = _compared(queries, corpus, key, vector, k, digits, ties=True).select("query", "neighbour", F.round("cosine", digits).alias("similarity"))
    return pairs.withColumn("rank", F.rank().over(Window.partitionBy("query").orderBy(F.desc("similarity")))).where(F.col("rank") <= k)


def novelty(queries: DataFrame, corpus: DataFrame, key: str, vector: str, digits: int = 9) -> DataFrame:
    """1 - the largest cosine to the corpus (an aggregate, combined map-side)."""
    return _compared(queries, corpus, key, vector, 1, digits).groupBy("query").agg((1 - F.max(F.round("cosine", digits))).alias("novelty"))


def fold_centroids(df: DataFrame, fold: str, label: str, vector: str) -> DataFrame:
    """Per fold and label the mean vector of the other folds' rows: totals less the fold's own, element by element."""
    cells = df.select(fold, label, F.posexplode(vector).alias("i", "x")).groupBy(fold, label, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy(label, "i")
    rest = cells.select(fold, label, "i", F.try_divide(F.sum("s").over(every) - F.col("s"), F.sum("n").over(every) - F.col("n")).alias("m"))
    return rest.groupBy(fold, label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("centroid"))  # a vector's elements


def centroid_model(df: DataFrame, fold: str, label: str, item: str, vector: str, digits: int = 9) -> DataFrame:
    """item, pred, conf: nearest centroid of the other folds by squared distance (rounded, ties: lowest label), with
    the softmax of the negated distances as confidence. Centroids: folds x labels rows."""
    c = fold_centroids(df, fold, label, vector).withColumnRenamed(label, "cls")
    d = F.aggregate(F.zip_with(vector, "centroid", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    scored = df.select(item, fold, vector).join(F.broadcast(c), fold).select(item, "cls", F.round(d, digits).alias("d"))
    return scored.groupBy(item).agg(F.min_by("cls", F.struct("d", "cls")).alias("pred"), (F.max(F.exp(-F.col("d"))) / F.sum(F.exp(-F.col("d")))).alias("conf"))


def shortlist(items: DataFrame, labels: DataFrame, item: str, vector: str, label: str, label_vector: str, m: int, digits: int = 9) -> DataFrame:
    """Per item the m labels with the largest cosine, in order, as an array (labels: few rows)."""
    x = items.join(F.broadcast(labels), F.lit(True)).select(item, label, F.round(cosine(vector, label_vector), digits).alias("s"))
    return x.groupBy(item).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), label))), lambda e: e[label]), 1, m).alias("shortlist"))
