"""Joins by similarity against all pairs, and how many rows they make."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatewright.operators import similar as sim


def made(n, seed):
    """Sets over a few frequent and many rare words, with near copies."""
    rng = random.Random(seed)
    out = [(0, "g", None), (1, "g", []), (2, "h", ["only"]), (3, "g", ["the", "the", "of"])]
    for i in range(4, n):
        w = [rng.choice(["the", "of", "and"]) for _ in range(4)] + [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 12))]
        out.append((i, rng.choice("gh"), w))
        if i % 5 == 0:
            out.append((n + i, "g", [*w[:-1], "changed"]))
    return out


SCHEMA = "id int, grp string, words array<string>"


@pytest.mark.parametrize("least", [0.4, 0.75, 1.0])
def test_jaccard_pairs(spark, least):
    a, b = made(80, 1), made(60, 2) + made(80, 1)[10:30]
    got = sim.jaccard_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["grp"], "words", least)
    digest = dict(spark.createDataFrame(list({tuple(sorted(set(w))): (list(w),) for _, _, w in a + b if w}.values()), "w array<string>").select(F.array_join(F.array_sort(F.array_distinct("w")), " "), sim.set_digest(F.col("w"))).collect())
    want = {}
    for _, g, u in a:
        for _, h, v in b:
            if g == h and u and v:
                x, y = set(u), set(v)
                j = len(x & y) / len(x | y)
                if j >= least - 1e-9:
                    want[g, digest[" ".join(sorted(x))], digest[" ".join(sorted(y))]] = j
    rows = got.collect()
    assert len(rows) == len(want) and want
    assert all(want[r["grp"], r["a"], r["b"]] == pytest.approx(r["jaccard"]) for r in rows)


def cosines(a, b):
    out = {}
    for i, _, u in a:
        for j, _, v in b:
            x, y = Counter(u or []), Counter(v or [])
            if x and y and (dot := sum(x[w] * y[w] for w in x)):
                out[i, j] = dot / math.sqrt(sum(c * c for c in x.values()) * sum(c * c for c in y.values()))
    return out


@pytest.mark.parametrize("least", [0.3, 0.7])
def test_cosine_pairs(spark, least):
    a, b = made(70, 3), made(50, 4)
    x, y = (sim.gram_weights(spark.createDataFrame(r, SCHEMA).withColumnRenamed("id", k), k, F.col("words")) for r, k in ((a, "i"), (b, "j")))
    got = {(r["i"], r["j"]): r["cosine"] for r in sim.cosine_pairs(x, y, "i", "j", least).collect()}
    want = {k: v for k, v in cosines(a, b).items() if v >= least - 1e-9}
    assert got == pytest.approx(want)


def test_common_grams_are_not_joined(spark):
    """Frequent words pair every row with every row; the prefixes leave them out."""
    a = [(i, "g", ["the", "of", "and", *[f"w{i}_{k}" for k in range(6)]]) for i in range(200)]
    x = sim.gram_weights(spark.createDataFrame(a, SCHEMA).withColumnRenamed("id", "i"), "i", F.col("words"))
    y = x.withColumnRenamed("i", "j")
    assert sim.candidates(x, y, "i", "j", 0.7).count() < 200 * 10
    assert x.join(y.drop("w"), "gram").count() > 200 * 200


def test_nearest(spark):
    a, b = made(70, 5), made(50, 6)
    x, y = (sim.gram_weights(spark.createDataFrame(r, SCHEMA).withColumnRenamed("id", k), k, F.col("words")) for r, k in ((a, "i"), (b, "j")))
    got = {r["i"]: (r["j"], r["cosine"]) for r in sim.nearest(x, y, "i", "j").collect()}
    best = {}
    for (i, j), c in cosines(a, b).items():
        best[i] = max(best.get(i, (-1.0, 0)), (round(c, 9), -j))
    assert {i: (-j, c) for i, (c, j) in best.items()} == {i: (j, pytest.approx(c)) for i, (j, c) in got.items()}


def test_nothing_is_similar_to_nothing(spark):
    a = spark.createDataFrame(made(20, 7), SCHEMA)
    assert sim.jaccard_pairs(a.limit(0), a, ["grp"], "words", 0.5).count() == 0
    empty = sim.gram_weights(a.limit(0), "id", F.col("words"))
    full = sim.gram_weights(a.withColumnRenamed("id", "j"), "j", F.col("words"))
    assert sim.nearest(empty, full, "id", "j").count() == 0 and sim.cosine_pairs(empty, full, "id", "j", 0.5).count() == 0


def test_equal_sets_are_not_searched(spark):
    """q344_equivalence searches near templates only for turns whose words are no template's."""
    from gatewright.plans import registry

    plan = registry.QUERIES["q344_equivalence"](spark, "/root/testdata/sf0.001")
    assert plan.count() > 0
    names = [f for f in plan.inputFiles() if "/sets-" in f]
    sides = [spark.read.parquet(f).select("act", "cls") for f in {f.rsplit("/", 1)[0] for f in names}]
    assert len(sides) == 2 and sides[0].intersect(sides[1]).count() == 0
