"""Running totals, ranks and frames against plain Python, with groups that lie in many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from gatewright.operators import defer as g
from gatewright.operators import ordered


def rows():
    rng = random.Random(4)
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 0.1, 0.5, 0.5, rng.random()]), rng.randrange(-3, 9)) for i in range(400)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "i int, k string, x double, v int").repartition(7)


def in_order(data, down=False):
    null = lambda x: (x is not None, x or 0.0)
    out = {}
    for r in sorted(data, key=lambda r: r[0]):
        out.setdefault(r[1], []).append(r)
    return {k: sorted(v, key=lambda r: null(r[2]), reverse=down) if not down else sorted(v, key=lambda r: (r[2] is None, -(r[2] or 0.0))) for k, v in out.items()}


@pytest.mark.parametrize("down", [False, True])
def test_running_totals(table, down):
    way = F.desc("x") if down else F.col("x")
    got = {r["i"]: (r["s"], r["place"]) for r in ordered.cumulate(table, ["k"], [way, "i"], {"s": F.col("v"), "place": F.lit(1)}).collect()}
    assert len(got) == 400
    for group in in_order(rows(), down).values():
        s = 0
        for place, r in enumerate(group, 1):
            s += r[3]
            assert got[r[0]] == (s, place)


def test_one_group(table):
    got = [r["place"] for r in ordered.ranked(table, [], ["i"], "place").orderBy("i").collect()]
    assert got == list(range(1, 401))
    assert ordered.ranked(table.limit(0), ["k"], ["i"], "place").count() == 0
    assert {r["n"] for r in ordered.with_size(table, [], "n").collect()} == {400}
    sizes = {r["k"]: r["n"] for r in ordered.with_size(table, ["k"], "n").collect()}
    assert sizes == {k: len(v) for k, v in in_order(rows()).items()}


def test_frames(table):
    got = {r["i"]: (r["s"], r["m"]) for r in ordered.sliding(table, ["k"], ["x", "i"], 7, {"s": F.sum("v"), "m": F.max("v")}, block=10).collect()}
    assert len(got) == 400
    for group in in_order(rows()).values():
        for j, r in enumerate(group):
            part = [q[3] for q in group[max(0, j - 6) : j + 1]]
            assert got[r[0]] == (sum(part), max(part))


def test_no_window_over_a_group(table):
    """No plan sorts a group of `by` in one task: every window's key has the range or the block in it."""
    df = table.where("x IS NOT NULL").withColumn("ok", (F.col("v") > 2).cast("int"))
    for out in (g.low_confidence_share(df, ["k"], "x", "ok", "i", 0.2), g.escalation_dial(df, [], "x", "ok", "i", [0.1]), g.band(df, ["k"], "x", "ok", "i", 0.2)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert all("__part" in w for w in windows)
