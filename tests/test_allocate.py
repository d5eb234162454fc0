"""The search over budgets and the class-aware layer against NumPy and plain Python."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gatewright.operators import allocate as al
from gatewright.operators import stacking as st
from gatewright.plans import cascade
from gatewright.plans import registry
from gatewright.sources.fixtures import CLASSES
from tests.compare import duck_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    fits = spark.sparkContext.accumulator(0)
    cells = cascade.fitted_search(spark, SF_DIR, fits).toPandas()
    return cells, fits.value


def test_every_part_is_fitted_once(fitted):
    """Five folds and three inner parts outside each: twenty training parts, whatever the number of budgets."""
    cells, fits = fitted
    assert fits == 20
    assert set(cells["rule"]) == {"confidence", "margin", "committee", "class_aware", "per_class_conf", "precision_floor", "conformal", "router"}
    assert sorted(set(cells["share"])) == cascade.GRID


def test_fitted_rules_leave_the_others_alone(spark, fitted):
    keys = ["outer", "part", "rule", "share", "gold"]
    plain = cascade.search(spark, SF_DIR).toPandas().sort_values(keys).reset_index(drop=True)
    cells = fitted[0]
    same = cells[~cells["rule"].isin(["conformal", "router"])].sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain[[*keys, "n", "right", "called"]], same[[*keys, "n", "right", "called"]])


def test_ends_of_the_budget(fitted):
    cells, _ = fitted
    budget = cells[cells["rule"] != "precision_floor"]
    assert (budget[budget["share"] == 0]["called"] == 0).all()
    at_one = budget[budget["share"] == 1]
    assert (at_one["called"] == at_one["n"]).all()


def test_router_against_numpy(spark):
    rows = al.staged(cascade.items(spark, SF_DIR), "fold", "inner_fold").where("outer = 2")
    got = al.router_scores(rows, ["outer"], "part", "free_pred", "free_conf", "margin", "free_ok", "llm_ok").toPandas()
    b = np.minimum(np.floor(got["free_conf"] * al.BINS), al.BINS - 1)
    m = np.minimum(np.floor(got["margin"] * al.MARGIN_BINS), al.MARGIN_BINS - 1)
    x = np.column_stack([got["free_pred"].to_numpy()[:, None] == np.arange(CLASSES), (b + 0.5) / al.BINS, (m + 0.5) / al.MARGIN_BINS, np.ones(len(got))]).astype(float)
    for own in sorted(set(got["part"])):
        train = (got["part"] != own).to_numpy()
        chance = []
        for ok in ("free_ok", "llm_ok"):
            # gradient of the penalised likelihood is nil at the fit, so plain descent by another way ends there too
            y, w = got[ok].to_numpy(float)[train], np.zeros(x.shape[1])
            pen = np.full(x.shape[1], 1.0)
            pen[-1] = 1e-6
            for _ in range(4000):
                p = 1 / (1 + np.exp(-x[train] @ w))
                w -= (x[train].T @ (p - y) + pen * w) / (0.25 * train.sum() + 1)
            chance.append(1 / (1 + np.exp(-x @ w)))
        assert np.abs((chance[0] - chance[1])[~train] - got["router"].to_numpy()[~train]).max() < 2e-3


def test_precision_margin_against_python(spark):
    x = cascade.items(spark, SF_DIR).toPandas()
    got = al.precision_margin(cascade.items(spark, SF_DIR), [], "fold", "free_pred", "free_conf", "free_ok", "llm_pred", "llm_ok", [0.0, 0.1, 0.5], 5).toPandas()
    for own in sorted(set(x["fold"])):
        tr, te = x[x["fold"] != own], x[x["fold"] == own]
        for margin in (0.0, 0.1, 0.5):
            called = set(got[(got["fold"] == own) & (got["share"] == margin) & got["escalate"]]["item_id"])
            want = set()
            for c in set(te["free_pred"]):
                part = tr[tr["free_pred"] == c].sort_values("free_conf", ascending=False)
                claims = tr[tr["llm_pred"] == c]
                bar = (1 - margin) * (claims["llm_ok"].mean() if len(claims) else tr["llm_ok"].mean())
                run = part["free_ok"].cumsum() / np.arange(1, len(part) + 1)
                good = part["free_conf"][((run >= bar) & (np.arange(1, len(part) + 1) >= 5)).to_numpy()]
                own_items = te[te["free_pred"] == c]
                want |= set(own_items["item_id"] if good.empty else own_items[own_items["free_conf"] < good.min()]["item_id"])
            assert called == want


def test_stacking_against_numpy(spark):
    rows = cascade.staged_members(spark, SF_DIR)
    got = st.stacked(rows, "gold", ["proba_b", "proba", "proba_llm"], CLASSES).toPandas()
    x = np.hstack([np.stack(got[c].to_numpy()) for c in ("proba_b", "proba", "proba_llm")] + [np.ones((len(got), 1))])
    g = got["gold"].to_numpy()
    for outer, own in set(zip(got["outer"], got["part"], strict=True)):
        at = (got["outer"] == outer).to_numpy()
        train, test = at & (got["part"] != own).to_numpy(), at & (got["part"] == own).to_numpy()
        n = np.bincount(g[train], minlength=CLASSES)
        w = (train.sum() / (np.maximum(n, 1) * (n > 0).sum()))[g[train]]
        root = np.sqrt(w)[:, None]
        pen = np.diag(np.r_[np.ones(x.shape[1] - 1), np.sqrt(1e-9)])
        # the same ridge as least squares on rows that stand for the penalty
        coef = np.linalg.lstsq(np.vstack([x[train] * root, pen]), np.vstack([np.eye(CLASSES)[g[train]] * root, np.zeros((x.shape[1], CLASSES))]), rcond=None)[0]
        assert ((x[test] @ coef).argmax(1) == got["stack_pred"].to_numpy()[test]).all()


def test_layer_ships_what_helps(spark):
    got = registry.QUERIES["q273_stacking_layer"](spark, SF_DIR).toPandas()
    assert len(got) == 5 and set(got["shipped"]) <= {"selection", "stacking", "b", "free", "llm"}
    assert got["shipped_score"].mean() >= got["single_score"].mean()
    built = got[got["shipped"].isin(["selection", "stacking"])]
    assert len(built) and (built["delta"] >= built["floor"]).all()


def test_verdict_falls_back():
    """Nothing is shipped that the data can't tell from the best single model, or that a smaller construction beats alone."""
    cells = pd.DataFrame({"n": [1000, 1000], "a": [700, 700], "m": [600, 600], "selection": [701, 702], "stacking": [690, 800]})
    for b in ("selection", "stacking"):
        for m in ("a", "m"):
            cells[f"{b}|{m}"] = np.minimum(cells[b], cells[m])
    got = st.verdict(cells, ["a", "m"], ["selection", "stacking"])
    assert (got["single"], got["shipped"]) == ("a", "stacking") and got["delta"] == pytest.approx(0.045)
    cells["stacking"] = [690, 705]
    cells["stacking|a"] = [690, 700]
    got = st.verdict(cells, ["a", "m"], ["selection", "stacking"])
    assert got["shipped"] == "a" and got["delta"] == 0


def test_gain_for_a_tenth(spark):
    points = spark.createDataFrame([("confidence", 0.0, 0.5, 0.0), ("confidence", 0.2, 0.6, 0.25), ("confidence", 0.3, 0.7, 0.25), ("margin", 0.2, 0.9, 0.2)], "rule string, share double, balanced_accuracy double, llm_share double")
    got = [r["gain_per_tenth"] for r in al.gains(points).orderBy("share").collect()]
    assert got[0] is None and got[1] == pytest.approx(0.04) and got[2] is None


def test_pool_router_against_python(spark):
    """Board, arbitration and hand-over as loops over items."""
    from gatewright.operators import defer as g
    from gatewright.plans.decide import POOL
    from gatewright.sources.fixtures import members

    x = members(spark, SF_DIR).select("item_id", "fold", "gold", *POOL.values(), "llm_ok", "llm_pred")
    rows = x.toPandas()
    got = g.pool_router(x, "fold", "gold", POOL, "llm_ok", 0.4).toPandas().set_index("item_id")
    assert len(got) == len(rows)
    classes = sorted({c for m in POOL.values() for c in rows[m]})
    for own in sorted(set(rows["fold"])):
        tr, te = rows[rows["fold"] != own], rows[rows["fold"] == own]
        acc = {m: (tr[p] == tr["gold"]).mean() for m, p in POOL.items()}
        score = {(m, c): ((tr[p][tr[p] == c] == tr["gold"][tr[p] == c]).sum() + 20 * acc[m]) / ((tr[p] == c).sum() + 20) for m, p in POOL.items() for c in classes}
        order = sorted(POOL, key=lambda m: (-round(acc[m], 12), list(POOL).index(m)))
        edge = lambda m, c: round(score[m, c] - sum(score[k, c] for k in POOL) / len(POOL), 12)  # noqa: B023, E731
        say = lambda r: max((edge(m, getattr(r, POOL[m])), -order.index(m), getattr(r, POOL[m])) for m in POOL)[2]  # noqa: B023, E731
        train = [(say(r), r.gold, r.llm_ok) for r in tr.itertuples()]
        mine = {r.item_id: say(r) for r in te.itertuples()}
        assert mine == {i: got["pred"][i] for i in mine}

        def balanced(taken):
            by = {}
            for p, gold, llm in train:  # noqa: B023
                by.setdefault(gold, []).append(llm if p in taken else p == gold)
            return sum(sum(v) / len(v) for v in by.values()) / len(by)

        room, taken, left = 0.4 * len(te), set(), sorted({p for p, _, _ in train})
        while left:
            best = max(left, key=lambda c: (round(balanced(taken | {c}), 12), -c))
            if balanced(taken | {best}) <= balanced(taken) + 1e-12:
                break
            left.remove(best)
            size = sum(p == best for p in mine.values())
            if 0 < size <= room:
                room -= size
                taken.add(best)
        assert {got["pred"][i] for i in mine if got["escalate"][i]} == taken


def test_pool_stays_within_its_budget(spark):
    out = registry.QUERIES["q263_pool_router"](spark, SF_DIR).first()
    assert 0 < out["llm_share"] <= 0.4 + 1e-9 and 0.5 < out["balanced_accuracy"] < 1


def test_unlabelled_items(spark, tmp_path):
    """q269_deferral_curve equals its SQL where labels are null: such items have no committee score and no outcome."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    e.withColumn("label", F.when(F.col("vec_id") % 7 != 3, F.col("label"))).coalesce(1).write.parquet(str(tmp_path / "made"))
    (part,) = (tmp_path / "made").glob("*.parquet")
    part.rename(tmp_path / "embeddings.parquet")
    name = "q269_deferral_curve"
    got, want = spark_rows(registry.QUERIES[name](spark, str(tmp_path))), duck_rows(registry.ORACLE_SQL[name], str(tmp_path))
    assert got == want


def test_null_scores_are_left_out(spark):
    rows = [(i, i % 2, None if i % 3 == 0 else float(i * 37 % 101)) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, 2, None)], "i long, fold int, s double")
    got = {(r["fold"], r["share"]): r["t"] for r in al.share_thresholds(df, [], "fold", "s", [0.1, 0.5, 0.75]).collect()}
    for (fold, share), t in got.items():
        assert t == pytest.approx(np.quantile([s for _, f, s in rows if f != fold and s is not None], share))
    assert len(got) == 9
    none = spark.createDataFrame([(0, None), (1, None)], "fold int, s double")
    assert {r["t"] for r in al.share_thresholds(none, [], "fold", "s", [0.0, 0.5]).collect()} == {None}


def test_balanced_accuracy_does_not_hang_on_the_order_of_classes(spark):
    """Classes' accuracies have one mean, the nearest double, in whatever order their rows come (q264_committee, q269_deferral_curve)."""
    rng = np.random.default_rng(5)
    n = rng.integers(900, 1100, 10)
    right = [int(rng.integers(600, k)) for k in n]
    rows = [(order, int(label), int(n[c]), right[c], 0) for order in range(40) for c, label in enumerate(rng.permutation(1000)[:10])]
    cells = spark.createDataFrame(rows, "rule int, gold int, n long, right long, called long")
    want = float(sum(Fraction(r, int(k)) for r, k in zip(right, n, strict=True)) / 10)
    assert {r["balanced_accuracy"] for r in al.curve(cells, ["rule"], "gold").collect()} == {want}
    items = spark.createDataFrame([(i, g, k < r) for i, g, c, r, _ in rows[:50] for k in range(c)], "rule int, gold int, ok boolean")
    got = al.outcomes(items.select("rule", "gold", F.col("ok").cast("int").alias("f"), F.lit(1).alias("l"), F.lit(False).alias("escalate")), ["rule"], "gold", "f", "l")
    assert {r["balanced_accuracy"] for r in got.collect()} == {want}
