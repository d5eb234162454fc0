"""The class-aware layer: is any construction over several models worth shipping in place of the best single one?

Rows are staged as in allocate.staged(): outer -1 with the part to score, fitted on the other parts; outer o with the inner
parts of everything outside fold o. So the choice that is made for a fold never saw the fold.

Stacking is a ridge regression of one-hot classes on all models' probability vectors side by side, classes weighted alike.
It is solved from sums of products, which add up: one scan of the rows gives the sums of every training part, however many
parts a nested search has. Tables grow with parts x (models x classes)^2, not with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.sources.scratch import cut

#: Lower ends of the bins of confidence in which a model's reliability is counted (fixed values), and what a bin must hold.
BIN_STARTS = (0.0, 0.6, 0.7, 0.8, 0.9)
LEAST_IN_BIN = 25


def argmax_class(proba: str):
    """The most probable class (ties: the lowest)."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def _features(df: DataFrame, gold: str, probas: list[str]) -> DataFrame:
    return df.withColumn("__x", F.concat(*probas, F.array(F.lit(1.0))))


def _sums(rows: DataFrame, gold: str, classes: int) -> DataFrame:
    """outer, own, i, sums: row i of [X'WX | X'WY] over the training rows of every part, each class of the same weight."""
    weight: dict[tuple[int, int], np.ndarray] = {}
    counts = rows.groupBy("outer", "part", gold).agg(F.count("*").alias("n")).collect()  # parts x classes rows
    for outer in {r["outer"] for r in counts}:
        for own in {r["part"] for r in counts if r["outer"] == outer}:
            n = np.zeros(classes)
            for r in counts:
                if r["outer"] == outer and r["part"] != own and r[gold] is not None:
                    n[r[gold]] += r["n"]
            weight[outer, own] = np.divide(n.sum(), n * max(1, (n > 0).sum()), out=np.zeros(classes), where=n > 0)

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for p in parts:
            p = p[p[gold].notna()]
            if not len(p):
                continue
            x, g = np.stack(p["__x"].to_numpy()), p[gold].to_numpy(int)
            both = np.hstack([x, np.eye(classes)[g]])
            outer, part = p["outer"].to_numpy(), p["part"].to_numpy()
            for (o, own), w in weight.items():
                at = (outer == o) & (part != own)
                if at.any():
                    held[o, own] = held.get((o, own), 0) + (x[at] * w[g[at]][:, None]).T @ both[at]
        for (o, own), s in held.items():
            yield pd.DataFrame({"outer": o, "own": own, "i": range(len(s)), "sums": list(s)})

    partial = rows.select("outer", "part", gold, "__x").mapInPandas(add, "outer int, own int, i int, sums array<double>")

    def total(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"outer": [key[0]], "own": [key[1]], "i": [key[2]], "sums": [np.sum(np.stack(p["sums"].to_numpy()), axis=0)]})

    return partial.groupBy("outer", "own", "i").applyInPandas(total, "outer int, own int, i int, sums array<double>")  # a row a task in each group


def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients (features x classes) from [X'WX | X'WY]; the last feature is the constant, not penalised."""
    d = len(sums)
    penalty = np.full(d, ridge)
    penalty[-1] = 1e-9
    return np.linalg.solve(sums[:, :d] + np.diag(penalty), sums[:, d:])


def stacked(rows: DataFrame, gold: str, probas: list[str], classes: int, ridge: float = 1.0) -> DataFrame:
    """rows with `stack_pred`, every row's from the other parts of its outer."""
    featured = _features(rows, gold, probas)
    found: dict[tuple[int, int], list] = {}
    for r in cut(_sums(featured, gold, classes), "moments").collect():  # parts x features rows
        found.setdefault((r["outer"], r["own"]), []).append((r["i"], r["sums"]))
    fitted = {k: solve(np.array([s for _, s in sorted(v)]), ridge) for k, v in found.items()}
    named = featured.select(*rows.columns, "__x", F.lit(None).cast("int").alias("stack_pred"))

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = np.stack(p["__x"].to_numpy())
                got = np.zeros(len(p), int)
                for o, own in set(zip(p["outer"], p["part"], strict=True)):
                    at = ((p["outer"] == o) & (p["part"] == own)).to_numpy()
                    got[at] = (x[at] @ fitted[o, own]).argmax(1)
                yield p.assign(stack_pred=got)

    return named.mapInPandas(predict, named.schema).drop("__x")


def selected(rows: DataFrame, gold: str, probas: dict[str, str]) -> DataFrame:
    """rows with `select_pred`: the class named by the model that is most reliable for it, within a bin of its own confidence
    (in under 25 items of the other parts: in the class), ties to the first name."""
    low = [F.when(F.col("c") >= s, i) for i, s in enumerate(BIN_STARTS)]
    claims = F.array(*[F.struct(F.lit(n).alias("model"), argmax_class(p).alias("p"), F.array_max(p).alias("c")) for n, p in sorted(probas.items())])
    long = rows.select("outer", "part", "__row", gold, F.inline(claims)).withColumn("b", F.greatest(*low)).withColumn("ok", (F.col("p") == F.col(gold)).cast("int"))
    cube = long.groupBy("outer", "part", "model", "p", "b").agg(F.count("*").alias("n"), F.sum("ok").alias("s"))
    parts = F.broadcast(cube.select("outer", F.col("part").alias("own")).distinct())
    others = parts.join(cube, "outer").where("own <> part")  # parts x parts x models x classes x bins rows
    fine = others.groupBy("outer", F.col("own").alias("part"), "model", "p", "b").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("r3"))
    coarse = others.groupBy("outer", F.col("own").alias("part"), "model", "p").agg((F.sum("s") / F.sum("n")).alias("r2"))
    scored = long.join(F.broadcast(fine), ["outer", "part", "model", "p", "b"], "left").join(F.broadcast(coarse), ["outer", "part", "model", "p"], "left")
    r = F.round(F.when(F.col("n") >= LEAST_IN_BIN, F.col("r3")).otherwise(F.coalesce("r2", F.lit(0.0))), 12)
    best = scored.groupBy("__row").agg(F.min_by("p", F.struct((-r).alias("loss"), "model")).alias("select_pred"))
    return rows.join(best, "__row")


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def verdict(cells: pd.DataFrame, members: list[str], built: list[str]) -> dict:
    """What to ship, from one row a class: n, each arm's number right, and of each pair (built, member) how often both are.

    A construction qualifies if its balanced accuracy is above the best single model's, significantly so after Holm over
    the constructions (paired, by class, normal) and by no less than the rarest class lets anyone tell. The best one that
    qualifies is shipped; without one, the best single model (ties: the first name)."""
    n = cells["n"].to_numpy(float)
    score = {a: float((cells[a] / n).mean()) for a in [*members, *built]}
    single = max(sorted(members), key=lambda m: score[m])
    floor = math.sqrt(0.25 / n.min()) / math.sqrt(len(n))
    p = {}
    for b in built:
        gap = (cells[b] - cells[single]) / n
        spread = (cells[b] + cells[single] - 2 * cells[f"{b}|{single}"]) / n - gap**2
        error = math.sqrt(float((spread / n).sum())) / len(n)
        p[b] = _two_sided(float(gap.mean()) / error) if error > 0 else float(gap.mean() == 0)
    adjusted, worst = {}, 0.0
    for k, b in enumerate(sorted(built, key=lambda b: p[b])):
        worst = adjusted[b] = max(worst, min(1.0, p[b] * (len(built) - k)))
    good = [b for b in sorted(built) if adjusted[b] <= 0.05 and score[b] - score[single] >= floor]
    shipped = max(good, key=lambda b: score[b]) if good else single
    return {"single": single, "shipped": shipped, "delta": score[shipped] - score[single], "floor": floor, **{f"p_{b}": adjusted[b] for b in built}}


def layer(staged: DataFrame, gold: str, probas: dict[str, str], classes: int, ridge: float = 1.0) -> DataFrame:
    """A row for every fold (part of outer -1): the best single model and what is shipped, as decided on the other folds,
    and what both bring on the fold's own items. staged: rows of allocate.staged() with the probability vectors."""
    rows = cut(staged.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    members, built = sorted(probas), ["selection", "stacking"]
    chosen = selected(stacked(rows, gold, [probas[m] for m in members], classes, ridge), gold, probas)
    right = {**{m: argmax_class(probas[m]) == F.col(gold) for m in members}, "selection": F.col("select_pred") == F.col(gold), "stacking": F.col("stack_pred") == F.col(gold)}
    outcome = chosen.select("outer", "part", gold, *[F.coalesce(v.cast("int"), F.lit(0)).alias(k) for k, v in right.items()])
    both = [F.sum(F.col(b) * F.col(m)).alias(f"{b}|{m}") for b in built for m in members]
    cells = cut(outcome.where(F.col(gold).isNotNull()).groupBy("outer", "part", gold).agg(F.count("*").alias("n"), *[F.sum(a).alias(a) for a in right], *both), "cells")  # parts x classes rows

    def decide(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        per = p.drop(columns=["part"]).groupby(gold, as_index=False).sum()
        return pd.DataFrame([{"part": key[0], **verdict(per, members, built)}])

    kinds = "part int, single string, shipped string, delta double, floor double, p_selection double, p_stacking double"
    decided = cells.where("outer >= 0").groupBy("outer").applyInPandas(decide, kinds)  # classes rows in a group
    held = cells.where("outer = -1").join(F.broadcast(decided), "part")  # a row a fold
    named = lambda c: F.create_map(*[x for a in right for x in (F.lit(a), F.col(a) / F.col("n"))])[F.col(c)]
    return held.groupBy(F.col("part").alias("fold"), "single", "shipped", "delta", "floor", "p_selection", "p_stacking").agg(F.avg(named("single")).alias("single_score"), F.avg(named("shipped")).alias("shipped_score"))
