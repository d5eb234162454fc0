"""Allocation of a budget of expensive calls: rules that say which items go, fitted on other folds, and what they bring.

Every rule takes items with a fold and gives them the column `escalate`. Rules work on tables of folds x classes x bins
or of distinct scores; items are joined with the outcome by broadcast, as those tables don't grow with the items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.functions import stats
from gatewright.operators import conformal, ordered
from gatewright.sources.scratch import cut

#: Bins of confidence in which reliabilities are fitted.
BINS = 20


def share_thresholds(df: DataFrame, by: list[str], fold: str, score: str, shares: list[float], own: bool = False) -> DataFrame:
    """Per fold and share the quantile (linear interpolation) of the scores of the other folds, or of the fold itself; null
    scores are left out, as in SQL. Scores are counted first; their running counts go over ranges of the order, so no fold is in one task."""
    cells = df.groupBy(*by, fold, F.col(score).alias("s")).agg(F.count(F.col(score)).alias("c"))
    folds = F.broadcast(df.select(*by, F.col(fold).alias("__own")).distinct())
    side = F.col("__own") == F.col(fold) if own else F.col("__own") != F.col(fold)
    pairs = folds.join(cells, by).where(side) if by else folds.join(cells, side)
    run = ordered.cumulate(pairs, [*by, "__own"], ["s", fold], {"hi": F.col("c")})
    total = run.groupBy(*by, "__own").agg(F.sum("c").alias("n"))
    counted = run.join(F.broadcast(total), [*by, "__own"])  # a row a fold
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    held = lambda k: F.max(F.when((F.col("hi") - F.col("c") <= k) & (k < F.col("hi")), F.col("s")))
    found = [F.struct(F.lit(s).alias("share"), (held(F.floor(a)) + (held(F.ceil(a)) - held(F.floor(a))) * F.max(a - F.floor(a))).alias("t")) for s, a in zip(shares, at, strict=True)]
    return counted.groupBy(*by, F.col("__own").alias(fold)).agg(F.array(*found).alias("x")).select(*by, fold, F.inline("x"))


def by_score(df: DataFrame, by: list[str], fold: str, score: str, shares: list[float], own: bool = False) -> DataFrame:
    """df once per share: the items at or below the threshold go (confidence, margin, agreement of a committee)."""
    return df.join(F.broadcast(share_thresholds(df, by, fold, score, shares, own)), [*by, fold]).withColumn("escalate", F.col(score) <= F.col("t")).drop("t")  # folds x shares rows


def by_class(df: DataFrame, by: list[str], fold: str, pred: str, conf: str, free_ok: str, llm_ok: str, item: str, shares: list[float]) -> DataFrame:
    """df once per share: classes by the expensive model's advantage on the other folds (positive ones alone), whole while
    the fold's budget lasts; of the class that doesn't fit the least confident items."""
    cube = df.groupBy(*by, fold, F.col(pred).alias("p")).agg(F.count("*").alias("n"), F.sum(free_ok).alias("f"), F.sum(llm_ok).alias("l"))
    every = Window.partitionBy(*by, "p")
    rest = {c: F.sum(c).over(every) - F.col(c) for c in ("n", "f", "l")}
    adv = cube.select(*by, fold, "p", "n", F.try_divide(rest["l"] - rest["f"], rest["n"]).alias("a"), F.sum("n").over(Window.partitionBy(*by, fold)).alias("total"))
    first = Window.partitionBy(*by, fold, "share").orderBy(F.desc("a"), "p").rowsBetween(Window.unboundedPreceding, -1)
    room = adv.where("a > 0").withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0)))
    take = room.select(*by, fold, F.col("p").alias(pred), "share", F.greatest(F.least(F.col("n"), F.floor(F.col("share") * F.col("total") - F.col("before"))), F.lit(0)).alias("take"))
    ranked = ordered.ranked(df, [*by, fold, pred], [conf, item], "__k").withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return ranked.join(F.broadcast(take), [*by, fold, pred, "share"], "left").withColumn("escalate", F.coalesce(F.col("__k") <= F.col("take"), F.lit(False))).drop("__k", "take")  # folds x classes x shares rows


def bin_of(conf: str) -> Column:
    return F.least(F.floor(F.col(conf) * BINS), F.lit(BINS - 1)).cast("int")


def reliability(df: DataFrame, by: list[str], fold: str, pred: str, conf: str, free_ok: str, prior: float = 20.0) -> DataFrame:
    """Per fold, class and bin of confidence: the cheap model's accuracy on the other folds, isotonic in confidence (the
    least mean of runs ending at or after the bin, over the greatest start), shrunk to that of all classes by `prior`
    pseudo-counts. Columns: fold, p, b, n (other folds' items), rel."""
    cube = df.groupBy(*by, fold, F.col(pred).alias("p"), bin_of(conf).alias("b")).agg(F.count("*").alias("n"), F.sum(free_ok).alias("f"))
    folds = cube.select(*by, F.col(fold).alias("__own")).distinct()
    pairs = cube.join(F.broadcast(folds), by) if by else cube.crossJoin(F.broadcast(folds))  # folds x folds x classes x bins rows
    others = pairs.where(F.col("__own") != F.col(fold)).groupBy(*by, "__own", "p", "b").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))

    def isotonic(cells: DataFrame, keys: list[str]) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        sums = cells.withColumn("cn", F.sum("n").over(upto)).withColumn("cf", F.sum("f").over(upto))
        start = sums.select(*keys, F.col("b").alias("a"), (F.col("cn") - F.col("n")).alias("n0"), (F.col("cf") - F.col("f")).alias("f0"))
        end = sums.select(*keys, F.col("b").alias("z"), F.col("cn").alias("n1"), F.col("cf").alias("f1"))
        runs = sums.select(*keys, "b").join(start, keys).where("a <= b").join(end, keys).where("z >= b")
        least = runs.groupBy(*keys, "b", "a").agg(F.min((F.col("f1") - F.col("f0")) / (F.col("n1") - F.col("n0"))).alias("m"))
        return least.groupBy(*keys, "b").agg(F.max("m").alias("rel"))

    keys = [*by, "__own"]
    pooled = isotonic(others.groupBy(*keys, "b").agg(F.sum("n").alias("n"), F.sum("f").alias("f")), keys).withColumnRenamed("rel", "all")
    own = others.join(isotonic(others, [*keys, "p"]), [*keys, "p", "b"])
    size = F.sum("n").over(Window.partitionBy(*keys, "p"))
    rel = own.withColumn("size", size).join(pooled, [*keys, "b"])
    return rel.select(*by, F.col("__own").alias(fold), "p", "b", "n", ((F.col("rel") * F.col("size") + F.col("all") * prior) / (F.col("size") + prior)).alias("rel"))


def by_class_confidence(df: DataFrame, by: list[str], fold: str, gold: str, pred: str, conf: str, free_ok: str, llm_ok: str, shares: list[float], prior: float = 20.0) -> DataFrame:
    """df once per share: bins of (class, confidence) in the order of their modelled value per call on the other folds,
    while the budget lasts. Value: the expensive model's shrunk accuracy on the class less the cheap one's reliability,
    times the class's mean weight 1 / (classes x items of the gold class)."""
    rel = reliability(df, by, fold, pred, conf, free_ok, prior)
    cube = df.groupBy(*by, fold, F.col(pred).alias("p"), F.col(gold).alias("g")).agg(F.count("*").alias("n"), F.sum(llm_ok).alias("l"))
    folds = cube.select(*by, F.col(fold).alias("__own")).distinct()
    pairs = cube.join(F.broadcast(folds), by) if by else cube.crossJoin(F.broadcast(folds))  # folds x folds x classes x classes rows
    others = pairs.where(F.col("__own") != F.col(fold)).groupBy(*by, "__own", "p", "g").agg(F.sum("n").alias("n"), F.sum("l").alias("l"))
    keys = [*by, "__own"]
    support = others.groupBy(*keys, "g").agg(F.sum("n").alias("t")).withColumn("w", 1 / (F.count("*").over(Window.partitionBy(*keys)) * F.col("t"))).drop("t")
    total = others.groupBy(*keys).agg(F.sum("n").alias("tn"), F.sum("l").alias("tl"))
    cls = others.join(support, [*keys, "g"]).groupBy(*keys, "p").agg(F.sum("n").alias("np"), F.sum("l").alias("lp"), (F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w")).join(total, keys)
    right = cls.select(*by, F.col("__own").alias(fold), "p", "w", "tn", ((F.col("lp") + prior * F.col("tl") / F.col("tn")) / (F.col("np") + prior)).alias("right"))
    value = rel.join(right, [*by, fold, "p"]).withColumn("value", F.round((F.col("right") - F.col("rel")) * F.col("w"), 15))
    upto = F.sum("n").over(Window.partitionBy(*by, fold, "share").orderBy(F.desc("value"), "p", "b").rowsBetween(Window.unboundedPreceding, 0))
    bought = value.where("value > 0").withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumn("upto", upto).where("upto <= share * tn")
    bought = bought.select(*by, fold, F.col("p").alias(pred), F.col("b").alias("__b"), "share", F.lit(True).alias("escalate"))
    items = df.withColumn("__b", bin_of(conf)).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return items.join(F.broadcast(bought), [*by, fold, pred, "__b", "share"], "left").withColumn("escalate", F.coalesce("escalate", F.lit(False))).drop("__b")  # folds x classes x bins x shares rows


def outcomes(df: DataFrame, by: list[str], gold: str, free_ok: str, llm_ok: str) -> DataFrame:
    """Balanced accuracy, accuracy and the expensive share of escalated items, by the given keys."""
    ok = F.when(F.col("escalate"), F.col(llm_ok)).otherwise(F.col(free_ok)).cast("double")
    per = df.withColumn("__ok", ok).groupBy(*by, gold).agg(F.avg("__ok").alias("r"), F.sum("__ok").alias("s"), F.count("*").alias("n"), F.sum(F.col("escalate").cast("long")).alias("e"))
    return per.groupBy(*by).agg(stats.mean(F.col("r")).alias("balanced_accuracy"), (F.sum("s") / F.sum("n")).alias("accuracy"), (F.sum("e") / F.sum("n")).alias("llm_share"))


def precision_margin(df: DataFrame, by: list[str], fold: str, pred: str, conf: str, free_ok: str, llm_pred: str, llm_ok: str, margins: list[float], least: int = 30) -> DataFrame:
    """df once per margin (column `share`): a class keeps what is at least as confident as the least confident point at
    which, on the other folds, its running precision is (1 - margin) times the expensive model's own precision on the class
    (of all its claims where it never makes this one), with the support. Classes without such a point go whole. The share
    of calls is what the promise costs."""
    folds = F.broadcast(df.select(*by, F.col(fold).alias("__own")).distinct())
    keys = [*by, "__own"]

    def others(cells: DataFrame) -> DataFrame:
        pairs = folds.join(cells, by) if by else folds.crossJoin(cells)
        return pairs.where(F.col("__own") != F.col(fold))

    points = others(df.groupBy(*by, fold, F.col(pred).alias("p"), F.col(conf).alias("t")).agg(F.count("*").alias("n"), F.sum(free_ok).alias("f")))
    run = ordered.cumulate(points, [*keys, "p"], [F.desc("t"), F.col(fold)], {"n": F.col("n"), "f": F.col("f")}).groupBy(*keys, "p", "t").agg(F.max("n").alias("n"), F.max("f").alias("f"))
    claims = others(df.groupBy(*by, fold, F.col(llm_pred).alias("p")).agg(F.count(F.col(llm_ok)).alias("n"), F.sum(llm_ok).alias("l")))  # unknown outcomes are no claims
    pooled = claims.groupBy(*keys).agg(F.try_divide(F.sum("l"), F.sum("n")).alias("all"))
    anchor = claims.groupBy(*keys, "p").agg(F.try_divide(F.sum("l"), F.sum("n")).alias("a"))
    known = run.join(F.broadcast(pooled), keys).join(F.broadcast(anchor), [*keys, "p"], "left")  # folds x classes rows
    clears = lambda m: (F.col("f") / F.col("n") >= (1 - m) * F.coalesce("a", "all")) & (F.col("n") >= least)
    floors = known.groupBy(*by, F.col("__own").alias(fold), F.col("p").alias(pred)).agg(F.array(*[F.struct(F.lit(m).alias("share"), F.min(F.when(clears(m), F.col("t"))).alias("__floor")) for m in margins]).alias("x")).select(*by, fold, pred, F.inline("x"))
    each = df.withColumn("share", F.explode(F.array(*[F.lit(m) for m in margins])))
    return each.join(F.broadcast(floors), [*by, fold, pred, "share"], "left").withColumn("escalate", F.coalesce(F.col(conf) < F.col("__floor"), F.lit(True))).drop("__floor")  # folds x classes x margins rows


#: Bins of the margin in which the router is fitted.
MARGIN_BINS = 10


def _logit(x: np.ndarray, n: np.ndarray, right: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model of right / n, by Newton's steps; the last column of x is the constant, not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(penalty), x.T @ (right - n * p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


def router_scores(df: DataFrame, by: list[str], fold: str, pred: str, conf: str, margin: str, free_ok: str, llm_ok: str, fits: Accumulator | None = None) -> DataFrame:
    """df with `router`: P(cheap right) - P(expensive right) by two logistic models of the other folds, on the predicted
    class, confidence and margin (low: the expensive model is the better bet). Items are counted in cells of class x bin x
    bin, so a fit reads a bounded table; each training part is fitted once, whatever the number of budgets. fits: counts
    them."""
    b = F.least(F.floor(F.col(margin) * MARGIN_BINS), F.lit(MARGIN_BINS - 1)).cast("int")
    placed = df.withColumn("__p", F.col(pred)).withColumn("__b", bin_of(conf)).withColumn("__m", b)
    cells = placed.groupBy(*by, fold, "__p", "__b", "__m").agg(F.count("*").alias("n"), F.sum(free_ok).alias("f"), F.sum(llm_ok).alias("l"))
    folds = F.broadcast(cells.select(*by, F.col(fold).alias("__own")).distinct())
    pairs = folds.join(cells, by) if by else folds.crossJoin(cells)
    keys = [*by, "__own"]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        classes = np.unique(part["__p"])
        x = np.column_stack([part["__p"].to_numpy()[:, None] == classes, (part["__b"] + 0.5) / BINS, (part["__m"] + 0.5) / MARGIN_BINS, np.ones(len(part))]).astype(float)
        train = (part[fold] != part["__own"]).to_numpy()
        n = part["n"].to_numpy(float)[train]
        chance = [1 / (1 + np.exp(-x @ _logit(x[train], n, part[c].to_numpy(float)[train]))) for c in ("f", "l")]
        if fits is not None:
            fits.add(1)
        return part[~train][[*keys, "__p", "__b", "__m"]].assign(router=np.round(chance[0] - chance[1], 12)[~train])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    scores = pairs.groupBy(*keys).applyInPandas(fit, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "__p", "__b", "__m"]) + ", router double")
    held = cut(scores, "router").withColumnRenamed("__own", fold)
    return placed.join(held, [*by, fold, "__p", "__b", "__m"]).drop("__p", "__b", "__m")


def conformal_scores(df: DataFrame, by: list[str], fold: str, proba: str, gold: str, conf: str, classes: int, alpha: float = 0.1) -> DataFrame:
    """df with `conformal`: low for items with large prediction sets, by confidence within a size."""
    sets = conformal.fold_sets(df, fold, proba, gold, alpha, classes, mondrian=True, by=tuple(by))
    return sets.withColumn("conformal", classes - F.size("pset") + F.col(conf)).drop("pset")


def _ends(df: DataFrame) -> DataFrame:
    """Nothing goes at a budget of 0, everything at 1."""
    return df.withColumn("escalate", F.when(F.col("share") <= 0, False).when(F.col("share") >= 1, True).otherwise(F.col("escalate")))


def search(df: DataFrame, fold: str, inner: str, gold: str, pred: str, llm_pred: str, conf: str, free_ok: str, llm_ok: str, item: str, shares: list[float], scores: tuple[str, ...] = (), own_scores: tuple[str, ...] = ()) -> DataFrame:
    """What every rule brings at every budget, on held-out items, as counts: outer, fold, rule, share, gold, n, right,
    called. outer -1: fold's items, by rules fitted on all other folds. outer o >= 0: the inner fold's items outside fold o,
    by rules fitted on the other inner folds outside o. Deferral curves and nested picks are sums of this one table.

    scores: further columns of which the lowest go first, with thresholds from the training part; own_scores: with
    thresholds from the scored part itself. Both may be made by staged(), as fitted scores must be."""
    rows = df if "outer" in df.columns else staged(df, fold, inner)
    by, at = ["outer"], "part"
    cell = lambda made: made.groupBy("outer", at, "rule", "share", gold).agg(F.count("*").alias("n"), F.sum(F.when(F.col("escalate"), F.col(llm_ok)).otherwise(F.col(free_ok))).alias("right"), F.sum(F.col("escalate").cast("long")).alias("called"))

    def scored(columns: tuple[str, ...], own: bool) -> DataFrame:
        long = rows.select("outer", at, gold, free_ok, llm_ok, F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("double").alias("score")) for c in columns])).alias("x")).select("outer", at, gold, free_ok, llm_ok, "x.*")
        return cell(_ends(by_score(long, ["outer", "rule"], at, "score", shares, own)))

    named = lambda made, rule: cell(made.withColumn("rule", F.lit(rule)))
    parts = [scored((conf, *scores), False)]
    if own_scores:
        parts.append(scored(own_scores, True))
    parts.append(named(_ends(by_class(rows, by, at, pred, conf, free_ok, llm_ok, item, shares)), "class_aware"))
    parts.append(named(_ends(by_class_confidence(rows, by, at, gold, pred, conf, free_ok, llm_ok, shares)), "per_class_conf"))
    parts.append(named(precision_margin(rows, by, at, pred, conf, free_ok, llm_pred, llm_ok, shares), "precision_floor"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(out.withColumn("rule", F.when(F.col("rule") == conf, "confidence").otherwise(F.col("rule"))), "search")


def staged(df: DataFrame, fold: str, inner: str) -> DataFrame:
    """df once for its fold (outer -1, part: the fold) and once for every other fold (outer: that fold, part: the inner
    fold), written once."""
    folds = df.select(F.col(fold).alias("outer")).distinct()
    nested = F.broadcast(folds).join(df, F.col("outer") != F.col(fold)).withColumn("part", F.col(inner))  # a copy a fold
    return cut(df.withColumn("outer", F.lit(-1)).withColumn("part", F.col(fold)).unionByName(nested), "staged")


def curve(cells: DataFrame, keys: list[str], gold: str) -> DataFrame:
    """Balanced accuracy, accuracy and the share of calls, from the counts of search()."""
    per = cells.groupBy(*keys, gold).agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("called").alias("called"))
    return per.groupBy(*keys).agg(stats.mean(F.col("right") / F.col("n")).alias("balanced_accuracy"), (F.sum("right") / F.sum("n")).alias("accuracy"), (F.sum("called") / F.sum("n")).alias("llm_share"))


def picks(cells: DataFrame, gold: str) -> DataFrame:
    """Per fold the (rule, share) with the best balanced accuracy of the inner cross-validation on the other folds (ties:
    the first rule by name, the smallest share), as part, rule, share, inner_score."""
    inner = curve(cells.where("outer >= 0"), ["outer", "rule", "share"], gold)
    return inner.groupBy("outer").agg(F.min(F.struct((-F.round("balanced_accuracy", 12)).alias("loss"), "rule", "share")).alias("x")).select(F.col("outer").alias("part"), "x.rule", "x.share", (-F.col("x.loss")).alias("inner_score"))


def nested_point(cells: DataFrame, gold: str) -> DataFrame:
    """What running the search brings on new data: each fold's pick on the fold's own items."""
    held = cells.where("outer = -1").join(F.broadcast(picks(cells, gold)), ["part", "rule", "share"])  # one row a fold
    return curve(held.withColumn("__one", F.lit(1)), ["__one"], gold).drop("__one")


def gains(points: DataFrame, rule: str = "confidence") -> DataFrame:
    """share and gain_per_tenth of the rule's points: what a further tenth of the traffic sent brings in balanced accuracy,
    from the point before (null for the first and where nothing more is sent)."""
    order = Window.partitionBy().orderBy("share")  # one row a budget
    own = points.where(F.col("rule") == rule)
    spent = F.col("llm_share") - F.lag("llm_share").over(order)
    gained = F.col("balanced_accuracy") - F.lag("balanced_accuracy").over(order)
    return own.select("share", "balanced_accuracy", "llm_share", F.when(spent > 1e-9, gained / spent * 0.1).alias("gain_per_tenth"))
