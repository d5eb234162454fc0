"""Split-conformal prediction sets. proba: arrays of class probabilities in class order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.operators import ordered
from gatewright.sources.scratch import cut


def nonconformity(proba: str, gold: str) -> Column:
    """1 - probability of the gold class (null for a class below 0)."""
    return F.when(F.col(gold) >= 0, 1 - F.element_at(proba, F.col(gold) + 1))


def thresholds(scores: DataFrame, by: list[str], score: str, alpha: float, overflow: str = "inf") -> DataFrame:
    """Per group the k-th smallest score, k = ceil((n + 1)(1 - alpha)) in exact arithmetic. Where k > n: infinity, or
    the largest score (overflow `max`)."""
    if overflow not in ("inf", "max"):
        raise ValueError(overflow)
    ranked = ordered.with_size(ordered.ranked(scores.where(F.col(score).isNotNull()).select(*by, score), by, [score], "__k"), by, "__n")
    want = F.ceil((F.col("__n") + 1).cast("decimal(20,0)") * F.lit(str(1 - alpha)).cast("decimal(12,10)").cast("decimal(12,6)"))
    at = F.least(want, F.col("__n")) if overflow == "max" else want
    out = ranked.groupBy(*by).agg(F.max(F.when(F.col("__k") == at, F.col(score))).alias("threshold"), F.max("__n").alias("n"))
    return out.withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))


#: Steps of the scores' range 0 to 1 in which they are counted first (scores outside count with the ends).
STEPS = 4096


def other_thresholds(scores: DataFrame, folds: DataFrame, by: list[str], fold: str, score: str, alpha: float) -> DataFrame:
    """thresholds() of each group and fold (`__own`) over the scores of the group's other folds. folds: the groups' keys,
    or some of them, and __own. Scores are counted in steps, which says in what step the wanted one lies; only the scores
    of those steps are put in order, so no row is copied for every fold. What is counted: groups x folds x STEPS rows."""
    step = F.floor(F.least(F.greatest(F.col(score) * STEPS, F.lit(0.0)), F.lit(STEPS - 1.0)))
    held = scores.where(F.col(score).isNotNull()).select(*by, fold, F.col(score).alias("__s"), step.alias("__step"))
    base, keys = [c for c in folds.columns if c != "__own"], [*by, "__own"]
    cells = held.groupBy(*by, fold, "__step").agg(F.count("*").alias("c"))
    pairs = (F.broadcast(folds).join(cells, base) if base else cells.crossJoin(F.broadcast(folds))).where(F.col("__own") != F.col(fold))
    every = Window.partitionBy(*keys)
    upto = F.sum("c").over(every.orderBy("__step").rowsBetween(Window.unboundedPreceding, 0))
    run = pairs.groupBy(*keys, "__step").agg(F.sum("c").alias("c")).withColumn("n", F.sum("c").over(every)).withColumn("before", upto - F.col("c"))
    want = F.ceil((F.col("n") + 1).cast("decimal(20,0)") * F.lit(str(1 - alpha)).cast("decimal(12,10)").cast("decimal(12,6)"))
    run = cut(run.withColumn("k", want - F.col("before")), "steps")
    at = run.where((F.col("k") > 0) & (F.col("k") <= F.col("c"))).select(*keys, "__step", "k")
    near = held.join(F.broadcast(at), [*by, "__step"]).where(F.col("__own") != F.col(fold)).groupBy(*keys, "k", "__s").agg(F.count("*").alias("c"))  # groups x folds rows
    found = ordered.cumulate(near, keys, ["__s"], {"hi": F.col("c")}).where((F.col("k") <= F.col("hi")) & (F.col("k") > F.col("hi") - F.col("c"))).select(*keys, F.col("__s").alias("threshold"))
    total = run.groupBy(*keys).agg(F.max("n").alias("n"))
    return total.join(found, keys, "left").select(*keys, F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"), "n")


def prediction_set(proba: Column, threshold: Column, empty: str = "argmax", eps: float = 1e-12) -> Column:
    """Classes with 1 - p <= threshold; an empty set stays empty or becomes the most probable class (ties: lowest)."""
    inside = F.filter(F.transform(proba, lambda p, i: F.when(1 - p <= threshold + eps, i)), lambda i: i.isNotNull())
    if empty == "allow":
        return inside
    return F.when(F.size(inside) > 0, inside).otherwise(F.array((F.array_position(proba, F.array_max(proba)) - 1).cast("int")))


def class_sets(proba: Column, per_class: Column, eps: float = 1e-12) -> Column:
    """Mondrian sets: each class against the threshold of its own (array in class order); may be empty."""
    return F.filter(F.transform(proba, lambda p, i: F.when(1 - p <= F.element_at(per_class, i + 1) + eps, i)), lambda i: i.isNotNull())


def fold_sets(df: DataFrame, fold: str, proba: str, gold: str, alpha: float, classes: int, mondrian: bool = False, empty: str = "argmax", least: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `pset`, every fold's thresholds from the other folds (of the same values of `by`). Mondrian: per gold class, with the pooled threshold
    for classes of fewer than `least` scores. Thresholds: folds x classes rows."""
    scores = cut(df.select(*by, fold, gold, nonconformity(proba, gold).alias("__s")), "scores")
    folds = scores.select(*by, F.col(fold).alias("__own")).distinct()
    keys = [*by, "__own"]
    pooled = other_thresholds(scores, folds, list(by), fold, "__s", alpha).select(*keys, F.col("threshold").alias("__t"))
    if mondrian:
        own = other_thresholds(scores, folds, [*by, gold], fold, "__s", alpha).where(F.col("n") >= least).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(gold, "threshold"))).alias("__m"))
        pooled = pooled.join(own, keys, "left")
        every = F.sequence(F.lit(0), F.lit(classes - 1))
        pooled = pooled.withColumn("__a", F.transform(every, lambda c: F.coalesce(F.element_at(F.coalesce("__m", F.create_map().cast("map<int,double>")), c), F.col("__t")))).drop("__m")
    joined = df.join(F.broadcast(pooled.withColumnRenamed("__own", fold)), [*by, fold])
    pset = class_sets(F.col(proba), F.col("__a")) if mondrian else prediction_set(F.col(proba), F.col("__t"), empty)
    return joined.withColumn("pset", pset).drop("__t", "__a")


def evaluate_sets(df: DataFrame, by: list[str], gold: str, pset: str = "pset") -> DataFrame:
    covered = F.array_contains(pset, F.col(gold).cast("int")).cast("double")
    single = F.size(pset) == 1
    return df.groupBy(*by).agg(F.avg(covered).alias("coverage"), F.avg(F.size(pset)).alias("set_size"), F.avg(single.cast("double")).alias("kept"), F.avg(F.when(single, covered)).alias("kept_accuracy"), F.avg((F.size(pset) == 0).cast("double")).alias("empty"))
