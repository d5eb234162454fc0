"""Folds, samples and bootstraps drawn by digests of (seed, id): the same rows whatever the partitioning or engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.functions.stats import BOUNDS, normal_cdf, normal_quantile
from gatewright.operators import ordered
from gatewright.sources.fixtures import u


def derived_seed(*parts: str | int) -> Column:
    """The first 32 bits of the SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.lit(str(p)) for p in parts]), 256), 1, 8), 16, 10).cast("long")


def stratified_fold(df: DataFrame, stratum: str, item: str, k: int, seed: int) -> DataFrame:
    """df with `fold` 0 to k - 1, each stratum dealt evenly."""
    order = Window.partitionBy(stratum).orderBy(u(seed, item), item)
    return df.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def grouped_fold(df: DataFrame, group: str, label: str, k: int, seed: int) -> DataFrame:
    """df with `fold`: rows of a group share one, groups are dealt evenly within their majority label (ties: lowest)."""
    votes = df.groupBy(group, label).agg(F.count("*").alias("__n"))
    majority = votes.groupBy(group).agg(F.max(F.struct("__n", (-F.col(label)).alias("l"))).alias("x")).select(group, (-F.col("x.l")).alias("__y"))
    dealt = stratified_fold(majority, "__y", group, k, seed).select(group, "fold")
    return df.join(dealt, group)


def leaks(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups whose rows are in more than one fold."""
    return df.groupBy(group).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi")).where("lo <> hi")


def stratified_take(df: DataFrame, stratum: str, item: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (or all): each stratum its share by largest remainders (ties: lowest stratum)."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__c"))
    every = Window.partitionBy()  # one row a stratum
    quota = sizes.withColumn("__q", F.least(F.lit(n), F.sum("__c").over(every)) * F.col("__c") / F.sum("__c").over(every))
    quota = quota.withColumn("__b", F.floor("__q").cast("long")).withColumn("__left", F.least(F.lit(n), F.sum("__c").over(every)) - F.sum("__b").over(every))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round(F.col("__q") - F.col("__b"), 9)), stratum))
    quota = quota.select(stratum, (F.col("__b") + (place <= F.col("__left")).cast("long")).alias("__take"))
    placed = ordered.ranked(df, [stratum], [u(seed, item), F.col(item)], "__k")
    return placed.join(F.broadcast(quota), stratum).where("__k <= __take").drop("__k", "__take")  # a row a stratum


def group_prefix(df: DataFrame, group: str, limit: int, seed: int) -> DataFrame:
    """Whole groups in random order until they hold `limit` rows at least."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__c"))
    upto = ordered.cumulate(sizes, [], [u(seed, group), F.col(group)], {"__upto": F.col("__c")})
    return df.join(upto.where(F.col("__upto") - F.col("__c") < limit).select(group), group, "left_semi")


def learning_subset(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """Rows of a share of groups; smaller fractions give subsets of larger ones."""
    return df.where(u(seed, group) < fraction)


def stride(df: DataFrame, order: str, cap: int) -> DataFrame:
    """The rows at floor(i * n / cap) in order, i < cap; all of them if there are no more or cap is 0."""
    placed = ordered.with_size(ordered.ranked(df, [], [order], "__k"), [], "__n")
    k, n, c = F.col("__k") - 1, F.col("__n"), F.lit(max(cap, 1))
    first = F.ceil(k * c / n)  # the smallest i whose floor(i * n / cap) can be k
    return placed.where((F.lit(cap) == 0) | (n <= c) | ((first < c) & (F.floor(first * n / c) == k))).drop("__k", "__n")


def replicate_weights(df: DataFrame, item: str, replicates: int, seed: int) -> DataFrame:
    """Every row once per replicate with a Poisson(1) weight `w` (inverted from one uniform; at most 7)."""
    x = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("__u", u(seed, "replicate", item))
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(7):
        total += p
        cuts.append(total)
        p /= k + 1
    w = F.lit(0)
    for c in cuts:
        w = w + (F.col("__u") >= c).cast("int")
    return x.withColumn("w", w).drop("__u")


def bootstrap_mean(df: DataFrame, by: list[str], item: str, value: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """Mean with percentile bounds over replicates. Sums per replicate are combined map-side: what is shuffled is
    replicates x groups rows."""
    r = replicate_weights(df, item, replicates, seed).groupBy(*by, "replicate").agg(F.try_divide(F.sum(F.col("w") * F.col(value).cast("double")), F.sum("w")).alias("m"))
    bounds = r.groupBy(*by).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_le_0"))
    mean = df.groupBy(*by).agg(F.avg(F.col(value).cast("double")).alias("mean"))
    return mean.join(bounds, by) if by else mean.crossJoin(bounds)  # one row each


def bca_mean(df: DataFrame, item: str, value: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """Mean with bias-corrected and accelerated bounds: the quantiles of the replicates are moved by the share of
    replicates below the mean and by the skewness of the jackknife means, which for a mean is that of the values. The
    replicates x 1 means and three moments come to the driver's plan, no item does."""
    x = df.select(item, F.col(value).cast("double").alias("v"))
    means = replicate_weights(x, item, replicates, seed).groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    mean = x.agg(F.avg("v").alias("mean"))
    moments = x.crossJoin(F.broadcast(mean)).agg(F.first("mean").alias("mean"), F.sum(F.pow(F.col("mean") - F.col("v"), F.lit(2))).alias("s2"), F.sum(F.pow(F.col("v") - F.col("mean"), F.lit(3))).alias("s3"))  # one row
    held = means.agg(F.sort_array(F.collect_list("m")).alias("ms")).crossJoin(moments)  # `replicates` numbers

    @F.pandas_udf(BOUNDS)
    def bounds(ms: pd.Series, mean: pd.Series, s2: pd.Series, s3: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bca_bounds(list(a), b, c, d, level) for a, b, c, d in zip(ms, mean, s2, s3, strict=True)], columns=["low", "high"])

    return held.select("mean", bounds("ms", "mean", "s2", "s3").alias("b")).select("mean", "b.*")


def bca_bounds(ms: list[float], mean: float, s2: float, s3: float, level: float) -> tuple[float, float]:
    """Bounds from sorted replicates; without spread, or with all replicates on one side, the plain percentiles."""
    below = (sum(m < mean for m in ms) + 0.5 * sum(m == mean for m in ms)) / len(ms)
    a = s3 / (6 * s2**1.5) if s2 > 0 else 0.0
    z0 = normal_quantile(below) if 0 < below < 1 else 0.0

    def at(p: float) -> float:
        z = z0 + normal_quantile(p)
        q = normal_cdf(z0 + z / (1 - a * z)) * (len(ms) - 1)
        k = min(int(q), len(ms) - 2) if len(ms) > 1 else 0
        return ms[k] + (ms[min(k + 1, len(ms) - 1)] - ms[k]) * (q - k)

    return at((1 - level) / 2), at((1 + level) / 2)


def cluster_bootstrap(df: DataFrame, cluster: str, num: str, den: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """Ratio of sums with bounds, whole clusters drawn."""
    sums = df.groupBy(cluster).agg(F.sum(F.col(num).cast("double")).alias("a"), F.sum(F.col(den).cast("double")).alias("b"))
    r = replicate_weights(sums, cluster, replicates, seed).groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("a")), F.sum(F.col("w") * F.col("b"))).alias("m"))
    bounds = r.agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    return sums.agg((F.sum("a") / F.sum("b")).alias("ratio"), F.count("*").alias("clusters")).crossJoin(bounds)  # one row each


def design_sample(df: DataFrame, stratum: str, item: str, n: int, seed: int) -> DataFrame:
    """n rows round robin over strata with design weights N_h / n_h."""
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(stratum).orderBy(u(seed, item), item))).withColumn("__N", F.count("*").over(Window.partitionBy(stratum)))
    taken = ranked.orderBy("__k", stratum, item).limit(n)
    return taken.withColumn("weight", F.col("__N") / F.count("*").over(Window.partitionBy(stratum))).drop("__k", "__N")
