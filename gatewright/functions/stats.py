"""Intervals, paired tests and costs as column expressions; what needs root finding as Arrow UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection: exact to double precision, and no table is needed."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


#: Two-sided 95 % and one-sided 95 %.
Z95, Z90 = normal_quantile(0.975), normal_quantile(0.95)


def mean(x: Column) -> Column:
    """The mean of a group's numbers below ten thousand million, right in its last bit whatever the order of the rows: they
    are summed as decimals of 28 places."""
    exact = x.cast("decimal(38, 28)")
    return F.try_divide(F.sum(exact).cast("double"), F.count(exact))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's interval; null without trials."""
    p = F.when(n > 0, k / n)
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest((centre - spread) / (1 + z * z / n), F.lit(0.0)), F.least((centre + spread) / (1 + z * z / n), F.lit(1.0))


def binomial_tail(k: Column, n: Column) -> tuple[Column, Column]:
    """P(X <= k) and P(X = k) for n fair coin flips. Log binomials are sums of logarithms over a sequence of n."""
    steps = F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))
    logs = lambda m: F.aggregate(F.filter(steps, lambda i: i <= m), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    total = logs(n)
    pmf = lambda j: F.exp(total - logs(j) - logs(n - j) - n * math.log(2))
    upto = F.aggregate(F.transform(F.sequence(F.lit(0), k.cast("int")), lambda j: pmf(j)), F.lit(0.0), lambda s, x: s + x)
    return upto, pmf(k)


def mcnemar(b: Column, c: Column, method: str) -> Column:
    """Two-sided p of discordant counts b and c: `exact`, `midp` or `chi2` (with continuity correction); 1 without
    discordant pairs."""
    n, k = b + c, F.least(b, c)
    if method == "chi2":
        stat = F.greatest(F.abs(b - c) - 1, F.lit(0)) / F.sqrt(n.cast("double"))
        p = 2 * (1 - normal_cdf_column(stat))
    else:
        upto, at = binomial_tail(k, n)
        p = 2 * upto if method == "exact" else 2 * upto - at
    return F.when(n == 0, 1.0).otherwise(F.least(p, F.lit(1.0)))


def normal_cdf_column(x: Column) -> Column:
    """Series of the normal distribution around 0 (60 terms; |x| up to 8)."""
    x = F.greatest(F.least(x, F.lit(8.0)), F.lit(-8.0))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(x.alias("t"), x.alias("s")), lambda a, i: F.struct((a["t"] * x * x / (2 * i + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * i + 1)).alias("s")))["s"]
    return 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * terms


def adjust(df: DataFrame, p: str, by: list[str], method: str, alpha: float = 0.05, order: str | None = None) -> DataFrame:
    """df with `p_adj` and `reject` within groups: `holm` (step-down) or `bh` (Benjamini and Hochberg)."""
    ties = [p, *([order] if order else [])]
    ranked = Window.partitionBy(*by).orderBy(*ties)
    every = Window.partitionBy(*by)
    out = df.withColumn("__r", F.row_number().over(ranked)).withColumn("__m", F.count("*").over(every))
    if method == "holm":
        running = F.max(F.least(F.col(p) * (F.col("__m") - F.col("__r") + 1), F.lit(1.0))).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bh":
        running = F.min(F.least(F.col(p) * F.col("__m") / F.col("__r"), F.lit(1.0))).over(Window.partitionBy(*by).orderBy(F.desc(p), *([F.desc(order)] if order else [])).rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(method)
    return out.withColumn("p_adj", running).withColumn("reject", F.col("p_adj") <= alpha).drop("__r", "__m")


def holm_steps(df: DataFrame, p: str, by: list[str], alpha: float = 0.05, order: str | None = None) -> DataFrame:
    """df with `rejected`: p values in order until the first that is over alpha / (tests left)."""
    ranked = Window.partitionBy(*by).orderBy(p, *([order] if order else []))
    out = df.withColumn("__r", F.row_number().over(ranked)).withColumn("__m", F.count("*").over(Window.partitionBy(*by)))
    good = F.col(p) <= alpha / (F.col("__m") - F.col("__r") + 1)
    return out.withColumn("rejected", F.min(good.cast("int")).over(ranked.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("__r", "__m")


def sample_size_ni(disagreement: Column, margin: Column, alpha: float = 0.05, power: float = 0.8, true_delta: float = 0.0) -> Column:
    """Pairs that a non-inferiority test of a margin needs."""
    z = normal_quantile(1 - alpha) + normal_quantile(power)
    return F.ceil(z * z * (disagreement - true_delta * true_delta) / ((margin + true_delta) * (margin + true_delta))).cast("long")


def min_detectable(n: Column, disagreement: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    return z * F.sqrt(disagreement / n)


def call_cost(in_tokens: Column, out_tokens: Column, cached: Column, price_in: Column, price_out: Column, price_cached: Column) -> Column:
    """USD of a call at USD per million tokens; cached tokens at their own rate, or at the full one if there is none."""
    return ((in_tokens - cached) * price_in + cached * F.coalesce(price_cached, price_in) + out_tokens * price_out) / 1e6


#: Built from types, as a worker process that imports this module has no session to read a schema string with.
BOUNDS = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


def _bisect(f, lo: float, hi: float) -> float:
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def _binomial_upto(k: int, n: int, p: float) -> float:
    if k >= n:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    if p <= 0:
        return 1.0
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))


def clopper_pearson_bounds(k: int, n: int, conf: float = 0.95) -> tuple[float, float]:
    a = (1 - conf) / 2
    low = 0.0 if k == 0 else _bisect(lambda p: a - (1 - _binomial_upto(k - 1, n, p)), 0.0, 1.0)
    high = 1.0 if k == n else _bisect(lambda p: _binomial_upto(k, n, p) - a, 0.0, 1.0)
    return low, high


@F.pandas_udf(BOUNDS)
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson_bounds(int(a), int(b)) if b else (None, None) for a, b in zip(k, n, strict=True)], columns=["low", "high"])


def tango_bounds(b: int, c: int, n: int, z: float) -> tuple[float, float]:
    """Score interval of the difference (b - c) / n of paired proportions, by bisection on the score statistic."""

    def score(d: float) -> float:
        p = 2 * n
        q = -b - c + (2 * n - b + c) * d
        r = -c * d * (1 - d)
        p21 = (math.sqrt(max(q * q - 4 * p * r, 0.0)) - q) / (2 * p)
        var = n * (2 * p21 + d * (1 - d))
        return (b - c - n * d) / math.sqrt(var) if var > 1e-12 else math.copysign(math.inf, b - c - n * d) if b - c != n * d else 0.0

    at = (b - c) / n
    low = _bisect(lambda d: score(d) - z, -1.0 + 1e-12, at) if at > -1 else -1.0
    high = _bisect(lambda d: score(d) + z, at, 1.0 - 1e-12) if at < 1 else 1.0
    return low, high


@F.pandas_udf(BOUNDS)
def tango(b: pd.Series, c: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tango_bounds(int(x), int(y), int(m), Z95) for x, y, m in zip(b, c, n, strict=True)], columns=["low", "high"])
