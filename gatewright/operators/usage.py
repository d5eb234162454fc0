"""Usage analytics over a request log: users, quotas, days, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.operators import ordered


def totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("requests"), F.count_distinct("email").alias("users"), F.sum((F.col("status") == "error").cast("int")).alias("errors"), F.avg(F.when(F.col("status") == "ok", F.col("ms"))).alias("mean_ok_ms"))


def per_user(log: DataFrame, limits: DataFrame, default: int) -> DataFrame:
    """Requests, last seen, busiest day and the limit of every user."""
    days = log.groupBy("email", "day").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    own = days.groupBy("email").agg(F.sum("n").alias("requests"), F.max("last").alias("last_seen"), F.max("n").alias("busiest"))
    return own.join(limits, "email", "left").withColumn("daily_limit", F.coalesce("daily_limit", F.lit(default)))


def daily(log: DataFrame) -> DataFrame:
    """Requests, users and errors of every day from the first to the last, days without requests too."""
    own = log.groupBy("day").agg(F.count("*").alias("requests"), F.count_distinct("email").alias("users"), F.sum((F.col("status") == "error").cast("int")).alias("errors"))
    spine = log.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    zero = F.lit(0).cast("long")
    return spine.join(own, "day", "left").select("day", *[F.coalesce(c, zero).alias(c) for c in ("requests", "users", "errors")])


def trailing(log: DataFrame, days: int) -> DataFrame:
    """Requests of the last `days` days at each day."""
    d = daily(log).select("day", "requests")
    w = Window.orderBy("day").rowsBetween(1 - days, 0)  # one row a day
    return d.withColumn("trailing", F.sum("requests").over(w))


def quota(log: DataFrame, limit: int) -> DataFrame:
    """log with `taken` (place within the user's day) and `refused` (over the limit)."""
    place = F.row_number().over(Window.partitionBy("email", "day").orderBy("ts", "event_id"))
    return log.withColumn("taken", place).withColumn("refused", F.col("taken") > limit)


def tiers(log: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """Counts, errors and nearest-rank percentiles (index int(n * p)). Ranks come from ranges of the order, so a path with
    a third of all requests is in many tasks."""
    x = ordered.with_size(ordered.ranked(log, by, [value], "__k"), by, "__n")
    at = [F.max(F.when(F.col("__k") - 1 == F.least(F.floor(F.col("__n") * p), F.col("__n") - 1), F.col(value))).alias(f"p{round(100 * p)}") for p in points]
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("status") == "error").cast("int")).alias("errors"), *at)


def sessions(log: DataFrame, gap: str) -> DataFrame:
    return log.groupBy("email", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("email", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def budget(log: DataFrame, cost: str, cap: float) -> DataFrame:
    """log with `spent` within the day so far and `allowed`: not yet over the cap."""
    run = ordered.cumulate(log, ["day"], ["ts", "event_id"], {"spent": F.col(cost)})
    return run.withColumn("spent", F.round("spent", 6)).withColumn("allowed", F.col("spent") <= cap)


def overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of intervals (start, end) of a key that overlap."""
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))).select(F.col(f"x.{key}").alias(key), F.col("x.start").alias("a_start"), F.col("y.start").alias("b_start"))
