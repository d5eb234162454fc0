"""Running totals, ranks and sliding frames in an order, for groups of any size.

A window over a key of a few values puts each value's rows into one task. Here rows are dealt to ranges of the order (a
large group lies in many), each range is summed on its own, and what stands before a range in its group is added: the
table of range totals has a row for each range and each group that begins in it. The dealt rows are written first, as
ranges are sampled and a second reading could deal them otherwise.

Rows that are equal in all of `order` are in some order of their own; give a column that tells them apart where it matters.
Null keys are one group, null values come first (last where the order descends). Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.sources.scratch import cut


def cumulate(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name of `sums`, the sum of its expression over the row and all rows before it in its group."""
    ways = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(*by) if by else F.lit(0)
    valued = df.withColumns({f"__v{i}": v for i, v in enumerate(sums.values())})
    dealt = cut(valued.repartitionByRange(parts, *[F.col(b) for b in by], *ways).withColumn("__part", F.spark_partition_id()).withColumn("__group", group), "ranges")
    total = dealt.groupBy("__part", "__group").agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(sums))])
    earlier = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select("__part", "__group", *[F.sum(f"__t{i}").over(earlier).alias(f"__b{i}") for i in range(len(sums))])
    upto = Window.partitionBy("__part", "__group").orderBy(*ways).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({f"__c{i}": F.sum(f"__v{i}").over(upto) for i in range(len(sums))})
    zero = F.lit(0)
    added = {name: F.coalesce(f"__c{i}", zero) + F.coalesce(f"__b{i}", zero) for i, name in enumerate(sums)}
    return own.join(before, ["__part", "__group"]).select(*[c for c in df.columns if c not in added], *[v.alias(n) for n, v in added.items()])


def ranked(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df with the row's place in its group, from 1."""
    return cumulate(df, by, order, {name: F.lit(1).cast("long")})


def with_size(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with the number of rows of its group, of groups that are few (a broadcast table with a row for each)."""
    n = df.groupBy(*by).agg(F.count("*").alias(name))
    if not by:
        return df.crossJoin(F.broadcast(n))  # one row
    keyed = n.select(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], name)
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(f"__by{i}").eqNullSafe(F.col(b))
    return df.join(F.broadcast(keyed), same).drop(*[f"__by{i}" for i in range(len(by))])


def sliding(df: DataFrame, by: list[str], order: list[Column | str], rows: int, values: dict[str, Column], block: int = 1 << 20) -> DataFrame:
    """df with aggregates (written as for a group) over the row and the `rows` - 1 rows before it in its group. Places are
    cut into blocks; the rows that a block's first frames reach back to are sent to it as well."""
    block = max(block, rows)
    placed = ranked(df, by, order, "__place").withColumn("__block", F.expr(f"(__place - 1) div {block}"))
    reach = F.col("__place") - 1 - F.col("__block") * block >= block - (rows - 1)
    both = placed.withColumn("__own", F.lit(True)).unionByName(placed.where(reach).withColumn("__block", F.col("__block") + 1).withColumn("__own", F.lit(False)))
    frame = Window.partitionBy(*by, "__block").orderBy("__place").rowsBetween(1 - rows, 0)
    return both.withColumns({n: v.over(frame) for n, v in values.items()}).where("__own").drop("__place", "__block", "__own")
