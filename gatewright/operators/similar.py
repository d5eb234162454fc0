"""Joins of sets and of weighted grams by similarity, through the rare tokens that a similar pair must share.

Tokens are put in one order over both sides, rarest first. A set is looked up by a prefix of that order alone, just long
enough that what is left can't reach the threshold without it; two similar sets share a token of both their prefixes. So
the joins are equi-joins on rare tokens: frequent tokens are compared for candidate pairs only, and no pair is made without
a shared prefix token. Equal sets are one class throughout, however many rows have them. Nulls and empty sets are similar to
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.sources.scratch import cut

#: Slack for comparisons of doubles with a threshold.
EPS = 1e-9


def _classes(df: DataFrame, by: list[str], tokens: str) -> DataFrame:
    """The distinct sets of every group: by, tokens (sorted), cls (their digest)."""
    return df.select(*by, F.array_sort(F.array_distinct(F.col(tokens))).alias("tokens")).where(F.size("tokens") > 0).withColumn("cls", F.md5(F.to_json("tokens"))).distinct()


def jaccard_pairs(left: DataFrame, right: DataFrame, by: list[str], tokens: str, least: float) -> DataFrame:
    """by, a, b, jaccard: the pairs of distinct token sets of one group (a of the left side, b of the right, as digests) with
    a Jaccard similarity of at least `least`, a number above 0. set_digest() gives the digest of a row's set."""
    x, y = (cut(_classes(df, by, tokens), "sets") for df in (left, right))
    count = x.unionByName(y).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # as many tokens as the smaller side may lack, and one more
    keep = F.col("size") - F.ceil(F.col("size") * least - EPS) + 1

    def prefixes(sets: DataFrame, name: str) -> DataFrame:
        each = sets.select(*by, "cls", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(count, "token")
        order = each.groupBy(*by, "cls", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
        first = order.select(*by, F.col("cls").alias(name), F.col("size").alias(f"{name}_size"), F.posexplode(F.transform(F.slice("t", 1, keep.cast("int")), lambda e: e["token"])).alias(f"{name}_at", "token"))
        return first

    p, q = prefixes(x, "a"), prefixes(y, "b")
    sizes = (F.col("b_size") >= F.col("a_size") * least - EPS) & (F.col("a_size") >= F.col("b_size") * least - EPS)
    # no token before the first shared one is shared: from there on the shorter rest must hold the overlap that is needed
    rest = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    enough = rest >= (F.col("a_size") + F.col("b_size")) * (least / (1 + least)) - EPS
    pairs = p.join(q, [*by, "token"]).where(sizes & enough).select(*by, "a", "b").distinct()
    named = lambda sets, name: sets.select(*by, F.col("cls").alias(name), F.col("tokens").alias(f"{name}_tokens"))
    both = pairs.join(named(x, "a"), [*by, "a"]).join(named(y, "b"), [*by, "b"])
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.withColumn("jaccard", shared / (F.size("a_tokens") + F.size("b_tokens") - shared)).where(F.col("jaccard") >= least - EPS).select(*by, "a", "b", "jaccard")


def set_digest(tokens: Column) -> Column:
    return F.md5(F.to_json(F.array_sort(F.array_distinct(tokens))))


def gram_weights(df: DataFrame, key: str, grams: Column) -> DataFrame:
    """key, gram, w: the grams' counts, scaled to length one."""
    counts = df.select(F.col(key), F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("c"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("norm"))
    return counts.join(norms, key).select(key, "gram", (F.col("c") / F.col("norm")).alias("w"))


def _prefix(weights: DataFrame, key: str, rarity: DataFrame, least: float) -> DataFrame:
    """The rarest grams of each key, until those left have a length below the threshold."""
    left = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key).orderBy(F.desc("n"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, 0))
    # `left` is the squared length of this gram and all commoner ones: below the threshold they are the rest
    return weights.join(rarity, "gram").withColumn("__left", left).where(F.col("__left") >= least * least - EPS).select(key, "gram")


def cosine_pairs(x: DataFrame, y: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """a, b, cosine: the pairs with a cosine of at least `least` (above 0). x, y: gram_weights() of both sides. Rows that
    come out of the join on grams are those of shared prefix grams alone: candidates() has them."""
    pairs = candidates(x, y, a, b, least).distinct()
    dots = pairs.join(x, a).join(y.withColumnRenamed("w", "w2"), [b, "gram"]).groupBy(a, b).agg(F.sum(F.col("w") * F.col("w2")).alias("cosine"))
    return dots.where(F.col("cosine") >= least - EPS)


def candidates(x: DataFrame, y: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """a, b once for every gram that the prefixes of both hold."""
    rarity = x.select("gram").unionByName(y.select("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return _prefix(x, a, rarity, least).join(_prefix(y, b, rarity, least), "gram").select(a, b)


def nearest(x: DataFrame, y: DataFrame, a: str, b: str, digits: int = 9, steps: tuple[float, ...] = (0.5, 0.25, 0.1)) -> DataFrame:
    """a, b, cosine: per key of x the key of y with the highest cosine, rounded (ties: the lowest b). Only keys that share a
    gram with some key of y come out. Keys without a partner at one threshold go on to the next lower one; what is left
    after the last is compared on all its grams."""
    left, found = cut(x, "grams"), None
    y = cut(y, "grams")
    top = lambda pairs: pairs.groupBy(a).agg(F.max(F.struct(F.round("cosine", digits).alias("c"), (-F.col(b)).alias("r"))).alias("x")).select(a, (-F.col("x.r")).alias(b), F.col("x.c").alias("cosine"))
    for least in steps:
        got = cut(top(cosine_pairs(left, y, a, b, least)), "nearest")
        found = got if found is None else found.unionByName(got)
        left = cut(left.join(got.select(a), a, "left_anti"), "grams")
        if left.isEmpty():
            return found
    rest = left.join(y.withColumnRenamed("w", "w2"), "gram").groupBy(a, b).agg(F.sum(F.col("w") * F.col("w2")).alias("cosine"))
    return found.unionByName(top(rest))
