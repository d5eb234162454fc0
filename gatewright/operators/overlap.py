"""Overlap between splits and duplicates within them: semi- and anti-joins on exact or normalised keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case, letters and digits kept, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def leaked(test: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Test rows whose keys occur in train. Keys are hashed to a digest before the shuffle when they are texts."""
    return test.join(train.select(*keys).distinct(), keys, "left_semi")


def leak_report(test: DataFrame, train: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Per group of test rows: rows, leaked rows and their share."""
    mark = train.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return test.join(mark, keys, "left").groupBy(*by).agg(F.count("*").alias("n"), F.count("__hit").alias("leaked"), (F.count("__hit") / F.count("*")).alias("share"))


def label_agreement(test: DataFrame, train: DataFrame, by: list[str], key: str, label: str, position: str) -> DataFrame:
    """Per group: leaked test rows and the share whose label equals the last train label of the key."""
    last = train.groupBy(*by, key).agg(F.max_by(label, position).alias("__label"))
    hit = test.join(last, [*by, key])
    return hit.groupBy(*by).agg(F.count("*").alias("leaked"), F.avg((F.col(label) == F.col("__label")).cast("double")).alias("agree"))


def duplicate_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with several rows: copies, distinct labels, and the best share that one label per key can reach."""
    cells = df.groupBy(key, label).agg(F.count("*").alias("c"))
    return cells.groupBy(key).agg(F.sum("c").alias("copies"), F.count("*").alias("labels"), F.max("c").alias("majority")).where("copies > 1")


def copies_histogram(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("keys"))


def clean_split(train: DataFrame, test: DataFrame, key: str, order: str) -> DataFrame:
    """Train rows, the first of each key, whose key isn't in test."""
    first = train.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__k = 1").drop("__k")
    return first.join(test.select(key).distinct(), key, "left_anti")


def alignment(df: DataFrame, item: str, part: str, place: str) -> DataFrame:
    """Items that stand in more than one part: the parts, and in how many places."""
    return df.groupBy(item).agg(F.count_distinct(part).alias("parts"), F.count_distinct(place).alias("places")).where("parts > 1")


def shared_in_all(df: DataFrame, item: str, arm: str) -> DataFrame:
    """Items that occur in every arm."""
    arms = df.select(arm).distinct().agg(F.count("*").alias("__n"))
    own = df.groupBy(item).agg(F.count_distinct(arm).alias("__c"))
    return own.join(F.broadcast(arms), F.col("__c") == F.col("__n")).select(item)  # one row


def ngram_overlap(queries: DataFrame, corpus: DataFrame, q: str, c: str, text: str, n: int = 8) -> DataFrame:
    """Pairs (query, corpus row) that share an n-gram of words, with the share of the query's n-grams. The query side
    is stated and small; n-grams that no query has are dropped before anything is grouped."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        # a column of its own, so that a text is normalised once and not for each of its n-grams
        words = df.select(F.col(key), F.split(normalized(F.col(text)), " ").alias("w"))
        each = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.md5(F.array_join(F.slice("w", i, F.lit(n)), " "))))
        return words.select(F.col(key), F.explode(each).alias("gram"))

    own = grams(queries, q).distinct()
    size = own.groupBy(q).agg(F.count("*").alias("__size"))
    hit = own.join(grams(corpus, c), "gram").distinct().groupBy(q, c).agg(F.count("*").alias("shared"))
    return hit.join(size, q).select(q, c, "shared", (F.col("shared") / F.col("__size")).alias("share"))


def containing(df: DataFrame, items: DataFrame, key: str, text: str, item: str, needle: str, n: int = 5) -> DataFrame:
    """Pairs (key, item) of the rows whose whole text contains the whole needle as it stands. Candidates come from an
    equi-join on one inner n-gram of the needle's words (its first and last word may be parts of longer ones); needles of
    under n + 2 words, which have none, are tested one by one against all rows."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    q = items.select(F.col(item).alias("__i"), F.col(needle).alias("__t"), words(F.col(needle)).alias("w"))
    long = q.where(F.size("w") >= n + 2).select("__i", "__t", F.xxhash64(F.array_join(F.slice("w", 2, n), " ")).alias("__g"))
    rows = df.select(F.col(key).alias("__k"), F.col(text).alias("__x"))
    held = rows.select("__k", words(F.col("__x")).alias("w"))
    grams = held.select("__k", F.explode(F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " "))))).alias("__g"))
    pairs = grams.join(long, "__g").select("__k", "__i", "__t").distinct()
    found = rows.join(pairs, "__k").where(F.contains("__x", "__t")).select("__k", "__i").distinct()
    short = q.where(F.size("w") < n + 2)
    direct = rows.join(short, F.contains("__x", "__t")).select("__k", "__i")
    return found.unionByName(direct).select(F.col("__k").alias(key), F.col("__i").alias(item))
