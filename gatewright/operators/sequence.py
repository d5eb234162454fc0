"""Turns of conversations: windows, recency, n-grams with backoff, first disclosures, skeletons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_window(df: DataFrame, conv: str, turn: str, first: int, last: int) -> DataFrame:
    """The first and last turns of each conversation, none of them twice."""
    w = Window.partitionBy(conv)
    x = df.withColumn("__a", F.row_number().over(w.orderBy(turn))).withColumn("__z", F.row_number().over(w.orderBy(F.desc(turn))))
    return x.where((F.col("__a") <= first) | (F.col("__z") <= last)).drop("__a", "__z")


def recency(df: DataFrame, conv: str, turn: str, most: int) -> DataFrame:
    """df with `bucket`: turns from the end, at most `most`."""
    return df.withColumn("bucket", F.least(F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn))) - 1, F.lit(most)))


def tagged_tokens(df: DataFrame, text: str, bucket: str, out: str = "tokens") -> DataFrame:
    """Tokens with their turn's age: rK_token."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return df.withColumn(out, F.transform(words, lambda t: F.concat(F.lit("r"), F.col(bucket).cast("string"), F.lit("_"), t)))


def contexts(df: DataFrame, conv: str, turn: str, text: str, k: int) -> DataFrame:
    """df with `context`: the last k earlier texts, oldest first; never the turn itself."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(-k, -1)
    return df.withColumn("context", F.collect_list(F.coalesce(text, F.lit(""))).over(before))


def history(df: DataFrame, conv: str, turn: str, label: str, order: int) -> DataFrame:
    """df with h1 .. h<order>: the labels before, nearest first."""
    w = Window.partitionBy(conv).orderBy(turn)
    for n in range(1, order + 1):
        df = df.withColumn(f"h{n}", F.lag(label, n).over(w))
    return df


def ngram_table(df: DataFrame, conv: str, turn: str, label: str, order: int) -> DataFrame:
    """For every context of 0 to `order` labels its most frequent next label (ties: lowest) and counts."""
    h = history(df, conv, turn, label, order)
    levels = [F.struct(F.lit(n).alias("n"), F.concat_ws(",", *[F.col(f"h{i}") for i in range(1, n + 1)]).alias("context")) for n in range(order + 1)]
    whole = [F.when(F.col(f"h{n}").isNotNull() if n else F.lit(True), levels[n]) for n in range(order + 1)]
    rows = h.select(F.explode(F.filter(F.array(*whole), lambda x: x.isNotNull())).alias("x"), F.col(label).alias("label")).select("x.*", "label")
    cells = rows.groupBy("n", "context", "label").agg(F.count("*").alias("c"))
    return cells.groupBy("n", "context").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("best"), F.sum("c").alias("total"))


def backoff(df: DataFrame, table: DataFrame, conv: str, turn: str, label: str, order: int) -> DataFrame:
    """df with `pred` and `used`: the best label of the longest seen context (true labels before)."""
    h = history(df, conv, turn, label, order)
    out = h
    for n in range(order + 1):
        side = table.where(F.col("n") == n).select(F.col("context").alias(f"__c{n}"), F.col("best").alias(f"__b{n}"))
        key = F.concat_ws(",", *[F.col(f"h{i}") for i in range(1, n + 1)])
        on = (key == F.col(f"__c{n}")) & (F.col(f"h{n}").isNotNull() if n else F.lit(True))
        out = out.join(side, on, "left")
    levels = range(order, -1, -1)
    out = out.withColumn("pred", F.coalesce(*[F.col(f"__b{n}") for n in levels])).withColumn("used", F.coalesce(*[F.when(F.col(f"__b{n}").isNotNull(), F.lit(n)) for n in levels]))
    return out.select(*df.columns, "pred", "used")


def sequence_head(df: DataFrame, train: Column, conv: str, turn: str, label: str, text: str, order: int) -> DataFrame:
    """conv, turn, pred, used, label_conf, said, text_conf of every row that isn't `train`: the label that most often follows
    the longest context of at most `order` true labels met in training, with its share there, and that label's most frequent
    training text, with its share (ties: the lowest label, the first text). Rows go to the tables of contexts once, with a
    key for each length of context; the longest that is found wins. Without training rows: nulls."""
    h = history(df, conv, turn, label, order).withColumn("__train", train)
    context = lambda n: F.struct(F.lit(n).alias("n"), F.concat_ws(",", *[F.col(f"h{i}") for i in range(1, n + 1)]).alias("context"))
    whole = [F.when(F.col(f"h{n}").isNotNull() if n else F.lit(True), context(n)) for n in range(order + 1)]
    keyed = F.explode(F.filter(F.array(*whole), lambda x: x.isNotNull())).alias("x")
    cells = h.where("__train").select(keyed, F.col(label).alias("l")).groupBy("x.n", "x.context", "l").agg(F.count("*").alias("c"))
    seen = cells.groupBy("n", "context").agg(F.max(F.struct("c", (-F.col("l")).alias("l"))).alias("b"), F.sum("c").alias("t")).select("n", "context", (-F.col("b.l")).alias("p"), (F.col("b.c") / F.col("t")).alias("share"))
    texts = h.where("__train").groupBy(F.col(label).alias("p"), F.col(text).alias("w")).agg(F.count("*").alias("c"))
    head = texts.groupBy("p").agg(F.min(F.struct((-F.col("c")).alias("c"), "w")).alias("b"), F.sum("c").alias("t")).select("p", F.col("b.w").alias("said"), (-F.col("b.c") / F.col("t")).alias("text_conf"))
    asked = h.where("not __train").select(conv, turn, keyed).select(conv, turn, "x.n", "x.context")
    found = asked.join(seen, ["n", "context"], "left").groupBy(conv, turn).agg(F.max(F.when(F.col("p").isNotNull(), F.struct("n", "p", "share"))).alias("b"))
    named = found.select(conv, turn, F.col("b.p").alias("p"), F.col("b.n").alias("used"), F.col("b.share").alias("label_conf"))
    return named.join(F.broadcast(head), "p", "left").select(conv, turn, F.col("p").alias("pred"), "used", "label_conf", "said", "text_conf")  # a row a label


def free_run(df: DataFrame, table: list[tuple[int, str, int]], conv: str, turn: str, label: str, order: int) -> DataFrame:
    """conv, turn, label, pred, where a prediction feeds the next contexts in place of the true label. Runs a
    conversation at a time, as each step needs the one before. table: rows (n, context, best), labels ** order at most."""
    best = {(n, c): b for n, c, b in table}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(turn, kind="stable")
        past: list[int] = []
        for _ in range(len(rows)):
            for n in range(min(order, len(past)), -1, -1):
                found = best.get((n, ",".join(str(x) for x in past[:n])))
                if found is not None:
                    break
            past.insert(0, found)
        return pd.DataFrame({conv: rows[conv], turn: rows[turn], label: rows[label], "pred": past[::-1]})

    slim = df.select(conv, turn, label)
    kinds = dict(slim.dtypes)
    return slim.groupBy(conv).applyInPandas(run, f"{conv} {kinds[conv]}, {turn} {kinds[turn]}, {label} {kinds[label]}, pred int")


def first_disclosure(values: DataFrame, turns: DataFrame, conv: str, turn: str, text: str, value: str) -> DataFrame:
    """Per (conversation, value) the first turn whose text holds the value between other than word characters."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.col(value), F.lit(r"\E(?![\p{L}\p{N}])"))
    return values.join(turns, conv).where(F.regexp_like(F.col(text), pattern)).groupBy(conv, value).agg(F.min(turn).alias("disclosed_at"))


def available(disclosed: DataFrame, turns: DataFrame, conv: str, turn: str, value: str) -> DataFrame:
    """Per turn the values disclosed strictly before it (a range join within the conversation)."""
    hit = turns.select(conv, turn).join(disclosed, conv, "left").where((F.col("disclosed_at") < F.col(turn)) | F.col("disclosed_at").isNull())
    held = hit.groupBy(conv, turn).agg(F.sort_array(F.collect_set(value)).alias("values"))
    return turns.select(conv, turn).join(held, [conv, turn], "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def skeletons(df: DataFrame, conv: str, turn: str, act: str) -> DataFrame:
    """Counts of ordered act sequences, numbered by count (descending), then sequence."""
    seq = df.groupBy(conv).agg(F.transform(F.sort_array(F.collect_list(F.struct(turn, act))), lambda x: x[act]).alias("skeleton"))
    counts = seq.groupBy("skeleton").agg(F.count("*").alias("n"))
    spelt = counts.withColumn("skeleton", F.array_join(F.transform("skeleton", lambda x: x.cast("string")), "-"))
    return spelt.withColumn("id", F.format_string("S%06d", F.row_number().over(Window.orderBy(F.desc("n"), "skeleton")) - 1))


def templates(df: DataFrame, by: list[str], text: str, example: str, least: int, most_examples: int) -> DataFrame:
    """Distinct texts per group with counts and the first example ids; the rare ones dropped. Examples are ranked before
    they are gathered, so a common text holds no more than it shows."""
    counts = df.groupBy(*by, text).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranked = df.select(*by, text, example).distinct().withColumn("__k", F.row_number().over(Window.partitionBy(*by, text).orderBy(example))).where(F.col("__k") <= most_examples)
    shown = ranked.groupBy(*by, text).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    same = [counts[c].eqNullSafe(shown[c]) for c in (*by, text)]
    return counts.join(shown, same).select(*[counts[c] for c in (*by, text)], "n", "examples")


def serialize(df: DataFrame, conv: str, turn: str, role: str, text: str, answer: str) -> DataFrame:
    """One row per turn of the answering role: the messages before it as an array, and the answer."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("messages", F.collect_list(F.struct(F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("content"))).over(before))
    return x.where(F.col(role) == answer).select(conv, turn, "messages", F.col(text).alias("answer"))
