"""Derived inputs: deterministic views over the given tables, the same in Spark and in SQL.

The expensive model's and the cheap model's predictions are simulated by hashes: they stand for logs that a user would
read from a table and are no measured model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLASSES, FOLDS, REPEATS = 10, 5, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u(seed: int, *ids: str | Column) -> Column:
    """A uniform number in [0, 1) from the digest of seed and ids."""
    spelt = F.concat_ws("|", F.lit(str(seed)), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids])
    return F.conv(F.substring(F.md5(spelt), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def u_sql(seed: int, *ids: str) -> str:
    spelt = " || '|' || ".join([f"'{seed}'", *[f"({i})::VARCHAR" for i in ids]])
    return f"(('0x' || substr(md5({spelt}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, gold, fold: every item in one fold, classes spread evenly."""
    order = Window.partitionBy("gold").orderBy(F.md5(F.concat_ws("|", F.lit("7"), F.col("item_id").cast("string"))), "item_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("gold"))
    return e.withColumn("fold", ((F.row_number().over(order) - 1) % FOLDS).cast("int"))


ITEMS_SQL = f"""SELECT vec_id AS item_id, label AS gold,
  ((row_number() OVER (PARTITION BY label ORDER BY md5('7|' || vec_id::VARCHAR), vec_id) - 1) % {FOLDS})::INT AS fold FROM embeddings"""


def pair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items with free_pred, free_conf, llm_pred, tokens, cost_usd, latency_s and the outcomes free_ok, llm_ok."""
    d = items(spark, sf_dir)
    free = F.when(u(21, "item_id") < 0.55 + 0.04 * F.col("gold"), F.col("gold")).otherwise((F.col("gold") + 1 + F.floor(u(22, "item_id") * 9)) % CLASSES).cast("int")
    llm = F.when(u(11, "item_id") < 0.95 - 0.04 * F.col("gold"), F.col("gold")).otherwise((F.col("gold") + 1 + F.floor(u(12, "item_id") * 9)) % CLASSES).cast("int")
    d = d.withColumn("free_pred", free).withColumn("llm_pred", llm)
    d = d.withColumn("free_ok", (F.col("free_pred") == F.col("gold")).cast("int")).withColumn("llm_ok", (F.col("llm_pred") == F.col("gold")).cast("int"))
    d = d.withColumn("free_conf", F.when(F.col("free_ok") == 1, F.sqrt(u(23, "item_id"))).otherwise(u(23, "item_id")))
    d = d.withColumn("in_tokens", (200 + F.floor(u(31, "item_id") * 800)).cast("long")).withColumn("out_tokens", (1 + F.floor(u(32, "item_id") * 60)).cast("long"))
    d = d.withColumn("cached_tokens", F.floor(F.col("in_tokens") * u(33, "item_id") * 0.5).cast("long")).withColumn("latency_s", 0.2 + u(34, "item_id") * 2)
    return d


PAIR_LOG_SQL = f"""SELECT *,
    CASE WHEN free_ok = 1 THEN sqrt({u_sql(23, "item_id")}) ELSE {u_sql(23, "item_id")} END AS free_conf,
    (200 + floor({u_sql(31, "item_id")} * 800))::BIGINT AS in_tokens,
    (1 + floor({u_sql(32, "item_id")} * 60))::BIGINT AS out_tokens,
    floor((200 + floor({u_sql(31, "item_id")} * 800))::BIGINT * {u_sql(33, "item_id")} * 0.5::DOUBLE)::BIGINT AS cached_tokens,
    0.2::DOUBLE + {u_sql(34, "item_id")} * 2 AS latency_s
  FROM (SELECT *, (free_pred = gold)::INT AS free_ok, (llm_pred = gold)::INT AS llm_ok FROM (SELECT *,
    CASE WHEN {u_sql(21, "item_id")} < 0.55::DOUBLE + 0.04::DOUBLE * gold THEN gold ELSE ((gold + 1 + floor({u_sql(22, "item_id")} * 9)) % {CLASSES})::INT END AS free_pred,
    CASE WHEN {u_sql(11, "item_id")} < 0.95::DOUBLE - 0.04::DOUBLE * gold THEN gold ELSE ((gold + 1 + floor({u_sql(12, "item_id")} * 9)) % {CLASSES})::INT END AS llm_pred
    FROM ({ITEMS_SQL})))"""


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_log three times with the cheap model's prediction drawn anew: repeat, item_id, gold, free_pred, llm_pred, kept."""
    d = pair_log(spark, sf_dir).withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(REPEATS)])))
    redo = F.when(u(41, "repeat", "item_id") < 0.8, F.col("free_pred")).otherwise(F.floor(u(42, "repeat", "item_id") * CLASSES)).cast("int")
    return d.withColumn("free_pred", redo).withColumn("free_ok", (F.col("free_pred") == F.col("gold")).cast("int")).withColumn("kept", (u(43, "repeat", "item_id") < 0.3 + 0.6 * F.col("free_conf")).cast("int"))


REPEATS_SQL = f"""SELECT * EXCLUDE (free_pred, free_ok, q), q AS free_pred, (q = gold)::INT AS free_ok,
    ({u_sql(43, "repeat", "item_id")} < 0.3::DOUBLE + 0.6::DOUBLE * free_conf)::INT AS kept
  FROM (SELECT *, CASE WHEN {u_sql(41, "repeat", "item_id")} < 0.8::DOUBLE THEN free_pred ELSE floor({u_sql(42, "repeat", "item_id")} * {CLASSES})::INT END AS q
    FROM ({PAIR_LOG_SQL}), (SELECT unnest(range({REPEATS}))::INT AS repeat))"""


def proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_log with `proba`: ten class probabilities, in class order."""
    d = pair_log(spark, sf_dir)
    weights = F.array(*[F.lit(0.05) + u(50 + c, "item_id") + F.when(F.col("free_pred") == c, 3.0 * F.col("free_conf")).otherwise(0.0) for c in range(CLASSES)])
    return d.withColumn("__w", weights).withColumn("proba", F.expr("transform(__w, w -> w / aggregate(__w, 0D, (a, x) -> a + x))")).drop("__w")


PROBA_SQL = f"""SELECT * EXCLUDE (w, s), list_transform(w, lambda x: x / s) AS proba FROM (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, w), lambda a, b: a + b) AS s FROM (SELECT *,
    [{", ".join(f"0.05::DOUBLE + {u_sql(50 + c, 'item_id')} + CASE WHEN free_pred = {c} THEN 3.0::DOUBLE * free_conf ELSE 0.0::DOUBLE END" for c in range(CLASSES))}] AS w
    FROM ({PAIR_LOG_SQL})))"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """proba with the probability vectors of two further models, `proba_b` (the cheap one drawn again) and `proba_llm`, and
    with the classes that two further cheap models name, `pred_b` and `pred_c` (good at the lower classes)."""
    d = proba(spark, sf_dir)
    again = F.when(u(45, "item_id") < 0.7, F.col("gold")).otherwise(F.floor(u(46, "item_id") * CLASSES)).cast("int")
    d = d.withColumn("__b", again)
    for name, told, seed in (("proba_b", "__b", 160), ("proba_llm", "llm_pred", 180)):
        weights = F.array(*[F.lit(0.05) + u(seed + c, "item_id") + F.when(F.col(told) == c, 0.5 + 2.5 * u(seed + 15, "item_id")).otherwise(0.0) for c in range(CLASSES)])
        d = d.withColumn("__w", weights).withColumn(name, F.expr("transform(__w, w -> w / aggregate(__w, 0D, (a, x) -> a + x))"))
    third = F.when(u(47, "item_id") < 0.95 - 0.08 * F.col("gold"), F.col("gold")).otherwise(F.floor(u(48, "item_id") * CLASSES)).cast("int")
    return d.withColumn("pred_b", F.col("__b")).withColumn("pred_c", third).drop("__w", "__b")


def doc_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, text, lang, source, gold (quality), toxic, grp (digest of the text)."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "text", "lang", "source", F.col("quality").alias("gold"), "toxic", F.md5("text").alias("grp"))


DOC_CLASSES_SQL = "SELECT d.doc_id, d.text, d.lang, d.source, l.quality AS gold, l.toxic, md5(d.text) AS grp FROM documents d JOIN labels l USING (doc_id)"


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with `split`: three quarters train, the rest test."""
    return table(spark, sf_dir, "documents").withColumn("split", F.when(u(61, "doc_id") >= 0.25, "train").otherwise("test"))


SPLIT_SQL = f"SELECT *, CASE WHEN {u_sql(61, 'doc_id')} >= 0.25::DOUBLE THEN 'train' ELSE 'test' END AS split FROM documents"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with `act` (0-8) by digest of the text."""
    return table(spark, sf_dir, "conversations").withColumn("act", F.floor(u(71, F.md5(F.coalesce("text", F.lit("")))) * 9).cast("int"))


_TEXT_MD5 = "md5(coalesce(text, ''))"
TURNS_SQL = f"SELECT *, floor({u_sql(71, _TEXT_MD5)} * 9)::INT AS act FROM conversations"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a request log: ts, day, email, status, path, ms."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.to_date("ts").alias("day"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("email"), F.when(u(81, "event_id") < 0.1, "error").otherwise("ok").alias("status"), F.concat(F.lit("/"), "event_type").alias("path"), F.col("value").alias("ms"))


REQUESTS_SQL = f"SELECT event_id, ts, ts::DATE AS day, 'user' || user_id::VARCHAR || '@example.org' AS email, CASE WHEN {u_sql(81, 'event_id')} < 0.1::DOUBLE THEN 'error' ELSE 'ok' END AS status, '/' || event_type AS path, value AS ms FROM events"
