"""Checked readers and resumable writers over files that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Per-item predictions of the cheap and log rows of the expensive model; read with these schemas, never inferred.
CHEAP_LOG = T.StructType([T.StructField(n, t) for n, t in (("task", T.StringType()), ("candidate", T.StringType()), ("repeat", T.IntegerType()), ("fold", T.IntegerType()), ("item_idx", T.LongType()), ("text_sha256", T.StringType()), ("gold", T.StringType()), ("pred", T.StringType()), ("p_pred", T.DoubleType()), ("kept", T.IntegerType()), ("set_size", T.IntegerType()))])
EXPENSIVE_LOG = T.StructType([T.StructField(n, t) for n, t in (("task", T.StringType()), ("model_key", T.StringType()), ("item_idx", T.LongType()), ("text_sha256", T.StringType()), ("gold", T.StringType()), ("raw_output", T.StringType()), ("pred", T.StringType()), ("parse_ok", T.IntegerType()), ("in_tokens", T.LongType()), ("out_tokens", T.LongType()), ("cached_tokens", T.LongType()), ("cost_usd", T.DoubleType()), ("latency_s", T.DoubleType()), ("ts", T.StringType()))])

_SOURCES: dict = {}


def register(name: str):
    """Decorator: a source by name; a name is taken once."""

    if name in _SOURCES:
        raise ValueError(f"source {name} is registered already")

    def wrap(fn):
        _SOURCES[name] = fn
        return fn

    return wrap


def load(spark: SparkSession, name: str, *args) -> DataFrame:
    if name not in _SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(_SOURCES)) or 'none'}")
    return _SOURCES[name](spark, *args)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose header must equal the schema's names in order; every column is read as text and then cast, and a value
    that doesn't cast is an error."""
    header = spark.read.text(path).first()
    names = [c.strip().strip('"') for c in header[0].split(",")] if header else []
    if names != schema.names:
        raise ValueError(f"{path}: header {names}, expected {schema.names}")
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = spark.read.csv(path, header=True, schema=raw, enforceSchema=False, mode="FAILFAST")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def check_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df; raises if a key occurs twice."""
    again = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if again:
        raise ValueError(f"{what}: {', '.join(str(tuple(r)[:-1]) for r in again)} occur more than once")
    return df


def join_logs(cheap: DataFrame, expensive: DataFrame) -> DataFrame:
    """Cheap predictions of several repeats joined many-to-one with the expensive model's log. Errors: an item twice in
    a repeat or in the log, repeats with unlike item sets, unlike text digests or gold labels."""
    check_unique(cheap, ["task", "repeat", "item_idx"], "cheap log")
    check_unique(expensive, ["task", "item_idx"], "expensive log")
    sets = cheap.groupBy("task", "repeat").agg(F.count("*").alias("n"), F.sum("item_idx").alias("s")).groupBy("task").agg(F.count_distinct("n", "s").alias("kinds")).where("kinds > 1")
    if not sets.isEmpty():
        raise ValueError("repeats hold unlike items")
    b = expensive.select("task", "item_idx", F.col("pred").alias("llm_pred"), "raw_output", "cost_usd", "latency_s", F.col("text_sha256").alias("__sha"), F.col("gold").alias("__gold"))
    out = cheap.join(b, ["task", "item_idx"])
    if not out.where("__sha <> text_sha256 or __gold <> gold").isEmpty():
        raise ValueError("texts or gold labels differ between the logs")
    return out.drop("__sha", "__gold")


def validate_items(df: DataFrame, text: str, gold: str) -> dict:
    """n and classes; raises unless there are two rows and two classes at least, labels run from 0 without gaps and no
    text is null."""
    r = df.agg(F.count("*").alias("n"), F.count_if(F.col(text).isNull()).alias("nulls"), F.min(gold).alias("lo"), F.max(gold).alias("hi"), F.count_distinct(gold).alias("k")).first()
    if r["n"] < 2 or r["nulls"] or r["lo"] != 0 or r["hi"] != r["k"] - 1 or r["k"] < 2:
        raise ValueError(f"not a dataset: {r.asDict()}")
    return {"n": r["n"], "classes": r["k"]}


def validate_upload(spark: SparkSession, path: str, most_rows: int = 10_000) -> dict:
    """Checks a JSON-lines upload: text under text, sentence or query, label under label, intent, category or class; two
    classes at least. Returns rows, bad rows and counts per class."""
    names = ["text", "sentence", "query", "label", "intent", "category", "class"]
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", ", ".join(f"`{n}` string" for n in names), {"mode": "PERMISSIVE"}).alias("j"))
    rows = parsed.select(F.coalesce(*[F.col(f"j.{n}") for n in names[:3]]).alias("text"), F.coalesce(*[F.col(f"j.`{n}`") for n in names[3:]]).alias("label"))
    good = rows.where("text is not null and label is not null")
    counts = {r["label"]: r["count"] for r in good.groupBy("label").count().orderBy("label").limit(most_rows).collect()}
    n = rows.count()
    problems = ["too many rows"] * (n > most_rows) + ["fewer than two classes"] * (len(counts) < 2)
    return {"rows": n, "bad": n - sum(counts.values()), "classes": counts, "problems": problems}


def append_rows(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys aren't there yet; returns how many. A second call with the same rows adds none."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(*keys)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = spark.createDataFrame([], T.StructType([df.schema[k] for k in keys]))
    new = df.join(there, keys, "left_anti")
    before = there.count()
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def compact(spark: SparkSession, path: str, out: str, bad: str) -> DataFrame:
    """The rows without an error marker, written to another folder; the old one stays as it is."""
    spark.read.parquet(path).where(f"not coalesce({bad}, false)").write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def upsert(base: DataFrame, patch: DataFrame, key: str, expected: list | None = None) -> DataFrame:
    """base with all rows of patch's keys replaced by patch's; error if patch lacks an expected key or has another."""
    if expected is not None:
        got = sorted(r[0] for r in patch.select(key).distinct().collect())
        if got != sorted(expected):
            raise ValueError(f"patch holds {got}, expected {sorted(expected)}")
    return base.join(patch.select(key).distinct(), key, "left_anti").unionByName(patch, allowMissingColumns=True)


def fold_columns(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """Columns with a prefix as a map (without nulls), the others as they are."""
    own = [c for c in df.columns if c.startswith(prefix)]
    entries = [F.struct(F.lit(c[len(prefix) :]).alias("k"), F.col(c).cast("string").alias("v")) for c in own]
    return df.select(*[c for c in df.columns if c not in own], F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull())).alias(out))


def best_published(scores: DataFrame) -> DataFrame:
    """Per task the metric with the most models (ties: by name), its best score and model. Columns: task, model, metric,
    score."""
    cover = scores.groupBy("task", "metric").agg(F.count_distinct("model").alias("models"), F.max(F.struct("score", "model")).alias("b"))
    return cover.groupBy("task").agg(F.max_by(F.struct("metric", "b"), F.struct("models", F.transform(F.split("metric", ""), lambda ch: -F.ascii(ch)))).alias("x")).select("task", "x.metric", F.col("x.b.score").alias("score"), F.col("x.b.model").alias("model"))


def fingerprint(df: DataFrame, columns: list[str], order: str | None = None) -> str:
    """SHA-256 of rows. With an order: of the row digests in order, per part of 4,096 rows first, so that no task holds
    all. Without: of sum and count of row hashes, whatever the order."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)]), 256)
    if order is None:
        r = df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.conv(F.substring(row, 16, 15), 16, 10).cast("long")).alias("x")).first()
        return uuid.uuid5(uuid.NAMESPACE_OID, f"{r['n']}/{r['s']}/{r['x']}").hex
    rows = df.select(F.col(order).cast("long").alias("o"), row.alias("d"))
    parts = rows.groupBy(F.floor(F.col("o") / 4096).alias("p")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "d"))), lambda e: e["d"]), ""), 256).alias("d"))
    top = parts.groupBy(F.floor(F.col("p") / 4096).alias("q")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda e: e["d"]), ""), 256).alias("d"))
    return uuid.uuid5(uuid.NAMESPACE_OID, "".join(r["d"] for r in top.orderBy("q").collect())).hex


def compare(measured: DataFrame, expected: DataFrame) -> DataFrame:
    """Paths (column path, value) whose values differ or that stand on one side alone."""
    a, b = measured.select("path", F.col("value").alias("measured")), expected.select("path", F.col("value").alias("expected"))
    return a.join(b, "path", "full_outer").where(~F.col("measured").eqNullSafe(F.col("expected")))
