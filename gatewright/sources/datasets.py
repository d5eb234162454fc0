"""Datasets from registries, splits, nested files and ordered streams; result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewright.functions import text as t
from gatewright.operators.folds import u
from gatewright.sources import files

REGISTRY = "task string, classes array<string>, n_test int"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a JSON file: a list, or an object with the list under `tasks`."""
    raw = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"^\s+", "")).alias("value"))
    task = "struct<task:string,classes:array<string>,n_test:int>"
    listed = F.when(F.startswith("value", F.lit("[")), F.from_json("value", f"array<{task}>")).otherwise(F.from_json("value", f"tasks array<{task}>")["tasks"])
    return raw.select(F.inline(listed))


def parse_registry(df: DataFrame, json: str) -> DataFrame:
    """Tasks of JSON text; a row that isn't an object with the three fields is an error."""
    parsed = df.select(F.from_json(json, REGISTRY).alias("x"), F.col(json).alias("__j"))
    ok = F.col("x.task").isNotNull() & F.col("x.classes").isNotNull() & F.col("x.n_test").isNotNull()
    return parsed.select(F.when(ok, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not a task: "), F.coalesce("__j", F.lit("null")))).cast("struct<task:string,classes:array<string>,n_test:int>")).alias("x")).select("x.*")


def task_spec(df: DataFrame) -> DataFrame:
    """Sorted normalised classes; an error where two become one."""
    normal = F.array_sort(F.transform("classes", t.normalize_label))
    same = F.size(F.array_distinct(normal)) == F.size("classes")
    return df.withColumn("classes", F.when(same, normal).otherwise(F.raise_error(F.concat(F.lit("classes collide in "), F.col("task"))).cast("array<string>")))


def split_scan(df: DataFrame, inputs: list[str], label: str, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """df with `input` (columns joined) and `label` (normalised), rows of the classes alone; and the rows left out."""
    x = df.withColumn("input", t.row_text(*inputs)).withColumn("label", t.normalize_label(F.col(label)))
    known = F.coalesce(F.col("label").isin(classes), F.lit(False))
    return x.where(known), x.where(~known)


def task_load(df: DataFrame, label: str, classes: list[str], expected: int) -> DataFrame:
    """Rows of each split and whether they differ from the expected number; raises without a test row."""
    counts = split_scan(df, [], label, classes)[0].groupBy("split").agg(F.count("*").alias("n"))
    if counts.where("split = 'test'").isEmpty():
        raise ValueError("the test split is empty")
    return counts.withColumn("drifted", F.col("n") != expected)


def draw_splits(df: DataFrame, key: str, text: str, label: str, parts: list[tuple[str, int]], seed: int) -> DataFrame:
    """df without blank and repeated texts (the first by key stays), with `part`: per label so many rows of each part in
    the order of a digest, the rest `pool`."""
    once = df.where(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn("__h", F.md5(text))
    first = once.groupBy("__h").agg(F.min(key).alias(key))
    once = once.join(first, ["__h", key], "left_semi").drop("__h")
    place = F.row_number().over(Window.partitionBy(label).orderBy(u(seed, key), key))
    out, upto = F.lit("pool"), sum(n for _, n in parts)
    for name, n in reversed(parts):
        out = F.when(F.col("__k") <= upto, name).otherwise(out)
        upto -= n
    return once.withColumn("__k", place).withColumn("part", out).drop("__k")


def two_branches(requests: DataFrame, responses: DataFrame, other: DataFrame, index: str, digest: str) -> DataFrame:
    """Requests with their responses by index, then another log by the item's digest; each index and digest once."""
    for df, k, what in ((requests, index, "requests"), (responses, index, "responses"), (other, digest, "other log")):
        files.check_unique(df, [k], what)
    return requests.join(responses, index).join(other, digest)


def numbered(df: DataFrame, order: list) -> DataFrame:
    """df with `__k`, the place in the order: range partitions are counted, so no task holds all rows."""
    parts = df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__r", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33))
    starts = parts.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__s", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return parts.join(F.broadcast(starts.select("__p", "__s")), "__p").withColumn("__k", F.col("__s") + F.col("__r")).drop("__p", "__r", "__s")


def zip_ordered(left: DataFrame, left_order: list, right: DataFrame, right_order: list) -> DataFrame:
    """Two ordered streams joined by place; raises if they differ in length."""
    if left.count() != right.count():
        raise ValueError("streams of unlike lengths")
    return numbered(left, left_order).join(numbered(right, right_order), "__k").drop("__k")


def read_zipped(spark: SparkSession, csv: str, lines: str) -> DataFrame:
    """A CSV of gold rows beside a text file of annotations, line by line (files of one part each)."""
    place = lambda df: df.withColumn("__m", F.monotonically_increasing_id())
    return zip_ordered(place(spark.read.csv(csv, header=True)), ["__m"], place(spark.read.text(lines).withColumnRenamed("value", "annotation")).withColumnRenamed("__m", "__o"), ["__o"]).drop("__m", "__o")


def pooled(splits: list[DataFrame], label: str, drop: list[str]) -> DataFrame:
    """Splits in one, without the dropped classes, `label` numbered from 0 in alphabetical order."""
    every = splits[0]
    for x in splits[1:]:
        every = every.unionByName(x)
    every = every.where(~F.col(label).isin(drop))
    names = every.select(F.col(label).alias("__l")).distinct().withColumn("label", F.row_number().over(Window.orderBy("__l")) - 1)  # one row a class
    return every.join(F.broadcast(names), F.col(label) == F.col("__l")).drop("__l")


def locales(spark: SparkSession, path: str, column: str = "locale") -> list[str]:
    """Names of the partition folders under path."""
    return sorted(str(r[0]) for r in spark.read.parquet(path).select(column).distinct().collect())


def read_columns(spark: SparkSession, path: str, locale: str, columns: list[str]) -> DataFrame:
    """One locale's rows, the asked columns alone."""
    return spark.read.parquet(path).where(F.col("locale") == locale).select(*columns)


def explode_corpus(df: DataFrame, part: str, json: str, schema: str) -> DataFrame:
    """Turns of conversations that are JSON objects with an array `turns`."""
    return df.select(part, F.from_json(json, schema).alias("c")).select(part, "c.conv_id", F.explode("c.turns").alias("t")).select(part, "conv_id", "t.*")


def ontology(df: DataFrame, json: str) -> DataFrame:
    """field, value of a JSON object of arrays."""
    return df.select(F.explode(F.from_json(json, "map<string,array<string>>")).alias("field", "values")).select("field", F.explode("values").alias("value"))


def collect_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """JSON artifacts below path, of two layouts (fields at the top or under `run`): task, variant, score, file and
    `canonical`, the newest run of its task without a variant."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    fields = "task string, variant string, score double"
    x = raw.select("file", "at", F.from_json("value", fields).alias("a"), F.from_json("value", f"run struct<{fields.replace(' ', ':').replace(',:', ',')}>")["run"].alias("b"))
    x = x.select("file", "at", F.when(F.col("b.task").isNotNull(), F.col("b")).otherwise(F.col("a")).alias("x")).select("file", "at", "x.*")
    plain = F.col("variant").isNull()
    newest = F.row_number().over(Window.partitionBy("task", plain).orderBy(F.desc("at"), F.desc("file"))) == 1
    return x.withColumn("canonical", plain & newest).drop("at")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256, bytes of all files below path."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def dataset_hash(spark: SparkSession, path: str) -> str:
    """Sixteen hexadecimal digits for the files' names and contents."""
    rows = file_hashes(spark, path).orderBy("file").select(F.concat_ws(":", "file", "sha256").alias("x")).agg(F.array_join(F.sort_array(F.collect_list("x")), "\n").alias("x"))  # one line a file
    return rows.select(F.substring(F.sha2("x", 256), 1, 16)).first()[0]


def results_table(long: DataFrame, task: str, model: str, value: str, models: list[str]) -> DataFrame:
    """One row a task, a column per model with the mean."""
    return long.groupBy(task).pivot(model, models).agg(F.avg(F.col(value).cast("double")))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header, rows in the given order; for results of a few rows a task."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_by_task(df: DataFrame, path: str, task: str) -> None:
    """A folder per task."""
    df.repartition(task).write.mode("overwrite").partitionBy(task).csv(path, header=True)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed decision log; a line that doesn't parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_bank(df: DataFrame, path: str, order: list[str]) -> str:
    """Rows as JSON lines in a fixed order; returns the digest of the bytes written."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)
    spark = df.sparkSession
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.sha2("content", 256)).first()[0]


def verify_split(df: DataFrame, columns: list[str], recorded: str | None) -> str:
    """The split's fingerprint; raises if another one is recorded."""
    own = files.fingerprint(df, columns)
    if recorded is not None and recorded != own:
        raise ValueError(f"the split changed: {own}, recorded {recorded}")
    return own


def read_cheap_log(spark: SparkSession, path: str) -> DataFrame:
    """Per-item predictions: exact header, casts, one task and candidate, each item once a repeat, the same items in all."""
    x = files.check_unique(files.read_csv(spark, path, files.CHEAP_LOG), ["repeat", "item_idx"], path)
    r = x.agg(F.count_distinct("task").alias("t"), F.count_distinct("candidate").alias("c")).first()
    if r["t"] != 1 or r["c"] != 1:
        raise ValueError(f"{path}: {r['t']} tasks, {r['c']} candidates")
    kinds = x.groupBy("repeat").agg(F.count("*").alias("n"), F.sum(F.xxhash64("item_idx").cast("decimal(38,0)")).alias("s")).select("n", "s").distinct().count()
    if kinds != 1:
        raise ValueError(f"{path}: repeats hold unlike items")
    return x


def read_expensive_log(spark: SparkSession, path: str) -> DataFrame:
    return files.check_unique(files.read_csv(spark, path, files.EXPENSIVE_LOG), ["item_idx"], path)


def cache_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a distinct text: its digest, the first key, how many rows share it."""
    return df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("key")).agg(F.min(key).alias("first"), F.count("*").alias("users"))
