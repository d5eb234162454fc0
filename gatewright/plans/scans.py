"""Queries on loading: registries, splits, nested corpora, pooled adapters, pivots of results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatewright.functions import text as t
from gatewright.plans.base import Plans
from gatewright.sources import datasets as ds
from gatewright.sources.fixtures import PAIR_LOG_SQL, SPLIT_SQL, pair_log, split_documents, table, u_sql

plans = Plans()
P = f"({PAIR_LOG_SQL})"


def registry(spark, d):
    """A registry as JSON text: one task a region with its classes, as a file would hold it."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("task")).agg(F.to_json(F.struct(F.first("r_name").alias("task"), F.collect_list("n_name").alias("classes"), F.first("r_regionkey").alias("n_test"))).alias("json"))


@plans.add("q001_registry", "SELECT r_name AS task, count(*) AS classes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def registry_scan(spark, d):
    return ds.parse_registry(registry(spark, d), "json").select("task", F.size("classes").cast("long").alias("classes"))


@plans.add("q002_task_spec", "SELECT r_name AS task, list_sort(list(lower(trim(n_name)))) AS classes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def task_spec(spark, d):
    """Classes normalised and sorted; a missing field or two classes that become one are errors."""
    return ds.task_spec(ds.parse_registry(registry(spark, d), "json")).select("task", "classes")


_CLS = "('src1', 'src2', 'src3', 'src4', 'src5')"


@plans.add("q003_split_scan", f"SELECT split, lower(trim(source)) AS label, count(*) AS n, sum(length(coalesce(lang, '') || chr(10) || text))::BIGINT AS chars FROM ({SPLIT_SQL}) WHERE lower(trim(source)) IN {_CLS} GROUP BY 1, 2")
def split_scan(spark, d):
    """Input columns joined, labels normalised, rows of other labels left out."""
    x = ds.split_scan(split_documents(spark, d), ["lang", "text"], "source", ["src1", "src2", "src3", "src4", "src5"])[0]
    return x.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum(F.char_length("input")).alias("chars"))


@plans.add("q003_dropped_labels", f"SELECT split, count(*) AS dropped FROM ({SPLIT_SQL}) WHERE lower(trim(source)) NOT IN {_CLS} GROUP BY 1")
def dropped_labels(spark, d):
    return ds.split_scan(split_documents(spark, d), ["lang", "text"], "source", ["src1", "src2", "src3", "src4", "src5"])[1].groupBy("split").agg(F.count("*").alias("dropped"))


@plans.add("q004_task_load", f"SELECT split, count(*) AS n, count(*) <> 150 AS drifted FROM ({SPLIT_SQL}) WHERE lower(trim(source)) IN {_CLS} GROUP BY 1")
def task_load(spark, d):
    """Rows per split and whether they differ from what the registry expects; an empty test split is an error."""
    return ds.task_load(split_documents(spark, d), "source", ["src1", "src2", "src3", "src4", "src5"], 150)


@plans.add("q005_dataset", f"""WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents WHERE trim(coalesce(text, '')) <> ''), y AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {u_sql(301, 'doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM x WHERE k = 1)
SELECT doc_id, CASE WHEN r <= 5 THEN 'test' WHEN r <= 10 THEN 'val' WHEN r <= 30 THEN 'train' ELSE 'pool' END AS part FROM y""")
def dataset(spark, d):
    """Blank texts dropped, of equal texts the first kept; per class five rows for test, five for validation, twenty to
    train, the rest a pool."""
    return ds.draw_splits(table(spark, d, "documents"), "doc_id", "text", "lang", [("test", 5), ("val", 5), ("train", 20)], 301).select("doc_id", "part")


@plans.add("q015_two_branch", f"WITH a AS (SELECT item_id AS idx, md5(item_id::VARCHAR) AS h, gold FROM {P}), b AS (SELECT item_id AS idx, llm_pred FROM {P} WHERE item_id % 3 > 0), c AS (SELECT md5(item_id::VARCHAR) AS h, free_pred FROM {P} WHERE item_id % 5 > 0) SELECT a.idx, a.gold, b.llm_pred, c.free_pred FROM a JOIN b USING (idx) JOIN c USING (h)")
def two_branch(spark, d):
    """Requests joined with their responses by index, and with another log by the item's digest."""
    x = pair_log(spark, d)
    requests = x.select(F.col("item_id").alias("idx"), F.md5(F.col("item_id").cast("string")).alias("h"), "gold")
    responses = x.where("item_id % 3 > 0").select(F.col("item_id").alias("idx"), "llm_pred")
    other = x.where("item_id % 5 > 0").select(F.md5(F.col("item_id").cast("string")).alias("h"), "free_pred")
    return ds.two_branches(requests, responses, other, "idx", "h").select("idx", "gold", "llm_pred", "free_pred")


@plans.add("q016_zip", "SELECT a.vec_id, a.label, b.vec_id AS other FROM (SELECT *, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings) a JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS k FROM embeddings) b USING (k)")
def zipped(spark, d):
    """Two ordered streams side by side; unlike lengths are an error."""
    e = table(spark, d, "embeddings")
    return ds.zip_ordered(e.select("vec_id", "label"), ["vec_id"], e.select(F.col("vec_id").alias("other")), [F.desc("other")]).select("vec_id", "label", "other")


@plans.add("q017_pooled", "SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS label FROM documents WHERE source <> 'src0'")
def pooled(spark, d):
    """Splits pooled, a class dropped, labels numbered without gaps."""
    x = split_documents(spark, d)
    return ds.pooled([x.where("split = 'train'"), x.where("split = 'test'")], "source", ["src0"]).select("doc_id", F.col("label").cast("long").alias("label"))


@plans.add("q020_nested_corpus", "SELECT CASE WHEN conv_id % 4 = 0 THEN 'dev' ELSE 'train' END AS part, conv_id, turn, role FROM conversations")
def nested_corpus(spark, d):
    """Arrays of conversations per part, each an array of turns, flattened."""
    c = table(spark, d, "conversations")
    part = F.when(F.col("conv_id") % 4 == 0, "dev").otherwise("train")
    nested = c.groupBy(part.alias("part"), "conv_id").agg(F.to_json(F.struct(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))).alias("json"))
    return ds.explode_corpus(nested, "part", "json", "conv_id long, turns array<struct<turn:long,role:string>>")


@plans.add("q021_candidates", "SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS candidate, md5(text) AS h FROM benchmark")
def candidates(spark, d):
    """A flat array of texts: the place is the id."""
    pool = table(spark, d, "benchmark").agg(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda e: e["text"]).alias("texts"))  # the candidate list is one array in its file
    return pool.select(F.posexplode("texts").alias("candidate", "text")).select("candidate", F.md5("text").alias("h"))


@plans.add("q022_ontology", "SELECT r_name AS field, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def ontology(spark, d):
    """A nested configuration of fields and their values."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    config = n.groupBy("r_name").agg(F.collect_list("n_name").alias("v")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "v")))).alias("json"))  # one row a region
    return ds.ontology(config, "json")


@plans.add("q027_results_pivot", f"SELECT gold AS task, avg(CASE WHEN m = 'free' THEN ok END) AS free, avg(CASE WHEN m = 'llm' THEN ok END) AS llm, count(*) AS n FROM (SELECT gold, 'free' AS m, free_ok::DOUBLE AS ok FROM {P} UNION ALL SELECT gold, 'llm', llm_ok::DOUBLE FROM {P}) GROUP BY 1")
def results_pivot(spark, d):
    """One row a task with a column per model, as the flat results file has it."""
    long = pair_log(spark, d).select(F.col("gold").alias("task"), F.explode(F.create_map(F.lit("free"), F.col("free_ok"), F.lit("llm"), F.col("llm_ok"))).alias("model", "ok"))
    n = long.groupBy("task").agg(F.count("*").alias("n"))
    return ds.results_table(long, "task", "model", "ok", ["free", "llm"]).join(n, "task")


@plans.add("q040_split_check", f"SELECT split, count(*) AS n, bit_xor(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT) AS x FROM ({SPLIT_SQL}) GROUP BY 1")
def split_check(spark, d):
    """What a split's fingerprint is made of, whatever the order of rows."""
    return split_documents(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")).alias("x"))


@plans.add("q174_best_rows", f"WITH k AS (SELECT gold AS task, free_pred AS candidate, avg(free_conf) AS score FROM {P} GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(score, 12) DESC, candidate) = 1 AS best FROM k) SELECT task, candidate, score FROM b WHERE best")
def best_rows(spark, d):
    k = pair_log(spark, d).groupBy(F.col("gold").alias("task"), F.col("free_pred").alias("candidate")).agg(F.avg("free_conf").alias("score"))
    marked = k.withColumn("best", F.row_number().over(Window.partitionBy("task").orderBy(F.desc(F.round("score", 12)), "candidate")) == 1)
    return marked.where("best").select("task", "candidate", "score")


@plans.add("q327_demands", "SELECT lang, max(ceil(length(text) / 4.0))::BIGINT AS most, quantile_cont(ceil(length(text) / 4.0), 0.95) AS p95, avg(ceil(length(text) / 4.0)) AS mean, count(DISTINCT source) AS classes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def demands(spark, d):
    """What a task asks of a model: prompt sizes (a token for four characters) and classes."""
    n = F.ceil(F.char_length("text") / 4.0)
    return table(spark, d, "documents").where("text is not null").groupBy("lang").agg(F.max(n).alias("most"), F.percentile(n, 0.95).alias("p95"), F.avg(n).alias("mean"), F.count_distinct("source").alias("classes"))


@plans.add("q286_embedding_cache", "SELECT sha256(text) AS key, min(doc_id) AS first, count(*) AS users FROM documents WHERE text IS NOT NULL GROUP BY 1")
def embedding_cache(spark, d):
    """One entry a distinct text, keyed by its digest."""
    return ds.cache_keys(table(spark, d, "documents"), "doc_id", "text")


@plans.add("q288_hypotheses", "SELECT n_name AS class, 'This text is about ' || replace(lower(n_name), '_', ' ') || '.' AS hypothesis FROM nation")
def hypotheses(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("class"), F.concat(F.lit("This text is about "), F.replace(t.normalize_label(F.col("n_name")), F.lit("_"), F.lit(" ")), F.lit(".")).alias("hypothesis"))
