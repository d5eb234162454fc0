"""MinHash near-deduplication with sequential Bayesian verification.

Candidates share a band of MinHash signatures. A pair's signatures are compared a batch of hashes at a time, and it is
given up as soon as the posterior probability of a similarity at the threshold falls below `miss`; survivors are
verified on their full shingle sets. Documents with equal sets are one class; links join classes into components.

Null, empty and blank texts have no shingles and are linked with nothing. Rows with equal ids stay rows of their own;
a component's id is the smallest id in it. Very long texts are read whole; a class's set is held by one task at a time.
Extra columns are left alone. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm import shingles as sh
from gatewright.llm.common import cut, release, table

#: A pair of the similarity is lost with at most this probability by the bands, and by each batch of the comparison.
MISS = 1e-6


def near_duplicates(df: DataFrame, key: str, text: str, n: int = 5, over: int = 80, of: int = 100, miss: float = MISS) -> DataFrame:
    """One row per row of df: key, n_shingles, component_id, kept (whether its key is the component's id)."""
    plan = sh.tune(n, over, of, miss, hashes=96)
    signed = cut(sh.units(df, key, text, sh.whole_text, plan, signed=True), "documents")
    every = sh.classes(signed, key, signed=True)
    found = cut(signed.select(key, "n_shingles", "set_key"), "found")
    release(df.sparkSession, signed)
    groups = sh.linked_classes(every, plan, lambda wanted: sh.full_sets(df, key, text, sh.whole_text, plan, wanted), miss / 10)
    named = every.select("cls", "set_key", F.col("place.key").alias("least")).join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # equal sets are one class whose least key is known, so a hot class is one row of this table
    labels = cut(named.join(smallest, "component").select("set_key", "component_id"), "labels")
    release(df.sparkSession, every, groups)
    out = found.select(key, "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.coalesce("component_id", F.col(key))
    return out.select(key, "n_shingles", component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))


def deduplicate(df: DataFrame, key: str, text: str, n: int = 5, over: int = 80, of: int = 100) -> DataFrame:
    """The rows of df whose key is the smallest of their group; of rows with equal key and text one stays."""
    found = cut(near_duplicates(df, key, text, n, over, of), "near")
    per_key = found.groupBy(F.col(key).alias("__k")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    marked = cut(per_key.where("not kept or n > 1"), "marked")  # few keys: the texts move only if these are many
    rows = df.join(marked.where("not kept").select("__k"), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    again = marked.where("kept and n > 1").select("__k")
    if again.isEmpty():
        return rows
    same = F.col(key).eqNullSafe(F.col("__k"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates([key, text]))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", n=3, over=85, of=100)


QUERIES = {"op3_near_dedup": op3_near_dedup}
