"""URL filters by a sort-merge range join (native).

A host's canonical key is its labels in reverse, each followed by a dot, so a rule's host and all its subdomains are
the keys in one interval [key, key with the last dot replaced by the next character). The intervals are nested or
disjoint. A sweep over the sorted starts, ends and keys carries the stack of active rule hosts (a running last value:
a start pushes its chain, an end restores its parent's chain). Below each active rule host the same sweep runs over
paths, whose prefixes are intervals too, and yields the longest path rule; of a url's hits the longest wins.

Sweeps run over distinct hosts and distinct (host, path) pairs, in ranges of the key. A rule that reaches over several
ranges opens in each of them, so no range needs another one, and a rule host with many urls is salted by its count.

Null urls and urls without "://" have an empty host and path and fit no rule. A url without a path fits no rule with
one. Ports and user names are a part of the host, so such hosts fit no rule that doesn't name them. Very long urls are
judged whole. Equal rules with unlike verdicts: block wins. Empty tables of urls or rules, repeated urls and extra columns
are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewright.llm.common import cut, lower_ascii, partitions, table

#: (host, path, verdict)
Rule = tuple[str, str, str]
RULES: list[Rule] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Urls of one rule host that a salt's sweep takes.
ROWS_A_SALT = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _bounds(keys: DataFrame, column: str, n: int) -> list[str]:
    """At most n keys that cut the sorted keys into ranges of about equal counts."""
    ranges = keys.select(column).repartitionByRange(n, column).groupBy(F.spark_partition_id().alias("p")).agg(F.min(column).alias("low"))
    return sorted(r["low"] for r in ranges.collect())


def _active_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (distinct host) with `chain`: the active rule hosts, outermost first; hosts without one are left out."""
    labels = F.split(F.col("key"), r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))
    keyed = rules.select(host_key(F.col("host")).alias("key")).distinct()
    chains = keyed.select("key", F.explode(ups).alias("up")).join(keyed.select(F.col("key").alias("up")), "up").groupBy("key").agg(F.array_sort(F.collect_list("up")).alias("chain"))
    points = hosts.select("host", host_key(F.col("host")).alias("key"))
    bounds = F.array(*[F.lit(b) for b in _bounds(points, "key", partitions(hosts.sparkSession))]) if not hosts.isEmpty() else F.array().cast("array<string>")

    def piece(key: Column) -> Column:
        return F.greatest(F.size(F.filter(bounds, lambda b: b <= key)), F.lit(1))

    end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))  # the character after the dot
    spans = chains.withColumn("end", end).withColumn("first", piece(F.col("key"))).withColumn("last", piece(F.col("end")))
    spans = spans.withColumn("piece", F.explode(F.sequence("first", "last")))
    depth = F.size("chain")
    # a rule that began in an earlier range opens before all keys of this one; outer ones first
    starts = spans.select("piece", F.when(F.col("piece") == F.col("first"), F.col("key")).otherwise(F.lit("")).alias("at"), F.lit(1).alias("kind"), depth.alias("turn"), "chain", F.lit(None).cast("string").alias("host"))
    ends = spans.where("piece = last").select("piece", F.col("end").alias("at"), F.lit(0).alias("kind"), (-depth).alias("turn"), F.expr("slice(chain, 1, size(chain) - 1)").alias("chain"), F.lit(None).cast("string").alias("host"))
    keys = points.select(piece(F.col("key")).alias("piece"), F.col("key").alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("turn"), F.lit(None).cast("array<string>").alias("chain"), "host")
    sweep = Window.partitionBy("piece").orderBy("at", "kind", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = starts.unionByName(ends).unionByName(keys).withColumn("chain", F.last("chain", ignorenulls=True).over(sweep))
    return swept.where("kind = 2 and size(chain) > 0").select("host", "chain")


def _longest_paths(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (node, host, path) with the longest path rule below each node, where there is one."""
    paths = rules.groupBy(host_key(F.col("host")).alias("node"), F.col("path").alias("start")).agg(F.max_by(F.struct("host", "path", "verdict"), F.col("verdict") == "block").alias("rule"))
    # a table, so that Spark broadcasts it by its size or splits a node's rows over tasks
    nodes = cut(urls.groupBy("node").agg(F.ceil(F.count("*") / ROWS_A_SALT).cast("int").alias("salts")), "nodes")
    shorter = paths.select("node", "start", F.explode(F.expr("transform(sequence(0, length(start)), n -> substring(start, 1, n))")).alias("up"))
    outer = shorter.where("up <> start").join(paths.select("node", F.col("start").alias("up"), F.col("rule").alias("outer")), ["node", "up"])
    chain = outer.groupBy("node", "start").agg(F.max_by("outer", F.length("up")).alias("parent"), F.count("*").alias("depth"))
    nested = paths.join(chain, ["node", "start"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    dealt = nested.join(nodes, "node").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")
    empty = F.lit(None).cast(paths.schema["rule"].dataType)
    # a prefix covers start .. start followed by the largest code point
    top = F.concat("start", F.lit("\U0010ffff"))
    none = F.lit(False)
    starts = dealt.select("node", "salt", F.col("start").alias("at"), F.lit(1).alias("kind"), F.col("depth").alias("turn"), "rule", none.alias("over"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    ends = dealt.select("node", "salt", top.alias("at"), F.lit(3).alias("kind"), (-F.col("depth")).alias("turn"), F.col("parent").alias("rule"), F.col("parent").isNull().alias("over"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    points = urls.join(nodes, "node").select("node", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"), F.col("path").alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("turn"), empty.alias("rule"), none.alias("over"), "host", "path")
    sweep = Window.partitionBy("node", "salt").orderBy("at", "kind", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.when(F.col("kind") != 2, F.struct(F.col("rule"), F.col("over")))
    swept = starts.unionByName(ends).unionByName(points).withColumn("state", F.last(state, ignorenulls=True).over(sweep))
    return swept.where("kind = 2 and state.rule is not null").select("host", "path", F.col("state.rule").alias("rule"))


def judge(df: DataFrame, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """df with host, path, rule (host followed by path; null if none fits) and verdict, in place of columns of these
    names. rules: host, path, verdict."""
    rules = rules.where("host is not null and path is not null and verdict is not null").select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").distinct()
    host, path = host_and_path(F.col(url))
    others = [c for c in df.columns if c == url or c not in ("host", "path", "rule", "verdict")]
    parsed = df.select(*others, host.alias("host"), path.alias("path"))
    pairs = cut(parsed.select("host", "path").where("host <> ''").distinct(), "pairs")
    hosts = cut(_active_hosts(pairs.select("host").distinct(), rules), "hosts")
    urls = pairs.join(hosts, "host").select("host", "path", F.explode("chain").alias("node"))
    hits = _longest_paths(cut(urls, "urls"), rules)
    size = F.struct(F.length("rule.host") + F.length("rule.path"), F.length("rule.host"))
    best = cut(hits.groupBy("host", "path").agg(F.max_by("rule", size).alias("best")), "best")
    best = best.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.concat("best.host", "best.path").alias("rule"), F.col("best.verdict").alias("verdict"))
    out = parsed.join(best, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left").drop("__h", "__p")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), "url", rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op9_url_filters": op9_url_filters}


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
ORACLE_SQL = {
    "op9_url_filters": f"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} END AS rule FROM split)
SELECT page_id, host, path, rule, CASE rule {" ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)} ELSE 'allow' END AS verdict
FROM ruled
"""
}
