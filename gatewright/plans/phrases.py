"""Queries on tables of phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.operators import phrases as ph
from gatewright.plans.base import Plans
from gatewright.sources.fixtures import table, u, u_sql

plans = Plans()

_W = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
PHRASES_SQL = f"""ph AS (SELECT DISTINCT p FROM (
  SELECT array_to_string(w[1:4], ' ') AS p FROM (SELECT {_W.format("unnest(string_split(text, chr(10)))")} AS w FROM documents)
  UNION ALL SELECT array_to_string(w[i:i + 2], ' ') FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT {_W.format("text")} AS w FROM benchmark))) WHERE p <> '')"""


def line_openings(spark, d):
    """phrase: the first four words of every line of `documents` and all runs of three words of `benchmark`."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    opening = lines.select(F.array_join(F.slice(ph.tokens(F.col("line")), 1, 4), " ").alias("phrase"))
    w = table(spark, d, "benchmark").select(ph.tokens(F.col("text")).alias("w")).where("size(w) > 2")
    runs = w.select(F.explode(F.expr("transform(sequence(1, size(w) - 2), i -> array_join(slice(w, i, 3), ' '))")).alias("phrase"))
    return opening.unionByName(runs).where("phrase <> ''").distinct()


@plans.add("q092_many_phrases", f"""WITH {PHRASES_SQL}, docs AS (SELECT doc_id, {_W.format("text")} AS w FROM documents), m AS (SELECT DISTINCT len(string_split(p, ' ')) AS m FROM ph),
g AS (SELECT doc_id, i - 1 AS start, array_to_string(w[i:i + m - 1], ' ') AS p FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, m))
SELECT doc_id, count(*) AS n, count(DISTINCT p) AS phrases, sum(start)::BIGINT AS places FROM g JOIN ph USING (p) GROUP BY doc_id""")
def many_phrases(spark, d):
    """Where in every document the openings of all lines and the runs of all benchmark items occur: one pass."""
    got = ph.occurrences(table(spark, d, "documents"), "doc_id", "text", line_openings(spark, d), "phrase")
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("phrase").alias("phrases"), F.sum("start").alias("places"))


_STOP = ("the", "of", "and", "der", "die", "de", "la")


def concept_table(spark, d):
    """phrase, kind, name: runs of two and three words of benchmark items; a fifth of them neutral."""
    w = table(spark, d, "benchmark").select("item_id", ph.tokens(F.col("text")).alias("w")).where("size(w) > 1")
    runs = w.select(F.explode(F.flatten(F.expr("transform(sequence(1, size(w)), i -> transform(filter(array(2, 3), m -> i + m - 1 <= size(w)), m -> array_join(slice(w, i, m), ' ')))"))).alias("phrase")).distinct()
    return runs.withColumn("kind", F.when(u(151, "phrase") < 0.2, "NEUTRAL").when(u(151, "phrase") < 0.6, "THING").otherwise("ACTION")).withColumn("name", F.md5("phrase"))


@plans.add("q094_concept_tags", rf"""WITH RECURSIVE b AS (SELECT {_W.format("text")} AS w FROM benchmark), runs AS (SELECT DISTINCT array_to_string(w[i:i + m - 1], ' ') AS p, m FROM (SELECT w, i, unnest([2, 3]) AS m FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM b)) WHERE i + m - 1 <= len(w)),
ph AS MATERIALIZED (SELECT p, m, CASE WHEN {u_sql(151, 'p')} < 0.2::DOUBLE THEN 'NEUTRAL' WHEN {u_sql(151, 'p')} < 0.6::DOUBLE THEN 'THING' ELSE 'ACTION' END AS kind FROM runs),
docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+|[.,;:!?]') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS s, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT unnest([2, 3]) AS m))),
best AS MATERIALIZED (SELECT doc_id, s, max(m) AS m, arg_max(kind, m) AS kind FROM g JOIN ph USING (p, m) GROUP BY doc_id, s),
nxt AS MATERIALIZED (SELECT a.doc_id, a.s, a.m, a.kind, b.s AS after FROM best a ASOF LEFT JOIN best b ON a.doc_id = b.doc_id AND a.s + a.m <= b.s),
taken AS (SELECT doc_id, s, m, kind, after FROM nxt WHERE (doc_id, s) IN (SELECT doc_id, min(s) FROM best GROUP BY doc_id) UNION ALL SELECT n.doc_id, n.s, n.m, n.kind, n.after FROM taken t JOIN nxt n ON n.doc_id = t.doc_id AND n.s = t.after),
cov AS (SELECT doc_id, unnest(range(s, s + m)) AS s FROM taken),
alone AS (SELECT doc_id, s, CASE WHEN w IN ('.', ',', ';', ':', '!', '?') THEN 'BREAK' ELSE 'WORD' END AS kind FROM (SELECT doc_id, unnest(range(len(w))) AS s, unnest(w) AS w FROM docs) ANTI JOIN cov USING (doc_id, s) WHERE w NOT IN {_STOP}),
every AS (SELECT doc_id, s, kind FROM alone UNION ALL SELECT doc_id, s, kind FROM taken WHERE kind <> 'NEUTRAL')
SELECT doc_id, kind, count(*) AS n, sum(s)::BIGINT AS places FROM every GROUP BY ALL""")
def concept_tags(spark, d):
    """Documents tagged from left to right with the longest phrases of a table; words and clause breaks between them."""
    got = ph.tags(table(spark, d, "documents"), "doc_id", "text", concept_table(spark, d), stop=_STOP)
    return got.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("start").alias("places"))
