"""Queries on overlap, text, conversations, vectors and usage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatewright.functions import text as t
from gatewright.operators import overlap as o
from gatewright.operators import sequence as s
from gatewright.operators import usage as us
from gatewright.operators import vectors as v
from gatewright.plans.base import Plans
from gatewright.sources.fixtures import DOC_CLASSES_SQL, ITEMS_SQL, REQUESTS_SQL, SPLIT_SQL, TURNS_SQL, doc_classes, items, requests, split_documents, table, turns, u, u_sql

plans = Plans()
D, T, L = f"({SPLIT_SQL})", f"({TURNS_SQL})", f"({REQUESTS_SQL})"


def halves(spark, d):
    x = split_documents(spark, d)
    return x.where("split = 'test'"), x.where("split = 'train'")


@plans.add("q074_exact_overlap", f"SELECT doc_id FROM {D} WHERE split = 'test' AND md5(text) IN (SELECT md5(text) FROM {D} WHERE split = 'train')")
def exact_overlap(spark, d):
    test, train = halves(spark, d)
    return o.leaked(test.withColumn("h", F.md5("text")), train.withColumn("h", F.md5("text")), ["h"]).select("doc_id")


@plans.add("q075_overlap_by_group", f"WITH x AS (SELECT *, md5(text) AS h FROM {D}) SELECT lang, count(*) AS n, count(hit) AS leaked, count(hit) / count(*) AS share FROM (SELECT x.lang, y.h AS hit FROM x LEFT JOIN (SELECT DISTINCT lang, h FROM x WHERE split = 'train') y ON x.h = y.h AND x.lang = y.lang WHERE split = 'test') GROUP BY lang")
def overlap_by_group(spark, d):
    test, train = (x.withColumn("h", F.md5("text")) for x in halves(spark, d))
    return o.leak_report(test, train, ["lang"], ["lang", "h"])


@plans.add("q075_label_agreement", f"""WITH x AS (SELECT *, md5(text) AS h FROM {D}), l AS (SELECT lang, h, arg_max(source, doc_id) AS s FROM x WHERE split = 'train' GROUP BY 1, 2)
SELECT lang, count(*) AS leaked, avg((source = s)::INT::DOUBLE) AS agree FROM x JOIN l USING (lang, h) WHERE split = 'test' GROUP BY lang""")
def label_agreement(spark, d):
    test, train = (x.withColumn("h", F.md5("text")) for x in halves(spark, d))
    return o.label_agreement(test, train, ["lang"], "h", "source", "doc_id")


_NORM = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@plans.add("q076_normalized_overlap", f"WITH x AS (SELECT *, md5({_NORM}) AS h, md5(text) AS e FROM {D}) SELECT count(*) AS n, sum((e IN (SELECT e FROM x WHERE split = 'train'))::INT)::BIGINT AS exact, sum((h IN (SELECT h FROM x WHERE split = 'train'))::INT)::BIGINT AS normalized FROM x WHERE split = 'test'")
def normalized_overlap(spark, d):
    test, train = (x.select(F.md5("text").alias("e"), F.md5(o.normalized(F.col("text"))).alias("h")) for x in halves(spark, d))
    x = test.join(train.select("e").distinct().withColumn("a", F.lit(1)), "e", "left").join(train.select("h").distinct().withColumn("b", F.lit(1)), "h", "left")
    return x.agg(F.count("*").alias("n"), F.count("a").alias("exact"), F.count("b").alias("normalized"))


@plans.add("q117_duplicate_conflicts", f"SELECT grp, sum(c)::BIGINT AS copies, count(*) AS labels, max(c) AS majority FROM (SELECT grp, gold, count(*) AS c FROM ({DOC_CLASSES_SQL}) GROUP BY 1, 2) GROUP BY grp HAVING sum(c) > 1")
def duplicate_conflicts(spark, d):
    return o.duplicate_conflicts(doc_classes(spark, d), "grp", "gold")


@plans.add("q117_copies_histogram", "SELECT copies, count(*) AS keys FROM (SELECT md5(text) AS h, count(*) AS copies FROM documents GROUP BY 1) GROUP BY 1")
def copies_histogram(spark, d):
    return o.copies_histogram(table(spark, d, "documents").select(F.md5("text").alias("h")), "h")


@plans.add("q078_clean_split", f"WITH x AS (SELECT *, md5(text) AS h FROM {D}) SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS k FROM x WHERE split = 'train') WHERE k = 1 AND h NOT IN (SELECT h FROM x WHERE split = 'test')")
def clean_split(spark, d):
    test, train = (x.withColumn("h", F.md5("text")) for x in halves(spark, d))
    return o.clean_split(train, test, "h", "doc_id").select("doc_id")


@plans.add("q077_alignment", f"SELECT md5(text) AS h, count(DISTINCT split) AS parts, count(DISTINCT source) AS places FROM {D} GROUP BY 1 HAVING count(DISTINCT split) > 1")
def alignment(spark, d):
    return o.alignment(split_documents(spark, d).withColumn("h", F.md5("text")), "h", "split", "source")


@plans.add("q089_shared_in_all", "SELECT md5(text) AS h FROM documents GROUP BY 1 HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM documents)")
def shared_in_all(spark, d):
    return o.shared_in_all(table(spark, d, "documents").select(F.md5("text").alias("h"), "lang"), "h", "lang")


def _grams(source: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, md5(array_to_string(w[i:i + 7], ' ')) AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}, string_split({_NORM}, ' ') AS w FROM {source}) WHERE len(w) >= 8)"


@plans.add("q074_benchmark_ngrams", f"WITH q AS ({_grams('benchmark', 'item_id')}), c AS ({_grams('documents', 'doc_id')}), z AS (SELECT item_id, count(*) AS size FROM q GROUP BY 1) SELECT item_id, doc_id, count(*) AS shared, count(*) / any_value(size) AS share FROM q JOIN c USING (gram) JOIN z USING (item_id) GROUP BY 1, 2")
def benchmark_ngrams(spark, d):
    """Benchmark items and the documents that hold eight of their words in a row."""
    return o.ngram_overlap(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", "text")


@plans.add("q190_novel_split", f"SELECT source, count(*) AS n FROM {D} WHERE split = 'train' AND source NOT IN ('src1', 'src2') GROUP BY 1")
def novel_split(spark, d):
    """Train rows without the sources held back as novel."""
    novel = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return split_documents(spark, d).where("split = 'train'").join(novel, "source", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@plans.add("q042_normalize", "SELECT doc_id, lower(trim(source)) AS label, coalesce(lang, '') || chr(10) || coalesce(source, '') AS joined FROM documents")
def normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", t.normalize_label(F.col("source")).alias("label"), t.row_text("lang", "source").alias("joined"))


_RAW = """CASE doc_id % 8 WHEN 0 THEN 'yes' WHEN 1 THEN ' Yes. ' WHEN 2 THEN 'Answer: **no**' WHEN 3 THEN 'The label is maybe' WHEN 4 THEN 'I would not say yes, so no' WHEN 5 THEN 'yes or no' WHEN 6 THEN NULL ELSE 'unsure' END"""
LABELS = ["yes", "no", "maybe"]


def answers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_RAW).alias("raw"))


@plans.add("q046_resolve", f"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' WHEN 3 THEN 'maybe' END AS label FROM documents")
def resolve(spark, d):
    return answers(spark, d).select("doc_id", t.resolve(F.col("raw"), LABELS).alias("label"))


@plans.add("q050_score_prediction", "SELECT doc_id % 8 AS kind, avg((doc_id % 8 IN (2, 4))::INT::DOUBLE) AS score FROM documents GROUP BY 1")
def score_prediction(spark, d):
    """Against `no`: unresolved or ambiguous answers score 0, a negated label isn't meant."""
    return answers(spark, d).groupBy((F.col("doc_id") % 8).alias("kind")).agg(F.avg(t.score_prediction(F.lit("no"), F.col("raw"), LABELS)).alias("score"))


#: Answers with the score of the gold label `positive` among (positive, negative).
NEGATION_CASES = (
    ("positive", 1), ("not positive", 0), ("it isn't positive", 0), ("I cannot call it positive", 0), ("it is positive", 1), ("don't say negative, say positive", 1), ("positive rather than negative", 1), ("negative rather than positive", 0),
    ("unlike the first, positive", 1), ("never negative but positive", 1), ("not negative whereas positive", 1), ("The sentiment is positive.", 1), ("positive or negative", 0), ("non positive", 0), ("not sure. definitely positive", 1), ("knot positive", 1),
)
_CASES_SQL = ", ".join(f"({i}, {s})" for i, (_, s) in enumerate(NEGATION_CASES))


@plans.add("q048_negation", f"SELECT k, score, count(*) AS n FROM documents JOIN (VALUES {_CASES_SQL}) v(k, score) ON doc_id % {len(NEGATION_CASES)} = k GROUP BY 1, 2")
def negation(spark, d):
    """Denied labels aren't meant; a label is denied only if a negator stands before each of its mentions in its clause."""
    said = F.element_at(F.array(*[F.lit(a) for a, _ in NEGATION_CASES]), (F.col("doc_id") % len(NEGATION_CASES) + 1).cast("int"))
    x = table(spark, d, "documents").select((F.col("doc_id") % len(NEGATION_CASES)).alias("k"), said.alias("raw"))
    return x.groupBy("k", t.score_prediction(F.lit("positive"), F.col("raw"), ["positive", "negative"]).alias("score")).agg(F.count("*").alias("n"))


@plans.add("q051_lenient", "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' WHEN 3 THEN 'maybe' WHEN 4 THEN 'yes' WHEN 5 THEN 'yes' END AS label FROM documents")
def lenient(spark, d):
    return answers(spark, d).select("doc_id", t.lenient_label(F.col("raw"), LABELS).alias("label"))


@plans.add("q049_sentences", "SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?;\\n]'), lambda x: trim(x, ' ')), lambda x: x <> ''))::INT AS n FROM documents")
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(t.sentences(F.col("text"))).alias("n"))


_QA = r"""list_filter(regexp_split_to_array(regexp_replace(lower({}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"""


@plans.add("q055_qa_tokens", f"""WITH s AS (SELECT item_id, {_QA.format("list_filter(list_transform(regexp_split_to_array(text, '[.!?;\n]'), lambda x: trim(x)), lambda x: x <> '')[1]")} AS a, {_QA.format("text")} AS b FROM benchmark),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0)::DOUBLE AS c FROM s)
SELECT item_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN (len(a) = len(b))::INT::DOUBLE WHEN c = 0 THEN 0.0 ELSE 2 * (c / len(a)) * (c / len(b)) / (c / len(a) + c / len(b)) END AS f1 FROM c""")
def qa_tokens(spark, d):
    """F1 of each benchmark item's first sentence against the whole item."""
    b = table(spark, d, "benchmark")
    return b.select("item_id", t.token_f1(F.element_at(t.sentences(F.col("text")), 1), F.col("text")).alias("f1"))


@plans.add("q056_fields_equal", "SELECT doc_id % 5 AS kind, bool_and(doc_id % 5 < 4) AS equal FROM documents GROUP BY 1")
def fields_equal(spark, d):
    k = F.col("doc_id") % 5
    a = F.when(k == 0, "a").when(k == 1, "2024-01-31").when(k == 2, "$1,000").when(k == 3, "The end!").otherwise("x")
    b = F.when(k == 0, "a").when(k == 1, "2024/01/31").when(k == 2, "1000.0").when(k == 3, "end").otherwise("y")
    return table(spark, d, "documents").groupBy(k.alias("kind")).agg(F.bool_and(t.fields_equal(a, b)).alias("equal"))


@plans.add("q057_valid_json", "SELECT event_type, avg((json_extract(props, '$.k') IS NOT NULL)::INT::DOUBLE) AS valid FROM events GROUP BY 1")
def valid_json(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.avg(t.valid_json(F.col("props"), ["k"]).cast("double")).alias("valid"))


@plans.add("q170_edge_window", f"SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM {T}) WHERE a <= 1 OR z <= 2")
def edge_window(spark, d):
    return s.edge_window(turns(spark, d), "conv_id", "turn", 1, 2).select("conv_id", "turn")


@plans.add("q169_recency", f"SELECT conv_id, turn, least(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1, 3)::INT AS bucket FROM {T}")
def recency(spark, d):
    return s.recency(turns(spark, d), "conv_id", "turn", 3).select("conv_id", "turn", "bucket")


@plans.add("q289_tagged_tokens", f"SELECT conv_id, turn, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: 'r' || b || '_' || w) AS tokens FROM (SELECT *, least(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1, 3)::INT AS b FROM {T})")
def tagged_tokens(spark, d):
    return s.tagged_tokens(s.recency(turns(spark, d), "conv_id", "turn", 3), "text", "bucket").select("conv_id", "turn", "tokens")


@plans.add("q081_contexts", f"SELECT conv_id, turn, list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS context FROM {T}".replace("list(coalesce", "list(coalesce"))
def contexts(spark, d):
    x = s.contexts(turns(spark, d), "conv_id", "turn", "text", 3)
    return x.select("conv_id", "turn", F.when(F.size("context") > 0, F.col("context")).alias("context"))


_H = f"""h AS (SELECT conv_id, turn, act, lag(act, 1) OVER w AS h1, lag(act, 2) OVER w AS h2 FROM {T} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT 0 AS n, '' AS context, act AS label FROM h UNION ALL SELECT 1, h1::VARCHAR, act FROM h WHERE h1 IS NOT NULL UNION ALL SELECT 2, h1::VARCHAR || ',' || h2::VARCHAR, act FROM h WHERE h2 IS NOT NULL),
c AS (SELECT n, context, label, count(*) AS c FROM r GROUP BY 1, 2, 3), b AS (SELECT n, context, label AS best, sum(c) OVER (PARTITION BY n, context) AS total, row_number() OVER (PARTITION BY n, context ORDER BY c DESC, label) AS k FROM c)"""


@plans.add("q171_ngram_table", f"WITH {_H} SELECT n, context, best, total::BIGINT AS total FROM b WHERE k = 1")
def ngram_table(spark, d):
    return s.ngram_table(turns(spark, d), "conv_id", "turn", "act", 2)


@plans.add("q171_backoff", f"""WITH {_H} SELECT h.conv_id, h.turn, coalesce(b2.best, b1.best, b0.best) AS pred, CASE WHEN b2.best IS NOT NULL THEN 2 WHEN b1.best IS NOT NULL THEN 1 ELSE 0 END AS used FROM h
LEFT JOIN b b2 ON b2.k = 1 AND b2.n = 2 AND b2.context = h1::VARCHAR || ',' || h2::VARCHAR LEFT JOIN b b1 ON b1.k = 1 AND b1.n = 1 AND b1.context = h1::VARCHAR LEFT JOIN b b0 ON b0.k = 1 AND b0.n = 0""")
def backoff(spark, d):
    x = turns(spark, d)
    return s.backoff(x, s.ngram_table(x, "conv_id", "turn", "act", 2), "conv_id", "turn", "act", 2).select("conv_id", "turn", "pred", "used")


@plans.add("q171_free_run")
def free_run(spark, d):
    """Predictions that feed their own history."""
    x = turns(spark, d)
    best = [(r["n"], r["context"], r["best"]) for r in s.ngram_table(x, "conv_id", "turn", "act", 2).collect()]  # 9 + 9^2 + 1 rows at most
    return s.free_run(x, best, "conv_id", "turn", "act", 2)


@plans.add("q130_hits_at_k", f"SELECT k, avg((r <= k)::INT::DOUBLE) AS recall FROM (SELECT x.act, f.r FROM {T} x JOIN (SELECT act, row_number() OVER (ORDER BY count(*) DESC, act) AS r FROM {T} GROUP BY act) f USING (act)), (SELECT unnest([1, 3, 5]) AS k) GROUP BY k")
def hits_at_k(spark, d):
    """Recall of the constant ranking of acts by frequency."""
    x = turns(spark, d)
    rank = x.groupBy("act").agg(F.count("*").alias("c")).select("act", F.row_number().over(Window.orderBy(F.desc("c"), "act")).alias("r"))  # nine rows
    return x.join(F.broadcast(rank), "act").withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).groupBy("k").agg(F.avg((F.col("r") <= F.col("k")).cast("double")).alias("recall"))


@plans.add("q132_grouped_constant", f"""WITH f AS (SELECT role, act, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, act) AS r FROM {T} GROUP BY 1, 2), h AS (SELECT x.role, (f.r <= 3)::INT::DOUBLE AS hit FROM {T} x JOIN f ON f.role = x.role AND f.act = x.act)
SELECT (SELECT avg(hit) FROM h) AS micro, avg(m) AS macro FROM (SELECT role, avg(hit) AS m FROM h GROUP BY role)""")
def grouped_constant(spark, d):
    x = turns(spark, d)
    rank = x.groupBy("role", "act").agg(F.count("*").alias("c")).select("role", "act", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("c"), "act")).alias("r"))
    per = x.join(F.broadcast(rank), ["role", "act"]).groupBy("role").agg(F.sum((F.col("r") <= 3).cast("long")).alias("h"), F.count("*").alias("n"))
    return per.agg((F.sum("h") / F.sum("n")).alias("micro"), F.avg(F.col("h") / F.col("n")).alias("macro"))


@plans.add("q139_skeletons", f"SELECT skeleton, count(*) AS n, format('S{{:06d}}', row_number() OVER (ORDER BY count(*) DESC, skeleton) - 1) AS id FROM (SELECT conv_id, string_agg(act::VARCHAR, '-' ORDER BY turn) AS skeleton FROM {T} GROUP BY 1) GROUP BY 1")
def skeletons(spark, d):
    return s.skeletons(turns(spark, d), "conv_id", "turn", "act")


@plans.add("q136_templates", f"SELECT act, text, count(*) AS n, list_sort(list_distinct(list(conv_id)))[1:3] AS examples FROM {T} GROUP BY 1, 2 HAVING count(*) >= 2")
def templates(spark, d):
    return s.templates(turns(spark, d), ["act"], "text", "conv_id", 2, 3)


@plans.add("q082_first_disclosure", f"""WITH v AS (SELECT conv_id, string_split(text, ' ')[1] AS value FROM {T} WHERE turn = 1) SELECT v.conv_id, v.value, min(x.turn) AS disclosed_at FROM v JOIN {T} x USING (conv_id) WHERE regexp_matches(x.text, '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape(v.value) || '($|[^\\p{{L}}\\p{{N}}])') GROUP BY 1, 2""")
def first_disclosure(spark, d):
    x = turns(spark, d)
    values = x.where("turn = 1").select("conv_id", F.element_at(F.split("text", " "), 1).alias("value"))
    return s.first_disclosure(values, x.select("conv_id", "turn", "text"), "conv_id", "turn", "text", "value")


@plans.add("q081_available")
def available(spark, d):
    x = turns(spark, d)
    return s.available(first_disclosure(spark, d), x, "conv_id", "turn", "value")


@plans.add("q357_serialize", f"SELECT conv_id, turn, len(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS before, role FROM {T} QUALIFY role = 'assistant'".replace("len(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"))
def serialize(spark, d):
    x = s.serialize(turns(spark, d), "conv_id", "turn", "role", "text", "assistant")
    return x.select("conv_id", "turn", F.size("messages").cast("long").alias("before"), F.lit("assistant").alias("role"))


_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


@plans.add("q084_nearest", f"SELECT query, neighbour, similarity, rank FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, {_COS} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10")
def nearest(spark, d):
    e = table(spark, d, "embeddings")
    return v.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, 6)


@plans.add("q085_nearest_with_ties", f"SELECT query, neighbour, similarity, rank FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round({_COS}, 2) AS similarity, rank() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 2) DESC) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 5")
def nearest_with_ties(spark, d):
    e = table(spark, d, "embeddings")
    return v.nearest_with_ties(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5, 2)


@plans.add("q088_novelty", f"SELECT a.vec_id AS query, 1 - max({_COS}) AS novelty FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1")
def novelty(spark, d):
    e = table(spark, d, "embeddings")
    return v.novelty(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 6)


_CENTROID = f"""x AS (SELECT i.fold, e.label, e.vec_id, e.embedding, generate_subscripts(e.embedding, 1) AS i, unnest(e.embedding)::DOUBLE AS x FROM embeddings e JOIN ({ITEMS_SQL}) i ON i.item_id = e.vec_id),
c AS (SELECT fold, label, i, sum(x) AS s, count(*) AS n FROM x GROUP BY 1, 2, 3), m AS (SELECT fold, label, i, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS m FROM c WINDOW w AS (PARTITION BY label, i)),
d AS (SELECT x.vec_id, m.label AS cls, round(sum((x.x - m.m) * (x.x - m.m)), 6) AS d FROM x JOIN m ON m.fold = x.fold AND m.i = x.i GROUP BY 1, 2)"""


@plans.add("q293_centroid_model", f"WITH {_CENTROID} SELECT vec_id AS item_id, arg_min(cls, d * 1000000000 + cls) AS pred, round(max(exp(-d)) / sum(exp(-d)), 6) AS conf FROM d GROUP BY 1")
def centroid_model(spark, d):
    x = items(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    return v.centroid_model(x, "fold", "gold", "item_id", "embedding", 6).select("item_id", "pred", F.round("conf", 6).alias("conf"))


@plans.add("q087_shortlist")
def shortlist(spark, d):
    x = items(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    labels = v.fold_centroids(x, "fold", "gold", "embedding").where("fold = 0").select(F.col("gold").alias("label"), "centroid")
    return v.shortlist(x, labels, "item_id", "embedding", "label", "centroid", 3)


@plans.add("q079_usage_totals", f"SELECT count(*) AS requests, count(DISTINCT email) AS users, sum((status = 'error')::INT)::BIGINT AS errors, avg(CASE WHEN status = 'ok' THEN ms END) AS mean_ok_ms FROM {L}")
def usage_totals(spark, d):
    return us.totals(requests(spark, d))


@plans.add("q079_usage_users", f"""WITH k AS (SELECT email, day, count(*) AS n, max(ts) AS last FROM {L} GROUP BY 1, 2), l AS (SELECT DISTINCT email, 7 AS daily_limit FROM {L} WHERE email LIKE 'user1%')
SELECT k.email, sum(n)::BIGINT AS requests, max(last) AS last_seen, max(n) AS busiest, coalesce(any_value(daily_limit), 50)::INT AS daily_limit FROM k LEFT JOIN l ON l.email = k.email GROUP BY 1""")
def usage_users(spark, d):
    log = requests(spark, d)
    limits = log.where("email like 'user1%'").select("email").distinct().withColumn("daily_limit", F.lit(7))
    return us.per_user(log, limits, 50)


@plans.add("q313_daily", f"""WITH s AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM {L}), k AS (SELECT day, count(*) AS r, count(DISTINCT email) AS u, sum((status = 'error')::INT)::BIGINT AS e FROM {L} GROUP BY 1)
SELECT s.day, coalesce(r, 0) AS requests, coalesce(u, 0) AS users, coalesce(e, 0) AS errors FROM s LEFT JOIN k USING (day)""")
def daily(spark, d):
    return us.daily(requests(spark, d))


@plans.add("q313_trailing", f"""WITH s AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM {L}), k AS (SELECT day, count(*) AS r FROM {L} GROUP BY 1), x AS (SELECT s.day, coalesce(r, 0) AS requests FROM s LEFT JOIN k USING (day))
SELECT day, requests, sum(requests) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS trailing FROM x""")
def trailing(spark, d):
    return us.trailing(requests(spark, d), 7)


@plans.add("q310_quota", f"SELECT event_id, taken, taken > 3 AS refused FROM (SELECT event_id, row_number() OVER (PARTITION BY email, day ORDER BY ts, event_id) AS taken FROM {L})")
def quota(spark, d):
    return us.quota(requests(spark, d), 3).select("event_id", "taken", "refused")


@plans.add("q143_tiers", f"SELECT path, any_value(n) AS n, sum((status = 'error')::INT)::BIGINT AS errors, max(CASE WHEN k = least(floor(n * 0.5), n - 1) THEN ms END) AS p50, max(CASE WHEN k = least(floor(n * 0.9), n - 1) THEN ms END) AS p90 FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY path) AS n FROM {L}) GROUP BY path")
def tiers(spark, d):
    return us.tiers(requests(spark, d), ["path"], "ms", [0.5, 0.9])


@plans.add("q188_recent", f"SELECT event_id, email, ts FROM {L} ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent(spark, d):
    return requests(spark, d).select("event_id", "email", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(25)


@plans.add("q314_budget", f"SELECT event_id, round(sum(c) OVER (PARTITION BY day ORDER BY ts, event_id), 6) AS spent, round(sum(c) OVER (PARTITION BY day ORDER BY ts, event_id), 6) <= 20 AS allowed FROM (SELECT *, round({u_sql(83, 'event_id')}, 3) AS c FROM {L})")
def budget(spark, d):
    return us.budget(requests(spark, d).withColumn("c", F.round(u(83, "event_id"), 3)), "c", 20.0).select("event_id", "spent", "allowed")


@plans.add("q_sessions", f"""WITH g AS (SELECT email, ts, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE)::INT AS b FROM {L} WINDOW w AS (PARTITION BY email ORDER BY ts)), n AS (SELECT *, sum(b) OVER (PARTITION BY email ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT email, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM n GROUP BY email, k""")
def sessions(spark, d):
    return us.sessions(requests(spark, d), "30 minutes")


@plans.add("q_rollup_micro_macro", f"SELECT path, status, count(*) AS n, avg(ms) AS ms FROM {L} GROUP BY GROUPING SETS ((path, status), (path), ())")
def rollup(spark, d):
    return requests(spark, d).rollup("path", "status").agg(F.count("*").alias("n"), F.avg("ms").alias("ms"))


@plans.add("q_star_revenue", "SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def star_revenue(spark, d):
    read = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation")}
    x = read["lineitem"].join(read["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(read["customer"], F.col("o_custkey") == F.col("c_custkey")).join(read["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("n"))
