"""Queries on document units, committees and named functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.functions import registry
from gatewright.functions import text as t
from gatewright.operators import units as un
from gatewright.plans.base import Plans
from gatewright.sources.fixtures import PAIR_LOG_SQL, REPEATS_SQL, pair_log, repeats, table

plans = Plans()
P, R = f"({PAIR_LOG_SQL})", f"({REPEATS_SQL})"


@plans.add("q060_masked_sentences", "SELECT c_custkey, 3 AS sentences, 'Ask {mr. x. y} now.' AS second FROM customer")
def masked_sentences(spark, d):
    """No sentence ends within a marker."""
    said = F.concat(F.lit("Hello "), F.col("c_name"), F.lit("! Ask {mr. x. y} now. Is it done? "))
    s = un.masked_sentences(said)
    return table(spark, d, "customer").select("c_custkey", F.size(s).alias("sentences"), F.element_at(s, 2).alias("second"))


@plans.add("q279_units")
def units(spark, d):
    """Sentences of whole documents packed into units of 80 to 300 characters."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", un.pack_units(t.sentences(F.col("text")), 80, 300).alias("u"))
    return x.select("doc_id", F.posexplode("u").alias("unit", "text")).select("doc_id", "unit", F.md5("text").alias("h"), F.char_length("text").alias("n"))


@plans.add("q299_clauses", "SELECT c_custkey, ['Fees: first of ' || c_name, 'Fees: second', 'third', 'fourth'] AS clauses FROM customer")
def clauses(spark, d):
    said = F.concat(F.lit("Fees:\nfirst of "), F.col("c_name"), F.lit("; second ;\nthird; fourth\n\n"))
    return table(spark, d, "customer").select("c_custkey", un.clause_units(said).alias("clauses"))


_DUE = "'due 2024-03-0' || (o_custkey % 9 + 1)::VARCHAR || ' or $' || (o_orderkey * 1000)::VARCHAR || '.50 plus 7% of ' || o_custkey::VARCHAR"


@plans.add("q298_spans", f"SELECT o_orderkey, regexp_extract_all({_DUE}, '([$€£] ?[0-9][0-9,]*(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)? ?%|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]+)', 1) AS found, ['date', 'money', 'percent', 'number'] AS types FROM orders")
def spans(spark, d):
    said = F.concat(F.lit("due 2024-03-0"), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit(" or $"), (F.col("o_orderkey") * 1000).cast("string"), F.lit(".50 plus 7% of "), F.col("o_custkey").cast("string"))
    s = un.spans(said)
    return table(spark, d, "orders").select("o_orderkey", F.transform(s, lambda x: x["value"]).alias("found"), F.transform(s, lambda x: x["type"]).alias("types"))


@plans.add("q304_parties", "SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN ['tenant', 'landlord'] ELSE ['seller', 'buyer'] END AS parties FROM customer")
def parties(spark, d):
    said = F.expr("CASE c_custkey % 2 WHEN 0 THEN 'Tenants pay; the Landlord repairs, the tenant waits' ELSE 'A seller, buyers, subtenants and the Seller' END")
    return table(spark, d, "customer").select("c_custkey", un.parties(said).alias("parties"))


_PHRASES = {"the": "neutral", "of the": "genitive", "of": "of", "and": "and", "that": "that", "der": "neutral"}


@plans.add("q094_concepts", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\b(of the|that|and|der|the|of)\\b', 1)) AS p FROM documents) SELECT doc_id, count(*) AS n, count(CASE WHEN p = 'of the' THEN 1 END) AS genitives FROM w WHERE p NOT IN ('the', 'der') GROUP BY 1")
def concepts(spark, d):
    """Longest phrases from left to right."""
    x = table(spark, d, "documents").select("doc_id", F.explode(un.concepts(F.col("text"), _PHRASES)).alias("c"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("c") == "genitive").alias("genitives"))


@plans.add("q073_members", f"SELECT item_id, max(CASE WHEN repeat = 0 THEN free_pred END) AS r0, max(CASE WHEN repeat = 1 THEN free_pred END) AS r1, max(llm_pred) AS llm FROM {R} WHERE item_id % 3 > 0 AND repeat < 2 GROUP BY 1")
def members(spark, d):
    """A column per committee member, for the items that all of them have."""
    r, p = repeats(spark, d), pair_log(spark, d)
    return un.committee({"r0": r.where("repeat = 0").select("item_id", F.col("free_pred").alias("p")), "r1": r.where("repeat = 1").select("item_id", F.col("free_pred").alias("p")), "llm": p.where("item_id % 3 > 0").select("item_id", F.col("llm_pred").alias("p"))}, "item_id", "p")


@plans.add("q095_zip_by_id", f"SELECT p.item_id, p.gold, r.free_pred, p.llm_pred FROM {P} p JOIN {R} r USING (item_id) WHERE r.repeat = 1")
def zip_by_id(spark, d):
    """What another engine aligns by place is aligned by the item's id."""
    return pair_log(spark, d).select("item_id", "gold", "llm_pred").join(repeats(spark, d).where("repeat = 1").select("item_id", "free_pred"), "item_id")


_QUERY = [1.0 if i % 2 else -0.5 for i in range(64)]


@plans.add("q091_reader_pick")
def reader_pick(spark, d):
    """Units of a document (here documents of a source with the vector of their id) by words, then by vector."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    x = table(spark, d, "documents").join(e, "doc_id").where("text is not null")
    return un.reader_pick(x, ["the", "of", "der", "que"], "source", "doc_id", "text", "embedding", _QUERY, 2, 2)


@plans.add("q_named_functions", "SELECT c_mktsegment AS segment, lower(trim(c_mktsegment)) AS label, sum(w) * sum(w) / sum(w * w) AS n_effective FROM (SELECT c_mktsegment, (1 + c_custkey % 3)::DOUBLE AS w FROM customer) GROUP BY 1, 2")
def named_functions(spark, d):
    """Functions by name in SQL: an expression and an aggregate."""
    registry.register_all(spark)
    table(spark, d, "customer").createOrReplaceTempView("gw_customer")
    return spark.sql("SELECT c_mktsegment AS segment, gw_normalize_label(c_mktsegment) AS label, gw_kish_n(CAST(1 + c_custkey % 3 AS DOUBLE)) AS n_effective FROM gw_customer GROUP BY 1, 2")


@plans.add("q_named_table_function", r"SELECT doc_id, count(*) AS sentences FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?;\n]'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents) GROUP BY 1")
def named_table_function(spark, d):
    """A table function by name, joined sideways."""
    registry.register_all(spark)
    table(spark, d, "documents").createOrReplaceTempView("gw_documents")
    return spark.sql("SELECT doc_id, count(*) AS sentences FROM gw_documents, LATERAL gw_sentences(text) GROUP BY doc_id")
