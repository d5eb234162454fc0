"""Queries on prices, selection, routing tiers, answer scores and result maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatewright.functions import stats
from gatewright.functions import text as t
from gatewright.operators import ordered
from gatewright.operators import overlap as o
from gatewright.plans.base import Plans
from gatewright.sources import files
from gatewright.sources.fixtures import PAIR_LOG_SQL, PROBA_SQL, REPEATS_SQL, TURNS_SQL, doc_classes, pair_log, proba, repeats, table, turns, u, u_sql, DOC_CLASSES_SQL

plans = Plans()
P, Q, R, T = f"({PAIR_LOG_SQL})", f"({PROBA_SQL})", f"({REPEATS_SQL})", f"({TURNS_SQL})"

#: Example price card: USD per million tokens, output limit. A missing cached rate is null.
PRICES = [("small", 0.1, 0.4, 0.02, 4096), ("medium", 0.6, 2.2, None, 8192), ("large", 3.0, 15.0, 0.3, 64000), ("free", 0.0, 0.0, None, 2048)]
_PRICES_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in PRICES) + ") AS m(model, price_in, price_out, price_cached, out_limit)"


def prices(spark):
    return spark.createDataFrame(PRICES, "model string, price_in double, price_out double, price_cached double, out_limit int")


@plans.add("q237_call_costs", f"SELECT model, sum(((in_tokens - cached_tokens) * price_in + cached_tokens * coalesce(price_cached, price_in) + out_tokens * price_out) / 1e6::DOUBLE) AS usd, 1000 * avg(((in_tokens - cached_tokens) * price_in + cached_tokens * coalesce(price_cached, price_in) + out_tokens * price_out) / 1e6::DOUBLE) AS usd_per_1k FROM {P}, {_PRICES_SQL} GROUP BY model")
def call_costs(spark, d):
    """Cost of the log under each price card (a card has a few rows)."""
    c = stats.call_cost(F.col("in_tokens"), F.col("out_tokens"), F.col("cached_tokens"), F.col("price_in"), F.col("price_out"), F.col("price_cached"))
    return pair_log(spark, d).join(F.broadcast(prices(spark)), F.lit(True)).groupBy("model").agg(F.sum(c).alias("usd"), (1000 * F.avg(c)).alias("usd_per_1k"))


@plans.add("q326_screening", f"SELECT model, CASE WHEN out_limit < need THEN 'rejected' WHEN price_cached IS NULL AND price_in > 0 THEN 'unverified' WHEN price_in = 0 THEN 'unavailable' ELSE 'runnable' END AS bucket, need FROM {_PRICES_SQL}, (SELECT max(out_tokens) * 50 AS need FROM {P})")
def screening(spark, d):
    """Models by what the longest output needs; a model of unknown cached rate is unverified."""
    need = pair_log(spark, d).agg((F.max("out_tokens") * 50).alias("need"))
    bucket = F.when(F.col("out_limit") < F.col("need"), "rejected").when(F.col("price_cached").isNull() & (F.col("price_in") > 0), "unverified").when(F.col("price_in") == 0, "unavailable").otherwise("runnable")
    return prices(spark).crossJoin(need).select("model", bucket.alias("bucket"), "need")  # one row


@plans.add("q243_price_drift", f"SELECT model FROM {_PRICES_SQL} WHERE (model, price_in) NOT IN (VALUES ('small', 0.1::DOUBLE), ('large', 2.5::DOUBLE), ('free', 0.0::DOUBLE))")
def price_drift(spark, d):
    """Stored rates without a matching meter."""
    meters = spark.createDataFrame([("small", 0.1), ("large", 2.5), ("free", 0.0)], "model string, price_in double")
    return prices(spark).join(meters, ["model", "price_in"], "left_anti").select("model")


@plans.add("q331_argmax", f"SELECT item_id, list_position(proba, list_max(proba)) - 1 AS pred, list_max(proba) AS p FROM {Q}")
def argmax(spark, d):
    return proba(spark, d).select("item_id", (F.array_position("proba", F.array_max("proba")) - 1).cast("int").alias("pred"), F.array_max("proba").alias("p"))


@plans.add("q333_softmax", f"SELECT item_id, list_sum(list_transform(proba, lambda x: exp(x - list_max(proba)))) AS total, 1 / list_sum(list_transform(proba, lambda x: exp(x - list_max(proba)))) AS top FROM {Q}")
def softmax(spark, d):
    x = proba(spark, d).withColumn("m", F.array_max("proba")).withColumn("e", F.expr("transform(proba, x -> exp(x - m))"))
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    return x.select("item_id", total.alias("total"), (1 / total).alias("top"))


@plans.add("q278_route_scores", f"SELECT item_id, proba[10] AS p_none, list_reverse_sort(proba[1:9])[1] - list_reverse_sort(proba[1:9])[2] AS gap, proba[10] < 0.2::DOUBLE AND list_reverse_sort(proba[1:9])[1] - list_reverse_sort(proba[1:9])[2] > 0.1::DOUBLE AS accepted FROM {Q}")
def route_scores(spark, d):
    """The last class stands for no option; accepted: it is unlikely and the first option is ahead."""
    top = F.sort_array(F.slice("proba", 1, 9), asc=False)
    gap = F.element_at(top, 1) - F.element_at(top, 2)
    return proba(spark, d).select("item_id", F.element_at("proba", 10).alias("p_none"), gap.alias("gap"), ((F.element_at("proba", 10) < 0.2) & (gap > 0.1)).alias("accepted"))


@plans.add("q277_document_answer", f"SELECT gold, CASE WHEN max(free_conf) >= 0.95::DOUBLE THEN 'yes' ELSE 'no' END AS answer, arg_max(item_id, free_conf) AS evidence, count(*) AS units FROM {P} GROUP BY gold")
def document_answer(spark, d):
    """Units of a document: yes if any is confident, with the most confident as evidence."""
    return pair_log(spark, d).groupBy("gold").agg(F.when(F.max("free_conf") >= 0.95, "yes").otherwise("no").alias("answer"), F.max_by("item_id", "free_conf").alias("evidence"), F.count("*").alias("units"))


@plans.add("q154_oracle_gate", f"SELECT avg((free_ok = 0)::INT::DOUBLE) AS sent, avg(CASE WHEN free_ok = 0 THEN llm_ok ELSE free_ok END::DOUBLE) AS accuracy FROM {P}")
def oracle_gate(spark, d):
    return pair_log(spark, d).agg(F.avg((F.col("free_ok") == 0).cast("double")).alias("sent"), F.avg(F.when(F.col("free_ok") == 0, F.col("llm_ok")).otherwise(F.col("free_ok"))).alias("accuracy"))


@plans.add("q_three_tiers", f"""SELECT gold, n, acc, CASE WHEN acc >= 0.73::DOUBLE THEN 'tier0' WHEN llm >= 0.74::DOUBLE THEN 'tier1' ELSE 'tier2' END AS tier, sum(n * CASE WHEN acc >= 0.73::DOUBLE THEN acc ELSE llm END) OVER () / sum(n) OVER () AS blended
FROM (SELECT gold, count(*) AS n, avg(free_ok::DOUBLE) AS acc, avg(llm_ok::DOUBLE) AS llm FROM {P} GROUP BY gold)""")
def three_tiers(spark, d):
    """Per class the cheapest tier near the bar, and the accuracy of the blend weighted by class counts."""
    k = pair_log(spark, d).groupBy("gold").agg(F.count("*").alias("n"), F.avg("free_ok").alias("acc"), F.avg("llm_ok").alias("llm"))
    every = Window.partitionBy()  # one row a class
    used = F.when(F.col("acc") >= 0.73, F.col("acc")).otherwise(F.col("llm"))
    return k.select("gold", "n", "acc", F.when(F.col("acc") >= 0.73, "tier0").when(F.col("llm") >= 0.74, "tier1").otherwise("tier2").alias("tier"), (F.sum(F.col("n") * used).over(every) / F.sum("n").over(every)).alias("blended"))


@plans.add("q233_repeat_verdict", f"""SELECT repeat, CASE WHEN a >= l - 0.05::DOUBLE THEN 'cheap alone' WHEN c >= l - 0.05::DOUBLE AND c > a THEN 'cascade earns' WHEN l > c THEN 'incumbent' ELSE 'unclear' END AS verdict FROM
(SELECT repeat, avg(free_ok::DOUBLE) AS a, avg(llm_ok::DOUBLE) AS l, avg(CASE WHEN kept = 1 THEN free_ok ELSE llm_ok END::DOUBLE) AS c FROM {R} GROUP BY repeat)""")
def repeat_verdict(spark, d):
    k = repeats(spark, d).groupBy("repeat").agg(F.avg("free_ok").alias("a"), F.avg("llm_ok").alias("l"), F.avg(F.when(F.col("kept") == 1, F.col("free_ok")).otherwise(F.col("llm_ok"))).alias("c"))
    return k.select("repeat", F.when(F.col("a") >= F.col("l") - 0.05, "cheap alone").when((F.col("c") >= F.col("l") - 0.05) & (F.col("c") > F.col("a")), "cascade earns").when(F.col("l") > F.col("c"), "incumbent").otherwise("unclear").alias("verdict"))


@plans.add("q236_balanced_from_recall", f"SELECT (r + (a * n - r * p) / (n - p)) / 2 AS balanced FROM (SELECT avg((free_pred = gold)::INT::DOUBLE) AS a, avg(CASE WHEN gold = 0 THEN free_ok::DOUBLE END) AS r, count(*) AS n, sum((gold = 0)::INT) AS p FROM {P})")
def balanced_from_recall(spark, d):
    """Balanced accuracy of two classes back from accuracy, recall and sizes (class 0 against the rest)."""
    k = pair_log(spark, d).agg(F.avg("free_ok").alias("a"), F.avg(F.when(F.col("gold") == 0, F.col("free_ok"))).alias("r"), F.count("*").alias("n"), F.sum((F.col("gold") == 0).cast("int")).alias("p"))
    return k.select(((F.col("r") + (F.col("a") * F.col("n") - F.col("r") * F.col("p")) / (F.col("n") - F.col("p"))) / 2).alias("balanced"))


@plans.add("q280_replay", f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY {u_sql(101, 'item_id')}, item_id) AS k FROM {P}), c AS (SELECT *, k <= 50 OR (free_conf < 0.4::DOUBLE AND sum((k > 50 AND free_conf < 0.4::DOUBLE)::INT) OVER (ORDER BY k) <= 60) AS called FROM o)
SELECT sum(called::INT)::BIGINT AS calls, avg(CASE WHEN called THEN llm_ok ELSE free_ok END::DOUBLE) AS accuracy FROM c""")
def replay(spark, d):
    """A stream in seeded order: fifty calls to warm up, then calls below a confidence until a cap of sixty is spent.
    Places and what is spent so far are running sums over ranges of the order."""
    placed = ordered.ranked(pair_log(spark, d), [], [u(101, "item_id"), F.col("item_id")], "k")
    placed = placed.withColumn("asks", (F.col("k") > 50) & (F.col("free_conf") < 0.4))
    spent = ordered.cumulate(placed, [], ["k"], {"spent": F.col("asks").cast("long")})
    called = (F.col("k") <= 50) | (F.col("asks") & (F.col("spent") <= 60))
    return spent.agg(F.sum(called.cast("long")).alias("calls"), F.avg(F.when(called, F.col("llm_ok")).otherwise(F.col("free_ok"))).alias("accuracy"))


@plans.add("q350_min_count_elasticity", f"WITH k AS (SELECT act, text, count(*) AS n FROM {T} GROUP BY 1, 2) SELECT least_n, count(*) AS templates, sum(n)::DOUBLE / (SELECT count(*) FROM {T}) AS coverage FROM k, (SELECT unnest([1, 2, 3]) AS least_n) WHERE n >= least_n GROUP BY 1")
def min_count_elasticity(spark, d):
    """Templates and coverage as the least count varies: sums over the distinct counts, not over templates per value."""
    k = turns(spark, d).groupBy("act", "text").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("templates"), F.sum("n").alias("rows"))
    total = k.agg(F.sum("rows").alias("total"))
    per = k.withColumn("least_n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("n >= least_n").groupBy("least_n").agg(F.sum("templates").alias("templates"), F.sum("rows").alias("rows"))
    return per.crossJoin(total).select("least_n", "templates", (F.col("rows") / F.col("total")).alias("coverage"))  # one row


@plans.add("q191_unseen_actions", f"WITH tr AS (SELECT DISTINCT role, act FROM {T} WHERE conv_id % 4 > 0) SELECT conv_id, turn FROM {T} x WHERE conv_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.role = x.role AND tr.act = x.act)")
def unseen_actions(spark, d):
    x = turns(spark, d)
    seen = x.where("conv_id % 4 > 0").groupBy("role").agg(F.collect_set("act").alias("seen"))  # nine acts at most
    y = x.where("conv_id % 4 = 0").join(F.broadcast(seen), "role", "left")
    return y.where(~F.coalesce(F.array_contains("seen", F.col("act")), F.lit(False))).select("conv_id", "turn")


@plans.add("q192_missing_slots", f"WITH n AS (SELECT conv_id, list(DISTINCT act) AS a FROM {T} WHERE role = 'assistant' GROUP BY 1), h AS (SELECT conv_id, list(DISTINCT act) AS b FROM {T} WHERE role = 'user' GROUP BY 1) SELECT n.conv_id, len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x)))::INT AS missing FROM n LEFT JOIN h USING (conv_id)")
def missing_slots(spark, d):
    """What the assistant needs (its acts stand for slots) less what the user gave."""
    x = turns(spark, d)
    need = x.where("role = 'assistant'").groupBy("conv_id").agg(F.collect_set("act").alias("a"))
    have = x.where("role = 'user'").groupBy("conv_id").agg(F.collect_set("act").alias("b"))
    return need.join(have, "conv_id", "left").select("conv_id", F.size(F.array_except("a", F.coalesce("b", F.array().cast("array<int>")))).alias("missing"))


@plans.add("q121_routing_metrics", f"SELECT role, avg((act < 3)::INT::DOUBLE) AS fast_rate, (SELECT avg(c::INT::DOUBLE) FROM (SELECT bool_and(act < 8) AS c FROM {T} GROUP BY conv_id)) AS containment FROM {T} GROUP BY role")
def routing_metrics(spark, d):
    """Share of turns answered fast per role; containment: conversations in which nothing escalates (act 8)."""
    x = turns(spark, d)
    contained = x.groupBy("conv_id").agg(F.bool_and(F.col("act") < 8).alias("c")).agg(F.avg(F.col("c").cast("double")).alias("containment"))
    return x.groupBy("role").agg(F.avg((F.col("act") < 3).cast("double")).alias("fast_rate")).crossJoin(contained)  # one row


@plans.add("q122_component_errors", f"SELECT role, count(CASE WHEN act % 3 > 0 THEN 1 END) AS n, avg(CASE WHEN act % 3 > 0 THEN (act % 3 = 2)::INT::DOUBLE END) AS error FROM {T} GROUP BY role")
def component_errors(spark, d):
    """A component that doesn't apply is null and not in the denominator."""
    e = F.when(F.col("act") % 3 > 0, (F.col("act") % 3 == 2).cast("double"))
    return turns(spark, d).groupBy("role").agg(F.count(e).alias("n"), F.avg(e).alias("error"))


@plans.add("q129_compose", f"SELECT avg(ok::INT::DOUBLE) AS unconditional, avg(CASE WHEN sk THEN ok::INT::DOUBLE END) AS conditional, count(*) AS n, count(CASE WHEN sk THEN 1 END) AS n_skeleton FROM (SELECT conv_id, bool_and(act < 7) AS ok, bool_and(act < 8) AS sk FROM {T} GROUP BY 1)")
def compose(spark, d):
    """All positions right, over all conversations and over those with the right skeleton."""
    k = turns(spark, d).groupBy("conv_id").agg(F.bool_and(F.col("act") < 7).alias("ok"), F.bool_and(F.col("act") < 8).alias("sk"))
    return k.agg(F.avg(F.col("ok").cast("double")).alias("unconditional"), F.avg(F.when(F.col("sk"), F.col("ok").cast("double"))).alias("conditional"), F.count("*").alias("n"), F.count_if("sk").alias("n_skeleton"))


@plans.add("q160_token_stats", "SELECT lang, avg(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::DOUBLE) AS tokens, avg(length(text)::DOUBLE) AS chars FROM documents GROUP BY lang")
def token_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.avg(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("double")).alias("tokens"), F.avg(F.char_length("text").cast("double")).alias("chars"))


@plans.add("q152_containment", "SELECT item_id, count(doc_id) AS holders FROM benchmark LEFT JOIN documents d ON contains(d.text, benchmark.text) GROUP BY 1")
def containment(spark, d):
    """Documents that hold the whole text of each benchmark item."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    hit = o.containing(table(spark, d, "documents"), b, "doc_id", "text", "item_id", "item").groupBy("item_id").agg(F.count("*").alias("holders"))
    return b.join(hit, "item_id", "left").select("item_id", F.coalesce("holders", F.lit(0)).alias("holders"))


@plans.add("q150_numeric_within", "SELECT doc_id, abs((doc_id % 100) / ((doc_id % 90) + 0.1::DOUBLE) - 1) < 0.1::DOUBLE AS ok FROM documents")
def numeric_within(spark, d):
    """The first number of an answer within a tenth of the gold one."""
    said = F.regexp_extract(F.concat(F.lit("about $"), (F.col("doc_id") % 100).cast("string"), F.lit(" in all")), r"(\d+)", 1).cast("double")
    return table(spark, d, "documents").select("doc_id", (F.abs(said / ((F.col("doc_id") % 90) + 0.1) - 1) < 0.1).alias("ok"))


@plans.add("q361_backfill", f"SELECT item_id, CASE WHEN item_id % 3 = 0 THEN in_tokens + out_tokens ELSE in_tokens END AS tokens, coalesce(CASE WHEN item_id % 2 = 0 THEN latency_s END, 1.0::DOUBLE) AS latency FROM {P}")
def backfill(spark, d):
    """Old rows without a total or a latency get them; rows that have them stay as they are."""
    x = pair_log(spark, d).withColumn("total", F.when(F.col("item_id") % 3 != 0, F.col("in_tokens"))).withColumn("seen", F.when(F.col("item_id") % 2 == 0, F.col("latency_s")))
    return x.select("item_id", F.coalesce("total", F.col("in_tokens") + F.col("out_tokens")).alias("tokens"), F.coalesce("seen", F.lit(1.0)).alias("latency"))


@plans.add("q031_upsert", f"SELECT gold, count(*) AS n, sum(free_pred)::BIGINT AS s FROM (SELECT gold, free_pred FROM {P} WHERE gold <> 3 UNION ALL SELECT 3, 99) GROUP BY gold")
def upsert(spark, d):
    base = pair_log(spark, d).select("gold", "free_pred")
    patch = spark.createDataFrame([(3, 99)], "gold int, free_pred int")
    return files.upsert(base, patch, "gold", [3]).groupBy("gold").agg(F.count("*").alias("n"), F.sum("free_pred").alias("s"))


@plans.add("q037_compare", f"WITH a AS (SELECT gold::VARCHAR AS path, count(*) AS v FROM {P} GROUP BY 1), b AS (SELECT free_pred::VARCHAR AS path, count(*) AS v FROM {P} WHERE free_pred < 9 GROUP BY 1) SELECT coalesce(a.path, b.path) AS path, a.v AS measured, b.v AS expected FROM a FULL JOIN b ON a.path = b.path WHERE a.v IS DISTINCT FROM b.v")
def compare(spark, d):
    x = pair_log(spark, d)
    a = x.groupBy(F.col("gold").cast("string").alias("path")).agg(F.count("*").alias("value"))
    b = x.where("free_pred < 9").groupBy(F.col("free_pred").cast("string").alias("path")).agg(F.count("*").alias("value"))
    return files.compare(a, b)


@plans.add("q316_cache", f"WITH c AS (SELECT gold AS key, md5(gold::VARCHAR) AS h, max(item_id) AS answer FROM {P} WHERE gold < 6 GROUP BY 1, 2) SELECT item_id, CASE WHEN c.h = md5((gold + (item_id % 7 = 0)::INT)::VARCHAR) THEN answer END AS answer FROM {P} LEFT JOIN c ON key = gold")
def cache(spark, d):
    """A hit needs the same digest of what was asked; another one under the same key is a miss."""
    x = pair_log(spark, d)
    c = x.where("gold < 6").groupBy(F.col("gold").alias("key"), F.md5(F.col("gold").cast("string")).alias("h")).agg(F.max("item_id").alias("answer"))
    asked = F.md5((F.col("gold") + (F.col("item_id") % 7 == 0).cast("int")).cast("string"))
    return x.join(c, F.col("key") == F.col("gold"), "left").select("item_id", F.when(F.col("h") == asked, F.col("answer")).alias("answer"))


@plans.add("q109_toxic_quality", f"SELECT gold, toxic, count(*) AS n FROM ({DOC_CLASSES_SQL}) GROUP BY CUBE (gold, toxic)")
def toxic_quality(spark, d):
    return doc_classes(spark, d).cube("gold", "toxic").agg(F.count("*").alias("n"))


@plans.add("q047_mentions", "SELECT source, lang, sum(regexp_matches(lower(text), '(^|[^\\w])the([^\\w]|$)')::INT)::BIGINT AS n FROM documents GROUP BY 1, 2")
def mentions(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.sum(t.mentions(F.col("text"), F.lit("the")).cast("long")).alias("n"))
