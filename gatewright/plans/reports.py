"""Queries on answer scores, bootstraps and verdicts, costs, document rules, usage tables and whole analyses."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gatewright.functions import answers as an
from gatewright.functions import stats
from gatewright.functions import text as t
from gatewright.operators import defer as g
from gatewright.operators import folds as f
from gatewright.operators import metrics as m
from gatewright.plans.base import Plans
from gatewright.plans.decide import GATE_SQL, _w_sql
from gatewright.plans.more import _PRICES_SQL, prices
from gatewright.sources.fixtures import DOC_CLASSES_SQL, PAIR_LOG_SQL, REPEATS_SQL, REQUESTS_SQL, TURNS_SQL, doc_classes, pair_log, repeats, requests, table, turns, u, u_sql

plans = Plans()
P, R, T, L = f"({PAIR_LOG_SQL})", f"({REPEATS_SQL})", f"({TURNS_SQL})", f"({REQUESTS_SQL})"

_SAID = "CASE doc_id % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'no' WHEN 2 THEN 'yes, surely' WHEN 3 THEN 'NO' ELSE '' END"


@plans.add("q053_exact_parse", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 3 THEN 'no' END AS pred FROM documents")
def exact_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", an.exact_parse(F.expr(_SAID), ["yes", "no"]).alias("pred"))


@plans.add("q052_lenient_columns", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' END AS pred_lenient, (doc_id % 5 < 4)::INT AS parse_ok_lenient FROM documents")
def lenient_columns(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.expr(_SAID).alias("raw"))
    pred = t.lenient_label(F.col("raw"), ["yes", "no"])
    return x.select("doc_id", pred.alias("pred_lenient"), pred.isNotNull().cast("int").alias("parse_ok_lenient"))


_PUNCT = "translate(text, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '')"


@plans.add("q054_benchmark_form", f"SELECT doc_id, md5(lower(trim({_PUNCT}))) AS h FROM documents")
def benchmark_form(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(an.benchmark_form(F.col("text"))).alias("h"))


@plans.add("q151_stemmed_overlap", "SELECT doc_id, doc_id % 4 IN (0, 1, 2) AS hit FROM documents")
def stemmed_overlap(spark, d):
    """Whether any answer equals the generation word for word after stemming."""
    said = F.expr("CASE doc_id % 4 WHEN 0 THEN 'The contracts, signed.' WHEN 1 THEN 'the contract sign' WHEN 2 THEN 'the contract signing' ELSE 'a contract' END")
    golds = F.array(F.lit("other words"), F.lit("the contract signed"))
    hit = F.exists(golds, lambda a: an.benchmark_form(a, True) == an.benchmark_form(said, True))
    return table(spark, d, "documents").select("doc_id", hit.alias("hit"))


@plans.add("q147_any_of", "SELECT doc_id, doc_id % 5 IN (0, 1, 3) AS exact, CASE doc_id % 5 WHEN 2 THEN 2 * (1.0 / 2) * 1 / (1.0 / 2 + 1) WHEN 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS f1 FROM documents")
def any_of(spark, d):
    """Against several gold answers: equal to one, and the best F1."""
    golds = F.array(F.lit("The yes!"), F.lit("no"))
    return table(spark, d, "documents").select("doc_id", an.any_of_exact(F.expr(_SAID), golds).alias("exact"), an.any_of_f1(F.expr(_SAID), golds).alias("f1"))


@plans.add("q146_field_f1", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 2.0 / 3 END::DOUBLE AS f1 FROM customer")
def field_f1(spark, d):
    """Fields of two JSON objects, typed values compared (1,000 equals 1000)."""
    gold = F.from_json(F.lit('{"name": "x", "total": "1000"}'), "map<string,string>")
    pred = F.from_json(F.expr("""CASE c_custkey % 3 WHEN 0 THEN '{"name": "X", "total": "1,000"}' WHEN 1 THEN '{"name": "x", "total": "7"}' ELSE '{"name": "x"}' END"""), "map<string,string>")
    return table(spark, d, "customer").select("c_custkey", an.field_f1(pred, gold).alias("f1"))


@plans.add("q149_set_f1", "SELECT lang, CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END AS f1 FROM (SELECT lang, len(list_filter(['the', 'of', 'der'], lambda c: contains(lower(a), c) AND contains(lower(b), c))) AS tp, len(list_filter(['the', 'of', 'der'], lambda c: contains(lower(a), c) AND NOT contains(lower(b), c))) AS fp, len(list_filter(['the', 'of', 'der'], lambda c: NOT contains(lower(a), c) AND contains(lower(b), c))) AS fn FROM (SELECT lang, substr(text, 1, 100) AS a, substr(text, 101, 100) AS b FROM documents)) GROUP BY 1")
def set_f1(spark, d):
    """F1 over the classes that a text's first and second hundred characters name."""
    x = table(spark, d, "documents").select("lang", F.substring("text", 1, 100).alias("a"), F.substring("text", 101, 100).alias("b"))
    tp, fp, fn = an.set_f1_counts(F.col("a"), F.col("b"), ["the", "of", "der"])
    k = x.groupBy("lang").agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    return k.select("lang", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


@plans.add("q153_consumed_f1", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS tp, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS fn, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 1 END AS fp FROM documents")
def consumed_f1(spark, d):
    """Answers that each consume one generation that contains them."""
    said = F.expr("CASE doc_id % 3 WHEN 0 THEN array('the tenant pays', 'a landlord repairs', 'other') WHEN 1 THEN array('Tenant and landlord', 'x') ELSE array('nothing') END")
    tp, fn, fp = an.consumed_counts(said, F.array(F.lit("tenant"), F.lit("landlord")))
    return table(spark, d, "documents").select("doc_id", tp.alias("tp"), fn.alias("fn"), fp.alias("fp"))


@plans.add("q101_unparseable", f"SELECT avg(r) AS balanced_accuracy FROM (SELECT gold, avg((CASE WHEN item_id % 7 > 0 THEN free_pred END IS NOT DISTINCT FROM gold)::INT::DOUBLE) AS r FROM {P} GROUP BY 1)")
def unparseable(spark, d):
    """A prediction that isn't a class is wrong, and stays in the denominator."""
    x = pair_log(spark, d).withColumn("p", F.when(F.col("item_id") % 7 > 0, F.col("free_pred")))
    return m.balanced_accuracy(x, [], "gold", "p").select("balanced_accuracy")


@plans.add("q120_stream_measures", f"SELECT fold, count(*) AS n, count(CASE WHEN p = gold THEN 1 END) AS correct, count(CASE WHEN p IS NULL THEN 1 END) AS unparsed, count(CASE WHEN p = gold AND gold = 1 THEN 1 END) AS tp FROM (SELECT *, CASE WHEN item_id % 7 > 0 THEN llm_pred END AS p FROM {P}) GROUP BY 1")
def stream_measures(spark, d):
    x = pair_log(spark, d).withColumn("p", F.when(F.col("item_id") % 7 > 0, F.col("llm_pred")))
    return x.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("gold")).alias("correct"), F.count_if(F.col("p").isNull()).alias("unparsed"), F.count_if((F.col("p") == F.col("gold")) & (F.col("gold") == 1)).alias("tp"))


@plans.add("q134_majority_baseline", f"WITH k AS (SELECT fold, gold, count(*) AS n FROM {P} GROUP BY ALL), o AS (SELECT a.fold, k.gold, sum(k.n) AS n FROM (SELECT DISTINCT fold FROM k) a JOIN k ON k.fold <> a.fold GROUP BY ALL), b AS (SELECT fold, gold AS pred FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, gold) AS r FROM o) WHERE r = 1) SELECT p.fold, any_value(b.pred) AS pred, avg((b.pred = p.gold)::INT::DOUBLE) AS accuracy FROM {P} p JOIN b USING (fold) GROUP BY 1")
def majority_baseline(spark, d):
    """The most frequent class of the other folds (ties: the lowest) for every item."""
    x = pair_log(spark, d)
    cube = x.groupBy("fold", "gold").agg(F.count("*").alias("n"))
    rest = cube.withColumn("n", F.sum("n").over(Window.partitionBy("gold")) - F.col("n"))
    best = rest.groupBy("fold").agg(F.max(F.struct("n", (-F.col("gold")).alias("g"))).alias("x")).select("fold", (-F.col("x.g")).alias("pred"))
    return x.join(F.broadcast(best), "fold").groupBy("fold", "pred").agg(F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("accuracy"))  # one row a fold


@plans.add("q144_compare_cheap", f"WITH a AS (SELECT repeat, item_id, free_ok AS a FROM {R} WHERE repeat < 2), b AS (SELECT repeat, item_id, llm_ok AS b FROM {R} WHERE repeat > 0), k AS (SELECT repeat, count(*) AS n, avg(a::DOUBLE) AS a, avg(b::DOUBLE) AS b, count(CASE WHEN a > b THEN 1 END) AS won, count(CASE WHEN a < b THEN 1 END) AS lost FROM a JOIN b USING (repeat, item_id) GROUP BY 1) SELECT count(*) AS repeats, avg(b - a) AS delta, avg(won) AS won, avg(lost) AS lost FROM k")
def compare_cheap(spark, d):
    """Two cheap models over the repeats that both have: paired per repeat, then the mean."""
    r = repeats(spark, d)
    a, b = r.where("repeat < 2").select("repeat", "item_id", F.col("free_ok").alias("a")), r.where("repeat > 0").select("repeat", "item_id", F.col("llm_ok").alias("b"))
    k = a.join(b, ["repeat", "item_id"]).groupBy("repeat").agg((F.avg("b") - F.avg("a")).alias("delta"), F.count_if(F.col("a") > F.col("b")).alias("won"), F.count_if(F.col("a") < F.col("b")).alias("lost"))
    return k.agg(F.count("*").alias("repeats"), F.avg("delta").alias("delta"), F.avg("won").alias("won"), F.avg("lost").alias("lost"))


def _boot(seed: int, value: str, ident: str, src: str, by: str = "", n: int = 200) -> str:
    k = f"{by}, " if by else ""
    return f"(SELECT {k}replicate, sum({_w_sql(seed, 'replicate', ident)} * ({value})::DOUBLE) / nullif(sum({_w_sql(seed, 'replicate', ident)}), 0) AS m FROM {src}, (SELECT unnest(range({n})) AS replicate) GROUP BY {k}replicate)"


@plans.add("q202_rate_bootstrap", f"SELECT (SELECT avg(kept::DOUBLE) FROM {R}) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg((m <= 0)::INT::DOUBLE) AS p_le_0 FROM {_boot(37, 'kept', 'item_id', R)}")
def rate_bootstrap(spark, d):
    """Bounds of a rate, all repeats of an item drawn together."""
    return f.bootstrap_mean(repeats(spark, d), [], "item_id", "kept", 200, 37)


@plans.add("q204_accuracy_bootstrap", f"SELECT (SELECT avg((llm_ok - free_ok)::DOUBLE) FROM {P}) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg((m <= 0)::INT::DOUBLE) AS p_le_0 FROM {_boot(41, 'llm_ok - free_ok', 'item_id', P)}")
def accuracy_bootstrap(spark, d):
    """Paired difference of accuracies: one draw of items for both models."""
    return f.bootstrap_mean(pair_log(spark, d).withColumn("delta", F.col("llm_ok") - F.col("free_ok")), [], "item_id", "delta", 200, 41)


@plans.add("q206_bca_bootstrap")
def bca_bootstrap(spark, d):
    """Bias-corrected and accelerated bounds of the paired difference."""
    return f.bca_mean(pair_log(spark, d).withColumn("delta", F.col("llm_ok") - F.col("free_ok")), "item_id", "delta", 200, 43)


_CK = f"(SELECT conv_id, sum((act = 0)::INT - (act = 1)::INT)::DOUBLE AS a, count(*)::DOUBLE AS b FROM {T} GROUP BY 1)"


@plans.add("q209_paired_clusters", f"WITH k AS {_CK}, r AS (SELECT replicate, sum({_w_sql(47, 'replicate', 'conv_id')} * a) / nullif(sum({_w_sql(47, 'replicate', 'conv_id')} * b), 0) AS m FROM k, (SELECT unnest(range(200)) AS replicate) GROUP BY 1) SELECT (SELECT sum(a) / sum(b) FROM k) AS ratio, (SELECT count(*) FROM k) AS clusters, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM r")
def paired_clusters(spark, d):
    """Difference of two arms per turn, whole conversations drawn."""
    x = turns(spark, d).withColumn("a", (F.col("act") == 0).cast("int") - (F.col("act") == 1).cast("int")).withColumn("one", F.lit(1))
    return f.cluster_bootstrap(x, "conv_id", "a", "one", 200, 47)


@plans.add("q208_cluster_and_row_width", f"""WITH x AS (SELECT conv_id, turn, (act = 0)::INT AS v FROM {T}), k AS (SELECT conv_id, sum(v)::DOUBLE AS a, count(*)::DOUBLE AS b FROM x GROUP BY 1), c AS (SELECT replicate, sum({_w_sql(53, 'replicate', 'conv_id')} * a) / nullif(sum({_w_sql(53, 'replicate', 'conv_id')} * b), 0) AS m FROM k, (SELECT unnest(range(200)) AS replicate) GROUP BY 1),
r AS (SELECT replicate, sum({_w_sql(59, 'replicate', 'conv_id', 'turn')} * v::DOUBLE) / nullif(sum({_w_sql(59, 'replicate', 'conv_id', 'turn')}), 0) AS m FROM x, (SELECT unnest(range(200)) AS replicate) GROUP BY 1) SELECT (SELECT (quantile_cont(m, 0.975) - quantile_cont(m, 0.025)) / 2 FROM c) AS cluster_half_width, (SELECT (quantile_cont(m, 0.975) - quantile_cont(m, 0.025)) / 2 FROM r) AS row_half_width""")
def cluster_and_row_width(spark, d):
    """Half widths with conversations and with single turns drawn."""
    x = turns(spark, d).withColumn("v", (F.col("act") == 0).cast("int")).withColumn("one", F.lit(1)).withColumn("id", F.concat_ws("|", "conv_id", "turn"))
    half = lambda df, name: df.select(((F.col("high") - F.col("low")) / 2).alias(name))
    return half(f.cluster_bootstrap(x, "conv_id", "v", "one", 200, 53), "cluster_half_width").crossJoin(half(f.bootstrap_mean(x, [], "id", "v", 200, 59), "row_half_width"))  # one row each


@plans.add("q211_mean_bootstrap", f"SELECT gold, (any_value(mean)) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM {_boot(61, 'latency_s', 'item_id', P, 'gold')} JOIN (SELECT gold, avg(latency_s) AS mean FROM {P} GROUP BY 1) USING (gold) GROUP BY gold")
def mean_bootstrap(spark, d):
    return f.bootstrap_mean(pair_log(spark, d), ["gold"], "item_id", "latency_s", 200, 61).drop("p_le_0")


_NI = f"SELECT gold, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM {_boot(67, 'free_ok - llm_ok', 'item_id', P, 'gold')} GROUP BY gold"


@plans.add("q223_non_inferiority", f"SELECT gold, low, CASE WHEN low > 0 THEN 'superior' WHEN low > -0.05 THEN 'non-inferior' WHEN high < -0.05 THEN 'inferior' ELSE 'unclear' END AS verdict FROM ({_NI})")
def non_inferiority(spark, d):
    """The cheap model against the expensive one at a margin of 0.05: the one-sided bound decides."""
    b = f.bootstrap_mean(pair_log(spark, d).withColumn("delta", F.col("free_ok") - F.col("llm_ok")), ["gold"], "item_id", "delta", 200, 67, 0.9)
    return b.select("gold", "low", F.when(F.col("low") > 0, "superior").when(F.col("low") > -0.05, "non-inferior").when(F.col("high") < -0.05, "inferior").otherwise("unclear").alias("verdict"))


@plans.add("q229_ship_decision", f"SELECT n.gold, CASE WHEN a < 0.5 THEN 'below the bar' WHEN low > 0 THEN 'ship' WHEN low > -0.05 THEN 'ship as equivalent' ELSE 'keep the expensive model' END AS decision FROM ({_NI}) n JOIN (SELECT gold, avg(free_ok::DOUBLE) AS a FROM {P} GROUP BY 1) USING (gold)")
def ship_decision(spark, d):
    x = pair_log(spark, d).withColumn("delta", F.col("free_ok") - F.col("llm_ok"))
    b = f.bootstrap_mean(x, ["gold"], "item_id", "delta", 200, 67, 0.9).join(x.groupBy("gold").agg(F.avg("free_ok").alias("a")), "gold")
    return b.select("gold", F.when(F.col("a") < 0.5, "below the bar").when(F.col("low") > 0, "ship").when(F.col("low") > -0.05, "ship as equivalent").otherwise("keep the expensive model").alias("decision"))


_Z = f"{stats.Z95!r}::DOUBLE"


@plans.add("q232_resolution_warning", f"SELECT gold, n, CASE WHEN h > 0.05 THEN 'differences under ' || round(100 * h)::INT || ' points are noise' END AS warning FROM (SELECT gold, count(*) AS n, {_Z} * sqrt(0.9::DOUBLE * 0.1::DOUBLE / count(*) + {_Z} * {_Z} / (4.0::DOUBLE * count(*) * count(*))) / (1 + {_Z} * {_Z} / count(*)) AS h FROM {P} GROUP BY 1)")
def resolution_warning(spark, d):
    """What a test set of this size can't tell at an accuracy of 0.9."""
    k = pair_log(spark, d).groupBy("gold").agg(F.count("*").alias("n"))
    n, z = F.col("n"), stats.Z95
    half = z * F.sqrt(0.9 * 0.1 / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    return k.select("gold", "n", F.when(half > 0.05, F.concat(F.lit("differences under "), F.round(100 * half).cast("int").cast("string"), F.lit(" points are noise"))).alias("warning"))


_COST = "((it - ct) * price_in + ct * coalesce(price_cached, price_in) + ot * price_out) / 1000::DOUBLE"


@plans.add("q238_cost_per_1k_calls", f"SELECT model, CASE WHEN price_in > 0 THEN {_COST} END AS usd FROM {_PRICES_SQL}, (SELECT avg(in_tokens) AS it, avg(out_tokens) AS ot, avg(cached_tokens) AS ct FROM {P})")
def cost_per_1k_calls(spark, d):
    """Cost of a thousand mean calls; null where there is no price."""
    k = pair_log(spark, d).agg(F.avg("in_tokens").alias("it"), F.avg("out_tokens").alias("ot"), F.avg("cached_tokens").alias("ct"))
    usd = 1000 * stats.call_cost(F.col("it"), F.col("ot"), F.col("ct"), F.col("price_in"), F.col("price_out"), F.col("price_cached"))
    return prices(spark).crossJoin(k).select("model", F.when(F.col("price_in") > 0, usd).alias("usd"))  # one row


@plans.add("q239_cost_per_1k_items", f"SELECT gold, 1000 * sum(in_tokens) * 0.6::DOUBLE / 1e6::DOUBLE / count(*) AS usd, round(count(*) * 1.5::DOUBLE)::BIGINT AS n_calls FROM {P} GROUP BY 1")
def cost_per_1k_items(spark, d):
    """A stored row holds items, mean calls an item and mean cost a call: cost of a thousand items, calls billed."""
    k = pair_log(spark, d).groupBy("gold").agg(F.count("*").alias("n"), F.lit(1.5).alias("calls_per_item"), (F.sum("in_tokens") * 0.6 / 1e6 / F.count("*") / 1.5).alias("usd_per_call"))
    return k.select("gold", (1000 * F.col("usd_per_call") * F.col("calls_per_item")).alias("usd"), F.round(F.col("n") * F.col("calls_per_item")).cast("long").alias("n_calls"))


@plans.add("q242_upper_bound", f"SELECT model, sum((in_tokens * price_in + 60 * price_out) / 1e6::DOUBLE) AS usd FROM {P}, {_PRICES_SQL} GROUP BY 1")
def upper_bound(spark, d):
    """Before the calls: full input price, the most output tokens."""
    return pair_log(spark, d).join(F.broadcast(prices(spark)), F.lit(True)).groupBy("model").agg(F.sum((F.col("in_tokens") * F.col("price_in") + 60 * F.col("price_out")) / 1e6).alias("usd"))  # a few rows


@plans.add("q194_missing_keys", "SELECT * FROM (VALUES ('KEY_A', ['medium', 'small']), ('KEY_B', ['large'])) v(key, models)")
def missing_keys(spark, d):
    """Settings that aren't there, and the models they would unlock."""
    need = spark.createDataFrame([("small", "KEY_A"), ("medium", "KEY_A"), ("large", "KEY_B"), ("free", "KEY_C")], "model string, key string")
    there = spark.createDataFrame([("KEY_C",)], "key string")
    return need.join(there, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_set("model")).alias("models"))  # a few models


@plans.add("q195_suitable", f"SELECT model, CASE WHEN out_limit < 4000 THEN 'output too short' WHEN price_out > 10 THEN 'too expensive' ELSE 'fits' END AS reason FROM {_PRICES_SQL}")
def suitable(spark, d):
    return prices(spark).select("model", F.when(F.col("out_limit") < 4000, "output too short").when(F.col("price_out") > 10, "too expensive").otherwise("fits").alias("reason"))


@plans.add("q216_model_prices", "SELECT model, price_in, round(price_in * 30 * 1000000 / 1e6 + price_out * 30 * 100000 / 1e6, 6)::DOUBLE AS monthly_usd FROM " + _PRICES_SQL + " WHERE model LIKE '%a%'")
def model_prices(spark, d):
    """Search in the price table, with the bill of a month at a million input and a tenth as many output tokens a day."""
    bill = F.round(F.col("price_in") * 30 * 1_000_000 / 1e6 + F.col("price_out") * 30 * 100_000 / 1e6, 6)
    return prices(spark).where(F.col("model").contains("a")).select("model", "price_in", bill.alias("monthly_usd"))


@plans.add("q173_strict_pareto", f"WITH k AS (SELECT free_pred AS c, avg(cost) AS cost, avg(ok) AS score FROM (SELECT free_pred, in_tokens::DOUBLE AS cost, free_ok::DOUBLE AS ok FROM {P}) GROUP BY 1) SELECT c, cost, score FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.cost <= a.cost AND b.score >= a.score AND (b.cost < a.cost OR b.score > a.score))")
def strict_pareto(spark, d):
    """Points that no other one equals or beats on both sides and beats on one: a running best over the costs."""
    k = pair_log(spark, d).groupBy(F.col("free_pred").alias("c")).agg(F.avg(F.col("in_tokens").cast("double")).alias("cost"), F.avg(F.col("free_ok").cast("double")).alias("score"))
    cheaper = F.max("score").over(Window.orderBy("cost").rangeBetween(Window.unboundedPreceding, Window.currentRow))  # one row a candidate
    before = F.max(F.col("best")).over(Window.orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    per = k.groupBy("cost").agg(F.max("score").alias("best")).withColumn("before", before)
    return k.withColumn("__top", cheaper).join(per, "cost").where((F.col("score") == F.col("best")) & (F.col("before").isNull() | (F.col("best") > F.col("before")))).select("c", "cost", "score")


_RUNG = f"""WITH x AS ({DOC_CLASSES_SQL}), y AS (SELECT grp, gold AS y FROM (SELECT grp, gold, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, gold) AS k FROM x GROUP BY grp, gold) WHERE k = 1), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {u_sql(401, 'grp')}, grp) AS k, count(*) OVER (PARTITION BY y) AS n FROM y)"""


@plans.add("q180_rung", f"{_RUNG} SELECT x.doc_id FROM x JOIN r USING (grp) WHERE k <= greatest(round(n * 0.3::DOUBLE), 1)")
def rung(spark, d):
    """Three tenths of the groups of each class (a group's class is its majority), whole groups, one at least."""
    x = doc_classes(spark, d)
    votes = x.groupBy("grp", "gold").agg(F.count("*").alias("n"))
    y = votes.groupBy("grp").agg(F.max(F.struct("n", (-F.col("gold")).alias("g"))).alias("v")).select("grp", (-F.col("v.g")).alias("y"))
    w = Window.partitionBy("y")
    r = y.withColumn("k", F.row_number().over(w.orderBy(u(401, "grp"), "grp"))).withColumn("n", F.count("*").over(w)).where(F.col("k") <= F.greatest(F.round(F.col("n") * 0.3), F.lit(1)))
    return x.join(r, "grp", "left_semi").select("doc_id")


@plans.add("q281_stream_select", f"""WITH s AS (SELECT seed, warm, avg(CASE WHEN {u_sql(411, 'seed', 'item_id')} < warm OR free_conf < 0.4::DOUBLE THEN llm_ok ELSE free_ok END::DOUBLE) AS acc FROM {P}, (SELECT unnest(range(4)) AS seed), (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS warm) GROUP BY ALL),
b AS (SELECT warm FROM (SELECT warm, row_number() OVER (ORDER BY round(avg(acc), 12) DESC, warm) AS k FROM s WHERE seed < 2 GROUP BY warm) WHERE k = 1) SELECT warm, avg(acc) AS accuracy, count(*) AS seeds FROM s JOIN b USING (warm) WHERE seed >= 2 GROUP BY 1""")
def stream_select(spark, d):
    """The warm-up share is chosen on half of the seeds and reported on the others."""
    x = pair_log(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("warm", F.explode(F.array(F.lit(0.05), F.lit(0.1), F.lit(0.2))))
    called = (u(411, "seed", "item_id") < F.col("warm")) | (F.col("free_conf") < 0.4)
    s = x.groupBy("seed", "warm").agg(F.avg(F.when(called, F.col("llm_ok")).otherwise(F.col("free_ok")).cast("double")).alias("acc"))
    best = s.where("seed < 2").groupBy("warm").agg(F.round(F.avg("acc"), 12).alias("a")).agg(F.max_by("warm", F.struct("a", -F.col("warm"))).alias("warm"))
    return s.where("seed >= 2").join(best, "warm").groupBy("warm").agg(F.avg("acc").alias("accuracy"), F.count("*").alias("seeds"))


@plans.add("q295_order_headroom", r"WITH w AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g, 1 AS a, 0 AS b FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i + 1] || ' ' || w[i])), 0, 1 FROM w), k AS (SELECT doc_id, g, abs(sum(a) - sum(b)) AS diff, sum(a) + sum(b) AS mass FROM g GROUP BY ALL) SELECT doc_id, sum(diff)::DOUBLE / sum(mass) AS moved FROM k GROUP BY 1")
def order_headroom(spark, d):
    """The share of a text's bigrams that reversing its words changes: what a vectoriser of bigrams can see of order."""
    texts = table(spark, d, "documents").groupBy("doc_id").agg(F.collect_list(F.lower("text")).alias("texts"))  # rows of one id

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counted document by document, so that texts are shuffled once and their bigrams never."""
        for batch in batches:
            took, shares = [], []
            for row, of in enumerate(batch.column(1)):
                n: Counter[tuple[str, str]] = Counter()
                for text in of.as_py():
                    w = [x for x in text.split(" ") if x]
                    n.update(zip(w, w[1:], strict=False))
                if n:
                    # a bigram that never stands the other way round is missing in one list and added in the other
                    diff = sum(abs(c - n[y, x]) if (y, x) in n else 2 * c for (x, y), c in n.items())
                    took.append(row)
                    shares.append(diff / (2 * n.total()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took, pa.int64())), pa.array(shares, pa.float64())], ["doc_id", "moved"])

    return texts.mapInArrow(moved, StructType().add(texts.schema["doc_id"]).add("moved", "double"))


_QUESTION = "CASE doc_id % 3 WHEN 0 THEN 'Please tell me:  does the CLAUSE limit liability ??' WHEN 1 THEN 'Does the clause limit liability?' ELSE 'can you say whether the clause limits liability' END"


@plans.add("q301_canonical", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'does the clause limit liability' ELSE 'does the clause limits liability' END AS q FROM documents")
def canonical(spark, d):
    """Questions in one form: courtesies off, `whether` as `does`, single blanks, no punctuation."""
    q = F.lower(F.expr(_QUESTION))
    for pattern, to in ((r"^(please )?(tell me:?|can you say) +", ""), (r"^whether ", "does "), (r"[?.!]+", ""), (r"\s+", " ")):
        q = F.regexp_replace(q, pattern, to)
    return table(spark, d, "documents").select("doc_id", F.trim(q).alias("q"))


_RULES = [("limit", "the .* of", "yes"), ("liability", "der", "no"), ("clause", "que", "unclear")]
_RULES_SQL = "(VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(_RULES)) + ") r(k, q, t, answer)"


@plans.add("q302_rules", f"SELECT doc_id, arg_min(answer, k) AS answer FROM documents, {_RULES_SQL} WHERE regexp_matches('does it limit liability in the clause', r.q) AND regexp_matches(text, r.t) GROUP BY 1")
def rules(spark, d):
    """The first rule whose question pattern and document pattern both match."""
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(_RULES)], "k int, q string, t string, answer string")
    hit = table(spark, d, "documents").join(F.broadcast(r), F.regexp_like(F.lit("does it limit liability in the clause"), F.col("q")) & F.regexp_like(F.col("text"), F.col("t")))  # a few rules
    return hit.groupBy("doc_id").agg(F.min_by("answer", "k").alias("answer"))


@plans.add("q305_topic", r"WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?;\n]'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents) SELECT doc_id, bool_or(contains(lower(s), 'the') AND contains(lower(s), 'and')) AS on_topic FROM s GROUP BY 1")
def topic(spark, d):
    """Whether one sentence holds every topic word."""
    s = table(spark, d, "documents").select("doc_id", F.explode(t.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.bool_or(F.contains(F.lower("s"), F.lit("the")) & F.contains(F.lower("s"), F.lit("and"))).alias("on_topic"))


@plans.add("q309_kind_router", "SELECT doc_id, CASE WHEN text LIKE '%|%' THEN 'table' WHEN length(text) < 400 THEN 'short' WHEN contains(lower(text), 'the') THEN 'english' ELSE 'other' END AS answer, CASE WHEN text LIKE '%|%' THEN 0 WHEN length(text) < 400 THEN 1 WHEN contains(lower(text), 'the') THEN 2 ELSE 3 END AS tier FROM documents WHERE text IS NOT NULL")
def kind_router(spark, d):
    """Tiers in order; the first that answers counts, and is named."""
    tiers = [F.when(F.contains("text", F.lit("|")), "table"), F.when(F.char_length("text") < 400, "short"), F.when(F.contains(F.lower("text"), F.lit("the")), "english"), F.lit("other")]
    first = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("answer"), F.lit(i).alias("tier"))) for i, c in enumerate(tiers)])
    return table(spark, d, "documents").where("text is not null").select("doc_id", first.alias("x")).select("doc_id", "x.*")


@plans.add("q311_last_seen", f"SELECT email, max(ts) AS last_seen, count(*) AS n FROM {L} GROUP BY 1")
def last_seen(spark, d):
    return requests(spark, d).groupBy("email").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n"))


@plans.add("q312_documents_once", "SELECT sha256(text) AS id, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1")
def documents_once(spark, d):
    """Insert or ignore by the digest of the content: the first stays."""
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("id")).agg(F.min("doc_id").alias("first"))


@plans.add("q363_request_log", f"SELECT event_id, '{{\"status\":\"' || status || '\",\"path\":\"' || path || '\"}}' AS evidence FROM {L}")
def request_log(spark, d):
    """Fact rows with their evidence as JSON."""
    return requests(spark, d).select("event_id", F.to_json(F.struct("status", "path")).alias("evidence"))


@plans.add("q364_limits", f"WITH c AS (SELECT email, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 10 + event_id % 5 END AS lim FROM (SELECT 'user' || user_id::VARCHAR || '@example.org' AS email, event_id, event_type FROM events)), z AS (SELECT email, lim, row_number() OVER (PARTITION BY email ORDER BY event_id DESC) AS k FROM c) SELECT email, lim AS daily_limit FROM z WHERE k = 1 AND lim IS NOT NULL")
def limits(spark, d):
    """Changes of a user's limit: the last one holds, null takes the limit off."""
    c = table(spark, d, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("email"), "event_id", F.when(F.col("event_type") != "error", 10 + F.col("event_id") % 5).alias("lim"))
    last = c.groupBy("email").agg(F.max(F.struct("event_id", "lim")).alias("x"))
    return last.where("x.lim is not null").select("email", F.col("x.lim").alias("daily_limit"))


@plans.add("q315_resume", f"WITH x AS (SELECT item_id, md5((gold * 10 + free_pred)::VARCHAR) AS sha FROM {P}), done AS (SELECT DISTINCT sha FROM x WHERE item_id % 4 = 0), todo AS (SELECT DISTINCT sha FROM x WHERE sha NOT IN (SELECT sha FROM done)) SELECT count(*) AS items, (SELECT count(*) FROM todo) AS calls, count(CASE WHEN sha IN (SELECT sha FROM todo) THEN 1 END) AS fanned_out FROM x")
def resume(spark, d):
    """One call for each distinct text that isn't answered yet, its answer given to all items of that text."""
    x = pair_log(spark, d).select("item_id", F.md5((F.col("gold") * 10 + F.col("free_pred")).cast("string")).alias("sha"))
    done = x.where("item_id % 4 = 0").select("sha").distinct()
    todo = x.select("sha").distinct().join(done, "sha", "left_anti").withColumn("asked", F.lit(1))
    out = x.join(todo, "sha", "left").agg(F.count("*").alias("items"), F.count("asked").alias("fanned_out"))
    return out.crossJoin(todo.agg(F.count("*").alias("calls")))  # one row each


@plans.add("q317_incremental_novelty", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), i AS (SELECT * FROM e WHERE vec_id % 2 = 1) SELECT q.vec_id, round(1 - max(round(list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))), 9)), 9) AS novelty FROM e q, i WHERE q.vec_id % 100 = 0 GROUP BY 1")
def incremental_novelty(spark, d):
    """Against an index fitted on training vectors (odd ids) that later ones don't change."""
    from gatewright.operators import vectors as v

    e = table(spark, d, "embeddings")
    x = v.novelty(e.where("vec_id % 100 = 0"), e.where("vec_id % 2 = 1"), "vec_id", "embedding")
    return x.select(F.col("query").alias("vec_id"), F.round("novelty", 9).alias("novelty"))


@plans.add("q359_locale_gate", f"WITH x AS (SELECT fold AS locale, 'free' AS arm, free_ok AS ok, free_conf AS c FROM {P} UNION ALL SELECT fold, 'llm', llm_ok, 1 - free_conf FROM {P}), a AS (SELECT locale, arm, avg(ok::DOUBLE) AS acc FROM x GROUP BY ALL), b AS (SELECT locale, arm, acc FROM (SELECT *, row_number() OVER (PARTITION BY locale ORDER BY round(acc, 12) DESC, arm) AS k FROM a) WHERE k = 1) SELECT b.locale, b.arm, any_value(b.acc) AS accuracy, avg(CASE WHEN x.c >= 0.5::DOUBLE THEN x.ok::DOUBLE END) AS kept_accuracy, avg((x.c >= 0.5::DOUBLE)::INT::DOUBLE) AS kept FROM b JOIN x USING (locale, arm) GROUP BY 1, 2")
def locale_gate(spark, d):
    """The most accurate arm of each locale (folds stand for locales), then the gate on it."""
    x = pair_log(spark, d).select(F.col("fold").alias("locale"), F.explode(F.array(F.struct(F.lit("free").alias("arm"), F.col("free_ok").alias("ok"), F.col("free_conf").alias("c")), F.struct(F.lit("llm").alias("arm"), F.col("llm_ok").alias("ok"), (1 - F.col("free_conf")).alias("c")))).alias("x")).select("locale", "x.*")
    a = x.groupBy("locale", "arm").agg(F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg(F.when(F.col("c") >= 0.5, F.col("ok").cast("double"))).alias("kept_accuracy"), F.avg((F.col("c") >= 0.5).cast("double")).alias("kept"))
    return a.groupBy("locale").agg(F.min_by(F.struct("arm", "accuracy", "kept_accuracy", "kept"), F.struct(-F.round("accuracy", 12), "arm")).alias("x")).select("locale", "x.*")


@plans.add("q362_act_audit", f"SELECT act, k, n, greatest((k / n + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 0.0) AS low, least((k / n + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 1.0) AS high FROM (SELECT act, sum((({u_sql(421, 'conv_id', 'turn')}) < 0.9::DOUBLE)::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM {T} GROUP BY 1)")
def act_audit(spark, d):
    """Agreement of audited acts with Wilson's interval."""
    k = turns(spark, d).groupBy("act").agg(F.sum((u(421, "conv_id", "turn") < 0.9).cast("int")).cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return k.select("act", "k", "n", low.alias("low"), high.alias("high"))


@plans.add("q318_dataset_analysis", f"""WITH {GATE_SQL}, per AS (SELECT gold, avg(free_ok::DOUBLE) AS f, avg(llm_ok::DOUBLE) AS l, avg(CASE WHEN escalate THEN llm_ok ELSE free_ok END::DOUBLE) AS c, sum(escalate::INT)::DOUBLE AS s, count(*) AS n FROM e GROUP BY 1)
SELECT avg(f) AS free, avg(l) AS llm, avg(c) AS cascade, sum(s) / sum(n) AS llm_share, sum(n)::BIGINT AS n, count(*) AS classes, CASE WHEN avg(c) > greatest(avg(f), avg(l)) THEN 'cascade' WHEN avg(l) > avg(f) THEN 'llm' ELSE 'free' END AS choice FROM per""")
def dataset_analysis(spark, d):
    """Profile, both arms, the class gate and the choice among them, from one pass over the gated items."""
    e = g.class_gate(pair_log(spark, d), [], "fold", "free_pred", "free_ok", "llm_ok")
    per = e.groupBy("gold").agg(F.avg("free_ok").alias("f"), F.avg("llm_ok").alias("l"), F.avg(F.when(F.col("escalate"), F.col("llm_ok")).otherwise(F.col("free_ok"))).alias("c"), F.sum(F.col("escalate").cast("int")).alias("s"), F.count("*").alias("n"))
    k = per.agg(F.avg("f").alias("free"), F.avg("l").alias("llm"), F.avg("c").alias("cascade"), (F.sum("s") / F.sum("n")).alias("llm_share"), F.sum("n").alias("n"), F.count("*").alias("classes"))
    return k.withColumn("choice", F.when(F.col("cascade") > F.greatest("free", "llm"), "cascade").when(F.col("llm") > F.col("free"), "llm").otherwise("free"))


@plans.add("q319_cv_run", f"WITH x AS (SELECT free_pred % 2 AS task, item_id, gold, 'free' AS candidate, free_pred AS p FROM {P} UNION ALL SELECT free_pred % 2, item_id, gold, 'llm', llm_pred FROM {P}), b AS (SELECT task, candidate, avg(r) AS bal FROM (SELECT task, candidate, gold, avg((p = gold)::INT::DOUBLE) AS r FROM x GROUP BY ALL) GROUP BY ALL) SELECT task, candidate, bal, row_number() OVER (PARTITION BY task ORDER BY round(bal, 12) DESC, candidate) = 1 AS best, CASE WHEN bal >= 0.75 THEN 'match' WHEN bal >= 0.7 THEN 'close' ELSE 'short' END AS verdict FROM b")
def cv_run(spark, d):
    """Tasks by candidates: balanced accuracy, the best of each task, the verdict against a published score."""
    x = pair_log(spark, d).select((F.col("free_pred") % 2).alias("task"), "item_id", "gold", F.explode(F.create_map(F.lit("free"), F.col("free_pred"), F.lit("llm"), F.col("llm_pred"))).alias("candidate", "p"))
    b = m.balanced_accuracy(x, ["task", "candidate"], "gold", "p").withColumnRenamed("balanced_accuracy", "bal").drop("classes")
    best = F.row_number().over(Window.partitionBy("task").orderBy(F.desc(F.round("bal", 12)), "candidate")) == 1
    return b.select("task", "candidate", "bal", best.alias("best"), F.when(F.col("bal") >= 0.75, "match").when(F.col("bal") >= 0.7, "close").otherwise("short").alias("verdict"))


_PAIR = f"""k AS (SELECT repeat, count(*) AS n, avg(free_ok::DOUBLE) AS a, avg(llm_ok::DOUBLE) AS l, avg(CASE WHEN kept = 1 THEN free_ok ELSE llm_ok END::DOUBLE) AS c, sum((kept = 1 AND free_ok > llm_ok)::INT) AS b, sum((kept = 1 AND free_ok < llm_ok)::INT) AS w, avg(kept::DOUBLE) AS kept FROM {R} GROUP BY 1),
z AS (SELECT *, CASE WHEN b + w > 0 THEN (b - w)::DOUBLE / sqrt(b + w) ELSE 0.0 END AS z FROM k)"""


@plans.add("q320_repeat_stats", f"WITH {_PAIR} SELECT repeat, n, a AS cheap, l AS incumbent, c AS cascade, c - l AS delta, z, kept, CASE WHEN c - l > -0.05 THEN 'holds' ELSE 'falls' END AS verdict FROM z")
def repeat_stats(spark, d):
    """The paired block of each repeat."""
    return _repeat_stats(spark, d).select("repeat", "n", F.col("a").alias("cheap"), F.col("l").alias("incumbent"), F.col("c").alias("cascade"), (F.col("c") - F.col("l")).alias("delta"), "z", "kept", F.when(F.col("c") - F.col("l") > -0.05, "holds").otherwise("falls").alias("verdict"))


def _repeat_stats(spark, d):
    kept = F.col("kept") == 1
    k = repeats(spark, d).groupBy("repeat").agg(F.count("*").alias("n"), F.avg("free_ok").alias("a"), F.avg("llm_ok").alias("l"), F.avg(F.when(kept, F.col("free_ok")).otherwise(F.col("llm_ok"))).alias("c"), F.count_if(kept & (F.col("free_ok") > F.col("llm_ok"))).alias("b"), F.count_if(kept & (F.col("free_ok") < F.col("llm_ok"))).alias("w"), F.avg("kept").alias("kept"))
    n = F.col("b") + F.col("w")
    return k.withColumn("z", F.when(n > 0, (F.col("b") - F.col("w")) / F.sqrt(n.cast("double"))).otherwise(0.0))


@plans.add("q321_pair_analysis", f"WITH {_PAIR} SELECT count(*) AS repeats, avg(a) AS cheap, avg(l) AS incumbent, avg(c) AS cascade, avg(kept) AS kept, min(c - l) AS worst_delta, bool_and(c - l > -0.05) AS holds FROM z")
def pair_analysis(spark, d):
    """The repeats in one row."""
    return _repeat_stats(spark, d).agg(F.count("*").alias("repeats"), F.avg("a").alias("cheap"), F.avg("l").alias("incumbent"), F.avg("c").alias("cascade"), F.avg("kept").alias("kept"), F.min(F.col("c") - F.col("l")).alias("worst_delta"), F.bool_and(F.col("c") - F.col("l") > -0.05).alias("holds"))


@plans.add("q241_llm_price", f"SELECT model, round(sum((in_tokens * price_in + out_tokens * price_out) / 1e6::DOUBLE), 6) AS usd FROM {P} JOIN {_PRICES_SQL} ON model = CASE gold % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END GROUP BY 1")
def llm_price(spark, d):
    """Every call at the price of its own model."""
    key = F.when(F.col("gold") % 3 == 0, "small").when(F.col("gold") % 3 == 1, "medium").otherwise("large")
    x = pair_log(spark, d).withColumn("model", key).join(F.broadcast(prices(spark)), "model")  # a few rows
    return x.groupBy("model").agg(F.round(F.sum((F.col("in_tokens") * F.col("price_in") + F.col("out_tokens") * F.col("price_out")) / 1e6), 6).alias("usd"))


@plans.add("q346_selection_sweep", f"WITH s AS (SELECT p.w, p.c, avg(CASE WHEN {u_sql(431, 'item_id')} < 0.7::DOUBLE THEN CASE WHEN free_conf < p.c THEN llm_ok ELSE free_ok END * p.w END::DOUBLE) AS inner_score, avg(CASE WHEN {u_sql(431, 'item_id')} >= 0.7::DOUBLE THEN CASE WHEN free_conf < p.c THEN llm_ok ELSE free_ok END * p.w END::DOUBLE) AS test_score FROM {P}, (SELECT w, c FROM (SELECT unnest([0.9, 1.0])::DOUBLE AS w), (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS c)) p GROUP BY ALL) SELECT w, c, inner_score, row_number() OVER (ORDER BY round(inner_score, 12) DESC, w, c) AS place, CASE WHEN row_number() OVER (ORDER BY round(inner_score, 12) DESC, w, c) = 1 THEN test_score END AS test_score FROM s")
def selection_sweep(spark, d):
    """A grid of settings ranked on a part of the items; the winner alone is scored on the rest, once."""
    x = pair_log(spark, d).withColumn("w", F.explode(F.array(F.lit(0.9), F.lit(1.0)))).withColumn("c", F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))))
    value = F.when(F.col("free_conf") < F.col("c"), F.col("llm_ok")).otherwise(F.col("free_ok")) * F.col("w")
    inner = u(431, "item_id") < 0.7
    s = x.groupBy("w", "c").agg(F.avg(F.when(inner, value)).alias("inner_score"), F.avg(F.when(~inner, value)).alias("t"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("inner_score", 12)), "w", "c"))  # one row a setting
    return s.withColumn("place", place).select("w", "c", "inner_score", "place", F.when(F.col("place") == 1, F.col("t")).alias("test_score"))
