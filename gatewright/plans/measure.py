"""Queries on metrics, paired tests and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatewright.functions import stats
from gatewright.operators import metrics as m
from gatewright.plans.base import Plans
from gatewright.sources.fixtures import CLASSES, DOC_CLASSES_SQL, PAIR_LOG_SQL, REPEATS_SQL, doc_classes, pair_log, repeats, u, u_sql

plans = Plans()
P, R = f"({PAIR_LOG_SQL})", f"({REPEATS_SQL})"


def classes(spark):
    return spark.range(CLASSES).select(F.col("id").cast("int").alias("cls"))


@plans.add("q096_accuracy", f"SELECT repeat, avg(free_ok::DOUBLE) AS accuracy, count(*) AS n FROM {R} GROUP BY repeat")
def accuracy(spark, d):
    return m.accuracy(repeats(spark, d), ["repeat"], "gold", "free_pred")


@plans.add("q097_class_recall", f"SELECT repeat, gold AS cls, avg(free_ok::DOUBLE) AS recall, count(*) AS support FROM {R} GROUP BY repeat, gold")
def class_recall(spark, d):
    return m.class_recall(repeats(spark, d), ["repeat"], "gold", "free_pred")


@plans.add("q098_class_recall_all", f"SELECT c AS cls, avg(free_ok::DOUBLE) AS recall, count(gold) AS support FROM (SELECT unnest(range({CLASSES + 2}))::INT AS c) LEFT JOIN {P} ON gold = c GROUP BY c")
def class_recall_all(spark, d):
    every = spark.range(CLASSES + 2).select(F.col("id").cast("int").alias("cls"))
    return m.class_recall(pair_log(spark, d), [], "gold", "free_pred", every)


@plans.add("q099_balanced_accuracy", f"SELECT repeat, avg(r) AS balanced_accuracy, count(*) AS classes FROM (SELECT repeat, gold, avg(free_ok::DOUBLE) AS r FROM {R} GROUP BY repeat, gold) GROUP BY repeat")
def balanced(spark, d):
    return m.balanced_accuracy(repeats(spark, d), ["repeat"], "gold", "free_pred")


@plans.add("q102_macro_f1", f"""WITH t AS {R}, g AS (SELECT repeat, gold AS c, count(*) AS n FROM t GROUP BY 1, 2), p AS (SELECT repeat, free_pred AS c, count(*) AS n, sum(free_ok) AS h FROM t GROUP BY 1, 2)
SELECT r.repeat, avg(coalesce(2.0::DOUBLE * p.h / (coalesce(g.n, 0) + coalesce(p.n, 0)), 0.0::DOUBLE)) AS macro_f1
FROM (SELECT DISTINCT repeat FROM t) r CROSS JOIN (SELECT unnest(range({CLASSES}))::INT AS c) k LEFT JOIN g ON g.repeat = r.repeat AND g.c = k.c LEFT JOIN p ON p.repeat = r.repeat AND p.c = k.c GROUP BY r.repeat""")
def macro_f1(spark, d):
    return m.macro_f1(repeats(spark, d), ["repeat"], "gold", "free_pred", classes(spark))


@plans.add("q104_mcc", f"""WITH t AS {R}, s AS (SELECT repeat, count(*)::DOUBLE AS s, sum(free_ok)::DOUBLE AS c FROM t GROUP BY 1),
g AS (SELECT repeat, gold AS k, count(*)::DOUBLE AS t FROM t GROUP BY 1, 2), p AS (SELECT repeat, free_pred AS k, count(*)::DOUBLE AS p FROM t GROUP BY 1, 2),
x AS (SELECT coalesce(g.repeat, p.repeat) AS repeat, sum(coalesce(t, 0) * coalesce(p, 0)) AS tp, sum(coalesce(t, 0) * coalesce(t, 0)) AS tt, sum(coalesce(p, 0) * coalesce(p, 0)) AS pp FROM g FULL JOIN p ON g.repeat = p.repeat AND g.k = p.k GROUP BY 1)
SELECT repeat, (c * s - tp) / sqrt((s * s - pp) * (s * s - tt)) AS mcc FROM s JOIN x USING (repeat)""")
def mcc(spark, d):
    return m.mcc(repeats(spark, d), ["repeat"], "gold", "free_pred")


@plans.add("q105_auroc", f"""WITH t AS (SELECT repeat, round(free_conf, 2) AS s, free_ok FROM {R}), k AS (SELECT repeat, s, sum(free_ok)::DOUBLE AS p, sum(1 - free_ok)::DOUBLE AS n FROM t GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY repeat ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM k)
SELECT repeat, sum(p * (b + n / 2)) / (sum(p) * sum(n)) AS auroc FROM w GROUP BY repeat""")
def auroc(spark, d):
    return m.auroc(repeats(spark, d).withColumn("s", F.round("free_conf", 2)), ["repeat"], "s", "free_ok")


@plans.add("q106_scope_metrics", f"""SELECT t.t AS threshold, avg((CASE WHEN free_conf >= t.t THEN free_pred ELSE 9 END = gold)::INT::DOUBLE) AS accuracy,
  avg(CASE WHEN gold < 9 THEN (free_conf >= t.t AND free_pred = gold)::INT::DOUBLE END) AS in_scope_accuracy, avg(CASE WHEN gold = 9 THEN (free_conf < t.t OR free_pred = 9)::INT::DOUBLE END) AS out_of_scope_recall, avg((free_conf >= t.t)::INT::DOUBLE) AS answered
FROM {P}, (SELECT unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS t) t GROUP BY t.t""")
def scope_metrics(spark, d):
    """Class 9 stands for out of scope; below the threshold the answer is class 9."""
    x = pair_log(spark, d).withColumn("threshold", F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))))
    kept = F.col("free_conf") >= F.col("threshold")
    num = lambda c: c.cast("double")
    return x.groupBy("threshold").agg(
        F.avg(num(F.when(kept, F.col("free_pred")).otherwise(9) == F.col("gold"))).alias("accuracy"),
        F.avg(F.when(F.col("gold") < 9, num(kept & (F.col("free_pred") == F.col("gold"))))).alias("in_scope_accuracy"),
        F.avg(F.when(F.col("gold") == 9, num(~kept | (F.col("free_pred") == 9)))).alias("out_of_scope_recall"),
        F.avg(num(kept)).alias("answered"),
    )


@plans.add("q107_confusion", f"SELECT gold, free_pred AS pred, count(*) AS n FROM {P} GROUP BY 1, 2")
def confusion(spark, d):
    return m.confusion(pair_log(spark, d), [], "gold", "free_pred")


@plans.add("q187_top_confusions", f"SELECT gold, free_pred AS pred, count(*) AS n FROM {P} WHERE gold <> free_pred GROUP BY 1, 2 ORDER BY n DESC, gold, pred LIMIT 8")
def top_confusions(spark, d):
    return m.confusion(pair_log(spark, d), [], "gold", "free_pred").where("gold <> pred").orderBy(F.desc("n"), "gold", "pred").limit(8)


@plans.add("q108_paired_table", f"SELECT CASE WHEN free_ok = 1 AND llm_ok = 1 THEN 'both' WHEN free_ok = 1 THEN 'a_only' WHEN llm_ok = 1 THEN 'b_only' ELSE 'neither' END AS cell, count(*) AS n, avg((free_conf < 0.5::DOUBLE)::INT::DOUBLE) AS sent_share FROM {P} GROUP BY 1")
def paired_table(spark, d):
    return m.paired_table(pair_log(spark, d).withColumn("sent", (F.col("free_conf") < 0.5).cast("int")), [], "free_ok", "llm_ok", "sent")


@plans.add("q109_profile", f"""WITH t AS ({DOC_CLASSES_SQL}), k AS (SELECT gold, count(*) AS n FROM t GROUP BY 1), c AS (SELECT grp, count(*) AS n FROM t GROUP BY 1)
SELECT (SELECT sum(n)::BIGINT FROM k) AS n, (SELECT count(*) FROM k) AS classes, (SELECT arg_max(gold, n * 1000 - gold) FROM k) AS majority, (SELECT max(n)::DOUBLE / min(n) FROM k) AS imbalance, (SELECT sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT FROM c) AS shared_text_rows""")
def profile(spark, d):
    t = doc_classes(spark, d)
    k = t.groupBy("gold").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.max_by("gold", F.struct("n", -F.col("gold"))).alias("majority"), (F.max("n") / F.min("n")).alias("imbalance"))
    c = t.groupBy("grp").agg(F.count("*").alias("c")).agg(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("shared_text_rows"))
    return k.crossJoin(c)  # one row each


@plans.add("q110_resolution_floor", f"SELECT sqrt(0.25::DOUBLE / min(n)) / sqrt(count(*)::DOUBLE) AS floor FROM (SELECT gold, count(*) AS n FROM {P} GROUP BY 1)")
def resolution_floor(spark, d):
    return pair_log(spark, d).groupBy("gold").agg(F.count("*").alias("n")).agg((F.sqrt(0.25 / F.min("n")) / F.sqrt(F.count("*").cast("double"))).alias("floor"))


@plans.add("q112_class_advantage", f"""WITH k AS (SELECT free_pred AS cls, count(*) AS n, avg(free_ok::DOUBLE) AS free_acc, avg(llm_ok::DOUBLE) AS llm_acc FROM {P} GROUP BY 1)
SELECT cls, n, free_acc, llm_acc, n / sum(n) OVER () AS share, llm_acc - free_acc AS advantage, max(CASE WHEN n >= 10 THEN llm_acc - free_acc END) OVER () - min(CASE WHEN n >= 10 THEN llm_acc - free_acc END) OVER () AS spread FROM k""")
def class_advantage(spark, d):
    return m.class_advantage(pair_log(spark, d), [], "free_pred", "free_ok", "llm_ok", 10)


@plans.add("q113_precision_by_class", f"SELECT min(p) AS least, max(p) - min(p) AS spread, min(p) >= 0.5::DOUBLE AS open FROM (SELECT free_pred, avg(free_ok::DOUBLE) AS p FROM {P} GROUP BY 1)")
def precision_by_class(spark, d):
    return pair_log(spark, d).groupBy("free_pred").agg(F.avg("free_ok").alias("p")).agg(F.min("p").alias("least"), (F.max("p") - F.min("p")).alias("spread"), (F.min("p") >= 0.5).alias("open"))


@plans.add("q114_competence", f"""WITH l AS (SELECT 'free' AS model, free_pred AS cls, free_ok::DOUBLE AS ok FROM {P} UNION ALL SELECT 'llm', llm_pred, llm_ok::DOUBLE FROM {P}), k AS (SELECT model, cls, sum(ok) AS hits, count(*) AS n FROM l GROUP BY 1, 2)
SELECT *, (hits + 20.0::DOUBLE * (sum(hits) OVER (PARTITION BY model) / sum(n) OVER (PARTITION BY model))) / (n + 20) AS score FROM k""")
def competence(spark, d):
    return m.competence(pair_log(spark, d), [], {"free": ("free_pred", "free_ok"), "llm": ("llm_pred", "llm_ok")})


@plans.add("q115_pool_diversity", f"""WITH t AS (SELECT gold, free_pred, llm_pred, free_ok, llm_ok, row_number() OVER (PARTITION BY gold ORDER BY item_id) AS k, row_number() OVER (PARTITION BY gold ORDER BY {u_sql(91, "item_id")}, item_id) AS j FROM {P})
SELECT avg(greatest(a.free_ok, a.llm_ok)::DOUBLE) AS oracle, avg((a.free_pred <> a.llm_pred)::INT::DOUBLE) AS disagreement, avg(greatest(a.free_ok, b.llm_ok)::DOUBLE) AS permuted_oracle FROM t a JOIN t b ON a.gold = b.gold AND a.k = b.j""")
def pool_diversity(spark, d):
    """The oracle of the pool against that of outcomes permuted within classes."""
    t = pair_log(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("gold").orderBy("item_id"))).withColumn("j", F.row_number().over(Window.partitionBy("gold").orderBy(u(91, "item_id"), "item_id")))
    other = t.select("gold", F.col("j").alias("k"), F.col("llm_ok").alias("other_ok"))
    return t.join(other, ["gold", "k"]).agg(F.avg(F.greatest("free_ok", "llm_ok")).alias("oracle"), F.avg((F.col("free_pred") != F.col("llm_pred")).cast("double")).alias("disagreement"), F.avg(F.greatest("free_ok", "other_ok")).alias("permuted_oracle"))


def _tpr_sql(c: str) -> str:
    rates = (0.1, 0.25, 0.5)
    cols = ", ".join(f"sum(CASE WHEN place <= {r}::DOUBLE THEN pos ELSE 0 END)::DOUBLE / sum(pos) AS r{k}" for k, r in enumerate(rates))
    return f"SELECT '{c}' AS model, {cols} FROM (SELECT pos, row_number() OVER (ORDER BY {c} DESC, pos)::DOUBLE / count(*) OVER () AS place FROM x)"


@plans.add("q116_roc_dominance", f"""WITH x AS (SELECT free_ok AS pos, free_conf AS a, {u_sql(92, "item_id")} AS b FROM {P}), t AS ({_tpr_sql("a")} UNION ALL {_tpr_sql("b")})
SELECT p.model, q.model AS other, p.r0 >= q.r0 AND p.r1 >= q.r1 AND p.r2 >= q.r2 AS dominates FROM t p JOIN t q ON p.model <> q.model""")
def roc_dominance(spark, d):
    x = pair_log(spark, d).select(F.col("free_ok").alias("pos"), F.col("free_conf").alias("a"), u(92, "item_id").alias("b"))
    return m.roc_dominance(x, {"a": "a", "b": "b"}, "pos", [0.1, 0.25, 0.5])


@plans.add("q127_ece", f"""WITH b AS (SELECT repeat, greatest(ceil(free_conf * 10)::INT - 1, 0) AS bin, count(*) AS n, avg(free_conf) AS c, avg(free_ok::DOUBLE) AS a FROM {R} GROUP BY 1, 2)
SELECT repeat, sum(n * abs(c - a)) / sum(n) AS ece FROM b GROUP BY repeat""")
def ece(spark, d):
    return m.ece(repeats(spark, d), ["repeat"], "free_conf", "free_ok")


@plans.add("q128_reliability", f"""SELECT k AS bin, count(free_ok) AS n, avg(free_conf) AS confidence, avg(free_ok::DOUBLE) AS accuracy
FROM (SELECT unnest(range(20))::INT AS k) LEFT JOIN (SELECT free_ok, free_conf, greatest(ceil(free_conf * 20)::INT - 1, 0) AS bin FROM {P}) ON bin = k GROUP BY k""")
def reliability(spark, d):
    return m.calibration_table(pair_log(spark, d), [], "free_conf", "free_ok", 20)


@plans.add("q141_judge_agreement", f"""WITH l AS (SELECT item_id, 'free' AS judge, free_pred AS v FROM {P} UNION ALL SELECT item_id, 'llm', llm_pred FROM {P} UNION ALL SELECT item_id, 'gold', gold FROM {P})
SELECT a.judge AS judge, b.judge AS other, avg((a.v = b.v)::INT::DOUBLE) AS exact, avg((a.v // 3 = b.v // 3)::INT::DOUBLE) AS coarse FROM l a JOIN l b ON a.item_id = b.item_id AND a.judge < b.judge GROUP BY 1, 2""")
def judge_agreement(spark, d):
    pairs = F.array(*[F.struct(F.lit(a).alias("judge"), F.lit(b).alias("other"), F.col(x).alias("a"), F.col(y).alias("b")) for a, x, b, y in (("free", "free_pred", "llm", "llm_pred"), ("free", "free_pred", "gold", "gold"), ("gold", "gold", "llm", "llm_pred"))])
    x = pair_log(spark, d).select(F.explode(pairs).alias("x")).select("x.*")
    return x.groupBy("judge", "other").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("exact"), F.avg((F.floor(F.col("a") / 3) == F.floor(F.col("b") / 3)).cast("double")).alias("coarse"))


@plans.add("q142_weighted_share", f"SELECT gold, sum(in_tokens::DOUBLE * free_ok) / sum(in_tokens::DOUBLE) AS share, sum(in_tokens::DOUBLE) * sum(in_tokens::DOUBLE) / sum(in_tokens::DOUBLE * in_tokens) AS n_effective FROM {P} GROUP BY gold")
def weighted_share(spark, d):
    return m.weighted_share(pair_log(spark, d), ["gold"], "free_ok", "in_tokens")


@plans.add("q157_mean_over_repeats", f"""WITH k AS (SELECT repeat, avg(free_ok::DOUBLE) AS accuracy, avg(kept::DOUBLE) AS kept_rate, avg(latency_s) AS latency FROM {R} GROUP BY 1)
SELECT path, avg(value) AS mean, min(value) AS least, max(value) AS most FROM (UNPIVOT k ON accuracy, kept_rate, latency INTO NAME path VALUE value) GROUP BY path""")
def mean_over_repeats(spark, d):
    k = repeats(spark, d).groupBy("repeat").agg(F.avg("free_ok").alias("accuracy"), F.avg("kept").alias("kept_rate"), F.avg("latency_s").alias("latency"))
    return k.unpivot("repeat", ["accuracy", "kept_rate", "latency"], "path", "value").groupBy("path").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@plans.add("q155_sent_subset", f"SELECT repeat, kept, count(*) AS n, avg(free_ok::DOUBLE) AS free_acc, avg(llm_ok::DOUBLE) AS llm_acc FROM {R} GROUP BY 1, 2")
def sent_subset(spark, d):
    return repeats(spark, d).groupBy("repeat", "kept").agg(F.count("*").alias("n"), F.avg("free_ok").alias("free_acc"), F.avg("llm_ok").alias("llm_acc"))


@plans.add("q156_cascade_stats", f"""SELECT repeat, avg((CASE WHEN kept = 1 THEN free_pred ELSE llm_pred END = gold)::INT::DOUBLE) AS accuracy, avg(1.0::DOUBLE - kept) AS llm_share,
  1000 * avg(CASE WHEN kept = 1 THEN 0.0::DOUBLE ELSE ((in_tokens - cached_tokens) * 0.6::DOUBLE + cached_tokens * 0.06::DOUBLE + out_tokens * 2.2::DOUBLE) / 1e6::DOUBLE END) AS usd_per_1k, avg(CASE WHEN free_ok = 0 THEN llm_ok ELSE free_ok END::DOUBLE) AS oracle_accuracy FROM {R} GROUP BY repeat""")
def cascade_stats(spark, d):
    cost = stats.call_cost(F.col("in_tokens"), F.col("out_tokens"), F.col("cached_tokens"), F.lit(0.6), F.lit(2.2), F.lit(0.06))
    kept = F.col("kept") == 1
    return repeats(spark, d).groupBy("repeat").agg(F.avg((F.when(kept, F.col("free_pred")).otherwise(F.col("llm_pred")) == F.col("gold")).cast("double")).alias("accuracy"), F.avg(1.0 - F.col("kept")).alias("llm_share"), (1000 * F.avg(F.when(kept, 0.0).otherwise(cost))).alias("usd_per_1k"), F.avg(F.greatest("free_ok", "llm_ok")).alias("oracle_accuracy"))


_LN = "(SELECT i, coalesce(sum(ln(i::DOUBLE)) OVER (ORDER BY i), 0.0) AS l FROM (SELECT unnest(range(1, 100001)) AS i) UNION ALL SELECT 0, 0.0)"


@plans.add("q218_mcnemar", f"""WITH k AS (SELECT gold, sum((free_ok = 1 AND llm_ok = 0)::INT)::BIGINT AS b, sum((free_ok = 0 AND llm_ok = 1)::INT)::BIGINT AS c FROM {P} GROUP BY gold),
n AS (SELECT *, b + c AS n, least(b, c) AS k FROM k),
t AS (SELECT gold, b, c, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2))) AS upto, max(CASE WHEN j = k THEN exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2)) END) AS pmf FROM n, (SELECT unnest(range(0, 3000)) AS j) WHERE j <= k GROUP BY gold, b, c)
SELECT gold, b, c, round(CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE least(2 * upto, 1.0::DOUBLE) END, 7) AS p_exact, round(CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE least(2 * upto - pmf, 1.0::DOUBLE) END, 7) AS p_midp FROM t""")
def mcnemar(spark, d):
    k = pair_log(spark, d).groupBy("gold").agg(F.count_if((F.col("free_ok") == 1) & (F.col("llm_ok") == 0)).alias("b"), F.count_if((F.col("free_ok") == 0) & (F.col("llm_ok") == 1)).alias("c"))
    b, c = F.col("b"), F.col("c")
    return k.select("gold", "b", "c", F.round(stats.mcnemar(b, c, "exact"), 7).alias("p_exact"), F.round(stats.mcnemar(b, c, "midp"), 7).alias("p_midp"))


@plans.add("q219_mcnemar_chi2")
def mcnemar_chi2(spark, d):
    k = pair_log(spark, d).groupBy("gold").agg(F.count_if((F.col("free_ok") == 1) & (F.col("llm_ok") == 0)).alias("b"), F.count_if((F.col("free_ok") == 0) & (F.col("llm_ok") == 1)).alias("c"))
    return k.select("gold", "b", "c", stats.mcnemar(F.col("b"), F.col("c"), "chi2").alias("p_chi2"))


_Z = f"{stats.Z95!r}::DOUBLE"


@plans.add("q215_wilson", f"""SELECT gold, k, n, greatest((k / n + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 0.0) AS low,
  least((k / n + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 1.0) AS high FROM (SELECT gold, sum(free_ok)::DOUBLE AS k, count(*)::DOUBLE AS n FROM {P} GROUP BY gold)""")
def wilson(spark, d):
    k = pair_log(spark, d).groupBy("gold").agg(F.sum("free_ok").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return k.select("gold", "k", "n", low.alias("low"), high.alias("high"))


@plans.add("q217_clopper_pearson")
def clopper_pearson(spark, d):
    k = pair_log(spark, d).groupBy("gold").agg(F.sum("free_ok").alias("k"), F.count("*").alias("n"))
    return k.select("gold", "k", "n", stats.clopper_pearson("k", "n").alias("x")).select("gold", "k", "n", "x.*")


@plans.add("q222_tango")
def tango(spark, d):
    """Score interval of the difference and the verdict of a non-inferiority test at a margin of 0.05."""
    k = pair_log(spark, d).groupBy("gold").agg(F.count_if((F.col("free_ok") == 1) & (F.col("llm_ok") == 0)).alias("b"), F.count_if((F.col("free_ok") == 0) & (F.col("llm_ok") == 1)).alias("c"), F.count("*").alias("n"))
    x = k.withColumn("x", stats.tango("b", "c", "n")).select("gold", ((F.col("b") - F.col("c")) / F.col("n")).alias("delta"), "x.*")
    return x.withColumn("verdict", F.when(F.col("low") > 0, "superior").when(F.col("low") > -0.05, "non-inferior").when(F.col("high") < -0.05, "inferior").otherwise("unclear"))


_PV = f"SELECT gold, free_pred, round({u_sql(93, 'gold', 'free_pred')} * {u_sql(94, 'gold', 'free_pred')}, 6) * 0.2::DOUBLE AS p FROM {P} WHERE gold <> free_pred GROUP BY 1, 2"


def p_values(spark, d):
    return pair_log(spark, d).where("gold <> free_pred").select("gold", "free_pred").distinct().withColumn("p", F.round(u(93, "gold", "free_pred") * u(94, "gold", "free_pred"), 6) * 0.2)


@plans.add("q225_holm", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY p, free_pred) AS r, count(*) OVER (PARTITION BY gold) AS m FROM ({_PV}))
SELECT gold, free_pred, p, min((p <= 0.05::DOUBLE / (m - r + 1))::INT) OVER (PARTITION BY gold ORDER BY r) = 1 AS rejected FROM t""")
def holm(spark, d):
    return stats.holm_steps(p_values(spark, d), "p", ["gold"], order="free_pred")


@plans.add("q226_adjust", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY p, free_pred) AS r, count(*) OVER (PARTITION BY gold) AS m FROM ({_PV})),
a AS (SELECT 'holm' AS method, gold, free_pred, p, max(least(p * (m - r + 1), 1.0)) OVER (PARTITION BY gold ORDER BY r) AS p_adj FROM t UNION ALL SELECT 'bh', gold, free_pred, p, min(least(p * m / r, 1.0)) OVER (PARTITION BY gold ORDER BY r DESC) FROM t)
SELECT *, p_adj <= 0.05::DOUBLE AS reject FROM a""")
def adjust(spark, d):
    p = p_values(spark, d)
    return stats.adjust(p, "p", ["gold"], "holm", order="free_pred").withColumn("method", F.lit("holm")).unionByName(stats.adjust(p, "p", ["gold"], "bh", order="free_pred").withColumn("method", F.lit("bh")))


@plans.add("q227_seed_summary", f"""WITH k AS (SELECT repeat, avg(free_ok::DOUBLE) AS a FROM {R} GROUP BY 1), f AS (SELECT avg((lo <> hi)::INT::DOUBLE) AS flip_rate FROM (SELECT item_id, min(free_ok) AS lo, max(free_ok) AS hi FROM {R} GROUP BY 1))
SELECT avg(a) AS mean, stddev_samp(a) AS sd, max(flip_rate) AS flip_rate, avg(a) - 4.302652729911275::DOUBLE * stddev_samp(a) / sqrt(3::DOUBLE) AS low, avg(a) + 4.302652729911275::DOUBLE * stddev_samp(a) / sqrt(3::DOUBLE) AS high FROM k, f""")
def seed_summary(spark, d):
    """Mean, deviation and t interval (two degrees of freedom) over repeats, and the share of items that flip."""
    r = repeats(spark, d)
    t = 4.302652729911275  # the 97.5 % quantile of Student's t with two degrees of freedom
    k = r.groupBy("repeat").agg(F.avg("free_ok").alias("a")).agg(F.avg("a").alias("mean"), F.stddev_samp("a").alias("sd"))
    f = r.groupBy("item_id").agg((F.min("free_ok") != F.max("free_ok")).cast("double").alias("x")).agg(F.avg("x").alias("flip_rate"))
    half = t * F.col("sd") / F.sqrt(F.lit(3.0))
    return k.crossJoin(f).withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)  # one row each


@plans.add("q230_sample_sizes", f"""SELECT gold, dis, ceil({(stats.normal_quantile(0.95) + stats.normal_quantile(0.8)) ** 2!r}::DOUBLE * (dis - 0.0::DOUBLE) / (0.05::DOUBLE * 0.05::DOUBLE))::BIGINT AS n_needed, {stats.normal_quantile(0.975) + stats.normal_quantile(0.8)!r}::DOUBLE * sqrt(dis / n) AS min_delta
FROM (SELECT gold, avg((free_ok <> llm_ok)::INT::DOUBLE) AS dis, count(*) AS n FROM {P} GROUP BY gold)""")
def sample_sizes(spark, d):
    k = pair_log(spark, d).groupBy("gold").agg(F.avg((F.col("free_ok") != F.col("llm_ok")).cast("double")).alias("dis"), F.count("*").alias("n"))
    return k.select("gold", "dis", stats.sample_size_ni(F.col("dis"), F.lit(0.05)).alias("n_needed"), stats.min_detectable(F.col("n"), F.col("dis")).alias("min_delta"))


@plans.add("q228_label_noise", f"SELECT gold, e, 1 - e AS ceiling, a > 1 - e AS above_ceiling FROM (SELECT gold, avg((free_ok = 0 AND llm_ok = 0)::INT::DOUBLE) AS e, avg(llm_ok::DOUBLE) AS a FROM {P} GROUP BY gold)")
def label_noise(spark, d):
    k = pair_log(spark, d).groupBy("gold").agg(F.avg(((F.col("free_ok") == 0) & (F.col("llm_ok") == 0)).cast("double")).alias("e"), F.avg("llm_ok").alias("a"))
    return k.select("gold", "e", (1 - F.col("e")).alias("ceiling"), (F.col("a") > 1 - F.col("e")).alias("above_ceiling"))


@plans.add("q234_task_verdict", f"""SELECT gold, acc, CASE WHEN low >= 0.75::DOUBLE THEN 'match' WHEN acc >= 0.75::DOUBLE - 0.05::DOUBLE THEN 'close' WHEN gold = 9 THEN 'no_reference' ELSE 'short' END AS verdict FROM (SELECT gold, avg(free_ok::DOUBLE) AS acc, avg(free_ok::DOUBLE) - {_Z} * sqrt(avg(free_ok::DOUBLE) * (1 - avg(free_ok::DOUBLE)) / count(*)) AS low FROM {P} GROUP BY gold)""")
def task_verdict(spark, d):
    a = F.avg("free_ok")
    k = pair_log(spark, d).groupBy("gold").agg(a.alias("acc"), (a - stats.Z95 * F.sqrt(a * (1 - a) / F.count("*"))).alias("low"))
    return k.select("gold", "acc", F.when(F.col("low") >= 0.75, "match").when(F.col("acc") >= 0.70, "close").when(F.col("gold") == 9, "no_reference").otherwise("short").alias("verdict"))


@plans.add("q235_cascade_estimate", f"SELECT avg(kr * coalesce(mk, 0.0) + (1 - kr) * 0.8::DOUBLE) AS estimate FROM (SELECT gold, avg(kept::DOUBLE) AS kr, avg(CASE WHEN kept = 1 THEN free_ok::DOUBLE END) AS mk FROM {R} GROUP BY gold)")
def cascade_estimate(spark, d):
    """Kept share at its accuracy, the rest at a published 0.8, per class."""
    k = repeats(spark, d).groupBy("gold").agg(F.avg("kept").alias("kr"), F.avg(F.when(F.col("kept") == 1, F.col("free_ok").cast("double"))).alias("mk"))
    return k.agg(F.avg(F.col("kr") * F.coalesce("mk", F.lit(0.0)) + (1 - F.col("kr")) * 0.8).alias("estimate"))


@plans.add("q125_cost_latency", f"SELECT kept, sum(((in_tokens - cached_tokens) * 0.6::DOUBLE + cached_tokens * 0.06::DOUBLE + out_tokens * 2.2::DOUBLE) / 1e6::DOUBLE) AS usd, quantile_cont(latency_s, 0.5) AS p50, quantile_cont(latency_s, 0.95) AS p95 FROM {R} GROUP BY kept")
def cost_latency(spark, d):
    cost = stats.call_cost(F.col("in_tokens"), F.col("out_tokens"), F.col("cached_tokens"), F.lit(0.6), F.lit(2.2), F.lit(0.06))
    return repeats(spark, d).groupBy("kept").agg(F.sum(cost).alias("usd"), F.percentile("latency_s", 0.5).alias("p50"), F.percentile("latency_s", 0.95).alias("p95"))
