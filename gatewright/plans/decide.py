"""Queries on deferral, running thresholds, conformal sets, folds and bootstraps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatewright.operators import conformal as c
from gatewright.operators import defer as g
from gatewright.operators import folds as f
from gatewright.operators import metrics as m
from gatewright.plans.base import Plans
from gatewright.sources.fixtures import CLASSES, DOC_CLASSES_SQL, PAIR_LOG_SQL, PROBA_SQL, REPEATS_SQL, TURNS_SQL, doc_classes, members, pair_log, proba, repeats, turns, u_sql

plans = Plans()
P, R, Q = f"({PAIR_LOG_SQL})", f"({REPEATS_SQL})", f"({PROBA_SQL})"

GATE_SQL = f"""k AS (SELECT fold, free_pred, count(*) AS n, sum(free_ok) AS f, sum(llm_ok) AS l FROM {P} GROUP BY 1, 2),
o AS (SELECT fold, free_pred, sum(n) OVER w - n AS n, sum(f) OVER w - f AS f, sum(l) OVER w - l AS l FROM k WINDOW w AS (PARTITION BY free_pred)),
e AS (SELECT p.*, coalesce(o.n > 0 AND (o.l - o.f)::DOUBLE / o.n > 0.0, false) AS escalate FROM {P} p JOIN o USING (fold, free_pred))"""


def _outcome_sql(source: str) -> str:
    return f"""SELECT avg(r) AS balanced_accuracy, sum(s) / sum(n) AS accuracy, sum(e) / sum(n) AS llm_share, sum(n)::BIGINT AS n FROM
  (SELECT gold, avg((CASE WHEN escalate THEN llm_pred ELSE free_pred END = gold)::INT::DOUBLE) AS r, sum((CASE WHEN escalate THEN llm_pred ELSE free_pred END = gold)::INT)::DOUBLE AS s, count(*) AS n, sum(escalate::INT) AS e FROM {source} GROUP BY gold)"""


@plans.add("q253_class_gate", f"WITH {GATE_SQL} {_outcome_sql('e')}")
def class_gate_outcome(spark, d):
    """The flagship: class-gated deferral, fitted on the other folds."""
    e = g.class_gate(pair_log(spark, d), [], "fold", "free_pred", "free_ok", "llm_ok")
    return g.outcome(e, [], "gold", "free_pred", "llm_pred", "escalate")


@plans.add("q253_class_gates", f"WITH {GATE_SQL} SELECT fold, free_pred, bool_and(escalate) AS escalate, count(*) AS n FROM e GROUP BY 1, 2")
def class_gates(spark, d):
    e = g.class_gate(pair_log(spark, d), [], "fold", "free_pred", "free_ok", "llm_ok")
    return e.groupBy("fold", "free_pred").agg(F.bool_and("escalate").alias("escalate"), F.count("*").alias("n"))


@plans.add("q257_margin_gate", f"WITH {GATE_SQL.replace('> 0.0, false', '> 0.1::DOUBLE, false')} {_outcome_sql('e')}")
def margin_gate(spark, d):
    e = g.class_gate(pair_log(spark, d), [], "fold", "free_pred", "free_ok", "llm_ok", margin=0.1)
    return g.outcome(e, [], "gold", "free_pred", "llm_pred", "escalate")


@plans.add("q254_confidence_cascade", f"""WITH {GATE_SQL}, s AS (SELECT fold, avg(escalate::INT::DOUBLE) AS share FROM e GROUP BY 1),
t AS (SELECT s.fold, quantile_cont(e.free_conf, any_value(s.share)) AS t FROM s JOIN e ON e.fold <> s.fold GROUP BY s.fold, s.share),
x AS (SELECT e.* EXCLUDE (escalate), free_conf <= t.t AS escalate FROM e JOIN t USING (fold)) {_outcome_sql('x')}""".replace("quantile_cont(e.free_conf, any_value(s.share))", "list_extract(list_sort(list(e.free_conf)), floor(any_value(s.share) * (count(*) - 1))::BIGINT + 1) + (list_extract(list_sort(list(e.free_conf)), ceil(any_value(s.share) * (count(*) - 1))::BIGINT + 1) - list_extract(list_sort(list(e.free_conf)), floor(any_value(s.share) * (count(*) - 1))::BIGINT + 1)) * (any_value(s.share) * (count(*) - 1) - floor(any_value(s.share) * (count(*) - 1)))"))
def confidence_cascade(spark, d):
    """The same share of items as the class gate sends, taken by confidence."""
    e = g.class_gate(pair_log(spark, d), [], "fold", "free_pred", "free_ok", "llm_ok")
    share = e.groupBy("fold").agg(F.avg(F.col("escalate").cast("double")).alias("share"))
    x = g.confidence_cascade(e.drop("escalate").join(F.broadcast(share), "fold"), [], "fold", "free_conf", "share")
    return g.outcome(x, [], "gold", "free_pred", "llm_pred", "escalate")


FRONTIER_SQL = """k AS (SELECT fold, s AS t, count(*) AS n, sum(free_ok) AS f, sum(llm_ok) AS l FROM x GROUP BY 1, 2),
fr AS (SELECT fold, t, sum(n) OVER u / sum(n) OVER (PARTITION BY fold) AS share, (sum(l) OVER u + sum(f) OVER (PARTITION BY fold) - sum(f) OVER u) / sum(n) OVER (PARTITION BY fold) AS accuracy FROM k WINDOW u AS (PARTITION BY fold ORDER BY t ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT fold, NULL, 0.0, avg(free_ok::DOUBLE) FROM x GROUP BY fold)"""


@plans.add("q184_threshold_frontier", f"WITH x AS (SELECT *, round(free_conf, 2) AS s FROM {P}), {FRONTIER_SQL} SELECT * FROM fr")
def threshold_frontier(spark, d):
    return g.threshold_frontier(pair_log(spark, d).withColumn("s", F.round("free_conf", 2)), ["fold"], "s", "free_ok", "llm_ok")


@plans.add("q185_operating_point", f"""WITH x AS (SELECT *, round(free_conf, 2) AS s FROM {P}), {FRONTIER_SQL}, b AS (SELECT fold, avg(llm_ok::DOUBLE) AS least FROM x GROUP BY 1)
SELECT fold, share, accuracy, t FROM (SELECT fr.*, row_number() OVER (PARTITION BY fold ORDER BY share, accuracy DESC, t) AS k FROM fr JOIN b USING (fold) WHERE accuracy >= least) WHERE k = 1""")
def operating_point(spark, d):
    x = pair_log(spark, d).withColumn("s", F.round("free_conf", 2))
    least = x.groupBy("fold").agg(F.avg("llm_ok").alias("least"))
    return g.cheapest_as_good(g.threshold_frontier(x, ["fold"], "s", "free_ok", "llm_ok").join(F.broadcast(least), "fold"), ["fold"], "least")


@plans.add("q161_running_precision", f"""SELECT item_id, avg(free_ok::DOUBLE) OVER w AS precision, count(*) OVER w AS support FROM (SELECT *, round(free_conf, 2) AS s FROM {P}) WINDOW w AS (PARTITION BY free_pred ORDER BY s DESC RANGE UNBOUNDED PRECEDING)""")
def running_precision(spark, d):
    return g.running_precision(pair_log(spark, d).withColumn("s", F.round("free_conf", 2)), [], "free_pred", "s", "free_ok").select("item_id", "precision", "support")


@plans.add("q163_guaranteed_coverage", f"""WITH r AS (SELECT free_pred, s, avg(free_ok::DOUBLE) OVER w AS p, count(*) OVER w AS k, count(*) OVER (PARTITION BY free_pred) AS n FROM (SELECT *, round(free_conf, 2) AS s FROM {P}) WINDOW w AS (PARTITION BY free_pred ORDER BY s DESC RANGE UNBOUNDED PRECEDING))
SELECT free_pred, min(CASE WHEN p >= 0.8::DOUBLE AND k >= 10 THEN s END) AS threshold, coalesce(max(CASE WHEN p >= 0.8::DOUBLE AND k >= 10 THEN k END), 0) / any_value(n) AS coverage FROM r GROUP BY free_pred""")
def guaranteed_coverage(spark, d):
    return g.guaranteed_coverage(pair_log(spark, d).withColumn("s", F.round("free_conf", 2)), [], "free_pred", "s", "free_ok", 0.8, 10)


@plans.add("q162_precision_floor", f"""WITH x AS (SELECT *, round(free_conf, 2) AS s FROM {P}), o AS (SELECT k.fold AS own, x.* FROM (SELECT DISTINCT fold FROM x) k JOIN x ON x.fold <> k.fold),
r AS (SELECT own, free_pred, s, avg(free_ok::DOUBLE) OVER w AS p, count(*) OVER w AS k, avg(llm_ok::DOUBLE) OVER (PARTITION BY own, free_pred) AS a FROM o WINDOW w AS (PARTITION BY own, free_pred ORDER BY s DESC RANGE UNBOUNDED PRECEDING)),
t AS (SELECT own AS fold, free_pred, min(s) AS t FROM r WHERE p >= 0.95::DOUBLE * a AND k >= 10 GROUP BY 1, 2),
e AS (SELECT x.*, coalesce(s < t.t, true) AS escalate FROM x LEFT JOIN t USING (fold, free_pred)) {_outcome_sql('e')}""")
def precision_floor(spark, d):
    x = pair_log(spark, d).withColumn("s", F.round("free_conf", 2))
    return g.outcome(g.precision_floor(x, [], "fold", "free_pred", "s", "free_ok", "llm_ok", 0.05, 10), [], "gold", "free_pred", "llm_pred", "escalate")


@plans.add("q165_error_share", f"""SELECT repeat, sum(CASE WHEN k <= round(n * 0.2::DOUBLE) THEN 1 - free_ok ELSE 0 END)::DOUBLE / sum(1 - free_ok) AS error_share FROM
(SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY free_conf, item_id) AS k, count(*) OVER (PARTITION BY repeat) AS n FROM {R}) GROUP BY repeat""")
def error_share(spark, d):
    return g.low_confidence_share(repeats(spark, d), ["repeat"], "free_conf", "free_ok", "item_id", 0.2)


@plans.add("q166_escalation_dial", f"""SELECT repeat, share, avg(CASE WHEN k > round(n * share) THEN free_ok::DOUBLE END) AS accuracy FROM
(SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY free_conf, item_id) AS k, count(*) OVER (PARTITION BY repeat) AS n FROM {R}), (SELECT unnest([0.0::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]) AS share) GROUP BY 1, 2""")
def escalation_dial(spark, d):
    return g.escalation_dial(repeats(spark, d), ["repeat"], "free_conf", "free_ok", "item_id", [0.0, 0.1, 0.25, 0.5])


@plans.add("q167_band_router", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY free_conf, item_id) AS k, count(*) OVER (PARTITION BY repeat) AS n FROM {R}),
s AS (SELECT repeat, k, round(n * 0.2::DOUBLE)::BIGINT AS w, sum(1 - free_ok) OVER (PARTITION BY repeat ORDER BY k) AS s FROM r), z AS (SELECT repeat, k, w, s FROM s UNION ALL SELECT DISTINCT repeat, 0, w, 0 FROM s)
SELECT repeat, first, last, errors FROM (SELECT a.repeat, a.k + 1 AS first, a.k + a.w AS last, (b.s - a.s)::BIGINT AS errors, row_number() OVER (PARTITION BY a.repeat ORDER BY b.s - a.s DESC, a.k) AS q FROM z a JOIN s b ON a.repeat = b.repeat AND b.k = a.k + a.w) WHERE q = 1""")
def band_router(spark, d):
    x = g.band(repeats(spark, d), ["repeat"], "free_conf", "free_ok", "item_id", 0.2)
    return x.select("repeat", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "errors")


@plans.add("q173_pareto", f"""WITH k AS (SELECT gold, CASE WHEN gold = 3 THEN NULL ELSE round(avg(in_tokens::DOUBLE)) END AS cost, avg(free_ok::DOUBLE) AS score FROM {P} GROUP BY gold)
SELECT gold, cost, score FROM (SELECT *, max(score) OVER (ORDER BY cost RANGE UNBOUNDED PRECEDING) AS best FROM k WHERE cost IS NOT NULL) WHERE score >= best""")
def pareto(spark, d):
    k = pair_log(spark, d).groupBy("gold").agg(F.when(F.col("gold") == 3, F.lit(None)).otherwise(F.round(F.avg("in_tokens"))).alias("cost"), F.avg("free_ok").alias("score"))
    return g.pareto(k, [], "cost", "score")


@plans.add("q263_class_router")
def class_router(spark, d):
    """Whole classes handed over, chosen on the other folds."""
    x = g.class_router(pair_log(spark, d), "fold", "gold", "free_pred", "free_ok", "llm_ok", 0.4)
    return g.outcome(x, [], "gold", "free_pred", "llm_pred", "escalate")


POOL = {"free": "free_pred", "b": "pred_b", "c": "pred_c"}


@plans.add("q263_pool_router")
def pool_router(spark, d):
    """Three cheap models settle who speaks by the board of the other folds; then whole classes are handed over."""
    x = g.pool_router(members(spark, d), "fold", "gold", POOL, "llm_ok", 0.4)
    return g.outcome(x, [], "gold", "pred", "llm_pred", "escalate")


@plans.add("q268_margin_signal", f"SELECT item_id, list_reverse_sort(proba)[1] - list_reverse_sort(proba)[2] AS margin FROM {Q}")
def margin_signal(spark, d):
    return proba(spark, d).select("item_id", g.margin_signal(F.col("proba")).alias("margin"))


@plans.add("q262_arbitrate", f"""WITH l AS (SELECT item_id, 0 AS turn, 'free' AS model, free_pred AS cls, free_ok::DOUBLE AS ok FROM {P} UNION ALL SELECT item_id, 1, 'llm', llm_pred, llm_ok::DOUBLE FROM {P}), k AS (SELECT model, cls, sum(ok) AS h, count(*) AS n FROM l GROUP BY 1, 2),
b AS (SELECT model, cls, (h + 20.0::DOUBLE * (sum(h) OVER (PARTITION BY model) / sum(n) OVER (PARTITION BY model))) / (n + 20) AS score FROM k), e AS (SELECT model, cls, score - avg(score) OVER (PARTITION BY cls) AS edge FROM b)
SELECT item_id, model, cls AS pred FROM (SELECT l.*, row_number() OVER (PARTITION BY item_id ORDER BY round(e.edge, 12) DESC, turn) AS k FROM l JOIN e USING (model, cls)) WHERE k = 1""")
def arbitrate(spark, d):
    x = pair_log(spark, d)
    models = {"free": ("free_pred", "free_ok"), "llm": ("llm_pred", "llm_ok")}
    return g.arbitrate(x, ["item_id"], m.competence(x, [], models), {k: v[0] for k, v in models.items()})


def _sets_sql(alpha: float) -> str:
    return f"""WITH x AS {Q}, o AS (SELECT f.fold AS own, 1 - proba[gold + 1] AS s FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold),
r AS (SELECT own, s, row_number() OVER (PARTITION BY own ORDER BY s) AS k, count(*) OVER (PARTITION BY own) AS n FROM o), t AS (SELECT own AS fold, coalesce(max(CASE WHEN k = ceil((n + 1) * {1 - alpha:.6f}::DECIMAL(12, 6)) THEN s END), 'inf'::DOUBLE) AS t FROM r GROUP BY own),
s AS (SELECT x.*, list_filter(range({CLASSES}), lambda i: 1 - proba[i + 1] <= t + 1e-12::DOUBLE) AS q FROM x JOIN t USING (fold)), y AS (SELECT * EXCLUDE (q), CASE WHEN len(q) > 0 THEN q ELSE [list_position(proba, list_max(proba)) - 1] END AS pset FROM s)"""


@plans.add("q245_prediction_sets", _sets_sql(0.1) + " SELECT item_id, len(pset)::INT AS set_size, list_contains(pset, gold::BIGINT) AS covered FROM y")
def prediction_sets(spark, d):
    x = c.fold_sets(proba(spark, d), "fold", "proba", "gold", 0.1, CLASSES)
    return x.select("item_id", F.size("pset").alias("set_size"), F.array_contains("pset", F.col("gold")).alias("covered"))


@plans.add("q246_set_evaluation", _sets_sql(0.2) + " SELECT fold, avg(list_contains(pset, gold::BIGINT)::INT::DOUBLE) AS coverage, avg(len(pset)::DOUBLE) AS set_size, avg((len(pset) = 1)::INT::DOUBLE) AS kept, avg(CASE WHEN len(pset) = 1 THEN list_contains(pset, gold::BIGINT)::INT::DOUBLE END) AS kept_accuracy, avg((len(pset) = 0)::INT::DOUBLE) AS empty FROM y GROUP BY fold")
def set_evaluation(spark, d):
    return c.evaluate_sets(c.fold_sets(proba(spark, d), "fold", "proba", "gold", 0.2, CLASSES), ["fold"], "gold")


@plans.add("q248_mondrian_coverage", f"""WITH x AS {Q}, o AS (SELECT f.fold AS own, gold, 1 - proba[gold + 1] AS s FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold),
p AS (SELECT own, coalesce(max(CASE WHEN k = ceil((n + 1) * 0.9::DECIMAL(12, 6)) THEN s END), 'inf'::DOUBLE) AS t FROM (SELECT own, s, row_number() OVER (PARTITION BY own ORDER BY s) AS k, count(*) OVER (PARTITION BY own) AS n FROM o) GROUP BY 1),
m AS (SELECT own, gold AS c, coalesce(max(CASE WHEN k = ceil((n + 1) * 0.9::DECIMAL(12, 6)) THEN s END), 'inf'::DOUBLE) AS t FROM (SELECT own, gold, s, row_number() OVER (PARTITION BY own, gold ORDER BY s) AS k, count(*) OVER (PARTITION BY own, gold) AS n FROM o) GROUP BY 1, 2 HAVING max(n) >= 5),
a AS (SELECT p.own, c.c, coalesce(m.t, p.t) AS t FROM p CROSS JOIN (SELECT unnest(range({CLASSES})) AS c) c LEFT JOIN m ON m.own = p.own AND m.c = c.c),
s AS (SELECT x.item_id, x.gold, count(CASE WHEN 1 - x.proba[a.c + 1] <= a.t + 1e-12::DOUBLE THEN 1 END) AS n, bool_or(a.c = x.gold AND 1 - x.proba[a.c + 1] <= a.t + 1e-12::DOUBLE) AS hit FROM x JOIN a ON a.own = x.fold GROUP BY 1, 2)
SELECT gold, avg(hit::INT::DOUBLE) AS coverage, avg(n::DOUBLE) AS set_size, avg((n = 1)::INT::DOUBLE) AS kept, avg(CASE WHEN n = 1 THEN hit::INT::DOUBLE END) AS kept_accuracy, avg((n = 0)::INT::DOUBLE) AS empty FROM s GROUP BY gold""")
def mondrian_coverage(spark, d):
    return c.evaluate_sets(c.fold_sets(proba(spark, d), "fold", "proba", "gold", 0.1, CLASSES, mondrian=True), ["gold"], "gold")


@plans.add("q251_clamped_quantile", f"""SELECT fold, max(CASE WHEN k = least(ceil((n + 1) * 0.99::DECIMAL(12, 6)), n) THEN s END) AS threshold, max(n) AS n FROM (SELECT fold, 1 - proba[gold + 1] AS s, row_number() OVER (PARTITION BY fold ORDER BY 1 - proba[gold + 1]) AS k, count(*) OVER (PARTITION BY fold) AS n FROM {Q}) GROUP BY fold""")
def clamped_quantile(spark, d):
    return c.thresholds(proba(spark, d).withColumn("s", c.nonconformity("proba", "gold")), ["fold"], "s", 0.01, "max")


@plans.add("q197_stratified_fold", f"SELECT lang, fold, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT *, ((row_number() OVER (PARTITION BY lang ORDER BY {u_sql(7, 'doc_id')}, doc_id) - 1) % 5)::INT AS fold FROM ({DOC_CLASSES_SQL})) GROUP BY 1, 2")
def stratified_fold(spark, d):
    return f.stratified_fold(doc_classes(spark, d), "lang", "doc_id", 5, 7).groupBy("lang", "fold").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_GF = f"""t AS ({DOC_CLASSES_SQL}), y AS (SELECT grp, gold AS y FROM (SELECT grp, gold, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, gold) AS k FROM t GROUP BY grp, gold) WHERE k = 1),
z AS (SELECT grp, ((row_number() OVER (PARTITION BY y ORDER BY {u_sql(7, 'grp')}, grp) - 1) % 5)::INT AS fold FROM y)"""


@plans.add("q200_grouped_fold", f"WITH {_GF} SELECT gold, fold, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM t JOIN z USING (grp) GROUP BY 1, 2")
def grouped_fold(spark, d):
    return f.grouped_fold(doc_classes(spark, d), "grp", "gold", 5, 7).groupBy("gold", "fold").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@plans.add("q199_fold_leaks", f"SELECT grp, min(fold) AS lo, max(fold) AS hi FROM (SELECT *, ((row_number() OVER (PARTITION BY lang ORDER BY {u_sql(7, 'doc_id')}, doc_id) - 1) % 5)::INT AS fold FROM ({DOC_CLASSES_SQL})) GROUP BY grp HAVING min(fold) <> max(fold)")
def fold_leaks(spark, d):
    """Texts that plain folds put on both sides."""
    return f.leaks(f.stratified_fold(doc_classes(spark, d), "lang", "doc_id", 5, 7), "grp", "fold")


@plans.add("q179_stratified_take", f"""WITH k AS (SELECT lang, count(*) AS c FROM documents GROUP BY 1), q AS (SELECT lang, least(100, sum(c) OVER ()) * c / sum(c) OVER () AS q, least(100, sum(c) OVER ()) AS n FROM k),
b AS (SELECT lang, floor(q)::BIGINT AS b, row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, lang) AS k, n - sum(floor(q)) OVER () AS left_over FROM q)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {u_sql(5, 'doc_id')}, doc_id) AS r FROM documents) JOIN b USING (lang) WHERE r <= b + (k <= left_over)::INT""")
def stratified_take(spark, d):
    return f.stratified_take(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "lang", "doc_id", 100, 5)


@plans.add("q177_learning_subset", f"SELECT conv_id, turn FROM conversations WHERE {u_sql(3, 'conv_id')} < 0.25::DOUBLE")
def learning_subset(spark, d):
    return f.learning_subset(turns(spark, d), "conv_id", 0.25, 3).select("conv_id", "turn")


@plans.add("q178_group_prefix", f"WITH k AS (SELECT conv_id, count(*) AS c FROM conversations GROUP BY 1), b AS (SELECT conv_id, coalesce(sum(c) OVER (ORDER BY {u_sql(4, 'conv_id')}, conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM k) SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM b WHERE b < 60)")
def group_prefix(spark, d):
    return f.group_prefix(turns(spark, d), "conv_id", 60, 4).select("conv_id", "turn")


@plans.add("q181_stride", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings) WHERE k IN (SELECT i * (SELECT count(*) FROM embeddings) // 37 FROM (SELECT unnest(range(37)) AS i))")
def stride(spark, d):
    return f.stride(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id"), "vec_id", 37)


def _w_sql(seed: int, *ids: str) -> str:
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(7):
        total += p
        cuts.append(f"({u_sql(seed, *ids)} >= {total!r}::DOUBLE)::INT")
        p /= k + 1
    return "(" + " + ".join(cuts) + ")"


@plans.add("q201_bootstrap", f"""WITH r AS (SELECT gold, replicate, sum({_w_sql(17, 'replicate', 'item_id')} * (llm_ok - free_ok)::DOUBLE) / sum({_w_sql(17, 'replicate', 'item_id')}) AS m FROM {P}, (SELECT unnest(range(200)) AS replicate) GROUP BY 1, 2)
SELECT gold, any_value(mean) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg((m <= 0)::INT::DOUBLE) AS p_le_0 FROM r JOIN (SELECT gold, avg((llm_ok - free_ok)::DOUBLE) AS mean FROM {P} GROUP BY 1) USING (gold) GROUP BY gold""")
def bootstrap(spark, d):
    """Paired difference of the models' accuracies by class, 200 replicates."""
    return f.bootstrap_mean(pair_log(spark, d).withColumn("delta", F.col("llm_ok") - F.col("free_ok")), ["gold"], "item_id", "delta", 200, 17, 0.95)


@plans.add("q207_cluster_bootstrap", f"""WITH k AS (SELECT conv_id, sum((act = 0)::INT)::DOUBLE AS a, count(*)::DOUBLE AS b FROM ({TURNS_SQL}) GROUP BY 1), r AS (SELECT replicate, sum({_w_sql(19, 'replicate', 'conv_id')} * a) / sum({_w_sql(19, 'replicate', 'conv_id')} * b) AS m FROM k, (SELECT unnest(range(200)) AS replicate) GROUP BY 1)
SELECT (SELECT sum(a) / sum(b) FROM k) AS ratio, (SELECT count(*) FROM k) AS clusters, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM r""")
def cluster_bootstrap(spark, d):
    x = turns(spark, d).withColumn("a", (F.col("act") == 0).cast("int")).withColumn("one", F.lit(1))
    return f.cluster_bootstrap(x, "conv_id", "a", "one", 200, 19)


@plans.add("q214_design_sample", f"""WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {u_sql(23, 'doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents), t AS (SELECT * FROM k ORDER BY k, lang, doc_id LIMIT 50)
SELECT doc_id, lang, n / count(*) OVER (PARTITION BY lang) AS weight FROM t""")
def design_sample(spark, d):
    return f.design_sample(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "lang", "doc_id", 50, 23)


@plans.add("q272_elimination", f"""WITH l AS (SELECT item_id, 'free' AS model, free_ok AS ok FROM {P} UNION ALL SELECT item_id, 'llm', llm_ok FROM {P} UNION ALL SELECT item_id, 'both', free_ok * llm_ok FROM {P}), a AS (SELECT model, avg(ok::DOUBLE) AS a FROM l GROUP BY 1), b AS (SELECT model FROM a ORDER BY a DESC, model LIMIT 1),
r AS (SELECT l.model, replicate, sum({_w_sql(29, 'replicate', 'l.item_id')} * (l.ok - q.ok)::DOUBLE) / sum({_w_sql(29, 'replicate', 'l.item_id')}) AS m FROM l JOIN l q ON q.item_id = l.item_id AND q.model = (SELECT model FROM b), (SELECT unnest(range(100)) AS replicate) GROUP BY 1, 2)
SELECT model, quantile_cont(m, 0.975) < 0 AS dropped FROM r GROUP BY model""")
def elimination(spark, d):
    """Drops models whose whole interval is below the leader."""
    x = pair_log(spark, d)
    long = x.select("item_id", F.explode(F.create_map(F.lit("free"), F.col("free_ok"), F.lit("llm"), F.col("llm_ok"), F.lit("both"), F.col("free_ok") * F.col("llm_ok"))).alias("model", "ok"))
    mean = long.groupBy("model").agg(F.avg("ok").alias("a"))
    leader = mean.orderBy(F.desc("a"), "model").limit(1).select("model")
    best = long.join(F.broadcast(leader), "model", "left_semi").select("item_id", F.col("ok").alias("best"))  # one model
    delta = long.join(best, "item_id").withColumn("delta", F.col("ok") - F.col("best"))
    return f.bootstrap_mean(delta, ["model"], "item_id", "delta", 100, 29).select("model", (F.col("high") < 0).alias("dropped"))


@plans.add("q166_gate_verdict", f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY free_conf, item_id) AS k, count(*) OVER () AS n FROM {P})
SELECT sum(CASE WHEN k <= round(n * 0.2::DOUBLE) THEN 1 - free_ok ELSE 0 END)::DOUBLE / sum(1 - free_ok) > 0.35::DOUBLE AS open FROM r""")
def gate_verdict(spark, d):
    return g.low_confidence_share(pair_log(spark, d), [], "free_conf", "free_ok", "item_id", 0.2).select((F.col("error_share") > 0.35).alias("open"))


@plans.add("q258_committee", f"""SELECT n_dis, count(*) AS n, avg((vote = gold)::INT::DOUBLE) AS accuracy FROM (SELECT item_id, gold, list_unique(list(p)) - 1 AS n_dis, arg_min(p, -c * 100 + p) AS vote FROM
  (SELECT item_id, gold, p, count(*) OVER (PARTITION BY item_id, p) AS c FROM (SELECT item_id, gold, free_pred AS p FROM {R} UNION ALL SELECT item_id, gold, llm_pred FROM {P})) GROUP BY 1, 2) GROUP BY 1""")
def committee(spark, d):
    """Members' disagreement and the accuracy of their majority vote (ties: lowest class)."""
    votes = repeats(spark, d).select("item_id", "gold", F.col("free_pred").alias("p")).unionByName(pair_log(spark, d).select("item_id", "gold", F.col("llm_pred").alias("p")))
    cells = votes.groupBy("item_id", "gold", "p").agg(F.count("*").alias("c"))
    out = cells.groupBy("item_id", "gold").agg((F.count("*") - 1).alias("n_dis"), F.max_by("p", F.struct("c", -F.col("p"))).alias("vote"))
    return out.groupBy("n_dis").agg(F.count("*").alias("n"), F.avg((F.col("vote") == F.col("gold")).cast("double")).alias("accuracy"))


@plans.add("q159_budget_split", f"SELECT free_pred, avg(e) AS escalated_rate, sum(e) / sum(sum(e)) OVER () AS spend_share FROM (SELECT free_pred, (free_conf < 0.5::DOUBLE)::INT::DOUBLE AS e FROM {P}) GROUP BY free_pred")
def budget_split(spark, d):
    x = pair_log(spark, d).withColumn("e", (F.col("free_conf") < 0.5).cast("double")).groupBy("free_pred").agg(F.avg("e").alias("escalated_rate"), F.sum("e").alias("s"))
    return x.select("free_pred", "escalated_rate", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("spend_share"))  # one row a class
