"""Queries on budgets: allocation rules, deferral curves, nested operating points, headroom, selection among models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatewright.functions import stats
from gatewright.operators import allocate as al
from gatewright.operators import conformal as c
from gatewright.operators import defer as g
from gatewright.operators import metrics as m
from gatewright.operators import stacking as st
from gatewright.operators import vectors as v
from gatewright.plans.base import Plans
from gatewright.plans.decide import _w_sql
from gatewright.operators.folds import replicate_weights
from gatewright.sources.scratch import cut
from gatewright.sources.fixtures import CLASSES, PAIR_LOG_SQL, PROBA_SQL, REPEATS_SQL, members, pair_log, proba, repeats, table, u, u_sql

plans = Plans()
P, Q, R = f"({PAIR_LOG_SQL})", f"({PROBA_SQL})", f"({REPEATS_SQL})"
SHARES = [0.1, 0.2, 0.4, 0.6]
#: Budgets of the search, both pure ends with them; for `precision_floor` they are margins of precision.
GRID = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0]
COLUMNS = {"gold": "gold", "pred": "free_pred", "llm_pred": "llm_pred", "conf": "free_conf", "free_ok": "free_ok", "llm_ok": "llm_ok", "item": "item_id", "shares": GRID, "scores": ("margin", "committee")}


def items(spark, d):
    """pair_log with `margin`, the inner fold, the model's probabilities and the committee's signal: how many of the
    repeats agree with the cheap model, then its confidence."""
    x = proba(spark, d)
    votes = repeats(spark, d).select("item_id", F.col("free_pred").alias("vote")).join(x.select("item_id", F.col("free_pred").alias("own")), "item_id").groupBy("item_id").agg(F.sum((F.col("vote") == F.col("own")).cast("int")).alias("agree"))
    x = x.join(votes, "item_id").withColumn("committee", F.col("agree") + F.col("free_conf")).drop("agree")
    return x.withColumn("margin", g.margin_signal(F.col("proba"))).withColumn("inner_fold", F.floor(u(107, "item_id") * 3).cast("int"))


_V = f"(SELECT item_id, sum((v.free_pred = p.free_pred)::INT) AS agree FROM {R} v JOIN (SELECT item_id, free_pred FROM {P}) p USING (item_id) GROUP BY item_id)"
X = f"(SELECT * EXCLUDE (agree), agree + free_conf AS committee, list_reverse_sort(proba)[1] - list_reverse_sort(proba)[2] AS margin, floor({u_sql(107, 'item_id')} * 3)::INT AS inner_fold FROM {Q} JOIN {_V} USING (item_id))"


def _grid(shares: list[float]) -> str:
    return "(SELECT unnest([" + ", ".join(f"{s!r}::DOUBLE" for s in shares) + "]) AS share)"


def _score_sql(src: str, by: str, fold: str, score: str, own: bool = False, shares: list[float] = SHARES) -> str:
    """The items of src once per share with `escalate`; by: `` or `o` (a column that all statistics are kept apart by)."""
    k, same = (f"{by}, ", f"AND f.{by} = y.{by}") if by else ("", "")
    using = f"{k}{fold}"
    return f"""SELECT x.*, t.share, x.{score} <= t.t AS escalate FROM {src} x JOIN (SELECT {using}, unnest({shares}::DOUBLE[]) AS share, unnest(q) AS t FROM (SELECT {"f." + by + ", " if by else ""}f.{fold}, quantile_cont(y.{score}, {shares}) AS q
      FROM (SELECT DISTINCT {using} FROM {src}) f JOIN {src} y ON y.{fold} {"=" if own else "<>"} f.{fold} {same} GROUP BY ALL)) t USING ({using})"""


def _class_sql(src: str, by: str, fold: str, shares: list[float] = SHARES) -> str:
    k, _S = f"{by}, " if by else "", _grid(shares)
    return f"""SELECT x.* EXCLUDE (rk), coalesce(x.rk <= t.take, false) AS escalate FROM (SELECT y.*, share, row_number() OVER (PARTITION BY {k}{fold}, free_pred, share ORDER BY free_conf, item_id) AS rk FROM {src} y, {_S}) x
      LEFT JOIN (SELECT {k}{fold}, free_pred, share, greatest(least(n, floor(share * total - bef)), 0) AS take FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY {k}{fold}, share ORDER BY a DESC, free_pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM
        (SELECT {k}{fold}, free_pred, n, CASE WHEN sum(n) OVER w > n THEN ((sum(l) OVER w - l) - (sum(f) OVER w - f))::DOUBLE / (sum(n) OVER w - n) END AS a, sum(n) OVER (PARTITION BY {k}{fold}) AS total FROM (SELECT {k}{fold}, free_pred, count(*) AS n, sum(free_ok) AS f, sum(llm_ok) AS l FROM {src} GROUP BY ALL) WINDOW w AS (PARTITION BY {k}free_pred)), {_S} WHERE a > 0)) t USING ({k}{fold}, free_pred, share)"""


def _confidence_sql(src: str, by: str, fold: str, prior: float = 20.0, shares: list[float] = SHARES) -> str:
    """by_class_confidence, with the isotonic fit as the greatest of least run means."""
    k, f = (f"{by}, ", f"f.{by}, ") if by else ("", "")
    same, _S = f"AND f.{by} = y.{by}" if by else "", _grid(shares)
    b = f"least(floor(free_conf * {al.BINS}), {al.BINS - 1})::INT"

    def iso(cells: str, keys: str) -> str:
        return f"""SELECT {keys}, b, max(m) AS rel FROM (SELECT {keys}, b, a, min((s1 - s0) / (n1 - n0)) AS m FROM (SELECT {keys}, b FROM {cells}) JOIN (SELECT {keys}, b AS a, sum(n) OVER w - n AS n0, sum(f) OVER w - f AS s0 FROM {cells} WINDOW w AS (PARTITION BY {keys} ORDER BY b)) USING ({keys})
          JOIN (SELECT {keys}, b AS z, sum(n) OVER w AS n1, sum(f) OVER w AS s1 FROM {cells} WINDOW w AS (PARTITION BY {keys} ORDER BY b)) USING ({keys}) WHERE a <= b AND z >= b GROUP BY ALL) GROUP BY ALL"""

    q = f"{k}{fold}"
    return f"""(WITH xx AS (SELECT * FROM {src}), ff AS (SELECT DISTINCT {q} FROM xx),
      oth AS (SELECT {f}f.{fold}, y.free_pred AS p, {b.replace("free_conf", "y.free_conf")} AS b, count(*)::DOUBLE AS n, sum(y.free_ok)::DOUBLE AS f FROM ff f JOIN xx y ON y.{fold} <> f.{fold} {same} GROUP BY ALL),
      pool AS (SELECT {q}, b, sum(n) AS n, sum(f) AS f FROM oth GROUP BY ALL), iso_all AS ({iso("pool", q)}), iso_own AS ({iso("oth", q + ", p")}),
      rel AS (SELECT {q}, p, b, n, (o.rel * size + a.rel * {prior}) / (size + {prior}) AS rel FROM (SELECT *, sum(n) OVER (PARTITION BY {q}, p) AS size FROM oth) JOIN iso_own o USING ({q}, p, b) JOIN iso_all a USING ({q}, b)),
      og AS (SELECT {f}f.{fold}, y.free_pred AS p, y.gold AS g, count(*)::DOUBLE AS n, sum(y.llm_ok)::DOUBLE AS l FROM ff f JOIN xx y ON y.{fold} <> f.{fold} {same} GROUP BY ALL),
      sup AS (SELECT {q}, g, 1 / (count(*) OVER (PARTITION BY {q}) * t) AS w FROM (SELECT {q}, g, sum(n) AS t FROM og GROUP BY ALL)),
      tot AS (SELECT {q}, sum(n) AS nn, sum(l) AS ll FROM og GROUP BY ALL),
      cls AS (SELECT {q}, p, sum(n * w) / sum(n) AS w, (sum(l) + {prior} * any_value(ll) / any_value(nn)) / (sum(n) + {prior}) AS rt, any_value(nn) AS nn FROM og JOIN sup USING ({q}, g) JOIN tot USING ({q}) GROUP BY {q}, p),
      val AS (SELECT {q}, p, b, n, nn, round((rt - rel) * w, 15) AS v FROM rel JOIN cls USING ({q}, p)),
      buy AS (SELECT {q}, p AS free_pred, b, share FROM (SELECT *, sum(n) OVER (PARTITION BY {q}, share ORDER BY v DESC, p, b ROWS UNBOUNDED PRECEDING) AS upto FROM val, {_S} WHERE v > 0) WHERE upto <= share * nn)
      SELECT x.* EXCLUDE (b), buy.b IS NOT NULL AS escalate FROM (SELECT y.*, share, {b.replace("free_conf", "y.free_conf")} AS b FROM xx y, {_S}) x LEFT JOIN buy USING ({q}, free_pred, b, share))"""


def _floor_sql(src: str, by: str, fold: str, shares: list[float], least: int = 30) -> str:
    """precision_margin."""
    return f"""(WITH xx AS (SELECT * FROM {src}), ff AS (SELECT DISTINCT {by}, {fold} FROM xx), oo AS (SELECT f.{fold} AS own, y.* FROM ff f JOIN xx y ON y.{by} = f.{by} AND y.{fold} <> f.{fold}),
      rr AS (SELECT DISTINCT {by}, own, free_pred, free_conf, avg(free_ok::DOUBLE) OVER w AS pr, count(*) OVER w AS n FROM oo WINDOW w AS (PARTITION BY {by}, own, free_pred ORDER BY free_conf DESC RANGE UNBOUNDED PRECEDING)),
      aa AS (SELECT {by}, own, llm_pred AS free_pred, avg(llm_ok::DOUBLE) AS a FROM oo GROUP BY ALL), pp AS (SELECT {by}, own, avg(llm_ok::DOUBLE) AS al FROM oo GROUP BY ALL),
      tt AS (SELECT {by}, own AS {fold}, free_pred, share, min(free_conf) AS t FROM rr JOIN pp USING ({by}, own) LEFT JOIN aa USING ({by}, own, free_pred), {_grid(shares)} WHERE pr >= (1 - share) * coalesce(a, al) AND n >= {least} GROUP BY ALL)
      SELECT x.*, coalesce(free_conf < t, true) AS escalate FROM (SELECT * FROM xx, {_grid(shares)}) x LEFT JOIN tt USING ({by}, {fold}, free_pred, share))"""


def _cells_sql() -> str:
    """The table of search(), from x."""
    src, by, fold = "st", "outer_fold", "part"
    ends = "CASE WHEN share <= 0 THEN false WHEN share >= 1 THEN true ELSE escalate END"
    parts = {"confidence": _score_sql(src, by, fold, "free_conf", shares=GRID), "margin": _score_sql(src, by, fold, "margin", shares=GRID), "committee": _score_sql(src, by, fold, "committee", shares=GRID), "class_aware": _class_sql(src, by, fold, GRID), "per_class_conf": _confidence_sql(src, by, fold, shares=GRID), "precision_floor": _floor_sql(src, by, fold, GRID)}
    every = " UNION ALL ".join(f"SELECT '{n}' AS rule, outer_fold, part, gold, free_ok, llm_ok, share, {'escalate' if n == 'precision_floor' else ends} AS escalate FROM ({p})" for n, p in parts.items())
    return f"""x AS MATERIALIZED {X}, st AS MATERIALIZED (SELECT x.*, -1 AS outer_fold, fold AS part FROM x UNION ALL SELECT x.*, f.outer_fold, x.inner_fold AS part FROM (SELECT DISTINCT fold AS outer_fold FROM x) f JOIN x ON x.fold <> f.outer_fold),
cells AS MATERIALIZED (SELECT rule, outer_fold, part, share, gold, count(*) AS n, sum(CASE WHEN escalate THEN llm_ok ELSE free_ok END) AS r, sum(escalate::INT) AS e FROM ({every}) GROUP BY ALL)"""


def _curve_sql(keys: str, src: str) -> str:
    return f"""SELECT {keys}, avg(r / n) AS balanced_accuracy, sum(r) / sum(n) AS accuracy, sum(e) / sum(n) AS llm_share FROM (SELECT {keys}, gold, sum(n)::DOUBLE AS n, sum(r)::DOUBLE AS r, sum(e)::DOUBLE AS e FROM {src} GROUP BY ALL) GROUP BY ALL"""


def _outcomes_sql(keys: str, src: str) -> str:
    return f"""SELECT {keys}, avg(r) AS balanced_accuracy, sum(s) / sum(n) AS accuracy, sum(e) / sum(n) AS llm_share FROM (SELECT {keys}, gold, avg(CASE WHEN escalate THEN llm_ok ELSE free_ok END::DOUBLE) AS r, sum(CASE WHEN escalate THEN llm_ok ELSE free_ok END)::DOUBLE AS s, count(*) AS n, sum(escalate::INT) AS e FROM {src} GROUP BY ALL) GROUP BY ALL"""


@plans.add("q264_score_rules", f"WITH x AS {X}, a AS (SELECT 'confidence' AS rule, share, gold, free_ok, llm_ok, escalate FROM ({_score_sql('x', '', 'fold', 'free_conf')}) UNION ALL SELECT 'margin', share, gold, free_ok, llm_ok, escalate FROM ({_score_sql('x', '', 'fold', 'margin')})) {_outcomes_sql('rule, share', 'a')}")
def score_rules(spark, d):
    """Confidence and margin: the lowest share by a threshold of the other folds."""
    x = items(spark, d)
    both = al.by_score(x, [], "fold", "free_conf", SHARES).withColumn("rule", F.lit("confidence")).unionByName(al.by_score(x, [], "fold", "margin", SHARES).withColumn("rule", F.lit("margin")))
    return al.outcomes(both, ["rule", "share"], "gold", "free_ok", "llm_ok")


@plans.add("q264_class_aware", f"WITH x AS {X}, a AS ({_class_sql('x', '', 'fold')}) {_outcomes_sql('share', 'a')}")
def class_aware(spark, d):
    """Classes by the expensive model's advantage until the fold's budget is spent."""
    return al.outcomes(al.by_class(items(spark, d), [], "fold", "free_pred", "free_conf", "free_ok", "llm_ok", "item_id", SHARES), ["share"], "gold", "free_ok", "llm_ok")


_SETS = f"""x AS {X}, o AS (SELECT f.fold AS own, gold, 1 - proba[gold + 1] AS s FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold),
p AS (SELECT own, coalesce(max(CASE WHEN k = ceil((n + 1) * 0.9::DECIMAL(12, 6)) THEN s END), 'inf'::DOUBLE) AS t FROM (SELECT own, s, row_number() OVER (PARTITION BY own ORDER BY s) AS k, count(*) OVER (PARTITION BY own) AS n FROM o) GROUP BY 1),
m AS (SELECT own, gold AS c, coalesce(max(CASE WHEN k = ceil((n + 1) * 0.9::DECIMAL(12, 6)) THEN s END), 'inf'::DOUBLE) AS t FROM (SELECT own, gold, s, row_number() OVER (PARTITION BY own, gold ORDER BY s) AS k, count(*) OVER (PARTITION BY own, gold) AS n FROM o) GROUP BY 1, 2 HAVING max(n) >= 5),
a AS (SELECT p.own, c.c, coalesce(m.t, p.t) AS t FROM p CROSS JOIN (SELECT unnest(range({CLASSES})) AS c) c LEFT JOIN m ON m.own = p.own AND m.c = c.c),
z AS (SELECT x.item_id, x.fold, x.gold, x.free_ok, x.llm_ok, {CLASSES} - count(CASE WHEN 1 - x.proba[a.c + 1] <= a.t + 1e-12::DOUBLE THEN 1 END) + any_value(x.free_conf) AS score FROM x JOIN a ON a.own = x.fold GROUP BY 1, 2, 3, 4, 5)"""


@plans.add("q264_conformal", f"WITH {_SETS}, e AS ({_score_sql('z', '', 'fold', 'score', own=True)}) {_outcomes_sql('share', 'e')}")
def conformal_rule(spark, d):
    """Larger prediction sets first, less confident items first within a size; the share is of the fold's own items."""
    x = c.fold_sets(items(spark, d), "fold", "proba", "gold", 0.1, CLASSES, mondrian=True).withColumn("score", CLASSES - F.size("pset") + F.col("free_conf"))
    return al.outcomes(al.by_score(x, [], "fold", "score", SHARES, own=True), ["share"], "gold", "free_ok", "llm_ok")


@plans.add("q264_committee", f"WITH x AS (SELECT p.*, v.agree FROM {P} p JOIN (SELECT item_id, sum((free_pred = llm_pred)::INT)::DOUBLE AS agree FROM {R} GROUP BY 1) v USING (item_id)), e AS ({_score_sql('x', '', 'fold', 'agree')}) {_outcomes_sql('share', 'e')}")
def committee_rule(spark, d):
    """Items on which fewest repeats agree with the expensive model's class go first; ties go together."""
    votes = repeats(spark, d).groupBy("item_id").agg(F.sum((F.col("free_pred") == F.col("llm_pred")).cast("int")).cast("double").alias("agree"))
    return al.outcomes(al.by_score(pair_log(spark, d).join(votes, "item_id"), [], "fold", "agree", SHARES), ["share"], "gold", "free_ok", "llm_ok")


@plans.add("q265_per_class_conf", f"WITH x AS {X}, a AS {_confidence_sql('x', '', 'fold')} {_outcomes_sql('share', 'a')}")
def per_class_conf(spark, d):
    """Bins of class and confidence by their modelled value per call."""
    return al.outcomes(al.by_class_confidence(items(spark, d), [], "fold", "gold", "free_pred", "free_conf", "free_ok", "llm_ok", SHARES), ["share"], "gold", "free_ok", "llm_ok")


@plans.add("q266_class_reliability", f"WITH x AS {X}, a AS {_confidence_sql('x', '', 'fold').replace('SELECT x.* EXCLUDE (b), buy.b IS NOT NULL AS escalate FROM (SELECT y.*, share, least(floor(y.free_conf * 20), 19)::INT AS b FROM xx y, ' + _grid(SHARES) + ') x LEFT JOIN buy USING (fold, free_pred, b, share))', 'SELECT * FROM rel)')} SELECT fold, p, b, n::BIGINT AS n, rel FROM a")
def class_reliability(spark, d):
    """Isotonic reliability by class, shrunk to the one of all classes, from the other folds."""
    return al.reliability(items(spark, d), [], "fold", "free_pred", "free_conf", "free_ok").select("fold", "p", "b", F.col("n").cast("long").alias("n"), "rel")


def search(spark, d):
    return al.search(items(spark, d), "fold", "inner_fold", **COLUMNS)


@plans.add("q269_deferral_curve", f"WITH {_cells_sql()} {_curve_sql('rule, share', '(SELECT * FROM cells WHERE outer_fold = -1)')}")
def deferral_curve(spark, d):
    """The six rules of the search at every budget, both ends with them."""
    return al.curve(search(spark, d).where("outer = -1"), ["rule", "share"], "gold")


@plans.add("q269_gain_per_spend", f"""WITH {_cells_sql()}, c AS ({_curve_sql('rule, share', "(SELECT * FROM cells WHERE outer_fold = -1 AND rule = 'confidence')")})
SELECT share, balanced_accuracy, llm_share, CASE WHEN llm_share - lag(llm_share) OVER w > 1e-9 THEN (balanced_accuracy - lag(balanced_accuracy) OVER w) / (llm_share - lag(llm_share) OVER w) * 0.1::DOUBLE END AS gain_per_tenth FROM c WINDOW w AS (ORDER BY share)""")
def gain_per_spend(spark, d):
    """What the next tenth of the traffic brings along the curve of confidence."""
    return al.gains(al.curve(search(spark, d).where("outer = -1"), ["rule", "share"], "gold"))


_NESTED = f"""{_cells_sql()}, sc AS ({_curve_sql('outer_fold, rule, share', '(SELECT * FROM cells WHERE outer_fold >= 0)')}),
best AS (SELECT outer_fold AS part, rule, share, inner_score FROM (SELECT outer_fold, rule, share, round(balanced_accuracy, 12) AS inner_score, row_number() OVER (PARTITION BY outer_fold ORDER BY round(balanced_accuracy, 12) DESC, rule, share) AS k FROM sc) WHERE k = 1)"""


@plans.add("q270_nested_point", f"WITH {_NESTED}, held AS (SELECT cells.* FROM cells JOIN best USING (part, rule, share) WHERE outer_fold = -1) SELECT balanced_accuracy, accuracy, llm_share FROM ({_curve_sql('1 AS one', 'held')})")
def nested_point(spark, d):
    """The operating point chosen by an inner cross-validation, scored on the outer folds."""
    return al.nested_point(search(spark, d), "gold")


@plans.add("q270_nested_picks", f"WITH {_NESTED} SELECT part AS fold, rule, share, inner_score FROM best")
def nested_picks(spark, d):
    return al.picks(search(spark, d), "gold").withColumnRenamed("part", "fold")


def fitted_search(spark, d, fits=None):
    """search() with the router's and the conformal sets' scores as two more rules, each fitted once for every part."""
    rows = al.staged(items(spark, d), "fold", "inner_fold")
    rows = al.conformal_scores(rows, ["outer"], "part", "proba", "gold", "free_conf", CLASSES)
    rows = al.router_scores(rows, ["outer"], "part", "free_pred", "free_conf", "margin", "free_ok", "llm_ok", fits)
    return al.search(cut(rows, "fitted"), "fold", "inner_fold", **COLUMNS, own_scores=("conformal", "router"))


@plans.add("q270_fitted_search")
def fitted_point(spark, d):
    """The nested point of all eight rules and, beside it, each fold's pick."""
    cells = cut(fitted_search(spark, d), "cells")
    return al.picks(cells, "gold").withColumnRenamed("part", "fold").crossJoin(F.broadcast(al.nested_point(cells, "gold")))  # one row


@plans.add("q186_cheapest_equivalent", f"""WITH {_cells_sql()}, o AS ({_curve_sql('rule, share', '(SELECT * FROM cells WHERE outer_fold = -1)')}), n AS (SELECT sqrt(0.25 / count(*))::DOUBLE * 1.959963984540054::DOUBLE AS floor FROM x)
SELECT rule, share, balanced_accuracy, llm_share FROM (SELECT *, row_number() OVER (ORDER BY round(llm_share, 12), round(balanced_accuracy, 12) DESC, rule, share) AS k FROM o, n WHERE balanced_accuracy >= (SELECT max(balanced_accuracy) FROM o) - floor) WHERE k = 1""")
def cheapest_equivalent(spark, d):
    """Of the points within the noise of the best one that with the smallest share (then the better, then by rule)."""
    cells = search(spark, d)
    o = al.curve(cells.where("outer = -1"), ["rule", "share"], "gold")
    noise = cells.where("outer = -1 AND rule = 'confidence' AND share = 0").agg((F.sqrt(0.25 / F.sum("n")) * stats.Z95).alias("floor"))
    near = o.crossJoin(F.broadcast(o.agg(F.max("balanced_accuracy").alias("top")))).crossJoin(noise).where("balanced_accuracy >= top - floor")  # one row each
    return near.agg(F.min_by(F.struct("rule", "share", "balanced_accuracy", "llm_share"), F.struct(F.round("llm_share", 12), -F.round("balanced_accuracy", 12), "rule", "share")).alias("x")).select("x.*")


_HR = [f"SELECT {r} AS rep, item_id, fold, gold, free_conf, free_ok, llm_ok, " + ("free_pred AS grp" if r == 0 else f"(SELECT min(c) FROM cum WHERE cum.upto > {u_sql(500 + r, 'item_id')}) AS grp") + f" FROM {P}" for r in range(4)]
_HEAD = f"""k AS (SELECT free_pred AS c, count(*)::DOUBLE AS n FROM {P} GROUP BY 1), cum AS (SELECT c, sum(n) OVER (ORDER BY c) / sum(n) OVER () AS upto FROM k), i AS ({" UNION ALL ".join(_HR)}),
s AS (SELECT gold, 1 / (count(*) OVER () * n) AS w FROM (SELECT gold, count(*)::DOUBLE AS n FROM {P} GROUP BY 1)),
cells AS (SELECT rep, fold, grp, least(floor(free_conf * 20), 19)::INT AS b, count(*) AS n, sum((llm_ok - free_ok) * w) AS gain FROM i JOIN s USING (gold) GROUP BY ALL),
per AS (SELECT rep, sum(gain) AS g FROM (SELECT rep, gain, sum(n) OVER (PARTITION BY rep, fold ORDER BY round(gain / n, 15) DESC, grp, b ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY rep, fold) AS total, gain AS g0 FROM cells) WHERE g0 > 0 AND upto <= 0.2::DOUBLE * total GROUP BY rep),
gl AS (SELECT sum(gain) AS g FROM (SELECT gain, sum(n) OVER (PARTITION BY fold ORDER BY b ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY fold) AS total FROM (SELECT fold, b, sum(n) AS n, sum(gain) AS gain FROM cells WHERE rep = 0 GROUP BY ALL)) WHERE upto <= 0.2::DOUBLE * total)"""


@plans.add("q271_headroom", f"""WITH {_HEAD} SELECT coalesce((SELECT g FROM gl), 0.0) AS global_gain, coalesce((SELECT g FROM per WHERE rep = 0), 0.0) AS class_gain, coalesce((SELECT sum(g) / 3 FROM per WHERE rep > 0), 0.0) AS null_gain""")
def headroom(spark, d):
    """What balanced accuracy gains with the answers in hand at a fifth of the calls: one threshold for all, thresholds by
    class, and by classes drawn at random with the same shares (three draws). Items are taken in whole bins of
    confidence; by class the bins come in the order of their gain per item."""
    x = pair_log(spark, d)
    sizes = x.groupBy(F.col("free_pred").alias("c")).agg(F.count("*").cast("double").alias("n"))
    upto = F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())  # one row a class
    cum = sizes.select("c", upto.alias("upto")).agg(F.sort_array(F.collect_list(F.struct("c", "upto"))).alias("cum"))
    weight = x.groupBy("gold").agg(F.count("*").cast("double").alias("n")).withColumn("w", 1 / (F.count("*").over(Window.partitionBy()) * F.col("n"))).drop("n")
    i = x.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(3)))).crossJoin(F.broadcast(cum)).join(F.broadcast(weight), "gold")  # classes rows
    drawn = F.lit(None).cast("int")
    for r in range(1, 4):
        at = u(500 + r, "item_id")
        drawn = F.when(F.col("rep") == r, F.element_at(F.filter("cum", lambda e: e["upto"] > at), 1)["c"]).otherwise(drawn)  # noqa: B023
    cells = i.withColumn("grp", F.when(F.col("rep") == 0, F.col("free_pred")).otherwise(drawn)).groupBy("rep", "fold", "grp", al.bin_of("free_conf").alias("b")).agg(F.count("*").alias("n"), F.sum((F.col("llm_ok") - F.col("free_ok")) * F.col("w")).alias("gain"))
    first = Window.partitionBy("rep", "fold").orderBy(F.desc(F.round(F.col("gain") / F.col("n"), 15)), "grp", "b").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy("rep", "fold"))
    per = cells.withColumn("upto", F.sum("n").over(first)).withColumn("total", total).where((F.col("gain") > 0) & (F.col("upto") <= 0.2 * F.col("total"))).groupBy("rep").agg(F.sum("gain").alias("g"))
    bins = cells.where("rep = 0").groupBy("fold", "b").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    low = Window.partitionBy("fold").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    glob = bins.withColumn("upto", F.sum("n").over(low)).withColumn("total", F.sum("n").over(Window.partitionBy("fold"))).where(F.col("upto") <= 0.2 * F.col("total")).agg(F.coalesce(F.sum("gain"), F.lit(0.0)).alias("global_gain"))
    own = per.agg(F.coalesce(F.sum(F.when(F.col("rep") == 0, F.col("g"))), F.lit(0.0)).alias("class_gain"), F.coalesce(F.sum(F.when(F.col("rep") > 0, F.col("g"))) / 3, F.lit(0.0)).alias("null_gain"))
    return glob.crossJoin(own)  # one row each


_MODELS = {"free": "free_pred", "llm": "llm_pred"}
_LAYER = f"""l AS (SELECT item_id, fold, gold, free_conf, 'free' AS model, free_pred AS p, free_ok AS ok FROM {P} UNION ALL SELECT item_id, fold, gold, free_conf, 'llm', llm_pred, llm_ok FROM {P}),
b AS (SELECT *, least(floor(free_conf * 4), 3)::INT AS b FROM l), k3 AS (SELECT f.fold, model, p, b, count(*) AS n, avg(ok::DOUBLE) AS r FROM (SELECT DISTINCT fold FROM b) f JOIN b y ON y.fold <> f.fold GROUP BY ALL), k2 AS (SELECT f.fold, model, p, avg(ok::DOUBLE) AS r FROM (SELECT DISTINCT fold FROM b) f JOIN b y ON y.fold <> f.fold GROUP BY ALL),
s AS (SELECT item_id, gold, model, x.p, x.ok, CASE WHEN k3.n >= 25 THEN k3.r ELSE coalesce(k2.r, 0.0) END AS r FROM b x LEFT JOIN k3 USING (fold, model, p, b) LEFT JOIN k2 USING (fold, model, p))"""


@plans.add("q273_selection_layer", f"WITH {_LAYER} SELECT model, count(*) AS n, avg(ok::DOUBLE) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(r, 12) DESC, model) AS k FROM s) WHERE k = 1 GROUP BY 1")
def selection_layer(spark, d):
    """Per item the model that is most reliable in its class and bin of confidence on the other folds (with under 25
    items there: in its class)."""
    x = pair_log(spark, d)
    long = x.select("item_id", "fold", F.least(F.floor(F.col("free_conf") * 4), F.lit(3)).cast("int").alias("b"), F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(p).alias("p"), F.col(f"{n}_ok").alias("ok")) for n, p in _MODELS.items()])).alias("x")).select("item_id", "fold", "b", "x.*")
    cube = long.groupBy("fold", "model", "p", "b").agg(F.count("*").alias("n"), F.sum("ok").alias("s"))
    folds = cube.select(F.col("fold").alias("own")).distinct()
    others = cube.join(F.broadcast(folds), F.col("own") != F.col("fold"))  # folds x folds x models x classes x bins rows
    fine = others.groupBy(F.col("own").alias("fold"), "model", "p", "b").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("r3"))
    coarse = others.groupBy(F.col("own").alias("fold"), "model", "p").agg((F.sum("s") / F.sum("n")).alias("r2"))
    scored = long.join(F.broadcast(fine), ["fold", "model", "p", "b"], "left").join(F.broadcast(coarse), ["fold", "model", "p"], "left")
    r = F.round(F.when(F.col("n") >= 25, F.col("r3")).otherwise(F.coalesce("r2", F.lit(0.0))), 12)
    best = scored.groupBy("item_id").agg(F.min_by(F.struct("model", "ok"), F.struct((-r).alias("loss"), "model")).alias("x")).select("x.*")
    return best.groupBy("model").agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"))


MEMBERS = {"b": "proba_b", "free": "proba", "llm": "proba_llm"}


def staged_members(spark, d):
    x = members(spark, d).withColumn("inner_fold", F.floor(u(107, "item_id") * 3).cast("int"))
    return al.staged(x.select("item_id", "fold", "inner_fold", "gold", *MEMBERS.values()), "fold", "inner_fold")


@plans.add("q273_stacking_layer")
def stacking_layer(spark, d):
    """For every fold what to ship, decided on the other folds: the best of three models, selection by reliability, or
    stacking; with what it brings on the fold."""
    return st.layer(staged_members(spark, d), "gold", MEMBERS, CLASSES)


_NEAR = f"""e AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0), pr AS (SELECT q.vec_id AS query, e.vec_id AS nb, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS s FROM q JOIN e ON q.vec_id <> e.vec_id),
nn AS (SELECT query, nb, rk FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, nb) AS rk FROM pr) WHERE rk <= 7), p AS {P},
z AS (SELECT n.query, n.rk, a.gold AS g, a.free_pred AS f, a.llm_pred AS l, b.gold AS ng, b.free_ok AS nf, b.llm_ok AS nl FROM nn n JOIN p a ON a.item_id = n.query JOIN p b ON b.item_id = n.nb)"""


@plans.add("q274_dynamic_selection", f"""WITH {_NEAR}, w AS (SELECT query, any_value(g) AS g, any_value(f) AS f, any_value(l) AS l, avg(nf) AS of, avg(nl) AS ol, coalesce(avg(CASE WHEN ng = f THEN nf END), 0.0) AS lf, coalesce(avg(CASE WHEN ng = l THEN nl END), 0.0) AS ll,
  coalesce(min(CASE WHEN nf = 0 THEN rk END), 8) AS kf, coalesce(min(CASE WHEN nl = 0 THEN rk END), 8) AS kl FROM z GROUP BY 1)
SELECT count(*) AS n, avg((CASE WHEN ol > of THEN l ELSE f END = g)::INT::DOUBLE) AS ola, avg((CASE WHEN ll > lf THEN l ELSE f END = g)::INT::DOUBLE) AS lca, avg((CASE WHEN kl > kf THEN l ELSE f END = g)::INT::DOUBLE) AS knora_e, avg((f = g OR l = g)::INT::DOUBLE) AS ceiling FROM w""")
def dynamic_selection(spark, d):
    """Selection by competence among the seven nearest items (queries: every row whose id is divisible by 100): overall
    accuracy, accuracy on neighbours of the class that a model names, and the longest run of neighbours that a model has
    right (ties: the cheap model); with the ceiling of a perfect choice."""
    e, p = table(spark, d, "embeddings"), pair_log(spark, d)
    near = v.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 7)
    own = p.select(F.col("item_id").alias("query"), F.col("gold").alias("g"), F.col("free_pred").alias("f"), F.col("llm_pred").alias("l"))
    side = p.select(F.col("item_id").alias("neighbour"), F.col("gold").alias("ng"), F.col("free_ok").alias("nf"), F.col("llm_ok").alias("nl"))
    z = near.join(side, "neighbour").join(own, "query")
    at = lambda cls, ok: F.coalesce(F.avg(F.when(F.col("ng") == F.col(cls), F.col(ok))), F.lit(0.0))
    run = lambda ok: F.coalesce(F.min(F.when(F.col(ok) == 0, F.col("rank"))), F.lit(8))
    w = z.groupBy("query", "g", "f", "l").agg(F.avg("nf").alias("of"), F.avg("nl").alias("ol"), at("f", "nf").alias("lf"), at("l", "nl").alias("ll"), run("nf").alias("kf"), run("nl").alias("kl"))
    right = lambda a, b: F.avg((F.when(F.col(b) > F.col(a), F.col("l")).otherwise(F.col("f")) == F.col("g")).cast("double"))
    return w.agg(F.count("*").alias("n"), right("of", "ol").alias("ola"), right("lf", "ll").alias("lca"), right("kf", "kl").alias("knora_e"), F.avg(((F.col("f") == F.col("g")) | (F.col("l") == F.col("g"))).cast("double")).alias("ceiling"))


_SEEDS = 4
_GS = f"""i AS (SELECT s.seed, p.* EXCLUDE (fold), ((row_number() OVER (PARTITION BY s.seed, gold ORDER BY md5(s.seed::VARCHAR || '|' || item_id::VARCHAR), item_id) - 1) % 5)::INT AS fold FROM {P} p, (SELECT unnest(range({_SEEDS}))::INT AS seed) s),
k AS (SELECT seed, fold, free_pred, count(*) AS n, sum(free_ok) AS f, sum(llm_ok) AS l FROM i GROUP BY ALL), o AS (SELECT seed, fold, free_pred, sum(n) OVER w - n AS n, sum(f) OVER w - f AS f, sum(l) OVER w - l AS l FROM k WINDOW w AS (PARTITION BY seed, free_pred)),
e AS (SELECT i.*, coalesce(o.n > 0 AND (o.l - o.f)::DOUBLE / o.n > 0.0, false) AS escalate FROM i JOIN o USING (seed, fold, free_pred))"""


@plans.add("q255_pair_runner", f"""WITH {_GS}, r AS (SELECT seed, avg(a) AS bal, sum(s) / sum(n) AS share FROM (SELECT seed, gold, avg(CASE WHEN escalate THEN llm_ok ELSE free_ok END::DOUBLE) AS a, count(*) AS n, sum(escalate::INT)::DOUBLE AS s FROM e GROUP BY ALL) GROUP BY 1), h AS (SELECT seed, count(*) AS handed FROM (SELECT DISTINCT seed, fold, free_pred FROM e WHERE escalate) GROUP BY 1)
SELECT avg(bal) AS balanced_accuracy, max(bal) - min(bal) AS spread, quantile_cont(bal, 0.5) AS median, avg(share) AS llm_share, avg(handed) AS classes_handed FROM r JOIN h USING (seed)""")
def pair_runner(spark, d):
    """The class gate under several split seeds: mean, median and spread of balanced accuracy, share, classes handed over."""
    x = pair_log(spark, d).drop("fold").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(_SEEDS - 1))))
    order = Window.partitionBy("seed", "gold").orderBy(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("item_id").cast("string"))), "item_id")
    e = g.class_gate(x.withColumn("fold", ((F.row_number().over(order) - 1) % 5).cast("int")), ["seed"], "fold", "free_pred", "free_ok", "llm_ok")
    r = al.outcomes(e, ["seed"], "gold", "free_ok", "llm_ok")
    h = e.where("escalate").select("seed", "fold", "free_pred").distinct().groupBy("seed").agg(F.count("*").alias("handed"))
    return r.join(h, "seed").agg(F.avg("balanced_accuracy").alias("balanced_accuracy"), (F.max("balanced_accuracy") - F.min("balanced_accuracy")).alias("spread"), F.percentile("balanced_accuracy", 0.5).alias("median"), F.avg("llm_share").alias("llm_share"), F.avg("handed").alias("classes_handed"))


@plans.add("q259_threshold_gate", f"""WITH x AS (SELECT *, round(free_conf, 2) AS c FROM {P}), k AS (SELECT f.fold AS own, c, count(*) AS n, sum(free_ok) AS f, sum(llm_ok) AS l FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold GROUP BY ALL),
a AS (SELECT own, c, sum(l - f) OVER (PARTITION BY own ORDER BY c) AS gain FROM k), b AS (SELECT own, c, gain, row_number() OVER (PARTITION BY own ORDER BY gain DESC, c) AS k FROM a)
SELECT x.fold, CASE WHEN any_value(b.gain) > 0 THEN any_value(b.c) END AS threshold, avg(CASE WHEN b.gain > 0 AND x.c <= b.c THEN llm_ok ELSE free_ok END::DOUBLE) AS accuracy, avg((b.gain > 0 AND x.c <= b.c)::INT::DOUBLE) AS llm_share FROM x JOIN b ON b.own = x.fold AND b.k = 1 GROUP BY 1""")
def threshold_gate(spark, d):
    """Below which confidence (two digits) the expensive model answers: the threshold with the most right answers on the
    other folds (ties: the lowest; none if none gains)."""
    x = pair_log(spark, d).withColumn("c", F.round("free_conf", 2))
    cube = x.groupBy("fold", "c").agg(F.sum(F.col("llm_ok") - F.col("free_ok")).alias("d"))
    folds = F.broadcast(cube.select(F.col("fold").alias("own")).distinct())
    k = folds.join(cube, F.col("own") != F.col("fold")).groupBy("own", "c").agg(F.sum("d").alias("d"))
    gain = k.withColumn("gain", F.sum("d").over(Window.partitionBy("own").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)))
    best = gain.groupBy(F.col("own").alias("fold")).agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("x")).select("fold", F.when(F.col("x.gain") > 0, -F.col("x.c")).alias("threshold"))
    sent = F.coalesce(F.col("c") <= F.col("threshold"), F.lit(False))
    return x.join(F.broadcast(best), "fold").groupBy("fold").agg(F.first("threshold").alias("threshold"), F.avg(F.when(sent, F.col("llm_ok")).otherwise(F.col("free_ok")).cast("double")).alias("accuracy"), F.avg(sent.cast("double")).alias("llm_share"))


@plans.add("q164_margin_coverage", f"""WITH x AS {P}, f AS (SELECT DISTINCT fold AS own FROM x), o AS (SELECT own, x.* FROM f JOIN x ON x.fold <> f.own), an AS (SELECT own, free_pred, avg(llm_ok::DOUBLE) AS anchor FROM o GROUP BY ALL),
r AS (SELECT own, free_pred, free_conf AS t, sum(s) OVER w / sum(n) OVER w AS prec, sum(n) OVER w AS sup FROM (SELECT own, free_pred, free_conf, count(*) AS n, sum(free_ok) AS s FROM o GROUP BY ALL) WINDOW w AS (PARTITION BY own, free_pred ORDER BY free_conf DESC)),
fl AS (SELECT own, free_pred, min(t) AS floor FROM r JOIN an USING (own, free_pred) WHERE prec >= (1 - 0.05::DOUBLE) * anchor AND sup >= 5 GROUP BY ALL)
SELECT x.free_pred, avg(coalesce(x.free_conf >= fl.floor, false)::INT::DOUBLE) AS coverage, avg(CASE WHEN x.free_conf >= fl.floor THEN free_ok::DOUBLE END) AS precision FROM x LEFT JOIN fl ON fl.own = x.fold AND fl.free_pred = x.free_pred GROUP BY 1""")
def margin_coverage(spark, d):
    """Per class the share that is kept with a precision of at least 95 % of the expensive model's on the other folds."""
    x = g.precision_floor(pair_log(spark, d), [], "fold", "free_pred", "free_conf", "free_ok", "llm_ok", 0.05, 5)
    kept = ~F.col("escalate")
    return x.groupBy("free_pred").agg(F.avg(kept.cast("double")).alias("coverage"), F.avg(F.when(kept, F.col("free_ok").cast("double"))).alias("precision"))


@plans.add("q158_versus_expert", f"""WITH e AS (SELECT gold, llm_ok, CASE WHEN free_conf < 0.5::DOUBLE THEN llm_ok ELSE free_ok END AS ok FROM {P}), b AS (SELECT avg(a) AS cascade, avg(l) AS expert FROM (SELECT gold, avg(ok::DOUBLE) AS a, avg(llm_ok::DOUBLE) AS l FROM e GROUP BY 1))
SELECT cascade - expert AS delta, (SELECT count(*) FROM e WHERE ok > llm_ok) AS gained, (SELECT count(*) FROM e WHERE ok < llm_ok) AS lost, CASE WHEN cascade - expert > 0 THEN 'better' WHEN cascade - expert > -0.05 THEN 'within margin' ELSE 'worse' END AS verdict FROM b""")
def versus_expert(spark, d):
    x = pair_log(spark, d).withColumn("ok", F.when(F.col("free_conf") < 0.5, F.col("llm_ok")).otherwise(F.col("free_ok")))
    per = x.groupBy("gold").agg(F.avg("ok").alias("a"), F.avg("llm_ok").alias("l"), F.count_if(F.col("ok") > F.col("llm_ok")).alias("g"), F.count_if(F.col("ok") < F.col("llm_ok")).alias("b"))
    delta = F.avg("a") - F.avg("l")
    return per.agg(delta.alias("delta"), F.sum("g").alias("gained"), F.sum("b").alias("lost"), F.when(delta > 0, "better").when(delta > -0.05, "within margin").otherwise("worse").alias("verdict"))


_CAND = f"(SELECT item_id, gold, 'r' || repeat::VARCHAR AS candidate, free_pred AS p FROM {R} UNION ALL SELECT item_id, gold, 'llm', llm_pred FROM {P})"


@plans.add("q175_rank_candidates", f"""WITH c AS {_CAND}, b AS (SELECT candidate, avg(a) AS bal FROM (SELECT candidate, gold, avg((p = gold)::INT::DOUBLE) AS a FROM c GROUP BY ALL) GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY round(bal, 12) DESC, candidate) AS place FROM b),
d AS (SELECT x.candidate, sum((x.p = x.gold AND y.p <> y.gold)::INT)::DOUBLE AS b, sum((x.p <> x.gold AND y.p = y.gold)::INT)::DOUBLE AS w FROM c x JOIN c y USING (item_id) WHERE y.candidate = (SELECT candidate FROM k WHERE place = 1) GROUP BY 1)
SELECT candidate, bal, place, b::BIGINT AS won, w::BIGINT AS lost, CASE WHEN b + w > 0 THEN (w - b) / sqrt(b + w) ELSE 0.0 END AS z FROM k JOIN d USING (candidate)""")
def rank_candidates(spark, d):
    """Candidates by balanced accuracy; against the leader the discordant items and their standardised difference."""
    long = repeats(spark, d).select("item_id", "gold", F.concat(F.lit("r"), F.col("repeat").cast("string")).alias("candidate"), F.col("free_pred").alias("p")).unionByName(pair_log(spark, d).select("item_id", "gold", F.lit("llm").alias("candidate"), F.col("llm_pred").alias("p")))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("balanced_accuracy", 12)), "candidate"))  # one row a candidate
    k = m.balanced_accuracy(long, ["candidate"], "gold", "p").select("candidate", F.col("balanced_accuracy").alias("bal"), place.alias("place"))
    ok = long.select("item_id", "candidate", (F.col("p") == F.col("gold")).alias("ok"))
    lead = ok.join(F.broadcast(k.where("place = 1").select("candidate")), "candidate", "left_semi").select("item_id", F.col("ok").alias("lead"))
    dis = ok.join(lead, "item_id").groupBy("candidate").agg(F.count_if(F.col("ok") & ~F.col("lead")).alias("won"), F.count_if(~F.col("ok") & F.col("lead")).alias("lost"))
    n = F.col("won") + F.col("lost")
    return k.join(dis, "candidate").withColumn("z", F.when(n > 0, (F.col("lost") - F.col("won")) / F.sqrt(n.cast("double"))).otherwise(0.0))


@plans.add("q189_pooled_repeats", f"SELECT gold, count(*) AS n, avg(free_ok::DOUBLE) AS accuracy, stddev_samp(free_ok::DOUBLE) / sqrt(count(*)) AS se FROM {R} GROUP BY gold")
def pooled_repeats(spark, d):
    """All repeats pooled, for one interval."""
    return repeats(spark, d).groupBy("gold").agg(F.count("*").alias("n"), F.avg("free_ok").alias("accuracy"), (F.stddev_samp("free_ok") / F.sqrt(F.count("*"))).alias("se"))


@plans.add("q198_calibration_slice", f"SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY gold ORDER BY {u_sql(109, 'item_id')}, item_id) AS k, count(*) OVER (PARTITION BY gold) AS n FROM {P}) WHERE k <= greatest(round(n * 0.2::DOUBLE), 1)")
def calibration_slice(spark, d):
    """A fifth of every class, one item at least."""
    w = Window.partitionBy("gold")
    x = pair_log(spark, d).withColumn("k", F.row_number().over(w.orderBy(u(109, "item_id"), "item_id"))).withColumn("n", F.count("*").over(w))
    return x.where(F.col("k") <= F.greatest(F.round(F.col("n") * 0.2), F.lit(1))).select("item_id")


@plans.add("q213_folds_with_fallback", f"""WITH x AS (SELECT item_id, CASE WHEN item_id = 0 THEN 99 ELSE gold END AS y FROM {P}), s AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM x GROUP BY y))
SELECT y, fold, count(*) AS n FROM (SELECT y, CASE WHEN least >= 5 THEN ((row_number() OVER (PARTITION BY y ORDER BY {u_sql(113, 'item_id')}, item_id) - 1) % 5)::INT ELSE floor({u_sql(113, 'item_id')} * 5)::INT END AS fold FROM x, s) GROUP BY ALL""")
def folds_with_fallback(spark, d):
    """Stratified folds, or plain ones by digest where a class has fewer items than there are folds (here item 0's)."""
    x = pair_log(spark, d).select("item_id", F.when(F.col("item_id") == 0, 99).otherwise(F.col("gold")).alias("y"))
    least = x.groupBy("y").agg(F.count("*").alias("c")).agg(F.min("c").alias("least"))
    place = (F.row_number().over(Window.partitionBy("y").orderBy(u(113, "item_id"), "item_id")) - 1) % 5
    fold = F.when(F.col("least") >= 5, place).otherwise(F.floor(u(113, "item_id") * 5)).cast("int")
    return x.crossJoin(F.broadcast(least)).withColumn("fold", fold).groupBy("y", "fold").agg(F.count("*").alias("n"))  # one row


_CLS_BOOT = f"""r AS (SELECT replicate, gold, sum({_w_sql(31, 'replicate', 'item_id')} * (llm_ok - free_ok)::DOUBLE) / nullif(sum({_w_sql(31, 'replicate', 'item_id')}), 0) AS m FROM {P}, (SELECT unnest(range(200)) AS replicate) GROUP BY 1, 2), b AS (SELECT replicate, avg(m) AS d FROM r GROUP BY 1)"""


@plans.add("q203_class_bootstrap", f"WITH {_CLS_BOOT} SELECT (SELECT avg(a) FROM (SELECT avg((llm_ok - free_ok)::DOUBLE) AS a FROM {P} GROUP BY gold)) AS delta, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, least(1.0, 2 * least(avg((d <= 0)::INT::DOUBLE), avg((d >= 0)::INT::DOUBLE))) AS p FROM b")
def class_bootstrap(spark, d):
    """Difference of balanced accuracies, resampled within classes: bounds and a two-sided p value."""
    x = pair_log(spark, d).withColumn("delta", (F.col("llm_ok") - F.col("free_ok")).cast("double"))
    r = replicate_weights(x.select("item_id", "gold", "delta"), "item_id", 200, 31).groupBy("replicate", "gold").agg(F.try_divide(F.sum(F.col("w") * F.col("delta")), F.sum("w")).alias("m")).groupBy("replicate").agg(F.avg("m").alias("d"))
    mean = x.groupBy("gold").agg(F.avg("delta").alias("a")).agg(F.avg("a").alias("delta"))
    low, high = (F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))
    return mean.crossJoin(r.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p")))  # one row each
