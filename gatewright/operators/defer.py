"""Deferral: which items the expensive model answers, under a rule fitted on other folds.

Rules by class work on the cube of (fold, predicted class) sums; statistics of all other folds are the totals less a
fold's own, so no self-join is needed and the cube has folds x classes rows whatever the number of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.functions import stats
from gatewright.operators import ordered
from gatewright.sources.scratch import cut


def class_gate(df: DataFrame, by: list[str], fold: str, pred: str, free_ok: str, llm_ok: str, margin: float = 0.0) -> DataFrame:
    """df with `escalate`: on the items of other folds that the cheap model gave this class, the expensive model's
    accuracy is above the cheap one's by more than the margin. A class unseen there is not escalated."""
    cube = df.groupBy(*by, fold, pred).agg(F.count("*").alias("__n"), F.sum(free_ok).alias("__f"), F.sum(llm_ok).alias("__l"))
    every = Window.partitionBy(*by, pred)
    rest = {c: F.sum(c).over(every) - F.col(c) for c in ("__n", "__f", "__l")}
    gate = cube.select(*by, fold, pred, F.coalesce(F.try_divide(rest["__l"] - rest["__f"], rest["__n"]) > margin, F.lit(False)).alias("escalate"))
    return df.join(F.broadcast(gate), [*by, fold, pred])  # folds x classes rows


def outcome(df: DataFrame, by: list[str], gold: str, free_pred: str, llm_pred: str, escalate: str) -> DataFrame:
    """Balanced accuracy, accuracy and the expensive model's share of what comes out."""
    final = F.when(F.col(escalate), F.col(llm_pred)).otherwise(F.col(free_pred))
    per = df.withColumn("__ok", F.coalesce((final == F.col(gold)).cast("double"), F.lit(0.0))).groupBy(*by, gold).agg(F.avg("__ok").alias("__r"), F.sum("__ok").alias("__s"), F.count("*").alias("__n"), F.sum(F.col(escalate).cast("long")).alias("__e"))
    return per.groupBy(*by).agg(stats.mean(F.col("__r")).alias("balanced_accuracy"), (F.sum("__s") / F.sum("__n")).alias("accuracy"), (F.sum("__e") / F.sum("__n")).alias("llm_share"), F.sum("__n").alias("n"))


def confidence_cascade(df: DataFrame, by: list[str], fold: str, conf: str, share: str) -> DataFrame:
    """df with `escalate`: confidence at most the quantile (linear interpolation) of the other folds' confidences at
    the fold's share (column `share`, one value a fold). Ties may spend more than the share. Confidences are counted
    once; a fold's place among the others' is its place among all less its place in its own fold."""
    cells = df.groupBy(*by, fold, F.col(conf).alias("__c")).agg(F.count("*").alias("__m"))
    shares = df.groupBy(*by, fold).agg(F.max(share).alias("__share"), F.count("*").alias("__own_n"))
    total = shares.groupBy(*by).agg(F.sum("__own_n").alias("__n"))
    aims = (shares.join(total, by) if by else shares.crossJoin(total)).withColumn("__n", F.col("__n") - F.col("__own_n")).withColumn("__at", F.col("__share") * (F.col("__n") - 1)).select(*by, F.col(fold).alias("__own"), "__at")
    others = cells.join(F.broadcast(aims), by) if by else cells.crossJoin(F.broadcast(aims))  # a row a fold
    run = ordered.cumulate(others.withColumn("__m", F.when(F.col(fold) == F.col("__own"), 0).otherwise(F.col("__m"))), [*by, "__own"], ["__c", fold], {"__hi": F.col("__m")})
    held = lambda k: F.max(F.when((F.col("__hi") - F.col("__m") <= k) & (k < F.col("__hi")), F.col("__c")))
    at = F.col("__at")
    low, up, part = held(F.floor(at)), held(F.ceil(at)), F.max(at - F.floor(at))
    least = run.groupBy(*by, F.col("__own").alias(fold)).agg((low + (up - low) * part).alias("__t"))
    return df.join(F.broadcast(least), [*by, fold]).withColumn("escalate", F.col(conf) <= F.col("__t")).drop("__t")  # a row a fold


def threshold_frontier(df: DataFrame, by: list[str], conf: str, free_ok: str, llm_ok: str) -> DataFrame:
    """For every distinct confidence t (escalate what is at most t) and for none (t null): share and accuracy. Running
    sums over distinct confidences instead of a join of items with thresholds."""
    per = df.groupBy(*by, F.col(conf).alias("t")).agg(F.count("*").alias("n"), F.sum(free_ok).alias("f"), F.sum(llm_ok).alias("l"))
    up, every = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    total = F.sum("n").over(every)
    some = per.select(*by, "t", (F.sum("n").over(up) / total).alias("share"), ((F.sum("l").over(up) + F.sum("f").over(every) - F.sum("f").over(up)) / total).alias("accuracy"))
    none = df.groupBy(*by).agg(F.lit(None).cast("double").alias("t"), F.lit(0.0).alias("share"), F.avg(F.col(free_ok).cast("double")).alias("accuracy"))
    return some.unionByName(none)


def cheapest_as_good(frontier: DataFrame, by: list[str], least: str) -> DataFrame:
    """Per group the point with the smallest share whose accuracy is at least the column `least`; of equal shares the
    more accurate one."""
    return frontier.where(F.col("accuracy") >= F.col(least)).groupBy(*by).agg(F.min(F.struct("share", (-F.col("accuracy")).alias("loss"), "t")).alias("x")).select(*by, "x.share", (-F.col("x.loss")).alias("accuracy"), "x.t")


def running_precision(df: DataFrame, by: list[str], pred: str, conf: str, ok: str) -> DataFrame:
    """Precision and support of all items at least as confident, within a predicted class; equal confidences count
    together."""
    points = precision_points(df, by, pred, conf, ok).withColumnRenamed("t", conf)
    return df.join(points, [*by, pred, conf])


def precision_points(df: DataFrame, by: list[str], pred: str, conf: str, ok: str) -> DataFrame:
    """running_precision once per distinct confidence (column t): counts are combined first, so running sums go over
    distinct confidences and not over items."""
    per = df.groupBy(*by, pred, F.col(conf).alias("t")).agg(F.count("*").alias("__n"), F.sum(ok).alias("__s"))
    run = ordered.cumulate(per, [*by, pred], [F.desc("t")], {"support": F.col("__n"), "__right": F.col("__s")})
    return run.select(*by, pred, "t", (F.col("__right") / F.col("support")).alias("precision"), "support")


def guaranteed_coverage(df: DataFrame, by: list[str], pred: str, conf: str, ok: str, bar: float, least: int = 30) -> DataFrame:
    """Per predicted class the lowest confidence from which on the precision clears the bar with the support, and the
    share of the class at or above it (0 without such a confidence)."""
    run = precision_points(df, by, pred, conf, ok)
    good = F.when((F.col("precision") >= bar) & (F.col("support") >= least), F.struct(F.col("support").alias("s"), F.col("t")))
    return run.groupBy(*by, pred).agg(F.max(good).alias("x"), F.max("support").alias("n")).select(*by, pred, F.col("x.t").alias("threshold"), (F.coalesce("x.s", F.lit(0)) / F.col("n")).alias("coverage"))


def precision_floor(df: DataFrame, by: list[str], fold: str, pred: str, conf: str, ok: str, llm_ok: str, margin: float, least: int = 30) -> DataFrame:
    """df with `escalate`: below the lowest confidence at which, on the other folds, the class's running precision is
    at least (1 - margin) times the expensive model's accuracy on the class; classes without one go whole."""
    folds = df.select(fold).distinct()
    others = F.broadcast(folds.withColumnRenamed(fold, "__own")).join(df, F.col("__own") != F.col(fold))  # one copy a fold
    run = precision_points(others, [*by, "__own"], pred, conf, ok)
    anchor = others.groupBy(*by, "__own", pred).agg(F.avg(F.col(llm_ok).cast("double")).alias("__anchor"))
    good = (F.col("precision") >= (1 - margin) * F.col("__anchor")) & (F.col("support") >= least)
    floor = run.join(F.broadcast(anchor), [*by, "__own", pred]).where(good).groupBy(*by, F.col("__own").alias(fold), pred).agg(F.min("t").alias("__floor"))  # folds x classes rows
    return df.join(F.broadcast(floor), [*by, fold, pred], "left").withColumn("escalate", F.coalesce(F.col(conf) < F.col("__floor"), F.lit(True))).drop("__floor")


def low_confidence_share(df: DataFrame, by: list[str], conf: str, ok: str, item: str, share: float) -> DataFrame:
    """The share of all errors that the least confident `share` of items holds."""
    d = ordered.with_size(ordered.ranked(df, by, [conf, item], "__k"), by, "__n")
    wrong = 1 - F.col(ok)
    return d.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("__k") <= F.round(F.col("__n") * share), wrong).otherwise(0)).cast("double"), F.sum(wrong)).alias("error_share"))


def escalation_dial(df: DataFrame, by: list[str], conf: str, ok: str, item: str, shares: list[float]) -> DataFrame:
    """Accuracy of what is kept when the least confident share goes, for each share. One ranking serves all."""
    d = ordered.with_size(ordered.ranked(df, by, [conf, item], "__k"), by, "__n")
    sums = d.groupBy(*by).agg(*[F.avg(F.when(F.col("__k") > F.round(F.col("__n") * s), F.col(ok).cast("double"))).alias(f"s{i}") for i, s in enumerate(shares)])
    return sums.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"s{i}").alias("accuracy")) for i, s in enumerate(shares)])).alias("x")).select(*by, "x.*")


def band(df: DataFrame, by: list[str], conf: str, ok: str, item: str, share: float) -> DataFrame:
    """The run of round(n * share) items, consecutive in confidence, that holds the most errors; of equal ones the
    first."""
    run = ordered.cumulate(df, by, [conf, item], {"__k": F.lit(1).cast("long"), "__s": (1 - F.col(ok)).cast("long")})
    sums = cut(ordered.with_size(run, by, "__n").withColumn("__w", F.round(F.col("__n") * share).cast("long")), "band")
    ends = sums.select(*by, (F.col("__k") - F.col("__w")).alias("__k"), F.col("__s").alias("__end"), F.col(conf).alias("__high"))
    starts = sums.select(*by, F.col("__k"), F.col("__s"), "__w").unionByName(sums.where("__k = 1").select(*by, F.lit(0).alias("__k"), F.lit(0).cast("long").alias("__s"), "__w"))
    both = starts.join(ends, [*by, "__k"]) if by else starts.join(ends, "__k")
    return both.groupBy(*by).agg(F.max_by(F.struct((F.col("__k") + 1).alias("first"), (F.col("__k") + F.col("__w")).alias("last"), (F.col("__end") - F.col("__s")).alias("errors")), F.struct(F.col("__end") - F.col("__s"), -F.col("__k"))).alias("x")).select(*by, "x.*")


def pareto(df: DataFrame, by: list[str], cost: str, score: str) -> DataFrame:
    """Rows with a price that no row of at most their cost beats in score."""
    upto = Window.partitionBy(*by).orderBy(cost).rangeBetween(Window.unboundedPreceding, 0)
    return df.where(F.col(cost).isNotNull()).withColumn("__best", F.max(score).over(upto)).where(F.col(score) >= F.col("__best")).drop("__best")


def _handed(cells: list, size: dict, room: float) -> list:
    """Classes to hand over, one at a time: the one that raises balanced accuracy on `cells` most (ties: the lowest), as
    long as one does; a class of which more than the room's items come up is passed over. cells: (predicted, gold, n,
    cheap right, expensive right)."""
    golds, preds = sorted({c[1] for c in cells}), sorted({c[0] for c in cells})
    support = {g: sum(c[2] for c in cells if c[1] == g) for g in golds}
    right = {g: sum(c[3] for c in cells if c[1] == g) for g in golds}
    edge: dict = {p: {c[1]: c[4] - c[3] for c in cells if c[0] == p} for p in preds}
    score = lambda r: sum(r[g] / support[g] for g in golds) / len(golds)
    taken, left, now = [], list(preds), score(right)
    while left:
        after = [(score({g: right[g] + edge[p].get(g, 0) for g in golds}), -k) for k, p in enumerate(left)]
        best, k = max(after)
        if best <= now + 1e-12:
            break
        p = left.pop(-k)
        if not 0 < size.get(p, 0) <= room:
            continue
        room -= size[p]
        taken.append(p)
        right, now = {g: right[g] + edge[p].get(g, 0) for g in golds}, best
    return taken


def class_router(df: DataFrame, fold: str, gold: str, pred: str, free_ok: str, llm_ok: str, budget: float) -> DataFrame:
    """df with `escalate`: per fold the predicted classes that are handed over whole, chosen on the other folds by what
    balanced accuracy gains, rescored after each class, while the fold's own items stay within the budget (a share of the
    fold). The choice runs on the (fold, predicted, gold) cube: folds x classes x classes rows on the driver."""
    cube = df.groupBy(fold, F.col(pred).alias("p"), F.col(gold).alias("g")).agg(F.count("*").alias("n"), F.sum(free_ok).alias("f"), F.sum(llm_ok).alias("l")).collect()
    rows = []
    for own in sorted({r[fold] for r in cube}):
        others: dict = {}
        size: dict = {}
        for r in cube:
            if r[fold] == own:
                size[r["p"]] = size.get(r["p"], 0) + r["n"]
            else:
                c = others.setdefault((r["p"], r["g"]), [0, 0, 0])
                for k, x in enumerate((r["n"], r["f"], r["l"])):
                    c[k] += x
        rows += [(own, p) for p in _handed([(*k, *v) for k, v in others.items()], size, budget * sum(size.values()))]
    kind = dict(df.dtypes)
    chosen = df.sparkSession.createDataFrame(rows, f"`{fold}` {kind[fold]}, `{pred}` {kind[pred]}").withColumn("escalate", F.lit(True))
    return df.join(F.broadcast(chosen), [fold, pred], "left").withColumn("escalate", F.coalesce("escalate", F.lit(False)))  # folds x classes rows


def boards(df: DataFrame, fold: str, gold: str, models: dict[str, str], prior: float = 20.0) -> DataFrame:
    """own, model, cls, score, edge, turn: for every fold the models' competence on the other folds. score: how often the
    model's claim of the class is right, shrunk to its accuracy by `prior` pseudo-counts (a class it never claims has that
    accuracy); edge: score less the class's mean over models; turn: the model's place by accuracy (ties: as listed)."""
    long = df.select(fold, gold, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("model"), F.col(p).alias("cls")) for i, (m, p) in enumerate(models.items())])).alias("x")).select(fold, gold, "x.*")
    cube = long.groupBy(fold, "i", "model", "cls").agg(F.count("*").alias("n"), F.sum(F.coalesce((F.col("cls") == F.col(gold)).cast("int"), F.lit(0))).alias("h"))
    folds, names, classes = (cube.select(*c).distinct() for c in ([F.col(fold).alias("own")], ["i", "model"], ["cls"]))
    others = cube.crossJoin(F.broadcast(folds)).where(F.col("own") != F.col(fold))  # folds x folds x models x classes rows
    cell = others.groupBy("own", "model", "cls").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    every = others.groupBy("own", "i", "model").agg((F.sum("h") / F.sum("n")).alias("acc"))
    every = every.withColumn("turn", F.row_number().over(Window.partitionBy("own").orderBy(F.desc(F.round("acc", 12)), "i")))
    zero = F.lit(0)
    grid = every.crossJoin(F.broadcast(classes)).join(cell, ["own", "model", "cls"], "left")
    scored = grid.withColumn("score", (F.coalesce("h", zero) + prior * F.col("acc")) / (F.coalesce("n", zero) + prior))
    return scored.select("own", "model", "cls", "score", (F.col("score") - F.avg("score").over(Window.partitionBy("own", "cls"))).alias("edge"), "turn")


def pool_router(df: DataFrame, fold: str, gold: str, models: dict[str, str], llm_ok: str, budget: float, prior: float = 20.0) -> DataFrame:
    """df with `pred`, `free_ok` and `escalate`: of several cheap models the claim with the largest edge on the other folds'
    board (ties: the more accurate model), and the classes so claimed that go to the expensive model: those that raise
    balanced accuracy on the other folds most, one at a time, within the budget of the fold's own items. An item's copies, one
    a fold, are settled in place from a map of models x classes."""
    key = lambda m, p: F.concat(F.lit(f"{m}|"), p.cast("string"))
    board = boards(df, fold, gold, models, prior).groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "model", F.col("cls").cast("string")), F.struct(F.round("edge", 12).alias("e"), (-F.col("turn")).alias("t"))))).alias("__board"))
    claims = F.array(*[F.struct(F.element_at("__board", key(m, F.col(p))).alias("b"), F.col(p).alias("p")) for m, p in models.items()])
    each = df.crossJoin(F.broadcast(board)).withColumn("pred", F.array_max(claims)["p"]).drop("__board")  # a row a fold
    each = each.withColumn("free_ok", F.coalesce((F.col("pred") == F.col(gold)).cast("int"), F.lit(0)))
    cube = each.groupBy("own", (F.col(fold) == F.col("own")).alias("mine"), F.col("pred").alias("p"), F.col(gold).alias("g")).agg(F.count("*").alias("n"), F.sum("free_ok").alias("f"), F.sum(llm_ok).alias("l")).collect()  # folds x 2 x classes x classes rows
    rows = []
    for own in sorted({r["own"] for r in cube}):
        size: dict = {}
        for r in cube:
            if r["own"] == own and r["mine"]:
                size[r["p"]] = size.get(r["p"], 0) + r["n"]
        cells = [(r["p"], r["g"], r["n"], r["f"], r["l"]) for r in cube if r["own"] == own and not r["mine"]]
        rows += [(own, p) for p in _handed(cells, size, budget * sum(size.values()))]
    kinds = dict(each.dtypes)
    chosen = df.sparkSession.createDataFrame(rows, f"own {kinds['own']}, pred {kinds['pred']}").withColumn("escalate", F.lit(True))
    mine = each.where(F.col(fold) == F.col("own"))
    return mine.join(F.broadcast(chosen), ["own", "pred"], "left").withColumn("escalate", F.coalesce("escalate", F.lit(False))).drop("own")


def margin_signal(proba: Column) -> Column:
    """Largest probability less the second largest."""
    top = F.sort_array(proba, asc=False)
    return F.element_at(top, 1) - F.element_at(top, 2)


def arbitrate(df: DataFrame, keep: list[str], board: DataFrame, models: dict[str, str]) -> DataFrame:
    """Per item the claim of the model whose competence (board: model, cls, score) in its own claim is the largest
    above the class's mean over models; earlier models win ties."""
    mean = board.withColumn("__mean", F.avg("score").over(Window.partitionBy("cls"))).select("model", "cls", (F.col("score") - F.col("__mean")).alias("edge"))
    long = df.select(*keep, F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(m).alias("model"), F.col(p).alias("cls")) for i, (m, p) in enumerate(models.items())])).alias("x")).select(*keep, "x.*")
    scored = long.join(F.broadcast(mean), ["model", "cls"], "left")  # models x classes rows
    return scored.groupBy(*keep).agg(F.max_by(F.struct("model", "cls"), F.struct(F.round(F.coalesce("edge", F.lit(0.0)), 12), -F.col("turn"))).alias("x")).select(*keep, "x.model", F.col("x.cls").alias("pred"))
