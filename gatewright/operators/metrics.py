"""Classification metrics over tables of items: gold and predicted columns, groups by any keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.functions import stats
from gatewright.operators import ordered


def accuracy(df: DataFrame, by: list[str], gold: str, pred: str) -> DataFrame:
    """An unparsed (null) prediction is wrong."""
    ok = F.coalesce((F.col(pred) == F.col(gold)).cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(ok).alias("accuracy"), F.count("*").alias("n"))


def class_recall(df: DataFrame, by: list[str], gold: str, pred: str, classes: DataFrame | None = None) -> DataFrame:
    """Recall and support per gold class; with a table of classes (column cls) those without support too, recall null."""
    ok = F.coalesce((F.col(pred) == F.col(gold)).cast("double"), F.lit(0.0))
    out = df.groupBy(*by, F.col(gold).alias("cls")).agg(F.avg(ok).alias("recall"), F.count("*").alias("support"))
    if classes is None:
        return out
    spine = classes.crossJoin(F.broadcast(df.select(*by).distinct())) if by else classes
    return spine.join(out, [*by, "cls"], "left").withColumn("support", F.coalesce("support", F.lit(0)))


def balanced_accuracy(df: DataFrame, by: list[str], gold: str, pred: str) -> DataFrame:
    """Mean recall over the classes that have support."""
    return class_recall(df, by, gold, pred).groupBy(*by).agg(stats.mean(F.col("recall")).alias("balanced_accuracy"), F.count("*").alias("classes"))


def confusion(df: DataFrame, by: list[str], gold: str, pred: str) -> DataFrame:
    return df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def macro_f1(df: DataFrame, by: list[str], gold: str, pred: str, classes: DataFrame) -> DataFrame:
    """Mean F1 over the given classes (column cls); a class that is neither given nor predicted counts 0."""
    cells = confusion(df, by, gold, pred)
    rows = cells.select(*by, F.col("gold").alias("cls"), "n", F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold") == F.col("pred")).cast("int").alias("hit"))
    cols = cells.where("pred is not null").select(*by, F.col("pred").alias("cls"), "n", F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("hit"))
    sums = rows.unionByName(cols).groupBy(*by, "cls").agg(*[F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("g", "p", "hit")])
    spine = classes.crossJoin(F.broadcast(df.select(*by).distinct())) if by else classes
    f1 = spine.join(sums, [*by, "cls"], "left").withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("g") + F.col("p")), F.lit(0.0)))
    return f1.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def mcc(df: DataFrame, by: list[str], gold: str, pred: str) -> DataFrame:
    """Multiclass correlation of gold and prediction from the confusion table's margins; 0 where it is undefined."""
    cells = confusion(df, by, gold, pred)
    diag = cells.groupBy(*by).agg(F.sum("n").cast("double").alias("s"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).cast("double").alias("c"))
    rows = cells.groupBy(*by, F.col("gold").alias("k")).agg(F.sum("n").alias("t"))
    cols = cells.groupBy(*by, F.col("pred").alias("k")).agg(F.sum("n").alias("p"))
    both = rows.join(cols, [*by, "k"], "full_outer").groupBy(*by).agg(*[F.sum(F.coalesce(F.col(a), F.lit(0)).cast("double") * F.coalesce(F.col(b), F.lit(0))).alias(x) for x, a, b in (("tp", "t", "p"), ("tt", "t", "t"), ("pp", "p", "p"))])
    d = diag.join(both, by) if by else diag.crossJoin(both)
    under = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return d.select(*by, F.when(under > 0, (F.col("c") * F.col("s") - F.col("tp")) / under).otherwise(0.0).alias("mcc"))


def auroc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve, ties counting half; null where only one outcome occurs.

    Counts per distinct score come first, so the running sums go over distinct scores, not over rows."""
    per = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(positive)).cast("double").alias("pos"), F.sum(1 - F.col(positive)).cast("double").alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = per.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return won.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auroc"))


def calibration_table(df: DataFrame, by: list[str], conf: str, ok: str, bins: int = 10) -> DataFrame:
    """Per bin (lo, hi] of confidence, the first one closed: count, mean confidence, accuracy; empty bins too."""
    b = F.greatest(F.ceil(F.col(conf) * bins).cast("int") - 1, F.lit(0))
    own = df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("confidence"), F.avg(F.col(ok).cast("double")).alias("accuracy"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    spine = spine.crossJoin(F.broadcast(df.select(*by).distinct())) if by else spine
    return spine.join(own, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(df: DataFrame, by: list[str], conf: str, ok: str, bins: int = 10) -> DataFrame:
    t = calibration_table(df, by, conf, ok, bins).where("n > 0")
    return t.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def paired_table(df: DataFrame, by: list[str], a_ok: str, b_ok: str, sent: str) -> DataFrame:
    """Both, a alone, b alone, neither right: counts and the share that was sent on."""
    cell = F.when((F.col(a_ok) == 1) & (F.col(b_ok) == 1), "both").when(F.col(a_ok) == 1, "a_only").when(F.col(b_ok) == 1, "b_only").otherwise("neither")
    return df.groupBy(*by, cell.alias("cell")).agg(F.count("*").alias("n"), F.avg(F.col(sent).cast("double")).alias("sent_share"))


def class_advantage(df: DataFrame, by: list[str], pred: str, free_ok: str, llm_ok: str, least: int = 1) -> DataFrame:
    """Per predicted class: share, both accuracies, advantage of the expensive model; spread over classes of `least`
    items."""
    d = df.groupBy(*by, F.col(pred).alias("cls")).agg(F.count("*").alias("n"), F.avg(F.col(free_ok).cast("double")).alias("free_acc"), F.avg(F.col(llm_ok).cast("double")).alias("llm_acc"))
    every = Window.partitionBy(*by)
    d = d.withColumn("share", F.col("n") / F.sum("n").over(every)).withColumn("advantage", F.col("llm_acc") - F.col("free_acc"))
    seen = F.when(F.col("n") >= least, F.col("advantage"))
    return d.withColumn("spread", F.max(seen).over(every) - F.min(seen).over(every))


def roc_dominance(df: DataFrame, models: dict[str, str], gold: str, rates: list[float]) -> DataFrame:
    """Per pair of models (score columns, gold 0/1): whether the first has at least the second's true positive rate
    at every given share of items called positive."""
    long = df.select(gold, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in models.items()])).alias("x")).select(gold, "x.*")
    placed = ordered.with_size(ordered.ranked(long, ["model"], [F.desc("score"), F.col(gold)], "__k"), ["model"], "__n").withColumn("place", F.col("__k") / F.col("__n"))
    tpr = placed.groupBy("model").agg(*[(F.sum(F.when(F.col("place") <= r, F.col(gold)).otherwise(0)) / F.sum(gold)).alias(f"r{k}") for k, r in enumerate(rates)])
    better = F.lit(True)
    for k in range(len(rates)):
        better = better & (F.col(f"a.r{k}") >= F.col(f"b.r{k}"))
    # one row a model
    return tpr.alias("a").join(tpr.alias("b"), F.col("a.model") != F.col("b.model")).select(F.col("a.model").alias("model"), F.col("b.model").alias("other"), better.alias("dominates"))


def competence(df: DataFrame, by: list[str], models: dict[str, tuple[str, str]], prior: float = 20.0) -> DataFrame:
    """Per model and class it predicts: accuracy shrunk to the model's own: (hits + prior * overall) / (n + prior).
    models: name -> (prediction column, outcome column)."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(p).alias("cls"), F.col(ok).cast("double").alias("ok")) for m, (p, ok) in models.items()])).alias("x")).select(*by, "x.*")
    cell = long.groupBy(*by, "model", "cls").agg(F.sum("ok").alias("hits"), F.count("*").alias("n"))
    every = Window.partitionBy(*by, "model")
    overall = F.sum("hits").over(every) / F.sum("n").over(every)
    return cell.withColumn("score", (F.col("hits") + prior * overall) / (F.col("n") + prior))


def weighted_share(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Hájek's estimate and the effective number of rows (sum w)^2 / sum w^2."""
    w = F.col(weight).cast("double")
    return df.groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("share"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_effective"))
