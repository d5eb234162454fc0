import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.functions import stats
from gatewright.functions import text as t
from gatewright.ml import models
from gatewright.operators import conformal, defer, folds, metrics


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_normal_quantile():
    assert stats.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert stats.normal_cdf(stats.normal_quantile(0.3)) == pytest.approx(0.3)


def test_clopper_pearson_ends():
    assert stats.clopper_pearson_bounds(0, 10)[0] == 0
    assert stats.clopper_pearson_bounds(10, 10)[1] == 1
    low, high = stats.clopper_pearson_bounds(5, 10)
    assert low == pytest.approx(0.187086, abs=1e-5) and high == pytest.approx(0.812914, abs=1e-5)


def test_tango_is_symmetric():
    low, high = stats.tango_bounds(8, 3, 40, stats.Z95)
    mirrored = stats.tango_bounds(3, 8, 40, stats.Z95)
    assert low == pytest.approx(-mirrored[1], abs=1e-6) and high == pytest.approx(-mirrored[0], abs=1e-6)
    assert low < 5 / 40 < high


def test_mcnemar(spark):
    r = one(spark, none=stats.mcnemar(F.lit(0), F.lit(0), "exact"), exact=stats.mcnemar(F.lit(1), F.lit(9), "exact"), chi=stats.mcnemar(F.lit(10), F.lit(30), "chi2"))
    assert r["none"] == 1.0
    assert r["exact"] == pytest.approx(2 * (1 + 10) / 1024)
    assert r["chi"] == pytest.approx(math.erfc(19 / math.sqrt(40) / math.sqrt(2)), abs=1e-9)


def test_resolve_and_score(spark):
    labels = ["yes", "no"]
    r = one(spark, a=t.resolve(F.lit("Yes."), labels), b=t.resolve(F.lit("answer: NO"), labels), c=t.resolve(F.lit("perhaps"), labels), d=t.score_prediction(F.lit("no"), F.lit("not yes but no"), labels), e=t.score_prediction(F.lit("no"), F.lit("yes or no"), labels), f=t.score_prediction(F.lit("no"), F.lit(None).cast("string"), labels))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == ("yes", "no", None, 1, 0, 0)


def test_token_f1(spark):
    r = one(spark, a=t.token_f1(F.lit("the cat sat"), F.lit("cat sat down")), b=t.token_f1(F.lit(""), F.lit("")), c=t.token_f1(F.lit("a"), F.lit("dog")))
    assert r["a"] == pytest.approx(0.8) and r["b"] == 1.0 and r["c"] == 0.0


def test_metrics_of_degenerate_tables(spark):
    rows = spark.createDataFrame([(0, 0, 0.5, 1), (0, 0, 0.5, 1)], "gold int, pred int, conf double, ok int")
    assert metrics.auroc(rows, [], "conf", "ok").first()["auroc"] is None
    assert metrics.mcc(rows, [], "gold", "pred").first()["mcc"] == 0.0
    assert metrics.balanced_accuracy(rows, [], "gold", "pred").first()["balanced_accuracy"] == 1.0
    assert metrics.balanced_accuracy(rows.limit(0), [], "gold", "pred").first()["balanced_accuracy"] is None


def test_conformal_overflow(spark):
    scores = spark.createDataFrame([(1, 0.1), (1, 0.2)], "g int, s double")
    assert conformal.thresholds(scores, ["g"], "s", 0.1).first()["threshold"] == math.inf
    assert conformal.thresholds(scores, ["g"], "s", 0.1, "max").first()["threshold"] == 0.2


def test_class_gate_ignores_own_fold(spark):
    """A class that only one fold predicts has nothing to learn from and stays."""
    rows = spark.createDataFrame([(0, 7, 0, 1), (0, 7, 0, 1), (1, 3, 0, 1), (0, 3, 0, 1)], "fold int, pred int, f int, l int")
    got = {(r["fold"], r["pred"]): r["escalate"] for r in defer.class_gate(rows, [], "fold", "pred", "f", "l").collect()}
    assert got == {(0, 7): False, (1, 3): True, (0, 3): True}


def test_grouped_folds_have_no_leaks(spark):
    rows = spark.createDataFrame([(i, f"g{i % 13}", i % 2) for i in range(100)], "i int, g string, y int")
    folded = folds.grouped_fold(rows, "g", "y", 5, 1)
    assert folds.leaks(folded, "g", "fold").isEmpty() and folded.count() == 100


def test_nested_subsets(spark):
    rows = spark.range(200).withColumnRenamed("id", "g")
    small, large = ({r["g"] for r in folds.learning_subset(rows, "g", f, 3).collect()} for f in (0.2, 0.5))
    assert small < large


def test_classifier_knows_parts_of_words(spark):
    """No word comes twice but those of all rows; beginnings of words tell the classes apart."""
    rows = [(i, i % 3, i % 2, f"some words {'prex' if i % 2 else 'sufy'}{chr(97 + i // 26)}{chr(97 + i % 26)}q") for i in range(60)]
    got = models.text_classifier(spark.createDataFrame(rows, "id long, part int, y int, t string"), "part", "t", "y", "id", 3).collect()
    assert len(got) == 60 and all(r["pred"] == r["gold"] for r in got)


def test_isotonic_is_by_class(spark):
    rows = [(i % 2, (i % 10) / 10, int(c == 0), c) for c in (0, 1) for i in range(80)] + [(0, 0.5, 1, 2)]
    got = models.isotonic(spark.createDataFrame(rows, "fold int, conf double, ok int, cls int"), "fold", "conf", "ok", "cls", 2).collect()
    by = {c: [r["calibrated"] for r in got if r["cls"] == c] for c in range(3)}
    w = 40 / 60  # forty rows of a class in the other fold
    assert len(got) == len(rows) and min(by[0]) >= w and max(by[1]) <= 1 - w and 0 < by[2][0] < 1


def test_labels_are_found_before_the_shuffle(spark):
    """q046_resolve_words sends on the texts that name a label, not every text."""
    from gatewright.plans import registry

    plan = registry.QUERIES["q046_resolve_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan[plan.rindex("Aggregate") :]


def test_resolve_odd_texts(spark):
    """Each stage on its own, labels that are equal in a later stage, and labels that are no word."""
    labels = ["Yes", "yes!", "a b", "A.B", "."]
    raws = {"Yes": "Yes", " YES ": "Yes", "yes!": "yes!", "a b": "a b", "a*b": None, "A.B": "A.B", "the answer is *yes*": "Yes", "label sentiment: YES.\n": "Yes", "answered yes": None, "answer": ".", "": ".", "it is a  b": None, "yes no": None}
    got = spark.createDataFrame([(r,) for r in raws], "r string").select("r", t.resolve(F.col("r"), labels).alias("x")).collect()
    assert {r["r"]: r["x"] for r in got} == raws


def test_scores_search_constant_patterns(spark):
    """q050_scored_snippets builds no pattern per row."""
    from gatewright.plans import registry

    plan = registry.QUERIES["q050_scored_snippets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "concat((?<!" not in plan


def test_tfidf_equals_plain_counts(spark):
    """Odd texts; the commonest terms of each part alone, ties by name; no row's n-grams as an array of strings."""
    import math
    import re
    from collections import Counter

    from gatewright.ml import models

    texts = ["a b a, b!", "", "A b c", "été a b " * 3, "c", " .;- "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["features"].toArray() for r in models.tfidf(rows, 6, 1).transform(rows).collect()}

    def parts(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return Counter(w), Counter(map(" ".join, zip(w, w[1:]))), Counter(f" {x} "[i : i + n] for x in w for n in (3, 4, 5) for i in range(len(x) + 3 - n))

    every = [parts(x) for x in texts]
    for i in range(len(texts)):
        want = []
        for k in range(3):
            tf = sum((e[k] for e in every), Counter())
            kept = sorted(tf, key=lambda x: (-tf[x], x))[:6]
            v = [every[i][k][x] * (math.log((1 + len(texts)) / (1 + sum(x in e[k] for e in every))) + 1) for x in kept]
            norm = math.sqrt(sum(x * x for x in v)) or 1
            want += [x / norm for x in v]
        assert list(got[i]) == pytest.approx(want)


def test_thresholds_of_other_folds(spark):
    """By brute force: ties, scores outside 0 to 1 and all in one step, groups too small for the rank, nulls; no copies of rows."""
    rng = random.Random(5)
    rows = [(g, f, rng.choice([None, 0.5, -3.0, 7.0, rng.random(), 0.25 + rng.random() / 1e5])) for g, n in (("a", 300), ("b", 60), ("c", 4)) for f in range(3) for _ in range(n)]
    scores = spark.createDataFrame(rows, "g string, f int, s double")
    own = scores.select(F.col("f").alias("__own")).distinct()
    got = {(r["g"], r["__own"]): (r["threshold"], r["n"]) for r in conformal.other_thresholds(scores, own, ["g"], "f", "s", 0.1).collect()}
    for g in "abc":
        for o in range(3):
            held = sorted(s for x, f, s in rows if x == g and f != o and s is not None)
            k = -(-(len(held) + 1) * 9 // 10)
            assert got[g, o] == (held[k - 1] if k <= len(held) else math.inf, len(held))


def test_fits_end_at_the_minimum(spark):
    """q284_text_classifier's fits, side by side: the slope of scikit-learn's objective, from transform()'s vectors, is nothing."""
    rows = spark.createDataFrame([(i, i % 3, i // 3 % 3, f"word{i % 3 if i % 5 else 1} word{i % 7} some w{i % 4}" if i % 11 else "") for i in range(66)], "id int, label int, inner int, text string")
    vectors = models.tfidf(rows, 40, 1)
    idfs, terms = spark.sparkContext.broadcast(vectors.idf), sum(map(len, vectors.idf))
    held = vectors.counted(rows, ["id", "label", "inner"])
    wanted = vectors.transform(rows).collect()
    for c, without in ((0.1, 0), (10.0, 2)):
        both = models.fit(held, idfs, c, [np.zeros((3, terms + 1))] * 2, [without, -1], [sum(r["inner"] != k for r in wanted) for k in (without, -1)])
        for w, k in zip(both, (without, -1), strict=True):
            x = np.array([[*r["features"].toArray(), 1.0] for r in wanted if r["inner"] != k])
            e = np.exp(x @ w.T)
            off = e / e.sum(1, keepdims=True) - np.eye(3)[[r["label"] for r in wanted if r["inner"] != k]]
            assert np.abs((off.T @ x + np.c_[w[:, :-1], np.zeros(3)] / c) / len(x)).max() <= 1.001e-4
        got = {r["id"]: r for r in models.scored(held, idfs, both[1][None]).collect()}
        for r in wanted:
            e = np.exp(both[1] @ [*r["features"].toArray(), 1.0])
            assert got[r["id"]]["pred"] == e.argmax() and got[r["id"]]["conf"] == pytest.approx(e.max() / e.sum())


def test_the_whole_grid_is_searched(spark, monkeypatch):
    """q284_text_classifier: five values of C on three inner folds each, then all rows; fewer folds for a class of two texts."""
    fits, true = [], models.fit
    monkeypatch.setattr(models, "fit", lambda held, idfs, c, starts, without, sizes: fits.append((c, without)) or true(held, idfs, c, starts, without, sizes))
    rows = [(i, i % 2, i % 4 // 2, f"{'abc' if i % 4 < 2 else 'xyz'} w{i}") for i in range(24)] + [(24, 0, 2, "rare one"), (25, 0, 2, "rare two"), (26, 1, 2, "rare six"), (27, 1, 2, "rare ten")]
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = models.text_classifier(spark.createDataFrame(rows, "id long, part int, y int, t string"), "part", "t", "y", "id", 2)
    assert {(r["item"], r["fold"], r["gold"]) for r in got.collect()} == {r[:3] for r in rows}
    assert len(fits) == 12 and [(c, w) for c, w in fits if w != [-1]] == [(c, [0, 1]) for c in (0.1, 0.3, 1.0, 3.0, 10.0)] * 2 and models.INNER == 3
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before  # no copy of the vectors stays
