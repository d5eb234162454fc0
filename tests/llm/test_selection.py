"""Importance resampling, decontamination and the audit of filters: against SQL, brute force, odd rows and small constants."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.llm import decontamination as dc
from gatewright.llm import filter_audit as fa
from gatewright.llm import importance as im
from gatewright.llm import words as wd
from tests.compare import duck_rows, spark_rows
from tests.llm.conftest import TEXTS

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [dc, fa, im], ids=["op12", "op13", "op11"])
def test_queries_match_sql(spark, module):
    for name, query in module.QUERIES.items():
        assert spark_rows(query(spark, SF_DIR)) == duck_rows(module.ORACLE_SQL[name], SF_DIR)


def split(text):
    return re.findall(wd.PATTERN, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_words_and_checksums():
    for text in [None, "", " ", "A-b C_d\x00e é日本 ñÑ\x1c\x85x y", "x" * 300 + " Y9", *[t for _, t in TEXTS]]:
        assert [w.decode() for w in wd.words(text)] == split(text)
    texts = [None, "one", "one two", "A-b c d e" + " x" * 5 + "é" * 90, "q" * 500 + " " + "r" * 65 + " s"]
    doc, bucket, n = im.feature_buckets(texts, 10_000)
    got = sorted(zip(doc.tolist(), bucket.tolist(), strict=True))
    want = [(i, zlib.crc32(" ".join(w[a : a + k]).encode()) % 10_000) for i, t in enumerate(texts) for w in [split(t)] for k in (1, 2, 3) for a in range(len(w) - k + 1)]
    assert got == sorted(want) and n.tolist() == [len(split(t)) for t in texts]


def test_packed_keys():
    rng = np.random.default_rng(5)
    for keys in ([], [0], [7, 7, 7], np.sort(rng.integers(0, 1 << 31, 500))):
        assert im.unpack(im.pack(np.array(keys, np.int64))).tolist() == list(keys)


def brute_scores(rows, target, percent, least, buckets=10_000):
    grams = lambda w: [zlib.crc32(" ".join(w[a : a + k]).encode()) % buckets for k in (1, 2, 3) for a in range(len(w) - k + 1)]
    own, wanted = [grams(split(t)) for _, t in rows], [b for t in target for b in grams(split(t))]
    s, t = np.bincount([b for f in own for b in f], minlength=buckets), np.bincount(np.array(wanted, int), minlength=buckets)
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + buckets) / ((int(s[b]) + 1) * (int(t.sum()) + buckets)))) for b in range(buckets)]
    out = []
    for (key, _), f in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((-x[3], math.inf if x[0] is None else x[0]) for x, (_, t) in zip(out, rows, strict=True) if len(split(t)) >= least)
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("ranges,task_bytes", [(16, 1 << 25), (3, 40)])
def test_importance_against_brute_force(spark, odd, monkeypatch, ranges, task_bytes):
    """Also with ranges dealt to several tasks, and blocks of a few rows."""
    monkeypatch.setattr(im, "BLOCK_TEXTS", 2)
    target = ["alpha beta w1 w2 w3", None, "", "zzz " * 9]
    df = spark.createDataFrame([(t,) for t in target], "text string")
    got = im.weights(odd, "doc_id", "text", df, "text", ranges=ranges, task_bytes=task_bytes)
    want, drawn = brute_scores(TEXTS, target, 50, 2)
    assert sorted((str(r["key"]), r["n_features"], r["weight"]) for r in got.collect()) == sorted((str(k), n, w) for k, n, w, _ in want)
    out = im.resample(odd, "doc_id", "text", df, "text", percent=50, least_words=2).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in out) == sorted((str(k), s) for k, _, _, s in want)
    ranked = sorted((r["rank"], -r["score"], math.inf if r["doc_id"] is None else r["doc_id"]) for r in out if r["rank"] is not None)
    assert [x[0] for x in ranked] == list(range(1, len(drawn) + 1)) and [x[1:] for x in ranked] == drawn


def test_importance_without_rows(spark, odd, empty):
    target = spark.createDataFrame([("a b",)], "text string")
    assert im.resample(empty, "doc_id", "text", target, "text").count() == 0
    assert im.resample(odd, "doc_id", "text", target.limit(0), "text").count() == len(TEXTS)


def test_ranks_over_many_ties(spark):
    """A third of all rows with one id and score are spread over ranges, and ranks have no gaps."""
    rows = spark.range(3000).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("place"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 100).alias("score"))
    got = im._ranked(rows, 2500).join(rows, ["block", "place"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 2501))
    assert [(-r["score"], r["key"]) for r in got] == sorted((-r["score"], r["key"]) for r in rows.collect())[:2500]


def brute_hits(rows, items, n):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for key, text in rows:
        w = split(text)
        hit, held = set(), set()
        for g, names in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    held |= names
        out.append((str(key), len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


ITEMS = [
    (1, " ".join(f"p{i}" for i in range(30, 55))), (2, "Alpha, BETA gamma"), (2, "delta"), (10, "w58 other"), (3, None), (4, ""), (5, "word word word word word word word word word word word word"),
    (None, "not there at all"), (6, "日本語のテキスト"), (7, " ".join(f"w{i}" for i in range(12))), (8, " ".join(f"w{i}" for i in range(1, 11))), (9, "w0 w1 w2 w3 changed w5 w6 w7 w8 w9 w10"), (11, "a row without an id"),
]


@pytest.mark.parametrize("items", [ITEMS, [x for x in ITEMS if len(split(x[1])) >= 10], ITEMS[4:6]], ids=["short", "long", "blank"])
def test_decontamination_against_brute_force(spark, odd, items):
    df = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, hash string")
    got = dc.contaminated(odd.withColumn("row", F.lit("x")).withColumn("segment", F.lit(1)), "doc_id", "text", df, "item_id", "text").collect()
    assert sorted((str(r["doc_id"]), *list(r)[1:]) for r in got) == brute_hits(TEXTS, items, 10)


def test_decontamination_of_random_words(spark):
    """Few different words: windows that overlap, repeat and share shingles."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    rows = [(i, text(rng.randrange(60))) for i in range(60)]
    items = [(i, text(rng.randrange(1, 16))) for i in range(25)]
    docs, df = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for n, k in ((10, 3), (6, 2), (1, 1)):
        got = dc.contaminated(docs, "doc_id", "text", df, "item_id", "text", n, k).collect()
        assert sorted((str(r["doc_id"]), *list(r)[1:]) for r in got) == brute_hits(rows, items, n)


def test_decontamination_without_rows(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.contaminated(empty, "doc_id", "text", items, "item_id", "text").count() == 0
    got = dc.contaminated(odd, "doc_id", "text", items.limit(0), "item_id", "text").collect()
    assert len(got) == len(TEXTS) and not any(r["contaminated"] or r["n_hit"] for r in got)


def brute_masks(rows):
    out = []
    for key, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        m = (len(w) < 200) | (100 * len(set(w)) < 50 * len(w)) << 1 | (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) << 2 | bool(re.search(r"[#$%&*|]", t)) << 3
        known = lambda k: math.inf if k is None else k
        out.append((key, m | any((u or "") == t and known(k) < known(key) for k, u in rows) << 4))
    return out


ROWS = [*TEXTS, (20, "ÄÖ ABC é"), (21, "A B"), (22, "50%|"), (None, "one"), (None, None), (30, "\x1c a\x85b"), (31, "  \t\n "), (19, "A B"), (40, " ".join(f"w{i}" for i in range(250))), (39, " ".join(f"w{i}" for i in range(250)))]


@pytest.mark.parametrize("hold,parts", [(1 << 25, 3), (8, 2), (1, 7)])
def test_masks_against_brute_force(spark, hold, parts):
    """Also where a partition hands its chains on again and again."""
    df = spark.createDataFrame([(k, t, "en" if i % 2 else None, 1) for i, (k, t) in enumerate(ROWS)], "doc_id long, text string, part string, mask int").repartition(parts)
    got = fa.masks(df, "doc_id", "text", F.col("part"), hold=hold).collect()
    assert sorted((str(r["doc_id"]), r["mask"]) for r in got) == sorted((str(k), m) for k, m in brute_masks(ROWS))
    ids = sorted(str(r["doc_id"]) for r in fa.non_minimum_ids(df, "doc_id", "text").collect())
    assert ids == sorted(str(k) for k, m in brute_masks(ROWS) if m & 16)


def test_one_fingerprint_of_many_texts(monkeypatch):
    """Texts with one fingerprint are told apart by their full text."""
    monkeypatch.setattr(fa, "_fingerprint", lambda text: len(text) % 2)
    rows = [(k, t, "x") for k, t in ROWS]
    routed = sorted(fa._local(iter(rows), fa.failures, 50), key=lambda x: x[0])
    got = fa._settled(iter(routed), 16)
    assert sorted((str(k), m) for k, _, m in got) == sorted((str(k), m) for k, m in brute_masks(ROWS))


def test_interactions_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["", "en", "de"]), rng.randrange(8), rng.random() < 0.5, rng.random() < 0.3) for _ in range(200)]
    got = {(r["part"], r["filter_order"], r["step"]): r for r in fa.interactions(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"), "ABC").collect()}
    assert len(got) == 3 * 6 * 3
    shapley = {}
    for part in ("", "en", "de"):
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABC"):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABC".index(letter)
                gone = [r for r in left if r[1] & bit]
                r = got[part, "".join(order), step]
                left = [x for x in left if not x[1] & bit]
                assert (r["kept"], r["removed"], r["good_lost"], r["toxic_lost"]) == (len(left), len(gone), sum(x[2] for x in gone), sum(x[3] for x in gone))
                assert (r["redundant"], r["unique_fails"]) == (sum(x[1] & bit > 0 for x in own) - len(gone), sum(x[1] == bit for x in own))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    assert all(r["shapley"] == shapley[p, o[s - 1]] for (p, o, s), r in got.items())


def test_audit_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert fa.op13_filter_audit(spark, str(tmp_path)).count() == 0


def test_audit_of_repeated_labels(spark, tmp_path):
    spark.createDataFrame([(1, "a", "en"), (2, "a", "en"), (None, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 1), (1, 1, None), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["part"], r["step"]): r for r in fa.op13_filter_audit(spark, str(tmp_path)).collect() if r["filter_order"] == "EABCD"}
    assert (got["en", 1]["removed"], got["en", 1]["good_lost"], got["en", 1]["toxic_lost"]) == (1, 1, 0)
    assert (got["en", 2]["removed"], got["en", 2]["good_lost"], got["en", 2]["toxic_lost"]) == (1, 1, 1)
    assert got["", 2]["removed"] == 1 and got["", 1]["kept"] == 1
