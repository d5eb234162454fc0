"""Phrases in texts against plain Python."""

import random
import re

import pytest

from gatewright.operators import phrases as ph
from gatewright.plans import registry

SF_DIR = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def texts():
    rng = random.Random(8)
    made = [(i, " ".join(rng.choice(["a", "b", "c", "d,", "E;"]) for _ in range(rng.randrange(40)))) for i in range(60)]
    return [*made, (100, None), (101, ""), (102, " .,; "), (None, "a b c"), (5, "a b"), (5, "a b"), (103, "x" * 50 + " été größe " + "a " * 3000)]


PHRASES = ["a", "a b", "A, b c", "c d e", "b c", None, "", " ;", "e e e e", "été größe", "zz", "a a a", "a b"]


@pytest.mark.parametrize("part_bytes", [1 << 25, 6])
def test_occurrences(spark, part_bytes):
    """Also where the phrases are cut into several parts."""
    df = spark.createDataFrame([(*r, "x") for r in texts()], "doc_id long, text string, phrase string")
    got = ph.occurrences(df, "doc_id", "text", spark.createDataFrame([(p,) for p in PHRASES], "phrase string"), "phrase", part_bytes).collect()
    want = []
    for key, text in texts():
        w = words(text)
        for p in {" ".join(words(p)) for p in PHRASES} - {""}:
            m = len(p.split())
            want += [(str(key), p, i) for i in range(len(w) - m + 1) if " ".join(w[i : i + m]) == p]
    assert sorted((str(r["doc_id"]), r["phrase"], r["start"]) for r in got) == sorted(want)


def test_passes_do_not_grow_with_phrases(spark):
    """q092_many_phrases: two passes over the texts at most, however many times part_bytes the phrases are."""
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    many = spark.createDataFrame([(f"a b x{i}",) for i in range(500)] + [("a",), ("b c d e",)], "phrase string")
    out = ph.occurrences(df, "doc_id", "text", many, "phrase", 64)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 2
    want = [(str(k), p, i) for k, t in texts() for p in ("a", "b c d e") for w in [words(t)] for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    assert sorted((str(r["doc_id"]), r["phrase"], r["start"]) for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("bits", [8, 1 << 19])
def test_full_filter_loses_and_adds_nothing(spark, monkeypatch, bits):
    """Where all runs pass the filter, the join alone decides; order of words and ends of texts count."""
    monkeypatch.setattr(ph, "BITS_MOST", bits)
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(["a b", "b a c", None, "c", "a b c a b", ""] * 300)], "doc_id long, text string")
    some = spark.createDataFrame([("b a",), ("a b",), ("c a b",), ("b c c",), ("c",)], "phrase string")
    got = ph.occurrences(df, "doc_id", "text", some, "phrase", 0).groupBy("phrase").count().collect()
    assert {r["phrase"]: r["count"] for r in got} == {"a b": 900, "b a": 300, "c a b": 300, "c": 900}


def test_no_phrases_or_texts(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    none = spark.createDataFrame([], "phrase string, kind string, name string")
    assert ph.occurrences(df, "doc_id", "text", none, "phrase").count() == 0
    assert {r["kind"] for r in ph.tags(df, "doc_id", "text", none).collect()} == {"WORD", "BREAK"}
    some = spark.createDataFrame([("a", "THING", "x")], "phrase string, kind string, name string")
    assert ph.tags(df.limit(0), "doc_id", "text", some).count() == 0


TABLE = [("a b", "THING", "ab"), ("a b c", "ACTION", "abc"), ("b c d", "THING", "bcd"), ("c", "NEUTRAL", "c"), ("e", "ACTOR", "z"), ("E", "ACTOR", "e"), ("a a a", "THING", "aaa"), (None, "X", "x"), ("d a", "THING", "da")]


def test_tags(spark):
    known = {}
    for p, kind, name in TABLE:
        if w := tuple(words(p)):
            known[w] = min(known.get(w, ("~",)), (kind, name))
    want = []
    for key, text in texts():
        t = re.findall(r"[^\W_]+|[.,;:!?]", (text or "").lower())
        i = 0
        while i < len(t):
            m = max((m for m in (3, 2, 1) if i + m <= len(t) and tuple(t[i : i + m]) in known), default=0)
            if m:
                kind, name = known[tuple(t[i : i + m])]
                if kind != "NEUTRAL":
                    want.append((str(key), i, i + m, kind, name))
            elif t[i] in ".,;:!?":
                want.append((str(key), i, i + 1, "BREAK", t[i]))
            elif t[i] != "b":
                want.append((str(key), i, i + 1, "WORD", t[i]))
            i += m or 1
    df = spark.createDataFrame([(*r, "x", 1) for r in texts()], "doc_id long, text string, kind string, start int")
    out = ph.tags(df, "doc_id", "text", spark.createDataFrame(TABLE, "phrase string, kind string, name string"), stop=("b",))
    assert sorted((str(r["doc_id"]), r["start"], r["end"], r["kind"], r["name"]) for r in out.collect()) == sorted(want)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_many_phrases_are_many(spark):
    """The query's table grows with the documents' lines."""
    from gatewright.plans.phrases import line_openings

    assert line_openings(spark, SF_DIR).count() > 1000
    assert registry.QUERIES["q092_many_phrases"](spark, SF_DIR).count() > 100


def test_places_are_no_rows_of_a_shuffle(spark):
    """q094_concept_tags joins no table of a row a word: words between matches come out of the row's array."""
    plan = registry.QUERIES["q094_concept_tags"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "posexplode(__t" not in plan
