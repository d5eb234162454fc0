"""Scores of generated answers against gold ones as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewright.functions import text as t

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def benchmark_form(text: Column, stem: bool = False) -> Column:
    """Without punctuation, trimmed, lower case; with stem, every word without its plural or participle ending."""
    out = F.lower(F.trim(F.translate(text, PUNCTUATION, "")))
    return F.array_join(F.transform(F.filter(F.split(out, r"\s+"), lambda w: w != ""), stemmed), " ") if stem else out


def stemmed(word: Column) -> Column:
    """A word without one inflectional ending: -sses to -ss, -ies to -i, -s off (not -ss, -us, -is); -ing and -ed off behind a vowel and
    three letters."""
    plural = F.when(F.endswith(word, F.lit("sses")), F.substring(word, F.lit(1), F.length(word) - 2)).when(F.endswith(word, F.lit("ies")), F.substring(word, F.lit(1), F.length(word) - 2))
    plural = plural.when(F.regexp_like(word, F.lit(r"[^sui]s$")) & (F.length(word) > 3), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    return F.when(F.regexp_like(plural, F.lit(r"^.*[aeiouy].*.ing$")) & (F.length(plural) > 5), F.substring(plural, F.lit(1), F.length(plural) - 3)).when(F.regexp_like(plural, F.lit(r"^.*[aeiouy].*.ed$")) & (F.length(plural) > 4), F.substring(plural, F.lit(1), F.length(plural) - 2)).otherwise(plural)


def exact_parse(raw: Column, classes: list[str]) -> Column:
    """The class that the normalised output equals; null otherwise."""
    return F.when(t.normalize_label(raw).isin(classes), t.normalize_label(raw))


def any_of_exact(pred: Column, gold: Column) -> Column:
    """Whether the prediction equals one of the gold answers after normalisation."""
    return F.exists(gold, lambda g: t.normalize_qa(g) == t.normalize_qa(pred))


def any_of_f1(pred: Column, gold: Column) -> Column:
    """The best token F1 over the gold answers."""
    return F.array_max(F.transform(gold, lambda g: t.token_f1(pred, g)))


def field_f1(pred: Column, gold: Column) -> Column:
    """F1 over the keys of two maps: a key counts if it stands on both sides with equal fields. 1 if both are empty."""
    both = F.array_intersect(F.map_keys(pred), F.map_keys(gold))
    right = F.size(F.filter(both, lambda k: t.fields_equal(F.element_at(pred, k), F.element_at(gold, k))))
    n = F.cardinality(pred) + F.cardinality(gold)
    return F.when(n == 0, 1.0).otherwise(2 * right / n)


def set_f1_counts(pred: Column, gold: Column, classes: list[str]) -> tuple[Column, Column, Column]:
    """True and false positives and false negatives of the classes that a text names (as substrings), against gold's."""
    every = F.array(*[F.lit(c) for c in classes])
    said, true = _named(every, pred), _named(every, gold)
    return F.size(F.array_intersect(said, true)), F.size(F.array_except(said, true)), F.size(F.array_except(true, said))


def _named(every: Column, text: Column) -> Column:
    return F.filter(every, lambda c: F.contains(F.lower(text), c))


def consumed_counts(generations: Column, answers: Column) -> tuple[Column, Column, Column]:
    """Each answer consumes the first generation left that contains it: true positives, answers without one (false
    negatives), generations left in the end (false positives)."""
    start = F.struct(generations.alias("left"), F.lit(0).alias("tp"), F.lit(0).alias("fn"))

    def step(s: Column, a: Column) -> Column:
        at = F.array_position(F.transform(s["left"], lambda g: F.contains(F.lower(g), F.lower(a))), F.lit(True))
        rest = F.filter(s["left"], lambda _g, i: i != at.cast("int") - 1)
        return F.when(at > 0, F.struct(rest.alias("left"), (s["tp"] + 1).alias("tp"), s["fn"].alias("fn"))).otherwise(F.struct(s["left"].alias("left"), s["tp"].alias("tp"), (s["fn"] + 1).alias("fn")))

    out = F.aggregate(answers, start, step)
    return out["tp"], out["fn"], F.size(out["left"])
