"""Porter's stemmer (1980) as expressions: the five steps over a column of words, a projection a step.

Words are lower-cased; those of one or two letters, and those with other characters than a to z, stay as they are. Null
stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of steps 2 to 4 and what takes their place (fixed values of the published algorithm).
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _classes(word: Column) -> Column:
    """The word with a y that is a consonant (first, or after a vowel) as Y, so that vowels are [aeiouy]."""
    return F.regexp_replace(F.regexp_replace(word, r"(^|[aeiou])y", "$1Y"), "yy", "yY")


def measure(stem: Column) -> Column:
    """m: how many times a run of vowels is followed by a run of consonants."""
    return F.size(F.regexp_extract_all(_classes(stem), F.lit(r"([aeiouy]+[^aeiouy]+)")))


def _vowel(stem: Column) -> Column:
    return F.regexp_like(_classes(stem), F.lit("[aeiouy]"))


def _double(stem: Column) -> Column:
    return F.regexp_like(stem, F.lit(r"(.)\1$")) & F.regexp_like(_classes(stem), F.lit("[^aeiouy]$"))


def _short(stem: Column) -> Column:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return F.regexp_like(_classes(stem), F.lit(r"[^aeiouy][aeiouy][^aeiouywxY]$"))


def _without(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _longest(word: Column, rules: list[tuple[str, Column, Column]]) -> Column:
    """The rule of the longest suffix that the word ends in: (suffix, condition, replaced word); if its condition fails the
    word stays."""
    out: Column | None = None
    for suffix, holds, new in sorted(rules, key=lambda r: -len(r[0])):
        then = F.when(holds, new).otherwise(word)
        out = F.when(F.endswith(word, F.lit(suffix)), then) if out is None else out.when(F.endswith(word, F.lit(suffix)), then)
    return out.otherwise(word)


def _replaced(word: Column, pairs: tuple[tuple[str, str], ...], least: int) -> Column:
    return _longest(word, [(a, measure(_without(word, len(a))) > least, F.concat(_without(word, len(a)), F.lit(b))) for a, b in pairs])


def _steps() -> list:
    def plural(w: Column) -> Column:
        return F.when(F.endswith(w, F.lit("sses")) | F.endswith(w, F.lit("ies")), _without(w, 2)).when(F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), _without(w, 1)).otherwise(w)

    def past(w: Column) -> Column:
        """-eed, -ed and -ing; a mark is left behind for the words that are mended next."""
        off = lambda n: F.when(_vowel(_without(w, n)), F.concat(_without(w, n), F.lit("+"))).otherwise(w)
        return F.when(F.endswith(w, F.lit("eed")), F.when(measure(_without(w, 3)) > 0, _without(w, 1)).otherwise(w)).when(F.endswith(w, F.lit("ed")), off(2)).when(F.endswith(w, F.lit("ing")), off(3)).otherwise(w)

    def mended(w: Column) -> Column:
        s = _without(w, 1)
        e = F.concat(s, F.lit("e"))
        fixed = F.when(F.regexp_like(s, F.lit("(at|bl|iz)$")), e).when(_double(s) & ~F.regexp_like(s, F.lit("[lsz]$")), _without(s, 1)).when((measure(s) == 1) & _short(s), e).otherwise(s)
        return F.when(F.endswith(w, F.lit("+")), fixed).otherwise(w)

    def last_y(w: Column) -> Column:
        return F.when(F.endswith(w, F.lit("y")) & _vowel(_without(w, 1)), F.concat(_without(w, 1), F.lit("i"))).otherwise(w)

    def fourth(w: Column) -> Column:
        cut = lambda s: _without(w, len(s))
        return _longest(w, [(s, (measure(cut(s)) > 1) & (F.regexp_like(cut(s), F.lit("[st]$")) if s == "ion" else F.lit(True)), cut(s)) for s in STEP_4])

    def last_e(w: Column) -> Column:
        s = _without(w, 1)
        m = measure(s)
        return F.when(F.endswith(w, F.lit("e")) & ((m > 1) | ((m == 1) & ~_short(s))), s).otherwise(w)

    def last_l(w: Column) -> Column:
        return F.when(F.endswith(w, F.lit("ll")) & (measure(_without(w, 1)) > 1), _without(w, 1)).otherwise(w)

    return [plural, past, mended, last_y, lambda w: _replaced(w, STEP_2, 0), lambda w: _replaced(w, STEP_3, 0), fourth, last_e, last_l]


def stems(df: DataFrame, word: str, out: str) -> DataFrame:
    """df with the stem of the column `word`. Give distinct words where a table repeats them."""
    plain = F.regexp_like(F.lower(word), F.lit("^[a-z]{3,}$"))
    got = df.withColumn("__w", F.lower(word))
    for step in _steps():
        # a step reads the word many times, so it must not be folded into the next
        got = got.withColumn("__w", step(F.col("__w")))
    return got.withColumn(out, F.when(plain, F.col("__w")).otherwise(F.lower(word))).drop("__w")
