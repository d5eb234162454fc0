"""Text normalisation, label resolution and answer scores as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that an answer may begin with, each taken off once and in this order; words and phrases that
#: negate what follows them in a clause; words that end a clause.
ANSWER_PREFIXES = ("label", "sentiment", "answer", "the sentiment is", "it is")
NEGATORS = (
    "not", "no", "never", "non", "neither", "nor", "without",
    "isn't", "isnt", "wasn't", "wasnt", "aren't", "arent",
    "cannot", "can't", "cant", "don't", "dont", "doesn't", "doesnt",
    "rather than", "instead of", "other than", "unlike", "besides",
)
CONTRAST = ("but", "though", "however", "although", "whereas", "yet")


def quoted(text: Column) -> Column:
    """A pattern that matches the text as it stands."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def normalize_label(text: Column) -> Column:
    return F.lower(F.trim(text))


def row_text(*columns: str, sep: str = "\n") -> Column:
    """Columns joined with sep, null counting as empty."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def undecorate(text: Column) -> Column:
    """Lower case without * ` \" ' . : ; and with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[*`\"'.:;]", " "), r"\s+", " "))


def normalize_answer(text: Column) -> Column:
    """Undecorated, without leading words such as `answer`."""
    out = undecorate(text)
    for prefix in ANSWER_PREFIXES:
        out = F.trim(F.regexp_replace(out, rf"^(the )?{prefix}( is)?(?!\w)\s*", ""))
    return out


def normalize_qa(text: Column) -> Column:
    """Lower case without punctuation and articles, single blanks."""
    t = F.regexp_replace(F.lower(text), r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the)\b", " "), r"\s+", " "))


def mentions(text: Column, label: Column) -> Column:
    """Whether label stands in text, bounded by other than word characters."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<!\w)"), quoted(F.lower(label)), F.lit(r"(?!\w)")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?;\n]"), lambda s: F.trim(s)), lambda s: s != "")


def negated(text: Column, label: Column) -> Column:
    """Whether label is mentioned and each mention has a negator before it in its clause."""
    clauses = F.split(F.lower(text), rf"[.!?;:,\n]|\b({'|'.join(CONTRAST)})\b")
    held = F.filter(clauses, lambda c: mentions(c, label))
    before = F.concat(F.lit(rf"(?<![\w'])({'|'.join(NEGATORS)})(?![\w']).*(?<!\w)"), quoted(F.lower(label)), F.lit(r"(?!\w)"))
    return (F.size(held) > 0) & F.forall(held, lambda c: F.regexp_like(c, before))


def _resolvable(raw: Column, labels: list[str]) -> Column:
    """Whether raw can resolve to a label at all: undecorated, with or without prefixes, it ends as some label does. One
    search of a fixed pattern, for texts of which few are labels."""
    last = [F.element_at(F.split(undecorate(F.lit(x)), " "), -1) for x in labels]
    return F.regexp_like(F.lower(raw), F.concat(F.lit("(?:"), F.concat_ws("|", *[quoted(x) for x in last]), F.lit(r")[\s*`\"'.:;]*$")))


def resolve(raw: Column, labels: list[str]) -> Column:
    """The label that raw names: as it stands, else in any case, else undecorated, else without prefixes; null if
    none or more than one does. Each form of raw is made once, whatever the number of labels, and only where it may count."""

    def only(form: Column, of: Callable[[Column], Column]) -> Column:
        every = F.array(*[F.struct(of(F.lit(x)).alias("form"), F.lit(x).alias("label")) for x in labels])  # constant
        return F.element_at(F.transform(F.array(form), lambda f: _single(F.filter(every, lambda e: e["form"] == f))), 1)["label"]

    return F.when(_resolvable(raw, labels), F.coalesce(
        only(raw, lambda x: x),
        only(F.lower(F.trim(raw)), F.lower),
        only(undecorate(raw), undecorate),
        only(normalize_answer(raw), undecorate),
    ))


def _single(found: Column) -> Column:
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def score_prediction(gold: Column, raw: Column, labels: list[str]) -> Column:
    """1 if raw resolves to gold, or else mentions, not negated, gold alone; otherwise 0."""
    # one constant pattern a label, searched for only in texts that hold the label's letters
    held = lambda x: F.contains(F.lower(raw), F.lower(F.lit(x))) & mentions(raw, F.lit(x)) & ~negated(raw, F.lit(x))
    named = F.filter(F.array(*[F.when(held(x), F.lit(x)) for x in labels]), lambda x: x.isNotNull())
    return F.coalesce((F.coalesce(resolve(raw, labels), _single(named)) == gold).cast("int"), F.lit(0))


def lenient_label(raw: Column, labels: list[str]) -> Column:
    """The label mentioned first; of those at one place the longest. Null if none is."""
    every = F.array(*[F.lit(label) for label in labels])
    found = F.transform(F.filter(every, lambda x: mentions(raw, x)), lambda x: F.struct(F.regexp_instr(F.lower(raw), F.concat(F.lit(r"(?<!\w)"), quoted(F.lower(x)), F.lit(r"(?!\w)"))).alias("at"), (-F.length(x)).alias("n"), x.alias("label")))
    return F.array_min(found)["label"]


def fields_equal(a: Column, b: Column) -> Column:
    """Equal as they stand, as digit strings of dates (six digits at least), as numbers, or as normalised text."""
    da, db = F.regexp_replace(a, r"\D", ""), F.regexp_replace(b, r"\D", "")
    shape = r"^[\d\s/.\-]+$"
    dates = F.regexp_like(a, F.lit(shape)) & F.regexp_like(b, F.lit(shape)) & (F.length(da) >= 6) & (da == db)
    plain = [F.regexp_replace(x, r"[,$ ]", "").try_cast("double") for x in (a, b)]
    return F.coalesce((a == b) | dates | F.coalesce(plain[0] == plain[1], F.lit(False)) | (normalize_qa(a) == normalize_qa(b)), F.lit(False))


def valid_json(raw: Column, required: list[str]) -> Column:
    """Whether raw holds an object, from the first { to the last }, with the required keys."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "map<string,string>")
    held = F.lit(True)
    for key in required:
        held = held & F.coalesce(F.map_contains_key(parsed, key), F.lit(False))
    return parsed.isNotNull() & held


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the multisets of normalised tokens; 1 if both are empty."""
    a, b = tokens(normalize_qa(pred)), tokens(normalize_qa(gold))
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    common = F.aggregate(F.transform(F.array_distinct(a), lambda w: F.least(times(a, w), times(b, w))), F.lit(0), lambda s, x: s + x)
    p, r = common / F.size(a), common / F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).when(common == 0, 0.0).otherwise(2 * p * r / (p + r))
