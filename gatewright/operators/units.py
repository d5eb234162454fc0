"""Units of documents: packed sentences, clauses under their headings, typed spans, parties, concepts, what a reader is
shown. Texts are cut by expressions over a row's own arrays; what carries from one sentence to the next is a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.functions import text as t
from gatewright.operators.vectors import dot

#: Typed spans; of overlapping ones the leftmost, of those that begin together the first listed.
SPANS = {"money": r"[$€£] ?[0-9][0-9,]*(?:\.[0-9]+)?", "percent": r"[0-9]+(?:\.[0-9]+)? ?%", "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "number": r"[0-9]+"}
#: Role words of parties.
ROLES = ("tenant", "landlord", "buyer", "seller", "licensor", "licensee")


def masked_sentences(text: Column) -> Column:
    """Sentences by their ends, none of them inside a {marker}."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?![^{}]*\})"), lambda s: s != "")


def pack_units(parts: Column, least: int, most: int) -> Column:
    """Parts joined by blanks into units: a unit is closed when it has `least` characters, or when the next part would
    carry it over `most`. What is left at the end and shorter than `least` goes to the last unit."""
    start = F.struct(F.array().cast("array<string>").alias("units"), F.lit("").alias("cur"))

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit(" "), p))
        over = (s["cur"] != "") & (F.length(joined) > most)
        units = F.when(over, F.concat(s["units"], F.array(s["cur"]))).otherwise(s["units"])
        cur = F.when(over, p).otherwise(joined)
        full = F.length(cur) >= least
        return F.struct(F.when(full, F.concat(units, F.array(cur))).otherwise(units).alias("units"), F.when(full, F.lit("")).otherwise(cur).alias("cur"))

    def close(s: Column) -> Column:
        n = F.size(s["units"])
        grown = F.concat(F.slice(s["units"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(s["units"], -1), F.lit(" "), s["cur"])))
        return F.when(s["cur"] == "", s["units"]).when(n == 0, F.array(s["cur"])).otherwise(grown)

    return F.aggregate(parts, start, step, close)


def clause_units(text: Column) -> Column:
    """Lines cut at semicolons; a heading (a line of at most 40 characters that ends in a colon) stands before each clause
    of the next line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("units"), F.lit("").alias("head"))

    def step(s: Column, line: Column) -> Column:
        heading = F.endswith(line, F.lit(":")) & (F.length(line) <= 40)
        parts = F.transform(F.filter(F.transform(F.split(line, ";"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.when(s["head"] == "", x).otherwise(F.concat(s["head"], F.lit(" "), x)))
        return F.struct(F.when(heading, s["units"]).otherwise(F.concat(s["units"], parts)).alias("units"), F.when(heading, line).otherwise(F.lit("")).alias("head"))

    return F.aggregate(lines, start, step, lambda s: s["units"])


def spans(text: Column) -> Column:
    """Typed spans in order, as an array of structs type, value."""
    pattern = "|".join(SPANS.values())
    kind = lambda v: F.coalesce(*[F.when(F.regexp_like(v, F.lit(f"^(?:{p})$")), F.lit(n)) for n, p in SPANS.items()])
    return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda v: F.struct(kind(v).alias("type"), v.alias("value")))


def parties(text: Column) -> Column:
    """Role words in the order of their first mention."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(ROLES) + r")s?\b"), F.lit(1)))


def concepts(text: Column, phrases: dict[str, str]) -> Column:
    """Concepts of the phrases in a text from left to right, at each place the longest phrase; `neutral` ones dropped."""
    pattern = r"\b(" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + r")\b"
    of = F.create_map(*[F.lit(x) for p, c in sorted(phrases.items()) for x in (p, c)])
    return F.filter(F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), lambda p: F.element_at(of, p)), lambda c: c != "neutral")


def committee(members: dict[str, DataFrame], item: str, pred: str) -> DataFrame:
    """One column per member, for the items that all of them have; each item once a member."""
    long: DataFrame | None = None
    for name, df in members.items():
        one = df.select(F.col(item), F.lit(name).alias("__m"), F.col(pred).alias("__p"))
        long = one if long is None else long.unionByName(one)
    wide = long.groupBy(item).pivot("__m", list(members)).agg(F.first("__p"))
    return wide.dropna(subset=list(members))


def reader_pick(units: DataFrame, terms: list[str], doc: str, unit: str, text: str, vector: str, query: list[float], k_words: int, k_vector: int, digits: int = 9) -> DataFrame:
    """Per document the units with the most terms (k_words of them, those with none left out), then the nearest to the query
    by dot product that aren't among them (k_vector); ties to the lower unit."""
    words = F.array(*[F.lit(x) for x in terms])
    q = F.array(*[F.lit(float(x)) for x in query])
    x = units.withColumn("hits", F.size(F.filter(words, lambda w: t.mentions(F.col(text), w)))).withColumn("near", F.round(dot(vector, q), digits))
    first = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("hits"), unit))
    lexical = x.withColumn("k", first).where((F.col("k") <= k_words) & (F.col("hits") > 0)).select(doc, unit, F.lit("words").alias("by"))
    rest = x.join(lexical.select(doc, unit), [doc, unit], "left_anti")
    near = rest.withColumn("k", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("near"), unit))).where(F.col("k") <= k_vector).select(doc, unit, F.lit("vector").alias("by"))
    return lexical.unionByName(near)
