"""Dialogue turns: templates, delexicalised text, slots, the gate that answers or escalates, scores of what was said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.operators import similar as sim
from gatewright.functions import text as t
from gatewright.llm.embedding_dedup import link_vectors


def dedup_form(text: Column) -> Column:
    """Lower case, single blanks, none before punctuation, without a full stop or exclamation mark at the end."""
    out = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r"\s+([,.!?;:])", "$1")
    return F.regexp_replace(out, r"[.!]+$", "")


def plain_form(text: Column) -> Column:
    """Compatibility letters folded as far as Spark's functions do (full-width ASCII, no-break blanks), lower case, other
    than letters and digits as single blanks."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    folded = F.translate(F.translate(text, wide, "".join(chr(0x21 + i) for i in range(94))), " 　", "  ")
    return F.trim(F.regexp_replace(F.lower(folded), r"[^\p{L}\p{N}]+", " "))


def slots(text: Column) -> Column:
    """Distinct {slot} names in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{([A-Za-z_]+)\}"), F.lit(1)))


def delexicalise(text: Column, values: Column, shapes: list[tuple[str, str]]) -> Column:
    """Known values (array of structs slot, value; longest first, ties by slot) and then shapes (slot, pattern) as {slot}."""
    ordered = F.array_sort(values, lambda a, b: F.when(F.length(a["value"]) > F.length(b["value"]), -1).when(F.length(a["value"]) < F.length(b["value"]), 1).when(a["slot"] < b["slot"], -1).when(a["slot"] > b["slot"], 1).otherwise(0))
    out = F.aggregate(ordered, text, lambda s, v: F.regexp_replace(s, F.concat(F.lit(r"(?<![\p{L}\p{N}{])"), t.quoted(v["value"]), F.lit(r"(?![\p{L}\p{N}}])")), F.concat(F.lit("{"), v["slot"], F.lit("}"))))
    for slot, pattern in shapes:
        out = F.regexp_replace(out, pattern, "{" + slot + "}")
    return out


def fill(template: Column, values: Column) -> tuple[Column, Column]:
    """A template with its {slot}s replaced from the map values, null if any is missing; and the missing slots in order."""
    missing = F.filter(slots(template), lambda s: ~F.coalesce(F.map_contains_key(values, s), F.lit(False)))
    filled = F.aggregate(F.map_entries(values), template, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return F.when(F.size(missing) == 0, filled), missing


def requested(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """Fields whose phrase stands in text, the longest phrase first; a phrase is consumed once it has matched."""
    ordered = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(f).alias("f")) for p, f in sorted(phrases, key=lambda x: (-len(x[0]), x[0]))])
    start = F.struct(F.lower(text).alias("rest"), F.array().cast("array<string>").alias("found"))
    step = lambda s, x: F.when(F.contains(s["rest"], x["p"]), F.struct(F.replace(s["rest"], x["p"], F.lit(" ")).alias("rest"), F.concat(s["found"], F.array(x["f"])).alias("found"))).otherwise(s)
    return F.array_sort(F.array_distinct(F.aggregate(ordered, start, step, lambda s: s["found"])))


def merged_templates(df: DataFrame, by: list[str], text: str, example: str, most: int) -> DataFrame:
    """Texts with the same form merged per group: canonical text (most frequent, then alphabetical), count, forms and the
    first example ids."""
    forms = df.withColumn("form", dedup_form(F.col(text))).groupBy(*by, "form", text).agg(F.count("*").alias("n"))
    best = forms.groupBy(*by, "form").agg(F.min(F.struct((-F.col("n")).alias("n"), text)).alias("x"), F.sum("n").alias("n"), F.count("*").alias("forms"))
    keys = [*by, "form"]
    ranked = df.withColumn("form", dedup_form(F.col(text))).select(*keys, example).distinct().withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(example))).where(F.col("__k") <= most)
    shown = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return best.join(shown, keys).select(*by, F.col(f"x.{text}").alias("canonical"), "n", "forms", "examples")


def clusters(df: DataFrame, key: str, vector: str, group: str, least: float, digits: int = 9) -> DataFrame:
    """Single-linkage clusters within groups: pairs of one group with a cosine (rounded) of at least `least` are linked; a
    cluster's label is its smallest key. Vectors of a group are compared by blocks of bounded size, and a pair of blocks
    gives a spanning forest of its links, from which components are found in rounds."""
    linked = link_vectors(df, key, vector, least - 0.5 * 10.0**-digits, by=group)
    return linked.select(key, F.col("component_id").alias("label"))


def action_patterns(df: DataFrame, by: list[str], values: str) -> DataFrame:
    """Per group the modal number of values (ties: the smaller) and, per position below it, the modal slot (ties: the
    first by name); rows of another length don't vote for slots."""
    sizes = df.withColumn("arity", F.size(values)).groupBy(*by, "arity").agg(F.count("*").alias("n"))
    modal = sizes.groupBy(*by).agg(F.max(F.struct("n", (-F.col("arity")).alias("a"))).alias("x")).select(*by, (-F.col("x.a")).alias("arity"))
    cells = df.join(modal, by).where(F.size(values) == F.col("arity")).select(*by, "arity", F.posexplode(values).alias("position", "slot")).groupBy(*by, "arity", "position", "slot").agg(F.count("*").alias("n"))
    return cells.groupBy(*by, "arity", "position").agg(F.min(F.struct((-F.col("n")).alias("n"), "slot")).alias("x")).select(*by, "arity", "position", "x.slot")


def gate(set_size: Column, novelty: Column, missing: Column, unseen: Column, most_novel: float) -> Column:
    """`reflex`, or why a turn escalates; the first reason counts: ambiguous set, novel context, missing slots, unseen
    action. What is unknown (null) escalates as the reason it belongs to."""
    return F.when(F.coalesce(set_size != 1, F.lit(True)), "ambiguous").when(F.coalesce(novelty > most_novel, F.lit(True)), "novel").when(F.coalesce(F.size(missing) > 0, F.lit(True)), "missing_slots").when(F.coalesce(unseen, F.lit(True)), "unseen_action").otherwise("reflex")


def verdict(checks: list[tuple[Column, Column]]) -> Column:
    """PASS if all criteria (measured, bar) hold, STOP if one fails, PARTIAL if one isn't measured and none fails."""
    failed, unknown = F.lit(False), F.lit(False)
    for measured, bar in checks:
        failed = failed | F.coalesce(measured < bar, F.lit(False))
        unknown = unknown | measured.isNull()
    return F.when(failed, "STOP").when(unknown, "PARTIAL").otherwise("PASS")


def confidence_set(proba: Column, q: Column, conformal: bool) -> Column:
    """Classes with 1 - p <= q, or with p >= q."""
    keep = (lambda p: 1 - p <= q + 1e-12) if conformal else (lambda p: p >= q)
    return F.filter(F.transform(proba, lambda p, i: F.when(keep(p), i)), lambda i: i.isNotNull())


def grams(text: Column) -> Column:
    """Word unigrams and bigrams of the plain form."""
    words = F.filter(F.split(plain_form(text), " "), lambda w: w != "")
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def lexical_cosine(left: DataFrame, right: DataFrame, a: str, b: str, text: str, least: float) -> DataFrame:
    """Pairs of texts whose gram counts have a cosine of at least `least`: candidates share a rare gram."""
    return sim.cosine_pairs(sim.gram_weights(left, a, grams(F.col(text))), sim.gram_weights(right, b, grams(F.col(text))), a, b, least)


def map_to_candidate(texts: DataFrame, candidates: DataFrame, key: str, rank: str, text: str, digits: int = 9) -> DataFrame:
    """Per text the candidate it says: the lowest rank of equal dedup form; else the highest lexical cosine (ties: the lowest
    rank); -1 for empty texts and those that share no gram."""
    form = texts.select(key, dedup_form(F.col(text)).alias("form"))
    exact = form.where("form <> ''").join(candidates.select(F.col(rank).alias("__r"), dedup_form(F.col(text)).alias("form")), "form").groupBy(key).agg(F.min("__r").alias("exact"))
    open_ = texts.join(exact, key, "left_anti")
    best = sim.nearest(sim.gram_weights(open_, key, grams(F.col(text))), sim.gram_weights(candidates, rank, grams(F.col(text))), key, rank, digits)
    near = best.select(key, F.col(rank).alias("near"))
    return texts.select(key).join(exact, key, "left").join(near, key, "left").select(key, F.coalesce("exact", "near", F.lit(-1)).alias("candidate"))


def parse_answer(raw: Column, actions: list[str]) -> Column:
    """The answer's fields from strict JSON (code fences allowed): step, action, index, slots, text. Null unless all five
    are there, the step is known, an action of the ontology is named exactly if the step is take_action, and the index is
    -1 unless the step is retrieve_utterance."""
    body = F.regexp_replace(F.trim(raw), r"(?s)^```(?:json)?\s*|\s*```$", "")
    keys = F.json_object_keys(body)
    j = F.from_json(body, "step string, action string, index int, slots array<string>, text string")
    complete = F.coalesce(F.size(F.array_except(F.array(*[F.lit(k) for k in ("step", "action", "index", "slots", "text")]), keys)) == 0, F.lit(False))
    steps = ("respond", "take_action", "retrieve_utterance")
    named = F.coalesce(j["action"].isin(*actions), F.lit(False))
    legal = j["step"].isin(*steps) & (named == (j["step"] == "take_action")) & ((j["step"] == "retrieve_utterance") | (j["index"] == -1)) & j["slots"].isNotNull()
    return F.when(complete & F.coalesce(legal, F.lit(False)), j)


def slot_values(sources: list[Column]) -> Column:
    """One value per slot from maps in order of priority."""
    out = sources[-1]
    for m in reversed(sources[:-1]):
        out = _over(m, out)
    return out


def _over(first: Column, other: Column) -> Column:
    return F.map_concat(F.map_filter(other, lambda k, _v: ~F.map_contains_key(first, k)), first)


def longest_term(text: Column, terms: list[str]) -> tuple[Column, Column]:
    """The longest of the terms that text contains (ties: alphabetical) and how many it contains."""
    held = F.filter(F.array(*[F.lit(x) for x in terms]), lambda x: F.contains(F.lower(text), x))
    best = F.array_min(F.transform(held, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"]
    return best, F.size(held)


def sentences_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, position and sentence: whole texts cut at sentence ends, line ends and semicolons."""
    return df.select(key, F.posexplode(t.sentences(F.col(text))).alias("position", "sentence"))


def clause_pick(df: DataFrame, key: str, text: str, terms: list[str], most: int, room: int) -> DataFrame:
    """Per text the sentences that match terms, by matches (then place), as long as they are at most `most` and their
    characters fit in `room`; given in the order of the text. A sentence that doesn't fit is passed over."""
    words = F.array(*[F.lit(x) for x in terms])
    s = sentences_of(df, key, text).withColumn("score", F.size(F.filter(words, lambda w: t.mentions(F.col("sentence"), w)))).where("score > 0")
    first = s.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "position"))).where(F.col("__k") <= most * 4)
    held = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__k", "position", "sentence"))).alias("x"))  # most * 4 sentences at most
    start = F.struct(F.lit(0).alias("chars"), F.array().cast("array<struct<position:int,sentence:string>>").alias("got"))
    step = lambda a, e: F.when((F.size(a["got"]) < most) & (a["chars"] + F.length(e["sentence"]) <= room), F.struct((a["chars"] + F.length(e["sentence"])).alias("chars"), F.concat(a["got"], F.array(F.struct(e["position"].alias("position"), e["sentence"].alias("sentence")))).alias("got"))).otherwise(a)
    picked = held.select(key, F.sort_array(F.aggregate("x", start, step, lambda a: a["got"])).alias("got"))
    return picked.select(key, F.transform("got", lambda e: e["position"]).alias("positions"))


def phrase_hits(df: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """Whole-word occurrences of every phrase in one pass over a text: key, phrase, n."""
    pattern = r"(?<![\p{L}\p{N}])(" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + r")(?![\p{L}\p{N}])"
    hits = df.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(1))).alias("phrase"))
    return hits.groupBy(key, "phrase").agg(F.count("*").alias("n"))


def all_in_one_sentence(df: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """key and position of the sentences that hold every word."""
    s = sentences_of(df, key, text)
    held = F.lit(True)
    for w in words:
        held = held & t.mentions(F.col("sentence"), F.lit(w))
    return s.where(held).select(key, "position")

