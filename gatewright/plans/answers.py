"""Labels and scores read out of real texts: words, runs of words and snippets of documents stand for raw answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.functions import answers as an
from gatewright.functions import text as t
from gatewright.plans.base import Plans
from gatewright.sources.fixtures import table

plans = Plans()

LABELS = ["the", "of", "and", "that", "de"]
_IN = "(" + ", ".join(f"'{x}'" for x in LABELS) + ")"

#: A snippet: up to thirty characters of a sentence, with the mark that ends it.
_SNIPPET = r"[^.!?;\n]{1,30}[.!?;]?"
SNIPPETS_SQL = f"sn AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SNIPPET}')) AS raw FROM documents)"
WORDS_SQL = r"""ws AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n]'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
rw AS (SELECT doc_id, unnest(w) AS raw FROM ws UNION ALL SELECT doc_id, array_to_string(w[i:i + 2], ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM ws))"""


def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_SNIPPET})"))).alias("raw"))


def said(spark, d):
    """Every word as it stands, marks and all, and every run of three."""
    w = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.filter(F.split("text", "[ \n]"), lambda x: x != "").alias("w"))
    runs = w.where("size(w) > 2").select("doc_id", F.explode(F.expr("transform(sequence(1, size(w) - 2), i -> array_join(slice(w, i, 3), ' '))")).alias("raw"))
    return w.select("doc_id", F.explode("w").alias("raw")).unionByName(runs)


_PLAIN = r"""trim(regexp_replace(regexp_replace(lower(raw), '[*`"''.:;]', ' ', 'g'), '\s+', ' ', 'g'))"""
_NORMAL = _PLAIN
for _p in t.ANSWER_PREFIXES:
    _NORMAL = rf"trim(regexp_replace({_NORMAL}, '^(the )?{_p}( is)?(?:\s+|$|([^\w\s]))', '\3'))"
_RESOLVED = f"CASE WHEN raw IN {_IN} THEN raw WHEN lower(trim(raw)) IN {_IN} THEN lower(trim(raw)) WHEN {_PLAIN} IN {_IN} THEN {_PLAIN} WHEN {_NORMAL} IN {_IN} THEN {_NORMAL} END"


@plans.add("q046_resolve_words", f"WITH {WORDS_SQL} SELECT label, count(*) AS n, count(DISTINCT raw) AS forms FROM (SELECT raw, {_RESOLVED} AS label FROM rw) WHERE label IS NOT NULL GROUP BY label")
def resolve_words(spark, d):
    """Which label each word or run of three names, by any of the four stages, and in how many spellings."""
    x = said(spark, d).select("raw", t.resolve(F.col("raw"), LABELS).alias("label")).where("label IS NOT NULL")  # before the shuffle: few are labels
    return x.groupBy("label", "raw").agg(F.count("*").alias("c")).groupBy("label").agg(F.sum("c").alias("n"), F.count("*").alias("forms"))


@plans.add("q053_exact_words", f"WITH {WORDS_SQL} SELECT doc_id, lower(trim(raw)) AS pred, count(*) AS n FROM rw WHERE lower(trim(raw)) IN {_IN} GROUP BY ALL")
def exact_words(spark, d):
    x = said(spark, d).select("doc_id", an.exact_parse(F.col("raw"), LABELS).alias("pred"))
    return x.where("pred IS NOT NULL").groupBy("doc_id", "pred").agg(F.count("*").alias("n"))


_FIRST = rf"list_filter(regexp_extract_all(lower(raw), '\w+'), lambda x: x IN {_IN})[1]"


@plans.add("q051_lenient_snippets", f"WITH {SNIPPETS_SQL} SELECT doc_id, label, count(*) AS n FROM (SELECT doc_id, {_FIRST} AS label FROM sn) GROUP BY ALL")
def lenient_snippets(spark, d):
    """The label that each snippet mentions first; null where it mentions none."""
    return snippets(spark, d).groupBy("doc_id", t.lenient_label(F.col("raw"), LABELS).alias("label")).agg(F.count("*").alias("n"))


@plans.add("q052_lenient_snippet_columns", f"WITH {SNIPPETS_SQL} SELECT doc_id, count(*) AS n, avg(({_FIRST} IS NOT NULL)::INT::DOUBLE) AS parsed, avg(coalesce({_FIRST} = 'the', false)::INT::DOUBLE) AS right_share FROM sn GROUP BY doc_id")
def lenient_snippet_columns(spark, d):
    pred = t.lenient_label(F.col("raw"), LABELS)
    x = snippets(spark, d).select("doc_id", pred.alias("pred_lenient"), pred.isNotNull().cast("int").alias("parse_ok_lenient"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("parse_ok_lenient").alias("parsed"), F.avg(F.coalesce(F.col("pred_lenient") == "the", F.lit(False)).cast("int")).alias("right_share"))


_NEG = "|".join(n.replace("'", "''") for n in t.NEGATORS)
_CONTRAST = "|".join(t.CONTRAST)
_NAMED = rf"""id AS (SELECT row_number() OVER () AS k, doc_id, raw FROM sn), la AS (SELECT unnest({LABELS}) AS label),
cl AS (SELECT k, unnest(regexp_split_to_array(lower(raw), '[.!?;:,\n]|(?:^|[^\p{{L}}\p{{N}}_])(?:{_CONTRAST})(?:[^\p{{L}}\p{{N}}_]|$)')) AS c FROM id),
he AS (SELECT k, label, count(*) AS n, count(CASE WHEN regexp_matches(c, '(^|[^\w''])(?:{_NEG})(?:[^\w'']|[^\w''].*\W)' || label || '(\W|$)') THEN 1 END) AS neg FROM cl JOIN la ON list_contains(regexp_extract_all(c, '\w+'), label) GROUP BY k, label)"""


@plans.add("q048_negated_snippets", f"WITH {SNIPPETS_SQL}, {_NAMED} SELECT label, count(*) AS mentioned, count(CASE WHEN neg = n THEN 1 END) AS negated FROM he GROUP BY label")
def negated_snippets(spark, d):
    """How many snippets mention each label, and in how many a negator stands before each mention in its clause."""
    x = snippets(spark, d).select("raw", F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("label")).where(t.mentions(F.col("raw"), F.col("label")))
    return x.groupBy("label").agg(F.count("*").alias("mentioned"), F.count_if(t.negated(F.col("raw"), F.col("label"))).alias("negated"))


@plans.add("q050_scored_snippets", f"""WITH {SNIPPETS_SQL}, {_NAMED}, one AS (SELECT k, any_value(label) AS label FROM he WHERE neg < n GROUP BY k HAVING count(*) = 1)
SELECT doc_id, count(*) AS n, avg(coalesce(coalesce({_RESOLVED}, label) = 'the', false)::INT::DOUBLE) AS score FROM id LEFT JOIN one USING (k) GROUP BY doc_id""")
def scored_snippets(spark, d):
    """Each document's snippets scored as answers against the label `the`."""
    return snippets(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(t.score_prediction(F.lit("the"), F.col("raw"), LABELS)).alias("score"))


@plans.add("q056_event_fields", r"""WITH f AS (SELECT event_type, round(value)::BIGINT::VARCHAR AS a, '$' || value::VARCHAR AS b FROM events UNION ALL
  SELECT event_type, strftime(ts, '%Y-%m-%d'), strftime(ts + to_days((event_id % 3)::INT), '%Y/%m/%d') FROM events UNION ALL SELECT event_type, event_type, upper(event_type) || '!' FROM events)
SELECT event_type, count(*) AS n, avg((CASE WHEN a = b THEN 1 WHEN regexp_full_match(a, '[\d\s/.\-]+') AND regexp_full_match(b, '[\d\s/.\-]+') AND len(regexp_replace(a, '\D', '', 'g')) >= 6 AND regexp_replace(a, '\D', '', 'g') = regexp_replace(b, '\D', '', 'g') THEN 1
  WHEN TRY_CAST(regexp_replace(a, '[,$ ]', '', 'g') AS DOUBLE) = TRY_CAST(regexp_replace(b, '[,$ ]', '', 'g') AS DOUBLE) THEN 1 WHEN lower(regexp_replace(a, '[!$/.\-]', '', 'g')) = lower(regexp_replace(b, '[!$/.\-]', '', 'g')) THEN 1 ELSE 0 END)::DOUBLE) AS equal_share FROM f GROUP BY event_type""")
def event_fields(spark, d):
    """Numbers, dates and names of events in two spellings, compared as fields."""
    e = table(spark, d, "events")
    later = F.date_format(F.col("ts") + F.make_dt_interval((F.col("event_id") % 3).cast("int")), "yyyy/MM/dd")
    pairs = [(F.round("value").cast("long").cast("string"), F.concat(F.lit("$"), F.col("value").cast("string"))), (F.date_format("ts", "yyyy-MM-dd"), later), (F.col("event_type"), F.concat(F.upper("event_type"), F.lit("!")))]
    x = e.select("event_type", F.inline(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs])))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.avg(t.fields_equal(F.col("a"), F.col("b")).cast("int")).alias("equal_share"))
