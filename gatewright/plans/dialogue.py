"""Queries on dialogue: templates and slots, the gate, what was said against what should be, probe rows and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatewright.functions import text as t
from gatewright.operators import dialogue as dl
from gatewright.operators import sequence as s
from gatewright.operators import vectors as v
from gatewright.operators import sequence as sq
from gatewright.operators import similar as sim
from gatewright.plans.base import Plans
from gatewright.sources.fixtures import TURNS_SQL, table, turns, u, u_sql

plans = Plans()
T = f"({TURNS_SQL})"

_FORM = r"regexp_replace(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '\s+([,.!?;:])', '\1', 'g'), '[.!]+$', '')"
_PLAIN = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"


@plans.add("q058_plain_form", f"SELECT doc_id, md5({_PLAIN}) AS h FROM documents")
def plain_form(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(dl.plain_form(F.col("text"))).alias("h"))


@plans.add("q059_dedup_form", f"SELECT conv_id, turn, md5({_FORM}) AS h FROM conversations")
def dedup_form(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(dl.dedup_form(F.col("text"))).alias("h"))


@plans.add("q061_delexicalise", r"""SELECT c_custkey, regexp_replace(replace(replace('account ' || c_name || ' of segment ' || c_mktsegment || ' owes ' || c_custkey::VARCHAR || '-' || c_nationkey::VARCHAR, c_name, '{name}'), ' ' || c_mktsegment || ' ', ' {segment} '), '[0-9]+-[0-9]+', '{order_id}', 'g') AS delex FROM customer""")
def delexicalise(spark, d):
    """Known values of the customer and number shapes as slots."""
    said = F.concat(F.lit("account "), F.col("c_name"), F.lit(" of segment "), F.col("c_mktsegment"), F.lit(" owes "), F.col("c_custkey").cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"))
    values = F.array(F.struct(F.lit("segment").alias("slot"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("name").alias("slot"), F.col("c_name").alias("value")))
    return table(spark, d, "customer").select("c_custkey", dl.delexicalise(said, values, [("order_id", r"\d+-\d+")]).alias("delex"))


_TEMPLATE = "CASE c_custkey % 3 WHEN 0 THEN 'Hello {name}, your segment is {segment}.' WHEN 1 THEN '{name} and {name} of {nation}' ELSE 'no slots, {missing} or {other}' END"


@plans.add("q062_slots", f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['name', 'segment'] WHEN 1 THEN ['name', 'nation'] ELSE ['missing', 'other'] END AS slots FROM customer")
def slots(spark, d):
    return table(spark, d, "customer").select("c_custkey", dl.slots(F.expr(_TEMPLATE)).alias("slots"))


@plans.add("q297_fill", f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Hello ' || c_name || ', your segment is ' || c_mktsegment || '.' WHEN 1 THEN c_name || ' and ' || c_name || ' of ' || c_nationkey::VARCHAR END AS said, CASE WHEN c_custkey % 3 = 2 THEN ['missing', 'other'] ELSE []::VARCHAR[] END AS missing FROM customer")
def fill(spark, d):
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    said, missing = dl.fill(F.expr(_TEMPLATE), values)
    return table(spark, d, "customer").select("c_custkey", said.alias("said"), missing.alias("missing"))


@plans.add("q340_compose", "SELECT c_custkey, 'Dear ' || c_name || '. Segment ' || c_mktsegment || '.' AS said FROM customer")
def compose(spark, d):
    """Templates filled in order and joined."""
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    parts = [dl.fill(F.lit(x), values)[0] for x in ("Dear {name}.", "Segment {segment}.")]
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", *parts).alias("said"))


@plans.add("q338_slot_sources", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'said' ELSE 'scenario' END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'acted' ELSE c_mktsegment END AS segment FROM customer")
def slot_sources(spark, d):
    """What the customer said before what an action gave before the scenario."""
    none = F.create_map().cast("map<string,string>")
    said = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("name"), F.lit("said"))).otherwise(none)
    acted = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("segment"), F.lit("acted"), F.lit("name"), F.lit("acted"))).otherwise(none)
    acted = F.when(F.col("c_custkey") % 2 == 0, acted).otherwise(F.map_filter(acted, lambda k, _v: k != "name"))
    scenario = F.create_map(F.lit("name"), F.lit("scenario"), F.lit("segment"), F.col("c_mktsegment"))
    m = dl.slot_values([said, acted, scenario])
    return table(spark, d, "customer").select("c_custkey", m["name"].alias("name"), m["segment"].alias("segment"))


@plans.add("q339_disclosed", "SELECT user_id, event_type AS slot, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def disclosed(spark, d):
    """One value per slot: the first that was disclosed."""
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("slot")).agg(F.min_by("value", "event_id").alias("value"))


@plans.add("q063_requested", "SELECT doc_id, list_sort(list_distinct(list_concat(list_concat(CASE WHEN contains(lower(text), 'the of') THEN ['pair'] ELSE []::VARCHAR[] END, CASE WHEN contains(replace(lower(text), 'the of', ' '), 'the') THEN ['article'] ELSE []::VARCHAR[] END), CASE WHEN contains(replace(replace(lower(text), 'the of', ' '), 'the', ' '), 'of') THEN ['preposition'] ELSE []::VARCHAR[] END))) AS fields FROM documents WHERE text IS NOT NULL")
def requested(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", dl.requested(F.col("text"), [("the", "article"), ("of", "preposition"), ("the of", "pair")]).alias("fields"))


@plans.add("q064_whole_token", r"SELECT c_custkey, regexp_matches('x ' || c_name || '1 of ' || c_mktsegment || '.', '(^|[^\p{L}\p{N}])' || c_mktsegment || '([^\p{L}\p{N}]|$)') AS held, false AS inner_part FROM customer")
def whole_token(spark, d):
    """A value within letters or digits doesn't count."""
    said = F.concat(F.lit("x "), F.col("c_name"), F.lit("1 of "), F.col("c_mktsegment"), F.lit("."))
    return table(spark, d, "customer").select("c_custkey", t.mentions(said, F.col("c_mktsegment")).alias("held"), t.mentions(said, F.col("c_name")).alias("inner_part"))


@plans.add("q065_flatten", "SELECT c_custkey, unnest(['customer.name', 'customer.place.nation', 'segment']) AS field, unnest([c_name, c_nationkey::VARCHAR, c_mktsegment]) AS value FROM customer")
def flatten(spark, d):
    """A nested scenario as (dotted field, value) rows."""
    scenario = F.struct(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").cast("string").alias("nation")).alias("place")).alias("customer"), F.col("c_mktsegment").alias("segment"))
    x = table(spark, d, "customer").select("c_custkey", scenario.alias("s"))
    leaves: list = []

    def walk(kind, path: str, name: str) -> None:
        for f in kind.fields:
            if f.dataType.typeName() == "struct":
                walk(f.dataType, f"{path}.{f.name}", f"{name}{f.name}.")
            else:
                leaves.append(F.struct(F.lit(name + f.name).alias("field"), F.col(f"{path}.{f.name}").alias("value")))

    walk(x.schema["s"].dataType, "s", "")
    return x.select("c_custkey", F.inline(F.array(*leaves)))


@plans.add("q066_prompt", "SELECT doc_id, md5('Classify.' || chr(10) || 'Text: ' || coalesce(text, '') || chr(10) || 'Label:') AS h FROM documents")
def prompt(spark, d):
    """A template with its text put in, behind an instruction."""
    body = F.replace(F.lit("Text: {{text}}\nLabel:"), F.lit("{{text}}"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("Classify.\n"), body)).alias("h"))


@plans.add("q067_stage_mask", f"SELECT conv_id, turn, 'p' || (act < 5)::INT || ' t' || (act % 2 = 0)::INT || ' j' || (role = 'user')::INT || ' r:' || act AS mask FROM {T}")
def stage_mask(spark, d):
    flag = lambda c: c.cast("int")
    return turns(spark, d).select("conv_id", "turn", F.format_string("p%d t%d j%d r:%s", flag(F.col("act") < 5), flag(F.col("act") % 2 == 0), flag(F.col("role") == "user"), F.col("act").cast("string")).alias("mask"))


_TERMS = ["the", "that", "with", "the of", "der"]
_T = "[" + ", ".join(f"'{x}'" for x in _TERMS) + "]"


@plans.add("q068_longest_term", f"SELECT doc_id, list_sort(list_transform(list_filter({_T}, lambda x: contains(lower(text), x)), lambda x: {{'n': -length(x), 'x': x}}))[1].x AS term, len(list_filter({_T}, lambda x: contains(lower(text), x)))::INT AS hits FROM documents WHERE text IS NOT NULL")
def longest_term(spark, d):
    """The longest vocabulary term in a text, and how many it holds."""
    best, hits = dl.longest_term(F.col("text"), _TERMS)
    return table(spark, d, "documents").where("text is not null").select("doc_id", best.alias("term"), hits.alias("hits"))


@plans.add("q119_derivation", f"WITH x AS (SELECT lang, len(list_filter({_T}, lambda x: contains(lower(coalesce(text, '')), x))) AS hits FROM documents) SELECT lang, count(CASE WHEN hits = 0 THEN 1 END) AS none, count(CASE WHEN hits = 1 THEN 1 END) AS one, count(CASE WHEN hits > 1 THEN 1 END) AS several FROM x GROUP BY 1")
def derivation(spark, d):
    hits = dl.longest_term(F.coalesce("text", F.lit("")), _TERMS)[1]
    return table(spark, d, "documents").withColumn("hits", hits).groupBy("lang").agg(F.count_if(F.col("hits") == 0).alias("none"), F.count_if(F.col("hits") == 1).alias("one"), F.count_if(F.col("hits") > 1).alias("several"))


@plans.add("q069_prompt_split", "SELECT doc_id, 'Does it rise?' AS instruction, coalesce(source, '') AS headline FROM documents")
def prompt_split(spark, d):
    q = F.concat(F.lit("Does it rise? Headline: "), F.coalesce("source", F.lit("")))
    pattern = r"^(.*?\?)\s*Headline:\s*(.*)$"
    return table(spark, d, "documents").select("doc_id", F.regexp_extract(q, pattern, 1).alias("instruction"), F.regexp_extract(q, pattern, 2).alias("headline"))


@plans.add("q080_template_lookup", f"WITH b AS (SELECT act, {_FORM} AS form, min(struct_pack(c := conv_id, t := turn)) AS first FROM {T} WHERE conv_id % 4 > 0 GROUP BY 1, 2) SELECT x.conv_id, x.turn, b.first.c AS template_conv, b.first.t AS template_turn FROM (SELECT *, {_FORM} AS form FROM {T} WHERE conv_id % 4 = 0) x LEFT JOIN b ON b.act = x.act AND b.form = x.form")
def template_lookup(spark, d):
    """A turn's template: the first training turn of its act with the same form."""
    x = turns(spark, d).withColumn("form", dl.dedup_form(F.col("text")))
    bank = x.where("conv_id % 4 > 0").groupBy("act", "form").agg(F.min(F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))).alias("first"))
    return x.where("conv_id % 4 = 0").join(bank, ["act", "form"], "left").select("conv_id", "turn", F.col("first.c").alias("template_conv"), F.col("first.t").alias("template_turn"))


@plans.add("q137_merged_templates", f"""WITH x AS (SELECT *, {_FORM} AS form FROM {T}), k AS (SELECT act, form, text, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT act, form, sum(n)::BIGINT AS n, count(*) AS forms FROM k GROUP BY 1, 2),
c AS (SELECT act, form, text AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY act, form ORDER BY n DESC, text) AS r FROM k) WHERE r = 1) SELECT act, canonical, n, forms, list_sort(list_distinct(ex))[1:3] AS examples FROM b JOIN c USING (act, form) JOIN (SELECT act, form, list(conv_id) AS ex FROM x GROUP BY 1, 2) USING (act, form)""")
def merged_templates(spark, d):
    """Texts of one form merged within an act."""
    return dl.merged_templates(turns(spark, d), ["act"], "text", "conv_id", 3)


@plans.add("q083_clusters", """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) >= 0.9),
s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT vec_id, vec_id AS reach FROM e UNION SELECT r.vec_id, s.b FROM r JOIN s ON s.a = r.reach) SELECT vec_id, min(reach) AS label FROM r GROUP BY 1""")
def clusters(spark, d):
    """Single-linkage clusters of vectors within a class."""
    return dl.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.9)


@plans.add("q140_action_patterns", f"""WITH x AS (SELECT conv_id, role, list(act::VARCHAR ORDER BY turn) AS a FROM {T} GROUP BY 1, 2), k AS (SELECT role, len(a) AS arity, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT role, arity FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, arity) AS r FROM k) WHERE r = 1),
c AS (SELECT x.role, m.arity, unnest(range(m.arity)) AS position, unnest(a) AS slot FROM x JOIN m ON m.role = x.role AND len(x.a) = m.arity), v AS (SELECT role, arity, position, slot, count(*) AS n FROM c GROUP BY ALL) SELECT role, arity::INT AS arity, position::INT AS position, slot FROM (SELECT *, row_number() OVER (PARTITION BY role, position ORDER BY n DESC, slot) AS r FROM v) WHERE r = 1""")
def action_patterns(spark, d):
    """Per role the usual number of acts in a conversation and the usual act at each place."""
    x = turns(spark, d).groupBy("conv_id", "role").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("act").cast("string").alias("a")))), lambda e: e["a"]).alias("acts"))
    return dl.action_patterns(x, ["role"], "acts")


_SCORES = f"""SELECT conv_id, turn, role, act, 1 + (({u_sql(201, 'conv_id', 'turn')}) < 0.3::DOUBLE)::INT AS set_size, CASE WHEN act = 7 THEN NULL ELSE {u_sql(202, 'conv_id', 'turn')} END AS novelty, CASE WHEN act = 3 THEN ['name'] ELSE []::VARCHAR[] END AS missing, act = 8 AS unseen FROM {T}"""
_GATE = f"""SELECT *, CASE WHEN set_size <> 1 THEN 'ambiguous' WHEN coalesce(novelty > 0.8::DOUBLE, true) THEN 'novel' WHEN len(missing) > 0 THEN 'missing_slots' WHEN unseen THEN 'unseen_action' ELSE 'reflex' END AS route FROM ({_SCORES})"""


def scores(spark, d):
    """Stand-ins for what the heads give per turn: size of the prediction set, novelty, missing slots, unseen action."""
    x = turns(spark, d).withColumn("set_size", 1 + (u(201, "conv_id", "turn") < 0.3).cast("int")).withColumn("novelty", F.when(F.col("act") != 7, u(202, "conv_id", "turn")))
    return x.withColumn("missing", F.when(F.col("act") == 3, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>"))).withColumn("unseen", F.col("act") == 8)


def gated(spark, d):
    return scores(spark, d).withColumn("route", dl.gate(F.col("set_size"), F.col("novelty"), F.col("missing"), F.col("unseen"), 0.8))


@plans.add("q276_gate", f"SELECT conv_id, turn, route FROM ({_GATE})")
def gate(spark, d):
    return gated(spark, d).select("conv_id", "turn", "route")


@plans.add("q282_decision_loop", f"SELECT conv_id, turn, CASE WHEN route = 'reflex' THEN 'act ' || act ELSE 'expensive' END AS answer, CASE WHEN route = 'reflex' THEN 0.0 ELSE 0.002 END::DOUBLE AS usd FROM ({_GATE})")
def decision_loop(spark, d):
    """Score, gate, then the filled answer or the expensive model, per turn."""
    reflex = F.col("route") == "reflex"
    return gated(spark, d).select("conv_id", "turn", F.when(reflex, F.concat(F.lit("act "), F.col("act").cast("string"))).otherwise("expensive").alias("answer"), F.when(reflex, 0.0).otherwise(0.002).alias("usd"))


_EVAL = f"""SELECT *, {u_sql(203, 'conv_id', 'turn')} < CASE WHEN route = 'reflex' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS right_answer FROM ({_GATE})"""


def evaluated(spark, d):
    return gated(spark, d).withColumn("right_answer", u(203, "conv_id", "turn") < F.when(F.col("route") == "reflex", 0.9).otherwise(0.7))


@plans.add("q123_fast_path", f"SELECT role, count(*) AS n, avg((NOT right_answer)::INT::DOUBLE) AS error FROM ({_EVAL}) WHERE route = 'reflex' GROUP BY 1")
def fast_path(spark, d):
    """Errors over the turns that were answered without the expensive model."""
    return evaluated(spark, d).where("route = 'reflex'").groupBy("role").agg(F.count("*").alias("n"), F.avg((~F.col("right_answer")).cast("double")).alias("error"))


@plans.add("q124_novelty_metrics", f"SELECT novelty > 0.5::DOUBLE AS is_novel, avg((route <> 'reflex')::INT::DOUBLE) AS escalated, avg(CASE WHEN route = 'reflex' THEN (NOT right_answer)::INT::DOUBLE END) AS error FROM ({_EVAL}) WHERE novelty IS NOT NULL GROUP BY 1")
def novelty_metrics(spark, d):
    x = evaluated(spark, d).where("novelty is not null").groupBy((F.col("novelty") > 0.5).alias("is_novel"))
    return x.agg(F.avg((F.col("route") != "reflex").cast("double")).alias("escalated"), F.avg(F.when(F.col("route") == "reflex", (~F.col("right_answer")).cast("double"))).alias("error"))


@plans.add("q126_parity", f"SELECT 100 * (avg(CASE WHEN route = 'reflex' THEN right_answer::INT::DOUBLE END) - avg(CASE WHEN route <> 'reflex' THEN right_answer::INT::DOUBLE END)) AS points FROM ({_EVAL})")
def parity(spark, d):
    """Difference of two arms' accuracies in points."""
    ok = F.col("right_answer").cast("double")
    return evaluated(spark, d).agg((100 * (F.avg(F.when(F.col("route") == "reflex", ok)) - F.avg(F.when(F.col("route") != "reflex", ok)))).alias("points"))


_RUN = f"""SELECT role, count(*) AS n, avg((route = 'reflex')::INT::DOUBLE) AS fast_rate, avg(right_answer::INT::DOUBLE) AS accuracy, avg(CASE WHEN route = 'reflex' THEN right_answer::INT::DOUBLE END) AS fast_accuracy, avg(CASE WHEN route = 'novel' THEN right_answer::INT::DOUBLE END) AS novel_accuracy, count(novelty) AS measured FROM ({_EVAL}) GROUP BY role"""


def run_metrics(spark, d):
    ok = F.col("right_answer").cast("double")
    return evaluated(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.avg((F.col("route") == "reflex").cast("double")).alias("fast_rate"), F.avg(ok).alias("accuracy"), F.avg(F.when(F.col("route") == "reflex", ok)).alias("fast_accuracy"), F.avg(F.when(F.col("route") == "novel", ok)).alias("novel_accuracy"), F.count("novelty").alias("measured"))


@plans.add("q324_run_evaluation", _RUN)
def run_evaluation(spark, d):
    """All metric families of a run in one pass."""
    return run_metrics(spark, d)


@plans.add("q325_run_verdict", f"WITH m AS ({_RUN}) SELECT role, CASE WHEN coalesce(accuracy < 0.6::DOUBLE, false) OR coalesce(fast_accuracy < 0.6::DOUBLE, false) THEN 'STOP' WHEN accuracy IS NULL OR fast_accuracy IS NULL OR (CASE WHEN measured = n THEN novel_accuracy END) IS NULL THEN 'PARTIAL' ELSE 'PASS' END AS verdict FROM m")
def run_verdict(spark, d):
    """A criterion that isn't measured on all turns is unknown, never a pass."""
    checks = [(F.col("accuracy"), F.lit(0.6)), (F.col("fast_accuracy"), F.lit(0.6)), (F.when(F.col("measured") == F.col("n"), F.col("novel_accuracy")), F.lit(0.0))]
    return run_metrics(spark, d).select("role", dl.verdict(checks).alias("verdict"))


@plans.add("q328_constant_guard", f"""WITH x AS {T}, b AS (SELECT role, act, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT role, act AS constant FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, act) AS k FROM b) WHERE k = 1), e AS (SELECT role, avg((({u_sql(204, 'conv_id', 'turn')}) < 0.2::DOUBLE)::INT::DOUBLE) AS system FROM x GROUP BY 1)
SELECT *, constant_score >= system AS dropped FROM (SELECT role, constant, system, avg((act = constant)::INT::DOUBLE) AS constant_score FROM x JOIN c USING (role) JOIN e USING (role) GROUP BY 1, 2, 3)""")
def constant_guard(spark, d):
    """A metric on which the constant answer is as good as the system is dropped."""
    x = turns(spark, d)
    counts = x.groupBy("role", "act").agg(F.count("*").alias("n"))
    const = counts.groupBy("role").agg(F.max_by("act", F.struct("n", -F.col("act"))).alias("constant"))
    e = x.groupBy("role").agg(F.avg((u(204, "conv_id", "turn") < 0.2).cast("double")).alias("system"))
    own = x.join(F.broadcast(const), "role").groupBy("role", "constant").agg(F.avg((F.col("act") == F.col("constant")).cast("double")).alias("constant_score"))  # one row a role
    return own.join(e, "role").withColumn("dropped", F.col("constant_score") >= F.col("system"))


@plans.add("q133_constant_verdict", f"SELECT role, CASE WHEN measured <= constant THEN 'DROP' WHEN measured - 1.96::DOUBLE * sqrt(measured * (1 - measured) / n) <= constant THEN 'UNSURE' ELSE 'KEEP' END AS verdict FROM (SELECT role, count(*) AS n, avg((act < 4)::INT::DOUBLE) AS measured, avg((act = 0)::INT::DOUBLE) AS constant FROM {T} GROUP BY 1)")
def constant_verdict(spark, d):
    k = turns(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.avg((F.col("act") < 4).cast("double")).alias("m"), F.avg((F.col("act") == 0).cast("double")).alias("c"))
    low = F.col("m") - 1.96 * F.sqrt(F.col("m") * (1 - F.col("m")) / F.col("n"))
    return k.select("role", F.when(F.col("m") <= F.col("c"), "DROP").when(low <= F.col("c"), "UNSURE").otherwise("KEEP").alias("verdict"))


@plans.add("q135_label_mode", f"SELECT role, act AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, act) AS k FROM (SELECT role, act, count(*) AS n FROM {T} GROUP BY ALL)) WHERE k = 1")
def label_mode(spark, d):
    """Most frequent label, ties to the lowest."""
    counts = turns(spark, d).groupBy("role", "act").agg(F.count("*").alias("n"))
    return counts.groupBy("role").agg(F.max(F.struct("n", (-F.col("act")).alias("a"))).alias("x")).select("role", (-F.col("x.a")).alias("mode"), "x.n")


@plans.add("q172_recall_at_k", f"WITH tr AS (SELECT role, act, count(*) AS n FROM {T} WHERE conv_id % 4 > 0 GROUP BY ALL), r AS (SELECT role, act, row_number() OVER (PARTITION BY role ORDER BY n DESC, act) AS rk FROM tr) SELECT x.role, avg((rk = 1)::INT::DOUBLE) AS at1, avg((rk <= 3)::INT::DOUBLE) AS at3, avg(coalesce(1.0::DOUBLE / rk, 0)) AS mrr FROM (SELECT * FROM {T} WHERE conv_id % 4 = 0) x LEFT JOIN r USING (role, act) GROUP BY 1")
def recall_at_k(spark, d):
    """The gold label's rank in the predicted ranking; a label that isn't ranked is a miss."""
    x = turns(spark, d)
    ranked = x.where("conv_id % 4 > 0").groupBy("role", "act").agg(F.count("*").alias("n")).select("role", "act", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "act")).alias("rk"))  # nine acts a role
    y = x.where("conv_id % 4 = 0").join(F.broadcast(ranked), ["role", "act"], "left")
    return y.groupBy("role").agg(F.avg((F.col("rk") == 1).cast("double")).alias("at1"), F.avg((F.col("rk") <= 3).cast("double")).alias("at3"), F.avg(F.coalesce(1 / F.col("rk"), F.lit(0.0))).alias("mrr"))


@plans.add("q182_agent_turns", f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM {T} WHERE role = 'assistant'")
def agent_turns(spark, d):
    return turns(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))


@plans.add("q183_example_texts", f"WITH b AS (SELECT act, text, list_sort(list_distinct(list(conv_id)))[1:2] AS ex FROM {T} GROUP BY 1, 2), e AS (SELECT act, md5(text) AS h, unnest(ex) AS conv_id FROM b) SELECT e.act, e.h, e.conv_id, count(c.text) AS turns FROM e LEFT JOIN conversations c USING (conv_id) GROUP BY ALL")
def example_texts(spark, d):
    """The conversations behind the examples of a bank of templates; none where the corpus lacks them."""
    bank = s.templates(turns(spark, d), ["act"], "text", "conv_id", 1, 2).select("act", F.md5("text").alias("h"), F.explode("examples").alias("conv_id"))
    return bank.join(table(spark, d, "conversations"), "conv_id", "left").groupBy("act", "h", "conv_id").agg(F.count("text").alias("turns"))


_GRAMS = lambda key, src: f"(SELECT {key}, gram, count(*)::DOUBLE AS c FROM (SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM (SELECT {key}, list_filter(string_split({_PLAIN}, ' '), lambda x: x <> '') AS w FROM {src})) GROUP BY ALL)"


@plans.add("q335_lexical_cosine", f"WITH a AS {_GRAMS('item_id', 'benchmark')}, na AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM a GROUP BY 1), b AS (SELECT item_id AS other, gram, c FROM a) SELECT * FROM (SELECT a.item_id, b.other, round(sum(a.c * b.c) / (any_value(x.n) * any_value(y.n)), 9) AS cosine FROM a JOIN b USING (gram) JOIN na x ON x.item_id = a.item_id JOIN na y ON y.item_id = b.other GROUP BY 1, 2) WHERE cosine >= 0.2::DOUBLE")
def lexical_cosine(spark, d):
    """All benchmark items against all, by rare grams."""
    b = table(spark, d, "benchmark")
    return dl.lexical_cosine(b, b.withColumnRenamed("item_id", "other"), "item_id", "other", "text", 0.2).select("item_id", "other", F.round("cosine", 9).alias("cosine"))


@plans.add("q336_map_to_candidate", f"""WITH x AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN text || ' !' ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END AS text FROM benchmark), c AS (SELECT item_id // 2 AS r, min(text) AS text FROM benchmark GROUP BY 1),
f AS (SELECT item_id, {_FORM} AS form FROM x), cf AS (SELECT r, {_FORM} AS form FROM c), e AS (SELECT item_id, min(r) AS exact FROM f JOIN cf USING (form) WHERE form <> '' GROUP BY 1),
a AS {_GRAMS('item_id', 'x')}, b AS {_GRAMS('r', 'c')}, na AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM a GROUP BY 1), nb AS (SELECT r, sqrt(sum(c * c)) AS n FROM b GROUP BY 1), d AS (SELECT item_id, r, round(sum(a.c * b.c) / (any_value(na.n) * any_value(nb.n)), 9) AS s FROM a JOIN b USING (gram) JOIN na USING (item_id) JOIN nb USING (r) GROUP BY 1, 2),
z AS (SELECT item_id, r FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, r) AS k FROM d) WHERE k = 1) SELECT item_id, coalesce(e.exact, z.r, -1) AS candidate FROM x LEFT JOIN e USING (item_id) LEFT JOIN z USING (item_id)""")
def map_to_candidate(spark, d):
    """Changed benchmark texts mapped back to one of the candidates."""
    b = table(spark, d, "benchmark")
    said = F.when(F.col("item_id") % 4 == 0, "").when(F.col("item_id") % 4 == 1, F.concat("text", F.lit(" !"))).otherwise(F.array_join(F.reverse(F.split("text", " ")), " "))
    candidates = b.groupBy(F.expr("item_id div 2").alias("r")).agg(F.min("text").alias("text"))
    return dl.map_to_candidate(b.select("item_id", said.alias("text")), candidates, "item_id", "r", "text")


_ANSWERS = """CASE doc_id % 6 WHEN 0 THEN '{"step": "respond", "action": "", "index": -1, "slots": [], "text": "hi"}' WHEN 1 THEN '```json' || chr(10) || '{"step": "take_action", "action": "refund", "index": -1, "slots": ["name"], "text": ""}' || chr(10) || '```'
  WHEN 2 THEN '{"step": "respond", "action": "refund", "index": -1, "slots": [], "text": ""}' WHEN 3 THEN '{"step": "respond", "action": "", "index": 4, "slots": [], "text": ""}' WHEN 4 THEN '{"step": "respond", "action": "", "index": -1, "text": ""}' ELSE 'not json' END"""


@plans.add("q341_parse_answer", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'respond' WHEN 1 THEN 'take_action' END AS step, CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS slots FROM documents")
def parse_answer(spark, d):
    """Strict answers: any violation gives null."""
    raw = F.expr(_ANSWERS.replace("chr(10)", "'\\n'"))
    j = dl.parse_answer(raw, ["refund", "lookup"])
    return table(spark, d, "documents").select("doc_id", j.alias("j")).select("doc_id", "j.step", F.when(F.col("j").isNotNull(), F.size("j.slots")).alias("slots"))


@plans.add("q342_probe_rows", f"SELECT conv_id, turn, h.head, CASE h.head WHEN 'act' THEN act::VARCHAR WHEN 'role' THEN role ELSE (length(text) > 100)::INT::VARCHAR END AS label FROM {T}, (SELECT unnest(['act', 'role', 'long']) AS head) h")
def probe_rows(spark, d):
    """One row per turn and head."""
    heads = F.array(F.struct(F.lit("act").alias("head"), F.col("act").cast("string").alias("label")), F.struct(F.lit("role").alias("head"), F.col("role").alias("label")), F.struct(F.lit("long").alias("head"), (F.char_length("text") > 100).cast("int").cast("string").alias("label")))
    return turns(spark, d).select("conv_id", "turn", F.inline(heads))


_COVER = f"WITH x AS (SELECT *, {_FORM} AS form FROM {T}), tr AS (SELECT DISTINCT act, text, form FROM x WHERE conv_id % 4 > 0), te AS (SELECT * FROM x WHERE conv_id % 4 = 0)"


@plans.add("q343_coverage_audit", f"{_COVER} SELECT role, count(*) AS n, avg((text IN (SELECT text FROM tr))::INT::DOUBLE) AS exact, avg((form IN (SELECT form FROM tr))::INT::DOUBLE) AS normalised, avg((act IN (SELECT act FROM tr))::INT::DOUBLE) AS act FROM te GROUP BY 1")
def coverage_audit(spark, d):
    """How much of the held-out turns the training turns could cover at best, by head."""
    x = turns(spark, d).withColumn("form", dl.dedup_form(F.col("text")))
    tr, te = x.where("conv_id % 4 > 0"), x.where("conv_id % 4 = 0")
    for k in ("text", "form", "act"):
        te = te.join(tr.select(k).distinct().withColumn(f"has_{k}", F.lit(1.0)), k, "left")
    hit = lambda k: F.avg(F.coalesce(f"has_{k}", F.lit(0.0)))
    return te.groupBy("role").agg(F.count("*").alias("n"), hit("text").alias("exact"), hit("form").alias("normalised"), hit("act").alias("act"))


@plans.add("q349_coverage_gap", f"{_COVER}, v AS (SELECT 'raw' AS variant, conv_id % 4 = 0 AS held, length(text) > 200 AS long, text IN (SELECT text FROM tr) AS hit FROM x UNION ALL SELECT 'form', conv_id % 4 = 0, length(text) > 200, form IN (SELECT form FROM tr) FROM x) SELECT variant, long, avg(CASE WHEN NOT held THEN hit::INT::DOUBLE END) - avg(CASE WHEN held THEN hit::INT::DOUBLE END) AS gap FROM v GROUP BY 1, 2")
def coverage_gap(spark, d):
    """Coverage lost from training to held-out turns, by labelling variant and length."""
    x = turns(spark, d).withColumn("form", dl.dedup_form(F.col("text")))
    tr = x.where("conv_id % 4 > 0")
    out = None
    for name, k in (("raw", "text"), ("form", "form")):
        hit = x.join(tr.select(k).distinct().withColumn("hit", F.lit(1.0)), k, "left").select(F.lit(name).alias("variant"), (F.col("conv_id") % 4 == 0).alias("held"), (F.char_length("text") > 200).alias("long"), F.coalesce("hit", F.lit(0.0)).alias("hit"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("variant", "long").agg((F.avg(F.when(~F.col("held"), F.col("hit"))) - F.avg(F.when(F.col("held"), F.col("hit")))).alias("gap"))


_SET = "list_sort(list_distinct(list_filter(string_split({}, ' '), lambda w: w <> '')))"


@plans.add("q344_equivalence", f"""{_COVER}, a AS (SELECT *, {_SET.format('form')} AS w FROM te), b AS (SELECT DISTINCT act, text, form, {_SET.format('form')} AS w FROM tr)
SELECT a.conv_id, a.turn, bool_or(a.text = b.text) AS exact, bool_or(a.form = b.form) AS field_safe, max(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) ELSE 0 END) >= 0.6::DOUBLE - 1e-9 AS near FROM a JOIN b USING (act) GROUP BY 1, 2""")
def equivalence(spark, d):
    """Whether a turn equals a template of its act: as it stands, by form, nearly (Jaccard of the words of 0.6)."""
    x = turns(spark, d).withColumn("form", dl.dedup_form(F.col("text"))).withColumn("words", F.filter(F.split("form", " "), lambda w: w != ""))
    tr, te = x.where("conv_id % 4 > 0"), x.where("conv_id % 4 = 0")
    sets = lambda side: side.where("size(words) > 0").select("act", "words", sim.set_digest(F.col("words")).alias("cls"))
    equal = sets(te).join(sets(tr).select("act", "cls").distinct(), ["act", "cls"], "left_semi").select("act", "cls")
    other = sets(te).join(equal.distinct(), ["act", "cls"], "left_anti")  # sets that the templates hold need no search
    near = sim.jaccard_pairs(other, tr, ["act"], "words", 0.6).select("act", F.col("a").alias("cls")).unionByName(equal).distinct().withColumn("near", F.lit(True))
    flag = lambda column, name: tr.select("act", F.md5(column).alias(f"__{column}")).distinct().withColumn(name, F.lit(True))
    known = tr.select("act").distinct()
    out = te.join(F.broadcast(known), "act").withColumn("__text", F.md5("text")).withColumn("__form", F.md5("form")).withColumn("cls", sim.set_digest(F.col("words")))  # a row an act
    out = out.join(flag("text", "exact"), ["act", "__text"], "left").join(flag("form", "field_safe"), ["act", "__form"], "left").join(near, ["act", "cls"], "left")
    no = F.lit(False)
    return out.groupBy("conv_id", "turn").agg(*[F.bool_or(F.coalesce(c, no)).alias(c) for c in ("exact", "field_safe", "near")])


_MEMBERS = f"SELECT conv_id, turn, act, [floor({u_sql(211, 'conv_id', 'turn')} * 9)::INT, CASE WHEN {u_sql(212, 'conv_id', 'turn')} < 0.7::DOUBLE THEN act ELSE 0 END, CASE WHEN {u_sql(213, 'conv_id', 'turn')} < 0.8::DOUBLE THEN act ELSE 1 END] AS votes, {u_sql(214, 'conv_id', 'turn')} AS conf FROM {T}"


def members(spark, d):
    vote = lambda seed, p, other: F.when(u(seed, "conv_id", "turn") < p, F.col("act")).otherwise(other)
    return turns(spark, d).select("conv_id", "turn", "act", F.array(F.floor(u(211, "conv_id", "turn") * 9).cast("int"), vote(212, 0.7, F.lit(0)), vote(213, 0.8, F.lit(1))).alias("votes"), u(214, "conv_id", "turn").alias("conf"))


@plans.add("q351_committee_gate", f"SELECT len(list_distinct(votes)) - 1 AS n_dis, floor((1 - conf) * 4)::INT AS bucket, count(*) AS n, avg((votes[3] = act)::INT::DOUBLE) AS accuracy FROM ({_MEMBERS}) GROUP BY ALL")
def committee_gate(spark, d):
    """Accuracy by the members' disagreement and the last one's doubt."""
    x = members(spark, d)
    return x.groupBy((F.size(F.array_distinct("votes")) - 1).alias("n_dis"), F.floor((1 - F.col("conf")) * 4).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.avg((F.element_at("votes", 3) == F.col("act")).cast("double")).alias("accuracy"))


@plans.add("q352_committee_conversations", f"WITH m AS (SELECT conv_id, max(len(list_distinct(votes)) - 1) AS n_dis, bool_and(votes[3] = act) AS ok FROM ({_MEMBERS}) GROUP BY 1) SELECT n_dis, count(*) AS n, avg(ok::INT::DOUBLE) AS accuracy FROM m GROUP BY 1")
def committee_conversations(spark, d):
    """The same on composed answers: a conversation is right if all its turns are."""
    k = members(spark, d).groupBy("conv_id").agg(F.max(F.size(F.array_distinct("votes")) - 1).alias("n_dis"), F.bool_and(F.element_at("votes", 3) == F.col("act")).alias("ok"))
    return k.groupBy("n_dis").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"))


_HEAD = f"{_COVER}, b AS (SELECT act, text AS best FROM (SELECT act, text, row_number() OVER (PARTITION BY act ORDER BY count(*) DESC, text) AS k FROM x WHERE conv_id % 4 > 0 GROUP BY act, text) WHERE k = 1)"


@plans.add("q353_act_template_head", f"{_HEAD} SELECT te.conv_id, te.turn, b.best = te.text AS ok, md5(b.best) AS h FROM te LEFT JOIN b USING (act)")
def act_template_head(spark, d):
    """Given the act, its most frequent training text."""
    x = turns(spark, d)
    counts = x.where("conv_id % 4 > 0").groupBy("act", "text").agg(F.count("*").alias("n"))
    best = counts.groupBy("act").agg(F.min(F.struct((-F.col("n")).alias("n"), "text")).alias("x")).select("act", F.col("x.text").alias("best"))
    return x.where("conv_id % 4 = 0").join(F.broadcast(best), "act", "left").select("conv_id", "turn", (F.col("best") == F.col("text")).alias("ok"), F.md5("best").alias("h"))  # one row an act


@plans.add("q353_sequence_head", f"""WITH x AS (SELECT *, lag(act) OVER w AS h1, lag(act, 2) OVER w AS h2 FROM {T} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), tr AS (SELECT * FROM x WHERE conv_id % 4 > 0), te AS (SELECT * FROM x WHERE conv_id % 4 = 0),
l AS (SELECT 0 AS n, NULL::INT AS a, NULL::INT AS b, act FROM tr UNION ALL SELECT 1, h1, NULL, act FROM tr WHERE h1 IS NOT NULL UNION ALL SELECT 2, h1, h2, act FROM tr WHERE h2 IS NOT NULL), c AS (SELECT n, a, b, act, count(*) AS c FROM l GROUP BY ALL),
t AS (SELECT n, a, b, act AS p, c / (sum(c) OVER (PARTITION BY n, a, b))::DOUBLE AS s, row_number() OVER (PARTITION BY n, a, b ORDER BY c DESC, act) AS k FROM c),
g AS (SELECT te.*, coalesce(t2.p, t1.p, t0.p) AS pred, CASE WHEN t2.p IS NOT NULL THEN 2 WHEN t1.p IS NOT NULL THEN 1 ELSE 0 END AS used, coalesce(t2.s, t1.s, t0.s) AS label_conf FROM te LEFT JOIN t t2 ON t2.k = 1 AND t2.n = 2 AND t2.a = h1 AND t2.b = h2 LEFT JOIN t t1 ON t1.k = 1 AND t1.n = 1 AND t1.a = h1 LEFT JOIN t t0 ON t0.k = 1 AND t0.n = 0),
d AS (SELECT act, text, count(*) AS c FROM tr GROUP BY ALL), hd AS (SELECT act AS p, text AS said, c / (sum(c) OVER (PARTITION BY act))::DOUBLE AS text_conf, row_number() OVER (PARTITION BY act ORDER BY c DESC, text) AS k FROM d)
SELECT g.conv_id, g.turn, pred, used, label_conf, md5(said) AS said, text_conf, label_conf * text_conf AS conf FROM g LEFT JOIN hd ON hd.p = pred AND hd.k = 1""")
def sequence_head(spark, d):
    """The next act from the acts before it by backing off, then that act's usual text, with both shares."""
    got = sq.sequence_head(turns(spark, d), F.col("conv_id") % 4 > 0, "conv_id", "turn", "act", "text", 2)
    return got.withColumn("said", F.md5("said")).withColumn("conf", F.col("label_conf") * F.col("text_conf"))


@plans.add("q354_relaxed_match", f"""{_HEAD}, z AS (SELECT te.text, b.best, list_distinct(list_filter(string_split(lower(te.text), ' '), lambda w: w <> '')) AS u, list_distinct(list_filter(string_split(lower(b.best), ' '), lambda w: w <> '')) AS v FROM te LEFT JOIN b USING (act))
SELECT count(*) AS n, avg(coalesce(best = text, false)::INT::DOUBLE) AS strict, avg(coalesce(len(u) > 0 AND len(v) > 0 AND len(list_intersect(u, v))::DOUBLE / (len(u) + len(v) - len(list_intersect(u, v))) >= 0.3::DOUBLE - 1e-9, false)::INT::DOUBLE) AS relaxed FROM z""")
def relaxed_match(spark, d):
    """Composed answers that are right as they stand, and nearly (Jaccard of the words of 0.3)."""
    x = turns(spark, d)
    counts = x.where("conv_id % 4 > 0").groupBy("act", "text").agg(F.count("*").alias("n"))
    best = counts.groupBy("act").agg(F.min(F.struct((-F.col("n")).alias("n"), "text")).alias("x")).select("act", F.col("x.text").alias("best"))
    u, v = (F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: w != "")) for c in ("best", "text"))
    y = x.where("conv_id % 4 = 0").join(F.broadcast(best), "act", "left")  # one row an act
    shared = F.size(F.array_intersect(u, v))
    near = (F.size(u) > 0) & (F.size(v) > 0) & (shared / (F.size(u) + F.size(v) - shared) >= 0.3 - sim.EPS)
    return y.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("best") == F.col("text"), F.lit(False)).cast("double")).alias("strict"), F.avg(F.coalesce(near, F.lit(False)).cast("double")).alias("relaxed"))


@plans.add("q355_miss_analysis", f"WITH m AS (SELECT *, votes[3] = act AS ok FROM ({_MEMBERS})) SELECT ok, count(*) AS n, quantile_cont(conf, 0.5) AS median, stddev_samp(conf) AS sd, avg((conf >= 0.5::DOUBLE)::INT::DOUBLE) AS above FROM m GROUP BY 1")
def miss_analysis(spark, d):
    """Confidence of hits and misses."""
    x = members(spark, d).withColumn("ok", F.element_at("votes", 3) == F.col("act"))
    return x.groupBy("ok").agg(F.count("*").alias("n"), F.percentile("conf", 0.5).alias("median"), F.stddev_samp("conf").alias("sd"), F.avg((F.col("conf") >= 0.5).cast("double")).alias("above"))


@plans.add("q355_threshold_sweep", f"WITH m AS (SELECT conf, (votes[3] = act)::INT AS ok FROM ({_MEMBERS})), k AS (SELECT t.t, sum((conf >= t.t AND ok = 1)::INT)::DOUBLE AS tp, sum((conf >= t.t)::INT)::DOUBLE AS p, sum(ok)::DOUBLE AS a FROM m, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS t) t GROUP BY 1) SELECT t, 2 * tp / (p + a) AS f1 FROM k")
def threshold_sweep(spark, d):
    x = members(spark, d).select("conf", (F.element_at("votes", 3) == F.col("act")).cast("int").alias("ok")).withColumn("t", F.explode(F.array(*[F.lit(v) for v in (0.1, 0.3, 0.5, 0.7, 0.9)])))
    k = x.groupBy("t").agg(F.sum(((F.col("conf") >= F.col("t")) & (F.col("ok") == 1)).cast("int")).alias("tp"), F.sum((F.col("conf") >= F.col("t")).cast("int")).alias("p"), F.sum("ok").alias("a"))
    return k.select("t", (2 * F.col("tp") / (F.col("p") + F.col("a"))).alias("f1"))


@plans.add("q356_generation_scores", f"WITH g AS (SELECT conv_id, turn, arm, CASE WHEN {u_sql(221, 'conv_id', 'turn', 'arm')} < 0.6::DOUBLE THEN text ELSE 'other' END = text AS ok FROM conversations, (SELECT unnest([0, 1]) AS arm)) SELECT arm, count(*) AS n, avg(ok::INT::DOUBLE) AS per_turn, avg(conv::INT::DOUBLE) AS weighted FROM (SELECT *, bool_and(ok) OVER (PARTITION BY arm, conv_id) AS conv FROM g) GROUP BY 1")
def generation_scores(spark, d):
    """Generated texts against the templates, per arm: turns right, and turns of conversations that are right throughout."""
    x = table(spark, d, "conversations").withColumn("arm", F.explode(F.array(F.lit(0), F.lit(1))))
    said = F.when(u(221, "conv_id", "turn", "arm") < 0.6, F.col("text")).otherwise("other")
    k = x.withColumn("ok", said == F.col("text")).groupBy("arm", "conv_id").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("double")).alias("s"), F.bool_and("ok").alias("every"))
    return k.groupBy("arm").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("per_turn"), (F.sum(F.when(F.col("every"), F.col("n")).otherwise(0)) / F.sum("n")).alias("weighted"))


@plans.add("q358_head_scores", f"SELECT 'act' AS head, act AS gold, round(conf, 1) AS bucket, count(*) AS n FROM ({_MEMBERS}) GROUP BY ALL UNION ALL SELECT 'vote', votes[3], round(conf, 1), count(*) FROM ({_MEMBERS}) GROUP BY ALL")
def head_scores(spark, d):
    """Scores by head, gold and bucket of confidence, for calibration."""
    x = members(spark, d).select(F.round("conf", 1).alias("bucket"), F.explode(F.array(F.struct(F.lit("act").alias("head"), F.col("act").alias("gold")), F.struct(F.lit("vote").alias("head"), F.element_at("votes", 3).alias("gold")))).alias("x"))
    return x.groupBy("x.head", "x.gold", "bucket").agg(F.count("*").alias("n"))


@plans.add("q090_clause_pick")
def clause_pick(spark, d):
    """The sentences that say most about some terms, within a budget of characters."""
    return dl.clause_pick(table(spark, d, "documents"), "doc_id", "text", ["the", "of", "that", "der", "que"], 3, 200)


@plans.add("q092_phrase_hits", r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) SELECT doc_id, w AS phrase, count(*) AS n FROM w WHERE w IN ('the', 'that', 'und', 'que') GROUP BY 1, 2")
def phrase_hits(spark, d):
    return dl.phrase_hits(table(spark, d, "documents"), "doc_id", "text", ["the", "that", "und", "que"])


@plans.add("q093_all_in_one_sentence", r"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?;\n]'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents), p AS (SELECT doc_id, unnest(range(len(s)))::INT AS position, unnest(s) AS x FROM s) SELECT doc_id, position FROM p WHERE regexp_matches(lower(x), '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)') AND regexp_matches(lower(x), '(^|[^\p{L}\p{N}_])of([^\p{L}\p{N}_]|$)')")
def all_in_one_sentence(spark, d):
    return dl.all_in_one_sentence(table(spark, d, "documents"), "doc_id", "text", ["the", "of"])


@plans.add("q086_rerank", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, e.label, q.label AS own, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 9) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS k FROM p) SELECT query, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s + 0.05::DOUBLE * (label = own)::INT, 9) DESC, neighbour) AS r FROM t WHERE k <= 10) WHERE r = 1""")
def rerank(spark, d):
    """Ten nearest vectors, then a second score (here a bonus for the same class) picks one."""
    e = table(spark, d, "embeddings")
    near = v.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)
    x = near.join(e.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), "query")
    score = F.round(F.col("similarity") + 0.05 * (F.col("label") == F.col("own")).cast("int"), 9)
    return x.groupBy("query").agg(F.max_by("neighbour", F.struct(score, -F.col("neighbour"))).alias("neighbour"))


@plans.add("q337_confidence_sets", f"SELECT conv_id, turn, CASE WHEN {u_sql(231, 'conv_id', 'turn')} >= 0.5::DOUBLE THEN 1 ELSE 0 END + CASE WHEN 1 - {u_sql(231, 'conv_id', 'turn')} >= 0.5::DOUBLE THEN 1 ELSE 0 END AS raw_size, (1 - {u_sql(231, 'conv_id', 'turn')} <= 0.8::DOUBLE + 1e-12::DOUBLE)::INT + ({u_sql(231, 'conv_id', 'turn')} <= 0.8::DOUBLE + 1e-12::DOUBLE)::INT AS conformal_size FROM conversations")
def confidence_sets(spark, d):
    """Two ways to a prediction set: a conformal threshold on 1 - p, or a bar on p."""
    p = u(231, "conv_id", "turn")
    proba = F.array(p, 1 - p)
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(dl.confidence_set(proba, F.lit(0.5), False)).alias("raw_size"), F.size(dl.confidence_set(proba, F.lit(0.8), True)).alias("conformal_size"))


@plans.add("q193_required_slots", f"SELECT conv_id, list_sort(list_distinct(flatten(list(CASE act % 3 WHEN 0 THEN ['name'] WHEN 1 THEN ['name', 'order'] ELSE []::VARCHAR[] END)))) AS slots FROM {T} WHERE role = 'assistant' GROUP BY 1")
def required_slots(spark, d):
    """The slots that any template of a selection needs."""
    need = F.when(F.col("act") % 3 == 0, F.array(F.lit("name"))).when(F.col("act") % 3 == 1, F.array(F.lit("name"), F.lit("order"))).otherwise(F.array().cast("array<string>"))
    return turns(spark, d).where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(need)))).alias("slots"))  # three kinds of need
