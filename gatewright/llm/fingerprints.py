"""Document fingerprints by winnowing (native).

Tokens are words (code points between white space, lower-cased, longer ones cut every 24; a Han, kana or Thai character
is a token of its own). Every k = 4 tokens give a hash, made by doubling from the hashes of pairs; of every w = 8
consecutive k-gram hashes the smallest is kept, the rightmost of equal ones, with its position. Two texts that share
w + k - 1 = 11 consecutive tokens therefore share a fingerprint entry. Everything is a DataFrame expression over one
row's arrays: nothing is exploded or shuffled.

A text with 1 to 3 tokens has one entry, the hash of all of them; with fewer than 8 k-grams, the smallest of all.
Null, empty and blank texts have no entries; likeness is the Jaccard coefficient of the entries' hashes, 1 for two
empty ones. Texts that differ only in case or white space have equal fingerprints. Very long texts are one array of their
tokens in the row that holds them. Rows with equal keys follow each other by their text; an empty table gives no rows.
Extra columns are left alone, but for those named like the columns that are made (`out` of winnow, next_<column> of
with_next), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewright.llm.common import partitions, table

#: Bits of a packed entry that hold the position (modulo 2^23); the other 41 hold the hash.
POSITION_BITS = 23
_LOW = (1 << POSITION_BITS) - 1
_SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
_TOKEN = rf"[{_SCRIPTS}]|[^\x20\x09-\x0D{_SCRIPTS}]{{1,24}}"

#: Of two packed entries the one with the smaller hash, the right one of equal hashes.
_PICK = f"(a, b) -> if(shiftright(b, {POSITION_BITS}) <= shiftright(a, {POSITION_BITS}), b, a)"


def _shifted(df: DataFrame, source: str, target: str, by: int, fn: str) -> DataFrame:
    """target[i] = fn(source[i], source[i + by]); empty where source has at most `by` elements."""
    n = f"greatest(size({source}) - {by}, 0)"
    return df.withColumn(target, F.expr(f"zip_with(slice({source}, 1, {n}), slice({source}, {by + 1}, {n}), {fn})"))


def winnow(df: DataFrame, text: str = "text", out: str = "entries", k: int = 4, window: int = 8) -> DataFrame:
    """df with column `out`: the array of packed entries (hash << 23 | position) in order of position.

    k and window: powers of two.
    """
    for name, value in (("k", k), ("window", window)):
        if value < 1 or value & (value - 1):
            raise ValueError(f"{name} must be a power of two")
    names = [f"__w{i}" for i in range(40)]
    free = iter(names)
    col = next(free)
    df = df.withColumn(col, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_TOKEN), F.lit(0)))
    words, col = col, next(free)
    df = df.withColumn(col, F.expr(f"transform({words}, w -> xxhash64(w))"))
    hashes, step = col, 1
    while step < k:
        col = next(free)
        df = _shifted(df, hashes if step == 1 else prior, col, step, "(a, b) -> xxhash64(a, b)")
        prior, step = col, step * 2
    grams = col
    col = next(free)
    whole = f"array(aggregate({hashes}, 0L, (s, h) -> xxhash64(s, h)))"
    df = df.withColumn(col, F.expr(f"if(size({grams}) > 0 or size({hashes}) = 0, {grams}, {whole})"))
    source, col = col, next(free)
    df = df.withColumn(col, F.expr(f"transform({source}, (h, i) -> (h & {~_LOW}L) | (i & {_LOW}))"))
    packed = least = col
    step = 1
    while step < window:
        col = next(free)
        df = _shifted(df, least, col, step, _PICK)
        least, step = col, step * 2
    few = f"array(aggregate({packed}, element_at({packed}, 1), {_PICK}))"
    df = df.withColumn(out, F.expr(f"case when size({least}) > 0 then array_distinct({least}) when size({packed}) > 0 then {few} else {packed} end"))
    return df.drop(*names)


def hashes_of(entries: str) -> Column:
    """The distinct hashes of packed entries, without positions."""
    return F.expr(f"array_distinct(transform({entries}, e -> shiftright(e, {POSITION_BITS})))")


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two arrays of distinct hashes; 1 for two empty ones."""
    both = f"size(array_intersect({a}, {b}))"
    return F.expr(f"if(size({a}) = 0 and size({b}) = 0, 1.0D, {both} / cast(size({a}) + size({b}) - {both} as double))")


def spell(entries: str) -> Column:
    """Entries as text: 16 hexadecimal digits each, hash and position, with commas."""
    return F.expr(f"array_join(transform({entries}, e -> hex(e)), ',')")


def with_next(df: DataFrame, key: str, carry: list[str], pieces: int | None = None) -> DataFrame:
    """df with next_<column> for each column of `carry`: the row that follows in descending order of key (null keys
    last, ties by text), the first row after the last one.

    The key's range is cut at `pieces` actual keys (quantiles, a list bounded by `pieces`); the rows of a piece are
    ordered together, and each piece's first row is also a guest at the end of the piece before it, so one shuffle
    of the rows suffices and no piece holds more than its share.
    """
    spark = df.sparkSession
    df = df.drop(*[f"next_{c}" for c in carry])
    pieces = pieces or min(4096, 4 * partitions(spark))
    low = F.coalesce(F.col(key).cast("long"), F.lit(1 - (1 << 63)))
    probs = [i / pieces for i in range(1, pieces + 1)]
    cuts = df.select(F.percentile_approx(low, probs, 10 * pieces)).first()[0]
    cuts = sorted(set(cuts or [0]), reverse=True)
    # piece j holds the keys in (cuts[j + 1], cuts[j]]; the maximum is cuts[0], each cut is the first key of its piece
    top = df.agg(F.max(low)).first()[0]
    if top is not None and top > cuts[0]:
        cuts = [top, *cuts]
    edges = F.array(*[F.lit(-c).cast("long") for c in cuts])  # ascending
    place = F.expr("size(filter(__cuts, c -> c <= -__key)) - 1")
    base = df.withColumn("__key", low).withColumn("__cuts", edges).withColumn("__piece", place)
    first = F.expr("array_contains(__cuts, -__key)")
    last = len(cuts) - 1
    seats = F.when(first, F.array(F.struct(F.col("__piece").alias("p"), F.lit(0).alias("g")), F.struct(F.when(F.col("__piece") == 0, F.lit(last)).otherwise(F.col("__piece") - 1).alias("p"), F.lit(1).alias("g"))))
    seats = seats.otherwise(F.array(F.struct(F.col("__piece").alias("p"), F.lit(0).alias("g"))))
    dealt = base.withColumn("__seat", F.explode(seats)).drop("__cuts")
    order = Window.partitionBy("__seat.p").orderBy(F.col("__seat.g"), F.col("__key").desc(), *[F.col(c) for c in carry])
    out = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return out.where("__seat.g = 0").drop("__seat", "__key", "__piece")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = winnow(docs)
    paired = with_next(own, "doc_id", ["text", "entries"])
    n = F.char_length("text")
    edited = paired.withColumn("n_chars", n.cast("long")).withColumn("edited", F.expr("concat(substring(text, 1, char_length(text) - char_length(text) div 2), substring(next_text, 1, cast(char_length(text) div 2 as int)))"))
    edited = winnow(edited.drop("text", "next_text"), "edited", "edited_entries")
    edited = edited.withColumn("__own", hashes_of("entries")).withColumn("__edited", hashes_of("edited_entries")).withColumn("__next", hashes_of("next_entries"))
    return edited.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), spell("entries").alias("fingerprint"), spell("edited_entries").alias("edited_fingerprint"), likeness("__own", "__edited").alias("near_edited"), likeness("__own", "__next").alias("near_next"))


QUERIES = {"op6_winnowing": op6_winnowing}
