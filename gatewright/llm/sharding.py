"""Sharding by a hierarchical weighted hash tree (native).

A topology lists shards with their region, rack and weight. A row descends region, rack, shard; at each level every
child draws ln(u) / weight with u hashed from (level, child, key) and the largest draw wins, so a child is chosen in
proportion to its subtree's weight. A draw depends on its own child alone: changing a weight moves rows only between
that subtree and its siblings. A new shard that opens its own region takes rows from everywhere and only into itself.

Keys: any type, compared by their text; null counts as empty text. Repeated rows land together. Texts play no part, however
long. Extra columns stay; columns of df named like the asked shard and slot columns are replaced. An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewright.llm.common import table

#: Rows of a topology: (region, rack, shard, weight).
Topology = list[tuple[int, int, int, float]]

SHARDS = 8


def topology(shards: int) -> Topology:
    """Racks of two shards, regions of two racks, equal weights."""
    return [(s // 4, s // 2, s, 1.0) for s in range(shards)]


def grown(shape: Topology, weight: float = 1.0) -> Topology:
    """shape with one more shard, which opens a region and a rack of its own: rows move into it and nowhere else, whatever
    the shape. (topology(n + 1) does so only where n is a multiple of four.)"""
    return [*shape, (max(r for r, *_ in shape) + 1, max(k for _, k, *_ in shape) + 1, max(s for _, _, s, _ in shape) + 1, weight)]


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    digest = F.md5(F.concat(F.lit(f"{level}{child}|"), key))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.log(u) / F.lit(weight)


def _choose(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child with the largest draw; of equal draws the smallest child."""
    live = {c: w for c, w in children.items() if w > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    return F.array_max(F.array(*[F.struct(_draw(key, level, c, w).alias("d"), F.lit(-c).alias("c")) for c, w in sorted(live.items())]))["c"] * -1


def shard_of(key: Column, shape: Topology) -> Column:
    """The shard of a key. Only the chosen region's and rack's draws are made."""
    if not any(w > 0 for *_, w in shape):
        raise ValueError("a topology needs a shard of positive weight")
    key = F.coalesce(key.cast("string"), F.lit(""))
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for region, rack, shard, weight in shape:
        regions.setdefault(region, {}).setdefault(rack, {})[shard] = weight
    rack_weight = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in regions.items()}

    def pick(chosen: Column, of: dict[int, Column]) -> Column:
        out = F.lit(None).cast("int")
        for value, then in of.items():
            out = F.when(chosen == value, then).otherwise(out)
        return out

    region = _choose(key, "g", {r: sum(w.values()) for r, w in rack_weight.items()})
    in_region = {}
    for r, racks in regions.items():
        if sum(rack_weight[r].values()) <= 0:
            continue
        rack = _choose(key, "k", rack_weight[r])
        in_region[r] = pick(rack, {k: _choose(key, "s", shards) for k, shards in racks.items() if rack_weight[r][k] > 0})
    return pick(region, in_region).cast("int")


def assign(df: DataFrame, key: str, shape: Topology, shard: str = "shard", slot: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with its shard and, if asked for, a gapless number from 0 within the shard.

    Slots are numbered in 256 parts of each shard by a digest of the key, offset by the counts of the parts before
    (at most 256 rows a shard), so that no shard is ever gathered in one task.
    """
    df = df.drop(*[c for c in (shard, slot, "__part", "__place", "__before") if c and c != key and c not in ties])
    out = df.withColumn(shard, shard_of(F.col(key), shape))
    if slot is None:
        return out
    part = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 2)
    out = out.withColumn("__part", part)
    counts = out.groupBy(F.col(shard).alias("__s"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(shard, "__part").orderBy(key, *ties))
    out = out.withColumn("__place", place.cast("long"))
    # bounded: 256 rows a shard
    out = out.join(F.broadcast(before.drop("__n")), (F.col(shard) == F.col("__s")) & (F.col("__part") == F.col("__p")))
    return out.withColumn(slot, (F.col("__before") + F.col("__place") - 1).cast("long")).drop("__part", "__place", "__before", "__s", "__p")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `key`; grown_shard: the shard with one more, which opens its own
    region. A null text has no bytes: size 1, crc 0."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign(docs, "doc_id", topology(SHARDS), slot="slot", ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), grown(topology(SHARDS))).alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}


def _sql_choose(level: str, children: list[int], weights: list[float], key: str) -> str:
    draws = ", ".join(f"{{'d': ln((('0x' || substr(md5('{level}{c}|' || {key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {w}::DOUBLE, 'c': {-c}}}" for c, w in zip(children, weights, strict=True))
    return str(children[0]) if len(children) == 1 else f"(-(list_max([{draws}]).c))"


def _sql_shard(key: str, shards: int) -> str:
    shape = topology(shards)
    regions = sorted({r for r, *_ in shape})
    region = _sql_choose("g", regions, [sum(w for g, *_, w in shape if g == r) for r in regions], key)
    cases = []
    for r in regions:
        racks = sorted({k for g, k, *_ in shape if g == r})
        rack = _sql_choose("k", racks, [sum(w for _, q, _, w in shape if q == k) for k in racks], key)
        inner = " ".join(f"WHEN {k} THEN {_sql_choose('s', [s for _, q, s, _ in shape if q == k], [w for _, q, _, w in shape if q == k], key)}" for k in racks)
        cases.append(f"WHEN {r} THEN CASE {rack} {inner} END")
    return f"CASE {region} {' '.join(cases)} END"


#: CRC-32 in SQL: the table's entries come from the polynomial 0xEDB88320 by eight shifts each, the text's bytes from its hex digits.
_CRC = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i)))
"""

ORACLE_SQL = {
    "op7_sharding": f"""
WITH {_CRC.strip()},
bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'),
      lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM bytes, crc_table),
placed AS (SELECT *, ({_sql_shard("doc_id::VARCHAR", SHARDS)})::INT AS shard, ({_sql_shard("doc_id::VARCHAR", SHARDS + 1)})::INT AS grown_shard FROM crc)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id::VARCHAR), 1, 2), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""
}
