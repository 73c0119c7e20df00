"""Sharding by jump consistent hashing, in DataFrame functions only.

``jump`` walks the jump sequence of a key: a 64-bit linear congruential step
yields the next shard at which the key would jump, until that lies past the
shard count. No ring, no table; one more shard takes rows only into itself, and
about a fraction 1/(n+1) of them.

The 64-bit product is formed from 16- and 32-bit limbs, so that nothing
overflows under ANSI arithmetic. The walk takes about ln(n) steps; a key that
isn't through after ``3 ln(n) + 12`` goes on for up to ``n`` in a branch that is
evaluated for such keys alone, so the result is exact for every key.

Slots number the rows of a shard without gaps, in order of (key, crc, size),
without ever gathering a shard: rows are range-partitioned by the key (a salt
splits runs of equal rows), counted per (partition, shard), and numbered inside
these bounded groups from the running sum of the counts.

Defined results: a null key hashes as 0; a null text has 0 bytes and crc32 0, so
size 8; repeated rows keep one slot each; an empty table gives an empty result.
Extra columns are carried by ``assign`` and dropped by ``with_slots``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, staged

#: Multiplier of the jump hash's congruential step.
MULTIPLIER = 2862933555777941757
_LOW32, _LOW16 = 0xFFFFFFFF, 0xFFFF
SHARDS = 24
ROWS_PER_PART = 500_000


def _step(state: Column, n: int) -> Column:
    """One jump; a finished walk stays as it is."""
    ch, cl = MULTIPLIER >> 32, MULTIPLIER & _LOW32
    hi, lo = state["hi"], state["lo"]
    part = lambda x, low: x.bitwiseAND(F.lit(low))
    p = part(lo, _LOW16) * F.lit(cl) + F.lit(1)
    q = F.shiftright(lo, 16) * F.lit(cl)
    t = p + F.shiftleft(part(q, _LOW16), 16)
    carried = F.shiftright(t, 32) + F.shiftright(q, 16)
    crossed = part(lo * F.lit(ch), _LOW32) + part(part(hi, _LOW16) * F.lit(cl), _LOW32)
    crossed = crossed + F.shiftleft(part(F.shiftright(hi, 16) * F.lit(cl), _LOW16), 16)
    new_hi = part(carried + crossed, _LOW32)
    new = F.struct(new_hi.alias("hi"), part(t, _LOW32).alias("lo"), state["j"].alias("b"), F.lit(0).cast("long").alias("j"))
    held = F.transform(
        F.array(new),
        lambda s: F.struct(
            s["hi"].alias("hi"),
            s["lo"].alias("lo"),
            s["b"].alias("b"),
            F.floor((s["b"] + F.lit(1)) * (F.lit(2147483648.0) / (F.shiftright(s["hi"], 1) + F.lit(1)))).cast("long").alias("j"),
        ),
    )[0]
    return F.when(state["j"] >= F.lit(n), state).otherwise(held)


def jump(key: Column, n: int) -> Column:
    """struct(shard int, grown int): the key's shard among ``n``, and among n+1."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_LOW32)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )
    walk = lambda state, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: _step(s, n))
    usual = min(n, int(3 * math.log(n)) + 12)
    end = walk(start, usual)
    if usual < n:
        end = F.transform(F.array(end), lambda s: F.when(s["j"] >= F.lit(n), s).otherwise(walk(s, n - usual)))[0]
    shard = end["b"].cast("int")
    return F.struct(shard.alias("shard"), F.when(end["j"] == F.lit(n), F.lit(n)).otherwise(shard).alias("grown"))


def assign(df: DataFrame, key: str, n: int = SHARDS, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``df`` with the key's shard, and its shard were there one more. No shuffle.
    Columns of these names are replaced."""
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    at = "__jump"
    out = df.drop(*[c for c in (shard, grown) if c in df.columns and c != key]).withColumn(at, jump(F.col(f"`{key}`"), n))
    return out.withColumns({shard: F.col(f"{at}.shard"), grown: F.col(f"{at}.grown")}).drop(at)


def with_slots(df: DataFrame, order: list[str], shard: str = "shard", slot: str = "slot", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``df``, narrow, with a gapless number from 0 in each shard, by ``order``.

    Rows equal in ``order`` and all else may be dealt to several partitions by a
    salt, so no key's rows need fit into one task; they are alike, so any
    numbering of them is the same result."""
    narrow = staged(df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())))
    parts = max(1, math.ceil(narrow.count() / rows_per_part))
    ranged = narrow.repartitionByRange(parts, *[F.col(c) for c in order], F.col("__salt"))
    ranged = staged(ranged.withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, "__part").orderBy(*[F.col(c) for c in order], "__salt")
    numbered = ranged.withColumn("__row", F.row_number().over(inside).cast("long") - F.lit(1))
    out = numbered.join(starts, [shard, "__part"])
    return out.withColumn(slot, F.col("__start") + F.col("__row")).drop("__salt", "__part", "__start", "__row")


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23, by doc_id."""
    docs = documents(spark, sf_dir)
    text = F.coalesce(column(docs, "text", "string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(8)).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = with_slots(assign(narrow, "doc_id", SHARDS), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: crc32 by its table, which is built from the polynomial; DuckDB has none.
OP1_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), sized AS (
  SELECT r, doc_id, strlen(text) + 8 AS size,
    xor(list_reduce(
      list_transform(range(0, 2 * strlen(text), 2), lambda p: ('0x' || substr(hex(encode(text)), p + 1, 2))::BIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM docs, crc_table
), walk(r, k, b, j) AS (
  SELECT r, CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END, -1::BIGINT, 0::BIGINT FROM docs
  UNION ALL
  SELECT r, n, j, floor((j + 1) * (2147483648.0::DOUBLE / ((n // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM walk WHERE j < 24)
), placed AS (
  SELECT r, b AS shard, CASE WHEN j = 24 THEN 24 ELSE b END AS grown_shard FROM walk WHERE j >= 24
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
  grown_shard::INTEGER AS grown_shard
FROM sized JOIN placed USING (r)
"""
