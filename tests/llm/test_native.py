"""Sharding and mixing, which run on the JVM alone."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerline.llm import mixing, sharding

DOCS = "doc_id long, text string, source string"


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, 2, 7, -1, -(2**63), 2**63 - 1, 123456789012345, *range(1000, 1200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 1000):
        got = {r.k: (r.shard, r.grown_shard) for r in sharding.assign(df, "k", n).collect()}
        assert got == {k: (jump(k, n), jump(k, n + 1)) for k in keys}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = sharding.assign(spark.range(20_000), "id", 24).collect()
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} == {24}
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) < 1.3 * min(sizes.values())


def test_slots_are_gapless_with_nulls_repeats_and_a_hot_key(spark):
    rows = [(i,) for i in range(300)] + [(7,)] * 200 + [(None,)] * 3
    df = sharding.assign(spark.createDataFrame(rows, "k long"), "k", 5)
    out = sharding.with_slots(df.withColumn("extra", F.lit("x")), ["k"], rows_per_part=50).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append((r.slot, -1 if r.k is None else r.k))
    assert len(out) == len(rows)
    for held in slots.values():
        assert [s for s, _ in sorted(held)] == list(range(len(held))) and [k for _, k in sorted(held)] == sorted(k for _, k in held)


def test_sharding_query_on_odd_rows(spark, tmp_path):
    rows = [(1, "añb", "s"), (2, None, None), (None, "", "s"), (2, None, None)]
    spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op1_jump_sharding(spark, str(tmp_path)).collect()
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted((8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert {r.law for r in out} == {"key"}
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert sharding.op1_jump_sharding(spark, f"{tmp_path}/empty").count() == 0


def water_fill(sizes, weights):
    """Targets by resharing the excess, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * unit > 3 * sizes[s]}
        if not over:
            return target | {s: w[s] * unit for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    return target


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = {"a": 1000, "b": 10, "c": 3, "é": 500, "zz": 0, None: 40}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, m long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = water_fill(sizes, mixing.WEIGHTS)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def corpus(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 97)), f"s{i % 3}") for i in range(600)]
    rows += [(9000, "one two three", "s0")] * 150 + [(9001, None, "s1"), (9002, "", None), (None, "a b c", None), (9003, " ".join(["x"] * 3000), "s2")]
    return spark.createDataFrame(rows, DOCS), rows


def test_sources_come_near_their_targets(spark):
    df, rows = corpus(spark)
    out = mixing.mix(mixing._rows(df)).collect()
    assert len(out) == len(rows)
    taken, target = defaultdict(int), {}
    for r in out:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in ("s0", "s1", "s2"):
        assert abs(taken[s] - target[s]) <= 100
    again = mixing.mix(mixing._rows(df.repartition(7))).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert next(r["size"] for r in out if r.doc_id is None) == 2


def test_every_row_has_its_expected_copies(spark):
    df, _ = corpus(spark)
    narrow = mixing._rows(df.filter("doc_id < 600 AND source = 's0'")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")).cache()
    size = narrow.agg(F.sum("size")).first()[0]
    sources = spark.createDataFrame([("s0", size, 0.4)], "source string, source_size long, ratio double")
    total = Counter()
    for seed in range(12):
        total.update({r.doc_id: r.copies for r in mixing.round_copies(narrow, sources, seed, fan=32).collect()})
    mean = sum(total.values()) / 12 / narrow.count()
    assert 0.34 < mean < 0.46


def test_replicated_rows_are_what_the_mix_takes(spark):
    df, _ = corpus(spark)
    df = df.withColumn("copies", F.lit("clash"))
    out = mixing.replicate(df)
    assert out.columns == df.columns
    want = Counter()
    for r in mixing.mix(mixing._rows(df)).collect():
        want[r.doc_id] += r.copies if r["size"] else 1
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_rows_alike_and_rows_of_one_key_share_their_copies(spark):
    """One id, source and size: 90 rows alike, 60 that differ, against the mix's total."""
    rows = [(1, "one two three four", "a", "same")] * 90 + [(1, "one two three four", "a", f"v{i}") for i in range(30)]
    rows += [(1, f"{i} two three four", "a", "other") for i in range(30)] + [(None, "x y", None, "n")] * 4 + [(None, None, None, "empty")] * 3 + [(i, "w " * (1 + i % 9), "b", "v") for i in range(2, 200)]
    df = spark.createDataFrame(rows, f"{DOCS}, value string")
    for n in ("__key", "h", "h2", "size", "n", "key", "row", "copy", "times", "c0", "grp"):
        df = df.withColumn(n, F.lit("own"))
    out = mixing.replicate(df)
    assert out.columns == df.columns
    got = Counter(r.doc_id for r in out.collect())
    want = Counter()
    for r in mixing.mix(mixing._rows(df)).collect():
        want[r.doc_id] += r.copies if r["size"] else 1
    assert got == +want
    each = Counter(r.value + r.text for r in out.filter("doc_id = 1").collect())
    one = [v for k, v in each.items() if not k.startswith("same")]
    assert max(one) - min(one + [0] * (60 - len(one))) <= 1 and abs(each["sameone two three four"] - 90 * sum(one) / 60) <= 90
    again = mixing.replicate(df.repartition(5))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, again.collect()))


def test_mixing_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(mixing._rows(df)).count() == 0 and mixing.replicate(df).count() == 0
    some = spark.createDataFrame([(1, None, "a"), (2, "", None)], DOCS)
    assert mixing.replicate(some).count() == 2 and [r.taken for r in mixing.mix(mixing._rows(some)).collect()] == [0, 0]


def test_a_very_long_text_is_sized_and_sharded(spark, tmp_path):
    long = "wörd " * 400_000
    spark.createDataFrame([(1, long, "a"), (2, "x", "a")], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in mixing.op4_pivotal_mixing(spark, str(tmp_path)).collect()}
    assert out[1]["size"] == 400_000 and out[1].source_size == 400_001 and out[1].taken in (400_000, 800_000, 1_200_000, 0)
    out = {r.doc_id: r for r in sharding.op1_jump_sharding(spark, str(tmp_path)).collect()}
    assert out[1]["size"] == len(long.encode()) + 8 and out[1].text_crc32 == zlib.crc32(long.encode())
