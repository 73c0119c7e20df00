"""The Jaccard join against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import jaccard

DOCS = "doc_id long, text string"


def brute(docs, width, num, den):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(sets[i]), (min(least[find(i)], default=None) if sets[i] else d)) for i, (d, _) in enumerate(docs)), key=repr)


def corpus(seed=1, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(30)]
    docs = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 9, 20, 60, 150]))]
        if i % 3 == 0:
            text += passage
        docs.append((i, " ".join(text)))
        for k in range(r.choice([0, 0, 1, 3])):
            copy = list(text)
            for _ in range(r.choice([0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            docs.append((1000 * (k + 1) + i, "\n".join(copy).upper()))
    docs += [(5000, None), (5001, ""), (5002, " \t\n"), (None, docs[0][1]), (7, docs[0][1]), (7, docs[0][1]), (5003, "É one two three four"), (5004, "é one two three four")]
    return docs


@pytest.mark.parametrize(("width", "similar"), [(4, (85, 100)), (5, (80, 100)), (2, (1, 2))])
def test_join_is_brute_force(spark, width, similar):
    docs = corpus()
    df = spark.createDataFrame(docs, DOCS).withColumn("set_id", F.lit("clash"))
    small = {"entries_per_task": 400, "shingles_per_tile": 300, "sets_per_tile": 3} if width == 4 else {}
    got = jaccard.join(df, width, similar, **small).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, width, *similar)


def test_one_document_of_each_group_stays(spark):
    docs = corpus(3, 60)
    df = spark.createDataFrame(docs, DOCS).withColumn("root", F.lit("clash"))
    out = jaccard.keep_one(df)
    assert out.columns == df.columns
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert kept == sorted({d for d, _, c in brute(docs, 5, 80, 100) if d is not None and d == c})


def test_rows_of_repeated_and_null_ids_are_judged_one_by_one(spark):
    r = random.Random(9)
    a, b, c, d, e, f = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(6))
    rows = [(1, a, "stays"), (2, a, ""), (2, b, "stays"), (2, f + " tail", ""), (1, f, "stays"), (5, c, "c"), (5, c + " tail", "c"), (None, d, "d"), (None, d, "d"), (None, d + " tail", "d"), (None, e, ""), (6, e, "stays")]
    rows += [(None, None, "stays"), (None, None, "stays"), (None, " \t", "stays"), (7, "", "7"), (7, "", "7"), (0, None, "stays")]
    out = jaccard.keep_one(spark.createDataFrame(rows, f"{DOCS}, fate string"))
    assert sorted(x.fate for x in out.collect()) == ["7", "c", "d", *["stays"] * 8]


def test_an_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], DOCS)).count() == 0


def test_linking_sets_share_a_tile():
    r = np.random.default_rng(5)
    for num, den in ((85, 100), (80, 100)):
        for size in (1, 2, 5, 7, 12, 30, 100, 333, 1000):
            base = np.unique(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            spoilt = int(len(base) * (den - num) / (den + num))  # the most that may be replaced
            other = np.unique(np.concatenate([base[spoilt:], r.integers(0, 2**63, spoilt, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            both = len(np.intersect1d(base, other))
            if both * den >= num * (len(base) + len(other) - both) and spoilt:
                keys, of = jaccard.tile_keys(np.concatenate([base, other]), np.array([len(base), len(other)]), num, den)
                assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def test_sets_of_very_different_sizes_share_a_tile_at_low_thresholds():
    r = np.random.default_rng(6)
    for num, den, small, large in ((25, 100, 7, 28), (29, 100, 61, 210), (5, 100, 20, 400), (1, 100, 3, 300)):
        base = np.unique(r.integers(0, 2**63, large, dtype=np.uint64) * np.uint64(2))
        for _ in range(20):
            part = np.sort(r.choice(base, small, replace=False))
            assert small * den >= num * large
            keys, of = jaccard.tile_keys(np.concatenate([part, base]), np.array([small, large]), num, den)
            assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def test_bitmaps_bound_the_overlap_from_above():
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 500, r.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        size = np.array([len(a), len(b)])
        flat, words = jaccard.signatures(np.concatenate([a, b]), size), jaccard.signature_words(size)
        marks = jaccard.folded([flat[: words[0]], flat[words[0] :]])
        assert jaccard.overlap_bound(marks[0], size[0], marks[1], size[1]) >= len(np.intersect1d(a, b))


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (202, 201), (200, 202), (5, 5)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 130), 100), 201: 200, 202: 200}


def test_a_large_group_of_near_copies_of_many_sizes(spark):
    """Groups beyond a tile are held against one member first, then cut in blocks."""
    r = random.Random(21)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(150):
        text = base[: r.choice([70, 84, 100, 120])]
        for _ in range(r.choice([0, 1, 1, 2])):
            text = [*text]
            text[r.randrange(len(text))] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(text)))
    docs += [(500 + i, " ".join(f"y{r.randrange(10**6)}" for _ in range(30))) for i in range(10)]
    got = jaccard.join(spark.createDataFrame(docs, DOCS), 4, (85, 100), shingles_per_tile=900, sets_per_tile=8).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, 4, 85, 100)


def test_keep_one_with_clashing_names_ties_and_no_rows(spark):
    names = ["__id", "__hash", "__nth", "__goes", "key", "alone", "row", "stays", "c0", "own_id", "own_text", "root", "grp"]
    r = random.Random(3)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    rows = [(1, text, f"v{i}") for i in range(5)] + [(2, text, "v"), (3, text + " more", "w"), (4, "else", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, value string")
    for n in names:
        df = df.withColumn(n, F.concat(F.lit(n), "value"))
    out = jaccard.keep_one(df)
    got = sorted(map(tuple, out.collect()))
    assert out.columns == df.columns and [g[0] for g in got] == [1, 4] and all(g[3:] == tuple(n + g[2] for n in names) for g in got)
    assert all(sorted(map(tuple, jaccard.keep_one(df.repartition(n)).collect())) == got for n in (1, 7))
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(8)
    long = [f"w{r.randrange(10**7)}" for _ in range(150_000)]
    near = [*long[:70_000], "changed", *long[70_001:]]
    docs = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:100_000])), (4, "short text of five words")]
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(docs, DOCS)).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(docs, 5, 80, 100)


def test_a_key_of_many_rows_is_looked_up_where_it_is(spark):
    from ledgerline.llm.common import Sieve, looked_up

    big = spark.createDataFrame([(7, i) for i in range(300)] + [(i, -i) for i in range(100, 140)] + [(None, 1)], "k long, v long")
    small = big.filter("k < 130").groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("v").alias("most"))
    got = looked_up(big, small, ["k"], "rows")
    assert sorted(map(tuple, got.select("k", "v", "most").collect()), key=repr) == sorted(map(tuple, big.join(small, "k", "left").select("k", "v", "most").collect()), key=repr)
    keys = spark.range(50)
    may, cannot = Sieve(keys, F.xxhash64("id"), 50).split(spark.range(5000).withColumn("__at", F.lit("own")).withColumnRenamed("__at", "own"), F.xxhash64("id"))
    found = {x.id for x in may.collect()}
    assert found >= set(range(50)) and len(found) < 800 and len(found) + cannot.count() == 5000
