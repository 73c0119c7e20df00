"""Vantage-point trees, WARC archives and BPE against brute force and round trips."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import ann, bpe, warc

VECTORS = "vec_id long, embedding array<float>"


def nearest(rows, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in {(i, tuple(x)): (i, x) for i, x in good if i % ann.EVERY == 0}.values():
        found = sorted((-float((v * x).sum()), i) for i, x in good if i != q and len(x) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def vectors(n=400, dim=6):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=dim) * r.uniform(0.5, 3)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[40][1]) for i in range(30)]  # copies, which tie
    rows += [(2000, None), (2020, [0.0] * dim), (2040, [1.0, None] + [0.0] * (dim - 2)), (2060, [float("nan")] * dim), (2080, []), (None, [1.0] * dim), (2100, [1.0, 2.0]), (2101, [2.0, 2.0])]
    return rows


def test_exact_search_is_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("shard", F.lit("clash"))
    index, shards = ann.build_index(df, shard_rows=100)
    assert shards > 3
    got = ann.search(index, shards, df.filter("vec_id % 20 = 0"), relax=1.0, block=7).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    want = nearest(rows, ann.NEIGHBOURS)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_a_search_for_more_neighbours_than_usual_finds_all_rows_that_are_alike(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [2.0, 0.0])] * 45 + [(2, [1.0, 1.0])] * 3 + [(3, [0.5, 0.0])] * 9
    df = spark.createDataFrame(rows, VECTORS)
    index, shards = ann.build_index(df)
    for k in (50, 30, 5, 100):
        got = ann.search(index, shards, df.filter("vec_id = 0"), k=k).orderBy("rank").collect()
        assert [(r["rank"], r.vec_id) for r in got] == [(n + 1, i) for n, i in enumerate([*[1] * 45, *[2] * 3, *[3] * 9][:k])]


def test_relaxing_prunes_and_recall_stays(spark):
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(40, 4)), 60, axis=0) + r.normal(size=(2400, 4)) * 0.05
    tree, q = ann.Tree(np.arange(2400), x), np.arange(0, 2400, 40)
    truth = [set(np.argsort(-(x @ x[i]), kind="stable")[:21]) - {i} for i in q]
    work = []
    for relax in (1.0, 1.2, 3.0):
        a, ids, _, scored = tree.search(x[q], q, 20, relax)
        recall = np.mean([len(set(ids[a == n]) & t) / 20 for n, t in enumerate(truth)])
        assert recall > {1.0: 0.999, 1.2: 0.9, 3.0: 0.3}[relax]
        work.append(scored)
    assert work[0] < 0.9 * 2400 * len(q) and work[2] <= work[1] <= work[0]


def unit(n, dim, seed=4):
    """Vectors about a few centres, of length one."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(12, dim))[r.integers(0, 12, n)] * 0.6 + r.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_the_factor_that_is_fitted_prunes_and_finds_nine_in_ten(spark):
    for dim in (8, 24, 64):
        x = unit(6000, dim)
        factor = ann.best_factor(x[np.random.default_rng(1).permutation(6000)[:3000]])
        q = np.arange(0, 6000, 20)
        a, ids, _, scored = ann.Tree(np.arange(6000), x).search(x[q], q, 20, factor)
        truth = [set(np.argsort(-(x @ x[i]), kind="stable")[:21].tolist()) - {i} for i in q]
        recall = np.mean([len(set(ids[a == n].tolist()) & t) / 20 for n, t in enumerate(truth)])
        assert factor > 1 and recall >= 0.93 and scored < 0.97 * 6000 * len(q)
    rows = [(i, v.tolist()) for i, v in enumerate(unit(700, 8))] + [(1000 + i, [1.0, float(i)]) for i in range(20)] + [(1, None), (None, [1.0] * 8)]
    fitted = ann.fit_relax(spark.createDataFrame(rows, VECTORS))
    assert set(fitted) == {8} and fitted[8] in ann.FACTORS and ann.fit_relax(spark.createDataFrame([], VECTORS)) == {}


def test_blocks_of_queries_are_searched_apart_or_together(spark, tmp_path):
    x = unit(900, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    index, shards = ann.build_index(df, shard_rows=200)
    got = [sorted(map(tuple, ann.search(index, shards, df.filter("vec_id % 20 = 0"), relax=1.0, block=7, together=t).collect())) for t in (1, 3, 100)]
    assert got[0] == got[1] == got[2] and [g[:3] for g in got[0]] == [(q, n, i) for q, n, i, _ in nearest([(i, v.tolist()) for i, v in enumerate(x)], 20)]
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert ann.op5_exact(spark, str(tmp_path)).count() == 45 * 20
    found = ann.op5_recall(spark, str(tmp_path)).first()
    assert (found.queries, found.wanted) == (45, 900) and found.found >= 850


def test_no_vectors(spark):
    df = spark.createDataFrame([(0, None)], VECTORS)
    index, shards = ann.build_index(df)
    assert ann.search(index, shards, df).count() == 0


def pages():
    r = random.Random(2)
    body = [" ".join(r.choice(["<p>", "lorem", "ipsum", "é", "</p>", "dolor"]) for _ in range(60)) for _ in range(40)]
    rows = [(i, f"http://x.test/{i}?q=a b", body[i % 25]) for i in range(120)]
    return rows + [(500, None, None), (501, "", ""), (502, "u\r\nEvil: 1", "short"), (503, "u", "short"), (None, "n", body[0]), (7, "again", body[7])]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_archives_are_read_back(spark, tmp_path, broadcast):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    folder = f"file://{tmp_path}/archives"
    index = warc.write_archives(df, folder, archive_bytes=4000, broadcast_groups=broadcast).collect()
    assert len(index) == len(rows) and len({r.archive for r in index}) > 3
    got = sorted(map(tuple, warc.read_archives(spark, folder).collect()), key=repr)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = first[h] if i is not None and h in first and first[h] != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=repr)
    one = index[len(index) // 2]
    data = (tmp_path / "archives" / one.archive).read_bytes()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    spans = list(warc.frames(data))
    assert spans[0][2] and (one.start, one.start + one.length, False) in spans and spans[-1][1] == len(data)
    assert warc.parse(list(warc.records(data))[spans.index((one.start, one.start + one.length, False)) - 1])[0] == one.page_id


def test_very_long_payloads_and_ties_are_read_back(spark, tmp_path):
    long = "".join(random.Random(1).choice("abcdefgh <>") for _ in range(300_000)) * 20
    rows = [(3, "u", long), (1, "u", long), (1, "v", long), (2, "w", long + "!")]
    folder = f"file://{tmp_path}/long"
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, archive_bytes=100_000)
    assert index.select("archive").distinct().count() > 1
    got = sorted(map(tuple, warc.read_archives(spark, folder).drop("payload_digest").collect()), key=repr)
    assert got == [(1, len(long), "response", None)] * 2 + [(2, len(long) + 1, "response", None), (3, len(long), "revisit", 1)]


def test_folders_are_named_as_arrow_does():
    assert [warc.arrow_uri(f) for f in ("s3a://b/x", "s3n://b", "hdfs://n/s3a:", "file:///a")] == ["s3://b/x", "s3://b", "hdfs://n/s3a:", "file:///a"]


def test_damage_is_noticed(tmp_path):
    digest = hashlib.sha256(b"hello").hexdigest()
    good = warc.record(1, "u", b"hello", 5, digest, None, "2020-01-01T00:00:00Z")
    assert warc.parse(good) == (1, 5, digest, "response", None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(good.replace(b"hello", b"hullo"))


def test_no_pages_make_no_archive(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/none"
    assert warc.write_archives(df, folder).count() == 0 and warc.read_archives(spark, folder).count() == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.load(*bpe.vocabulary())


def test_bpe_is_tiktoken_and_round_trips(codec):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=bpe.vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("ab  \n\t'sé1.!\x1c\x85　日本 thein🙂") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 20_000, "ab" * 5000 + "the" * 3000, " " * 9999 + "x", "日本語" * 3000, "", "<|endoftext|> it's"]
    for text, coded in zip(texts, codec.encode_all(texts), strict=True):
        ids = [int(i) for c in coded for i in c[0].split(",")]
        assert ids == other.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_the_queue_and_the_strict_order_agree_on_odd_vocabularies():
    import tiktoken

    for seed in range(60):
        r = random.Random(seed)
        tokens = [bytes([i]) for i in range(256)] + sorted({bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(40)})
        ids = list(range(len(tokens)))
        r.shuffle(ids)
        codec = bpe.Codec(dict(zip(tokens, ids, strict=True)), r"\S+")
        other = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=codec.ranks, special_tokens={})
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(20)]
        want = [tuple(other.encode_ordinary(w)) for w in words]
        assert codec.merge_all([w.encode() for w in words]) == want == [codec.merge(w.encode()) for w in words]


def test_ranks_come_lowest_first():
    r = random.Random(0)
    queue, ranks = bpe.RankQueue(), [r.randrange(300_000) for _ in range(2000)]
    for x in ranks:
        queue.push(x, x)
    out = []
    while (found := queue.pop()) is not None:
        out += found[1]
    assert out == sorted(ranks)


def test_bpe_on_odd_rows(spark, codec):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, None), (None, ""), (1, "héllo wörld")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, *bpe.vocabulary()).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = codec.encode("héllo wörld")
    full = (1, len(ids), sha(",".join(map(str, ids)).encode()), sha("héllo wörld".encode()))
    assert got == [(0, 0, sha(b""), sha(b"")), full, full, (2, 0, sha(b""), sha(b""))]
    assert [bytes(r.decoded).decode() for r in bpe.tokens(df, *bpe.vocabulary()).collect()] == ["héllo wörld", "", "", "héllo wörld"]
    assert bpe.digests(df.limit(0), *bpe.vocabulary()).count() == 0
