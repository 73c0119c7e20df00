"""The rule ledger against brute force, and the pipeline against its parts."""

import hashlib
import random
import re
from collections import Counter

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import bpe, jaccard, mixing, quality_rules, toxicity

from .test_native import water_fill

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    if not words:
        return (0,) * 5
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x1c é#|<日", max_size=80))
def test_measurements_are_brute_force(text):
    assert quality_rules.measure(text.encode())[:5] == plain(text)


def test_measurements_of_long_texts():
    r = random.Random(1)
    text = " ".join(r.choice(["x", "y", "z", *(f"w{i}" for i in range(5000))]) for _ in range(30_000))
    assert quality_rules.measure(text.encode())[:5] == plain(text)


def docs(spark):
    r = random.Random(3)
    good = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(80))) for i in range(20)]
    bad = [(100, "few words"), (101, None), (102, ""), (103, "a b c " * 40), (104, " ".join(f"x{i}###" for i in range(80))), (105, "\n".join([f"l{i % 3} " + " ".join(f"q{i % 3}{k}" for k in range(9)) for i in range(12)])), (106, " ".join(f"LOUD{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(80)))]
    return spark.createDataFrame(good + bad + [good[0], (None, good[1][1])], "doc_id long, text string").withColumn("failed", F.lit("clash"))


def test_ledger_policies_and_ablations(spark):
    df = docs(spark)
    marked = quality_rules.ledger(df).cache()
    assert marked.count() == df.count()
    kept = {r.doc_id for r in quality_rules.apply_policy(marked).collect()}
    assert kept == {None, *range(20)}
    assert {104, 106} <= {r.doc_id for r in quality_rules.apply_policy(marked, "base").collect()}
    policy = quality_rules.POLICIES[quality_rules.CURRENT]
    for r in quality_rules.ablations(marked).collect():
        bit = 1 << [x.name for x in quality_rules.RULES].index(r.rule)
        rows = [x.failed & policy.mask for x in marked.collect()]
        assert (r.n_failed, r.n_failed_alone, r.n_kept) == (sum(bool(f & bit) for f in rows), sum(f == bit for f in rows), rows.count(0))
    out = quality_rules.keep_documents(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept and set(out.select("failed").distinct().toPandas().failed) == {"clash"}
    assert quality_rules.ledger(df.limit(0)).count() == 0


def test_few_distinct_words_fail_at_every_length(spark):
    r = random.Random(11)
    rows = [(n, " ".join(f"w{r.randrange(80)}" for _ in range(n))) for n in (1999, 2000, 2001, 20_000, 60_000)]
    rows += [(-n, " ".join(f"w{k % d}" for k in r.sample(range(n), n))) for n, d in ((1999, 100), (2000, 100), (20_000, 317))]
    marked = quality_rules.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    bit = 1 << [x.name for x in quality_rules.RULES].index("few_distinct_words")
    assert {x.doc_id: bool(x.failed & bit) for x in marked.collect()} == {n: n > 0 for n, _ in rows}


def test_pipeline_stages_are_their_operators_in_order(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for i in range(160):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randint(55, 90))]
        if i % 8 == 0:
            words[3:3] = ["vilewort", "foulterm", "vilewort"]
        rows.append((i, " ".join(words), "en", f"s{i % 2}"))
    rows += [(1000 + i, rows[i][1] + " tail", "en", "s0") for i in range(1, 5)] + [(2000, "short", "en", "s1"), (2001, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "mixing", "bpe"]
    now, sf = df, str(tmp_path)
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == df.columns
        left.append(Counter(x.doc_id for x in now.collect()))
    toxic = {i for i in range(160) if i % 8 == 0}
    assert set(left[0]) == {x[0] for x in rows} - toxic
    assert set(left[1]) == set(left[0]) - {2000, 2001}
    assert set(left[2]) == set(left[1]) - {1001, 1002, 1003, 1004}
    clean = df.filter(F.col("doc_id").isin(*left[2]))
    assert left[3] == Counter({x.doc_id: x.copies for x in mixing.mix(mixing._rows(clean)).collect() if x.copies})
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(x.doc_id for x in out) == left[3]
    # Mixing and tokens again, without the operators: water filled by hand, tiktoken.
    text, source = {i: t for i, t, _, _ in rows}, {i: s for i, _, _, s in rows}
    sizes, taken = Counter(), Counter()
    for i in left[2]:
        sizes[source[i]] += len(text[i].split())
    for i, n in left[3].items():
        assert n <= 3
        taken[source[i]] += n * len(text[i].split())
    want = water_fill(sizes, mixing.WEIGHTS)
    assert all(abs(taken[s] - want[s]) <= 100 for s in want)
    codec = bpe.Codec.load(*bpe.vocabulary())
    other = tiktoken.Encoding("own", pat_str=bpe.vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})
    for x in out:
        ids = other.encode_ordinary(text[x.doc_id])
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[x.doc_id].encode()).hexdigest())
    empty = df.limit(0)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert jaccard.WIDTH == 5 and toxicity.REJECT == 0.5
