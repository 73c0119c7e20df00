"""Language, toxicity and quality models: held-out accuracy and odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import langid, linear, quality_model, toxicity

SYLLABLES = {"aa": ["ka", "to", "ri", "mu", "shi", "no"], "bb": ["str", "ung", "ach", "ver", "ein", "kz"], "cc": ["eau", "ille", "é", "tion", "ou", "que"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages():
    r = random.Random(4)
    rows = [(i, prose(r, lang := r.choice("aa bb cc".split()), r.randint(5, 80)), lang, lang) for i in range(240)]
    mixed = [(1000 + i, prose(r, "aa", 60) + " " + prose(r, "bb", 40), None, "aa") for i in range(10)]
    odd = [(2000, None, "aa", "und"), (2001, "", "bb", "und"), (2002, "12 !! --", None, "und"), (None, prose(r, "cc", 30), None, "cc"), (5, rows[5][1], rows[5][2], rows[5][2])]
    return rows + mixed + odd


def test_languages_are_told_apart(spark, languages, tmp_path):
    df = spark.createDataFrame([x[:3] for x in languages], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = langid.op2_language_mixture(spark, str(tmp_path)).collect()
    want = {(d, t): w for d, t, _, w in languages}
    assert len(out) == len(languages)
    by_id = {d: w for d, _, _, w in languages}
    assert np.mean([r.lang_pred == by_id[r.doc_id] for r in out]) > 0.97 and len(want) > 200
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in out)


def test_a_mixture_has_its_proportions(spark, languages):
    df = spark.createDataFrame([x[:3] for x in languages], "doc_id long, text string, lang string")
    got = [r for r in langid.identify(df, langid.fit_languages(df)).collect() if r.doc_id and 1000 <= r.doc_id < 1010]
    assert all(set(r.langs) == {"aa", "bb"} and abs(r.langs["aa"] - 0.6) < 0.1 and abs(r.score - r.langs["aa"]) < 1e-9 for r in got)


def test_nothing_learned_is_und(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.fit_languages(df) is None
    assert langid.identify(df, None).first()[1:3] == ("und", 0.0)
    assert langid.identify(df.limit(0), None).count() == 0


def labelled(r, n):
    rows = []
    for i in range(n):
        words = [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randint(0, 30)}" .rstrip("0123456789") + r.choice(["", "en", "ly"]) for _ in range(r.randint(40, 120))]
        toxic, junk = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["vilewort", "foulterm", "nastyname"])
        if junk:
            words = [w + r.choice(["&&&", "###", "%%%"]) for w in words]
        rows.append((i, " ".join(words), int(not junk), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def marked(spark, tmp_path_factory):
    rows = labelled(random.Random(8), 400)
    folder = str(tmp_path_factory.mktemp("labelled"))
    docs = [(i, t) for i, t, _, _ in rows] + [(9000, None), (9001, ""), (9002, "&&& ###"), (3, rows[3][1]), (None, "plain words here")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("p_toxic", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i % 2 == 0 or i % 3 == 0] + [(None, 1, 0), (2, None, 1), (77777, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {i: (q, t) for i, _, q, t in rows}, len(docs)


def test_quality_is_learned(spark, marked):
    folder, truth, n = marked
    out = quality_model.op6_quality_ftrl(spark, folder).collect()
    assert len(out) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id][0] for r in held]) > 0.95
    again = {(r.doc_id, r.score) for r in quality_model.op6_quality_ftrl(spark, folder).collect()}
    assert again == {(r.doc_id, r.score) for r in out}


def test_toxic_documents_are_caught_and_clean_ones_left(spark, marked):
    folder, truth, n = marked
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    chain = toxicity.fit_toxicity(docs, labels)
    out = toxicity.score(docs, chain).collect()
    assert len(out) == n
    unseen = [r for r in out if r.doc_id in truth and r.doc_id % 2 and r.doc_id % 3]
    assert unseen and all(r.toxic == bool(truth[r.doc_id][1]) for r in unseen)
    assert not any(r.toxic for r in out if r.doc_id is None or r.doc_id >= 9000)
    kept = toxicity.keep_clean(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in out)


def test_every_word_of_a_text_counts_as_it_was_fitted():
    model = toxicity.Linear(np.arange(40, dtype=np.int32), np.repeat([0.5, -0.6], 20).astype(np.float32), np.zeros(0), -8.0)
    xs = [np.arange(20, dtype=np.int32), np.arange(40, dtype=np.int32), np.arange(50, 60, dtype=np.int32), np.empty(0, dtype=np.int32)]
    assert np.allclose(model.predict(xs, np.empty((4, 0)), bits=6), linear.sigmoid(np.array([2.0, -10.0, -8.0, -8.0])), rtol=1e-6)


def many_words(words=150, each=10):
    xs = [np.array([w], dtype=np.int32) for w in range(words) for _ in range(each)] + [np.empty(0, dtype=np.int32)] * (3 * words * each)
    return xs, np.repeat([1.0, 0.0], [words * each, 3 * words * each])


def test_words_are_taken_in_until_none_gains():
    xs, y = many_words()
    model = toxicity.fit_linear(xs, np.empty((len(xs), 0)), y, bits=10)
    p = model.predict(xs, np.empty((len(xs), 0)), bits=10)
    some = [len(x) > 0 for x in xs]
    g, h = np.bincount(np.concatenate(xs), weights=(y - p)[some]), np.bincount(np.concatenate(xs), weights=(p * (1 - p))[some]) + 1.0
    assert len(model.at) == 150 and (g * g / (2 * h)).max() < toxicity.LEAST_GAIN


def test_a_fit_that_is_cut_short_is_an_error(monkeypatch):
    xs, y = many_words(20)
    monkeypatch.setattr(toxicity, "STEPS_PER_WORD", 1)
    with pytest.raises(RuntimeError, match="still gain"):
        toxicity.fit_linear(xs, np.empty((len(xs), 0)), y, bits=10)


def test_without_labels_no_one_is_judged(spark):
    docs = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit_toxicity(docs, none) is None and toxicity.score(docs, None).first().toxic is False
    assert quality_model.score(docs, quality_model.fit_quality(docs, none, F.lit(True))).first().score == 0.5


def test_later_models_are_trained_on_out_of_fold_predictions():
    r = np.random.default_rng(0)
    first = r.integers(0, 2, 200).astype(float)
    xs = [np.unique(np.append(r.integers(10, 90, 5), 1 if y else 2)).astype(np.int32) for y in first]
    chain = toxicity.train_chain(xs, np.column_stack([first, first]), bits=8)
    p = toxicity.predict_chain(chain, xs, bits=8)
    assert chain[1].earlier[0] > 0 and ((p[:, 1] > 0.5) == (first > 0)).all()


def plain_grams(word):
    w = "\0" + word + "\0"
    return [*word, *(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2))]


def plain_em(like, words, langs, steps):
    """Proportions of a document's languages and its log-likelihood, word by word."""
    share = dict.fromkeys(langs, 1 / len(langs))
    for _ in range(steps):
        joint = [{x: share[x] * math.exp(like[w][x]) for x in langs} for w in words]
        share = {x: sum(j[x] / sum(j.values()) for j in joint) / len(words) for x in langs}
    return share, sum(math.log(sum(share[x] * math.exp(like[w][x]) for x in langs)) for w in words)


def test_languages_against_plain_counts_and_plain_em(spark, languages):
    """The whole of it again, with dicts: counts of n-grams by their text, EM word by word."""
    rows = [x for x in languages if x[0] is not None and x[1] and x[2]]
    df = spark.createDataFrame([x[:3] for x in languages], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, langid.fit_languages(df)).collect() if r.doc_id is not None}
    counts = defaultdict(Counter)
    for _, text, lang, _ in {x[:3]: x for x in rows}.values():
        for w in text.lower().split():
            counts[lang].update(plain_grams(w))
    names, total = sorted(counts), {x: sum(counts[x].values()) for x in counts}
    chance = lambda x, g: math.log((counts[x][g] + 0.1) / (total[x] + 0.1 * (1 << langid.BITS)))
    like = {}
    for w in {w for _, t, _, _ in languages for w in (t or "").lower().split() if w.isalpha()}:
        own = {x: sum(chance(x, g) for g in plain_grams(w)) * (len(w) + 1) / (3 * len(w) + 1) for x in names}
        like[w] = {x: math.log(math.exp(v - max(own.values())) + langid.NOISE) for x, v in own.items()}
    seen = 0
    for i, text, _, _ in languages:
        words = (text or "").lower().split()
        if i is None or not words or not all(w in like for w in words):
            continue
        single = {x: sum(like[w][x] for w in words) for x in names}
        best = max(names, key=lambda x: (single[x], -names.index(x)))
        shares, value = {best: 1.0}, single[best]
        cost = langid.PENALTY * 0.5 * math.log(len(words) + 1)
        every, _ = plain_em(like, words, names, langid.STEPS)
        order = sorted(names, key=lambda x: -every[x])
        for m in range(2, len(names) + 1):
            part, fit = plain_em(like, words, order[:m], langid.STEPS)
            if fit - cost * (m - 1) > value:
                shares, value = part, fit - cost * (m - 1)
        r = got[i]
        seen += 1
        # Hashed n-grams may meet in a slot, which moves proportions by little.
        assert r.lang_pred == max(names, key=lambda x: (shares.get(x, 0), -names.index(x)))
        assert set(r.langs) == {x for x, v in shares.items() if v > 0} and all(abs(r.langs[x] - shares[x]) < 0.02 for x in r.langs)
    assert seen > 200


def test_equal_proportions_go_to_the_first_language():
    share = langid.infer(np.log(np.array([[1.0, 1e-9], [1e-9, 1.0]] * 40)), np.zeros(80, dtype=int), 1)
    assert abs(share[0, 0] - 0.5) < 1e-9 and share[0].argmax() == 0


def test_characters_not_bytes_make_the_ngrams():
    slot, of, n = langid.grams(["é".encode(), b"ab", "日本語".encode()])
    assert n.tolist() == [1, 2, 3] and np.bincount(of).tolist() == [4, 7, 10]


def test_an_odd_word_does_not_decide(spark, languages):
    df = spark.createDataFrame([x[:3] for x in languages], "doc_id long, text string, lang string")
    text = prose(random.Random(3), "aa", 30)
    odd = spark.createDataFrame([(1, f"{text} {'strungachverein' * 5000}"), (2, " ".join([text] * 5000))], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(odd, langid.fit_languages(df)).collect()] == ["aa", "aa"]


def test_a_row_repeated_without_end_is_one_training_row(spark):
    r = random.Random(6)
    rows = [(i, prose(r, "aa", 30), "aa") for i in range(20)] + [(50 + i, prose(r, "bb", 30), "bb") for i in range(20)]
    one, many = (spark.createDataFrame(x, "doc_id long, text string, lang string") for x in (rows, rows + [rows[0]] * 500))
    (a, x), (b, y) = langid.fit_languages(one), langid.fit_languages(many)
    assert a == b and (x == y).all()
    assert langid.fit_languages(many, most=5)[1].shape[1] == 1 << langid.BITS


def plain_ftrl(rows, epochs, alpha=1.0, beta=0.1, l1=0.002, l2=0.05):
    """Follow-the-regularised-leader over dicts of named features."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        bound = 0.0 if f == "bias" else l1
        if abs(z[f]) <= bound:
            return 0.0
        return -(z[f] - math.copysign(bound, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    ones = sum(y for _, y in rows)
    weigh = {1: min(1.0, ((len(rows) - ones) / ones) ** quality_model.BALANCE), 0: min(1.0, (ones / (len(rows) - ones)) ** quality_model.BALANCE)}
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            features, y = rows[i]
            x = {**dict.fromkeys(features, 1 / math.sqrt(len(features))), "bias": 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * weigh[y] * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return weight


def plain_features(text):
    words = text.encode().split()
    looks = [re.sub(rb"(.)\1{2,}", rb"\1\1", re.sub(rb"[A-Z]", b"A", re.sub(rb"[0-9]", b"0", re.sub(rb"[a-z\x80-\xff]", b"a", w.replace(b"A", b"\x01")).replace(b"\x01", b"A")))) for w in words]
    out = set()
    for kind, held in (("w", words), ("s", looks)):
        out |= {(kind, w) for w in held} | {(kind, a, b) for a, b in zip(held, held[1:], strict=False)}
    return out


def test_quality_against_plain_ftrl():
    """Scores of a few dozen rows, against FTRL over features that aren't hashed."""
    texts = [(t, q) for _, t, q, _ in labelled(random.Random(5), 60)]
    bits = 26  # so that hardly any two features meet
    xs = quality_model.Features(bits)([t.encode() for t, _ in texts])
    assert [len(x) for x in xs] == [len(plain_features(t)) for t, _ in texts]
    weights, bias = quality_model.train(xs[:40], np.array([[q] for _, q in texts[:40]], dtype=float), bits, epochs=3)
    weight = plain_ftrl([(sorted(plain_features(t), key=repr), q) for t, q in texts[:40]], 3)
    got = linear.sigmoid(linear.sums(weights, xs) / np.sqrt([len(x) for x in xs]) + bias)
    for (t, _), p in zip(texts, got, strict=True):
        f = plain_features(t)
        assert abs(p - 1 / (1 + math.exp(-sum(map(weight, f)) / math.sqrt(len(f)) - weight("bias")))) < 1e-3


def test_the_whole_of_a_word_is_its_shape():
    assert quality_model.shape(b"Abc123##" * 4) == b"Aaa00##" * 4 and quality_model.shape(b"aaaa" * 10 + b"!") == b"aa!"


def plain_chain(rows, ys, folds):
    """A classifier chain over sets of features, one update at a time."""

    def fit(rows, before, y):
        n, ones = len(rows), sum(y)
        if not 0 < ones < n:
            return {}, [0.0] * len(before[0]), 35.0 if ones else -35.0
        seen, hit = Counter(f for r in rows for f in r), Counter(f for r, v in zip(rows, y, strict=True) if v for f in r)
        some = sorted(f for f in seen if seen[f] >= toxicity.MIN_ROWS)
        share = ones / n
        term = lambda k, p, f: k * math.log(k / (seen[f] * p)) if k else 0.0
        some = [f for f in some if term(hit[f], share, f) + term(seen[f] - hit[f], 1 - share, f) >= math.log(10.0 * max(len(some), 1))]
        w, beta = dict.fromkeys(some, 0.0), [math.log(share / (1 - share))] + [0.0] * len(before[0])
        ridge = [1e-3] + [1.0] * len(before[0])
        while True:
            dense = [[1.0, *b] for b in before]
            words = [sum(w.get(f, 0.0) for f in r) for r in rows]
            odds = lambda: [1 / (1 + math.exp(-(a + sum(x * c for x, c in zip(d, beta, strict=True))))) for a, d in zip(words, dense, strict=True)]  # noqa: B023, E731
            for _ in range(25):
                p = odds()
                k = len(beta)
                slope = [[sum(q * (1 - q) * d[i] * d[j] for q, d in zip(p, dense, strict=True)) + (ridge[i] if i == j else 0) for j in range(k)] for i in range(k)]
                pull = [sum((v - q) * d[i] for v, q, d in zip(y, p, dense, strict=True)) - ridge[i] * beta[i] for i in range(k)]
                move = [max(-1.0, min(1.0, m)) for m in np.linalg.solve(slope, pull)]
                beta = [b + m for b, m in zip(beta, move, strict=True)]
                if max(map(abs, move)) < 1e-3:
                    break
            p = odds()
            g = {f: sum(v - q for v, q, r in zip(y, p, rows, strict=True) if f in r) for f in some}
            h = {f: sum(q * (1 - q) for q, r in zip(p, rows, strict=True) if f in r) + 1.0 for f in some}
            best = max(some, key=lambda f: (g[f] * g[f] / (2 * h[f]), -f), default=None)
            if best is None or g[best] ** 2 / (2 * h[best]) < toxicity.LEAST_GAIN:
                return {f: v for f, v in w.items() if v}, beta[1:], beta[0]
            w[best] += max(-1.0, min(1.0, toxicity.RATE * g[best] / h[best]))

    def predict(model, rows, before):
        w, earlier, bias = model
        return [1 / (1 + math.exp(-max(-35.0, min(35.0, bias + sum(w.get(f, 0.0) for f in r) + sum(x * c for x, c in zip(b, earlier, strict=True)))))) for r, b in zip(rows, before, strict=True)]

    odds = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / min(max(1 - p, 1e-4), 1 - 1e-4))
    before, chain = [[] for _ in rows], []
    for c in range(len(ys[0])):
        y = [v[c] for v in ys]
        chain.append(fit(rows, before, y))
        out = [0.0] * len(rows)
        for fold in range(folds):
            rest = [i for i in range(len(rows)) if i % folds != fold]
            own = [i for i in range(len(rows)) if i % folds == fold]
            part = fit([rows[i] for i in rest], [before[i] for i in rest], [y[i] for i in rest])
            for i, p in zip(own, predict(part, [rows[i] for i in own], [before[i] for i in own]), strict=True):
                out[i] = p
        before = [[*b, odds(p)] for b, p in zip(before, out, strict=True)]

    def score(rows):
        before, p = [[] for _ in rows], []
        for model in chain:
            p = predict(model, rows, before)
            before = [[*b, odds(x)] for b, x in zip(before, p, strict=True)]
        return p

    return score


def test_toxicity_against_a_plain_chain():
    r = random.Random(12)
    toxic = [r.random() < 0.3 for _ in range(90)]
    junk = [r.random() < 0.3 for _ in range(90)]
    rows = [sorted({r.randrange(20, 120) for _ in range(12)} | ({r.choice([1, 2])} if t else set()) | ({5} if j else set())) for t, j in zip(toxic, junk, strict=True)]
    ys = [[float(t and j), float(t and not j), float(t)] for t, j in zip(toxic, junk, strict=True)]
    xs = [np.array(x, dtype=np.int32) for x in rows]
    got = toxicity.predict_chain(toxicity.train_chain(xs, np.array(ys), bits=7), xs, bits=7)[:, -1]
    want = plain_chain([set(x) for x in rows], ys, toxicity.FOLDS)([set(x) for x in rows])
    assert np.abs(got - np.array(want)).max() < 1e-4 and ((got > 0.5) == np.array(toxic)).mean() > 0.9


def test_empty_tables_and_very_long_texts_of_the_classifiers(spark, marked):
    folder, _, _ = marked
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    chain, model = toxicity.fit_toxicity(docs, labels), quality_model.fit_quality(docs, labels, F.lit(True))
    assert toxicity.score(docs.limit(0), chain).count() == toxicity.keep_clean(docs.limit(0), chain).count() == quality_model.score(docs.limit(0), model).count() == 0
    clean = " ".join(t for _, t, q, x in labelled(random.Random(2), 400) if q and not x)
    junk = " ".join(w + "&&&" for w in clean.split())
    vile = clean + " vilewort foulterm nastyname vilewort foulterm nastyname " + clean
    long = spark.createDataFrame([(1, clean * 20), (2, junk * 10), (3, vile)], "doc_id long, text string")
    assert {r.doc_id: r.toxic for r in toxicity.score(long, chain).collect()} == {1: False, 2: False, 3: True}
    scores = {r.doc_id: r.score for r in quality_model.score(long, model).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_a_sparse_dot_product():
    w = np.arange(10, dtype=np.float32)
    xs = [np.array([1, 2], dtype=np.int32), np.empty(0, dtype=np.int32), np.array([9], dtype=np.int32)]
    assert linear.sums(w, xs).tolist() == [3, 0, 9]


def test_a_passage_has_the_same_features_in_a_longer_text():
    r = random.Random(1)
    passage = " ".join(r.choice(["venomous", "venomly", "venoming", "plain"]) for _ in range(40))
    long = " ".join(prose(r, "aa", 3000) for _ in range(15))
    words = toxicity.Words()
    alone, inside = words([passage.encode(), f"{long} {passage} {long}".encode()])
    assert len(long) > toxicity.SPAN_BYTES // 2 and set(alone.tolist()) <= set(inside.tolist())


def test_spans_hold_every_stretch_of_words(monkeypatch):
    monkeypatch.setattr(toxicity, "SPAN_BYTES", 60)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)).encode()
    words, reach = text.split(), toxicity.REACH
    held = list(toxicity.spans(text))
    assert held[0] + [w for s in held[1:] for w in s[reach - 1 :]] == words or len(held[1]) < reach
    windows = {tuple(s[i : i + reach]) for s in held for i in range(len(s) - reach + 1)}
    assert windows == {tuple(words[i : i + reach]) for i in range(len(words) - reach + 1)}
    assert not list(toxicity.spans(None)) and not list(toxicity.spans(b" 12 .. "))


def test_a_long_text_takes_bounded_memory():
    """Peak of one worker over 8 MB of new words, above what it begins with."""
    import subprocess
    import sys

    code = (
        "import resource, random\nfrom ledgerline.llm import toxicity\n"
        "r = random.Random(0)\ntext = ' '.join(''.join(r.choice('abcdefghij') for _ in range(5)) for _ in range(1_350_000)).encode()\n"
        "peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024\nwords, before = toxicity.Words(), peak()\n"
        "words([text])\nprint(len(text), peak() - before)"
    )
    size, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=None).stdout.split())
    assert size > 8_000_000 and grown < 250
