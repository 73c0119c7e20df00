"""Toxicity by a classifier chain.

Categories are predicted in order. Each has a linear model over a text's words and
over the probabilities of all categories before it. When a later model is trained,
the earlier probabilities of its training rows are out of fold: they come from
models that were fitted without the row, so that the later model learns how far
they can be trusted on new texts.

A linear model is a logistic regression over the distinct letter-words of a text
(lower-cased, marks stripped, hashed) and their beginnings, that takes in words one by one, as long as
one explains more than chance would (``fit_linear``). A word counts only if at
least ``MIN_ROWS`` training rows have it. All words of a text count, at fitting
and at scoring alike.

The categories' labels are SQL over the columns of ``labels``; the last one is
the verdict. A category without rows of both kinds gets a constant.

Defined results: null, empty and wordless texts have no features and get the
bias's probabilities; they are never rejected; without labels, every probability
is 0; repeated rows score alike; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_tools import map_texts
from .common import U64, WordIds, column, documents, mix64
from .linear import TRAINING_ROWS, fit, sigmoid, slots, training_rows

BITS = 20
#: Lengths in bytes of the beginnings of words that are features as well.
STEMS = (4, 5, 7)
#: A word or beginning that comes k times within APART * k words, anywhere in a
#: text, is a further feature: a passage has the same ones in a longer text.
AGAIN, APART = (2, 3, 5), 100
REACH = APART * max(AGAIN)
#: Text that is worked on at a time; a longer one is taken in overlapping spans.
SPAN_BYTES = 500_000
#: Folds of the out-of-fold predictions.
FOLDS = 4
#: Rows that must hold a word for it to count.
MIN_ROWS = 4
#: Part of a word's Newton step that is taken; small, so that words which stand
#: together share what they explain.
RATE = 0.2
#: Log-likelihood that a word must gain to take a step.
LEAST_GAIN = 1.5
#: Steps for each word, on average, after which a fit is held to have no end.
STEPS_PER_WORD = 200
#: Texts whose last category is at least this likely are rejected.
REJECT = 0.5


@dataclass(frozen=True)
class Category:
    name: str
    label: str  # SQL over the labels' columns


CATEGORIES = (
    Category("toxic_in_junk", "toxic = 1 AND quality = 0"),
    Category("toxic_in_prose", "toxic = 1 AND quality = 1"),
    Category("toxic", "toxic = 1"),
)

_NO_LETTERS = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalpha()), b" " * sum(not chr(b).isalpha() for b in range(128)))


class StemIds(WordIds):
    """As WordIds; a row of hashes for each word: its own, and its beginnings'."""

    def __init__(self) -> None:
        super().__init__(seed=3)
        self._table = np.empty((0, 1 + len(STEMS)), dtype=U64)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        parts = [b"%d:%s" % (k, word[:k]) for k in STEMS if len(word) > k]
        held = [xxhash.xxh3_64_intdigest(p, self.seed) for p in (word, *parts)]
        self._new.append(held + held[:1] * (1 + len(STEMS) - len(held)))
        return at

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self._table = self._table[:0]
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self._new:
            self._table = np.vstack([self._table, np.array(self._new, dtype=U64)])
            self._new = []
        return self._table[ids]


def spans(text: bytes | None) -> Iterator[list[bytes]]:
    """A text's letter-words in lists of about ``SPAN_BYTES``; each begins with the
    last ``REACH - 1`` words of the one before, so that what stands within REACH
    words stands together in one of them, however long the text is."""
    clean = text.translate(_NO_LETTERS).lower() if text else b""
    at, tail = 0, []
    while at < len(clean):
        end = clean.find(b" ", at + SPAN_BYTES)
        end = len(clean) if end < 0 else end
        words = tail + clean[at:end].split()
        if words:
            yield words
        at, tail = end, words[-(REACH - 1) :]


class Words:
    """Distinct hashed letter-words of texts, and their beginnings."""

    def __init__(self, bits: int = BITS) -> None:
        self.bits, self.words = bits, StemIds()

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        found, held, owners, size = [], [], [], 0
        for i, text in enumerate(texts):
            for words in spans(text):
                held.append(words)
                owners.append(i)
                size += len(words)
                if size >= SPAN_BYTES // 6:
                    found.append(self._features(held, owners))
                    held, owners, size = [], [], 0
        if held:
            found.append(self._features(held, owners))
        if not found:
            return [np.empty(0, dtype=np.int32) for _ in texts]
        key = np.unique(np.concatenate(found))
        cuts = np.searchsorted(key >> self.bits, np.arange(len(texts) + 1)).tolist()
        low = (key & ((1 << self.bits) - 1)).astype(np.int32)
        return [low[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _features(self, spans: list[list[bytes]], owners: list[int]) -> np.ndarray:
        """Distinct (owner, slot), as one number each."""
        n = np.array([len(s) for s in spans])
        h = self.words.hashes([w for s in spans for w in s])
        width = h.shape[1]
        at = np.repeat(np.arange(len(h), dtype=np.int32), width)
        of = np.repeat(np.repeat(np.arange(len(n)), n), width)
        key = (of << self.bits) | slots(h.ravel(), self.bits)
        # A word that is no longer than its beginning has its own hash there; once counts.
        first = np.ones((len(h), width), dtype=bool)
        first[:, 1:] = h[:, 1:] != h[:, :1]
        key, at = key[first.ravel()], at[first.ravel()]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        out = [key[new]]
        for k in AGAIN:
            again = (key[k - 1 :] == key[: len(key) - k + 1]) & (at[k - 1 :] - at[: len(key) - k + 1] < APART * k)
            often = np.unique(key[: len(key) - k + 1][again])
            slot = slots(mix64((often & ((1 << self.bits) - 1)).astype(U64) * U64(8) + U64(k)), self.bits)
            out.append((often >> self.bits << self.bits) | slot)
        key = np.concatenate(out)
        return (np.array(owners)[key >> self.bits] << self.bits) | (key & ((1 << self.bits) - 1))


class _Featuriser:
    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if not hasattr(self, "words"):
            self.words = Words()
        return self.words(texts)


@dataclass
class Linear:
    """log-odds = bias + sum of the words' weights + earlier @ log-odds."""

    at: np.ndarray  # slots that have a weight, sorted
    weight: np.ndarray
    earlier: np.ndarray
    bias: float
    _table: np.ndarray | None = field(default=None, repr=False)

    def table(self, size: int) -> np.ndarray:
        if self._table is None or len(self._table) != size:
            self._table = np.zeros(size, dtype=np.float32)
            self._table[self.at] = self.weight
        return self._table

    def predict(self, xs: list[np.ndarray], before: np.ndarray, bits: int = BITS) -> np.ndarray:
        table = self.table(1 << bits)
        words = np.array([table[x].sum(dtype=np.float64) for x in xs])
        return sigmoid(self.bias + words + before @ self.earlier)


def log_odds(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / np.clip(1 - p, 1e-4, 1 - 1e-4))


def fit_linear(xs: list[np.ndarray], before: np.ndarray, y: np.ndarray, bits: int = BITS) -> Linear:
    """A category's model from rows of features, earlier log-odds and labels.

    Forward stagewise: the bias and the earlier categories' coefficients take a
    Newton step, then the word whose own step gains most likelihood. It ends when
    no word gains more than chance would. So rows that a few words explain lend no
    weight to the other words that stand beside these (the rest of a copied text,
    or a language of which only rows of one label are known). A fit that does not
    end within ``STEPS_PER_WORD`` steps for each word is an error."""
    ones, n = float(y.sum()), len(y)
    if not 0 < ones < n:
        return Linear(np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32), np.zeros(before.shape[1]), 35.0 if ones else -35.0)
    size = 1 << bits
    total, hits = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for x, label in zip(xs, y.tolist(), strict=True):  # a row's features are distinct
        total[x] += 1
        if label:
            hits[x] += 1
    some = np.flatnonzero(total >= MIN_ROWS)
    # A word tells something if its split between the classes is unlikely by
    # chance (the likelihood ratio of its rows), for as many words as there are.
    seen, hit = total[some].astype(float), hits[some].astype(float)
    share = ones / n
    part = lambda k, p: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(seen * p, 1e-9)), 0.0)
    some = some[part(hit, share) + part(seen - hit, 1 - share) >= np.log(10.0 * max(len(some), 1))]
    place = np.full(size, -1, dtype=np.int32)
    place[some] = np.arange(len(some))
    cols = [c[c >= 0] for c in (place[x] for x in xs)]
    col, row = np.concatenate(cols), np.repeat(np.arange(n), [len(c) for c in cols])
    w = np.zeros(len(some))
    dense = np.column_stack([np.ones(n), before])
    ridge = np.concatenate([[1e-3], np.full(before.shape[1], 1.0)])
    beta = np.concatenate([[np.log(share / (1 - share))], np.zeros(before.shape[1])])
    words = np.zeros(n)
    for step_no in range(STEPS_PER_WORD * len(some) + 1):
        for _ in range(25):
            p = sigmoid(words + dense @ beta)
            slope = (dense * (p * (1 - p))[:, None]).T @ dense + np.diag(ridge)
            move = np.clip(np.linalg.solve(slope, dense.T @ (y - p) - ridge * beta), -1.0, 1.0)
            beta = beta + move
            if np.abs(move).max() < 1e-3:
                break
        p = sigmoid(words + dense @ beta)
        if not len(some):
            break
        g = np.bincount(col, weights=(y - p)[row], minlength=len(some))
        h = np.bincount(col, weights=(p * (1 - p))[row], minlength=len(some)) + 1.0
        gain = g * g / (2 * h)
        j = int(gain.argmax())
        if gain[j] < LEAST_GAIN:
            break
        if step_no == STEPS_PER_WORD * len(some):
            raise RuntimeError(f"words still gain after {step_no} steps over {len(some)} words")
        step = float(np.clip(RATE * g[j] / h[j], -1.0, 1.0))
        w[j] += step
        words += np.bincount(row[col == j], minlength=n) * step
    kept = w != 0
    return Linear(some[kept].astype(np.int32), w[kept].astype(np.float32), beta[1:], float(beta[0]))


def train_chain(xs: list[np.ndarray], ys: np.ndarray, bits: int = BITS) -> list[Linear]:
    """The models of all categories, in order."""
    fold = np.arange(len(xs)) % FOLDS
    before = np.empty((len(xs), 0))
    chain = []
    for c in range(ys.shape[1]):
        y = ys[:, c]
        chain.append(fit_linear(xs, before, y, bits))
        out = np.zeros(len(xs))
        for f in range(FOLDS):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(own) and len(rest):
                part = fit_linear([xs[i] for i in rest], before[rest], y[rest], bits)
                out[own] = part.predict([xs[i] for i in own], before[own], bits)
        before = np.column_stack([before, log_odds(out)])
    return chain


def predict_chain(chain: list[Linear], xs: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Probabilities (texts x categories), each category fed with those before."""
    before = np.empty((len(xs), 0))
    out = []
    for model in chain:
        p = model.predict(xs, before, bits)
        out.append(p)
        before = np.column_stack([before, log_odds(p)])
    return np.column_stack(out) if out else np.empty((len(xs), 0))


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...] = CATEGORIES, keep=None, most: int = TRAINING_ROWS) -> list[Linear] | None:
    """The chain, from a bounded sample of labelled rows; rows whose label is
    unknown for any category are left out."""
    named = [F.expr(c.label).cast("double").alias(f"y{i}") for i, c in enumerate(categories)]
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *named).dropna()
    targets = [f"y{i}" for i in range(len(categories))]
    sample = training_rows(docs, marked, F.lit(True) if keep is None else keep, targets, most)
    return fit(sample, _Featuriser(), train_chain, targets)


def _scores(docs: DataFrame, chain: list[Linear] | None, categories: tuple[Category, ...], carried: dict[str, str]) -> DataFrame:
    """``carried`` columns (name in the frame -> type), with p_<category> each."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c.name}" for c in categories]

    def make():
        words, models = Words(), held.value

        def work(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            xs = words(texts)
            p = predict_chain(models, xs) if models else np.zeros((len(texts), len(names)))
            p[[not len(x) for x in xs]] = 0.0
            own = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(p[:, i], pa.float64()) for i in range(len(names)))], [*carried, *names])

        return work

    return map_texts(docs, make, ", ".join([*(f"{c} {t}" for c, t in carried.items()), *(f"{c} double" for c in names)]))


def score(docs: DataFrame, chain: list[Linear] | None, categories: tuple[Category, ...] = CATEGORIES) -> DataFrame:
    """(doc_id, p_<category> .., toxic boolean) of every whole text."""
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    out = _scores(rows, chain, categories, {"doc_id": "long"})
    return out.withColumn("toxic", F.col(f"p_{categories[-1].name}") >= REJECT)


def keep_clean(docs: DataFrame, chain: list[Linear] | None, categories: tuple[Category, ...] = CATEGORIES) -> DataFrame:
    """``docs``, all columns kept, without the texts that the chain rejects. The
    verdict is reached beside each row, so nothing is shuffled."""
    names = docs.columns
    inner = {c: "text" if c == "text" else f"__c{i}" for i, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in names])
    if "text" not in names:
        raise ValueError("no column text")
    carried = {inner[c]: docs.schema[c].dataType.simpleString() for c in names}
    out = _scores(rows, chain, categories, carried)
    return out.filter(F.col(f"p_{categories[-1].name}") < REJECT).select(*[F.col(inner[c]).alias(c) for c in names])


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a chain learned from the labels."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit_toxicity(docs, labels))
