"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

A text's features are the distinct hashed words and pairs of words in it, each as
it stands and by its shape (letters of one case, digits and marks folded), so that
kinds of junk the sample doesn't spell out are known by their look. Each feature
of a row counts ``1 / sqrt(number of features)``, so long texts don't shout.
Rows of the commoner label weigh less in training, as ``BALANCE`` says.

Learns only from texts and labels of the rows it is given; labels, language,
source and id are never inputs of a score. Whole texts are read. Defined results:
null and empty texts have no feature but the bias and get its score; without any
label to learn from, every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_tools import map_texts
from .common import U64, WordIds, column, documents, id_crc_mod, mix64
from .linear import TRAINING_ROWS, fit, sigmoid, slots, sums, training_rows, unique_per_text

BITS = 18
#: Scores from here on predict label 1.
THRESHOLD = 0.3
#: Rows of the commoner label weigh (rarer / commoner) to this power in training.
BALANCE = 0.75
#: Rows of crc32(doc_id) modulo FOLDS equal to HELD_OUT are not learned from.
FOLDS, HELD_OUT = 5, 0

_SHAPE = bytes.maketrans(
    bytes(range(256)),
    bytes(
        ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b
        for b in range(256)
    ),
)


_RUNS = re.compile(rb"(.)\1{2,}", re.S)


def shape(word: bytes) -> bytes:
    """The word's look, the whole of it: runs of one kind shortened to two."""
    return _RUNS.sub(rb"\1\1", word.translate(_SHAPE))


class Features:
    """Distinct hashed words and word pairs of texts, as spelt and by shape."""

    def __init__(self, bits: int = BITS) -> None:
        self.bits, self.words, self.shapes = bits, WordIds(seed=1), ShapeIds()

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        split = [t.split() if t else [] for t in texts]
        n = np.array([len(s) for s in split])
        words = [w for s in split for w in s]
        if not words:
            return [np.empty(0, dtype=np.int32) for _ in texts]
        of = np.repeat(np.arange(len(n)), n)
        parts, owners = [], []
        beside = of[1:] == of[:-1]
        for h in (self.words.hashes(words), self.shapes.hashes(words)):
            parts += [h, mix64(h[:-1][beside] * U64(3) + h[1:][beside])]
            owners += [of, of[1:][beside]]
        return unique_per_text(slots(np.concatenate(parts), self.bits), np.concatenate(owners), len(texts), self.bits)


class ShapeIds(WordIds):
    """As WordIds, with the hash of each word's shape."""

    def __init__(self) -> None:
        super().__init__(seed=2)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self._new.append(xxhash.xxh3_64_intdigest(shape(word), 2))
        return at


class FollowTheLeader:
    """FTRL-proximal logistic regression (per-coordinate rates, L1 and L2)."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 0.1, l1: float = 0.002, l2: float = 0.05) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def update(self, x: np.ndarray, y: float, importance: float) -> None:
        at = np.append(x, self.bias)
        value = np.append(np.full(len(x), 1.0 / np.sqrt(max(len(x), 1))), 1.0)
        w = self.weights(at)
        g = (sigmoid(np.array([w @ value]))[0] - y) * importance * value
        new = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = new

    def fixed(self) -> tuple[np.ndarray, float]:
        w = self.weights(np.arange(self.bias + 1))
        return w[:-1].astype(np.float32), float(w[-1])


def train(xs: list[np.ndarray], ys: np.ndarray, bits: int = BITS, epochs: int = 8) -> tuple[np.ndarray, float]:
    """Weights and bias of P(label 1); rows come in a repeatable order, which a
    fixed permutation changes for each epoch."""
    model, y = FollowTheLeader(1 << bits), ys[:, 0]
    ones = max(1.0, float(y.sum()))
    zeros = max(1.0, float(len(y) - y.sum()))
    weigh = {1.0: min(1.0, (zeros / ones) ** BALANCE), 0.0: min(1.0, (ones / zeros) ** BALANCE)}
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(xs)).tolist():
            model.update(xs[i], y[i], weigh[float(y[i])])
    return model.fixed()


def fit_quality(docs: DataFrame, labels: DataFrame, keep, most: int = TRAINING_ROWS) -> tuple[np.ndarray, float] | None:
    """The model of ``labels.quality`` (0 or 1; nulls are left out)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter("quality IN (0, 1)")
    sample = training_rows(docs, marked, keep, ["quality"], most)
    return fit(sample, _Featuriser(), train, ["quality"])


class _Featuriser:
    """Features made in the worker that unpickles this."""

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if not hasattr(self, "features"):
            self.features = Features()
        return self.features(texts)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """(doc_id, score) of every whole text. The model's size is fixed (2 to the
    power of BITS weights), so it is broadcast."""
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features = Features()
        weights, bias = held.value if held.value is not None else (np.zeros(1 << BITS, dtype=np.float32), 0.0)

        def work(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            xs = features(texts)
            size = np.sqrt(np.maximum([len(x) for x in xs], 1))
            p = sigmoid(sums(weights, xs) / size + bias)
            return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(p, pa.float64())], ["doc_id", "score"])

        return work

    return map_texts(rows, make, "doc_id long, score double")


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the rows of the other folds."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, id_crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(id_crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
