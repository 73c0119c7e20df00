"""Hashed features and linear models that the classifiers share.

Training data is a bounded sample of labelled rows (``training_ids``): their ids
are chosen from the labels alone, by hash, and broadcast (the bound is the number
of ids), so no text is shuffled. Fitting runs in one task on the features of that
sample, in the order of a hash of the id, so that it can be repeated.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_tools import pieces
from .common import U64, staged

#: Labelled rows that a model is fitted on, at most.
TRAINING_ROWS = 20_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def training_rows(docs: DataFrame, labels: DataFrame, keep: Column, columns: list[str], most: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, ``columns``) of up to ``most`` labelled rows, those of the
    smallest hashes of their ids; ``keep`` tells by doc_id which rows may be
    learned from. A document or label of a null id is not learned from; of
    labels that repeat an id, one is taken, and so is one of the documents that
    do (``fit``)."""
    ids = labels.filter(F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns])
    chosen = ids.withColumn("__h", F.xxhash64("doc_id")).orderBy("__h", "doc_id").limit(most).drop("__h")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(staged(chosen)), "doc_id")


def fit(sample: DataFrame, featurise: Callable[[list[bytes | None]], list[np.ndarray]], train: Callable[[list[np.ndarray], np.ndarray], object], columns: list[str]) -> object | None:
    """``train(features, targets)`` over a bounded sample, in one task on an
    executor; the model comes back pickled. None if the sample is empty.

    Features are made where the texts are read; only they move to the task."""
    names = ", ".join(f"{c} double" for c in columns)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in pieces(batch):
                packed = pa.array([x.astype(np.int32).tobytes() for x in featurise(texts)], pa.binary())
                ids = piece.column(piece.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([ids, packed, *(piece.column(piece.schema.get_field_index(c)).cast(pa.float64()) for c in columns)], ["doc_id", "x", *columns])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, ys = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            xs += [np.frombuffer(b, dtype=np.int32) for b in batch.column(1).to_pylist()]
            ys += list(zip(*(batch.column(2 + i).to_pylist() for i in range(len(columns))), strict=True))
        if ids:
            order = sorted(range(len(ids)), key=lambda i: ((ids[i] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, len(xs[i]), xs[i].tobytes()))
            model = train([xs[i] for i in order], np.array([ys[i] for i in order], dtype=np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = sample.select("doc_id", "text", *columns).mapInArrow(features, f"doc_id long, x binary, {names}")
    # One row for each id, so that an id repeated without end stays one.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", *columns)).alias("r")).select("doc_id", "r.*")
    found = rows.repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int32)


def unique_per_text(slot: np.ndarray, of: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    """The distinct slots of each text."""
    key = np.unique((of.astype(np.int64) << bits) | slot)
    owner = key >> bits
    cuts = np.searchsorted(owner, np.arange(n + 1))
    low = (key & ((1 << bits) - 1)).astype(np.int32)
    return [low[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def sums(weights: np.ndarray, xs: list[np.ndarray]) -> np.ndarray:
    """Sum of the weights of each row of features: a sparse dot product each."""
    out = np.zeros(len(xs))
    sizes = np.array([len(x) for x in xs])
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        out[some] = np.add.reduceat(weights[np.concatenate([xs[i] for i in some])].astype(np.float64), starts)
    return out
