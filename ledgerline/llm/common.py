"""Shared pieces: the shared folder, staging, hashing of words, column checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import hadoop, shared_root

#: A word, in every operator that counts words: a run of anything but ASCII
#: white space. ``bytes.split()`` cuts UTF-8 text at exactly these places.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_MIX = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``sources.tables``)."""
    return shared_root(spark)


def staged(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the
    shared folder, so that a lost executor loses nothing. For narrow rows only:
    texts are never staged."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared one, for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/ledgerline-{kind}-{uuid.uuid4().hex}"


def column(df: DataFrame, name: str, kind: str) -> Column:
    """``df``'s column as ``kind``; a null of that type if there is none."""
    if name in df.columns:
        return F.col(f"`{name}`").cast(kind)
    return F.lit(None).cast(kind)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> U64(30))) * _MIX[0]
    x = (x ^ (x >> U64(27))) * _MIX[1]
    return x ^ (x >> U64(31))


class WordIds(dict):
    """Word (bytes) -> place in ``hashes``; learns new words as they come.

    The table is forgotten once it holds ``most`` words, between batches, so
    that its memory doesn't follow the vocabulary."""

    def __init__(self, most: int = 200_000, seed: int = 0) -> None:
        super().__init__()
        self.most, self.seed = most, seed
        self._new: list[int] = []
        self._table = np.empty(0, dtype=U64)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self._new.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return at

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """64-bit hashes of ``words``, in order."""
        if len(self) > self.most:
            self.clear()
            self._table = np.empty(0, dtype=U64)
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self._new:
            self._table = np.concatenate([self._table, np.array(self._new, dtype=U64)])
            self._new = []
        return self._table[ids]


def id_crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone (53 bits of a hash)."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


#: Folders that were written, by the ``scratch`` blocks that are open.
_WRITTEN: list[list[str]] = []


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like ``staged``, for more
    rows. The ``scratch`` block around it removes it in the end."""
    path = run_dir(df.sparkSession, kind)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written in this block are removed at its end, those that ``kept`` names
    at the end of the block around it, if there is one."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            fs, at = hadoop(spark, path)
            fs.delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """``df``, a table just written, which outlives its ``scratch`` block."""
    path = _WRITTEN[-1].pop()
    if len(_WRITTEN) > 1:
        _WRITTEN[-2].append(path)
    return df


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove the written tables that ``tables`` read, before their block ends."""
    for folder in {name.rsplit("/", 1)[0] for df in tables for name in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("ledgerline-"):
            fs, at = hadoop(spark, folder)
            fs.delete(at, True)


#: A key of more than a SHARE-th of the rows is hot: fewer than SHARE keys are.
SHARE = 4096
#: 64-bit words of the largest sieve; 16 bytes each where it is broadcast.
SIEVE_WORDS = 1 << 19


def looked_up(big: DataFrame, small: DataFrame, keys: list[str], rows: str, total: int | None = None) -> DataFrame:
    """``big`` left joined with ``small``, which holds each key once and in ``rows``
    how many of ``total`` rows have it (if not given, of ``big``'s). The keys that hold more than a SHARE-th of all
    rows, fewer than SHARE, are broadcast, so that their rows stay where they are;
    the others, none of them hot, meet by a shuffle."""
    hot = staged(small.filter(F.col(rows) * F.lit(SHARE) > F.lit(big.count() if total is None else total)).drop(rows))
    if hot.isEmpty():
        return big.join(small.drop(rows), keys, "left")
    calm = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    rest = small.join(F.broadcast(hot.select(*keys)), keys, "left_anti").drop(rows)
    return big.join(F.broadcast(hot), keys).unionByName(calm.join(rest, keys, "left"))


class Sieve:
    """A bitmap of hashed keys that is broadcast: rows whose bit is not set have
    none of the keys. It holds 16 bits or more for each key up to ``SIEVE_WORDS``
    words; beyond, it lets more rows through that have none of the keys either."""

    def __init__(self, keys: DataFrame, hashed: Column, n: int) -> None:
        words = 1
        while words * 4 < n and words < SIEVE_WORDS:
            words *= 2
        self.words = words
        at = self._place(hashed)
        bit = F.expr("shiftleft(1L, cast(__at & 63 AS int))")
        self.table = keys.select(at.alias("__at")).groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))

    def _place(self, hashed: Column) -> Column:
        return F.pmod(hashed, F.lit(self.words * 64).cast("long"))

    def split(self, df: DataFrame, hashed: Column) -> tuple[DataFrame, DataFrame]:
        """(rows that may have one of the keys, rows that have none)."""
        names = df.columns
        rows = df.withColumn("__at", self._place(hashed)).withColumn("__word", F.shiftright("__at", 6))
        met = rows.join(F.broadcast(self.table), "__word", "left")
        hit = F.expr("shiftright(coalesce(__bits, 0L), cast(__at & 63 AS int)) & 1") == 1
        each = [F.col(f"`{c}`") for c in names]
        return met.filter(hit).select(*each), met.filter(~hit).select(*each)


def planned_bytes(df: DataFrame) -> int | None:
    """Bytes of ``df`` as the optimizer estimates them from its files; None where
    it has nothing to go by."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None
