"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt by a hash of their id to shards of a bounded number of rows;
each shard's tree splits its points at the median distance to a vantage point and
keeps for each half the least and greatest distance. A search goes down to each
query's own leaf first, then through the tree: a half whose distances can't hold
anything nearer than the worst neighbour found so far is passed over. The
triangle inequality gives the bound; ``relax`` multiplies it, so that above 1
halves are passed over that might hold a neighbour, and 1 is exact search. The
factor is the largest that finds ``RECALL`` of the nearest in a bounded sample.

The measure is the largest inner product. Vectors are lifted by one coordinate to
the length of their shard's longest, where the nearest in Euclidean distance are
those of the largest inner product; that distance is a metric, so trees apply.

Queries are searched in blocks, a block and a tree at a time: matrix products
find candidates, with a margin for rounding; the score of what is returned is
summed for each pair by itself, so equal vectors score equal and ties are settled
by id. Every row is indexed; rows alike in id and vector are one entry with their
number.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, and rows of a null id, take no part; vectors of another length than
the query's aren't its candidates; rows of the query's own id aren't either;
repeated candidate rows are candidates each, repeated query rows are one query;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, staged

#: Rows of a shard, and queries of a block, on average.
SHARD_ROWS, BLOCK_QUERIES = 8192, 2048
#: Blocks that one task searches in a shard's tree, one after the other.
BLOCKS_TOGETHER = 8
LEAF_ROWS = 128
NEIGHBOURS = 20
#: Queries are the rows whose id is divisible by this.
EVERY = 20
#: Factors of the pruning bound that ``fit_relax`` tries; 1 is exact.
FACTORS = (1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)
#: Part of the nearest that a factor must find to be taken, and the sample (vectors,
#: and queries among them) on which it is measured.
RECALL, SAMPLE_ROWS, SAMPLE_QUERIES = 0.97, 8192, 256


def _usable(v: Column) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


class Tree:
    """A vantage-point tree over rows (id, vector), each of them ``times`` rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS, times: np.ndarray | None = None) -> None:
        norm2 = (vectors * vectors).sum(axis=1)
        self.longest2 = float(norm2.max())
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(self.longest2 - norm2, 0.0))])
        order = np.argsort(ids, kind="stable")
        place: list[np.ndarray] = []
        # A node: (vantage, child, child) of (least, greatest, node); or a leaf's span.
        self.nodes: list[tuple] = []
        filled = 0

        def build(rows: np.ndarray) -> int:
            nonlocal filled
            at = len(self.nodes)
            self.nodes.append(())
            if len(rows) > leaf:
                first = ((lifted[rows] - lifted[rows[0]]) ** 2).sum(axis=1)
                vantage = rows[int(first.argmax())]
                d = np.sqrt(((lifted[rows] - lifted[vantage]) ** 2).sum(axis=1))
                near = d <= np.median(d)
                if near.all():
                    near = d < d.max()
                if near.any() and not near.all():
                    halves = []
                    for half in (near, ~near):
                        halves.append((float(d[half].min()), float(d[half].max()), build(rows[half])))
                    self.nodes[at] = (vectors[vantage], *halves)
                    return at
            place.append(rows)
            self.nodes[at] = (filled, filled + len(rows))
            filled += len(rows)
            return at

        build(order)
        kept = np.concatenate(place)
        self.ids, self.vectors = ids[kept], np.ascontiguousarray(vectors[kept])
        self.times = np.ones(len(kept), dtype=np.int64) if times is None else times[kept]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, relax: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, id, score) of the k nearest of each query, the shard's own, in
        order of (query, -score, id); and the number of pairs that were scored."""
        n = len(queries)
        length2 = (queries * queries).sum(axis=1)
        margin = 1e-9 * (1.0 + np.sqrt(length2 * self.longest2))
        best = np.full((n, k), -np.inf)
        seen = np.zeros((n, len(self.nodes)), dtype=bool)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        scored = 0

        def leaf(node: int, act: np.ndarray) -> None:
            nonlocal scored
            act = act[~seen[act, node]]
            seen[act, node] = True
            a, b = self.nodes[node]
            for x in range(a, b, 4096):
                y = min(b, x + 4096)
                if not len(act):
                    return
                s = queries[act] @ self.vectors[x:y].T
                scored += s.size
                s[self.ids[x:y][None, :] == own[act][:, None]] = -np.inf
                q, p = np.nonzero(s >= (best[act, 0] - margin[act])[:, None])
                if len(q):
                    keep = s[q, p]
                    q, p, keep = q[keep > -np.inf], p[keep > -np.inf], keep[keep > -np.inf]
                    hits.append((act[q], p + x, keep))
                    both = np.concatenate([best[act], s], axis=1)
                    best[act] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)

        def distance(act: np.ndarray, vantage: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(length2[act] + self.longest2 - 2.0 * (queries[act] @ vantage), 0.0))

        def descend(node: int, act: np.ndarray) -> None:
            if len(self.nodes[node]) == 2:
                leaf(node, act)
                return
            vantage, (lo1, hi1, one), (lo2, hi2, two) = self.nodes[node]
            d = distance(act, vantage)
            first = d <= (hi1 + lo2) / 2
            for child, go in ((one, act[first]), (two, act[~first])):
                if len(go):
                    descend(child, go)

        def visit(node: int, act: np.ndarray) -> None:
            if len(self.nodes[node]) == 2:
                leaf(node, act)
                return
            vantage, *halves = self.nodes[node]
            d = distance(act, vantage)
            for lo, hi, child in halves:
                worst = best[act, 0] - margin[act]
                reach = np.sqrt(np.maximum(length2[act] + self.longest2 - 2.0 * np.where(np.isfinite(worst), worst, 0.0), 0.0))
                bound = np.maximum(np.maximum(lo - d, d - hi), 0.0)
                go = ~np.isfinite(worst) | (bound * relax <= reach + 1e-9 * (1.0 + reach))
                if go.any():
                    visit(child, act[go])

        everyone = np.arange(n)
        descend(0, everyone)
        visit(0, everyone)
        if not hits:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0), scored
        q, p, s = (np.concatenate(x) for x in zip(*hits, strict=True))
        good = s >= best[q, 0] - margin[q]
        pair = np.unique(q[good] * len(self.ids) + p[good])
        q, p = pair // len(self.ids), pair % len(self.ids)
        if not len(q):
            return q, p, np.empty(0), scored
        score = np.concatenate([exact(queries[q[i : i + 100_000]], self.vectors[p[i : i + 100_000]]) for i in range(0, len(q), 100_000)])
        order = np.lexsort((self.ids[p], -score, q))
        q, p, score = q[order], p[order], score[order]
        # The k nearest rows are rows of the k nearest entries.
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, p, score = q[rank < k], p[rank < k], score[rank < k]
        times = np.minimum(self.times[p], k)
        q, p, score = (np.repeat(x, times) for x in (q, p, score))
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], self.ids[p][rank < k], score[rank < k], scored


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, row by row, each summed alike."""
    return (a * b).sum(axis=1)


def _matrix(held: list) -> np.ndarray:
    return np.array(held, dtype=np.float64)


def _build(table: pa.Table) -> pa.Table:
    tree = Tree(table.column("vec_id").to_numpy(), _matrix(table.column("v").to_pylist()), times=table.column("n").to_numpy())
    return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(dim, shard, tree) of all usable rows (vec_id, embedding), and the number
    of shards. A shard has about ``shard_rows`` entries, by a hash of the id and the
    vector. Rows that are alike in both are one entry, which keeps their number, so
    that a search for any number of neighbours returns as many as there are."""
    rows = vectors.select(column(vectors, "vec_id", "long").alias("vec_id"), column(vectors, "embedding", "array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("v"))).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("dim", F.size("v"))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    return staged(dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, tree binary")), shards


def best_factor(vectors: np.ndarray, k: int = NEIGHBOURS, queries: int = SAMPLE_QUERIES, recall: float = RECALL) -> float:
    """The largest factor up to which every one finds that part of the nearest."""
    own = np.arange(len(vectors))
    asked = own[:queries]
    tree = Tree(own, vectors)
    found = lambda relax: set(zip(*(x.tolist() for x in tree.search(vectors[asked], asked, k, relax)[:2]), strict=True))
    exact, best = found(1.0), 1.0
    for factor in FACTORS[1:]:
        if len(found(factor) & exact) < recall * len(exact):
            break
        best = factor
    return best


def fit_relax(vectors: DataFrame, k: int = NEIGHBOURS, recall: float = RECALL, rows: int = SAMPLE_ROWS) -> dict[int, float]:
    """A factor for each length of vectors, from a bounded sample (``rows`` vectors of
    the least hashes), in one task; what the sample has too few of is searched exactly.
    A shard's search keeps k of its own rows, of which fewer are among the k of all;
    so what all shards find together is at least as complete as the sample's."""
    held = vectors.select(column(vectors, "vec_id", "long").alias("vec_id"), column(vectors, "embedding", "array<double>").alias("v"))
    held = held.filter(F.col("vec_id").isNotNull() & _usable(F.col("v"))).withColumn("h", F.xxhash64("vec_id", "v"))
    chosen = held.select("h", "v").dropDuplicates(["h"]).orderBy("h").limit(rows)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = {}
        for batch in batches:
            for v in batch.column("v").to_pylist():
                by_dim.setdefault(len(v), []).append(v)
        found = {d: best_factor(_matrix(x), k, recall=recall) for d, x in by_dim.items() if len(x) >= 4 * LEAF_ROWS}
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(found.values(), pa.float64())], ["dim", "relax"])

    return {r.dim: r.relax for r in chosen.repartition(1).mapInArrow(fitted, "dim int, relax double").collect()}


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = NEIGHBOURS, relax: float | dict[int, float] = 1.0, block: int = BLOCK_QUERIES, together: int = BLOCKS_TOGETHER) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query row (vec_id,
    embedding), best first. ``relax`` is a factor, or one for each length of vectors
    (``fit_relax``), others being searched exactly.

    ``together`` blocks of queries meet a shard's tree in one task, which loads the
    tree once and searches block by block; a shard's other blocks are other tasks.
    Each meeting yields at most k rows for a query, of which the k best are ranked."""
    rows = queries.select(column(queries, "vec_id", "long").alias("vec_id"), column(queries, "embedding", "array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("v"))).distinct().withColumn("dim", F.size("v"))
    blocks = max(1, math.ceil(rows.count() / block))
    packed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    part = F.floor(F.col("block") / together).cast("int")
    asked = packed.withColumns({"part": part, "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))}).select("dim", "shard", "part", "queries")
    trees = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // together)))).select("dim", "shard", "part", "tree")

    def met(tree: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if tree.num_rows:
            held = pickle.loads(tree.column("tree")[0].as_py())
            for i in range(asked.num_rows):
                block = asked.column("queries")[i].as_py()
                own = np.array([x["vec_id"] for x in block], dtype=np.int64)
                vectors = _matrix([x["v"] for x in block])
                factor = relax.get(vectors.shape[1], 1.0) if isinstance(relax, dict) else relax
                q, ids, score, _ = held.search(vectors, own, k, factor)
                out.append(pa.table({"query_id": pa.array(own[q], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())}))
        return pa.concat_tables(out) if out else pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]).empty_table()

    keys = ["dim", "shard", "part"]
    found = trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(met, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every EVERYth row among all rows."""
    return _nearest(spark, sf_dir)


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at factor one; scores to nine digits, as engines sum in other orders."""
    return _nearest(spark, sf_dir, 1.0).withColumn("score", F.round("score", 9))


def op5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(queries, found, wanted): of the nearest that the exact search finds, how many
    the production factor does."""
    exact = _nearest(spark, sf_dir, 1.0).select("query_id", "vec_id")
    near = _nearest(spark, sf_dir).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted"))


def _nearest(spark: SparkSession, sf_dir: str, relax: float | None = None) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index, shards = build_index(vectors)
    return search(index, shards, vectors.filter(F.col("vec_id") % EVERY == 0), relax=fit_relax(vectors) if relax is None else relax)


OP5_EXACT_SQL = f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS s
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % {EVERY} = 0) q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id, round(s, 9) AS score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= {NEIGHBOURS}
"""
