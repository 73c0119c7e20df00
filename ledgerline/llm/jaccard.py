"""N-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

A document's set holds its distinct word shingles, as sorted 64-bit hashes; two
sets link when ``den * |A & B| >= num * |A | B|``. Equal sets are one class, known
by a 64-bit hash of the set and its size, so copies cost nothing beyond the first.

1. *Tiles.* Sizes are cut into bands; two sets can only link if the larger lies
   within ``den / num`` of the smaller, so every linking pair belongs to the band
   of its smaller set, and can't differ in more than ``d`` shingles, which the
   band fixes. The hash range is cut into ``d + e`` equal segments for the band: a
   linking pair agrees in at least ``e`` of them. (band, segment, what the set has
   there) is a tile; sets that share none cannot link. Empty segments count as a
   tile only for sets that have ``e`` of them or more, so that they tell something.
   A passage that many documents share makes no large tile, unless a segment holds
   nothing else.
2. *Candidates.* Tiles of the same sets are one. In a tile, sets are held against
   each other by bitmaps of their hashed shingles: bits of one that the other
   lacks bound the overlap from above, and pairs that can't link go. The connected
   components of what is left, found by star contraction, are sent the shingles of
   their sets. Pairs are never listed; a tile's edges are a spanning forest.
3. *Links.* In a component, sets are sorted by size; each is held against the
   larger ones within reach that aren't joined to it yet: by the bitmaps' bound
   first, then by exact intersection of the sorted arrays. Components of many
   shingles are cut into tiles of size band by size band and block by block, so a
   task's share stays bounded.
4. The links' connected components are the result.

Nothing is capped or sampled: each pair that links is either tested or already
joined through others. Defined results: a set of a text shorter than the shingle
is its whole word sequence; a null, empty or wordless text has an empty set and
links with nothing, not even its like; rows of a null id take part, and have the
smallest id of their component, null if there is none; repeated rows are copies;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_tools import pieces
from .common import U64, WORD, Sieve, WordIds, column, documents, forget, kept, looked_up, mix64, planned_bytes, scratch, written

#: Unless a contract says otherwise: five words, similarity 0.8.
WIDTH, SIMILAR = 5, (80, 100)
#: Tile entries that a task sorts, about; 20 bytes each.
ENTRIES_PER_TASK = 1_500_000
#: Shingles that a task verifies at a time, about; 8 bytes each and a signature.
SHINGLES_PER_TILE = 2_000_000
#: Sets whose bitmaps a task holds against each other at a time, at most.
SETS_PER_TILE = 10_000
_I64 = np.int64


# --- sets -----------------------------------------------------------------
class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, WordIds()

    def sets(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all hashes, text after text; number of them for each text)."""
        split = [t.lower().split() if t else [] for t in texts]
        n = np.array([len(s) for s in split], dtype=_I64)
        if not n.sum():
            return np.empty(0, dtype=U64), np.zeros(len(texts), dtype=_I64)
        h = self.words.hashes([w for s in split for w in s])
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        doc = np.repeat(np.arange(len(n)), n)
        room = n[doc] - (np.arange(len(h)) - start[doc])  # words from here to the end
        ok = room >= self.width
        at = np.flatnonzero(ok)
        held = np.zeros(len(at), dtype=U64)
        for k in range(self.width):
            held = mix64(held * U64(3) + h[at + k])
        of = doc[at]
        short = np.flatnonzero((n > 0) & (n < self.width))
        if len(short):
            whole = np.empty(len(short), dtype=U64)
            for i, d in enumerate(short.tolist()):
                x = n[d : d + 1].astype(U64)
                for v in h[start[d] : start[d] + n[d]]:
                    x = mix64(x * U64(5) + v)
                whole[i] = x[0]
            held, of = np.concatenate([held, whole]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            held, of = held[order], of[order]
        counts = np.bincount(of, minlength=len(n))
        stops = np.cumsum(counts)
        a = 0
        for b in stops.tolist():
            if b - a > 1:
                held[a:b].sort()
            a = b
        new = np.ones(len(held), dtype=bool)
        new[1:] = (held[1:] != held[:-1]) | (of[1:] != of[:-1])
        return held[new], np.bincount(of[new], minlength=len(n))


def set_ids(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set, independent of the order of its hashes."""
    total = np.zeros(len(sizes), dtype=U64)
    some = sizes > 0
    if some.any():
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[some]
        total[some] = np.add.reduceat(mix64(hashes ^ U64(0x5851F42D4C957F2D)), starts)
    return mix64(total + sizes.astype(U64) * U64(0x9E3779B97F4A7C15)).view(_I64)


# --- bands and tiles ------------------------------------------------------
@lru_cache
def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(smallest size, largest size, segments, spare segments) of each band;
    no segments where sets can only link if they are equal."""
    low, high, segments, spare = [], [], [], []
    lo = 1
    while lo < 1 << 40:
        hi = max(lo + 1, math.ceil(lo * 1.5)) - 1
        most = hi + hi * den // num
        totals = np.arange(max(2, most - 400), most + 1)
        d = int((totals - 2 * -(-num * totals // (den + num))).max())
        e = 0
        if d:
            e = 4
            for _ in range(3):
                e = 4 + math.ceil(2 * (d + e) * math.exp(-lo / (d + e)))
        low.append(lo)
        high.append(hi)
        segments.append(d + e if d else 0)
        spare.append(e)
        lo = hi + 1
    return tuple(np.array(x, dtype=_I64) for x in (low, high, segments, spare))


def tile_keys(hashes: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its set) of every tile that a set lies in."""
    low, high, segments, spare = bands(num, den)
    own = np.searchsorted(low, sizes, side="right") - 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mixed = mix64(hashes ^ U64(0xD6E8FEB86659FD93))
    keys, of = [], []
    band = own + 1
    while True:
        # The next band below, as long as its largest set can link with this one.
        band = band - 1
        takes = (band >= 0) & (sizes > 0)
        takes[takes] &= sizes[takes] * num <= high[band[takes]] * den
        if not takes.any():
            break
        takes[takes] &= segments[band[takes]] > 0
        if not takes.any():
            continue
        which = np.flatnonzero(takes)
        n, m, b = sizes[which], segments[band[which]], band[which]
        ends = np.cumsum(n)
        of_doc = np.repeat(np.arange(len(which)), n)
        at = np.arange(int(ends[-1])) - np.repeat(ends - n, n) + np.repeat(starts[which], n)
        segment = ((hashes[at] >> U64(32)) * m[of_doc].astype(U64)) >> U64(32)
        first = np.ones(len(at), dtype=bool)
        first[1:] = (of_doc[1:] != of_doc[:-1]) | (segment[1:] != segment[:-1])
        cut = np.flatnonzero(first)
        content = np.add.reduceat(mixed[at], cut)
        doc = of_doc[cut]
        place = (b[doc].astype(U64) << U64(48)) | segment[cut]
        keys.append(mix64(content + mix64(place)))
        of.append(which[doc])
        empty = m - np.bincount(doc, minlength=len(which))
        sparse = np.flatnonzero(empty >= spare[b])
        if len(sparse):
            keys.append(mix64((b[sparse].astype(U64) << U64(48)) | U64((1 << 48) - 1)))
            of.append(which[sparse])
    if not keys:
        return np.empty(0, dtype=U64), np.empty(0, dtype=_I64)
    return np.concatenate(keys), np.concatenate(of)


def shared_tiles(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tile, node) of the tiles that hold two different sets or more; a tile is
    named by its sets, and tiles of the same sets are given once."""
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[1:] == keys[:-1]
    shared = same[1:] | same[:-1]
    keys, nodes = keys[shared], nodes[shared]
    if not len(keys):
        return nodes, nodes
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
    keys, nodes = keys[new], nodes[new]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(starts, len(keys)))
    name = mix64(np.add.reduceat(mix64(nodes.view(U64)), starts) + count.astype(U64)).view(_I64)
    _, once = np.unique(name, return_index=True)
    keep = np.zeros(len(starts), dtype=bool)
    keep[once] = True
    keep &= count > 1
    rows = np.repeat(keep, count)
    return np.repeat(name, count)[rows], nodes[rows]


# --- signatures -----------------------------------------------------------
def signature_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of a set's bitmap: about a bit for each shingle, a power of
    two, so that a larger bitmap can be folded onto a smaller one."""
    return 1 << np.ceil(np.log2(np.maximum(sizes, 64) / 64)).astype(_I64)


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bitmaps of sets, one after the other."""
    words = signature_words(sizes)
    stops = np.cumsum(words)
    out = np.zeros(int(stops[-1]) if len(stops) else 0, dtype=U64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    low = hashes & (words[of] * 64 - 1).astype(U64)
    np.bitwise_or.at(out, (stops - words)[of] + (low >> U64(6)).astype(_I64), U64(1) << (low & U64(63)))
    return out


def folded(marks: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows of a matrix, folded to the smallest's length."""
    least = min(map(len, marks))
    out = np.empty((len(marks), least), dtype=U64)
    for i, m in enumerate(marks):
        out[i] = m if len(m) == least else np.bitwise_or.reduce(m.reshape(-1, least), axis=0)
    return out


def overlap_bound(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """No two sets of these bitmaps and sizes share more than this."""
    lacks = np.bitwise_count(a & ~b).sum(axis=-1, dtype=_I64)
    more = np.bitwise_count(b & ~a).sum(axis=-1, dtype=_I64)
    return np.minimum(size_a - lacks, size_b - more)


def need(size_a: np.ndarray, size_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shared shingles from which two sets link."""
    return -(-num * (size_a + size_b) // (den + num))


# --- connected components -------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v), by alternating large-star and
    small-star contraction; a root is the smallest node of its component. Roots
    themselves are not listed. Each round is a written table."""
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e, last = written(e, "edges"), None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.count_distinct("u").alias("d")).first()
        if (now.n, now.h) == last or now.n == 0:
            break
        last = (now.n, now.h)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e, old = written(new, "edges"), e
        forget(spark, old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- verification ---------------------------------------------------------
def links(size: np.ndarray, marks: list[np.ndarray], sets: list[np.ndarray] | None, num: int, den: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that link, and join all sets that are joined by links; without
    ``sets``, pairs that may link by their bitmaps. With ``side``, only pairs of
    different sides are looked at; sets of one ``label`` are joined already."""
    order = np.argsort(size, kind="stable")
    size = size[order]
    marks = folded([marks[i] for i in order.tolist()])
    root = np.arange(len(size))
    if label is not None:
        _, first, which = np.unique(label[order], return_index=True, return_inverse=True)
        root = first[which]
    found = []
    reach = np.searchsorted(size, size * den // num, side="right")
    for i in range(len(size) - 1):
        j = np.arange(i + 1, reach[i])
        j = j[root[j] != root[i]]
        if side is not None:
            j = j[side[order[j]] != side[order[i]]]
        if not len(j):
            continue
        least = need(size[i], size[j], num, den)
        j = j[overlap_bound(marks[i], size[i], marks[j], size[j]) >= least]
        for k in j.tolist():
            if root[k] == root[i]:
                continue
            if sets is not None:
                mine, other = sets[order[i]], sets[order[k]]
                at = np.searchsorted(other, mine)
                at[at == len(other)] = 0
                if int(np.count_nonzero(other[at] == mine)) < need(size[i], size[k], num, den):
                    continue
            found.append((int(order[i]), int(order[k])))
            root[root == max(root[i], root[k])] = min(root[i], root[k])
    return found


# --- the operator ---------------------------------------------------------
def _entries(num: int, den: int, width: int, fine: int):
    """Text rows -> rows (p, a, b, n, s) of packed arrays: p >= 0: tile keys and
    set ids; p < 0: ids of documents and then hashes of their texts, set ids, sizes
    (-1 - n: null id), bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        turn = 0
        for batch in batches:
            for piece, texts in pieces(batch):
                hashes, sizes = shingler.sets(texts)
                ids = set_ids(hashes, sizes)
                doc_id = piece.column(0)
                null = np.array(doc_id.is_null().to_pylist(), dtype=bool)
                docs = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(_I64)
                texts_of = piece.column(2).to_numpy(zero_copy_only=False).astype(_I64)
                turn += 1
                p, a, b, c = [-1 - turn % fine], [docs.tobytes() + texts_of.tobytes()], [ids.tobytes()], [np.where(null, -1 - sizes, sizes).astype(_I64).tobytes()]
                s = [signatures(hashes, sizes).tobytes()]
                # Copies within a piece are entered once.
                _, once = np.unique(ids, return_index=True)
                keep = np.zeros(len(sizes), dtype=bool)
                keep[once] = True
                hashes, kept = hashes[np.repeat(keep, sizes)], sizes[keep]
                keys, of = tile_keys(hashes, kept, num, den)
                nodes = ids[keep][of]
                part = (keys % U64(fine)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, keys, nodes = part[order], keys[order], nodes[order]
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    if y > x:
                        p.append(int(part[x]))
                        a.append(keys[x:y].tobytes())
                        b.append(nodes[x:y].tobytes())
                        c.append(b"")
                        s.append(b"")
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), *(pa.array(x, pa.binary()) for x in (a, b, c, s))], ["p", "a", "b", "n", "s"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows -> rows (kind, u, v, n, s, h): 0: tile and set id; 1: document id,
    set id, size, bitmap and hash of the text."""
    keys, nodes = [], []
    names = ["kind", "u", "v", "n", "s", "h"]
    for batch in batches:
        for p, a, b, n, s in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if p >= 0:
                keys.append(np.frombuffer(a, dtype=U64))
                nodes.append(np.frombuffer(b, dtype=_I64))
                continue
            size = np.frombuffer(n, dtype=_I64)
            null = size < 0
            size = np.where(null, -1 - size, size)
            stops = (8 * np.cumsum(signature_words(size))).tolist()
            marks = pa.array([s[x:y] for x, y in zip([0, *stops[:-1]], stops, strict=True)], pa.binary())
            own = np.frombuffer(a, dtype=_I64)
            docs = pa.array(own[: len(size)], pa.int64(), mask=null)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(size)), pa.int32()), docs, pa.array(np.frombuffer(b, dtype=_I64), pa.int64()), pa.array(size, pa.int64()), marks, pa.array(own[len(size) :], pa.int64())], names)
    if keys:
        u, v = shared_tiles(np.concatenate(keys), np.concatenate(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u)), pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.binary()), pa.nulls(len(u), pa.int64())], names)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of equal first column, which come in a row, without that column."""
    now, rows = None, []
    for batch in batches:
        for first, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first != now:
                if rows:
                    yield rows
                now, rows = first, []
            rows.append(rest)
    if rows:
        yield rows


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])


def _sides(rows: list[list]) -> tuple[bool, np.ndarray | None, np.ndarray]:
    """(whether there is a pair to look at, sides, labels) of a tile's rows, which
    begin with (side, set id, label); side 0 meets all of side 0."""
    side, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    if side[0] == 0:
        return len(rows) > 1, None, label
    return bool((side != side[0]).any()), side, label


def _bounded(num: int, den: int):
    """Rows (tile, side, set id, label, size, bitmap), a tile's in a row -> edges
    (u, v) that join the sets which may link by their bitmaps. Tiles of two go
    together."""

    def two(held: list[list]) -> list[tuple[int, int]]:
        out = []
        words = np.array([min(len(x[4]), len(y[4])) // 8 for x, y in held])
        for w in np.unique(words).tolist():
            which = np.flatnonzero(words == w).tolist()
            fold = lambda m: np.bitwise_or.reduce(np.frombuffer(m, dtype=U64).reshape(-1, w), axis=0)  # noqa: B023, E731
            a, b = (np.array([fold(held[i][k][4]) for i in which]) for k in (0, 1))
            na, nb = (np.array([held[i][k][3] for i in which]) for k in (0, 1))
            ok = (overlap_bound(a, na, b, nb) >= need(na, nb, num, den)) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
            out += [(held[which[i]][0][1], held[which[i]][1][1]) for i in np.flatnonzero(ok).tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twos: list[list] = []
        for rows in _grouped(batches):
            rows = list({r[1]: r for r in rows}.values())
            some, side, label = _sides(rows)
            if some and len(rows) == 2:
                twos.append(rows)
                if len(twos) >= 20_000:
                    yield _pairs(two(twos))
                    twos = []
            elif some:
                found = links(np.array([r[3] for r in rows]), [np.frombuffer(r[4], dtype=U64) for r in rows], None, num, den, side, label)
                yield _pairs([(rows[i][1], rows[j][1]) for i, j in found])
        if twos:
            yield _pairs(two(twos))

    return run


def _arrays(width: int):
    """Text rows -> (set id, size, packed shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for _, texts in pieces(batch):
                hashes, sizes = shingler.sets(texts)
                ids, stops = set_ids(hashes, sizes), np.cumsum(sizes).tolist()
                packed = [hashes[a:b].tobytes() for a, b in zip([0, *stops[:-1]], stops, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["set_id", "shingles"])

    return run


def _verified(num: int, den: int):
    """Rows (tile, side, set id, label, shingles), a tile's in a row -> links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for rows in _grouped(batches):
            rows = list({r[1]: r for r in rows}.values())
            some, side, label = _sides(rows)
            if some:
                sets = [np.frombuffer(r[3], dtype=U64) for r in rows]
                size = np.array([len(x) for x in sets], dtype=_I64)
                flat, words = signatures(np.concatenate(sets), size), signature_words(size)
                marks = np.split(flat, np.cumsum(words)[:-1])
                found = links(size, marks, sets, num, den, side, label)
                held += [(rows[i][1], rows[j][1]) for i, j in found]
            if len(held) >= 10_000:
                yield _pairs(held)
                held = []
        if held:
            yield _pairs(held)

    return run


# --- groups of sets, cut into tiles of bounded weight ---------------------
def _compared(members: DataFrame, most: int, compare) -> DataFrame:
    """Edges among the members (grp, set_id, w, prefer) of each group, by
    ``compare`` of tiles (tile, side, set_id, label). A group of up to ``most``
    weight is one tile. In a larger one, all are held against one member first, the
    least by (prefer, set_id), in as many tiles as its weight asks for; those joined
    to it needn't be compared among themselves. Only the others are compared with each
    other and with these, a tile for each pair of blocks."""
    groups = members.groupBy("grp").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("prefer", "set_id"))["set_id"].alias("first"))
    large = written(groups.filter(F.col("weight") > most), "groups")
    alone = lambda df: df.select(F.col("grp").alias("tile"), F.lit(0).alias("side"), "set_id", F.col("set_id").alias("label"))
    if large.isEmpty():
        return compare(alone(members))
    known = written(looked_up(members, large, ["grp"], "rows"), "known")
    parts = F.ceil(F.col("weight") / F.lit(max(1, most))).cast("long")
    others = known.filter("weight IS NOT NULL AND set_id <> first").select(F.xxhash64("grp", F.pmod(F.xxhash64("set_id"), parts)).alias("tile"), F.lit(2).alias("side"), "set_id", F.col("set_id").alias("label"))
    firsts = large.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select(F.xxhash64("grp", "part").alias("tile"), F.lit(1).alias("side"), F.col("first").alias("set_id"), F.col("first").alias("label"))
    found = written(compare(alone(known.filter("weight IS NULL")).unionByName(others).unionByName(firsts)), "edges")

    # What is joined to the first of its group has its label, other sets their own.
    held = known.filter("weight IS NOT NULL").select("grp", "set_id", "w", "first")
    ends = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    marked = held.join(ends, (F.col("set_id") == F.col("u")) & (F.col("first") == F.col("v")), "left")
    marked = marked.withColumn("apart", F.col("u").isNull() & (F.col("set_id") != F.col("first")))
    marked = marked.select("grp", "set_id", "w", "apart", F.when(F.col("apart"), F.col("set_id")).otherwise(F.col("first")).alias("label"))
    if not marked.filter("apart").isEmpty():
        found = found.unionByName(_of_those_apart(written(marked, "marked"), most, compare))
    return found


def _of_those_apart(marked: DataFrame, most: int, compare) -> DataFrame:
    """Edges of the members (grp, set_id, w, apart, label) that stand apart, among
    each other and to the rest of their group."""
    blocks = lambda p: F.ceil(F.coalesce(F.sum(F.when(p, F.col("w"))), F.lit(0)) / F.lit(max(1, most // 2))).cast("long")
    load = marked.groupBy("grp").agg(blocks(F.col("apart")).alias("a"), blocks(~F.col("apart")).alias("b"), F.count(F.lit(1)).alias("rows")).filter("a > 0")
    each = looked_up(marked, load, ["grp"], "rows").filter("a > 0")
    own = F.pmod(F.xxhash64("set_id", "grp"), F.when(F.col("apart"), F.col("a")).otherwise(F.col("b")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    each = each.withColumn("own", own)
    # (apart, apart): side 0 within a block, 1 and 2 across; (apart, joined): 3 and 4.
    apart = each.filter("apart").withColumn("other", F.explode(upto("a")))
    apart = apart.select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "set_id", "label")
    cross = lambda: F.xxhash64("grp", F.lit(-1), F.col("x"), F.col("y")).alias("tile")
    left = each.filter("apart AND b > 0").withColumns({"x": F.col("own"), "y": F.explode(upto("b"))}).select(cross(), F.lit(3).alias("side"), "set_id", "label")
    right = each.filter("NOT apart").withColumns({"y": F.col("own"), "x": F.explode(upto("a"))}).select(cross(), F.lit(4).alias("side"), "set_id", "label")
    return compare(apart.unionByName(left).unionByName(right))


def _windows(members: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Groups (grp, set_id, w, prefer) in which candidates (set_id, n, root) are
    verified: a component of up to ``most`` shingles; of a larger one, three
    neighbouring size bands of ratio den / num, which hold each pair that can link
    (rounding of the logarithm may put it one band further apart)."""
    weight = members.groupBy("root").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("rows")).filter(F.col("weight") > most)
    weight = written(weight, "weights")
    if weight.isEmpty():
        return members.select(F.col("root").alias("grp"), "set_id", F.col("n").alias("w"), F.lit(0).cast("long").alias("prefer"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) if den > num else 1.0)).cast("long")
    known = looked_up(members, weight, ["root"], "rows").withColumn("band", band)
    whole = known.filter("weight IS NULL").select(F.col("root").alias("grp"), "set_id", F.col("n").alias("w"), F.lit(0).cast("long").alias("prefer"))
    cut = known.filter("weight IS NOT NULL").withColumn("low", F.explode(F.array("band", F.col("band") - 1, F.col("band") - 2)))
    cut = cut.select(F.xxhash64("root", "low").alias("grp"), "set_id", F.col("n").alias("w"), F.abs(F.col("band") - F.col("low") - 1).alias("prefer"))
    return whole.unionByName(cut)


def _classes(docs: DataFrame, width: int, similar: tuple[int, int], entries_per_task: int = ENTRIES_PER_TASK, shingles_per_tile: int = SHINGLES_PER_TILE, sets_per_tile: int = SETS_PER_TILE) -> DataFrame:
    """(doc_id, h, set_id, n, root) of each row, a written table: the hash of its
    text, its class of equal sets, and the class that names its component."""
    num, den = similar
    if not 0 < num <= den:
        raise ValueError("similarity must be above 0, and 1 at most")
    spark = docs.sparkSession
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    # A text has about a word in six bytes, and a band's tiles are about
    # (1 - t) / t of its shingles, with what the neighbouring band adds. This only
    # sets the number of tasks, so an estimate does: files hold texts compressed.
    size = 3 * (planned_bytes(rows) or 0)
    if not size:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("h", F.xxhash64("text"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 6 * 2 * (den - num) / num / entries_per_task))
    packed = rows.mapInArrow(_entries(num, den, width, 4 * tasks), "p int, a binary, b binary, n binary, s binary")
    met = written(packed.repartition(tasks, "p").mapInArrow(_gathered, "kind int, u long, v long, n long, s binary, h long"), "sets")
    members = met.filter("kind = 1").select(F.col("u").alias("doc_id"), "h", F.col("v").alias("set_id"), "n")

    # Bitmaps go to the tiles; of a class of equal sets, one.
    marks = met.filter("kind = 1 AND n > 0").select(F.col("v").alias("set_id"), "n", "s").dropDuplicates(["set_id"])
    tiles = met.filter("kind = 0").select(F.col("u").alias("grp"), F.col("v").alias("set_id")).distinct()
    tiles = tiles.withColumns({"w": F.lit(1).cast("long"), "prefer": F.lit(0).cast("long")})

    def bounded(tiles: DataFrame) -> DataFrame:
        marked = tiles.join(marks.hint("merge"), "set_id").select("tile", "side", "set_id", "label", "n", "s")
        return marked.repartition("tile").sortWithinPartitions("tile").mapInArrow(_bounded(num, den), "u long, v long")

    near = components(_compared(tiles, sets_per_tile, bounded))

    # Shingles are fetched for one document of each class that has a candidate.
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    classes = members.filter("n > 0").groupBy("set_id", "n").agg(F.min("doc_id").alias("doc_id"))
    wanted = written(classes.join(near, F.col("set_id") == F.col("node")).select("set_id", "n", "root", "doc_id"), "wanted")
    key = lambda c: F.struct(F.col(c).alias("k"))  # noqa: E731  a struct of null equals its like
    named = wanted.select(key("doc_id").alias("__key")).distinct()
    # Texts that are surely not wanted stay where they are.
    texts, _ = Sieve(wanted, F.xxhash64("doc_id"), wanted.count()).split(rows.select("doc_id", "text"), F.xxhash64("doc_id"))
    texts = texts.withColumn("__key", key("doc_id")).join(named.hint("merge"), "__key", "left_semi").select("text")
    shingles = texts.mapInArrow(_arrays(width), "set_id long, shingles binary")
    groups = written(_windows(wanted.select("set_id", "n", "root"), num, den, shingles_per_tile), "windows")

    def verified(tiles: DataFrame) -> DataFrame:
        held = shingles.join(tiles.hint("merge"), "set_id").select("tile", "side", "set_id", "label", "shingles")
        return held.repartition("tile").sortWithinPartitions("tile").mapInArrow(_verified(num, den), "u long, v long")

    reached = components(_compared(groups, shingles_per_tile, verified))
    of = members.join(reached, F.col("set_id") == F.col("node"), "left").select("doc_id", "h", "set_id", "n", F.coalesce("root", "set_id").alias("root"))
    return written(of, "members")


def _rooted(docs: DataFrame, *how) -> DataFrame:
    """``_classes``; the tables on the way to it are removed."""
    with scratch(docs.sparkSession):
        return kept(_classes(docs, *how))


def join(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, entries_per_task: int = ENTRIES_PER_TASK, shingles_per_tile: int = SHINGLES_PER_TILE, sets_per_tile: int = SETS_PER_TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id): each row's class of equal sets,
    and the smallest doc_id that it reaches by links. ``docs`` needs doc_id and
    text; other columns are left out."""
    of = _rooted(docs, width, similar, entries_per_task, shingles_per_tile, sets_per_tile)
    # Only components of more than one row have anything to look up.
    worded = of.filter("n > 0")
    least = worded.groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    out = looked_up(worded, least, ["root"], "rows").unionByName(of.filter("n = 0"), allowMissingColumns=True)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "set_id")


def keep_one(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``docs``, all columns kept, with one row of each group of near copies: that
    of the smallest id, null last, then of the smallest hash of its text; of rows
    equal in both, that of the smallest hash of all its columns. A wordless text is
    no one's copy; of wordless rows equal in id and text one stays, those without an
    id stay all. Texts of rows that no other row is held against aren't shuffled."""
    names = docs.columns
    of = _rooted(docs, width, similar)
    # A row is known by its id and the hash of its text; the least of a group stays.
    group = F.when(F.col("n") > 0, F.struct(F.lit(0).alias("kind"), F.col("root").alias("a"), F.lit(0).cast("long").alias("b"))).when(F.col("doc_id").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("doc_id").alias("a"), F.col("h").alias("b")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h").alias("hash"))
    rows = of.select(group.alias("grp"), key.alias("key")).filter("grp IS NOT NULL")
    least = rows.groupBy("grp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    touched = looked_up(rows, least, ["grp"], "rows").filter("least IS NOT NULL").groupBy("key").agg(F.max(F.col("key") == F.col("least")).alias("stays"))
    touched = written(touched, "touched")

    inner = [f"c{i}" for i in range(len(names))]
    own = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)], column(docs, "doc_id", "long").alias("own_id"), column(docs, "text", "string").alias("own_text"))
    own = own.withColumn("key", F.struct(F.col("own_id").isNull().alias("none"), F.coalesce("own_id", F.lit(0)).alias("id"), F.xxhash64("own_text").alias("hash")))
    alone = F.col("own_id").isNull() & ~F.coalesce(F.col("own_text").rlike(WORD), F.lit(False))
    hashed = F.xxhash64("key.none", "key.id", "key.hash")
    may, cannot = Sieve(touched, hashed, touched.count()).split(own.select(*inner, "key", alone.alias("alone")), hashed)
    # Whatever passes the sieve without being touched is the only row of its key.
    plain = [i for c, i in zip(names, inner, strict=True) if "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    once = may.filter("NOT alone").groupBy("key").agg(F.min_by(F.struct(*inner), F.xxhash64(*plain)).alias("row"))
    kept = once.join(touched, "key", "left").filter("stays OR stays IS NULL").select("row.*")
    out = cannot.select(*inner).unionByName(may.filter("alone").select(*inner)).unionByName(kept)
    return out.select(*[F.col(i).alias(c) for c, i in zip(names, inner, strict=True)])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, four words, similarity 0.85."""
    return join(documents(spark, sf_dir), 4, (85, 100)).select("doc_id", "n_shingles", "component_id")


#: Shingles joined with shingles, and what is reached by links; for small tables.
OP9_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs
), sizes AS (
  SELECT r, count(*) AS n, bit_xor(hash(s)) AS h FROM shingles GROUP BY r
), classes AS (
  SELECT r, n, min(r) OVER (PARTITION BY n, h) AS c FROM sizes
), pairs AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r
  WHERE a.r IN (SELECT c FROM classes) AND b.r IN (SELECT c FROM classes) GROUP BY a.r, b.r
), links AS (
  SELECT a, b FROM pairs p JOIN sizes x ON a = x.r JOIN sizes y ON b = y.r WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), roots AS (
  SELECT a, min(b) AS root FROM reach GROUP BY a
), least AS (
  SELECT root, min(doc_id) AS least FROM classes JOIN roots ON c = a JOIN docs USING (r) GROUP BY root
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id
FROM docs LEFT JOIN classes USING (r) LEFT JOIN roots ON c = a LEFT JOIN least USING (root)
"""
