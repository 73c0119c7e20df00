"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

Pre-tokens (matches of the pattern) start as linked lists of single bytes. Each
pair of neighbours that has a merge rank waits in the bucket of that rank, which
holds positions of the lists; a bitmap of three levels marks the ranks whose
bucket isn't empty, so that finding the lowest rank is three find-first-sets.
A bucket's positions are merged from left to right; entries whose pair has
changed meanwhile are stale and skipped. Merging n bytes so takes time in
proportion to n, whatever the order of the merges, which suits very long
pre-tokens.

One queue serves all pre-tokens of a piece of the input at once: lists of
different pre-tokens don't touch, so what waits in a bucket can be merged in one
go of array operations, whichever pre-tokens it comes from. Where buckets hold few
positions, several are taken at once, and of each pre-token the lowest rank among
them is merged; what it has at the other ranks goes back. Equal stretches of
text are merged once per task and then looked up.

``tiktoken``'s rule is reproduced: a pre-token that is itself a vocabulary entry
is that id; otherwise the pair of lowest rank merges first, the leftmost of these.
Should a merge offer a pair of a lower rank than its own, the leftmost rule
depends on the order within the pre-token, and it is merged again by itself.

Defined results: a null text encodes as an empty one (no ids); whole texts are
encoded, without special tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .arrow_tools import map_texts
from .common import column, documents

#: Stretches of text that a task remembers the ids of.
REMEMBERED = 150_000
#: Stretches longer than this many characters aren't remembered.
LONGEST_REMEMBERED = 64
#: Positions that are merged in one go, about: of as many ranks as that takes.
WIDE = 4096
#: Text bytes that one queue serves; arrays of 21 bytes stand for a byte.
QUEUE_BYTES = 4_000_000
RANKS = "byte_bpe_multi_50k.tiktoken"


#: Before a space between two characters that are not white space.
_CUTS = re.compile(r"(?<=\S)(?= \S)")
_NAMES, _DECODED = itemgetter(0), itemgetter(1)


def _ids(coded: list[Coded]) -> list[int]:
    """The ids of the stretches of one text."""
    return [int(x) for x in ",".join(map(_NAMES, coded)).split(",")] if coded else []


class RankQueue:
    """Buckets of entries by rank, under a bitmap of three levels of 64."""

    def __init__(self) -> None:
        self.buckets: dict[int, list] = {}
        self.top = 0
        self.mid: dict[int, int] = {}
        self.low: dict[int, int] = {}

    def push(self, rank: int, entry) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(entry)
            return
        self.buckets[rank] = [entry]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Arrays of positions, one for each rank."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for start, end, rank in zip(starts, [*starts[1:], len(ranks)], ranks[starts].tolist(), strict=True):
            self.push(rank, positions[start:end])

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank and its entries; None if there is none."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) | ((word & -word).bit_length() - 1)
        word = self.low[a]
        rank = (a << 6) | ((word & -word).bit_length() - 1)
        word &= word - 1
        if word:
            self.low[a] = word
        else:
            del self.low[a]
            word = self.mid[b] & ~(1 << (a & 63))
            if word:
                self.mid[b] = word
            else:
                del self.mid[b]
                self.top &= ~(1 << b)
        return rank, self.buckets.pop(rank)


#: A stretch of text: its ids in decimal, and the bytes they decode to.
Coded = tuple[str, bytes]


class Codec:
    """Encoder and decoder over a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.span = max(self.vocabulary) + 1
        self.names = {i: str(i) for i in self.vocabulary}
        self.name_sizes, self.token_sizes = np.zeros(self.span, dtype=np.int64), np.zeros(self.span, dtype=np.int64)
        for i, token in self.vocabulary.items():
            self.name_sizes[i], self.token_sizes[i] = len(self.names[i]) + 1, len(token)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = [
            (left * self.span + right, i)
            for token, i in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        ]
        pairs.sort()
        self._pairs = np.array([p for p, _ in pairs], dtype=np.int64)
        self._merged = np.array([i for _, i in pairs], dtype=np.int64)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        return cls(ranks, pattern)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; -1 for those that have none."""
        key = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._merged[at], -1) if len(self._pairs) else np.full(len(key), -1)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token, in strict order of (rank, position)."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        token = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        waits = [-1] * n  # the rank that the pair beginning here waits at

        def offer(i: int) -> None:
            j = after[i]
            rank = ranks.get(token[i] + token[j]) if j < n else None
            waits[i] = -1 if rank is None else rank
            if rank is not None:
                queue.push(rank, i)

        for i in range(n - 1):
            offer(i)
        while (found := queue.pop()) is not None:
            rank, positions = found
            positions.sort()
            for place, i in enumerate(positions):
                if waits[i] != rank:
                    continue
                j = after[i]
                token[i] += token[j]
                waits[j] = -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                offer(i)
                h = before[i]
                if h >= 0:
                    offer(h)
                # What a merge makes is longer, so it never waits at the same
                # rank; should it wait at a lower one, that goes first.
                if -1 < waits[i] < rank or h >= 0 and -1 < waits[h] < rank:
                    for p in positions[place + 1 :]:
                        queue.push(rank, p)
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i]])
            i = after[i]
        return tuple(out)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many pre-tokens, none of them empty."""
        if not pieces:
            return []
        ids, stops, again = self._queued(pieces)
        ids = ids.tolist()
        out = [tuple(ids[a:b]) for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        for i in again:
            out[i] = self.merge(pieces[i])
        # A pre-token that is an entry itself needs no merges to be that id.
        return [(whole,) if (whole := self.ranks.get(p)) is not None else x for p, x in zip(pieces, out, strict=True)]

    def _queued(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """(ids, where each pre-token's end, pre-tokens to be merged by themselves), by
        one queue."""
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        n = int(ends[-1])
        token = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)].astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1], before[starts] = -1, -1
        waits = np.full(n, -1, dtype=np.int32)
        alive = np.ones(n, dtype=bool)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(ends, prepend=0))
        lowest = np.zeros(len(pieces), dtype=np.int32)
        queue, again = RankQueue(), set()

        def offer(at: np.ndarray) -> np.ndarray:
            right = after[at]
            waits[at] = -1
            at, right = at[right >= 0], right[right >= 0]
            rank = self._rank_of(token[at], token[right])
            waits[at] = rank
            queue.push_all(rank[rank >= 0], at[rank >= 0])
            return at

        offer(np.arange(n, dtype=np.int32))
        wide = WIDE
        while True:
            # Ranks in order, until enough positions wait; of each pre-token only the
            # lowest counts, its other ones go back.
            ranks, held, size = [], [], 0
            while size < wide and (found := queue.pop()) is not None:
                rank, arrays = found
                at = arrays[0] if len(arrays) == 1 else np.unique(np.concatenate(arrays))
                at = at[waits[at] == rank]
                if len(at):
                    ranks.append(rank)
                    held.append(at)
                    size += len(at)
            if not held:
                break
            at, rank = np.concatenate(held), np.repeat(np.array(ranks, dtype=np.int32), [len(x) for x in held])
            own = owner[at]
            lowest[own[::-1]] = rank[::-1]
            if len(held) > 1:
                later = lowest[own] != rank
                if later.any():
                    queue.push_all(rank[later], at[later])
                    at, rank = at[~later], rank[~later]
                wide = max(1, wide // 2) if 2 * len(at) < size else min(WIDE, 2 * wide)
                order = np.argsort(at, kind="stable")
                at, rank = at[order], rank[order]
            elif size < wide:
                wide = min(WIDE, 2 * wide)
            # Of pairs that share a node, the first, third, ... of a run merge.
            touching = after[at[:-1]] == at[1:]
            if touching.any():
                place = np.arange(len(at))
                first = np.concatenate([[True], ~touching])
                odd = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
                at, rank = at[odd], rank[odd]
            gone = after[at]
            onward = after[gone]
            # The pair that stands for a moment between two merges side by side.
            beside = np.flatnonzero(at[1:] == onward[:-1])
            if len(beside):
                passing = self._rank_of(rank[beside], token[at[beside + 1]])
                again.update(owner[at[beside[(passing >= 0) & (passing < rank[beside])]]].tolist())
            token[at] = rank
            alive[gone], waits[gone] = False, -1
            after[at] = onward
            before[onward[onward >= 0]] = at[onward >= 0]
            left = before[at]
            fresh = offer(np.unique(np.concatenate([at, left[left >= 0]])))
            lower = fresh[(waits[fresh] >= 0) & (waits[fresh] < lowest[owner[fresh]])]
            if len(lower):
                again.update(owner[lower].tolist())
        return token[alive], np.cumsum(np.add.reduceat(alive.astype(np.int64), starts)), again

    def _coded_matches(self, matches: list[bytes]) -> list[Coded]:
        """Each match coded. Ids of all are written and decoded at once, and cut up."""
        whole = list(map(self.ranks.get, matches))
        rest = [m for m, i in zip(matches, whole, strict=True) if i is None]
        merged = iter(())
        if rest:
            ids, stops, again = self._queued(rest)
            names, tokens = ",".join(map(self.names.__getitem__, held := ids.tolist())), b"".join(map(self.vocabulary.__getitem__, held))
            name_ends, token_ends = (np.cumsum(x[ids])[stops - 1] for x in (self.name_sizes, self.token_sizes))
            cuts = [x.tolist() for x in (name_ends, token_ends)]
            out = [(names[a : b - 1], tokens[c:d]) for a, b, c, d in zip([0, *cuts[0]], cuts[0], [0, *cuts[1]], cuts[1], strict=False)]
            for i in again:
                out[i] = self._coded(self.merge(rest[i]))
            merged = iter(out)
        return [next(merged) if i is None else (self.names[i], self.vocabulary[i]) for i in whole]

    def _coded(self, ids: tuple[int, ...]) -> Coded:
        return ",".join(map(self.names.__getitem__, ids)), self.decode(ids)

    def cut(self, text: str) -> list[str]:
        """Stretches that the pattern can be matched in alone. A space between two
        characters that are not white space begins a match, whatever comes before
        it; so a text can be cut there."""
        return _CUTS.split(text) if text else []

    def encode_all(self, texts: list[str], known: dict[str, Coded] | None = None) -> list[list[Coded]]:
        """The stretches of each text, coded; ``known`` is what is remembered from call
        to call."""
        # What is made here holds no cycles; looking for them takes a third of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts, {} if known is None else known)
        finally:
            if collects:
                gc.enable()

    def _encode_all(self, texts: list[str], known: dict[str, Coded]) -> list[list[Coded]]:
        if len(known) > REMEMBERED:
            known.clear()
        cuts = [self.cut(t) for t in texts]
        new = list(set(chain.from_iterable(cuts)).difference(known))
        matches = list(map(self.find, new))
        distinct = list(set(chain.from_iterable(matches)))
        merged = dict(zip(distinct, self._coded_matches(list(map(str.encode, distinct))), strict=True))
        for piece, found in zip(new, matches, strict=True):
            if len(found) == 1:
                known[piece] = merged[piece]
            else:
                parts = [merged[m] for m in found]
                known[piece] = (",".join(map(_NAMES, parts)), b"".join(map(_DECODED, parts)))
        coded = known.__getitem__
        out = [list(map(coded, c)) for c in cuts]
        for piece in new:
            if len(piece) > LONGEST_REMEMBERED:
                del known[piece]
        return out

    def encode(self, text: str) -> list[int]:
        return _ids(self.encode_all([text])[0])

    def decode(self, ids: list[int] | tuple[int, ...]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_LOADED: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """A worker's codec, which serves all its tasks."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Codec.load(path, pattern)
    return _LOADED[path, pattern]


def tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every whole text."""
    return _coded(docs, path, pattern, digest=False)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, taken
    where the ids are, so that ids needn't leave the task."""
    return _coded(docs, path, pattern, digest=True)


def _coded(docs: DataFrame, path: str, pattern: str, digest: bool) -> DataFrame:
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))

    def make():
        codec, known = _codec(path, pattern), {}  # what is remembered goes with the task

        def work(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            doc_id = batch.column(batch.schema.get_field_index("doc_id"))
            coded = codec.encode_all([t.decode() if t else "" for t in texts], known)
            if not digest:
                ids = pa.array(list(map(_ids, coded)), pa.list_(pa.int32()))
                decoded = pa.array([b"".join(map(_DECODED, c)) for c in coded], pa.binary())
                return pa.RecordBatch.from_arrays([doc_id, ids, decoded], ["doc_id", "ids", "decoded"])
            named = [",".join(map(_NAMES, c)) for c in coded]
            counts = [x.count(",") + 1 if x else 0 for x in named]
            of_ids = [hashlib.sha256(x.encode()).hexdigest() for x in named]
            of_text = [hashlib.sha256(b"".join(map(_DECODED, c))).hexdigest() for c in coded]
            return pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded binary"
    return map_texts(rows, make, schema, QUEUE_BYTES)


def vocabulary(name: str = RANKS) -> tuple[str, str]:
    """Path and pattern of one of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return digests(documents(spark, sf_dir), *vocabulary())
