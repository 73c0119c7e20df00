"""Language identification by multilingual mixture inference.

Each learned language has a model of character n-grams within words (one to three
characters, with word edges, hashed): smoothed log-likelihoods. A document's words
are drawn from an unknown mixture of languages; expectation-maximisation finds
the proportions that make the words' n-grams likeliest. The set of languages is
chosen by penalised likelihood: from the likeliest single language on, the next
one by proportion joins as long as the fit gains more than ``PENALTY`` times half
the logarithm of the number of words for each language added. The prediction is
the language of the largest proportion; the score is that proportion.

Counts of n-grams are taken on the executors from a bounded sample of documents
of a known language (``TRAINING_ROWS`` rows that differ, by a hash of the row), and
summed; what reaches the driver are at most ``MOST_LANGUAGES`` x 2 to the power of
BITS counts.

Learned from text and lang alone; lang, source and id are never inputs of a
prediction. Whole texts are read. Defined results: a null text, or one without
letters, is ``und`` with score 0; without any language learned, so is every text;
ties go to the language first in order; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_tools import map_texts, pieces
from .common import U64, WordIds, column, documents, id_crc_mod, mix64, staged

BITS = 16
#: Documents that the models are fitted on, at most.
TRAINING_ROWS = 20_000
#: Rows of crc32(doc_id) modulo FOLDS equal to HELD_OUT are not learned from.
FOLDS, HELD_OUT = 4, 2
PENALTY = 2.0
STEPS = 12
#: In a text of any language a word is noise with this probability: it stands there
#: whatever the language, as likely as in the language that explains it best. So one
#: odd word, however long, can't decide for a text.
NOISE = 1e-11
#: Languages that are learned, at most; more are an error. The model is broadcast.
MOST_LANGUAGES = 1000
UND = "und"
#: They keep n-grams of different length apart (a code point has 21 bits).
_KINDS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))
_LETTERS = regex.compile(r"\p{L}+")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_ASCII = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalpha()), b" " * sum(not chr(b).isalpha() for b in range(128)))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: what lies between ASCII characters that aren't letters;
    of a text without ASCII letters, its runs of letters."""
    if not text:
        return []
    if _ASCII_LETTER.search(text) is None:
        return [w.encode() for w in _LETTERS.findall(text.decode().lower())]
    low = text.lower() if text.isascii() else text.decode().lower().encode()
    return low.translate(_ASCII).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, index of its word) of all character n-grams of words, one to three
    characters, with edges: 3 n + 1 of them for a word of n characters; and n."""
    x = np.frombuffer((b"\x00" + b"\x00".join(words) + b"\x00").decode().encode("utf-32-le"), dtype=np.uint32).astype(U64)
    letter = x != 0
    owner = np.cumsum(~letter) - 1
    at = np.flatnonzero(letter)
    two = np.where(letter[:-1], owner[:-1], owner[1:])
    parts = [
        x[at] ^ _KINDS[0],
        (x[:-1] << U64(21) | x[1:]) ^ _KINDS[1],
        (x[at - 1] << U64(42) | x[at] << U64(21) | x[at + 1]) ^ _KINDS[2],
    ]
    slot = (mix64(np.concatenate(parts)) >> U64(64 - BITS)).astype(np.int32)
    return slot, np.concatenate([owner[at], two, owner[at]]), np.bincount(owner[at], minlength=len(words))


def fit_languages(rows: DataFrame, most: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray] | None:
    """(languages in order, log-likelihoods float32 [languages x slots]) from rows
    (doc_id, text, lang); None if there is nothing to learn from."""
    marked = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # The bound holds by rank among hashes of the rows, which are narrow; rows that
    # are alike are one, so that a row repeated without end stays one.
    known = marked.select("text", "lang", F.xxhash64("doc_id", "lang", "text").alias("h"))
    chosen = staged(known.select("h").distinct().orderBy("h").limit(most))
    sample = known.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.*")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        held: dict[str, np.ndarray] = {}

        def settle() -> None:
            for lang, words in seen.items():
                slot, of, _ = grams(list(words))
                times = np.fromiter(words.values(), dtype=np.float64, count=len(words))
                held[lang] = held.get(lang, 0) + np.bincount(slot, weights=times[of], minlength=1 << BITS)
            seen.clear()

        for batch in batches:
            for piece, texts in pieces(batch):
                for lang, text in zip(piece.column(piece.schema.get_field_index("lang")).to_pylist(), texts, strict=True):
                    if words := words_of(text):
                        seen.setdefault(lang, Counter()).update(words)
                settle()
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64), pa.int64())], ["lang", "slot", "n"])

    summed = sample.select("text", "lang").mapInArrow(counted, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    if not table.num_rows:
        return None
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    slot, n = table.column("slot").to_numpy(), table.column("n").to_numpy()
    names = sorted(set(langs.tolist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages are more than {MOST_LANGUAGES}")
    counts = np.zeros((len(names), 1 << BITS))
    index = {x: i for i, x in enumerate(names)}
    counts[np.array([index[x] for x in langs]), slot] = n
    smooth = 0.1
    total = counts.sum(axis=1, keepdims=True)
    return names, np.log((counts + smooth) / (total + smooth * (1 << BITS))).astype(np.float32)


class WordScores(WordIds):
    """Word -> place in a table of log-likelihoods, one per language."""

    def __init__(self, models: np.ndarray) -> None:
        super().__init__()
        self.models, self.scores = models, np.empty((0, len(models)))

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self._new.append(word)
        return at

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.scores = np.empty((0, len(self.models)))
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self._new:
            slot, of, n = grams(self._new)
            # The mean over a word's n-grams, times its letters: n-grams overlap.
            new = np.array([np.bincount(of, weights=m[slot], minlength=len(n)) for m in self.models]) * ((n + 1) / (3 * n + 1))
            new = np.logaddexp(new - new.max(axis=0), np.log(NOISE))
            self.scores = np.vstack([self.scores, new.T])
            self._new = []
        return self.scores[ids]


def mixtures(score: np.ndarray, of: np.ndarray, n: int, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [n x languages], log-likelihood) by expectation-maximisation,
    for words (rows of ``score``, sorted by ``of``) of ``n`` documents."""
    like = np.exp(np.ascontiguousarray(score.T))  # a language's words lie together
    words = np.bincount(of, minlength=n).astype(float)
    starts = np.searchsorted(of, np.arange(n))
    share = (allowed / allowed.sum(axis=1, keepdims=True)).T
    for _ in range(steps):
        joint = like * share[:, of]
        joint /= np.maximum(joint.sum(axis=0), 1e-300)
        share = np.add.reduceat(joint, starts, axis=1) / words
    fit = np.add.reduceat(np.log(np.maximum((like * share[:, of]).sum(axis=0), 1e-300)), starts)
    return share.T, fit


def infer(score: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Proportions of the chosen languages for ``n`` documents that have words."""
    k = score.shape[1]
    starts = np.searchsorted(of, np.arange(n))
    words = np.bincount(of, minlength=n)
    single = np.add.reduceat(score, starts, axis=0)
    best = single.argmax(axis=1)
    out = np.zeros((n, k))
    out[np.arange(n), best] = 1.0
    if k == 1:
        return out
    cost = PENALTY * 0.5 * np.log(words + 1.0)
    share, fit = mixtures(score, of, n, np.ones((n, k)))
    # No set of languages fits better than all of them.
    open_ = np.flatnonzero(fit - single[np.arange(n), best] > cost)
    if not len(open_):
        return out
    pick = np.isin(of, open_)
    place = np.full(n, -1)
    place[open_] = np.arange(len(open_))
    s, o = score[pick], place[of[pick]]
    order = np.argsort(-share[open_], axis=1, kind="stable")
    value = single[open_, best[open_]]
    held = out[open_]
    for m in range(2, k + 1):
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[:, :m], 1.0, axis=1)
        part, part_fit = mixtures(s, o, len(open_), allowed)
        gain = part_fit - cost[open_] * (m - 1)
        better = gain > value
        value = np.where(better, gain, value)
        held[better] = part[better]
    out[open_] = held
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """(doc_id, lang_pred, score, langs: map of the chosen languages' proportions)
    of every whole text. The model's size is the number of languages times 2 to
    the power of BITS; it is broadcast."""
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        names, models = held.value if held.value is not None else ([], np.empty((0, 1 << BITS), dtype=np.float32))
        table = WordScores(models)
        kinds = pa.map_(pa.string(), pa.float64())

        def work(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            split = [words_of(t) if names else [] for t in texts]
            some = [i for i, s in enumerate(split) if s]
            pred, score, langs = [UND] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if some:
                of = np.repeat(np.arange(len(some)), [len(split[i]) for i in some])
                share = infer(table.rows([w for i in some for w in split[i]]), of, len(some))
                top = share.argmax(axis=1)
                for i, t, row in zip(some, top.tolist(), share, strict=True):
                    pred[i], score[i] = names[t], min(1.0, float(row[t]))
                    langs[i] = [(names[j], float(row[j])) for j in np.flatnonzero(row > 0).tolist()]
            doc_id = batch.column(batch.schema.get_field_index("doc_id"))
            return pa.RecordBatch.from_arrays([doc_id, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, kinds)], ["doc_id", "lang_pred", "score", "langs"])

        return work

    return map_texts(rows, make, "doc_id long, lang_pred string, score double, langs map<string,double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_crc_mod(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from the rows of the other folds."""
    docs = documents(spark, sf_dir)
    learn = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"), column(docs, "lang", "string").alias("lang"))
    model = fit_languages(learn.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
