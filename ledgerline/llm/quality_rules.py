"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for each document and stores one bit for
each failure beside the measurements. Policies, which are versioned sets of rules,
are then bit operations on the ledger: ``apply_policy`` keeps the rows none of
whose failures the policy counts, and ``ablations`` tells for each rule of a
policy how many documents fail it, fail nothing else, and would be kept without
it, from the counts of the distinct masks alone; no text is read again.

Words are runs of anything but ASCII white space. Defined results: a null or
empty text has no words, all measurements 0 and fails ``too_few_words``; a line
counts as repeated if it holds a word and equals an earlier line, and fails a text
if more than a third of its lines are repeated; a text has few
distinct words if they are less than a twentieth of its words and, since a
vocabulary grows slower than a text, than the square root of five times their
number (the lower bound of the two from 2,000 words on); repeated rows
are judged each for itself; an empty table gives an empty ledger. Whole texts are
read, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_tools import map_texts
from .common import column, documents

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements, in whole numbers, so that it is
    exact; a document without words fails only ``too_few_words``."""

    name: str
    fails: str


#: The order gives each rule its bit; rules are only ever appended.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "3 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("shouting", "n_letters > 0 AND 10 * n_upper > 6 * n_letters"),
    Rule("few_distinct_words", "100 * n_distinct_words < 5 * n_words AND n_distinct_words * n_distinct_words < 5 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        unknown = set(self.rules) - {r.name for r in RULES}
        if unknown:
            raise ValueError(f"policy {self.version}: unknown rules {sorted(unknown)}")
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("too_few_words", "repeated_words")),
        Policy("2024.1", ("too_few_words", "repeated_words", "symbols", "repeated_lines")),
        Policy("2024.2", tuple(r.name for r in RULES)),
    )
}
CURRENT = "2024.2"


def repeated_windows(ids: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(ids)
    if n < width + 1:
        return 0
    window = ids[: n - width + 1].astype(np.int64)
    for k in range(1, width):
        span = int(ids.max()) + 1
        if int(window.max()) >= (1 << 62) // span:
            window = np.unique(window, return_inverse=True)[1].astype(np.int64)
        window = window * span + ids[k : n - width + 1 + k]
    order = np.argsort(window, kind="stable")
    held = window[order]
    same = held[1:] == held[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(held), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = np.zeros(n, dtype=bool)
    starts = order[twice]
    for k in range(width):
        at[starts + k] = True
    return int(at.sum())


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_SPACE = b" \t\n\x0b\x0c\r"


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    if not words:
        return (0,) * len(MEASURES)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    # Bytes of the form 10xxxxxx go on with a character, the others begin one.
    raw = np.frombuffer(text, dtype=np.uint8)
    points = len(raw) - int(np.count_nonzero((raw & 0xC0) == 0x80))
    blanks = len(text) - len(text.translate(None, _SPACE))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    letters = len(text) - len(text.translate(None, _LETTERS))
    return (
        len(words),
        points - blanks,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_windows(ids),
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
        letters,
        len(seen),
    )


def _measured(with_columns: list[str]):
    def make():
        def work(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            rows = list(zip(*map(measure, texts), strict=True))
            held = [batch.column(batch.schema.get_field_index(c)) for c in with_columns]
            return pa.RecordBatch.from_arrays([*held, *(pa.array(r, pa.int64()) for r in rows)], [*with_columns, *MEASURES])

        return work

    return make


def failures() -> Column:
    """The bits of all rules that a measured row fails."""
    bits = [F.when(F.expr(r.fails) & ((F.col("n_words") > 0) | F.lit(i == 0)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed long): every rule, once, for each row."""
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return map_texts(rows, _measured(["doc_id"]), schema).withColumn("failed", failures())


def kept_by(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(marked: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of a ledger that the policy keeps."""
    return marked.filter(kept_by(POLICIES[version]))


def ablations(marked: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_failed_alone (what dropping
    the rule would keep more), n_kept by the policy. The masks are counted first;
    there are at most 2 to the number of rules of them."""
    policy = POLICIES[version]
    masks = marked.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r.name in policy.rules])
    each = masks.select("mask", "n", F.explode(rules).alias("r")).select("mask", "n", "r.rule", "r.bit")
    total = lambda p: F.coalesce(F.sum(F.when(p, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("mask") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("mask") == 0).alias("n_kept"),
    )


def keep_documents(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """``docs``, all columns kept, without the rows that the policy rejects. The
    measurements travel beside each row, so nothing is shuffled."""
    names = docs.columns
    own = [c for c in names if c != "text"]
    inner = {c: f"__c{i}" for i, c in enumerate(own)}
    rows = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in own], column(docs, "text", "string").alias("text"))
    fields = [f"{inner[c]} {docs.schema[c].dataType.simpleString()}" for c in own]
    schema = ", ".join([*fields, "text string", *(f"{m} long" for m in MEASURES)])
    marked = map_texts(rows, _measured([*inner.values(), "text"]), schema).withColumn("failed", failures())
    kept = apply_policy(marked, version)
    return kept.select(*[F.col("text") if c == "text" else F.col(inner[c]).alias(c) for c in names])


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the current policy."""
    marked = ledger(documents(spark, sf_dir))
    base = F.lit(POLICIES["base"].mask).cast("long")
    return marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"),
        kept_by(POLICIES[CURRENT]).alias("kept"),
        "failed",
    )


def op7_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy costs over all documents."""
    return ablations(ledger(documents(spark, sf_dir)))


_LEDGER_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT r, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
    len(list_distinct(words))::BIGINT AS n_distinct_words
  FROM split LEFT JOIN covered USING (r)
), marked AS (
  SELECT *, (""" + " + ".join(f"CASE WHEN ({r.fails}){'' if i == 0 else ' AND n_words > 0'} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES)) + """)::BIGINT AS failed
  FROM measured
)
"""

OP7_SQL = _LEDGER_SQL + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & {POLICIES['base'].mask}) <> 0 AS base_failed, (failed & {POLICIES[CURRENT].mask}) = 0 AS kept, failed
FROM marked
"""

OP7_ABLATIONS_SQL = _LEDGER_SQL + ", rules(rule, bit) AS (VALUES " + ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(RULES)) + f""")
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed,
  count(*) FILTER (failed & {POLICIES[CURRENT].mask} = bit) AS n_failed_alone,
  count(*) FILTER (failed & {POLICIES[CURRENT].mask} = 0) AS n_kept
FROM marked, rules GROUP BY rule
"""
