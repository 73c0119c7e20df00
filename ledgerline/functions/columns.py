"""Column expressions that several operators share; all are built-in and JVM-side."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"


def tidy(text: Column) -> Column:
    """White space collapsed and trimmed, lower-cased; blank becomes null."""
    flat = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.nullif(flat, F.lit(""))


def parsed_time(text: Column, pattern: str = SECOND_FORMAT) -> Column:
    """Timestamp of a text; null, never an error, where it doesn't parse."""
    return F.try_to_timestamp(text, F.lit(pattern))


def date_key(ts: Column) -> Column:
    """yyyyMMdd as an int."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def marked_hash(columns: Iterable[Column]) -> Column:
    """64-bit hash of values and of which of them are null, so that neither a
    null's place nor a value that looks like a marker or separator is ambiguous."""
    parts: list[Column] = []
    for c in columns:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def version_key(key: Column, since: Column) -> Column:
    """Surrogate key of one version; of the instant itself, not of its text, which
    would depend on the session's time zone."""
    return F.xxhash64(key, F.unix_micros(since))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; null for a whole of 0."""
    return F.round(F.lit(100.0).cast("decimal(4,1)") * part / F.nullif(whole, F.lit(0)), digits)
