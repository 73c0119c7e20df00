"""Cleaning: renames, casts, parsing, normalising, one row per business key."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import parsed_time, tidy


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns renamed; names that aren't there are passed over."""
    return df.withColumnsRenamed(dict(names))


def _each(df: DataFrame, columns: Iterable[str], make) -> DataFrame:
    held = {c: make(F.col(c)) for c in columns if c in df.columns}
    return df.withColumns(held) if held else df


def normalise_strings(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _each(df, columns, tidy)


def parse_timestamps(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _each(df, columns, parsed_time)


def cast_numerics(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns cast; null, never an error, where a value doesn't fit."""
    held = {c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns}
    return df.withColumns(held) if held else df


def latest_per_key(df: DataFrame, keys: Iterable[str], order_by: str | None = None, tiebreak: str | Iterable[str] = (), spread: Iterable[str] | None = None) -> DataFrame:
    """One row per key: the latest by ``order_by``, then by each ``tiebreak``; a value
    beats null. What ties even then is settled by the row's other columns, so the
    result does not depend on where rows lie. Rows are dealt out by ``spread``, all or
    some of the keys, before any sort; if it is empty, they lie so already."""
    keys = list(keys)
    spread = keys if spread is None else list(spread)
    df = df.repartition(*spread) if spread else df
    then = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak or ())
    ranked = [c for c in (order_by, *then) if c and c in df.columns]
    rest = [c for c in df.columns if c not in keys and c not in ranked]
    total: list[Column] = [F.col(c).desc_nulls_last() for c in ranked] + [F.col(c).asc_nulls_last() for c in rest]
    window = Window.partitionBy(*keys).orderBy(*(total or [F.lit(1)]))
    return df.withColumn("__nth", F.row_number().over(window)).filter("__nth = 1").drop("__nth")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the schema's columns, in its order and types."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"the frame has no {', '.join(sorted(missing))}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def geolocation_centres(readings: DataFrame) -> DataFrame:
    """One row per zip prefix: centre, commonest city and state, readings. Of
    names equally common, the first in order."""
    return readings.groupBy(F.col("geolocation_zip_code_prefix")).agg(
        F.avg("geolocation_lat").alias("latitude"),
        F.avg("geolocation_lng").alias("longitude"),
        F.mode("geolocation_city", deterministic=True).alias("city"),
        F.mode("geolocation_state", deterministic=True).alias("state"),
        F.count(F.lit(1)).alias("reading_count"),
    )
