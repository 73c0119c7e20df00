"""A live trial of the quarantine: rows that break rules are put among the raw ones,
the real cleaning runs, and the versions that were there are restored.

It tells an empty quarantine of good data from one that doesn't work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import FAILED
from ..sources import ingest
from ..sources.tables import Context, Tables
from . import ops

TABLE = "order_items"
#: One row for each rule, a null that a comparison passes over, one row
#: that breaks two rules, and a good one.
_SHIPS = "2018-01-01 00:00:00"
ROWS = (
    (None, "1", "probe_p", "probe_s", _SHIPS, "10.00", "5.00"),
    ("probe_2", "1", None, "probe_s", _SHIPS, "10.00", "5.00"),
    ("probe_3", "1", "probe_p", "probe_s", _SHIPS, "-10.00", "5.00"),
    ("probe_4", "1", "probe_p", "probe_s", _SHIPS, "10.00", "-5.00"),
    ("probe_5", "0", "probe_p", "probe_s", _SHIPS, "10.00", "5.00"),
    ("probe_6", "1", "probe_p", "probe_s", _SHIPS, None, "5.00"),
    ("probe_7", "1", "probe_p", "probe_s", _SHIPS, "-1.00", "-1.00"),
    ("probe_8", "1", "probe_p", "probe_s", _SHIPS, "10.00", "5.00"),
)
EXPECTED = {
    "order_items.order_id_not_null": 1,
    "order_items.product_id_not_null": 1,
    "order_items.price_non_negative": 3,
    "order_items.freight_non_negative": 2,
    "order_items.item_sequence_positive": 1,
}
QUARANTINED, KEPT, TWICE, GOOD = 7, 1, "probe_7", "probe_8"


def _fired(out: DataFrame) -> dict[str, int]:
    return {r.rule: r.n for r in out.select(F.explode(FAILED).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}


def probe_quarantine(context: Context) -> dict[str, int]:
    """Rows that each rule caught, of those put in; what is not as expected is raised,
    after raw and clean tables are as they were."""
    tables, wrong = Tables(context), []
    raw, clean, out = f"bronze.{TABLE}", f"silver.{TABLE}", f"silver.quarantine_{TABLE}"
    ingest.clean_table(context, TABLE)
    versions, before = {n: tables.version(n) for n in (raw, clean, out)}, {n: tables.count(n) for n in (raw, clean, out)}
    had = _fired(tables.read(out))
    rows = context.spark.createDataFrame(list(ROWS), ", ".join(f"{c} string" for c in ingest.ENTITIES[TABLE].columns))
    rows = rows.withColumns({"_ingest_ts": F.current_timestamp(), "_source_file": F.lit("probe"), "_batch_id": F.lit(f"probe-{context.run_id}")})
    tables.append(raw, rows, evolve=True)
    try:
        cleaned = ingest.clean_table(context, TABLE)
        ops.log_quality(context, cleaned.results)
        kept, caught = tables.read(clean), tables.read(out)
        now = _fired(caught)
        fired = {k: now.get(k, 0) - had.get(k, 0) for k in sorted(EXPECTED | now) if now.get(k, 0) != had.get(k, 0)}
        logged = {r.rule_id: r.rows_failed for r in tables.read("ops.dq_results").filter((F.col("run_id") == context.run_id) & (F.col("table_name") == TABLE)).collect()}
        for what, got, want in (
            ("rows in quarantine", caught.count() - before[out], QUARANTINED),
            ("rows kept", kept.count() - before[clean], KEPT),
            ("rows by rule", fired, EXPECTED),
            ("rules of the row that breaks two", [len(r[0]) for r in caught.filter(F.col("order_id") == TWICE).select(FAILED).collect()], [2]),
            ("the good row, kept and caught", (kept.filter(F.col("order_id") == GOOD).count(), caught.filter(F.col("order_id") == GOOD).count()), (1, 0)),
            ("rows by rule in the log", {k: logged.get(k, 0) - had.get(k, 0) for k in EXPECTED}, EXPECTED),
        ):
            if got != want:
                wrong.append(f"{what}: {got}, not {want}")
    finally:
        for name, version in versions.items():
            tables.restore(name, version)
    after = {n: tables.count(n) for n in before}
    if after != before:
        wrong.append(f"rows afterwards: {after}, not {before}")
    if wrong:
        raise AssertionError("; ".join(wrong))
    return fired
