"""Run log, quality log, fingerprints, SQL files."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Context, Tables

#: The logs: grain, and columns.
LOGS = {
    "ops.pipeline_runs": ("one row per run and task", "run_id string NOT NULL COMMENT 'the run', task_name string NOT NULL, run_date date COMMENT 'the day that the run works on, not the day it runs', started_at timestamp, ended_at timestamp, duration_seconds double, status string COMMENT 'SUCCESS or FAILED', rows_read bigint, rows_written bigint, rows_quarantined bigint, error_message string, details map<string,string>"),
    "ops.dq_results": ("one row per run, table and rule", "run_id string NOT NULL, run_date date, table_name string, rule_id string NOT NULL, description string, severity string, rows_checked bigint, rows_failed bigint, failure_rate double, evaluated_at timestamp"),
    "ops.gold_fingerprints": ("one row per run and gold table", "run_id string NOT NULL, run_date date, captured_at timestamp, table_name string NOT NULL, row_count bigint, measure_sums map<string,decimal(20,2)>"),
}
#: The measures whose sums a table's fingerprint holds.
MEASURES = {
    "dim_date": (), "dim_customer": ("lifetime_value",), "dim_product": (), "dim_seller": (), "dim_order_status": (), "dim_payment_type": (),
    "fact_order": ("order_total", "items_total", "freight_total"), "fact_order_item": ("item_revenue", "item_price"), "fact_payment": ("payment_value",),
}


def ensure_tables(context: Context) -> list[str]:
    """The logs, made where they aren't there; those that were made."""
    return [name for name, (grain, ddl) in LOGS.items() if Tables(context).create(name, ddl, grain)]


@dataclass
class Task:
    """What a task has done; filled in while it runs."""

    rows_read: int = 0
    rows_written: int = 0
    rows_quarantined: int = 0
    details: dict[str, str] = field(default_factory=dict)


@contextmanager
def logged(context: Context, name: str) -> Iterator[Task]:
    """One row in ``ops.pipeline_runs`` however the task ends; an error is logged
    and raised again."""
    task, began, error = Task(), time.time(), None
    try:
        yield task
    except BaseException as e:
        error = f"{type(e).__name__}: {e}"[:2000]
        raise
    finally:
        ended = time.time()
        row = (context.run_id, name, context.run_date, began, ended, ended - began, "FAILED" if error else "SUCCESS", task.rows_read, task.rows_written, task.rows_quarantined, error, {k: str(v) for k, v in task.details.items()})
        raw = "run_id string, task_name string, run_date string, started_at double, ended_at double, duration_seconds double, status string, rows_read bigint, rows_written bigint, rows_quarantined bigint, error_message string, details map<string,string>"
        df = context.spark.createDataFrame([row], raw)
        df = df.withColumns({"run_date": F.to_date("run_date"), "started_at": F.timestamp_seconds("started_at"), "ended_at": F.timestamp_seconds("ended_at")})
        ensure_tables(context)
        Tables(context).append("ops.pipeline_runs", df)


def log_quality(context: Context, results: DataFrame) -> int:
    stamped = results.withColumns({"run_id": F.lit(context.run_id), "run_date": F.to_date(F.lit(context.run_date)), "evaluated_at": F.current_timestamp()})
    ensure_tables(context)
    return Tables(context).append("ops.dq_results", stamped)


def fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count, measure_sums) of the tables that are there."""
    found = []
    for name, measures in MEASURES.items():
        if name in tables:
            sums = [F.sum(F.col(m).cast("decimal(20,2)")).cast("decimal(20,2)").alias(m) for m in measures]
            counted = tables[name].agg(F.count(F.lit(1)).alias("row_count"), *sums)
            pairs = [x for m in measures for x in (F.lit(m), F.col(m))]
            held = F.create_map(*pairs) if pairs else F.create_map()
            found.append(counted.select(F.lit(name).alias("table_name"), "row_count", held.cast("map<string,decimal(20,2)>").alias("measure_sums")))
    return reduce(DataFrame.unionByName, found)


def capture(context: Context, tables: dict[str, DataFrame]) -> int:
    stamped = fingerprint(tables).withColumns({"run_id": F.lit(context.run_id), "run_date": F.to_date(F.lit(context.run_date)), "captured_at": F.current_timestamp()})
    ensure_tables(context)
    return Tables(context).append("ops.gold_fingerprints", stamped)


def differences(context: Context) -> list[str]:
    """How this run's fingerprints differ from those of the last other run of the
    same date; none if there is no such run. One row per table is read."""
    held = Tables(context).read("ops.gold_fingerprints").filter(F.col("run_date") == F.to_date(F.lit(context.run_date)))
    before = held.filter(F.col("run_id") != context.run_id).orderBy(F.col("captured_at").desc(), "run_id").limit(1).collect()
    if not before:
        return []
    read = lambda run: {r.table_name: (r.row_count, r.measure_sums) for r in held.filter(F.col("run_id") == run).collect()}
    old, new = read(before[0].run_id), read(context.run_id)
    out = [f"{t}: not there any more" for t in sorted(set(old) - set(new))] + [f"{t}: not there before" for t in sorted(set(new) - set(old))]
    for t in sorted(set(old) & set(new)):
        if old[t][0] != new[t][0]:
            out.append(f"{t}: {old[t][0]} rows, now {new[t][0]}")
        names = sorted(set(old[t][1]) | set(new[t][1]))
        out += [f"{t}.{m}: {old[t][1].get(m)}, now {new[t][1].get(m)}" for m in names if old[t][1].get(m) != new[t][1].get(m)]
    return out


def check_repeatable(context: Context, strict: bool = True) -> list[str]:
    found = differences(context)
    if found and strict:
        raise AssertionError("this run differs from the last of its date:\n" + "\n".join(found))
    return found


# --- SQL files ------------------------------------------------------------
_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|;|[^-/'\"`;]+|.", re.S)


def statements(sql: str, values: dict[str, str] | None = None) -> list[str]:
    """The statements of a text, without comments; ``${name}`` is replaced.
    Semicolons and dashes in quotes are left alone."""
    for k, v in (values or {}).items():
        sql = sql.replace(f"${{{k}}}", v)
    out, now = [], []
    for t in _TOKEN.findall(sql):
        if t == ";":
            out.append("".join(now).strip())
            now = []
        elif not t.startswith(("--", "/*")):
            now.append(t)
    out.append("".join(now).strip())
    return [s for s in out if s]


def load_statements(folder: str | Path, values: dict[str, str] | None = None) -> list[str]:
    """Of all ``*.sql`` files of a folder, in order of their names."""
    return [s for f in sorted(Path(folder).glob("*.sql")) for s in statements(f.read_text(), values)]
