"""Parts that keep state, run from end to end over a source's rows: ingestion of files,
tables and their versions, the quarantine's trial, streams, generated feeds. Each
works in a new folder below the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import generator, ingest
from ..sources.adapters import Source
from ..sources.tables import Context, Tables, shared_root
from ..streaming import events
from .probe import probe_quarantine


def _context(source: Source, name: str, day: str = "2020-01-01") -> Context:
    return Context(source.spark, f"{shared_root(source.spark).rstrip('/')}/ledgerline-{name}-{uuid.uuid4().hex}", name, day, keep=10)


def landed_twice(source: Source) -> DataFrame:
    """Sellers land; a third of them again, corrected, in a file whose columns stand in
    another order. What is clean is the last that landed."""
    context, entity = _context(source, "landed"), ingest.ENTITIES["sellers"]
    sellers, landing = source.sellers().select(*entity.columns), context.path("landing")
    generator.write_csv(sellers, f"{landing}/first")
    ingest.ingest(context, entity, f"{landing}/*/*.csv", "first")
    third = sellers.filter(F.col("seller_id").cast("long") % 3 == 0)
    generator.write_csv(third.select("seller_state", F.concat(F.lit("Corrected  "), "seller_city").alias("seller_city"), "seller_zip_code_prefix", "seller_id"), f"{landing}/second")
    ingest.ingest(context, entity, f"{landing}/*/*.csv", "second")
    ingest.clean_table(context, "sellers")
    return Tables(context).read("silver.sellers").select("seller_id", "seller_city", "seller_state")


def rescued(source: Source) -> DataFrame:
    """Sellers in files with a column that isn't the entity's, taken out of what was
    rescued."""
    context, entity = _context(source, "rescued"), ingest.ENTITIES["sellers"]
    sellers = source.sellers().select(*entity.columns)
    note = F.when(F.col("seller_id").cast("long") % 3 == 0, F.concat(F.lit("note "), "seller_id"))
    generator.write_csv(sellers.withColumn("note", note), context.path("landing"), files=3)
    ingest.ingest(context, entity, context.path("landing", "*.csv"), "only", mode="rescue")
    return ingest.bronze(context, "sellers").select("seller_id", F.get_json_object(ingest.RESCUED, "$.note").alias("note"))


def versions(source: Source) -> DataFrame:
    """(version, n, widened) of a table that is made, added to, widened and restored."""
    tables = Tables(_context(source, "versions"))
    rows, more = source.table("supplier").select("s_suppkey"), source.table("nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), "n_name")
    rows = rows.withColumn("s_suppkey", F.col("s_suppkey").cast("long"))
    tables.replace("a.t", rows)
    tables.append("a.t", rows)
    tables.append("a.t", more, evolve=True)
    tables.restore("a.t", 0)
    out = None
    for number, name in enumerate(("first", "appended", "evolved", "restored")):
        held = tables.read("a.t", number)
        wide = F.count("n_name") if "n_name" in held.columns else F.lit(0).cast("long")
        row = held.agg(F.lit(name).alias("version"), F.count(F.lit(1)).alias("n"), wide.alias("widened"))
        out = row if out is None else out.unionByName(row)
    return out


def probed(source: Source) -> DataFrame:
    """(rule_id, rows_failed) of the quarantine's trial among the source's lines."""
    context, entity = _context(source, "probed"), ingest.ENTITIES["order_items"]
    raw = source.order_items().select(*[F.col(c).cast("string") for c in entity.columns])
    stamped = raw.withColumns({ingest.RESCUED: F.lit(None).cast("string"), "_source_file": F.lit("made"), "_ingest_ts": F.current_timestamp(), "_batch_id": F.lit("made")})
    Tables(context).replace("bronze.order_items", stamped)
    return source.spark.createDataFrame(list(probe_quarantine(context).items()), "rule_id string, rows_failed long")


def streamed(source: Source) -> DataFrame:
    """Windows over events that come as files, with late and repeated ones, counted by
    a stream up to the end of what is there."""
    context = _context(source, "streamed")
    made = source.events()
    made.repartition(4).write.parquet(context.path("landing"))
    tables = Tables(context)
    stream = source.spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 2).parquet(context.path("landing"))
    counted = events.tumbling(stream, late="3650 days")
    take = lambda df, _: tables.replace("gold.windows", df) and None
    counted.writeStream.outputMode("complete").foreachBatch(take).option("checkpointLocation", context.path("_checkpoints")).trigger(availableNow=True).start().awaitTermination()
    return tables.read("gold.windows")


def generated(source: Source) -> DataFrame:
    """(day, op, n, keys) of three days of changes; no person is in two days."""
    days = [generator.change_day(source.customers(), d, "2018-10-01").withColumn("day", F.lit(d)) for d in (1, 2, 3)]
    return days[0].unionByName(days[1]).unionByName(days[2]).groupBy("day", "op").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("customer_unique_id").alias("keys"))


def batch_runs(source: Source, day: str) -> DataFrame:
    """(what, n) of the whole batch pipeline from CSV files, run twice: rows of the gold
    tables, of the logs, and what the second run read, wrote and found to differ."""
    from . import ops, pipeline

    context = _context(source, "batch", day)
    spark, landing = source.spark, context.path("landing")
    made = {"customers": source.customers(), "orders": source.orders(), "order_items": source.raw_items(), "order_payments": source.order_payments(), "products": source.products(), "sellers": source.sellers(), "product_category_translation": source.translation()}
    for name, df in made.items():
        times = [c for c, kind in df.dtypes if kind == "timestamp"]
        text = df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times}) if times else df
        generator.write_csv(text, f"{landing}/{name}", files=None, compression="gzip")
    feed = source.changes(day).withColumns({"updated_at": F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"), "customer_id": F.lit(None).cast("string")})
    generator.write_csv(feed.select(*generator.CHANGE_COLUMNS), f"{landing}/changes")
    folders = {name: f"{landing}/{name}/*.csv.gz" for name in made}
    runs = [pipeline.run(Context(spark, context.root, run, day, keep=20), folders, f"{landing}/changes") for run in ("first", "second")]
    tables = Tables(context)
    found = {f"gold.{k}": v for k, v in runs[0].items()}
    found["gold tables that the second run changed"] = sum(runs[0][k] != runs[1][k] for k in runs[0])
    found["differences of fingerprints"] = len(ops.differences(Context(spark, context.root, "second", day)))
    log = {(r.run_id, r.task_name): r for r in tables.read("ops.pipeline_runs").collect()}
    found["tasks that succeeded"] = sum(r.status == "SUCCESS" for r in log.values())
    for run in ("first", "second"):
        found[f"{run} run: rows ingested"] = log[run, "ingest"].rows_read
        found[f"{run} run: changes written"] = log[run, "changes"].rows_written
    found["duplicate lines"] = int(log["first", "clean"].details["order_items.duplicates"])
    found["rows with their file and time"] = ingest.bronze(context, "orders").filter("_source_file LIKE '%.csv.gz' AND _ingest_ts IS NOT NULL AND _batch_id = 'first'").count()
    found["rules logged"] = tables.read("ops.dq_results").filter("run_id = 'first'").count()
    found["views"] = len(pipeline.register_views(context))
    return spark.createDataFrame([(k, int(v)) for k, v in found.items()], "what string, n long")
