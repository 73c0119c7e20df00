"""Raw files to the bronze layer, each file once.

A stream of file names with a checkpoint for each table finds what is new, until
nothing is (``availableNow``); running it again reads nothing. Each batch of files is
read by the names in each file's header, wherever its columns stand; columns are all
strings; where a row came from is stamped on it; a batch that is tried again is
committed once. A column that the entity doesn't have widens the table (mode
``evolve``) or goes into ``_rescued_data`` (mode ``rescue``), a JSON object of what
doesn't fit, with a row of another shape whole under ``_row``.
"""

from __future__ import annotations

import csv
import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import cast_numerics, latest_per_key, normalise_strings, parse_timestamps, rename
from ..operators.rules import results, rules_for, split
from .tables import Context, Tables, hadoop, read_text, write_parquet

RESCUED = "_rescued_data"
PROVENANCE = ("_ingest_ts", "_source_file", "_batch_id")
MODES = ("evolve", "rescue")
#: Files of a batch, at most; their names go through the driver.
FILES_PER_BATCH = 1000
#: Large entities are dealt out by these where many folders land together; a bucket for so
#: many bytes that have landed, and so many at least.
DEALT = {"customers": "customer_id", "orders": "order_id", "order_items": "order_id", "order_payments": "order_id", "order_reviews": "order_id"}
BUCKET_BYTES, LEAST_BUCKETS = 40_000_000, 8
_ROW = "_row"
_TIMES = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")


@dataclass(frozen=True)
class Entity:
    """How a raw file becomes an entity."""

    name: str
    columns: tuple[str, ...]
    key: tuple[str, ...]
    sequence: str | None = None
    times: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    numbers: Mapping[str, str] = field(default_factory=dict)
    renames: Mapping[str, str] = field(default_factory=dict)
    csv: Mapping[str, str] = field(default_factory=dict)


# The files' columns, and the misspellings in two of them.
_SIZES = ("product_name_length", "product_description_length", "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
ENTITIES = {
    e.name: e
    for e in (
        Entity("customers", ("customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"), ("customer_id",), texts=("customer_city", "customer_state"), numbers={"customer_zip_code_prefix": "int"}),
        Entity("orders", ("order_id", "customer_id", "order_status", *_TIMES), ("order_id",), "order_purchase_timestamp", _TIMES, ("order_status",)),
        Entity("order_items", ("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"), ("order_id", "order_item_id"), times=("shipping_limit_date",), numbers={"order_item_id": "int", "price": "decimal(10,2)", "freight_value": "decimal(10,2)"}),
        Entity("order_payments", ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"), ("order_id", "payment_sequential"), texts=("payment_type",), numbers={"payment_sequential": "int", "payment_installments": "int", "payment_value": "decimal(10,2)"}),
        Entity("order_reviews", ("review_id", "order_id", "review_score", "review_comment_title", "review_comment_message", "review_creation_date", "review_answer_timestamp"), ("review_id", "order_id"), "review_answer_timestamp", ("review_creation_date", "review_answer_timestamp"), ("review_comment_title",), {"review_score": "int"}, csv={"multiLine": "true", "escape": '"'}),
        Entity("products", ("product_id", "product_category_name", "product_name_lenght", "product_description_lenght", *_SIZES[2:]), ("product_id",), texts=("product_category_name",), numbers=dict.fromkeys(_SIZES, "int"), renames={"product_name_lenght": "product_name_length", "product_description_lenght": "product_description_length"}),
        Entity("sellers", ("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"), ("seller_id",), texts=("seller_city", "seller_state"), numbers={"seller_zip_code_prefix": "int"}),
        Entity("product_category_translation", ("product_category_name", "product_category_name_english"), ("product_category_name",), texts=("product_category_name", "product_category_name_english")),
    )
}


def header(spark: SparkSession, path: str, options: Mapping[str, str] | None = None) -> tuple[str, ...]:
    """The names in a file's first line; empty if it has none. Compressed files are
    opened by the codec of their suffix."""
    fs, at = hadoop(spark, path)
    jvm = spark._jvm
    stream = fs.open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    line = reader.readLine()
    reader.close()
    options = options or {}
    names = next(csv.reader([(line or "").removeprefix("\ufeff")], delimiter=options.get("sep", ","), quotechar=options.get("quote", '"')), [])
    return tuple(n.strip() for n in names)


def _columns(names: tuple[str, ...]) -> list[str]:
    """Column names for a header: odd characters replaced, empty and repeated names
    told apart by their place."""
    out: list[str] = []
    for i, n in enumerate(names):
        n = re.sub(r"[ ,;{}()\n\t=`.]", "_", n) or f"column_{i + 1}"
        out.append(n if n.lower() not in {x.lower() for x in out} else f"{n}_{i + 1}")
    return out


def read_files(spark: SparkSession, entity: Entity, paths: list[str], mode: str = "evolve") -> DataFrame:
    """Rows of CSV files in the entity's columns, all strings, with ``_rescued_data``
    and ``_source_file``. Files of one header are read together."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode}")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(paths):
        by_header.setdefault(header(spark, path, entity.csv), []).append(path)
    out = None
    for names, files in by_header.items():
        held = _columns(names)
        schema = ", ".join([*(f"`{c}` string" for c in held), f"`{_ROW}` string"])
        rows = spark.read.schema(schema).options(header="true", mode="PERMISSIVE", columnNameOfCorruptRecord=_ROW).options(**entity.csv).csv(files)
        more = [c for c in held if c not in entity.columns]
        odd = [*([] if mode == "evolve" else more), _ROW]
        rescued = F.to_json(F.struct(*[F.col(f"`{c}`") for c in odd]))
        rows = rows.withColumn(RESCUED, F.nullif(rescued, F.lit("{}")))
        own = [F.col(f"`{c}`") if c in held else F.lit(None).cast("string").alias(c) for c in entity.columns]
        rows = rows.select(*own, *([F.col(f"`{c}`") for c in more] if mode == "evolve" else []), RESCUED, F.col("_metadata.file_path").alias("_source_file"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def ingest(context: Context, entity: Entity, folder: str, batch_id: str, mode: str = "evolve", buckets: int = 0) -> int:
    """New files of ``folder`` into ``bronze.<entity>``; returns the rows that came. A new
    table of an entity in ``DEALT`` is dealt into ``buckets``, if there are any."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode}")
    spark, tables, target = context.spark, Tables(context), f"bronze.{entity.name}"
    dealt = (DEALT[entity.name], buckets) if buckets and entity.name in DEALT else None
    came = []

    def take(names: DataFrame, number: int) -> None:
        paths = [r.path for r in names.select("path").distinct().collect()]
        if paths:
            rows = read_files(spark, entity, paths, mode)
            rows = rows.withColumns({"_ingest_ts": F.current_timestamp(), "_batch_id": F.lit(batch_id)})
            # The stream is known by its checkpoint's id: a new checkpoint counts anew.
            stream = json.loads(read_text(spark, f"{log}/metadata"))["id"]
            came.append(tables.append(target, rows, evolve=True, batch=(stream, number), dealt=dealt))

    log = context.path("_checkpoints", entity.name)
    # Only names are read here: the content column is pruned.
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", FILES_PER_BATCH).load(folder).select("path")
    found.writeStream.foreachBatch(take).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    if not tables.exists(target):
        stamped = "_source_file string, _ingest_ts timestamp, _batch_id string"
        tables.create(target, ", ".join([*(f"`{c}` string" for c in entity.columns), f"{RESCUED} string", stamped]))
    return sum(came)


def ingest_all(context: Context, folders: Mapping[str, str], batch_id: str, mode: str = "evolve") -> dict[str, int]:
    n = buckets(context, folders)
    return {name: ingest(context, ENTITIES[name], folder, batch_id, mode, n) for name, folder in folders.items()}


def buckets(context: Context, folders: Mapping[str, str]) -> int:
    """Into how many buckets tables are dealt: as those that are there, else by the bytes
    that have landed. It is the same for all, so that they meet without a shuffle."""
    tables = Tables(context)
    for name in folders:
        if tables.exists(f"bronze.{name}") and (held := tables.commit(f"bronze.{name}").dealt):
            return held[1]
    landed = 0
    for folder in folders.values():
        fs, at = hadoop(context.spark, folder)
        landed += sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(at) or ())
    return max(LEAST_BUCKETS, -(-landed // BUCKET_BYTES))


def bronze(context: Context, name: str) -> DataFrame:
    return Tables(context).read(f"bronze.{name}")


def clean(raw: DataFrame, entity: Entity, spread: bool = True) -> DataFrame:
    """Typed, parsed, normalised, one row per key: the latest by the entity's own
    sequence, then the latest to land, then that of the last file by name. Rows that lie
    by key already needn't be ``spread``."""
    df = parse_timestamps(cast_numerics(rename(raw, entity.renames), entity.numbers), entity.times)
    return latest_per_key(normalise_strings(df, entity.texts), entity.key, entity.sequence, ("_ingest_ts", "_source_file"), None if spread else ())


@dataclass(frozen=True)
class Cleaned:
    read: int
    written: int
    quarantined: int
    results: DataFrame | None

    @property
    def duplicates(self) -> int:
        return self.read - self.written - self.quarantined


def clean_table(context: Context, name: str) -> Cleaned:
    """``bronze.<name>`` to ``silver.<name>``, rejected rows to
    ``silver.quarantine_<name>``, if the table has rules."""
    if name not in ENTITIES:
        raise ValueError(f"unknown table {name}")
    tables, rules, raw = Tables(context), rules_for(name), bronze(context, name)
    dealt = tables.commit(f"bronze.{name}").dealt
    df = clean(raw, ENTITIES[name], spread=not dealt)
    if not rules:
        return Cleaned(raw.count(), tables.replace(f"silver.{name}", df, dealt=dealt), 0, None)
    # The clean rows are found once, in a folder of their own; what is kept, what is not
    # and the counts, a row for each rule, are read from there. Where all are kept, that
    # folder becomes the table and nothing is written again.
    stage = context.path("_stages", f"{name}-{uuid.uuid4().hex}")
    try:
        write_parquet(df, stage, dealt)
        staged = context.spark.read.schema(df.schema).parquet(stage)
        kept, out = split(staged, rules)
        found = results(staged, rules)
        found = context.spark.createDataFrame(found.collect(), found.schema)
        if out.isEmpty():
            n, quarantined = tables.adopt(f"silver.{name}", stage, kept.schema, dealt=dealt), tables.replace(f"silver.quarantine_{name}", out.limit(0))
        else:
            n, quarantined = tables.replace(f"silver.{name}", kept, dealt=dealt), tables.replace(f"silver.quarantine_{name}", out)
    finally:
        fs, at = hadoop(context.spark, stage)
        fs.delete(at, True)
    return Cleaned(raw.count(), n, quarantined, found)


def clean_all(context: Context, names: list[str] | None = None) -> dict[str, Cleaned]:
    names = list(ENTITIES) if names is None else names
    unknown = sorted(set(names) - set(ENTITIES))
    if unknown:
        raise ValueError(f"unknown tables {unknown}")
    return {n: clean_table(context, n) for n in names}


def read_changes(context: Context, path: str) -> DataFrame:
    """A change feed's CSV, normalised as the entities are; a time that doesn't
    parse is null, and so loses to any that does."""
    schema = "op string, customer_id string, customer_unique_id string, customer_city string, customer_state string, updated_at string"
    df = context.spark.read.option("header", "true").schema(schema).csv(path)
    return parse_timestamps(normalise_strings(df, ("customer_city", "customer_state")), ("updated_at",))
