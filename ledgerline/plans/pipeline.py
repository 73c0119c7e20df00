"""The batch pipeline: land, clean, build the star, apply changes, check."""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, scd2, star
from ..sources import ingest
from ..sources.tables import Context, Tables
from . import ops
from .views import VIEWS, Star, meet_feed


class Silver:
    """A ``Source`` over the silver tables."""

    def __init__(self, context: Context) -> None:
        self.tables = Tables(context)

    def orders(self) -> DataFrame:
        return self.tables.read("silver.orders")

    def customers(self) -> DataFrame:
        return self.tables.read("silver.customers")

    def order_items(self) -> DataFrame:
        return self.tables.read("silver.order_items")

    def order_payments(self) -> DataFrame:
        return self.tables.read("silver.order_payments")

    def products(self) -> DataFrame:
        return self.tables.read("silver.products")

    def translation(self) -> DataFrame:
        return self.tables.read("silver.product_category_translation")

    def sellers(self) -> DataFrame:
        return self.tables.read("silver.sellers")


def seed_customers(context: Context) -> int:
    """Version 1 of every person; nothing if the dimension has rows."""
    tables = Tables(context)
    if tables.count("gold.dim_customer"):
        return 0
    silver, day = Silver(context), F.lit(context.run_date).cast("timestamp")
    people = star.customer_attributes(silver.customers(), silver.orders(), silver.order_items(), day)
    return tables.replace("gold.dim_customer", scd2.seed(people, scd2.CUSTOMER, F.col("first_order_ts")))


def apply_changes(context: Context, changes: DataFrame) -> dict[str, int]:
    """A day's feed to ``gold.dim_customer``; rows per action. What the feed meets is
    staged once, then counted, checked and written from there, in one replacement. A
    feed applied again is all ``unchanged`` and writes nothing."""
    tables = Tables(context)
    tables.replace("ops.stg_transitions", meet_feed(tables.read("gold.dim_customer"), changes))
    met, versions = tables.read("ops.stg_transitions"), tables.read("gold.dim_customer")
    counts = dict.fromkeys((scd2.NEW, scd2.CHANGED, scd2.UNCHANGED, scd2.DELETED), 0)
    counts |= {r[scd2.ACTION]: r.n for r in scd2.action_counts(met).collect()}
    if counts[scd2.NEW] or counts[scd2.CHANGED] or counts[scd2.DELETED]:
        day = F.lit(context.run_date).cast("timestamp")
        wrong = scd2.out_of_order(scd2.closed(met, scd2.CUSTOMER, day)).count()
        if wrong:
            raise ValueError(f"{wrong} versions would end before they begin; the feed is older than what it changes")
        tables.replace("gold.dim_customer", scd2.next_state(versions, met, scd2.CUSTOMER, day))
    return counts


def build_star(context: Context) -> dict[str, int]:
    """Dimensions and facts, each replaced as a whole. Where orders, lines and payments are
    dealt by order, so is ``fact_order``, and none of them is shuffled to meet another."""
    tables, silver = Tables(context), Silver(context)
    orders, items, customers, payments = silver.orders(), silver.order_items(), silver.customers(), silver.order_payments()
    out = {
        "dim_date": tables.replace("gold.dim_date", star.dim_date(orders)),
        "dim_product": tables.replace("gold.dim_product", star.dim_product(silver.products(), silver.translation())),
        "dim_seller": tables.replace("gold.dim_seller", star.dim_seller(silver.sellers())),
        "dim_order_status": tables.replace("gold.dim_order_status", star.dim_order_status(orders)),
        "dim_payment_type": tables.replace("gold.dim_payment_type", star.dim_payment_type(payments)),
    }
    gold = lambda n: tables.read(f"gold.{n}")
    versions, dealt = gold("dim_customer"), tables.commit("silver.orders").dealt
    out["dim_customer"] = versions.count()
    out["fact_order"] = tables.replace("gold.fact_order", star.fact_order(orders, items, customers, versions, gold("dim_order_status"), spread=not tables.commit("silver.order_items").dealt), dealt=dealt)
    lines = star.sold(items, gold("fact_order"), gold("dim_seller")).drop(ingest.RESCUED, *ingest.PROVENANCE)
    with tables.dealt_out(lines, ("product_id", dealt[1])) if dealt else nullcontext(lines) as held:
        out["fact_order_item"] = tables.replace("gold.fact_order_item", star.fact_of_sold(held, gold("dim_product")))
    out["fact_payment"] = tables.replace("gold.fact_payment", star.fact_payment(payments, gold("fact_order"), gold("dim_payment_type")))
    return out


def gold_tables(context: Context) -> dict[str, DataFrame]:
    tables = Tables(context)
    return {n: tables.read(f"gold.{n}") for n in ops.MEASURES if tables.exists(f"gold.{n}")}


class Gold(Star):
    """A star whose tables are read from the gold layer."""

    def __init__(self, context: Context) -> None:
        super().__init__(Silver(context), context.run_date)
        for name, df in gold_tables(context).items():
            self.__dict__[name] = df
        if "fact_order_item" in self.__dict__:
            self.__dict__["order_lines"] = self.__dict__["fact_order_item"]
        if "fact_payment" in self.__dict__:
            self.__dict__["order_payments"] = star.counting_orders(self.__dict__["fact_payment"])


def register_views(context: Context) -> list[str]:
    """The views as temporary views of the session, each with its grain as comment."""
    gold = Gold(context)
    for name, (view, grain) in VIEWS.items():
        view(gold).createOrReplaceTempView(f"{name}_plan")
        context.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} COMMENT '{grain}' AS SELECT * FROM {name}_plan")
    return list(VIEWS)


def declare_constraints(context: Context) -> None:
    """Keys of the gold tables must not be null; what their rows are, as comment."""
    tables = Tables(context)
    for name, key in checks.PRIMARY_KEYS.items():
        if tables.exists(f"gold.{name}"):
            tables.declare(f"gold.{name}", not_null=key, comment=f"one row per {', '.join(key)}")


def run(context: Context, folders: Mapping[str, str], changes: str | None = None, mode: str = "evolve") -> dict[str, int]:
    """Every stage in order, each logged; returns the rows of the gold tables."""
    Tables(context).ensure_layers("bronze", "silver", "gold", "ops")
    ops.ensure_tables(context)
    with ops.logged(context, "ingest") as t:
        t.rows_read = t.rows_written = sum(ingest.ingest_all(context, folders, context.run_id, mode).values())
    with ops.logged(context, "clean") as t:
        for name, c in ingest.clean_all(context, list(folders)).items():
            t.rows_read += c.read
            t.rows_written += c.written
            t.rows_quarantined += c.quarantined
            t.details[f"{name}.duplicates"] = str(c.duplicates)
            if c.results is not None:
                ops.log_quality(context, c.results)
    with ops.logged(context, "seed") as t:
        t.rows_written = seed_customers(context)
    if changes:
        with ops.logged(context, "changes") as t:
            counts = apply_changes(context, ingest.read_changes(context, changes))
            t.rows_read, t.details = sum(counts.values()), {k: str(v) for k, v in counts.items()}
            t.rows_written = t.rows_read - counts[scd2.UNCHANGED]
    with ops.logged(context, "star") as t:
        out = build_star(context)
        t.rows_written = sum(out.values())
        declare_constraints(context)
    with ops.logged(context, "fingerprint") as t:
        t.rows_written = ops.capture(context, gold_tables(context))
        ops.check_repeatable(context)
    return out
