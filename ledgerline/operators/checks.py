"""Constraints as queries: duplicate keys, orphans, nulls; empty if all hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIMARY_KEYS = {
    "dim_date": ("date_sk",), "dim_customer": ("customer_sk",), "dim_product": ("product_sk",), "dim_seller": ("seller_sk",),
    "dim_order_status": ("order_status_sk",), "dim_payment_type": ("payment_type_sk",),
    "fact_order": ("order_id",), "fact_order_item": ("order_id", "order_item_id"), "fact_payment": ("order_id", "payment_sequential"),
}
FOREIGN_KEYS = (
    ("fact_order", "customer_sk", "dim_customer", "customer_sk"), ("fact_order", "order_status_sk", "dim_order_status", "order_status_sk"),
    ("fact_order", "order_date_sk", "dim_date", "date_sk"), ("fact_order", "delivered_date_sk", "dim_date", "date_sk"),
    ("fact_order_item", "product_sk", "dim_product", "product_sk"), ("fact_order_item", "seller_sk", "dim_seller", "seller_sk"),
    ("fact_order_item", "customer_sk", "dim_customer", "customer_sk"), ("fact_order_item", "order_date_sk", "dim_date", "date_sk"),
    ("fact_payment", "payment_type_sk", "dim_payment_type", "payment_type_sk"), ("fact_payment", "customer_sk", "dim_customer", "customer_sk"),
    ("fact_payment", "order_date_sk", "dim_date", "date_sk"),
)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are null in part or held by several rows, with their count."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | null)


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows that refer to no row of ``parent``; null refers to nothing."""
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def counted(df: DataFrame, column: str) -> DataFrame:
    """(value, n): how many rows hold each value; null refers to nothing."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def constraint_report(tables: dict[str, DataFrame], references: Mapping[tuple[str, str], DataFrame] | None = None) -> DataFrame:
    """(constraint, violations) of every key and reference. What refers is counted by
    value before it meets what it refers to; ``references`` gives, by table and column,
    such counts (value, n) that are known otherwise."""
    found, known = [], references or {}
    named = lambda df, name, n: df.agg(n.alias("violations")).select(F.lit(name).alias("constraint_name"), "violations")
    for table, key in PRIMARY_KEYS.items():
        found.append(named(duplicate_keys(tables[table], key), f"pk_{table}", F.count(F.lit(1))))
    for table, column, parent, key in FOREIGN_KEYS:
        values = known[table, column] if (table, column) in known else counted(tables[table], column)
        found.append(named(orphans(values, "value", tables[parent], key), f"fk_{table}_{column}", F.coalesce(F.sum("n"), F.lit(0))))
    return reduce(DataFrame.unionByName, found)
