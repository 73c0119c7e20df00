"""What grows with the tables: shuffles and sorts of plans, tables that a query makes."""

import re
import shutil

from pyspark.sql import functions as F

from ledgerline.operators import checks, cleaning, star
from ledgerline.plans import probe, views
from ledgerline.plans.catalog import QUERIES
from ledgerline.sources import ingest
from ledgerline.sources.adapters import Source
from ledgerline.sources.tables import Context, Tables

SMALL = "/root/testdata/sf0.001"
ITEMS = "order_id string, order_item_id int, product_id string, seller_id string, shipping_limit_date timestamp, price decimal(10,2), freight_value decimal(10,2)"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def scans(df):
    return plan(df).count("FileScan parquet")


def folder(tmp_path, spark, **changed):
    """A copy of the small tables, some of them replaced by frames."""
    out = tmp_path / "tables"
    shutil.copytree(SMALL, out)
    for name, df in changed.items():
        (out / f"{name}.parquet").unlink()
        df.write.parquet(str(out / f"{name}.parquet"))
    return str(out)


def made(spark, at):
    """The tables that a folder's mart has written."""
    tables = Tables(views.mart(spark, at).context)
    return {n for n in views.KEPT if tables.exists(f"gold.{n}")}


def test_the_latest_of_a_key_is_not_sorted_before_rows_are_dealt_out(spark):
    held = plan(cleaning.latest_per_key(spark.range(9).selectExpr("id % 2 AS k", "id"), ("k",), "id"))
    assert "Sort" in held and "Sort" not in held.split("Exchange", 1)[1]


def test_totals_of_lines_take_one_shuffle(spark):
    items = spark.createDataFrame([("a", 1, "p", "s", None, None, None), ("a", 2, "p", "s", None, None, None), ("a", None, "p", None, None, None, None)], ITEMS)
    assert exchanges(star.line_totals(items)) == 1
    assert exchanges(star.line_totals(Source(spark, SMALL).order_items(), spread=False)) == 1
    (r,) = star.line_totals(items).collect()
    assert (r.n, r.c, r.s) == (3, 2, 1)


def test_orders_are_not_joined_with_themselves_for_their_person(spark, tmp_path):
    at = folder(tmp_path, spark)
    QUERIES["dashboard_delivery_by_state"](spark, at).collect()
    assert "items" not in made(spark, at)
    mart = views.mart(spark, at)
    assert (scans(mart.fresh("placed")), scans(mart.fresh("fact_order"))) == (2, 3)  # orders, lines; these, versions, statuses


def test_totals_of_lines_are_not_written_and_orders_are_dealt_out_raw(spark, tmp_path):
    at = folder(tmp_path, spark)
    mart = views.mart(spark, at)
    assert "lines" not in made(spark, at) and "lines" not in views.KEPT
    held = plan(mart.fresh("placed"))
    assert "order_estimated_delivery_date" in held and "order_estimated_delivery_date" not in held.split("Exchange hashpartitioning", 1)[1]
    assert scans(mart.fresh("placed")) == exchanges(mart.fresh("placed")) == 2  # orders and lines, each dealt out once


def test_payments_are_made_where_their_orders_are_dealt_out(spark, tmp_path):
    at = folder(tmp_path, spark)
    mart = views.mart(spark, at)
    for name in ("fact_payment", "order_payments"):
        assert "Generate explode" in plan(mart.fresh(name)) and all("Generate" not in x for x in plan(mart.fresh(name)).split("REPARTITION_BY_COL")[1:])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(mart.source.order_payments(spread=True)) == key(mart.source.order_payments())


def test_measures_and_sellers_take_lines_and_orders_only(spark, tmp_path):
    at = folder(tmp_path, spark)
    QUERIES["dashboard_measures"](spark, at).collect()
    assert made(spark, at) == {"order_lines"}
    QUERIES["v_seller_monthly_performance"](spark, at).collect()
    assert made(spark, at) == {"order_lines", "dim_date", "dim_seller"}


def test_orders_meet_both_versions_of_their_person_in_one_shuffle(spark, tmp_path):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    at = folder(tmp_path, spark, orders=orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey") + 5_000_000).when(F.col("o_orderkey") % 9 != 1, F.col("o_custkey"))))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES["v_order_point_in_time"](spark, at)
        assert made(spark, at) == {"placed", "attributes", "seeded", "dim_customer"}
        assert exchanges(found) == 3  # orders; versions; live versions
        rows = sorted((r.order_id, r.order_total, r.city_at_order_time or "", str(r.version_effective_from), r.city_current or "", str(r.customer_has_moved_since)) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    mart = views.mart(spark, at)
    then = mart.dim_customer.selectExpr("customer_sk", "customer_city AS t", "effective_from")
    now = mart.dim_customer.filter("is_current AND NOT is_deleted").selectExpr("customer_unique_id", "customer_city AS n")
    facts = mart.fact_order.join(then, "customer_sk", "left").join(now, "customer_unique_id", "left").withColumns({"moved": F.expr("t <> n"), "total": F.col("order_total").cast("double")})
    assert rows == sorted((r.order_id, r.total, r.t or "", str(r.effective_from), r.n or "", str(r.moved)) for r in facts.collect())
    assert len(rows) == orders.count() and {r[5] for r in rows} == {"True", "False", "None"}


def test_cities_of_orders_take_no_lines(spark, tmp_path):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    at = folder(tmp_path, spark, orders=orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey") + 5_000_000).when(F.col("o_orderkey") % 9 != 1, F.col("o_custkey"))))
    found = QUERIES["question_city_at_order_time"](spark, at)
    assert made(spark, at) == {"places"}
    rows = {r.city: (r.orders, r.moved_since) for r in found.collect()}
    mart = views.mart(spark, at)
    by = views.order_point_in_time(mart).groupBy("city_at_order_time").agg(F.count(F.lit(1)).alias("n"), F.count_if("customer_has_moved_since").alias("m"))
    assert rows == {r.city_at_order_time: (r.n, r.m) for r in by.collect()}
    assert sum(n for n, _ in rows.values()) == orders.count() and None in rows and any(m for _, m in rows.values())


def test_lines_of_sellers_are_neither_written_nor_dealt_out_again(spark, tmp_path):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    again = orders.filter("o_orderkey % 3 = 0").withColumn("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL '5' DAY"))
    at = folder(tmp_path, spark, orders=orders.unionAll(again))
    found = QUERIES["v_seller_monthly_performance"](spark, at)
    rows = {(r.seller_id, r.year_month): (r.orders, r.order_lines) for r in found.collect()}
    assert made(spark, at) == {"dim_date", "dim_seller"} and not re.findall(r"Exchange hashpartitioning\([^)]*order_id[^)]*year_month|Exchange hashpartitioning\([^)]*year_month[^)]*order_id", plan(found))
    mart = views.mart(spark, at)
    lines = mart.order_lines.filter("NOT is_cancelled").join(mart.dim_date.selectExpr("date_sk AS order_date_sk", "year_month"), "order_date_sk")
    assert rows == {(r.seller_id, r.year_month): (r.n, r.m) for r in lines.groupBy("seller_id", "year_month").agg(F.count_distinct("order_id").alias("n"), F.count(F.lit(1)).alias("m")).collect()}
    assert any(n < m for n, m in rows.values())


def test_completion_takes_payments_and_orders_only(spark, tmp_path):
    at = folder(tmp_path, spark)
    QUERIES["v_payment_method_completion"](spark, at).collect()
    assert made(spark, at) == {"order_payments"}


def test_orders_of_a_payment_type_are_counted_without_dealing_out_payments(spark, tmp_path):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    again = orders.filter("o_orderkey % 3 = 0").withColumns({"o_orderstatus": F.lit("P"), "o_orderpriority": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))})
    at = folder(tmp_path, spark, orders=orders.unionAll(again))
    found = QUERIES["v_payment_method_completion"](spark, at)
    mart = views.mart(spark, at)
    assert exchanges(found) == 1 and "order_id" not in plan(found) and exchanges(mart.fresh("order_payments")) == 2
    by = mart.order_payments.groupBy("payment_type").agg(F.count_distinct("order_id").alias("n"), F.count_distinct(F.when(F.col("order_completed"), F.col("order_id"))).alias("c"))
    rows = {r.payment_type: (r.orders, r.completed_orders) for r in found.collect()}
    assert rows == {r.payment_type: (r.n, r.c) for r in by.collect()} and None in rows
    gold = star.counting_orders(mart.fact_payment).filter("counts_order").groupBy("payment_type").count()
    assert {r.payment_type: r["count"] for r in gold.collect()} == {t: n for t, (n, _) in rows.items()}


def test_facts_take_the_version_that_the_order_has(spark, tmp_path):
    at = folder(tmp_path, spark)
    mart = views.mart(spark, at)
    for name in ("fact_order_item", "fact_payment"):
        held = plan(mart.fresh(name))
        assert "effective_from" not in held
        assert mart.fresh(name).join(mart.fact_order.withColumnRenamed("customer_sk", "own"), "order_id").filter(~F.col("own").eqNullSafe(F.col("customer_sk"))).isEmpty()


def test_constraints_do_not_deal_out_lines_by_product(spark, tmp_path):
    at = folder(tmp_path, spark)
    held = {r.constraint_name: r.violations for r in QUERIES["constraint_violations"](spark, at).collect()}
    assert {"line_keys", "fact_payment"} <= made(spark, at) and not made(spark, at) & {"fact_order_item", "order_lines"}
    mart = views.mart(spark, at)
    assert "product_id" not in "".join(re.findall(r"hashpartitioning\((.*?),", plan(mart.fresh("line_keys"))))
    of_facts = mart.tables()
    of_facts["dim_seller"] = of_facts["dim_seller"].filter("seller_id % 5 <> 0")
    of_facts["dim_product"] = of_facts["dim_product"].filter("product_id % 3 <> 0")
    tables, references = mart.checked()
    found = lambda *x: {r.constraint_name: r.violations for r in checks.constraint_report(*x).collect()}
    assert found(tables | {n: of_facts[n] for n in ("dim_seller", "dim_product")}, references) == found(of_facts)
    lost = mart.fact_order_item.filter("product_sk IS NOT NULL").join(of_facts["dim_product"], "product_sk", "left_anti").count()
    assert found(of_facts)["fk_fact_order_item_product_sk"] == lost > 0 and held["fk_fact_order_item_seller_sk"] > 0


def test_constraints_read_lines_once_and_no_money(spark, tmp_path):
    orders, lines = spark.read.parquet(f"{SMALL}/orders.parquet"), spark.read.parquet(f"{SMALL}/lineitem.parquet")
    orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey") + 5_000_000).when(F.col("o_orderkey") % 9 != 1, F.col("o_custkey")))
    tied = lines.filter("l_orderkey % 2 = 0").withColumn("l_extendedprice", F.col("l_extendedprice") + 1)
    later = lines.filter("l_orderkey % 3 = 0").withColumns({"l_suppkey": F.col("l_suppkey") + 1, "l_shipdate": F.col("l_shipdate") + F.expr("INTERVAL '1' DAY")})
    at = folder(tmp_path, spark, orders=orders.unionAll(orders.filter("o_orderkey % 50 = 0")), lineitem=lines.unionAll(tied).unionAll(later))
    held = {r.constraint_name: r.violations for r in QUERIES["constraint_report"](spark, at).collect()}
    assert {"places", "order_keys", "line_keys", "fact_payment"} <= made(spark, at) and not made(spark, at) & {"placed", "attributes", "seeded", "dim_customer", "fact_order", "fact_order_item"}
    mart = views.mart(spark, at)
    held_plan = plan(mart.fresh("line_keys"))
    assert "l_extendedprice" not in held_plan and "l_tax" not in held_plan and "l_partkey" in held_plan
    key = lambda df: sorted(map(str, df.collect()))
    assert key(mart.places) == key(mart.dim_customer.select(*mart.places.columns))
    assert key(mart.order_keys) == key(mart.fact_order.select(*mart.order_keys.columns))
    products = mart.dim_product.select("product_id", "product_sk")
    of_lines = ("order_id", "order_item_id", "product_sk", "seller_sk", "customer_sk", "order_date_sk")
    assert key(mart.line_keys.join(products, "product_id", "left").select(*of_lines)) == key(mart.fact_order_item.select(*of_lines))
    assert held == {r.constraint_name: r.violations for r in checks.constraint_report(mart.tables()).collect()} and held["pk_fact_order"] > 0


def test_constraints_find_lines_of_a_product_that_is_there_twice(spark, tmp_path):
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    at = folder(tmp_path, spark, part=part.unionAll(part.filter("p_partkey = 7")))
    held = {r.constraint_name: r.violations for r in QUERIES["constraint_report"](spark, at).filter("violations > 0").collect()}
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").filter("l_partkey = 7").select("l_orderkey", "l_linenumber").distinct().count()
    assert held.keys() == {"pk_dim_product", "pk_fact_order_item"} and 0 < held["pk_fact_order_item"] <= lines


def test_a_seller_that_is_there_twice_has_lines_twice_in_one_row(spark, tmp_path):
    sellers = spark.read.parquet(f"{SMALL}/supplier.parquet")
    rows = lambda at: {(r.seller_id, r.year_month): (r.revenue, r.orders, r.order_lines) for r in QUERIES["v_seller_monthly_performance"](spark, at).collect()}
    once, twice = rows(SMALL), rows(folder(tmp_path, spark, supplier=sellers.unionAll(sellers)))
    assert once.keys() == twice.keys()
    assert all((round(2 * v, 2), n, 2 * m) == (round(twice[k][0], 2), *twice[k][1:]) for k, (v, n, m) in once.items())


def test_a_table_is_cleaned_once_and_the_probe_restores_it(spark, tmp_path):
    context = Context(spark, str(tmp_path / "root"), "probed", "2020-01-01")
    raw = Source(spark, SMALL).order_items().select(*[F.col(c).cast("string") for c in ingest.ENTITIES["order_items"].columns])
    stamps = {ingest.RESCUED: F.lit(None).cast("string"), "_source_file": F.lit("made"), "_ingest_ts": F.current_timestamp(), "_batch_id": F.lit("made")}
    Tables(context).replace("bronze.order_items", raw.withColumns(stamps))
    cleaned = ingest.clean_table(context, "order_items")
    assert cleaned.read == cleaned.written == raw.count() and "Window" not in plan(cleaned.results)
    assert not any((tmp_path / "root" / "_stages").iterdir())
    probe.probe_quarantine(context)
    for name in ("bronze.order_items", "silver.order_items", "silver.quarantine_order_items"):
        *_, before, _, after = (Tables(context).commit(name, n).folders for n in Tables(context).history(name))
        assert before == after


def test_clean_rows_are_written_again_only_where_some_are_rejected(spark, tmp_path, monkeypatch):
    context, written = Context(spark, str(tmp_path / "root"), "adopted", "2020-01-01"), []
    real = Tables._written
    monkeypatch.setattr(Tables, "_written", lambda self, name, df: written.append(name) or real(self, name, df))
    columns = ", ".join(f"{c} string" for c in ingest.ENTITIES["sellers"].columns)
    stamps = {ingest.RESCUED: F.lit(None).cast("string"), "_source_file": F.lit("made"), "_ingest_ts": F.current_timestamp(), "_batch_id": F.lit("made")}
    good, bad = ("s1", "1", " Rio ", "RJ"), (None, "2", "x", "SP")
    for rows, kept, out, again in (([good], 1, 0, False), ([good, bad], 1, 1, True), ([good], 1, 0, False)):
        Tables(context).replace("bronze.sellers", spark.createDataFrame(rows, columns).withColumns(stamps))
        written.clear()
        cleaned = ingest.clean_table(context, "sellers")
        assert (cleaned.read, cleaned.written, cleaned.quarantined) == (len(rows), kept, out)
        assert ("silver.sellers" in written, [r.seller_city for r in Tables(context).read("silver.sellers").collect()]) == (again, ["rio"])
        assert Tables(context).count("silver.quarantine_sellers") == out and not any((tmp_path / "root" / "_stages").iterdir())
        assert {r.rows_failed for r in cleaned.results.collect()} == {out}
