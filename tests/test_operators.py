"""Cleaning, rules and SCD2, on inline rows."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.columns import marked_hash, version_key
from ledgerline.operators import checks, cleaning, rules, scd2, star

ORDERS = "order_id string, status string, updated_at string"


def test_strings_are_tidied(spark):
    df = spark.createDataFrame([("  São  PAULO ",), ("são paulo",), ("   ",), (None,)], "city string")
    assert [r.city for r in cleaning.normalise_strings(df, ("city", "absent")).collect()] == ["são paulo", "são paulo", None, None]


def test_bad_times_and_numbers_become_null(spark):
    df = spark.createDataFrame([("2018-01-02 03:04:05", "7", "1.50"), ("soon", "x", "y"), (None, None, None)], "ts string, n string, p string")
    out = cleaning.cast_numerics(cleaning.parse_timestamps(df, ("ts",)), {"n": "int", "p": "decimal(10,2)", "absent": "int"}).collect()
    assert out[0].ts == datetime(2018, 1, 2, 3, 4, 5) and out[0].n == 7 and str(out[0].p) == "1.50"
    assert out[1] == out[2] == (None, None, None)


def test_latest_wins_and_beats_null(spark):
    df = spark.createDataFrame([("a", "old", "1"), ("a", "new", "3"), ("a", "mid", "2"), ("b", "none", None), ("b", "some", "0")], ORDERS)
    out = {r.order_id: r.status for r in cleaning.latest_per_key(df, ("order_id",), "updated_at").collect()}
    assert out == {"a": "new", "b": "some"}


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [("a", s, "1") for s in "zyxw"]
    pick = lambda r: cleaning.latest_per_key(spark.createDataFrame(r, ORDERS), ("order_id",), "updated_at").first().status
    assert pick(rows) == pick(rows[::-1]) == "w"


def test_the_latest_to_land_wins_where_there_is_no_sequence(spark):
    rows = [("a", "zeta", 1, "f1"), ("a", "alpha", 2, "f1"), ("a", "beta", 2, "f2"), ("b", "one", None, "f9"), ("b", "two", 0, "f1")]
    df = spark.createDataFrame(rows, "k string, v string, landed int, file string")
    assert {r.k: r.v for r in cleaning.latest_per_key(df, ("k",), None, ("landed", "file")).collect()} == {"a": "beta", "b": "two"}


def test_renames_pass_over_what_is_not_there(spark):
    assert cleaning.rename(spark.range(1), {"id": "k", "nope": "x"}).columns == ["k"]


def test_conform_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="b"):
        cleaning.conform(spark.range(1).withColumnRenamed("id", "a"), spark.createDataFrame([], "a int, b int").schema)


def test_geolocation_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "b", "x"), (1, 3.0, 4.0, "a", "x"), (2, 5.0, 5.0, None, None)], "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, geolocation_city string, geolocation_state string")
    out = {r[0]: r for r in cleaning.geolocation_centres(df).collect()}
    assert (out[1].latitude, out[1].longitude, out[1].city, out[1].reading_count) == (2.0, 3.0, "a", 2)


ITEMS = "order_id string, product_id string, price double, freight_value double, order_item_id int"


def items(spark):
    return spark.createDataFrame([("1", "p", 1.0, 0.0, 1), ("2", "p", -1.0, 0.0, 1), ("3", "p", None, 0.0, 1), ("4", None, -2.0, 0.0, 1)], ITEMS)


def test_null_predicates_fail_and_rows_are_routed(spark):
    kept, out = rules.split(items(spark), rules.rules_for("order_items"))
    assert [r.order_id for r in kept.collect()] == ["1"]
    failed = {r.order_id: r[rules.FAILED] for r in out.collect()}
    assert failed["4"] == ["order_items.product_id_not_null", "order_items.price_non_negative"]
    assert {r.rule_id: r.rows_failed for r in rules.count_failures(items(spark), rules.rules_for("order_items")).collect()} == {"order_items.price_non_negative": 3, "order_items.product_id_not_null": 1}


def test_warnings_count_but_keep(spark):
    warn = [rules.Rule("t", "w", "", "price > 0", "warn")]
    kept, out = rules.split(items(spark), warn)
    assert (kept.count(), out.count(), rules.FAILED in out.columns) == (4, 0, True)
    assert rules.results(items(spark), warn).first().rows_failed == 3


def test_without_rules_nothing_fails(spark):
    assert rules.count_failures(items(spark), []).count() == 0
    assert rules.tag(items(spark), []).select(F.max(F.size(rules.FAILED))).first()[0] == 0


def test_the_registry(spark):
    assert len(rules.RULES) == 23 and sum(r.severity == "reject" for r in rules.RULES) == 20 and len({r.table for r in rules.RULES}) == 7


DIM = scd2.Dimension("id", ("city", "segment"), ("value",), version="sk")
CURRENT = "id string, city string, segment string, value double, is_deleted boolean"


def current(spark):
    return spark.createDataFrame([("1", "a", "x", 1.0, False), ("2", None, "x", 2.0, False), ("3", "c", "x", 3.0, True), ("4", "d", "x", 4.0, False)], CURRENT)


def meet(spark, rows, ddl="id string, city string, op string"):
    return scd2.transitions(current(spark), spark.createDataFrame(rows, ddl), DIM)


def actions(spark, rows, ddl="id string, city string, op string"):
    return {r.id: r[scd2.ACTION] for r in scd2.completed(meet(spark, rows, ddl)).collect()}


def test_what_changes_do(spark):
    got = actions(spark, [("1", "b", "U"), ("2", None, "U"), ("3", None, "D"), ("4", None, "d"), ("9", "z", "I"), ("8", None, "D")])
    assert got == {"1": "changed", "2": "unchanged", "3": "unchanged", "4": "deleted", "9": "new", "8": "unchanged"}


def test_only_tracked_values_count(spark):
    assert actions(spark, [("1", "a", "x", 99.0)], "id string, city string, segment string, value double") == {"1": "unchanged"}


def test_what_is_left_out_is_inherited(spark):
    got = {r.id: (r.city, r.segment, r.value, r.op) for r in scd2.completed(meet(spark, [("1", "b", "U"), ("9", "z", "I")])).collect()}
    assert got == {"1": ("b", "x", 1.0, "U"), "9": ("z", None, None, "I")}


def test_keys_that_the_feed_does_not_name_have_no_action(spark):
    met = meet(spark, [("1", "b", "U"), (None, "q", "I")])
    assert {r.key: r[scd2.ACTION] for r in met.collect()} == {"1": "changed", "2": None, "3": None, "4": None, None: "new"}
    assert {r[scd2.ACTION]: r.n for r in scd2.action_counts(met).collect()} == {"changed": 1, "new": 1}


def test_hashes_are_unambiguous(spark):
    df = spark.createDataFrame([("a||b", "c"), ("a", "b||c"), (None, "a"), ("a", None), ("<null>", "a")], "x string, y string")
    assert df.select(marked_hash([F.col("x"), F.col("y")]).alias("h")).distinct().count() == 5


def test_version_keys_do_not_depend_on_the_time_zone(spark):
    df = spark.sql("SELECT 'k' AS k, timestamp_seconds(1500000000) AS t")
    key = lambda: df.select(version_key(F.col("k"), F.col("t"))).first()[0]
    utc = key()
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        assert key() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_change_closes_and_opens_in_one_state_and_replays_to_nothing(spark):
    day = F.lit("2020-01-01").cast("timestamp")
    base = spark.createDataFrame([("1", "a", "x", 1.0), ("2", "b", "x", 2.0), ("3", "c", "x", 3.0)], "id string, city string, segment string, value double")
    versions = scd2.seed(base, DIM, F.lit(None).cast("timestamp")).cache()
    feed = spark.createDataFrame([("1", "z", "U"), ("2", None, "D"), ("9", "n", "I"), ("8", None, "D")], "id string, city string, op string")

    def step(state):
        return scd2.transitions(state, feed, DIM)

    after = scd2.next_state(versions, step(versions), DIM, day).cache()
    assert (after.count(), after.filter("is_current").count(), scd2.live(after).count()) == (6, 4, 3)
    assert scd2.integrity(after, DIM).count() == scd2.out_of_order(after).count() == 0
    assert {r.effective_to for r in after.filter("NOT is_current").collect()} == {datetime(2020, 1, 1)}
    assert sorted(r.id for r in scd2.closed(step(versions), DIM, day).collect()) == ["1", "2"]
    assert {r.id: (r.city, r.is_deleted) for r in scd2.opened(step(versions), DIM, day).collect()} == {"1": ("z", False), "2": ("b", True), "9": ("n", False)}
    assert [r[scd2.ACTION] for r in scd2.action_counts(step(after)).collect()] == ["unchanged"]
    again = scd2.next_state(after, step(after), DIM, day)
    assert again.exceptAll(after).count() == after.exceptAll(again).count() == 0
    facts = spark.createDataFrame([("1", datetime(2019, 12, 31, 23, 59)), ("1", datetime(2020, 1, 1)), ("7", datetime(2020, 1, 1))], "id string, t timestamp")
    assert sorted((r.t, r.city) for r in scd2.at_time(facts, after, "id", F.col("t"), ["city"]).collect() if r.id == "1") == [(datetime(2019, 12, 31, 23, 59), "a"), (datetime(2020, 1, 1), "z")]


def test_broken_versions_are_found(spark):
    rows = [("k", 1, datetime(2020, 1, 1), datetime(2020, 3, 1), True), ("k", 2, datetime(2020, 2, 1), datetime(2020, 4, 1), True), ("j", 3, datetime(2020, 2, 1), datetime(2020, 1, 1), True)]
    df = spark.createDataFrame(rows, "id string, sk long, effective_from timestamp, effective_to timestamp, is_current boolean")
    assert [r.violation for r in scd2.integrity(df, DIM).collect()] == ["expected exactly 1 current version"]
    assert scd2.out_of_order(df).count() == 1


def test_segments_look_back_but_first_orders_do_not(spark):
    rows = [("p", datetime(2020, 1, 1), 10.0), ("p", datetime(2020, 6, 1), 10.0), ("q", datetime(2020, 12, 1), 5000.0), ("r", datetime(2020, 5, 1), 5.0), ("s", datetime(2019, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "customer_unique_id string, order_purchase_timestamp timestamp, order_total double")
    got = {r.customer_unique_id: r.customer_segment for r in star.segments(df, F.lit("2020-07-01").cast("timestamp")).collect()}
    assert got == {"p": "returning", "r": "new", "s": "lapsed"}
    assert star.first_orders(df).count() == 4


def test_constraints(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 9)], "k int, ref int")
    assert sorted(r.n for r in checks.duplicate_keys(df, ["k"]).collect()) == [1, 2]
    assert [r.ref for r in checks.orphans(df, "ref", spark.range(1, 3), "id").collect()] == [9]


def test_persons_have_the_address_of_their_latest_order(spark):
    customers = spark.createDataFrame([("c1", "p", "old", "x", 1), ("c2", "p", "new", "y", 2), ("c3", "p", "never", "z", 3), ("c4", "q", "only", "w", 4)], "customer_id string, customer_unique_id string, customer_city string, customer_state string, customer_zip_code_prefix int")
    orders = spark.createDataFrame([("1", "c1", datetime(2020, 1, 1)), ("2", "c2", datetime(2020, 6, 1))], "order_id string, customer_id string, order_purchase_timestamp timestamp")
    items = spark.createDataFrame([("1", 1, 10, 1)], "order_id string, order_item_id int, price int, freight_value int").selectExpr("order_id", "order_item_id", "CAST(price AS DECIMAL(10,2)) price", "CAST(freight_value AS DECIMAL(10,2)) freight_value")
    got = {r.customer_unique_id: r for r in star.customer_attributes(customers, orders, items, F.lit("2020-03-01").cast("timestamp")).collect()}
    assert (got["p"].customer_city, got["p"].order_count, str(got["p"].lifetime_value), got["p"].customer_segment) == ("new", 1, "11.00", "new")
    assert (got["p"].last_order_ts, got["p"].first_order_ts) == (datetime(2020, 1, 1), datetime(2020, 1, 1))
    assert tuple(got["q"])[1:] == ("only", "w", 4, "unknown", 0, None, None, None)


def test_percentiles_are_exact(spark):
    from ledgerline.plans import views

    values = [(k, v) for k in (1, 2, 3) for v in range(7 * k)] + [(4, None), (1, None)]
    df = spark.createDataFrame(values, "k int, v int")
    want = {k: (sorted(range(7 * k))[math.ceil(0.5 * 7 * k) - 1], sorted(range(7 * k))[math.ceil(0.95 * 7 * k) - 1]) for k in (1, 2, 3)}
    assert {r.k: (r.a, r.b) for r in views.percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()} == want
    got = df.groupBy("k").agg(views.exact_percentile("v", 0.5).alias("a"), views.exact_percentile("v", 0.95).alias("b")).collect()
    assert {r.k: (r.a, r.b) for r in got} == want | {4: (None, None)}
