"""Tables, ingestion, the batch pipeline, logs, streams and SQL files."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerline.operators import star
from ledgerline.plans import ops, pipeline, probe
from ledgerline.sources import generator, ingest
from ledgerline.sources.tables import Conflict, Context, Tables, shared_root
from ledgerline.streaming import events

DATA = {
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,u1,10,  Sao  PAULO,sp\nc2,u1,11,Rio,rj\nc3,u2,x,Recife,pe\nc3,u2,12,Recife,pe\n",
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    "o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 12:30:00,2018-01-02 00:00:00,2018-01-20 00:00:00,2018-01-10 00:00:00\no2,c2,canceled,2018-02-01 10:00:00,,,,2018-02-10 00:00:00\no3,c3,shipped,2018-03-01 10:00:00,bad,,,2018-03-10 00:00:00\no4,c3,lost,2018-03-01 10:00:00,,,,\n",
    "order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\no1,1,p1,s1,2018-01-05 00:00:00,10.00,1.00\no1,2,p2,s1,2018-01-05 00:00:00,20.00,2.00\no2,1,p1,s1,2018-02-05 00:00:00,5.00,0.50\no3,1,p1,s1,2018-03-05 00:00:00,-5.00,0.50\n",
    "order_payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,credit_card,2,30.00\no1,2,voucher,1,3.00\no2,1,boleto,1,5.50\n",
    "order_reviews": 'review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\nr1,o1,5,Good,"two\nlines, and ""quotes""",2018-01-21 00:00:00,2018-01-22 00:00:00\nr2,o2,9,Bad,x,2018-01-21 00:00:00,2018-01-22 00:00:00\n',
    "products": "product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\np1,toys,1,1,1,100,1,1,1\np2,,1,1,1,,1,1,1\n",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,X,sp\n",
    "product_category_translation": "product_category_name,product_category_name_english\ntoys,Toys\n",
}


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    folders = {}
    for name, text in DATA.items():
        (root / "landing" / name).mkdir(parents=True)
        (root / "landing" / name / "a.csv").write_text(text)
        folders[name] = str(root / "landing" / name)
    feed = root / "changes.csv"
    feed.write_text("op,customer_id,customer_unique_id,customer_city,customer_state,updated_at\nU,,u1,First,sp,2018-06-01 01:00:00\nU,,u1,Last,sp,2018-06-01 05:00:00\nD,,u2,,,2018-06-01 02:00:00\nI,,u9,New,ba,bad\n")
    return root, folders, str(feed)


def test_the_pipeline_runs_twice_to_the_same_gold(spark, landed):
    root, folders, feed = landed
    first = pipeline.run(Context(spark, str(root / "t"), "run1", "2018-06-01"), folders, feed)
    assert (first["fact_order"], first["fact_order_item"], first["fact_payment"], first["dim_customer"]) == (3, 3, 3, 5)
    context = Context(spark, str(root / "t"), "run2", "2018-06-01")
    assert pipeline.run(context, folders, feed) == first
    tables = Tables(context)
    runs = {(r.run_id, r.task_name): r for r in tables.read("ops.pipeline_runs").collect()}
    assert runs["run1", "ingest"].rows_read > 0 and runs["run2", "ingest"].rows_read == 0
    assert runs["run2", "changes"].rows_written == 0 and runs["run1", "changes"].rows_written == 3
    assert tables.read("silver.quarantine_orders").first()["_dq_failed_rules"] == ["orders.status_in_domain"]
    assert tables.read("silver.order_reviews").first().review_comment_message == 'two\nlines, and "quotes"'
    quality = {r.rule_id: r.rows_failed for r in tables.read("ops.dq_results").filter("run_id = 'run1'").collect()}
    assert quality["order_items.price_non_negative"] == 1 and quality["products.category_present"] == 1 and quality["sellers.seller_id_not_null"] == 0
    fact = {r.order_id: r for r in tables.read("gold.fact_order").collect()}
    assert str(fact["o1"].approval_lag_hours) == "2.50" and fact["o1"].is_late and fact["o2"].delivery_days is None
    names = pipeline.register_views(context)
    assert len(names) == 13 and spark.table("v_scd2_integrity").count() == 0
    assert {(r.silver_value, r.gold_value) for r in spark.table("v_reconciliation").collect() if r.check_name == "orders rows"} == {(3, 3)}
    tables.replace("gold.dim_seller", tables.read("gold.dim_seller").limit(0))
    third = Context(spark, str(root / "t"), "run3", "2018-06-01")
    ops.capture(third, pipeline.gold_tables(third))
    with pytest.raises(AssertionError, match="dim_seller"):
        ops.check_repeatable(third)


def test_new_files_come_once(spark, landed, tmp_path):
    root, folders, _ = landed
    context = Context(spark, str(tmp_path))
    entity = ingest.ENTITIES["sellers"]
    assert [ingest.ingest(context, entity, folders["sellers"], b) for b in "12"] == [1, 0]
    extra = Path(folders["sellers"]) / "b.csv"
    extra.write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns2,2,Y,rj\n")
    try:
        assert ingest.ingest(context, entity, folders["sellers"], "3") == 1
    finally:
        extra.unlink()
    rows = ingest.bronze(context, "sellers").collect()
    assert {r.seller_id for r in rows} == {"s1", "s2"} and all(r["_source_file"].endswith(".csv") and r["_ingest_ts"] for r in rows)
    with pytest.raises(ValueError):
        ingest.clean_all(context, ["nope"])


def test_columns_are_found_by_their_names(spark, tmp_path):
    """Another order, a column more, one less, a row that is too long, an odd header."""
    entity = ingest.ENTITIES["sellers"]
    files = {
        "a.csv": "seller_state,seller_id,seller_city,seller_zip_code_prefix\nsp,s1,Aaa,1\n",
        "b.csv": "\ufeffseller_id,seller_city,rating\ns2,Bbb,5\n",
        "c.csv": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns3,3,Ccc,rj,extra\n",
        "d.csv": "seller_id,,seller_id,seller state\ns4,x,y,z\n",
    }
    for mode in ("evolve", "rescue"):
        landing = tmp_path / mode / "landing"
        landing.mkdir(parents=True)
        for name, text in files.items():
            (landing / name).write_text(text)
        context = Context(spark, str(tmp_path / mode))
        assert [ingest.ingest(context, entity, str(landing), b, mode) for b in "12"] == [4, 0]
        rows = {r.seller_id: r for r in ingest.bronze(context, "sellers").collect()}
        assert (rows["s1"].seller_state, rows["s1"].seller_zip_code_prefix, rows["s1"][ingest.RESCUED]) == ("sp", "1", None)
        assert (rows["s2"].seller_city, rows["s2"].seller_state) == ("Bbb", None)
        assert json.loads(rows["s3"][ingest.RESCUED]) == {"_row": "s3,3,Ccc,rj,extra"} and rows["s3"].seller_city == "Ccc"
        if mode == "evolve":
            assert rows["s2"].rating == "5" and rows["s1"].rating is None and rows["s4"].seller_id_3 == "y"
        else:
            assert json.loads(rows["s2"][ingest.RESCUED]) == {"rating": "5"} and "rating" not in rows["s2"]
            assert json.loads(rows["s4"][ingest.RESCUED]) == {"column_2": "x", "seller_id_3": "y", "seller_state": "z"} or "seller_state" in rows["s4"]
    with pytest.raises(ValueError, match="mode"):
        ingest.ingest(context, entity, str(landing), "3", "other")


def test_a_correction_that_lands_later_is_what_is_clean(spark, tmp_path):
    landing, context = tmp_path / "landing", Context(spark, str(tmp_path / "t"))
    landing.mkdir()
    head = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    (landing / "a.csv").write_text(head + "s1,1,Aaa,sp\n")
    ingest.ingest(context, ingest.ENTITIES["sellers"], str(landing), "1")
    (landing / "b.csv").write_text(head + "s1,1,Zzz corrected,sp\n")
    ingest.ingest(context, ingest.ENTITIES["sellers"], str(landing), "2")
    assert ingest.clean_table(context, "sellers").duplicates == 1
    assert Tables(context).read("silver.sellers").first().seller_city == "zzz corrected"


def test_an_empty_landing_makes_an_empty_table(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    context = Context(spark, str(tmp_path / "t"))
    assert ingest.ingest(context, ingest.ENTITIES["sellers"], str(tmp_path / "landing"), "1") == 0
    cleaned = ingest.clean_table(context, "sellers")
    assert (cleaned.read, cleaned.written, cleaned.quarantined) == (0, 0, 0)


def test_the_quarantine_is_tried_and_left_as_it_was(spark, tmp_path):
    context = Context(spark, str(tmp_path / "t"), "trial", "2020-01-01")
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "a.csv").write_text(DATA["order_items"])
    ingest.ingest(context, ingest.ENTITIES["order_items"], str(tmp_path / "landing"), "1")
    assert probe.probe_quarantine(context) == probe.EXPECTED
    tables = Tables(context)
    assert (tables.count("bronze.order_items"), tables.count("silver.order_items"), tables.count("silver.quarantine_order_items")) == (4, 3, 1)


def test_tables_have_versions(spark, tmp_path):
    tables = Tables(Context(spark, str(tmp_path), keep=3))
    assert tables.count("a.t") == 0 and not tables.exists("a.t")
    with pytest.raises(LookupError):
        tables.read("a.t")
    tables.replace("a.t", spark.range(3))
    tables.replace("a.t", tables.read("a.t").filter("id > 0"))
    assert tables.append("a.t", spark.range(10, 12)) == 2 and tables.count("a.t") == 4 and tables.history("a.t") == [0, 1, 2]
    assert tables.read("a.t", 0).count() == 3
    tables.restore("a.t", 1)
    assert tables.count("a.t") == 2 and tables.history("a.t") == [1, 2, 3]
    assert tables.evolve("a.t", spark.range(1).withColumn("more", F.lit("x"))) == 3
    assert sorted(r.more or "" for r in tables.read("a.t").collect()) == ["", "", "x"]
    assert tables.compact("a.t") == 3 and len(tables.commit("a.t").folders) == 1
    with pytest.raises(LookupError):
        tables.restore("a.t", 0)
    assert tables.ensure_layers("b") == ["a", "b"]


def test_an_append_rewrites_nothing(spark, tmp_path):
    tables = Tables(Context(spark, str(tmp_path)))
    for i in range(3):
        tables.append("a.t", spark.range(i, i + 1))
    first = tables.commit("a.t", 0).folders
    assert tables.commit("a.t").folders[:1] == first and len(tables.commit("a.t").folders) == 3
    assert tables.append("a.t", spark.range(1), batch=("s", 4)) == 1 and tables.append("a.t", spark.range(1), batch=("s", 4)) == 0
    assert tables.count("a.t") == 4


def test_a_writer_that_dies_leaves_nothing_that_counts(spark, tmp_path, monkeypatch):
    tables = Tables(Context(spark, str(tmp_path), keep=2))
    tables.replace("a.t", spark.range(3))
    with monkeypatch.context() as m:
        m.setattr(Tables, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
        for _ in range(4):
            with pytest.raises(RuntimeError):
                tables.replace("a.t", spark.range(9))
    (tmp_path / "a" / "t" / "part=torn").mkdir()
    assert tables.history("a.t") == [0] and tables.count("a.t") == 3
    with pytest.raises(LookupError):
        tables.restore("a.t", 1)
    tables.replace("a.t", spark.range(5))
    assert tables.history("a.t") == [0, 1] and tables.read("a.t", 0).count() == 3 and tables.count("a.t") == 5


def test_of_two_writers_of_one_version_one_fails(spark, tmp_path, monkeypatch):
    tables, other = (Tables(Context(spark, str(tmp_path))) for _ in range(2))
    tables.replace("a.t", spark.range(3))
    write, once = Tables._written, []

    def late(self, name, df):
        part = write(self, name, df)
        if self is tables and not once:
            once.append(1)
            other.append("a.t", spark.range(1))
        return part

    monkeypatch.setattr(Tables, "_written", late)
    with pytest.raises(Conflict):
        tables.replace("a.t", spark.range(9))
    assert tables.count("a.t") == 4
    once.clear()
    tables.append("a.t", spark.range(10))  # an append goes on from what is there
    assert tables.count("a.t") == 15


def test_tables_are_declared(spark, tmp_path):
    tables = Tables(Context(spark, str(tmp_path)))
    assert tables.create("a.t", "k bigint NOT NULL COMMENT 'key', v string", "grain") and not tables.create("a.t", "x int")
    assert tables.count("a.t") == 0 and tables.commit("a.t").comment == "grain"
    with pytest.raises(ValueError, match="k"):
        tables.append("a.t", spark.createDataFrame([(None, "x")], "k bigint, v string"))
    tables.append("a.t", spark.createDataFrame([(1, None)], "k int, v string"))
    assert tables.count("a.t") == 1
    with pytest.raises(ValueError, match="v"):
        tables.declare("a.t", not_null=("v",))
    tables.declare("a.t", comments={"v": "value"})
    assert [(r.column_name, r.nullable, r.comment) for r in tables.describe("a.t").collect()] == [("k", False, "key"), ("v", True, "value")]


def test_generated_days_are_repeatable_and_apart(spark, tmp_path):
    customers = spark.createDataFrame([(f"c{i}", f"u{i}", "x", "y") for i in range(300)], "customer_id string, customer_unique_id string, customer_city string, customer_state string")
    days = {d: generator.change_day(customers, d, "2018-10-01").collect() for d in (1, 2)}
    again = generator.change_day(customers.repartition(5), 2, "2018-10-01").collect()
    assert days[2] == again and all(len(x) == 49 for x in days.values())
    keys = {d: {r.customer_unique_id for r in x if r.op != "I"} for d, x in days.items()}
    assert len(keys[1]) == len(keys[2]) == 45 and not keys[1] & keys[2]
    for d, rows in days.items():
        twice = [r for r in rows if r.op == "U" and sum(x.customer_unique_id == r.customer_unique_id for x in rows) == 2]
        assert len(twice) == 2 and max(twice, key=lambda r: r.updated_at).customer_city == generator.LAST_CITY and rows != sorted(rows, key=lambda r: r.updated_at)
    generator.write_csv(generator.change_day(customers, 1, "2018-10-01"), str(tmp_path / "day"))
    head = generator.read_head(spark, next(str(p) for p in (tmp_path / "day").glob("*.csv")), 5)
    assert [tuple(r) for r in head.collect()] == [tuple(r) for r in days[1][:5]] and tuple(head.columns) == generator.CHANGE_COLUMNS
    orders = customers.selectExpr("customer_unique_id AS order_id", "customer_id")
    made = generator.order_events(orders, "2018-10-01")
    generator.write_jsonl(made, str(tmp_path / "events"), files=2)
    events_ = spark.read.json(str(tmp_path / "events"))
    late = events_.filter("event_id LIKE '%-late'").count()
    assert events_.count() == made.count() and late > 5 and made.count() - late - made.filter("event_id NOT LIKE '%-late'").select("event_id").distinct().count() > 20


def test_failures_are_logged_and_raised(spark, tmp_path):
    context = Context(spark, str(tmp_path), "r", "2020-01-01")
    with pytest.raises(RuntimeError), ops.logged(context, "bad") as task:
        task.rows_read = 7
        raise RuntimeError("no")
    row = Tables(context).read("ops.pipeline_runs").first()
    assert not ops.ensure_tables(context) and Tables(context).commit("ops.pipeline_runs").comment == "one row per run and task"
    assert (row.status, row.rows_read, row.error_message) == ("FAILED", 7, "RuntimeError: no")


def test_sql_text_is_split_outside_quotes_and_comments(tmp_path):
    text = "-- a; b\nSELECT ';--' AS x, \"q;\" /* c; */ FROM ${schema}.t; SELECT 2 -- end\n;"
    assert [s.split() for s in ops.statements(text, {"schema": "g"})] == [["SELECT", "';--'", "AS", "x,", '"q;"', "FROM", "g.t"], ["SELECT", "2"]]
    (tmp_path / "b.sql").write_text("SELECT 2")
    (tmp_path / "a.sql").write_text("SELECT 1;")
    assert ops.load_statements(tmp_path) == ["SELECT 1", "SELECT 2"]


def test_a_stream_agrees_with_the_batch(spark, tmp_path):
    rows = [{"event_id": str(i), "ts": f"2020-01-0{1 + i % 4} 0{i % 10}:00:00", "user_id": i % 3, "event_type": "created", "value": float(i)} for i in range(20)]
    rows += rows[::4]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "event_id string, ts timestamp, user_id long, event_type string, value double"
    stream = events.tumbling(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = events.tumbling(spark.read.schema(schema).json(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.agg(F.sum("events")).first()[0] == 20


ROWS = "event_id string, ts timestamp, user_id long, event_type string, value double"


def fed(spark, folder, batches, make, mode="append"):
    """What a stream over files, one batch of rows after the other, puts out."""
    folder.mkdir()
    name = f"out_{folder.name}"
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(folder))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).start()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "ts", "user_id", "event_type", "value"), r, strict=True))) for r in rows))
        query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_windows_that_the_watermark_has_closed_stay_as_they_are(spark, tmp_path):
    at = lambda day, hour=0: f"2020-01-{day:02d} {hour:02d}:00:00"
    batches = [[("1", at(1), 1, "a", 1.0), ("2", at(1, 5), 1, "a", 2.0)], [("3", at(20), 1, "a", 3.0)], [("4", at(1, 7), 1, "a", 100.0), ("5", at(19), 1, "a", 4.0), ("5", at(19), 1, "a", 4.0)], [("6", at(30), 1, "a", 0.0)], [("7", at(31), 2, "a", 0.0)]]
    days = {r.start.day: (r.events, float(r.value)) for r in fed(spark, tmp_path / "tumble", batches, events.tumbling)}
    assert days == {1: (2, 3.0), 19: (1, 4.0), 20: (1, 3.0)}  # the late 4 is gone, 5 counts once
    two = {r.start.day: r.events for r in fed(spark, tmp_path / "slide", batches, events.sliding) if r.start.month == 1}
    assert two[1] == 2 and two[19] == 2 and two[18] == 1
    spans = [(r.user_id, r.start.day, r.start.hour, r.end.day, r.events) for r in fed(spark, tmp_path / "sessions", batches, events.sessions)]
    assert (1, 1, 0, 1, 2) in spans and (1, 20, 0, 20, 1) in spans and not any(s[4] > 2 for s in spans)


def test_a_stream_is_matched_with_a_stream(spark, tmp_path):
    at = lambda hour, minute=0: f"2020-01-01 {hour:02d}:{minute:02d}:00"
    batches = [[("1", at(1), 1, "seen", 0.0), ("2", at(1), 2, "seen", 0.0)], [("3", at(1, 30), 1, "bought", 0.0), ("4", at(3), 2, "bought", 0.0)]]
    both = lambda s: events.matched(events.timed(s.filter("event_type = 'seen'")), events.timed(s.filter("event_type = 'bought'")))
    assert [tuple(r) for r in fed(spark, tmp_path / "matched", batches, both)] == [("1", "3", 1)]


def test_rows_are_taken_one_by_one(spark):
    rows = spark.readStream.format("rate").option("rowsPerSecond", 50).option("numPartitions", 1).load().filter("value % 2 = 0").select("value")
    query = events.running(rows, "continuous_rows", "continuous 1 second")
    for _ in range(60):
        if spark.table("continuous_rows").count() > 20:
            break
        time.sleep(0.5)
    query.stop()
    got = sorted(r.value for r in spark.table("continuous_rows").collect())
    assert len(got) > 20 and got == list(range(0, 2 * len(got), 2))


def test_what_is_there_is_taken_and_the_query_ends(spark, tmp_path):
    spark.range(30).write.parquet(str(tmp_path / "in"))
    query = events.running(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), "taken")
    assert query.awaitTermination(60) and spark.table("taken").count() == 30


def test_a_mart_is_made_once_and_anew_when_files_change(spark, tmp_path):
    from ledgerline.plans import views

    source = Path("/root/testdata/sf0.001")
    if not source.exists():
        pytest.skip("no tables here")
    for f in source.glob("*.parquet"):
        (tmp_path / f.name).write_bytes(f.read_bytes())
    mart = views.mart(spark, str(tmp_path))
    assert mart.dim_seller.count() > 0 and Tables(mart.context).history("gold.dim_seller") == [0]
    assert views.mart(spark, str(tmp_path)) is mart
    (tmp_path / "supplier.parquet").write_bytes((source / "supplier.parquet").read_bytes())
    assert views.mart(spark, str(tmp_path)) is not mart


def test_the_entry_points():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


def test_orders_lines_and_payments_are_dealt_once_and_meet_without_a_shuffle(spark, tmp_path):
    folders = {}
    for name, text in DATA.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(text)
        folders[name] = str(tmp_path / name)
    context = Context(spark, str(tmp_path / "t"), "run1", "2018-06-01")
    pipeline.run(context, folders)
    tables, rows = Tables(context), lambda df: sorted(map(str, df.collect()))
    dealt = ("order_id", ingest.LEAST_BUCKETS)
    for name in ("bronze.orders", "bronze.order_items", "silver.orders", "silver.order_items", "silver.order_payments", "gold.fact_order"):
        assert tables.commit(name).dealt == dealt
    silver, facts = pipeline.Silver(context), tables.read("gold.fact_order")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        for df in (
            ingest.clean(ingest.bronze(context, "order_items"), ingest.ENTITIES["order_items"], spread=False),
            star.order_totals(silver.orders(), silver.order_items()),
            silver.order_items().join(facts.select("order_id", "customer_sk"), "order_id"),
            star.order_payments(silver.order_payments(), facts),
        ):
            assert "Exchange" not in plan(df) and df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # What lands later is dealt as the rest is, and rows are the same as those dealt by no one.
    (tmp_path / "orders" / "b.csv").write_text(DATA["orders"].replace("o1,c1,delivered", "o1,c1,shipped").replace("2018-01-01 10:00:00", "2018-01-03 10:00:00"))
    assert pipeline.run(Context(spark, context.root, "run2", "2018-06-02"), folders)["fact_order"] == 3
    assert tables.commit("bronze.orders").dealt == dealt and len(tables.commit("bronze.orders").folders) == 2
    assert {r.order_id: r.order_status for r in silver.orders().collect()}["o1"] == "shipped"
    plain = lambda n: spark.read.schema(tables.read(n).schema).parquet(*(f"{context.root}/{n.replace('.', '/')}/{f}" for f in tables.commit(n).folders))
    assert rows(plain("bronze.orders")) == rows(tables.read("bronze.orders"))
    cleaned = ingest.clean(plain("bronze.orders"), ingest.ENTITIES["orders"])
    assert rows(cleaned.filter("order_id <> 'o4'")) == rows(silver.orders())
    lines = star.fact_order_item(silver.order_items(), tables.read("gold.fact_order"), tables.read("gold.dim_product"), tables.read("gold.dim_seller"))
    assert rows(lines) == rows(tables.read("gold.fact_order_item"))
    assert not list((tmp_path / "t" / "_stages").iterdir())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ledgerline_")]


def test_the_whole_pipeline_lands_compressed_files(spark):
    source = Path("/root/testdata/sf0.001")
    if not source.exists():
        pytest.skip("no tables here")
    root = Path(shared_root(spark))
    known = set(root.glob("ledgerline-batch-*"))
    found = {r.what: r.n for r in entry.queries()["batch_pipeline"](spark, str(source)).collect()}
    (made,) = set(root.glob("ledgerline-batch-*")) - known
    assert found["rows with their file and time"] == found["gold.fact_order"] > 0 and found["tasks that succeeded"] == 12
    assert list(made.glob("landing/orders/*.csv.gz")) and not list(made.glob("landing/orders/*.csv"))
