"""Change feeds and events made from a base of rows, for trials of what takes them in.

Everything follows from hashes of the seed, the day and the keys, so a day is the
same however often and with whatever other days it is made. The feeds are dirty on
purpose: one key comes twice, rows are out of order, events repeat and come late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a change file, in order.
CHANGE_COLUMNS = ("op", "customer_id", "customer_unique_id", "customer_city", "customer_state", "updated_at")
#: Where movers go.
PLACES = (("sao paulo", "sp"), ("rio de janeiro", "rj"), ("belo horizonte", "mg"), ("curitiba", "pr"), ("porto alegre", "rs"), ("salvador", "ba"), ("brasilia", "df"), ("fortaleza", "ce"), ("recife", "pe"), ("manaus", "am"))
STAGES = ("created", "approved", "shipped", "delivered")
#: The city of the row that must win among those of the repeated key.
LAST_CITY = "correct-city-wins"


def _pick(*parts: Column) -> Column:
    places = F.array(*[F.struct(F.lit(c).alias("city"), F.lit(s).alias("state")) for c, s in PLACES])
    return F.element_at(places, (F.pmod(F.xxhash64(*parts), F.lit(len(PLACES))) + 1).cast("int"))


def change_day(customers: DataFrame, day: int, base: str, seed: int = 42, updates: int = 40, deletes: int = 5, arrivals: int = 3) -> DataFrame:
    """A day's feed in CHANGE_COLUMNS: moves, deletes and arrivals, and the first
    move's key once more with a later time. Days draw on slices of the customers that
    don't overlap, by a hash of the id; at most ``day * (updates + deletes)`` rows are
    sorted."""
    if day < 1:
        raise ValueError("days are numbered from 1")
    each = updates + deletes
    chosen = customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state").withColumn("h", F.xxhash64("customer_unique_id", F.lit(seed)))
    chosen = chosen.groupBy("customer_unique_id", "h").agg(F.min(F.struct("customer_id", "customer_city", "customer_state")).alias("c")).orderBy("h", "customer_unique_id").limit(day * each)
    n = F.row_number().over(Window.orderBy("h", "customer_unique_id")) - F.lit((day - 1) * each + 1)
    pool = chosen.withColumn("n", n).filter("n >= 0").select("n", "customer_unique_id", "c.*")
    at = lambda hours: F.date_format(F.timestamp_add("MINUTE", (F.lit(24 * 60 * day) + hours * 60).cast("int"), F.lit(base).cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    to = _pick(F.lit(seed), F.lit(day), F.col("customer_unique_id"))
    row = lambda op, city, state, hours: F.struct(F.lit(op).alias("op"), "customer_id", "customer_unique_id", city.alias("customer_city"), state.alias("customer_state"), at(hours).alias("updated_at"))
    moves = row("U", to["city"], to["state"], F.col("n") * 0.1)
    again = row("U", F.lit(LAST_CITY), to["state"], F.lit(23))
    gone = row("D", F.col("customer_city"), F.col("customer_state"), F.lit(12) + (F.col("n") - updates) * 0.1)
    rows = F.when(F.col("n") == 0, F.array(moves, again)).when(F.col("n") < updates, F.array(moves)).otherwise(F.array(gone))
    fresh = customers.sparkSession.range(arrivals).select(F.col("id").alias("n"), F.format_string(f"gen{day:02d}%03d", "id").alias("customer_id")).withColumn("customer_unique_id", F.concat(F.lit("u"), "customer_id"))
    fresh = fresh.withColumn("r", row("I", to["city"], to["state"], F.lit(18) + F.col("n")))
    out = pool.select(F.explode(rows).alias("r")).unionByName(fresh.select("r")).select("r.*")
    return out.orderBy(F.xxhash64(F.lit(seed + day), "customer_unique_id", "updated_at"))


def order_events(orders: DataFrame, base: str, seed: int = 42) -> DataFrame:
    """(event_id, order_id, customer_id, event_type, event_ts): each order's first
    stages, as many as its hash says; every 10th event twice, every 25th again under
    an id of its own, 72 hours before the base."""
    n = F.pmod(F.xxhash64("order_id", F.lit(seed)), F.lit(len(STAGES))) + 1
    stage = F.posexplode(F.slice(F.array(*map(F.lit, STAGES)), F.lit(1), n.cast("int"))).alias("place", "event_type")
    each = orders.select("order_id", "customer_id", F.pmod(F.xxhash64(F.lit(seed), "order_id"), F.lit(1000)).alias("start"), stage)
    at = F.timestamp_add("MINUTE", (F.col("start") * 30 + F.col("place") * 360).cast("int"), F.lit(base).cast("timestamp"))
    text = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    each = each.select(F.concat_ws("-", "order_id", "event_type").alias("event_id"), "order_id", "customer_id", "event_type", text(at).alias("event_ts"))
    h = F.xxhash64("event_id", F.lit(seed))
    late = F.struct(F.concat("event_id", F.lit("-late")).alias("event_id"), "order_id", "customer_id", "event_type", text(F.timestamp_add("HOUR", F.lit(-72), F.lit(base).cast("timestamp"))).alias("event_ts"))
    itself = F.struct(*each.columns)
    copies = F.array_compact(F.array(itself, F.when(F.pmod(h, F.lit(10)) == 0, itself), F.when(F.pmod(h, F.lit(25)) == 1, late)))
    return each.select(F.explode(copies).alias("e")).select("e.*")


def write_csv(df: DataFrame, folder: str, files: int | None = 1, compression: str = "none") -> None:
    """CSV files with a header, in the order of the rows where there is one file; as many
    as the frame has partitions if ``files`` is None."""
    df = df if files is None else df.coalesce(files)
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "false").option("compression", compression).csv(folder)


def write_jsonl(df: DataFrame, folder: str, files: int = 1) -> None:
    """JSON Lines files."""
    df.coalesce(files).write.mode("overwrite").json(folder)


def read_head(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n rows of one CSV file, as they stand in it, all strings. A limit takes
    from the file's splits in order; it reads no further than it must."""
    return spark.read.option("header", "true").csv(path).limit(n)
