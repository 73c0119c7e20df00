"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame
functions only.

Every row of a source is wanted ``ratio = target / source_size`` times. The whole
part of that is taken outright; the fraction is rounded to 0 or 1 so that the
*words* of a source come out at its target: two fractional units exchange mass (a
row's mass is its size times its fraction) at random, without changing either
expectation, until one of the two is integral; the other meets the next unit. So
a source's taken words miss its target by less than the size of the one row that
is left at the end, and every row keeps its expected copies.

The order of the pairing sees to it that this last row is a small one. Rows above
a ``LARGE``-th of their source's words (fewer than ``LARGE`` of them, whatever
the source's size) come first, largest first; each is paired with all that comes
after it as one unit, whose rows share one fraction, and so becomes integral
while the rest takes up the difference. The remaining rows run through a
reduction tree: dealt by hash into blocks of about ``FAN`` rows, each folded
pairwise from its largest row down to at most one fractional residual; residuals
meet in the blocks of the next level, until one is left for each source. A source
with a third of all rows is thus worked off by as many tasks as it has blocks,
and no task holds more than a block. Levels are staged in the shared folder.

Repeated rows (equal id, source and size) are aggregated first: m of them take
``floor(m * fraction)`` extra copies and enter the tree with what is left, so
that one id repeated in a third of all rows is one entry.

Defined results: a null text has size 0; rows of size 0 take nothing; a null
source is a source of its own, last in order; ids may be null or repeated; an
empty table gives an empty result. Random numbers are hashes of the ids and the
seed: reruns agree, however the input is partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, column, documents, looked_up, staged, uniform
from .sharding import ROWS_PER_PART, with_slots

#: Rows that a block of the reduction tree holds, on average.
FAN = 256
#: A row above this part of its source's words is paired with all the rest.
LARGE = 4096
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
CAP = 3
#: Most sources that are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size, m).

    Sharing by weight, stopping at ``cap`` times a source's size and resharing
    the excess until none is above is the water level at which the capped targets
    sum to the total. It is found from below: the level of all that is left, over
    the sources that are not above their caps at the level before; each round is one
    aggregate, and the last one puts no further source above its cap. Sources are
    numbered in range partitions, so any number of them will do."""
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).cast("long").alias("source_size"))
    per = with_slots(per.withColumns({"all": F.lit(0), "none": F.col("source").isNull()}), ["none", "source"], shard="all", slot="place")
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    per = staged(per.withColumn("cap", F.col("source_size").cast("double") * cap).select("source", "source_size", "w", "cap"))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    water, capped = 0.0, -1
    while True:
        full = F.col("cap") < F.col("w") * F.lit(water)
        now = per.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if now.n is None or now.n == capped or not now.open:
            break
        water, capped = (total - now.caps) / now.open, now.n
    target = F.col("cap") if now.n and not now.open else F.least(F.col("cap"), F.col("w") * F.lit(water))
    return per.select("source", "source_size", target.alias("target"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _meet(state: Column, item: Column, seed: int) -> Column:
    """The residual so far and the next row exchange mass; the state's ``done``
    gains whichever became integral, ``rest`` is the one that did not."""
    r, x = state["rest"], item
    moved = F.struct(
        (r["size"] * (F.lit(1.0) - r["p"])).alias("r_up"),
        (r["size"] * r["p"]).alias("r_down"),
        (x["size"] * x["p"]).alias("x_down"),
        (x["size"] * (F.lit(1.0) - x["p"])).alias("x_up"),
        uniform(r["h"], x["h"], F.lit(seed)).alias("u"),
    )

    def exchange(m: Column) -> Column:
        a, b = F.least(m["r_up"], m["x_down"]), F.least(m["r_down"], m["x_up"])
        to_r = m["u"] * (a + b) < b
        p_r = F.when(to_r, F.when(m["r_up"] <= m["x_down"], F.lit(1.0)).otherwise(r["p"] + a / r["size"])).otherwise(
            F.when(m["r_down"] <= m["x_up"], F.lit(0.0)).otherwise(r["p"] - b / r["size"])
        )
        p_x = F.when(to_r, F.when(m["x_down"] <= m["r_up"], F.lit(0.0)).otherwise(x["p"] - a / x["size"])).otherwise(
            F.when(m["x_up"] <= m["r_down"], F.lit(1.0)).otherwise(x["p"] + b / x["size"])
        )
        clip = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        return F.struct(clip(p_r).alias("r"), clip(p_x).alias("x"))

    def settle(p: Column) -> Column:
        new_r, new_x = r.withField("p", p["r"]), x.withField("p", p["x"])
        whole = lambda q: (q <= 0.0) | (q >= 1.0)
        both = F.struct(F.concat(state["done"], F.array(new_r, new_x)).alias("done"), F.lit(None).cast(_ITEM).alias("rest"))
        first = F.struct(F.concat(state["done"], F.array(new_r)).alias("done"), new_x.alias("rest"))
        second = F.struct(F.concat(state["done"], F.array(new_x)).alias("done"), new_r.alias("rest"))
        return F.when(whole(p["r"]) & whole(p["x"]), both).when(whole(p["r"]), first).otherwise(second)

    alone = F.struct(state["done"].alias("done"), x.alias("rest"))
    return F.when(r.isNull(), alone).otherwise(_let(_let(moved, exchange), settle))


_ITEM = "struct<size:double,h:bigint,p:double,doc_id:bigint,source:string,m:bigint,base:bigint>"


def _fold(items: Column, seed: int) -> Column:
    start = F.struct(F.lit(None).cast(f"array<{_ITEM}>").alias("done"), F.lit(None).cast(_ITEM).alias("rest"))
    start = start.withField("done", F.array().cast(f"array<{_ITEM}>"))
    ordered = F.reverse(F.array_sort(items))
    return F.aggregate(ordered, start, lambda s, x: _meet(s, x, seed))


_BIG = "struct<size:double,h:bigint,nth:bigint,doc_id:bigint,source:string,m:bigint>"
_DECIDED = "struct<doc_id:bigint,source:string,size:double,m:bigint,bit:double>"


def _meet_rest(state: Column, x: Column, seed: int) -> Column:
    """A large row and all that comes after it, as one unit of one fraction,
    exchange mass. Where the rest is too small to make the row integral, the rest
    becomes integral itself and the row, the last fractional one, is rounded."""
    f, size = state["f"], x["size"]
    moved = F.struct(
        f.alias("f"),
        (state["rest"] - size).alias("rest"),
        (size * (F.lit(1.0) - f)).alias("x_up"),
        (size * f).alias("x_down"),
        (f * (state["rest"] - size)).alias("r_down"),
        ((F.lit(1.0) - f) * (state["rest"] - size)).alias("r_up"),
        uniform(x["h"], x["nth"], F.lit(seed)).alias("u"),
        uniform(x["h"], x["nth"], F.lit(seed + 7)).alias("v"),
    )

    def exchange(m: Column) -> Column:
        a, b = F.least(m["x_up"], m["r_down"]), F.least(m["x_down"], m["r_up"])
        flip = lambda p: (m["v"] < p).cast("double")
        result = lambda bit, rest_f: F.struct(bit.alias("bit"), rest_f.alias("f"))
        gains = F.when(m["x_up"] <= m["r_down"], result(F.lit(1.0), F.greatest(F.lit(0.0), m["f"] - m["x_up"] / m["rest"]))).otherwise(
            result(flip(m["f"] + m["r_down"] / size), F.lit(0.0))
        )
        loses = F.when(m["x_down"] <= m["r_up"], result(F.lit(0.0), F.least(F.lit(1.0), m["f"] + m["x_down"] / m["rest"]))).otherwise(
            result(flip(m["f"] - m["r_up"] / size), F.lit(1.0))
        )
        return (
            F.when((m["f"] <= 0.0) | (m["f"] >= 1.0), result(m["f"], m["f"]))
            .when(m["rest"] <= 0.0, result(flip(m["f"]), m["f"]))
            .when(m["u"] * (a + b) < b, gains)
            .otherwise(loses)
        )

    def settle(r: Column) -> Column:
        done = F.struct(x["doc_id"].alias("doc_id"), x["source"].alias("source"), size.alias("size"), x["m"].alias("m"), r["bit"].alias("bit")).cast(_DECIDED)
        return F.struct(r["f"].alias("f"), (state["rest"] - size).alias("rest"), F.concat(state["done"], F.array(done)).alias("done"))

    return _let(_let(moved, exchange), settle)


def _with_source(rows: DataFrame, sources: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with columns of their source; few sources are broadcast."""
    held = sources.select(F.col("source").alias("__s"), *names)
    if sources.count() <= BROADCAST_SOURCES:
        held = F.broadcast(held)
    return rows.join(held, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def _large_rows(groups: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(source, f, done) per source that has large rows: their roundings, and the
    fraction that is left to all other rows."""
    big = groups.filter(F.col("size") * LARGE > F.col("source_size")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    h = F.xxhash64("doc_id", "source", "size", F.lit(seed))
    item = F.struct(F.col("size").cast("double").alias("size"), h.alias("h"), "nth", "doc_id", "source", "m").cast(_BIG)
    packed = big.groupBy("source").agg(F.collect_list(item).alias("items"), F.first("f").alias("f"), F.first("source_size").cast("double").alias("rest"))
    start = F.struct(F.col("f").alias("f"), F.col("rest").alias("rest"), F.array().cast(f"array<{_DECIDED}>").alias("done"))
    end = F.aggregate(F.reverse(F.array_sort("items")), start, lambda s, x: _meet_rest(s, x, seed))
    return staged(packed.select("source", end.alias("end")).select("source", F.col("end.f").alias("f_left"), F.col("end.done").alias("done")))


def round_copies(groups: DataFrame, sources: DataFrame, seed: int = 20, fan: int = FAN) -> DataFrame:
    """(doc_id, source, size, m, copies) from groups (doc_id, source, size, m) and
    sources (source, source_size, ratio): what the m equal rows take together."""
    sources = sources.withColumn("whole", F.floor("ratio").cast("long")).withColumn("f", F.col("ratio") - F.col("whole"))
    known = _with_source(groups, sources, ["source_size", "whole", "f"])
    live = known.filter("size > 0")
    large = _large_rows(live, sources, seed)
    decided = large.select(F.explode("done").alias("x")).select("x.*").groupBy("doc_id", "source", "size", "m").agg(F.sum("bit").cast("long").alias("extra"))
    decided = decided.withColumn("size", F.col("size").cast("long"))
    rest = _with_source(live.filter(F.col("size") * LARGE <= F.col("source_size")), large, ["f_left"])
    want = F.col("m").cast("double") * F.coalesce("f_left", "f")
    base = F.floor(want).cast("long")
    items = rest.select(
        F.col("size").cast("double").alias("size"),
        F.xxhash64("doc_id", "source", "size", F.lit(seed)).alias("h"),
        (want - base).alias("p"),
        "doc_id", "source", "m", base.alias("base"),
    )
    items = staged(items)
    settled = [items.filter("p <= 0 OR p >= 1")]
    blocks = max(1, math.ceil(items.count() / fan))
    level = items.filter("p > 0 AND p < 1").withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.lit(blocks)))
    while True:
        packed = level.groupBy("source", "block").agg(F.collect_list(F.struct("size", "h", "p", "doc_id", "source", "m", "base").cast(_ITEM)).alias("items"))
        folded = staged(packed.select("block", _fold(F.col("items"), seed + blocks).alias("end")))
        settled.append(folded.select(F.explode("end.done").alias("x")).select("x.*"))
        left = folded.filter("end.rest IS NOT NULL").select("block", "end.rest.*")
        if blocks == 1:
            break
        blocks = math.ceil(blocks / fan)
        level = left.withColumn("block", F.pmod(F.col("block"), F.lit(blocks)))
    # One fractional row is left for each source; it is rounded by itself.
    flip = F.when(uniform(F.col("h"), F.lit(seed + 2)) < F.col("p"), 1.0).otherwise(0.0)
    settled.append(left.drop("block").withColumn("p", flip).select("size", "h", "p", "doc_id", "source", "m", "base"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    out = out.select("doc_id", "source", F.col("size").cast("long").alias("size"), "m", (F.col("base") + F.col("p").cast("long")).alias("extra"))
    out = _with_source(out.unionByName(decided), sources, ["whole"])
    out = out.select("doc_id", "source", "size", "m", (F.col("m") * F.col("whole") + F.col("extra")).alias("copies"))
    return out.unionByName(groups.filter("size = 0").select("doc_id", "source", "size", "m", F.lit(0).cast("long").alias("copies")))


def mix_groups(groups: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """From groups of equal rows (doc_id, source, size, m): the same with what they
    take (.., copies), and the sources (source, source_size, target)."""
    narrow = staged(groups)
    targets = staged(source_targets(narrow, weights, cap))
    ratios = targets.select("source", "source_size", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0).alias("ratio"))
    return round_copies(narrow, ratios, seed), targets


def _own_copies() -> Column:
    """What the nth of m equal rows takes of their copies: an even share; the
    first few take one more."""
    even = F.floor(F.col("copies") / F.col("m")).cast("long")
    return even + (F.col("nth") <= F.col("copies") % F.col("m")).cast("long")


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 20) -> DataFrame:
    """From rows (doc_id, source, size): one row each, with source_size, target,
    copies (0 to ``cap``) and taken = copies * size."""
    copies, targets = mix_groups(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), weights, cap, seed)
    each = copies.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).withColumn("copies", _own_copies())
    t = targets.alias("t")
    n_sources = targets.count()
    out = each.alias("e").join(F.broadcast(t) if n_sources <= BROADCAST_SOURCES else t, F.col("e.source").eqNullSafe(F.col("t.source")))
    return out.select("e.doc_id", "e.source", "e.size", "t.source_size", "t.target", "e.copies", (F.col("e.copies") * F.col("e.size")).alias("taken"))


def n_words(text: Column) -> Column:
    """Words of a text, counted; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "source", "string").alias("source"), n_words(column(docs, "text", "string")).alias("size"))


def replicate(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 20) -> DataFrame:
    """``docs``, all columns kept, each row as often as the mix takes it; rows
    without a word stay once. Rows alike in all columns are counted before texts are
    shuffled, by a hash of the whole row; so neither a row nor an id that is repeated
    without end gathers in a task. Which rows of an equal id, source and size take
    one copy more is settled by that hash."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    plain = [i for c, i in zip(names, inner, strict=True) if "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    text = column(docs, "text", "string")
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)], column(docs, "doc_id", "long").alias("doc_id"), column(docs, "source", "string").alias("source"), n_words(text).alias("size"))
    # 128 bits know a row.
    rows = rows.withColumns({"h": F.xxhash64(*plain, F.lit(0)), "h2": F.xxhash64(F.lit(seed), *plain)})
    like = rows.groupBy("doc_id", "source", "size", "h", "h2").agg(F.count(F.lit(1)).alias("n"))
    like = staged(like)
    copies, _ = mix_groups(like.groupBy("doc_id", "source", "size").agg(F.sum("n").alias("m")), weights, cap, seed)
    took = _shares(like, copies)
    once = rows.groupBy("h", "h2").agg(F.min_by(F.struct(*inner), F.lit(0)).alias("row"))
    met = once.join(took.filter("times > 0"), ["h", "h2"])
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*[F.col(f"row.{i}").alias(c) for c, i in zip(names, inner, strict=True)])


def _shares(like: DataFrame, copies: DataFrame) -> DataFrame:
    """(h, h2, times): what the n rows alike in all columns take of the copies of
    their group (doc_id, source, size), whose m rows are numbered by (h, h2) in range
    partitions. A group of one kind of rows takes all; only others are numbered."""
    key = F.struct("doc_id", "source", "size").alias("key")  # a struct of nulls equals its like
    total = like.agg(F.sum("n")).first()[0] or 0
    of = copies.select(key, "m", "copies", F.col("m").alias("rows"))
    met = staged(looked_up(like.select(key, "size", "h", "h2", "n"), of, ["key"], "rows", total))
    even = F.when(F.col("size") == 0, F.col("n")).otherwise(F.floor(F.col("copies") / F.col("m")).cast("long") * F.col("n"))
    whole = met.filter("n = m OR size = 0").select("h", "h2", F.when(F.col("size") == 0, F.col("n")).otherwise(F.col("copies")).alias("times"))
    mixed = met.filter("n < m AND size > 0").withColumn("grp", F.xxhash64("key"))
    parts = max(1, math.ceil(mixed.count() / ROWS_PER_PART))
    ranged = staged(mixed.repartitionByRange(parts, "grp", "h", "h2").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("grp", "part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("grp", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("grp", "part").orderBy("h", "h2").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["grp", "part"])
    first = F.col("start") + F.col("within")
    more = F.greatest(F.lit(0), F.least(F.col("n"), F.col("copies") % F.col("m") - first))
    return whole.unionByName(numbered.select("h", "h2", (even + more).alias("times")))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words that the mix takes of each."""
    return mix(_rows(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken", "copies")
