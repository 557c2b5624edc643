"""Joins, aggregations, windows and set operations on ordered record tables.

Tables carry an order column where order means something: "first" is always the first by that column, never whichever row
comes first in a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.operators.checkpoints import written

Keys = Sequence[str]


def first_per_group(df: DataFrame, keys: Keys, order: Sequence[Column | str]) -> DataFrame:
    """One whole row for each key: the first by ``order``. An aggregation, so it combines before it shuffles."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def last_wins(df: DataFrame, keys: Keys, order: Sequence[Column | str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def occurrence(df: DataFrame, keys: Keys, order: Sequence[Column | str], name: str = "occurrence") -> DataFrame:
    """The ordinal of each row among those of its key, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def forward_fill(df: DataFrame, column: str, keys: Keys, order: Sequence[Column | str], name: str) -> DataFrame:
    """The last value seen so far, as a section heading holds for the rows below it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


def islands(df: DataFrame, value: str, keys: Keys, order: Sequence[Column | str], name: str = "island") -> DataFrame:
    """Numbers runs of neighbouring rows with one value; a null value breaks a run and is in none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new").where(F.col(value).isNotNull())


def chunked(df: DataFrame, order: Sequence[Column | str], size: int) -> DataFrame:
    """``rank`` (from 1) and ``chunk`` of ``size`` rows in global order, without one task sorting all: rows are dealt to ranges of
    the order, ranked inside, and lifted by the count of the ranges before. The ranges are written once, as planning them again may
    deal rows otherwise."""
    spread = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    ranked = spread.withColumn("_inside", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    rank = F.col("_before") + F.col("_inside")
    return ranked.join(before, "_part").withColumns({"rank": rank, "chunk": (F.floor((rank - 1) / size) + 1).cast("int")}).drop("_part", "_inside", "_before")


def require(left: DataFrame, right: DataFrame, on: Keys) -> tuple[DataFrame, DataFrame]:
    """A lookup that must find a row: the joined rows, and the keys that have none."""
    return left.join(right, list(on)), left.join(right, list(on), "left_anti").select(*on).distinct()


def duplicated(df: DataFrame, keys: Keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def overlapping(df: DataFrame, keys: Keys, row_id: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose closed ranges meet: a row with ``other, other_low, other_high`` of a later one by id. Ranges
    are dealt to stretches of ``width``, so a long key is no group of its own; a pair meets in the stretch where its overlap starts."""
    cell = lambda c: F.floor(F.col(c) / width)
    spread = df.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    other = spread.select(*keys, "_cell", F.col(row_id).alias("other"), F.col(low).alias("other_low"), F.col(high).alias("other_high"))
    met = spread.join(other, [*keys, "_cell"]).where(F.col(row_id) < F.col("other"))
    start = F.greatest(low, "other_low")
    return met.where((start <= F.least(high, "other_high")) & (F.col("_cell") == F.floor(start / width))).drop("_cell")


def key_fallback(left: DataFrame, keys: str, right: DataFrame, right_key: str, order: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with the first of an ordered array of keys that ``right`` has."""
    ids = [c for c in left.columns if c != keys]
    probes = left.select(*ids, F.posexplode(keys).alias("_at", right_key))
    found = probes.join(right, right_key)
    return found.groupBy(*ids).agg(F.min_by(F.struct(F.col(right_key), *[c for c in right.columns if c != right_key]), F.struct("_at", *order)).alias("_hit")).select(*ids, "_hit.*")


def contained_sets(parts: DataFrame, wholes: DataFrame, part_id: str, whole_id: str, item: str) -> DataFrame:
    """Pairs whose items of the part are all in the whole. Each part is probed by its rarest item among the wholes, so a common
    item makes no pairs; the rest is looked up in the whole's set."""
    held = wholes.select(whole_id, item).distinct()
    often = held.groupBy(item).agg(F.count("*").alias("_often"))
    own = parts.select(part_id, item).distinct().join(often, item, "left")
    # A part with an item that no whole has is in none.
    probes = own.groupBy(part_id).agg(F.min_by(item, F.struct(F.coalesce("_often", F.lit(0)), item)).alias(item), F.collect_set(item).alias("_items"))
    sets = held.groupBy(whole_id).agg(F.collect_set(item).alias("_held"))  # a whole's members
    met = probes.join(held, item).join(sets, whole_id)
    return met.where(F.size(F.array_except("_items", "_held")) == 0).select(part_id, whole_id)


def same_sets(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """Keys that hold the same set of items on both sides (a guard against members having changed)."""
    as_set = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias(name))  # noqa: E731  a group's members
    return as_set(a, "_a").join(as_set(b, "_b"), key).where("_a = _b").select(key)


def only_once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose value of each key is in no other row (of all, whatever another key says): links that compete for an end are inert.
    Rows without a key compete with each other."""
    out = df
    for k in keys:
        taken = df.groupBy(F.col(k).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k")
        out = out.join(taken, F.col(k).eqNullSafe(F.col("_k")), "left_anti")
    return out


def upsert(old: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """Old rows whose key is new go, new rows come."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(old.columns).unionByName(new.select(old.columns))


def field_diff(before: DataFrame, after: DataFrame, key: str, fields: Keys) -> DataFrame:
    """``key, field, change``: every field that differs, and rows that came or went."""
    a = before.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_a"))
    b = after.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_b"))
    both = a.join(b, key, "full_outer")
    gone, came = F.col("_a").isNull(), F.col("_b").isNull()
    changes = F.when(came, F.array(F.struct(F.lit("*").alias("field"), F.lit("removed").alias("change")))).when(gone, F.array(F.struct(F.lit("*").alias("field"), F.lit("added").alias("change")))).otherwise(
        F.filter(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.struct(F.lit(f).alias("field"), F.lit("changed").alias("change"))) for f in fields]), lambda x: x.isNotNull())
    )
    return both.select(key, F.inline(changes))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side`` and the rows of one table that the other lacks, with multiplicity; empty if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def competition(df: DataFrame, left: str, right: str) -> DataFrame:
    """How many other candidates each end of a pair has. Counts are aggregations, so a common end is no task's own."""
    own = df
    for end, name in ((left, "left_rivals"), (right, "right_rivals")):
        own = own.join(df.groupBy(end).agg((F.count("*") - 1).alias(name)), end)
    return own.select(*df.columns, "left_rivals", "right_rivals")


def redirects(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``source, final, hops``: where each chain of redirects ends; chains that run into a circle end nowhere (null). Of several targets
    of a source the least counts. Each round doubles the way that is known, so a chain of n edges takes log n rounds; what has gone
    further than there are edges runs in a circle."""
    at = written(edges.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.min(target).alias("at")).withColumns({"hops": F.lit(1).cast("long"), "open": F.lit(True)}), "redirects")
    n = at.count()
    while at.where("open").limit(1).count():
        ahead = at.select(F.col("source").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("open").alias("_open"))
        met = at.join(ahead, "at", "left")
        hops = F.col("hops") + F.col("_hops")
        moved = F.col("open") & F.col("_at").isNotNull()
        far = moved & (hops > n)
        at = written(met.select("source", F.when(far, F.lit(None)).when(moved, F.col("_at")).otherwise(F.col("at")).alias("at"), F.when(moved, F.least(hops, F.lit(n + 1))).otherwise(F.col("hops")).alias("hops"), (moved & ~far & F.col("_open")).alias("open")), "redirects")
    circle = F.col("hops") > n
    return at.select("source", F.when(~circle, F.col("at")).alias("final"), F.when(~circle, F.col("hops")).alias("hops"))


def profile(df: DataFrame, columns: Keys) -> DataFrame:
    """``column, populated, nulls, blanks, zeros, distinct`` in one pass over the rows."""
    facts = []
    for c in columns:
        t = F.col(c).cast("string")
        facts.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("populated"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.trim(t) == "").alias("blanks"), F.count_if(t.rlike(r"^-?0+(\.0*)?$")).alias("zeros"), F.count_distinct(c).alias("distinct")))
    return df.agg(F.array(*facts).alias("_facts")).select(F.inline("_facts"))


def collisions(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """One row: how many rows have a key, how many keys, how many are shared, by how many at most, and how many
    shared keys stand for different values."""
    groups = df.select(key.alias("_k"), value.alias("_v")).where("_k IS NOT NULL AND _k <> ''").groupBy("_k").agg(F.count("*").alias("n"), F.count_distinct("_v").alias("v"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("eligible"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("shared"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count_if((F.col("n") > 1) & (F.col("v") > 1)).alias("mixed"))


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str, per: int = 5000, how: str = "inner", wide: bool = False) -> DataFrame:
    """``left`` and ``right`` by ``keys``, where keys with more than ``per`` rows on the left are dealt to several tasks by the hash of ``by`` and
    their rows on the right repeated for each. ``wide`` keeps small sides on all cores, for few rows that make many pairs, and no side is broadcast, for
    sides whose compressed files say little about their size."""
    hot = left.groupBy(*keys).agg(F.ceil(F.count("*") / per).cast("int").alias("_parts")).where("_parts > 1")
    hot = F.broadcast(hot)  # one row for each ``per`` rows at most; else this join would bring a hot key to one task
    parts = F.coalesce("_parts", F.lit(1))
    own = left.join(hot, list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    other = right.join(hot, list(keys), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    if wide:
        own, other = spread(own, *keys, "_part"), spread(other, *keys, "_part").hint("merge")
    return own.join(other, [*keys, "_part"], how).drop("_part")


def in_blocks(df: DataFrame, keys: Sequence[str], by: str, per: int, name: str = "_at") -> DataFrame:
    """``df`` with ``name``, the block of its key that a row is in by the hash of ``by``: some ``per`` rows at most, so a block of a key can be one array, and
    two of them one row of a join that only becomes pairs where it is read."""
    many = df.groupBy(*keys).agg(F.ceil(F.count("*") / per).cast("int").alias("_parts")).where("_parts > 1")
    told = df.join(F.broadcast(many), list(keys), "left")  # one row for each ``per`` rows at most
    return told.withColumn(name, F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt to as many tasks as there are cores or shuffle partitions, by the hash of ``by``: for small files whose rows make much work."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
