"""Reviewed records: lookups by alias, candidate pairs by names, decisions that supersede each other, and accounted partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions import text
from placewright.operators.linkage import close_names
from placewright.operators.relational import dealt_join, first_per_group


def name_index(features: DataFrame, key: str, fields: Sequence[str], between: str = r"\s+/\s+") -> DataFrame:
    """``alias, key, field``: every name of every feature over several columns (the first column that has it), composite labels split too,
    as folded words. One row for each alias and feature."""
    parts = F.concat(*[F.transform(F.concat(F.array(F.col(f)), F.split(F.coalesce(F.col(f), F.lit("")), between)), lambda n, i=i: F.struct(text.words(n).alias("alias"), F.lit(i).alias("field"))) for i, f in enumerate(fields)])
    named = features.select(key, F.inline(parts)).where("alias <> ''")
    return named.groupBy("alias", key).agg(F.min("field").alias("field"))


def by_alias(probes: DataFrame, probe: str, index: DataFrame, key: str, manual: DataFrame | None = None) -> DataFrame:
    """``probes`` with ``key`` and ``how``: every feature that has the name in its best column (``exact``), else what ``manual`` (alias, key)
    says, else null (``none``). Ambiguous names keep all of their features."""
    asked = probes.withColumn("alias", text.words(F.col(probe)))
    best = index.groupBy("alias").agg(F.min("field").alias("field"))
    exact = index.join(best, ["alias", "field"]).select("alias", F.col(key).alias("_exact"))
    met = asked.join(exact, "alias", "left")
    if manual is None:
        return met.withColumns({key: F.col("_exact"), "how": F.when(F.col("_exact").isNotNull(), "exact").otherwise("none")}).drop("_exact", "alias")
    hits = met.where(F.col("_exact").isNotNull()).withColumns({key: F.col("_exact"), "how": F.lit("exact")}).drop("_exact", "alias")
    told = manual.select(text.words(F.col("alias")).alias("alias"), F.col(key).alias("_manual")).distinct()
    rest = met.where(F.col("_exact").isNull()).drop("_exact").join(told, "alias", "left")
    rest = rest.withColumns({key: F.col("_manual"), "how": F.when(F.col("_manual").isNotNull(), "manual").otherwise("none")}).drop("_manual", "alias")
    return hits.unionByName(rest)


def translated(c: Column, terms: dict[str, str], vetoes: dict[str, str] | None = None) -> Column:
    """Terms of a dictionary replaced wherever they stand, longest first. A term is passed over, and only that term, while the text as it stands by
    then holds the term's veto (a longer name that the term is part of)."""
    held = vetoes or {}
    step = lambda own, term: F.replace(own, F.lit(term), F.lit(terms[term]))
    each = lambda own, term: F.when(F.contains(own, F.lit(held[term])), own).otherwise(step(own, term)) if term in held else step(own, term)
    return reduce(each, sorted(terms, key=lambda t: (-len(t), t)), c)


def denormalised(facts: DataFrame, key: str, ids: str, dimension: DataFrame, dimension_key: str, name: str) -> DataFrame:
    """``key`` and ``name``: the dimension's rows for an array of ids, in the array's order; ids without a row are left out."""
    every = facts.select(key, F.posexplode(ids).alias("_at", dimension_key)).join(dimension, dimension_key)
    rows = every.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", *dimension.columns))).alias("_rows"))  # as many as the array holds
    rows = rows.select(key, F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in dimension.columns])).alias(name))
    return facts.select(key).join(rows, key, "left").withColumn(name, F.coalesce(name, F.filter(F.array(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in dimension.dtypes])), lambda _: F.lit(False))))


def approval(groups: DataFrame, group: str, member: str, approved: DataFrame) -> DataFrame:
    """``group, some, every``: whether any and whether all of a group's members are approved; a mixed group has only the first."""
    told = groups.select(group, member).join(approved.select(member).distinct().withColumn("_ok", F.lit(True)), member, "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    return told.groupBy(group).agg(F.bool_or("_ok").alias("some"), F.bool_and("_ok").alias("every"))


def substring_pairs(left: DataFrame, right: DataFrame, least: int = 4, ratio: float = 0.48) -> DataFrame:
    """``id, other`` of ``left`` (id, name) whose name stands in one of ``right`` (other, name), from ``least`` characters and that ratio of
    lengths on. Names meet by grams: the shorter one's rarest gram must stand in the longer one, so common grams make few pairs. Equal names of
    ``right`` are one until the pairs are known, and their rows come in dealt."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(c, i, F.lit(least))))
    long_enough = F.length("name") >= least
    named = right.where(long_enough).select("other", F.col("name").alias("other_name"))
    held = named.select("other_name").distinct().withColumn("gram", F.explode(grams(F.col("other_name"))))
    often = held.groupBy("gram").agg(F.count("*").alias("often"))
    own = left.where(long_enough).select("id", "name", F.explode(grams(F.col("name"))).alias("gram")).join(often, "gram", "left")
    probe = own.groupBy("id", "name").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))
    met = dealt_join(held, probe, ["gram"], "other_name").where(F.contains("other_name", "name") & (F.length("name") >= ratio * F.length("other_name")))
    return dealt_join(named, met.select("id", "other_name").distinct(), ["other_name"], "other").select("id", "other").distinct()


def looked_up_once(df: DataFrame, probe: str, lookup) -> DataFrame:
    """``df`` joined with what ``lookup`` says of its distinct probes: a costly source is asked once for each."""
    return df.join(lookup(df.select(probe).where(F.col(probe).isNotNull()).distinct()), probe, "left")


def superseded(decisions: DataFrame, key: str, position: str, decision: str, replaces: str) -> tuple[DataFrame, DataFrame]:
    """The last decision of each key, and violations: later decisions that don't name the one before them."""
    w = Window.partitionBy(key).orderBy(position)
    seen = decisions.withColumn("_before", F.lag(decision).over(w))
    wrong = seen.where(F.col("_before").isNotNull() & ~F.col(replaces).eqNullSafe(F.col("_before")))
    return first_per_group(decisions, [key], [-F.col(position)]), wrong.select(key, position, F.col("_before").alias("unnamed"))


def partitioned(df: DataFrame, buckets: Sequence[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``bucket``: the only condition that holds; rows where none or several do are in ``unassigned`` or ``ambiguous``, so every row
    is accounted for."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in buckets]))
    return df.withColumn("bucket", F.when(F.size(hits) == 1, hits[0]).when(F.size(hits) == 0, "unassigned").otherwise("ambiguous"))


def filled(columns: Sequence[str]) -> Column:
    """The values of numbered columns that are not blank, in order."""
    return F.filter(F.transform(F.array(*[F.trim(F.col(c).cast("string")) for c in columns]), lambda x: F.nullif(x, F.lit(""))), lambda x: x.isNotNull())


def with_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """``key`` and the columns whose names start with a prefix."""
    return df.select(key, *[c for c in df.columns if c.startswith(prefix)])


def exported(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A fixed set of columns; those that are not there are null texts."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def alive_in(start: Column, end: Column, year: int) -> Column:
    """Whether an interval holds a year; an unknown or zero start holds none, an open end all later ones."""
    return F.coalesce((start > 0) & (start <= year) & (end.isNull() | (end >= year)), F.lit(False))


def labelled(df: DataFrame, order: Sequence[Column | str], parts: Sequence[str], prefix: str, width: int, name: str = "label") -> DataFrame:
    """Labels such as ``C001`` by rank within ``parts``; longer numbers keep all their digits."""
    rank = F.row_number().over(Window.partitionBy(*parts).orderBy(*order)).cast("string")
    return df.withColumn(name, F.concat(F.lit(prefix), F.when(F.length(rank) >= width, rank).otherwise(F.lpad(rank, width, "0"))))


def by_enum(c: Column, values: Sequence[str]) -> Column:
    """The position of a value in a fixed order, unknown ones last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), c), F.lit(0)), F.lit(len(values) + 1)).cast("int")


def adjacent(df: DataFrame, key: str, items: str, closed: bool = False) -> DataFrame:
    """``key, segment, a, b``: neighbouring items of an array; a ``closed`` one goes on from its last to its first."""
    own = F.concat(items, F.slice(items, 1, 1)) if closed else F.col(items)
    pairs = F.zip_with(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return df.select(key, F.posexplode(pairs).alias("segment", "_p")).select(key, "segment", "_p.*")


def noted(df: DataFrame, parts: Sequence[str], position: str, is_note: str, marked: str, note: str) -> DataFrame:
    """Marked rows with the first note that comes after them in their part (a footnote holds for what is above it)."""
    w = Window.partitionBy(*parts).orderBy(position).rowsBetween(1, Window.unboundedFollowing)
    after = F.first(F.when(F.col(is_note), F.col(note)), ignorenulls=True).over(w)
    return df.withColumn("attached", F.when(F.col(marked), after)).where(~F.col(is_note))


def variant_groups(records: DataFrame, group: str, key: str, name: str, score: str) -> DataFrame:
    """``group, key, leader``: within a group names join the most specific name that they are a spelling of, else they lead on their
    own. Most specific first, as each name asks only leaders before it; a group is a site's names and its work is one aggregation."""
    own = F.struct((-F.col(score)).alias("s"), F.col(key).alias("key"), text.compact(F.col(name)).alias("c"))
    held = records.groupBy(group).agg(F.array_sort(F.collect_list(own)).alias("_all"))
    kind = "array<struct<key:{k},c:string,leader:{k}>>".format(k=dict(records.dtypes)[key])

    def take(made: Column, row: Column) -> Column:
        leaders = F.filter(made, lambda m: (m["key"] == m["leader"]) & close_names(m["c"], row["c"]))
        return F.concat(made, F.array(F.struct(row["key"].alias("key"), row["c"].alias("c"), F.coalesce(F.get(leaders, 0)["leader"], row["key"]).alias("leader"))))

    found = held.select(group, F.explode(F.reduce("_all", F.array().cast(kind), take)).alias("_m"))
    return found.select(group, F.col("_m.key").alias(key), F.col("_m.leader").alias("leader"))


def chunk_progress(df: DataFrame, chunk: str, measures: dict[str, Column]) -> DataFrame:
    """One row for each chunk: its rows, and how many meet each measure."""
    return df.groupBy(chunk).agg(F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in measures.items()])
