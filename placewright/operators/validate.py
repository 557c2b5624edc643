"""Constraints as queries: each gives rows of ``rule, key, detail``; no rows mean that it holds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _told(df: DataFrame, rule: str, key: Column | str, detail: Column) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def required(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns that are null or blank."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return _told(df.select(key, F.explode(missing).alias("_c")), "required", key, F.col("_c"))


def unique(df: DataFrame, key: str) -> DataFrame:
    return _told(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "unique", key, F.col("n"))


def references(df: DataFrame, key: str, column: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    own = df.select(key, F.col(column).alias("_r")).where("_r IS NOT NULL")
    return _told(own.join(dimension.select(F.col(dimension_key).alias("_r")).distinct(), "_r", "left_anti"), "references", key, F.col("_r"))


def holds(df: DataFrame, rule: str, key: str, condition: Column, detail: Column | None = None) -> DataFrame:
    """Rows where a condition is not true (unknown counts as broken)."""
    return _told(df.where(~F.coalesce(condition, F.lit(False))), rule, key, detail if detail is not None else F.lit(None))


def sorted_by(df: DataFrame, key: str, position: str, value: str, parts: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is below the one before, within ``parts``."""
    w = Window.partitionBy(*parts).orderBy(position)
    return _told(df.withColumn("_b", F.lag(value).over(w)).where(F.col("_b") > F.col(value)), "sorted", key, F.concat_ws(" > ", "_b", value))


def conserved(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that came, went, or stand more than once afterwards."""
    a, b = before.groupBy(key).agg(F.count("*").alias("a")), after.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return _told(both.where("a <> b"), "conserved", key, F.concat_ws(" -> ", "a", "b"))


def accounted(df: DataFrame, group: str, parts: Sequence[str], total: str) -> DataFrame:
    """Groups whose counts don't add up to their total."""
    s = reduce(lambda x, y: x + y, [F.coalesce(F.col(p), F.lit(0)) for p in parts])
    return _told(df.where(s != F.col(total)), "accounted", group, F.concat_ws(" <> ", s, total))


def at_least(df: DataFrame, rule: str, measure: Column, least: int) -> DataFrame:
    return _told(df.agg(measure.alias("n")).where(F.col("n") < least), rule, F.lit(None), F.col("n"))


def cardinality(df: DataFrame, rule: str, expected: int) -> DataFrame:
    return _told(df.agg(F.count("*").alias("n")).where(F.col("n") != expected), rule, F.lit(expected), F.col("n"))


def chunks(df: DataFrame, chunk: str, size: int) -> DataFrame:
    """Chunk numbers have no gap, and all but the last are full."""
    n = df.groupBy(chunk).agg(F.count("*").alias("n"))
    last = n.agg(F.max(chunk).alias("_last"), F.count("*").alias("_all"))
    return _told(n.crossJoin(F.broadcast(last)).where(((F.col(chunk) < F.col("_last")) & (F.col("n") != size)) | (F.col("n") > size) | (F.col("_all") != F.col("_last"))), "chunks", chunk, F.col("n"))  # one row is broadcast


def columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The exact set of columns."""
    wrong = [(c, "unexpected") for c in df.columns if c not in expected] + [(c, "missing") for c in expected if c not in df.columns]
    return df.sparkSession.createDataFrame([("columns", c, w) for c, w in wrong], "rule string, key string, detail string")


def combinations(df: DataFrame, key: str, fields: Sequence[str], legal: Sequence[tuple]) -> DataFrame:
    """Rows whose fields together are none of the legal combinations."""
    own = F.concat_ws("|", *fields)
    return holds(df, "combinations", key, own.isin(*["|".join(map(str, x)) for x in legal]), own)


def present(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that must be there, word for word, and are not."""
    return _told(expected.join(df.select(expected.columns).distinct(), expected.columns, "left_anti"), "present", F.concat_ws("|", *expected.columns), F.lit("missing"))


def digests(df: DataFrame, key: str, content: str, expected: DataFrame) -> DataFrame:
    """``expected`` (key, sha256) that the contents no longer have."""
    now = df.select(key, F.sha2(content, 256).alias("_now"))
    return _told(expected.join(now, key, "left").where("NOT (_now <=> sha256)"), "digests", key, F.col("_now"))


def all_of(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def enforce(violations: DataFrame, show: int = 5) -> None:
    """Raise if there is any violation, naming the first few."""
    found = violations.limit(show).collect()
    if found:
        raise ValueError("constraints broken: " + "; ".join(f"{r['rule']} {r['key']}: {r['detail']}" for r in found))
