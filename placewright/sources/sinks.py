"""Sinks: GeoJSON documents, numbered chunks, drift checks and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.operators.relational import chunked, set_differences


def feature_lines(df: DataFrame, x: Column, y: Column, properties: Sequence[str], order: str) -> DataFrame:
    """One GeoJSON feature a row (``value``), nulls left out: a document of any size is a sequence of such lines."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))
    return df.orderBy(order).select(feature.alias("value"))


def write_chunks(df: DataFrame, path: str, chunk: str, order: Sequence[str] = ()) -> None:
    """One folder for each chunk number, its rows in ``order``; older chunks go."""
    df.repartition(chunk).sortWithinPartitions(chunk, *order).write.mode("overwrite").partitionBy(chunk).json(path)


def feature_collections(df: DataFrame, x: Column, y: Column, properties: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """``chunk, value``: a FeatureCollection document for each ``size`` features in global order; nulls are left out."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("rank", feature.alias("feature")))), lambda f: f["feature"])  # ``size`` at most
    return chunked(df, order, size).groupBy("chunk").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), held.alias("features"))).alias("value"))


def drift(df: DataFrame, saved: DataFrame) -> DataFrame:
    """What a written table and its recomputation don't share; empty if nothing drifted."""
    return set_differences(saved.select(df.columns), df)


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a Markdown table as ``value``, with bars escaped."""
    cells = [F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
