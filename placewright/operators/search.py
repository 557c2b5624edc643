"""Name search: one row of distinct terms for each group, ranked exact, prefix, contains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.text import search_key
from placewright.operators.relational import first_per_group


def search_records(features: DataFrame, group: str, position: str, name: str, terms: Sequence[str]) -> DataFrame:
    """``group, name, position, terms``: normalised distinct terms of each group's first feature; ``terms`` may be texts or arrays."""
    kinds = dict(features.dtypes)
    lists = [F.coalesce(F.col(t), F.array().cast("array<string>")) if kinds[t].startswith("array") else F.array(t) for t in terms]
    own = F.filter(F.concat(*lists), lambda t: t.isNotNull() & (t != ""))
    first = first_per_group(features, [group], [position])
    return first.select(group, name, position, F.array_distinct(F.transform(own, search_key)).alias("terms"))


def search(records: DataFrame, queries: DataFrame, group: str, name: str, position: str, limit: int = 10, most_queries: int = 1000) -> DataFrame:
    """``query, rank, place`` and the record's key of the best ``limit`` records for each row of ``queries`` (query). Queries
    are what people typed: at most ``most_queries`` rows, which are broadcast (more are an error); records stay where they are and are cut
    to the best before sorting."""
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries at once")
    asked = queries.select("query", search_key(F.col("query")).alias("_q")).where("_q <> ''")
    term = records.select(group, name, position, F.explode("terms").alias("_t"))
    met = term.join(F.broadcast(asked), F.instr(F.col("_t"), F.col("_q")) > 0)
    rank = F.when(F.col("_t") == F.col("_q"), 0).when(F.col("_t").startswith(F.col("_q")), 1).otherwise(2)
    best = met.groupBy("query", group, name, position).agg(F.min(rank).alias("rank"))
    w = Window.partitionBy("query").orderBy("rank", name, position)
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query", "place", "rank", group, name)
