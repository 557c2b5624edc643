"""Feeds that resume: what is fetched once is kept by key, and what has been kept is not fetched again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def still_to_fetch(wanted: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    return wanted.join(fetched.where("status = 'ok'").select(key).distinct(), key, "left_anti")


def with_fallback(fresh: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Fresh values, and the cache's where fetching failed; a key that was fetched and is empty stays empty."""
    both = fresh.select(key, value, "status").join(cache.select(key, F.col(value).alias("_old")), key, "full_outer")
    failed = F.coalesce(F.col("status"), F.lit("failed")) == "failed"
    return both.select(key, F.when(failed, F.col("_old")).otherwise(F.col(value)).alias(value), F.when(failed, F.lit("cache")).otherwise(F.lit("fresh")).alias("source"))


def keep_latest(stream: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's latest row of every key under the batch's own folder; a batch that is run again after a
    failure overwrites its folder. ``latest`` reads them."""
    def write(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(kept: DataFrame, key: str, order: str) -> DataFrame:
    columns = [c for c in kept.columns if c != "batch"]
    return kept.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "batch")).alias("_row")).select("_row.*")
