"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a folder of our own only where that is unset and Spark runs in one
    process. A cluster that names none is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="placewright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and every later
    job (or a retry after a lost executor) reads whole files instead of computing again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df: DataFrame) -> Column:
    """The text column of ``df``, null as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def block_counts(counts: DataFrame, key: str, total: int, per: int = 2000, keys: int = 10_000) -> DataFrame:
    """``key, _blocks`` of the keys that hold at least ``per`` of ``total`` rows, and at least one in ``keys`` of them: no more than
    ``keys`` rows, which are broadcast. ``counts`` has the rows of each key as ``n``; the other keys are one block."""
    return F.broadcast(counts.where(F.col("n") >= max(per, -(-total // keys))).select(key, F.ceil(F.col("n") / per).cast("int").alias("_blocks")))


def block_join(left: DataFrame, right: DataFrame, keys: str | list[str], by: str, blocks: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` and ``right`` by ``keys``, where a first key with many rows on the left is dealt to blocks (by the hash of ``by``) and
    its rows on the right are repeated for each block."""
    keys = [keys] if isinstance(keys, str) else keys
    many = F.coalesce("_blocks", F.lit(1))
    dealt = left.join(blocks, keys[0], "left").withColumn("_block", F.pmod(F.xxhash64(by), many).cast("int")).drop("_blocks")
    spread = right.join(blocks, keys[0], "left").withColumn("_block", F.explode(F.sequence(F.lit(0), many - 1))).drop("_blocks")
    return dealt.join(spread, [*keys, "_block"], how).drop("_block")
