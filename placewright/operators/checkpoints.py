"""Tables written between jobs: lineage and estimates end there, and a lost executor costs a task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the folder the cluster names in ``spark.checkpoint.dir``, read back. Only a session in one process may
    leave it unset, and gets a folder of its own."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="placewright-")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more, such as the one of the round before last."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
