"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage durably: any executor may be lost afterwards, the
optimizer knows its size, and several readers share one computation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it isn't set, a folder in the warehouse, on a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet and read again."""
    path = f"{shared_dir(df.sparkSession)}/isospark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    if path := getattr(df, "_written_at", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
