"""Tables in the folder that all executors share: lineage ends there, and they go when they are no longer needed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a local one, which only a local master can use."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "/tmp/checkpoints"
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "graph", held: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read again, so that plans don't grow and lost executors only cost a read. The path is
    added to `held`, for discard()."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, held: list[str]) -> None:
    """Delete tables that cut() wrote."""
    for path in held:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    held.clear()
