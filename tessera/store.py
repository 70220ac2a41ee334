"""Written tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine whose session names no folder, as in tests.
LOCAL = "file:///tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """The shared folder: the session's `spark.checkpoint.dir`, else `LOCAL`, which
    fails where tasks run on other machines."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return (named or LOCAL).rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Writes `df` and returns it as read again, so that no executor need survive."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
