"""Written tables that cut lineage, in the folder that the whole cluster shares.

They are Parquet under `spark.checkpoint.dir`, so they outlive any executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine whose session names no folder, as in tests.
LOCAL = "file:///tmp/checkpoints"
#: Rows of a key, at least, and as a share of all rows, from which `lookup` takes it apart.
HOT, HOT_SHARE = 1000, 500


def folder(spark: SparkSession) -> str:
    """The shared folder: the session's `spark.checkpoint.dir`, else `LOCAL`, which
    fails where tasks run on other machines."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return (named or LOCAL).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` and returns it as read again; `drop` removes it, `clear` all of them."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Deletes what `keep` wrote for `df`; later reads of it fail."""
    _delete(df.sparkSession, df._kept_at)


def clear(spark: SparkSession) -> None:
    """Deletes all that `keep` wrote for this application. Results not yet written are
    lost with it, so this comes last."""
    _delete(spark, f"{folder(spark)}/{spark.sparkContext.applicationId}")


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of `df`, whatever characters their names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """`rows` (of `keep`) joined to `table`, which has one row at most for each `key`.

    Keys with over a `HOT_SHARE`-th of all rows, and over `HOT`, are under `HOT_SHARE`:
    their rows stay where they are and meet a broadcast of these keys' entries. The
    other rows are shuffled by key, which is no hot group then.
    """
    floor = max(HOT, rows.count() // HOT_SHARE)
    hot = [r[key] for r in rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > floor).select(key).collect()]  # under HOT_SHARE of them
    known = [k for k in hot if k is not None]
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(known), F.lit(None in hot))
    cold = rows.where(~is_hot).join(table.where(~is_hot), key, how)
    return cold.unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of `rows`, which bounds what a task makes of one at a time;
    Spark bounds the bytes of a batch itself."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
