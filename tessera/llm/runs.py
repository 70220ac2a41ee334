"""Running sums along ordered groups of any size, none of which one task need hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import columns_of, keep


def running(rows: DataFrame, key: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`rows` with, for each name of `sums`, the sum of its expression over the rows of
    the same `key` up to and with this one in `order`. Rows that tie in `order` must be
    alike, or any order of them must do. A null key is a key.

    Rows are dealt by ranges of key and order, so a large group lies in many parts. Sums
    of the parts of such groups (two at most for each part, for only the groups at its
    ends go beyond it) are broadcast, and the rest is a window within each part.
    """
    dealt = rows.withColumns({f"sum_{n}": e for n, e in sums.items()}).repartitionByRange(key, *order)
    dealt = keep(dealt.withColumn("run_part", F.spark_partition_id()), "runs")
    parts = dealt.groupBy(key, "run_part").agg(*(F.sum(f"sum_{n}").alias(f"part_{n}") for n in sums))
    ends = dealt.groupBy(key).agg(F.min("run_part").alias("a"), F.max("run_part").alias("b")).where("a < b").select(F.col(key).alias("run_key"))
    torn = parts.join(F.broadcast(ends), F.col(key).eqNullSafe(F.col("run_key")), "left_semi")  # fewer than the parts
    before = Window.partitionBy(key).orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = torn.select(F.col(key).alias("run_key"), F.col("run_part").alias("run_place"), *(F.coalesce(F.sum(f"part_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in sums))
    met = dealt.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("run_key")) & (F.col("run_part") == F.col("run_place")), "left")
    within = Window.partitionBy(key, "run_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return met.select(*columns_of(rows), *((F.sum(f"sum_{n}").over(within) + F.coalesce(f"before_{n}", F.lit(0))).alias(n) for n in sums))
