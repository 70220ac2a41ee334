"""Connected components by alternating large-star and small-star steps, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, keep, lookup


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges`; root is the smallest node reachable.

    Each step takes minima per node with partial aggregation and joins them back,
    so a node with very many links is never gathered in one group; its links meet its
    minimum by `lookup`, where they lie. Nulls and loops are ignored; no edges give no
    rows. Needs about log2 of the longest path steps; raises if `rounds` run out.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = keep(pairs.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        up = now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        large = lookup(up, least, "u", "inner").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        large = keep(large, "large")
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        step = lookup(large, small, "hi", "inner").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(small.select(F.col("m").alias("lo"), "hi"))
        after = keep(step.where("lo <> hi").distinct(), "edges")
        drop(large)
        drop(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x"), F.sum(F.xxhash64("hi", "lo").bitwiseAND(0xFFFFFF)).alias("s")).first()
    return row["n"], row["x"], row["s"]
