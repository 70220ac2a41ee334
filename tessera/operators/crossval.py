"""Cluster-grouped cross-validation: folds, weights, and the two controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import uniform
from .digests import list_digests


def folds(members: DataFrame, trials: int, k: int, seed: int) -> DataFrame:
    """(clustering_id, trial, cluster_id, fold): clusters in a shuffled order of each
    trial, dealt out in turn, so a cluster is whole in its fold. Clusterings of fewer
    than `k` clusters are left out."""
    clusters = members.select("clustering_id", "cluster_id").distinct()
    sizes = clusters.groupBy("clustering_id").agg(F.count("*").alias("clusters")).where(F.col("clusters") >= k)
    runs = clusters.join(sizes, "clustering_id").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    order = Window.partitionBy("clustering_id", "trial").orderBy(uniform(str(seed), F.col("trial"), F.col("cluster_id")), "cluster_id")
    return runs.select("clustering_id", "trial", "cluster_id", F.pmod(F.row_number().over(order) - 1, F.lit(k)).alias("fold"))


def training_weights(members: DataFrame, equal_clusters: bool = True) -> DataFrame:
    """`members` with w, one over the size of the cluster (or 1)."""
    if not equal_clusters:
        return members.withColumn("w", F.lit(1.0))
    sizes = members.groupBy("clustering_id", "cluster_id").agg((1.0 / F.count("*")).alias("w"))
    return members.join(sizes, ["clustering_id", "cluster_id"])


def random_affinity(members: DataFrame, seed: int) -> DataFrame:
    """(complex_id, value): each distinct cluster, by its members, adds one random
    number to all of them: a control in which clusters matter and structures don't."""
    ids = F.col("complex_id").cast("string")
    # A digest stands for the members, which are as many as rows of it.
    named = list_digests(members, ["clustering_id", "cluster_id"], [ids], ids, ":", f"{seed}:")
    each = members.join(named, ["clustering_id", "cluster_id"]).select("complex_id", "md5").distinct()
    return each.groupBy("complex_id").agg(F.sum(F.conv(F.substring("md5", 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)).alias("value"))


def best_splits(rows: DataFrame, leaf: int, by: list[str] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """(*by, threshold, sse): the split of least squared error for each group, by running
    sums over its distinct x. Left has over `leaf` rows, right at least `leaf`."""
    by = by or []
    each = rows.groupBy(*by, x).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    w, up = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(x)
    run = each.select(*by, x, F.lead(x).over(up).alias("after"), *[F.sum(c).over(up).alias(f"l{c}") for c in "nsq"], *[F.sum(c).over(w).alias(f"t{c}") for c in "nsq"])
    c = F.col
    ok = run.where((c("ln") >= leaf + 1) & (c("tn") - c("ln") >= leaf) & c("after").isNotNull())
    sse = c("lq") - c("ls") * c("ls") / c("ln") + (c("tq") - c("lq")) - (c("ts") - c("ls")) * (c("ts") - c("ls")) / (c("tn") - c("ln"))
    cand = ok.select(*by, ((c(x) + c("after")) / 2).alias("threshold"), sse.alias("sse"))
    return cand.groupBy(*by).agg(F.min(F.struct(F.round("sse", 6).alias("sse"), "threshold")).alias("m")).select(*by, "m.threshold", "m.sse")
