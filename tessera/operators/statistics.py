"""Weighted statistics of rows (observed, predicted, cluster), by explicit sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import uniform


def weighted(rows: DataFrame, by: list[str] | None = None, equal_clusters: bool = False) -> DataFrame:
    """`rows` with w: 1, or with `equal_clusters` one over the rows of the cluster."""
    by = by or []
    if not equal_clusters:
        return rows.withColumn("w", F.lit(1.0))
    n = rows.groupBy(*by, "cluster").agg(F.count("*").alias("cluster_n"))
    return rows.join(n, [*by, "cluster"]).withColumn("w", 1.0 / F.col("cluster_n")).drop("cluster_n")


def statistics(rows: DataFrame, by: list[str] | None = None, equal_clusters: bool = False) -> DataFrame:
    """(*by, n, pearson, rmse, r2): pearson and r2 are null where a side is constant.
    r2 is against the mean of what was observed."""
    w, x, y = F.col("w"), F.col("observed"), F.col("predicted")
    sums = weighted(rows, by, equal_clusters).groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"), F.sum(w * (x - y) * (x - y)).alias("see")
    )
    c = F.col
    cov, vx, vy = c("sxy") - c("sx") * c("sy") / c("sw"), c("sxx") - c("sx") * c("sx") / c("sw"), c("syy") - c("sy") * c("sy") / c("sw")
    return sums.select(*(by or []), "n", F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))).alias("pearson"), F.sqrt(c("see") / c("sw")).alias("rmse"), (1 - F.try_divide(c("see"), vx)).alias("r2"))


def r2_against(model: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """(n, r2): the model's squared errors against the baseline's. Observed values of
    the two must be the same, else this fails."""
    both = model.alias("m").join(baseline.alias("b"), key)
    x = F.when(F.col("m.observed") == F.col("b.observed"), F.col("m.observed")).otherwise(F.raise_error(F.lit("observed values differ")).cast("double"))
    err = lambda s: F.sum((x - F.col(f"{s}.predicted")) * (x - F.col(f"{s}.predicted")))
    return both.agg(F.count("*").alias("n"), (1 - F.try_divide(err("m"), err("b"))).alias("r2"))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, mean, sd): the population standard deviation."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


#: Rounds of the bijection below.
ROUNDS = 6


def permuted(place: Column, n: Column, *key: Column | str | int) -> Column:
    """The place that a keyed bijection of 0 .. n - 1 gives `place`: computed for each
    place alone, so no order of all of them is made.

    A place is a pair (l, r) below (a, b), a about the root of n and a b at least n. In
    turn one of the two is shifted by a number drawn from the other, which can be undone.
    What comes out at n or above goes in again: fewer than a places can, one after
    another, so that ends.
    """
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")

    def round_(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        even = i % 2 == 0
        left = F.when(even, (l + uniform(*key, i, r)) % a).otherwise(l)
        right = F.when(even, r).otherwise((r + uniform(*key, i, l)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    def once(v: Column) -> Column:
        start = F.struct((v % a).alias("l"), F.floor(v / a).cast("long").alias("r"))
        done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_)
        return done["r"] * a + done["l"]

    again = F.sequence(F.lit(0).cast("long"), a * b - n)
    return F.aggregate(again, F.lit(-1).cast("long"), lambda v, i: F.when((v >= 0) & (v < n), v).otherwise(once(F.when(v < 0, place.cast("long")).otherwise(v))))


#: Draws of a cluster that a task makes at a time.
STRETCH = 8192


def permutation_p(rows: DataFrame, permutations: int, seed: int, by: list[str] | None = None, equal_clusters: bool = False) -> DataFrame:
    """(*by, r, p, hits): how often shuffled clusters correlate as much as the real ones,
    either way.

    In each permutation a slot j takes the observed of cluster perm(j) and the
    predicted of cluster j, both drawn with replacement as often as a uniform number
    between the sizes of the two; with `equal_clusters` a slot weighs one. perm(j) is
    computed by `permuted`, so nothing is sorted for a permutation. The draws come from
    MD5, so reruns agree. Only clusters and their sizes are permuted: rows
    meet their draws by their place in the cluster. No permutation gives p -1; a group
    of one cluster, p null.
    """
    by = by or []
    real = statistics(rows, by, equal_clusters).select(*by, F.col("pearson").alias("r"))
    if permutations < 1:
        return real.withColumns({"p": F.lit(-1.0), "hits": F.lit(0).cast("long")})
    place = Window.partitionBy(*by, "cluster").orderBy("observed", "predicted")
    placed = rows.select(*by, "cluster", "observed", "predicted", (F.row_number().over(place) - 1).alias("pos"))
    # A row for each cluster of a group.
    sizes = rows.groupBy(*by, "cluster").agg(F.count("*").alias("n")).withColumns({"slot": F.row_number().over(Window.partitionBy(*by).orderBy("cluster")), "groups": F.count("*").over(Window.partitionBy(*by))})
    runs = sizes.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    draw = lambda name, *parts: uniform(name, seed, *[F.col(c) for c in (*by, "perm", *parts)])
    key = ("p", seed, *[F.col(c) for c in (*by, "perm")])
    dealt = runs.withColumn("from_slot", permuted(F.col("slot") - 1, F.col("groups"), *key) + 1).drop("groups")
    both = dealt.join(sizes.select(*by, F.col("slot").alias("from_slot"), F.col("cluster").alias("from"), F.col("n").alias("from_n")), [*by, "from_slot"])
    lo, hi = F.least("n", "from_n"), F.greatest("n", "from_n")
    sized = both.withColumn("draws", lo + draw("n", "slot") % (hi - lo + 1))
    # A few clusters may have very many draws: stretches of them are dealt over tasks.
    parts = sized.withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"), F.lit(STRETCH).cast("long"))))
    spread = parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "perm", "slot", "start")
    drawn = spread.withColumn("k", F.explode(F.sequence("start", F.least(F.col("draws"), F.col("start") + (STRETCH - 1)))))
    drawn = drawn.withColumns({"x": draw("o", "slot", "k") % F.col("from_n"), "y": draw("q", "slot", "k") % F.col("n")})
    first = placed.select(*by, F.col("cluster").alias("from"), F.col("pos").alias("x"), "observed")
    second = placed.select(*by, "cluster", F.col("pos").alias("y"), "predicted")
    drawn = drawn.join(first, [*by, "from", "x"]).join(second, [*by, "cluster", "y"])
    rs = statistics(drawn.select(*by, "perm", F.col("slot").alias("cluster"), "observed", "predicted"), [*by, "perm"], equal_clusters)
    clusters = sizes.groupBy(*by).agg(F.count("*").alias("clusters"))
    one = F.lit(1).alias("one")
    keys = [*by, "one"]
    each = rs.select(*by, one, F.col("pearson").alias("drawn")).join(real.select("*", one), keys).join(clusters.select("*", one), keys)
    hits = F.count_if(F.abs("drawn") >= F.abs("r"))
    found = each.groupBy(*by, "r").agg(hits.alias("hits"), F.first("clusters").alias("clusters"))
    return found.select(*by, "r", F.when(F.col("clusters") > 1, F.col("hits") / F.lit(float(permutations))).alias("p"), "hits")
