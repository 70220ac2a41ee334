"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's rows are permuted by hash and cut into disjoint blocks. A source's
quota is an exact number of words: whole passes over its blocks, then blocks of a
further pass, the last of them cut between two documents. The splitting tree deals
block copies out: at each node a uniformly random subset of exact size goes left,
so the sources' counts there are multivariate hypergeometric; the leaves are the
output shards, and each shuffles what it got: every copy has a place in its shard's
own order. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import columns_of, drop, keep

#: Words: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Weights by rank of the source, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Equal rows that one task writes out.
RUN = 10_000


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, source_rows, target) from rows (source, size).

    Sources rank by code point, null last, and weigh `weights`, repeating. They
    share `share` times all words; none gets over `most` times its own. With the
    sources sorted by cap / weight, those before some place get their cap and the
    others the rest by weight, so a running sum finds the place.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    # One row for each source from here on: their number bounds these windows.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = each.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = ranked.withColumn("rest", total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("lambda", F.col("rest") / F.sum("w").over(after))
    level = level.withColumn("fits", F.col("lambda") * F.col("w") <= F.col("cap"))
    # Past that place levels only fall, so the right one is the highest that fits.
    return level.withColumn("found", F.max(F.when(F.col("fits"), F.col("lambda"))).over(everything)).select("source", "source_size", "source_rows", F.least("cap", F.coalesce(F.col("found") * F.col("w"), F.col("cap"))).alias("target"))


def row_key(seed: int, *columns: Column) -> Column:
    """A hash that tells a null from what stands beside it."""
    return F.xxhash64(F.lit(seed), *[c for x in columns for c in (x, x.isNull())])


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows equal in `keys`, numbered: a row (*keys, nth) for each. Equal rows are counted
    where they lie and written out again in runs of `RUN` that are dealt over tasks, so
    no task gets all rows of one kind."""
    runs = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    runs = keep(runs, "runs")
    if (runs.agg(F.max("run").alias("m")).first()["m"] or 0) > 0:
        # By a fixed number: runs are few bytes, and the adaptive rule would put them together.
        runs = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "run")
    upto = F.least(F.col("n"), (F.col("run") + 1) * RUN)
    return runs.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN + 1, upto))).select(*keys, "nth")


def mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", shards: int = 16, seed: int = 1, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, more: Column | None = None) -> DataFrame:
    """One row for each row of `docs`: (row_key, nth, ident, source, size, source_size,
    target, taken, copies, shards, places), shards and places having an entry for each
    copy taken: its shard, and where it stands there once the shard is shuffled.

    Null texts have size 0. A source whose words are all zero has target 0. Rows equal
    in ident, source and text (and `more`, a hash) are told apart by `nth` alone, which
    is any of 1 to their number. An empty table gives no rows. Equal `seed`s give
    equal results, however the input is dealt.
    """
    key = row_key(seed, F.col(ident), F.col(source), F.col(text), *([more] if more is not None else []))
    named = docs.select(F.col(ident).alias("ident"), F.col(source).alias("source"), word_count(text).alias("size"), key.alias("row_key"))
    rows = keep(counted(named, ["row_key", "ident", "source", "size"]), "sizes")
    targets = keep(source_targets(rows, weights, share, most), "targets")
    # About the square root of all rows in a block: blocks and rows in a block stay few together.
    all_rows = F.sum("source_rows").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / F.greatest(F.lit(2048.0), F.sqrt(all_rows)))).cast("long")
    plan = targets.withColumn("blocks", blocks).withColumns({"passes": F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("long")})
    plan = plan.withColumn("more", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    dealt = rows.join(F.broadcast(plan) if _few(plan) else plan, rows.source.eqNullSafe(plan.source)).drop(plan.source)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "row_key", "nth"), "blocks"))
    sums = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"), F.first("more").alias("more"), F.first("passes").alias("passes"))
    order = Window.partitionBy("source").orderBy("block")
    upto = sums.withColumn("ahead", F.sum("words").over(order) - F.col("words"))
    # The last pass: whole blocks first, then the one in which the quota ends.
    upto = upto.withColumn("whole", F.col("ahead") + F.col("words") <= F.col("more")).withColumn("cut", ~F.col("whole") & (F.col("ahead") < F.col("more")))
    upto = keep(upto, "quotas")
    tree = keep(splitting_tree(upto.select("source", "block", F.col("passes") + (F.col("whole") | F.col("cut")).cast("long")).toDF("source", "block", "quota"), shards, seed), "tree")
    table = upto.join(tree.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("leaves")).withColumnsRenamed({"source": "s", "block": "b"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    table = keep(table.select(F.col("source").alias("s"), F.col("block").alias("b"), "ahead", "whole", "cut", "leaves"), "blocks")
    joined = dealt.join(table, dealt.source.eqNullSafe(table.s) & (dealt.block == table.b))
    inside = Window.partitionBy("source", "block").orderBy("row_key", "nth")
    placed = joined.withColumn("upto", F.col("ahead") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    in_ = F.col("whole") | (F.col("cut") & (F.col("upto") <= F.col("more")))
    # What the cut leaves open goes to the one document of its block that fits best.
    gap = F.max(F.when(F.col("cut") & in_, F.col("upto")).otherwise(F.col("ahead"))).over(Window.partitionBy("source", "block"))
    placed = placed.withColumns({"in": in_, "open": F.col("more") - gap})
    off = F.abs(F.col("open") - F.col("size"))
    best = F.when(F.col("cut") & ~F.col("in") & (off < F.col("open")), F.struct(off.alias("off"), "row_key", "nth"))
    placed = placed.withColumn("best", F.min(best).over(Window.partitionBy("source", "block")))
    chosen = F.coalesce((F.col("best.row_key") == F.col("row_key")) & (F.col("best.nth") == F.col("nth")) & ~F.col("in"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("in") | chosen).cast("long")).otherwise(F.col("passes"))
    leaves = F.slice(F.transform("leaves", lambda x: x["shard"]), 1, F.col("copies").cast("int"))
    done = placed.withColumn("copies", copies).withColumn("shards", F.coalesce(leaves, F.array().cast("array<int>")))
    done = keep(done.select("row_key", "nth", "ident", "source", "size", "source_size", "target", "copies", "shards"), "taken")
    for kept in (rows, upto, tree, table):
        drop(kept)
    at = shuffled(done.select("row_key", "nth", F.posexplode("shards").alias("copy", "shard")), seed)
    at = at.groupBy("row_key", "nth").agg(F.array_sort(F.collect_list(F.struct("copy", "place"))).alias("at")).withColumnsRenamed({"row_key": "k", "nth": "t"})  # `most` copies
    out = done.join(at, (F.col("row_key") == F.col("k")) & (F.col("nth") == F.col("t")), "left")
    places = F.coalesce(F.transform("at", lambda x: x["place"]), F.array().cast("array<long>"))
    return out.select("row_key", "nth", F.col("ident").alias(ident), F.col("source").alias(source), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "shards", places.alias("places"))


def shuffled(copies: DataFrame, seed: int, cell: int = 50_000) -> DataFrame:
    """Rows (row_key, nth, copy, shard) with place: each shard in an order of its own by
    hash, counted from 0. A shard is sorted in cells of about `cell` rows, stretches of
    the hashes, and running counts over the cells give exact places."""
    order = F.xxhash64(F.lit(seed), F.lit("order"), "shard", "row_key", "nth", "copy")
    copies = copies.withColumn("order", order)
    sizes = copies.groupBy("shard").agg(F.greatest(F.lit(1.0), F.ceil(F.count("*") / cell)).cast("double").alias("cells"))  # a row for each shard
    # The upper bits of the order, as a share of all orders.
    share = (F.shiftrightunsigned("order", 12)).cast("double") / float(1 << 52)
    cells = keep(copies.join(F.broadcast(sizes), "shard").withColumn("cell", F.floor(share * F.col("cells"))).drop("cells"), "cells")
    counts = cells.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("order", "row_key", "nth", "copy")) - 1
    return cells.join(ahead, ["shard", "cell"]).select("row_key", "nth", "copy", "shard", (F.col("ahead") + nth).cast("long").alias("place"))


def _few(plan: DataFrame, most: int = 10_000) -> bool:
    """Whether the sources are few enough to broadcast."""
    return plan.limit(most + 1).count() <= most


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, block, copy, shard): every copy of a block, dealt to a shard.

    A node holds shards [lo, hi) and some copies. Of n copies, round(n * half / all)
    go to its left half: those that come first in the node's own random order.
    """
    copies = quotas.where("quota > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("copy"))
    nodes = copies.withColumns({"lo": F.lit(0), "hi": F.lit(shards)})
    for level in range(max(0, (shards - 1).bit_length())):
        node = Window.partitionBy("lo", "hi")
        order = node.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "source", "block", "copy"), "source", "block", "copy")
        mid = (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)).cast("int")
        left = F.round(F.count("*").over(node) * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        nodes = nodes.withColumns({"mid": mid, "left": F.row_number().over(order) <= left})
        split = F.col("hi") - F.col("lo") > 1
        nodes = nodes.select("source", "block", "copy", F.when(split & ~F.col("left"), F.col("mid")).otherwise(F.col("lo")).alias("lo"), F.when(split & F.col("left"), F.col("mid")).otherwise(F.col("hi")).alias("hi"))
    return nodes.select("source", "block", F.col("copy").cast("int").alias("copy"), F.col("lo").alias("shard"))


def emit(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1, **how) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, with the
    columns of `docs`, `mix_shard` and `mix_place` (which replace any of those names):
    the shard and the place in its shuffled order, gapless from 0.

    Null texts and empty ones have no words and are taken as often as whole passes
    over their source say. Repeated rows are taken one by one. An empty table gives
    no rows.
    """
    docs = docs.drop("mix_shard", "mix_place")
    whole = columns_of(docs)
    others = [c for c, name in zip(whole, docs.columns) if name not in (ident, source, text)]
    more = row_key(seed, *[c.cast("string") for c in others]) if others else F.lit(0)
    plan = mix(docs, ident, source, text, seed=seed, more=more, **how)
    each = plan.select("row_key", F.explode(F.arrays_zip("shards", "places")).alias("at"))
    # One row of each kind, as a struct, so that no name of its columns meets those used
    # here; the copies of a kind are many rows of the other side, which the adaptive rule splits.
    key = row_key(seed, F.col(ident), F.col(source), F.col(text), more)
    kinds = docs.select(key.alias("row_key"), F.struct(*whole).alias("row")).groupBy("row_key").agg(F.first("row").alias("row"))
    return each.join(kinds, "row_key").select("row.*", F.col("at.shards").alias("mix_shard"), F.col("at.places").alias("mix_place"))
