"""Sharding by sampled splitters: size-weighted key samples choose quantile
boundaries, records are range-partitioned by them, and overfull ranges are
subdivided by splitters of their own. DataFrame functions only.

Records lie in the order of (hash of the text, ident), so equal texts are
neighbours. Large groups of equal texts are placed first, each whole in the emptiest
shard that has room for it. The others fill the room that is left, in their order:
ranges are cut so small that exact places within each are cheap, and running sums
over the ranges give every record its exact place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, keep

#: Bytes that each record takes besides its text.
OVERHEAD = 16
#: Rows drawn for the splitters, over all records, and ranges made by them.
SAMPLE, RANGES = 20_000, 512
#: Rows that a range may hold before it is subdivided.
RANGE_ROWS = 50_000
#: Share of a shard's bytes or rows from which a group of equal texts is placed by itself.
UNIT = 0.02


def splitters(records: DataFrame, ranges: int = RANGES, sample: int = SAMPLE) -> list[int]:
    """Boundaries at quantiles of a sample of keys drawn in proportion to size.

    The draw is a bounded one and repeatable: of each record, u ** (1 / size) with
    u from a hash of its ident is the rank, and the largest `sample` are taken.
    """
    u = (F.pmod(F.xxhash64(F.lit("draw"), "ident", "key"), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52) + 2)
    drawn = records.select("key", (F.log(u) / F.col("size")).alias("rank")).orderBy(F.desc("rank"), "key").limit(sample)
    cuts = drawn.agg(F.percentile("key", F.array(*[F.lit(i / ranges) for i in range(1, ranges)])).alias("q")).first()["q"] if ranges > 1 else []
    return sorted({int(c) for c in cuts or []})


def range_of(key: Column, cuts: list[int], base: int = 0) -> Column:
    """The number of `cuts` that are not above `key`, by a binary search of conditions."""
    if not cuts:
        return F.lit(base)
    mid = len(cuts) // 2
    return F.when(key < F.lit(cuts[mid]), range_of(key, cuts[:mid], base)).otherwise(range_of(key, cuts[mid + 1 :], base + mid + 1))


def subdivided(ranged: DataFrame, range_rows: int, ranges: int) -> DataFrame:
    """`ranged` (key, range) with part: the number of splitters, drawn from the range's own
    keys, that are not above the key. Ranges of up to `range_rows` rows have none."""
    # A row for each of the `ranges` and under one for every `range_rows` records.
    counts = ranged.groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > range_rows)
    parts = F.ceil(F.col("n") / range_rows).cast("int")
    overfull = ranged.join(F.broadcast(counts.select("range", parts.alias("parts"))), "range")
    # Of each overfull range the 64 keys of least hash for each part to be made.
    order = Window.partitionBy("range", "bucket").orderBy("h", "key")
    drawn = overfull.withColumns({"h": F.xxhash64(F.lit("split"), "ident", "key")}).withColumn("bucket", F.pmod(F.col("h"), F.col("parts")))
    drawn = drawn.withColumn("nth", F.row_number().over(order)).where("nth <= 64")
    cuts = drawn.groupBy("range").agg(F.first("parts").alias("n"), F.sort_array(F.collect_list("key")).alias("keys"))
    every = F.sequence(F.lit(1), F.col("n") - 1)
    cuts = cuts.select("range", F.array_distinct(F.transform(every, lambda i: F.get(F.col("keys"), F.floor(i * F.size("keys") / F.col("n")).cast("int")))).alias("cuts"))
    return ranged.join(F.broadcast(cuts), "range", "left").withColumn("part", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("key"))), F.lit(0))).drop("cuts")


def packed(groups: DataFrame, shards: int, mean: float) -> DataFrame:
    """(loads, homes): bytes that shards hold once the large groups are placed, and
    (key, shard) of those placed, in one row. groups: (key, bytes), under
    2 * shards / UNIT of them. The largest goes first, each to the emptiest shard if
    that has room for it up to `mean`; one without room has no home and is cut."""
    ordered = groups.agg(F.sort_array(F.collect_list(F.struct("bytes", "key")), asc=False).alias("g"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<struct<key:bigint,shard:int>>").alias("homes"))

    def put(state: Column, group: Column) -> Column:
        least = F.array_min(state["loads"])
        at = F.array_position(state["loads"], least).cast("int")
        fits = (least + group["bytes"]).cast("double") <= F.lit(mean)
        loads = F.when(fits, F.transform(state["loads"], lambda v, i: F.when(i == at - 1, v + group["bytes"]).otherwise(v))).otherwise(state["loads"])
        homes = F.when(fits, F.concat(state["homes"], F.array(F.struct(group["key"].alias("key"), (at - 1).alias("shard"))))).otherwise(state["homes"])
        return F.struct(loads.alias("loads"), homes.alias("homes"))

    return ordered.select(F.aggregate("g", start, put).alias("s")).select("s.loads", "s.homes")


def shard_by_bytes(docs: DataFrame, shards: int = 40, ident: str = "doc_id", text: str = "text", ranges: int = RANGES, range_rows: int = RANGE_ROWS, unit: float = UNIT) -> DataFrame:
    """(ident, size, text_crc32, shard, slot) of every row, sizes of shards near equal.

    size is the text's UTF-8 bytes (null: none) plus 16; a null text has the CRC of
    the empty one. Equal texts share a shard, unless a group of them is so large that
    no shard has room for it up to the mean: such a group is cut between records. A
    shard's bytes differ from the mean by at most the larger of one record and, for
    the groups at its two ends, half of `unit` of a shard each. Slots count from 0
    without gaps. Rows equal in ident and text are interchangeable. No rows give no
    shards; further columns are ignored.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    records = docs.select(F.col(ident).alias("ident"), (F.octet_length(whole).cast("long") + OVERHEAD).alias("size"), F.crc32(whole).alias("text_crc32"), F.xxhash64(whole).alias("key"))
    records = keep(records, "records")
    all_ = records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    mean, rows = all_["bytes"] / shards, all_["n"] / shards
    # Under 2 * shards / unit groups hold so much of all bytes or rows.
    large = records.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > unit * mean) | (F.col("n") > unit * rows)).where("n > 1")
    large = keep(large.withColumn("pieces", F.ceil(F.col("n") / range_rows).cast("int")), "large")
    plan = keep(packed(large, shards, mean), "plan")
    loads = plan.first()["loads"]
    homes = plan.select(F.explode("homes").alias("h")).select("h.key", F.col("h.shard").alias("home"))
    known = keep(large.select("key", "pieces").join(F.broadcast(homes), "key", "left"), "known")
    ranged = records.join(F.broadcast(known), "key", "left")
    ranged = ranged.withColumn("range", range_of(F.col("key"), splitters(records.join(F.broadcast(known), "key", "left_anti"), ranges)))
    # A group of its own is a cell for itself, in pieces by ident; rows that are equal in it
    # too are any of each other, so they are counted and dealt evenly over the pieces.
    small = subdivided(ranged.where("pieces is null"), range_rows, ranges).withColumns({"group": F.lit(None).cast("long"), "piece": F.lit(0)})
    same = ranged.where("pieces is not null").groupBy("ident", "size", "text_crc32", "key", "home", "range", "pieces").agg(F.count("*").alias("same"))
    parts = same.withColumn("at", F.explode(F.sequence(F.lit(0), F.least("same", "pieces").cast("int") - 1)))
    each = F.expr("same div pieces") + (F.col("at") < F.col("same") % F.col("pieces")).cast("int")
    alone = parts.withColumns({"piece": ((F.pmod(F.xxhash64("ident"), F.col("pieces")) + F.col("at")) % F.col("pieces")).cast("int"), "each": each.cast("int")})
    alone = alone.withColumns({"part": F.lit(0), "group": F.col("key"), "nth": F.explode(F.sequence(F.lit(1), F.col("each")))})
    cell = ["range", "part", "group", "piece"]
    names = ["ident", "size", "text_crc32", "key", "home", *cell]
    cut = keep(small.select(*names).unionByName(alone.select(*names)), "ranges")
    drop(records)
    # Places among the bytes that fill the room left, in order of cells and within them.
    sums = cut.where("home is null").groupBy(*cell).agg(F.sum("size").alias("bytes"))
    before = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    ahead = sums.select(*cell, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("ahead"))
    free = _joined(cut.where("home is null"), ahead, cell)
    inside = Window.partitionBy(*cell).orderBy("key", "ident", "size").rowsBetween(Window.unboundedPreceding, 0)
    free = free.withColumn("first", F.col("ahead") + F.sum("size").over(inside) - F.col("size"))
    together = Window.partitionBy(*cell, "key")
    free = free.withColumns({"group_first": F.min("first").over(together), "group_bytes": F.sum("size").over(together)})
    # By the middle of the record, or of a small group as a whole.
    middle = F.when(F.col("group").isNull(), F.col("group_first") + F.col("group_bytes") / 2).otherwise(F.col("first") + F.col("size") / 2)
    edges, upto = [], 0.0
    for load in loads[:-1]:
        upto += max(0.0, mean - load)
        edges.append(upto)
    shard = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= middle)) if edges else F.lit(0)
    found = free.withColumn("shard", shard).select("ident", "size", "text_crc32", "key", *cell, "shard").unionByName(cut.where("home is not null").select("ident", "size", "text_crc32", "key", *cell, F.col("home").alias("shard")))
    found = keep(found, "placed")
    drop(cut)
    # Slots: rows of the shard in cells before, and place within the cell.
    counts = found.groupBy("shard", *cell).agg(F.count("*").alias("n"))
    slot_before = Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.select("shard", *cell, F.coalesce(F.sum("n").over(slot_before), F.lit(0)).alias("rows_ahead"))
    nth = F.row_number().over(Window.partitionBy("shard", *cell).orderBy("key", "ident", "size")) - 1
    return _joined(found, slots, ["shard", *cell]).select(F.col("ident").alias(ident), "size", "text_crc32", "shard", (F.col("rows_ahead") + nth).cast("long").alias("slot"))


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """An equi-join in which nulls are equal. A cell holds few rows, so no key is hot."""
    same = [table[k].alias(f"on_{k}") for k in keys]
    other = table.select(*same, *[c for c in table.columns if c not in keys])
    on = None
    for k in keys:
        this = rows[k].eqNullSafe(other[f"on_{k}"])
        on = this if on is None else on & this
    return rows.join(other, on).drop(*[f"on_{k}" for k in keys])
