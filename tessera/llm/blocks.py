"""Pairs within buckets, with large buckets cut into pairs of bounded blocks.

Every two rows of a bucket meet in at least one block pair, whatever the size of
the bucket, and no task holds more than two blocks of it at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one block; two of them are in memory together.
BLOCK = 2048


def block_pairs(rows: DataFrame, keys: list[str], ident: str, block: int = BLOCK) -> DataFrame:
    """`rows` with block numbers (lo, hi) and side (0: of lo, 1: of hi), sorted by
    bucket within partitions. Buckets of up to `block` rows have one block pair
    (0, 0); n blocks have n (n + 1) / 2, and each row goes to n of them. `ident`
    deals rows to blocks by hash."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("bucket_n")).where(F.col("bucket_n") > block)
    sizes = sizes.select(*keys, F.ceil(F.col("bucket_n") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(ident), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    dealt = dealt.withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other", "blocks")
    spread = dealt.repartition(*keys, "lo", "hi")
    return spread.sortWithinPartitions(*keys, "lo", "hi")


def by_group(keys: list[str], work: Callable[[dict[str, np.ndarray], np.ndarray], pa.RecordBatch | None]):
    """A function for mapInArrow over rows sorted by `keys`: calls `work` with whole
    groups only, as columns and the starts of the groups (and the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(k)[batch.num_rows - 1] for k in keys]
            first = [held[0].column(k)[0] for k in keys]
            if last == first and sum(b.num_rows for b in held) < 1_000_000:
                continue  # the group goes on
            cols = columns(held)
            starts = starts_of(cols, keys)
            cut = starts[-2]  # the last group may go on
            if cut:
                out = work({k: v[:cut] for k, v in cols.items()}, starts[:-1])
                if out is not None and out.num_rows:
                    yield out
            table = pa.Table.from_batches(held).slice(int(cut)).combine_chunks()
            held = table.to_batches()
        if held:
            cols = columns(held)
            out = work(cols, starts_of(cols, keys))
            if out is not None and out.num_rows:
                yield out

    return run


def columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    out = {}
    for name in table.column_names:
        col = table.column(name).combine_chunks()
        if pa.types.is_list(col.type):
            flat = col.flatten().to_numpy(zero_copy_only=False)
            out[name] = flat.reshape(len(col), -1)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def starts_of(cols: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    n = len(cols[keys[0]])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= cols[k][1:] != cols[k][:-1]
    return np.append(np.flatnonzero(new), n)
