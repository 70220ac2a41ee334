"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its `near` closest pivots, in order; inverted lists hold
the vectors of each pivot. Two vectors that share at least `shared` pivots are
candidates; the cosine in double precision decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, block_pairs, by_group
from .graph import components
from .store import drop, keep, lookup, slices


#: Pivots at least and at most, sampled vectors for each, and the cosine that parts them.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLED, APART = 256, 16_384, 4, 0.7


def unit_vectors(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(vector, rep, copies): distinct valid vectors, with how many rows
    have each and the smallest ident among them. Null, empty or zero vectors and
    those with null or non-finite components are left out."""
    x = F.col(vector)
    good = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.coalesce(good, F.lit(False))).groupBy(x.alias("vector")).agg(F.min(ident).alias("rep"), F.count("*").alias("copies"))


def pivot_number(rows: int) -> int:
    """About the square root of the rows, so that lists grow no faster than that."""
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << max(0, int(np.ceil(np.log2(max(rows, 1)) / 2)))))


def near_number(pivots: int) -> int:
    """Closest pivots of a vector: more of many pivots, which part close vectors sooner."""
    return 8 + max(0, int(np.ceil(np.log2(max(pivots, 1)) / 2 - 5)))


def choose_pivots(vectors: DataFrame, number: int, apart: float = APART) -> np.ndarray:
    """Pivots from a bounded sample of the distinct vectors (`SAMPLED` times `number`,
    those of smallest hash), each with a cosine under `apart` to all before it. So a
    large group of near-copies has one pivot among them, and its members agree on
    the order of the others."""
    rows = vectors.select("vector", F.xxhash64("vector").alias("h")).orderBy("h", "vector").limit(SAMPLED * number).select("vector").toArrow()
    if not rows.num_rows:
        return np.empty((0, 0))
    # In Arrow's own memory: a bounded sample, but of long vectors.
    x = unit(rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1))
    chosen = np.empty((0, x.shape[1]))
    for at in range(0, len(x), 256):  # those free of all before the block, then one after another within it
        block = x[at : at + 256]
        block = block[(block @ chosen.T < apart).all(axis=1)]
        free = np.ones(len(block), dtype=bool)
        near = block @ block.T >= apart
        for i in range(len(block)):
            if free[i]:
                free[i + 1 :] &= ~near[i, i + 1 :]
        chosen = np.concatenate([chosen, block[free]])
        if len(chosen) >= number:
            break
    return chosen[:number]


def describe(vectors: DataFrame, pivots: np.ndarray, near: int) -> DataFrame:
    """(node, copies, vector, perm): vectors as they came, and their closest pivots in order."""
    kind = vectors.schema["vector"].dataType
    units = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    near = min(near, len(units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):  # rows x pivots in double precision are in memory at a time
            x = unit(b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            far = -(x @ units.T)
            perm = np.argpartition(far, near - 1, axis=1)[:, :near] if near < len(units) else np.tile(np.arange(near), (len(x), 1))
            perm = np.take_along_axis(perm, np.argsort(np.take_along_axis(far, perm, axis=1), axis=1), axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(perm) + 1) * perm.shape[1], pa.int32()), pa.array(perm.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), b.column("vector"), lists], names=["node", "copies", "vector", "perm"])

    return vectors.select("node", "copies", "vector").mapInArrow(run, f"node long, copies long, vector {kind.simpleString()}, perm array<int>")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against over- and underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verifier(least: float, shared: int):
    return lambda cols, starts: _verify(cols, starts, least, shared)


def _verify(cols: dict[str, np.ndarray], starts: np.ndarray, least: float, shared: int) -> pa.RecordBatch | None:
    """Links of each inverted list: per node how many rows it links with, and edges of
    a spanning forest. A pair counts in the list of the smallest pivot it shares."""
    out: list[tuple[int, int, int]] = []
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if e - s < 2:
            continue
        # Rows of one list: in a pair of blocks (lo, hi) only pairs across it are new.
        two = cols["lo"][s] != cols["hi"][s]
        left = np.arange(s, e)[cols["side"][s:e] == 0]
        right = np.arange(s, e)[cols["side"][s:e] == 1] if two else left
        if not len(right):
            continue
        x = unit(cols["vector"][left])
        y = unit(cols["vector"][right]) if two else x
        at, other = np.nonzero(np.atleast_2d(x @ y.T) >= least)
        keep_ = np.ones(len(at), dtype=bool) if two else at < other
        at, other = left[at[keep_]], right[other[keep_]]
        for k in range(0, len(at), 1 << 16):
            a, b = at[k : k + (1 << 16)], other[k : k + (1 << 16)]
            same = cols["perm"][a][:, :, None] == cols["perm"][b][:, None, :]
            both = same.any(axis=2)
            first = np.where(both, cols["perm"][a], np.iinfo(np.int32).max).min(axis=1)
            ok = (both.sum(axis=1) >= shared) & (first == cols["pivot"][s])
            out += _forest(cols["node"], cols["copies"], a[ok], b[ok])
    if not out:
        return None
    a, b, n = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])


def _forest(node: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(node, node, links): how many rows each node links with; and (node, root, 0):
    edges to the least node of its component among these links."""
    ends = np.concatenate([a, b])
    if not len(ends):
        return []
    places, where = np.unique(ends, return_inverse=True)
    sums = np.bincount(where, weights=copies[np.concatenate([b, a])])
    out = [(n, n, s) for n, s in zip(node[places].tolist(), sums.astype(np.int64).tolist())]
    ia, ib = where[: len(a)], where[len(a) :]
    label = np.arange(len(places))
    while True:
        before = label.copy()
        np.minimum.at(label, ib, before[ia])
        np.minimum.at(label, ia, before[ib])
        label = label[label]
        if (label == before).all():
            break
    return out + [(u, v, 0) for u, v in zip(node[places].tolist(), node[places[label]].tolist()) if u != v]


def near_duplicates(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", least: float = 0.9, pivots: int | None = None, near: int | None = None, shared: int = 1, block: int = BLOCK) -> DataFrame:
    """(ident, n_links, component_id, kept) of every row.

    n_links counts other rows linked directly (cosine >= `least` in double
    precision), copies included; component_id is the smallest ident reachable. Rows
    with a null, empty or zero vector or null or non-finite components link with
    nothing: n_links 0 and their own ident. Vectors of different lengths never
    meet: each length is indexed with itself. Repeated rows each count. A null
    ident takes part but is never a component_id. Further columns are ignored.
    """
    x = F.col(vector)
    distinct = unit_vectors(vectors, ident, vector)
    distinct = keep(distinct.withColumn("node", F.xxhash64("vector")), "vectors")
    parts = []
    for size in [r["n"] for r in distinct.select(F.size("vector").alias("n")).distinct().collect()]:  # lengths in the schema: few
        own = distinct.where(F.size("vector") == size)
        table = choose_pivots(own, pivots or pivot_number(own.count()))
        index = keep(describe(own, table, near or near_number(len(table))), "index")
        lists = index.select("node", "copies", "vector", "perm", F.explode("perm").alias("pivot"))
        dealt = block_pairs(lists, ["pivot"], "node", block).select("pivot", "lo", "hi", "side", "node", "copies", "vector", "perm")
        parts.append(dealt.mapInArrow(by_group(["pivot", "lo", "hi"], _verifier(least, min(shared, len(table)))), "a long, b long, links long"))
    found = parts[0] if parts else vectors.sparkSession.createDataFrame([], "a long, b long, links long")
    for p in parts[1:]:
        found = found.unionByName(p)
    found = keep(found, "found")
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> b"), "a", "b")
    nodes = distinct.select("node", "rep", "copies").join(links, "node", "left").join(roots, "node", "left")
    nodes = keep(nodes.withColumn("root", F.coalesce("root", "node")), "roots")
    firsts = nodes.groupBy("root").agg(F.min("rep").alias("first"))
    labels = lookup(nodes, firsts, "root", "inner").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "first")
    labels = keep(labels, "labels")
    drop(nodes)
    rows = keep(vectors.select(F.col(ident).alias("ident"), F.xxhash64(x).alias("node")), "rows")
    out = lookup(rows, labels, "node").select(F.col("ident").alias(ident), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n").isNull(), F.col("ident")).otherwise(F.col("first")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(ident) == F.col("component_id"), F.lit(False)))
