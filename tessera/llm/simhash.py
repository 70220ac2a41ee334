"""SimHash near-duplicates by the generalised pigeonhole.

Fingerprints of 64 bits link at a Hamming distance of at most `distance`. Bits are
grouped into partitions (correlated ones together); each partition i has its own
threshold t_i >= -1 with sum(t_i + 1) = distance + 1, so two fingerprints within the
distance agree to within t_i in some partition. Dynamic programming picks the t_i
by estimated candidate counts and probes; candidates are then verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, block_pairs, by_group
from .graph import components
from .store import drop, keep, lookup, slices

BITS = 64
#: Shingles hashed at a time, which bounds the memory a very long text takes.
AT_ONCE = 1 << 16
#: Costs in the plan: a row sent to a bucket, and a pair of rows compared there.
ROW_COST, PAIR_COST = 1.0, 0.01


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    last = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1 :] - 1
    ones, total = np.zeros(BITS, dtype=np.int64), last
    for at in range(0, last, AT_ONCE):
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[at : min(at + AT_ONCE, last)].tolist(), stops[at : at + AT_ONCE].tolist())]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 rows fit in a byte
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(ident, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[ident].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[ident, "fp"])

    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {kind.simpleString()}, fp long")


# -- the plan -----------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(x.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.float64)
            n += len(x)
        i, j = np.meshgrid(range(BITS), range(BITS), indexing="ij")
        cols = [np.append(i.ravel(), -1), np.append(j.ravel(), -1), np.append(total.ravel(), n)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2])], names=["i", "j", "n"])

    sums = fps.select("fp").mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
    gram, n = np.zeros((BITS, BITS)), 0
    for i, j, v in sums.collect():  # 4097 rows
        if i < 0:
            n = int(v)
        else:
            gram[i, j] = v
    return n, gram


def group_bits(n: int, gram: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near-equal width, correlated bits together: each bit,
    the most correlated first, joins the open group it is most correlated with."""
    p = np.diag(gram) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((gram / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    groups: list[list[int]] = [[] for _ in range(parts)]
    room = np.array([len(gram) // parts + (k < len(gram) % parts) for k in range(parts)])
    sums, size = np.zeros((len(gram), parts)), np.zeros(parts, dtype=np.int64)
    for bit in np.argsort(-corr.max(axis=1), kind="stable").tolist():
        mean = np.where(size > 0, sums[bit] / np.maximum(size, 1), 0.05)
        best = int(np.argmax(np.where(size < room, mean, -1.0)))
        groups[best].append(bit)
        size[best] += 1
        sums[:, best] += corr[:, bit]
    return [sorted(g) for g in groups]


def within(probs: list[float], most: int) -> list[float]:
    """P(at most t of independent events happen) for t = 0..most."""
    pmf = np.zeros(most + 1)
    pmf[0] = 1
    for q in probs:
        pmf[1:] = pmf[1:] * (1 - q) + pmf[:-1] * q
        pmf[0] *= 1 - q
    return np.cumsum(pmf).tolist()


def probes(width: int, t: int) -> int:
    return sum(comb(width, j) for j in range(t + 1))


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 of least cost;
    costs[i][t] is that of threshold t, and -1 costs nothing."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, distance - used + 1):
                to = (c + (cost[t] if t >= 0 else 0.0), [*ts, t])
                if used + t + 1 not in step or to[0] < step[used + t + 1][0]:
                    step[used + t + 1] = to
        best = step
    return best[distance + 1]


def plan(n: int, gram: np.ndarray, distance: int, joined: dict[int, float] | None = None, parts: list[list[int]] | None = None) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds. `joined` has measured pairs that agree on all of
    a partition of `parts`; without it they come from the bits' frequencies."""
    n = max(n, 2)
    p = np.diag(gram) / n
    options = []
    for m in [len(parts)] if parts else range(2, distance + 3):
        groups = parts or group_bits(n, gram, m)
        costs = []
        for k, g in enumerate(groups):
            near = within([2 * p[b] * (1 - p[b]) for b in g], distance)
            pairs = joined[k] / max(near[0], 1e-300) if joined else n * (n - 1) / 2
            # Rows are both stored and looked up under all probes, so V probes make V times the pairs that the threshold asks for.
            costs.append([ROW_COST * n * (v := probes(len(g), t)) + PAIR_COST * pairs * near[t] * v for t in range(distance + 1)])
        options.append((*allocate(costs, distance), groups))
    _, ts, groups = min(options, key=lambda x: x[0])
    return groups, ts


def mask_of(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], dtype=np.uint64).view(np.int64)[0])


def link(fps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all those within
    `distance`, verified; of the links found in one batch, a spanning forest."""
    n, gram = bit_statistics(fps)
    groups, _ = plan(n, gram, distance)
    counted = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(g))).alias("key")) for k, g in enumerate(groups)])).alias("x"))
    sizes = counted.groupBy("x.part", "x.key").agg(F.count("*").alias("c")).groupBy("part").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))
    joined = {r["part"]: float(r["pairs"]) for r in sizes.collect()}  # a row for each partition
    groups, ts = plan(n, gram, distance, {k: joined.get(k, 0.0) for k in range(len(groups))}, groups)
    options = []
    for k, (g, t) in enumerate(zip(groups, ts)):
        if t < 0:
            continue
        flips = [mask_of(list(c)) for j in range(t + 1) for c in combinations(g, j)]
        options.append(_probed(k, F.col("fp").bitwiseAND(F.lit(mask_of(g))), flips))
    rows = fps.select("fp", F.explode(F.concat(*options)).alias("x")).select("fp", "x.part", "x.key")
    dealt = block_pairs(rows, ["part", "key"], "fp", block)
    return dealt.select("part", "key", "lo", "hi", "fp").mapInArrow(by_group(["part", "key", "lo", "hi"], lambda cols, starts: _verify(cols["fp"].astype(np.int64), starts, distance)), "a long, b long").distinct()


def _probed(part: int, own: F.Column, flips: list[int]) -> F.Column:
    """The (part, key) that a fingerprint is kept and looked up under."""
    return F.transform(F.array(*map(F.lit, flips)), lambda m: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(m).alias("key")))


def _verify(fp: np.ndarray, starts: np.ndarray, distance: int) -> pa.RecordBatch | None:
    """A spanning forest of the pairs within `distance` in each group."""
    sizes = np.diff(starts)
    end_of = np.repeat(starts[1:], sizes)
    place, x = np.arange(len(fp)), fp.view(np.uint64)
    parent: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = p = parent[p]
            v = p
        return v

    small = np.repeat(sizes <= 64, sizes)
    for lag in range(1, min(64, int(sizes.max()))):
        at = place[small & (place + lag < end_of)]
        if not len(at):
            break
        hit = at[np.bitwise_count(x[at] ^ x[at + lag]) <= distance]
        for u, v in zip(fp[hit].tolist(), fp[hit + lag].tolist()):
            if (a := root(u)) != (b := root(v)):
                parent[a] = b
                out.append((u, v))
    for s, e in zip(starts[:-1][sizes > 64].tolist(), starts[1:][sizes > 64].tolist()):
        rest = np.unique(x[s:e])
        while len(rest):
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):  # breadth first: each is compared with those not yet reached
                found = np.zeros(len(rest), dtype=bool)
                from_ = np.zeros(len(rest), dtype=np.uint64)
                for f in range(0, len(front), 64):
                    near = np.bitwise_count(front[f : f + 64, None] ^ rest[None, :]) <= distance
                    new = near.any(axis=0) & ~found
                    from_[new] = front[f + near[:, new].argmax(axis=0)]
                    found |= new
                out += zip(from_[found].view(np.int64).tolist(), rest[found].view(np.int64).tolist())
                front, rest = rest[found], rest[~found]
    if not out:
        return None
    a, b = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(ident, fingerprint, component_id) of every row.

    component_id is the smallest ident reachable over links, itself included. Null
    texts count as empty; texts without words have fingerprint zero and link like
    any other. Repeated rows each give a row. A null ident is never a component_id:
    such rows bear that of their links, or null. An empty table gives no rows;
    further columns are ignored.
    """
    fps = keep(fingerprints(docs, ident, text, width), "fingerprints")
    own = keep(fps.groupBy("fp").agg(F.min(ident).alias("first")), "distinct")
    roots = components(link(own, distance), "a", "b")
    labelled = own.join(roots, own.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labelled = keep(labelled, "roots")
    firsts = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = keep(lookup(labelled, firsts, "root", "inner").select("fp", "component_id"), "labels")
    drop(own)
    drop(labelled)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return lookup(fps, labels, "fp", "inner").select(ident, shown.alias("fingerprint"), "component_id")
