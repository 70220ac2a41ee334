"""SimHash near-duplicates at a Jaccard similarity of word shingles.

At a similarity of 0.8 some 15 of 100 fingerprint bits differ, too many for thresholds
that add up to a distance: their buckets would hold nearly all pairs. So fingerprints
are wide, and the generalised pigeonhole works to a recall instead: correlated bits are
grouped into partitions, and dynamic programming gives each its own threshold, or
none, so that estimated candidates cost least while a pair at the similarity agrees
within the threshold in some partition with probability `RECALL`. Large tables need
more and wider partitions than one grouping has bits for; then further groupings of
the same bits add them, so buckets stay small at every size. Candidates that the
fingerprints confirm form groups, and whole shingle sets decide within these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations
from math import acos, ceil, exp, lgamma, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, by_group
from .graph import components
from .simhash import AT_ONCE, PAIR_COST, ROW_COST, group_bits, probes, within
from .store import columns_of, drop, keep, lookup, slices

WIDTH, LEAST = 5, 0.8
#: Bits of a fingerprint, and those of them that confirm a candidate.
BITS, CONFIRM = 512, 256
#: Of pairs at the similarity, the share that shares a bucket, and the standard errors
#: by which their distance may exceed what is expected.
RECALL, ERRORS = 0.996, 3.5
#: Bits may differ this much more often in sets of few shingles.
MARGIN = 1.06
#: Numbers of partitions and thresholds tried, and steps of the recall in the program.
PARTITIONS, THRESHOLDS, STEPS = (6, 8, 12, 14, 16, 18, 20, 22, 24, 28, 32, 36, 40, 44, 48, 56, 64), (0, 1), 200
#: Numbers of groupings tried, factors on what the program is asked for, as groupings
#: share their bits, and partitions that each draw of several groupings fills.
GROUPINGS, FACTORS, DEALT = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256), (1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0), 4
#: Bits of a bucket's key that hold those of its partition.
KEY_BITS = 48
#: Rows of one block; two of them, with their shingles, are in memory together.
BLOCK = 1024
#: What turns one hash into each word of a fingerprint.
SALTS = np.array([xxhash.xxh64_intdigest(f"word {k}") for k in range(BITS // 64)], dtype=np.uint64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words is one
    shingle, one without words has none. Words are as in `simhash.fingerprint`."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - width + 1)].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, stops)], dtype=np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bits of a set of hashes as words: 1 where over half of them have a 1."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE // 8):
        x = (hashes[at : at + AT_ONCE // 8, None] ^ SALTS) * MIX_1
        x ^= x >> np.uint64(32)
        x *= MIX_2
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 rows fit in a byte
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        words = np.stack([fingerprint(shingles(t)) for t in b.column(1).to_pylist()]).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(words)], names=["node", "words"])


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [shingles(t).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])


# -- the plan -----------------------------------------------------------------


def bit_statistics(signed: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set, over all of them. Each
    task sums its own; rows of the table are then summed by number."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in slices(batches, 4096):
            bits = _unpacked(_matrix(b.column(0))).astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS, dtype=np.int32)), _lists(total)], names=["i", "n"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table([table.column("i")[:1], _lists(_matrix(table.column("n").combine_chunks()).sum(axis=0)[None, :])], names=["i", "n"])

    rows = signed.select("words").mapInArrow(own, "i int, n array<double>").groupBy("i").applyInArrow(add, "i int, n array<double>")
    gram = np.zeros((BITS, BITS))
    for r in rows.collect():  # a row for each bit
        gram[r["i"]] = r["n"]
    return signed.count(), gram


def expected(least: float) -> float:
    """Share of the bits that differ between two sets of one size at a similarity."""
    return MARGIN * acos(min(1.0, 2 * least / (1 + least))) / pi


def allocate(costs: list[list[float]], gains: list[list[float]], need: float) -> tuple[float, list[int]]:
    """Thresholds (-1: none) of least cost whose gains add up to `need`; costs[i][t] and
    gains[i][t] are those of threshold t. Gains count in whole steps, rounded down."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost, gain in zip(costs, gains):
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for had, (c, ts) in best.items():
            for t in range(-1, len(cost)):
                to = min(STEPS, had + (int(gain[t] / need * STEPS) if t >= 0 else 0))
                new = c + (cost[t] if t >= 0 else 0.0)
                if to not in step or new < step[to][0]:
                    step[to] = (new, (*ts, t))
        best = step
    return (best[STEPS][0], list(best[STEPS][1])) if STEPS in best else (float("inf"), [])


@lru_cache(maxsize=100_000)
def agreement(width: int, q: float) -> tuple[float, ...]:
    """P(at most t of `width` bits differ) at each threshold, if each does with q."""
    return tuple(within([q] * width, max(THRESHOLDS)))


def recall(widths: list[int], ts: list[int], groupings: int, q: float) -> float:
    """Share of the pairs that share a bucket, if each bit differs with q. All groupings
    see the same bits, so it is that of each distance over all of them, weighed by how
    many pairs have it."""
    used = Counter((w, t) for w, t in zip(widths, ts) if t >= 0)
    total = 0.0
    for d in range(1, BITS):
        share = exp(lgamma(BITS + 1) - lgamma(d + 1) - lgamma(BITS - d + 1) + d * log(q) + (BITS - d) * log(1 - q))
        if share > 1e-7:
            missed = sum(k * log(max(1 - agreement(w, d / BITS)[t], 1e-300)) for (w, t), k in used.items())
            total += share * (1 - exp(groupings * missed))
    return total


def grouping(n: int, gram: np.ndarray, parts: int, number: int) -> list[list[int]]:
    """One of several groupings. Its number deals the bits to draws of a few partitions
    each, so that groupings differ; correlated bits are grouped within a draw."""
    bits = np.random.default_rng(number).permutation(len(gram))
    widths = [len(gram) // parts + (k < len(gram) % parts) for k in range(parts)]
    out: list[list[int]] = []
    at = 0
    for k in range(0, parts, DEALT):
        draw = bits[at : at + sum(widths[k : k + DEALT])]
        out += [draw[g].tolist() for g in group_bits(n, gram[np.ix_(draw, draw)], len(widths[k : k + DEALT]))]
        at += len(draw)
    return out


def plan(n: int, gram: np.ndarray, least: float) -> tuple[list[list[int]], list[int]]:
    """Partitions of bits and their thresholds: of one grouping, or of several that all
    have the thresholds allotted to the first of them for its part of the recall."""
    n = max(n, 2)
    p, q, need = np.diag(gram) / n, expected(least), -log(1 - RECALL)

    def estimates(groups: list[list[int]]) -> tuple[list[list[float]], list[list[float]]]:
        costs, gains = [], []
        for g in groups:
            near = within([2 * p[b] * (1 - p[b]) for b in g], max(THRESHOLDS))
            hit = agreement(len(g), q)
            v = [probes(len(g), t) for t in THRESHOLDS]
            costs.append([ROW_COST * n * v[t] + PAIR_COST * n * (n - 1) / 2 * near[t] * v[t] for t in THRESHOLDS])
            gains.append([-log(max(1 - hit[t], 1e-12)) for t in THRESHOLDS])
        return costs, gains

    cost, ts, groups, number = float("inf"), [], [], 1
    for m in PARTITIONS:
        for bits in {BITS, m * max(2, ceil(log(n, 2)))}:
            if m * 2 <= bits <= min(BITS, m * KEY_BITS):
                own = group_bits(n, gram[:bits, :bits], m)
                found = allocate(*estimates(own), need)
                if found[0] < cost:
                    (cost, ts), groups, number = found, own, 1
    for m in PARTITIONS:
        if BITS > m * KEY_BITS:
            continue
        own = grouping(n, gram, m, 0)
        of, widths = estimates(own), [len(g) for g in own]
        for k in GROUPINGS:
            for factor in FACTORS:
                found = allocate(*of, need * factor / k)
                if found[0] * k >= cost:
                    break
                if recall(widths, found[1], k, q) >= RECALL:
                    cost, ts, groups, number = found[0] * k, found[1], own, k
                    break
    if number > 1:
        groups = [g for k in range(number) for g in grouping(n, gram, len(ts), k)]
    return groups, ts * number


def _keys(groups: list[list[int]], ts: list[int]):
    """A function for mapInArrow that gives each fingerprint its buckets: for each
    partition, its bits there, with up to its threshold of them flipped."""
    used = [(k, np.array(g), [sum(1 << b for b in c) for j in range(t + 1) for c in combinations(range(len(g)), j)]) for k, (g, t) in enumerate(zip(groups, ts)) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            words = _matrix(b.column(1))
            bits = _unpacked(words).astype(np.int64)
            cols = []
            for k, g, flips in used:
                own = bits[:, g] @ (np.int64(1) << np.arange(len(g), dtype=np.int64))
                cols += [np.int64(k) << KEY_BITS | own ^ f for f in flips]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(words[:, : CONFIRM // 64]), _lists(np.stack(cols, axis=1))], names=["node", "words", "keys"])

    return run


# -- candidates and links ---------------------------------------------------------------


def _near(most: int):
    """Confirms the pairs of each bucket; of those within `most` bits, a spanning forest."""

    def work(cols: dict[str, np.ndarray], starts: np.ndarray) -> pa.RecordBatch | None:
        node, x = cols["node"], np.ascontiguousarray(cols["words"]).view(np.uint64)
        sizes = np.diff(starts)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        small = np.repeat(sizes <= 64, sizes)
        end, place = np.repeat(starts[1:], sizes), np.arange(len(node))
        for lag in range(1, min(64, int(sizes.max()))):
            at = place[small & (place + lag < end)]
            if not len(at):
                break
            hit = at[(np.bitwise_count(x[at] ^ x[at + lag]).sum(axis=1) <= most) & (node[at] != node[at + lag])]
            out.append((node[hit], node[hit + lag]))
        for s, e in zip(starts[:-1][sizes > 64].tolist(), starts[1:][sizes > 64].tolist()):
            rest = np.arange(s, e)
            while len(rest):
                front, rest = rest[:1], rest[1:]
                while len(front) and len(rest):  # breadth first: each is compared with those not yet reached
                    one, front = front[0], front[1:]
                    found = np.bitwise_count(x[rest] ^ x[one]).sum(axis=1) <= most
                    out.append((np.full(int(found.sum()), node[one]), node[rest[found]]))
                    front, rest = np.concatenate([front, rest[found]]), rest[~found]
        a, b = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in (0, 1))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        both = np.unique(np.stack([lo, hi], axis=1)[lo != hi], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].astype(np.int64)), pa.array(both[:, 1].astype(np.int64))], names=["a", "b"]) if len(both) else None

    return work


def similar(sets: list[np.ndarray], least: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the sets whose Jaccard similarity is at least `least`."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    here = np.zeros(int(codes.max(initial=-1)) + 1, dtype=bool)
    out: list[tuple[int, int]] = []
    rest = np.arange(len(sets))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):  # breadth first: each is compared with those not yet reached
            f = front.pop()
            mine = codes[cuts[f] : cuts[f + 1]]
            here[mine] = True
            near = np.flatnonzero(np.minimum(sizes[rest], len(mine)) * least.denominator >= np.maximum(sizes[rest], len(mine)) * least.numerator)
            found = np.zeros(len(rest), dtype=bool)
            for k in near.tolist():
                g = rest[k]
                both = int(np.count_nonzero(here[codes[cuts[g] : cuts[g + 1]]]))
                found[k] = both * least.denominator >= (len(mine) + int(sizes[g]) - both) * least.numerator
            here[mine] = False
            out += [(f, g) for g in rest[found].tolist()]
            front += rest[found].tolist()
            rest = rest[~found]
    return out


def _verifier(least: Fraction):
    def work(cols: dict[str, np.ndarray], starts: np.ndarray) -> pa.RecordBatch | None:
        pairs = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if e - s > 1:
                pairs += [(s + a, s + b) for a, b in similar([np.frombuffer(h, dtype=np.uint64) for h in cols["hashes"][s:e]], least)]
        if not pairs:
            return None
        a, b = np.array(pairs).T
        return pa.RecordBatch.from_arrays([pa.array(cols["node"][a]), pa.array(cols["node"][b])], names=["a", "b"])

    return work


def candidates(signed: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b): pairs of fingerprints (node, words) that share a bucket and differ in as
    few bits as sets of the similarity do; of those of one bucket, a spanning forest."""
    groups, ts = plan(*bit_statistics(signed), least)
    rows = signed.mapInArrow(_keys(groups, ts), "node long, words array<long>, keys array<long>").select("node", "words", F.explode("keys").alias("key"))
    dealt = block_pairs(rows, ["key"], "node", 2 * block).select("key", "lo", "hi", "node", "words")
    q = expected(least)
    most = ceil(q * CONFIRM + ERRORS * sqrt(CONFIRM * q * (1 - q)))
    return dealt.mapInArrow(by_group(["key", "lo", "hi"], _near(most)), "a long, b long").distinct()


def link(texts: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(a, b): links between nodes of `texts` (node, text; copies of a text have one
    node) that connect the candidates of at least `least`."""
    signed = keep(texts.select("node", "text").mapInArrow(_signed, "node long, words array<long>").dropDuplicates(["node"]), "fingerprints")
    found = keep(components(candidates(signed, least, block), "a", "b"), "candidates")
    drop(signed)
    sets = texts.join(found.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = sets.select("node", "text").mapInArrow(_whole, "node long, hashes binary")
    sets = keep(sets.join(found, "node").select("node", "root", "hashes"), "shingles")
    dealt = block_pairs(sets, ["root"], "node", block)
    work = by_group(["root", "lo", "hi"], _verifier(Fraction(str(least))))
    return dealt.select("root", "lo", "hi", "node", "hashes").mapInArrow(work, "a long, b long").distinct()


def one_of_each(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: that of the smallest
    ident reachable over links. Null texts count as empty; texts without words are
    alike. Rows of one ident and one text are one document, of which one row stays;
    rows of one ident with several texts are a document each, so no group of texts
    is left without one. Rows without an ident have no place in that order and all
    stay. An empty table stays empty."""
    own = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(ident).alias("ident"), own.alias("text"), F.xxhash64(own).alias("node"))
    roots = keep(components(link(texts, least, block), "a", "b"), "roots")
    nodes = keep(texts.groupBy("node").agg(F.min("ident").alias("first")), "nodes")
    labelled = lookup(nodes, roots, "node")
    least_of = F.min(F.struct("first", "node")).alias("m")
    chosen = labelled.where("first IS NOT NULL").groupBy(F.coalesce("root", "node").alias("root")).agg(least_of)
    at = "node of the text"
    while at in docs.columns:
        at += "_"
    chosen = chosen.select(F.col("m.first").alias(ident), F.col("m.node").alias(at))
    known = docs.withColumn(at, F.xxhash64(own)).where(F.col(ident).isNotNull())
    named = known.join(chosen, [ident, at], "left_semi").dropDuplicates([ident, at])
    return named.select(*columns_of(docs)).union(docs.where(F.col(ident).isNull()))
