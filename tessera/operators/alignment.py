"""Pairwise alignment scores with affine gaps, and distances made from them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.residues import COMPLEMENT, NUCLEOTIDES, TRIANGLE, substitution_scores

# The first residue of a gap and each further one; for proteins and for nucleotides.
PROTEIN_GAPS, NUCLEOTIDE_GAPS = (11, 1), (5, 2)
#: Nucleotides that can and that can't be the same, and masked ones.
MATCH, MISMATCH, MASKED = 2, -3, 0
#: Score where a sequence is empty.
NOTHING = -99_999_999


@lru_cache(maxsize=8)
def protein_table(triangle: str = TRIANGLE) -> tuple[dict[str, int], np.ndarray]:
    """Codes of letters, and scores by code. J reads as I, U as X."""
    scores = substitution_scores(triangle)
    letters = sorted({a for a, _ in scores})
    code = {x: i for i, x in enumerate(letters)}
    table = np.array([[scores[a, b] for b in letters] for a in letters], dtype=np.int64)
    code |= {"J": code["I"], "U": code["X"]}
    return code | {k.lower(): v for k, v in code.items()}, table


@lru_cache(maxsize=2)
def nucleotide_table(mask_n: bool = False) -> tuple[dict[str, int], np.ndarray]:
    letters = sorted(NUCLEOTIDES)
    code = {x: i for i, x in enumerate(letters)}
    same = lambda a, b: bool(set(NUCLEOTIDES[a]) & set(NUCLEOTIDES[b]))
    score = lambda a, b: MASKED if mask_n and "N" in (a, b) else MATCH if same(a, b) else MISMATCH
    return code | {k.lower(): v for k, v in code.items()}, np.array([[score(a, b) for b in letters] for a in letters], dtype=np.int64)


def encoded(sequence: str, code: dict[str, int]) -> np.ndarray:
    try:
        return np.array([code[c] for c in sequence], dtype=np.int64)
    except KeyError as x:
        raise ValueError(f"unknown letter {x}") from None


#: Numbers of one state of a batch's diagonal, so that a batch's work stays in the cache.
CELLS = 1 << 15


def align_batch(queries: list[np.ndarray], targets: list[np.ndarray], table: np.ndarray, gaps: tuple[int, int], local: bool, starts: bool) -> np.ndarray:
    """Rows (score, query start, query stop, target start, target stop) of encoded pairs,
    none empty; without `starts` the starts are -1.

    All pairs go along their anti-diagonals together, padded to the longest: what lies
    beyond a pair's end is never looked at from within. Three diagonals are kept.
    """
    opened, extended = gaps
    count = len(queries)
    ns, ms = (np.array([len(x) for x in side], dtype=np.int64) for side in (queries, targets))
    n, m = int(ns.max()), int(ms.max())
    q, t = np.zeros((count, n), np.int64), np.zeros((count, m), np.int64)
    for k in range(count):
        q[k, : ns[k]], t[k, : ms[k]] = queries[k], targets[k]
    scores, letters = table.ravel(), q * len(table)
    width, pairs = m + 1, (n + 1) * (m + 1)
    # By row i = 0..n on diagonal d: score, and the packed start cell, of three states.
    blank = lambda: [np.full((count, n + 1), x, np.int64) for x in (0, -opened, -opened)]
    edge = lambda d: np.broadcast_to(np.arange(n + 1) * (width - 1) + d, (count, n + 1))
    score_2, score_1 = blank(), blank()
    start_2, start_1 = [edge(0)] * 3, [edge(1)] * 3
    key, first = np.full(count, NOTHING * pairs), np.zeros(count, np.int64)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1) + 1
        now, above = slice(lo, hi), slice(lo - 1, hi - 1)
        score = blank()
        s = [x[:, above] for x in score_2]
        top = np.maximum(np.maximum(s[0], s[1]), s[2])
        if local:
            top = np.maximum(top, 0)
        score[0][:, now] = top + scores[letters[:, above] + t[:, d - hi : d - lo][:, ::-1]]
        if starts:
            start = [edge(d).copy() for _ in range(3)]
            at = [x[:, above] for x in start_2]
            if local:
                fresh = np.arange(lo - 1, hi - 1) * (width - 1) + d - 2
                at = [np.where(x < 0, fresh, a) for x, a in zip(s, at)]
                s = [np.maximum(x, 0) for x in s]
            start[0][:, now] = np.where(s[0] >= top, at[0], np.where(s[1] >= top, at[1], at[2]))
        for k, back in ((1, now), (2, above)):  # a gap in the query comes from the left, one in the target from above
            m_, g_ = score_1[0][:, back], score_1[k][:, back]
            insert = (np.maximum(m_, 0) if local else m_) - opened
            extend = np.where(g_ > 0, g_ - extended, -opened) if local else g_ - extended
            score[k][:, now] = np.maximum(insert, extend)
            if starts:
                start[k][:, now] = np.where(insert >= extend, start_1[0][:, back], start_1[k][:, back])
        # Of equal scores the last row counts, and in it the last column.
        i = np.arange(lo, hi)
        inside = (i <= ns[:, None]) & (d - i <= ms[:, None])
        if not local:
            inside &= (i == ns[:, None]) | (d - i == ms[:, None])
        keys = np.where(inside, score[0][:, now] * pairs + i * (width - 1) + d, NOTHING * pairs)
        best = keys.argmax(axis=1)
        found = keys[np.arange(count), best]
        better = found > key
        key[better] = found[better]
        if starts:
            first[better] = start[0][np.flatnonzero(better), lo + best[better]]
            start_2, start_1 = start_1, start
        score_2, score_1 = score_1, score
    top, place = np.divmod(key, pairs)
    begins = (first // width, first % width) if starts else (np.full(count, -1),) * 2
    return np.column_stack([top, begins[0], place // width - 1, begins[1], place % width - 1])


def align_pairs(pairs: list[tuple[str, str]], mode: str = "local", alphabet: str = "protein", mask_n: bool = False, triangle: str = TRIANGLE, starts: bool = True) -> np.ndarray:
    """The rows of `align_batch` for pairs of sequences, in their order: pairs of like
    lengths go together. `local` may start anew where a score falls below 0, `overlap`
    must start at an edge and end in the last row or column. A gap of one kind never
    follows one of the other. The longest alignment of equal ones to a place counts."""
    code, table = protein_table(triangle) if alphabet == "protein" else nucleotide_table(mask_n)
    gaps = PROTEIN_GAPS if alphabet == "protein" else NUCLEOTIDE_GAPS
    known = {s: encoded(s, code) for pair in pairs for s in pair}
    out = np.tile(np.array([NOTHING, -1, -1, -1, -1], np.int64), (len(pairs), 1))
    order = sorted((k for k, (x, y) in enumerate(pairs) if x and y), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        size = max(1, CELLS // (len(pairs[order[at]][0]) + 1))
        part = order[at : at + size]
        out[part] = align_batch([known[pairs[k][0]] for k in part], [known[pairs[k][1]] for k in part], table, gaps, mode == "local", starts)
        at += size
    return out


def align(query: str, target: str, mode: str = "local", alphabet: str = "protein", mask_n: bool = False, triangle: str = TRIANGLE) -> tuple[int, int, int, int, int]:
    """(score, query start, query stop, target start, target stop) of the best alignment of
    one pair, places counted from 0 and inclusive."""
    return tuple(int(v) for v in align_pairs([(query, target)], mode, alphabet, mask_n, triangle)[0])


def score_bound(x: np.ndarray, y: np.ndarray, table: np.ndarray) -> int:
    """What no alignment of two encoded sequences goes beyond: every letter of one meets
    one of the other's at best, and gaps only cost."""
    part = table[np.ix_(np.unique(x), np.unique(y))]
    best = lambda s, axis: int((np.unique(s, return_counts=True)[1] * np.maximum(part.max(axis=axis), 0)).sum())
    return min(best(x, 1), best(y, 0))


def self_score(sequence: Column, triangle: str = TRIANGLE) -> Column:
    """Score of a sequence with itself, without gaps; unknown letters fail."""
    scores = substitution_scores(triangle)
    diagonal = {a: v for (a, b), v in scores.items() if a == b}
    diagonal |= {"J": diagonal["I"], "U": diagonal["X"]}
    table = F.create_map(*[F.lit(v) for kv in diagonal.items() for v in kv])
    letters = F.filter(F.split(F.upper(sequence), ""), lambda c: c != "")
    known = lambda c: F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit("unknown letter "), c)).cast("int"))
    return F.aggregate(letters, F.lit(0), lambda s, c: s + known(c))


def reverse_complement(sequence: Column) -> Column:
    return F.translate(F.reverse(F.upper(sequence)), *COMPLEMENT)


RANGES = ("query_start", "query_stop", "target_start", "target_stop")


def pair_scores(pairs: DataFrame, query: str, target: str, ranges: bool = False, **how) -> DataFrame:
    """`pairs` with the alignment score of two of its columns, and with `ranges` where the
    best alignment starts and stops in both, from 0 and inclusive; null for a null.
    `how` is that of `align`: mode, alphabet, mask_n, triangle. Alignments cost the
    product of their lengths, so rows are dealt out by their number."""
    names = pairs.columns
    more = ["score", *(RANGES if ranges else ())]
    spread = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                both = list(zip(b.column(names.index(query)).to_pylist(), b.column(names.index(target)).to_pylist()))
                known = [x is not None and y is not None for x, y in both]
                found = np.zeros((len(both), 5), np.int64)
                found[known] = align_pairs([p for p, k in zip(both, known) if k], starts=ranges, **how)
                for k, name in enumerate(more):
                    b = b.append_column(name, pa.array(found[:, k], pa.int64(), mask=~np.array(known, bool)))
                yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.repartition(spread).mapInArrow(run, ", ".join([schema, *(f"{name} long" for name in more)]))


def alignment_distances(sequences: DataFrame, block: int = 64, cut: float | None = None) -> DataFrame:
    """(id_a, id_b, d) for all pairs of complexes, from (complex_id, side, sequence); with
    `cut` only those at most so far apart.

    Two chains are 1 - score / sqrt(own score of one * of the other) apart; two
    complexes half the sum over the better of the two pairings of their chains. The
    matrix is asked for as a whole; blocks of complexes meet as equi-join groups.
    With a cut, a pair whose letters alone put it beyond that is not aligned.
    """
    two = sequences.groupBy("complex_id").agg(F.max(F.when(F.col("side") == 1, F.col("sequence"))).alias("s1"), F.max(F.when(F.col("side") == 2, F.col("sequence"))).alias("s2"))
    n = max(1, -(-two.count() // block))
    rows = two.withColumn("own", F.pmod(F.xxhash64("complex_id"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.select(F.struct(F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "own", "other", F.col("complex_id").alias("id"), "s1", "s2")
    a, b = rows.alias("a"), rows.alias("b")
    apart = (F.col("a.own") != F.col("b.own")) | (F.col("a.own") == F.col("a.other"))
    pairs = a.join(b, F.col("a.pair") == F.col("b.pair")).where((F.col("a.id") < F.col("b.id")) & apart)
    pairs = pairs.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("id", "s1", "s2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table = protein_table()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from part(batch.slice(at, 256), code, table)

    def part(batch: pa.RecordBatch, code: dict[str, int], table: np.ndarray) -> Iterator[pa.RecordBatch]:
        got = batch.to_pydict()
        known = {s: encoded(s, code) for c in ("s1_a", "s2_a", "s1_b", "s2_b") for s in got[c]}
        own = {s: int(table[x, x].sum()) for s, x in known.items()}
        root = lambda x, y: float(np.sqrt(own[x] * own[y]))
        better = lambda far, p, q, r, s: 0.5 * min(far[p, r] + far[q, s], far[p, s] + far[q, r])
        rows = list(zip(got["s1_a"], got["s2_a"], got["s1_b"], got["s2_b"]))
        ways = lambda p, q, r, s: ((p, r), (q, s), (p, s), (q, r))
        every = list(range(len(rows)))
        if cut is not None:
            near = {w: 1.0 - score_bound(known[w[0]], known[w[1]], table) / root(*w) for row in rows for w in ways(*row)}
            every = [k for k in every if better(near, *rows[k]) <= cut]
        wanted = list(dict.fromkeys(w for k in every for w in ways(*rows[k])))
        far = {w: 1.0 - score / root(*w) for w, score in zip(wanted, align_pairs(wanted, starts=False)[:, 0])}
        if any(d < -1e-9 for d in far.values()):
            raise ValueError("a distance is below zero")
        far = {w: max(d, 0.0) for w, d in far.items()}
        d = np.array([better(far, *rows[k]) for k in every], dtype=np.float64)
        kept = np.flatnonzero(d <= cut) if cut is not None else np.arange(len(d))
        ids = batch.take(pa.array([every[k] for k in kept], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids.column("id_a"), ids.column("id_b"), pa.array(d[kept])], names=["id_a", "id_b", "d"])

    return pairs.mapInArrow(run, "id_a string, id_b string, d double")
