"""Feature extraction: composition, and sums and histograms over near pairs."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.residues import LETTERS, UNKNOWN
from ..functions.text import uniform
from ..store import keep
from .running import running
from .spatial import by_types, cross_pairs, nearest, pairs_within


def composition(residues: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(complex, n_<type>...): residues by type over both sides, unknown ones too."""
    types = types or [*LETTERS, UNKNOWN]
    return residues.groupBy("complex").agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types])


def adjacent_pairs(residues: DataFrame, order: list[str]) -> DataFrame:
    """(complex, first, second, n): types of neighbours in `order`, across sides too."""
    w = Window.partitionBy("complex").orderBy(*order)
    pairs = residues.select("complex", F.lag("type").over(w).alias("first"), F.col("type").alias("second"))
    return pairs.where("first is not null").groupBy("complex", "first", "second").agg(F.count("*").alias("n"))


def linear_bin(d: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a distance in (low, high]: half open from below; null outside."""
    width = (high - low) / bins
    return F.when((d > low) & (d <= high), F.least(F.ceil((d - low) / width) - 1, F.lit(bins - 1)).cast("int"))


def edge_bin(d: Column, edges: list[float]) -> Column:
    """Bin (edge_i, edge_i+1] of a distance by any rising edges; null outside."""
    below = [F.when(d > e, 1).otherwise(0) for e in edges[1:-1]]
    return F.when((d > edges[0]) & (d <= edges[-1]), sum(below, F.lit(0)))


def geometric_edges(low: float, high: float, bins: int, ratio: float = 1.5) -> list[float]:
    """Edges whose steps grow by `ratio`."""
    first = (high - low) * (ratio - 1) / (ratio**bins - 1)
    return [*(low + first * (ratio**k - 1) / (ratio - 1) for k in range(bins)), high]


def log_edges(low: float, high: float, bins: int) -> list[float]:
    step = (log(high) - log(low)) / bins
    return [*(low * 2.718281828459045 ** (k * step) for k in range(bins)), high]


def distance_histogram(points: DataFrame, low: float, high: float, bins: int, edges: list[float] | None = None) -> DataFrame:
    """(complex, type_a, type_b, bin, n): pairs across the sides, by types and distance.

    Bins are (edge, next edge]; pairs at `low` or nearer, or beyond `high`, drop out.
    """
    at = edge_bin(F.col("d"), edges) if edges else linear_bin(F.col("d"), low, high, bins)
    counted = cross_pairs(points, high).withColumn("bin", at).where("bin is not null")
    return by_types(counted, ["complex", "bin"], ("n", F.count("*")))


def minimum_distance_histogram(points: DataFrame, low: float, high: float, bins: int, key: str = "serial") -> DataFrame:
    """(complex, type, bin, n): atoms by type and by the distance to the nearest atom of
    the other side. Bins are (edge, next edge]; nearer ones count in the first, and
    atoms with none up to `high` in the last."""
    other = points.withColumn("side", 3 - F.col("side"))
    near = nearest(points, other, high, ["complex", "side"], [key])
    at = F.coalesce(F.greatest(linear_bin(F.greatest(F.col("d"), F.lit(low)), low, high, bins), F.when(F.col("d") <= low, 0)), F.lit(bins - 1))
    both = points.select("complex", "side", key, "type").join(near, ["complex", "side", key], "left")
    return both.groupBy("complex", "type", at.alias("bin")).agg(F.count("*").alias("n"))


def self_histogram_features(histogram: DataFrame, types: list[str], bins: int) -> DataFrame:
    """(complex, features): counts in the order of type pairs and bins, zeros included."""
    known = sorted(types)
    rank = F.create_map(*[x for i, t in enumerate(known) for x in (F.lit(t), F.lit(i))])
    first, second = F.try_element_at(rank, F.col("type_a")), F.try_element_at(rank, F.col("type_b"))
    before = first * len(known) - (first * (first - 1) / 2).cast("int")  # pairs that begin with an earlier type
    code = F.when((first <= second) & F.col("bin").between(0, bins - 1), (before + second - first) * bins + F.col("bin"))
    return dense(sparse(histogram.select("complex", code.alias("code"), F.col("n").alias("value"))), len(known) * (len(known) + 1) // 2 * bins)


def adjacency(points: DataFrame, self_reach: float, other_reach: float, most_self: int, most_other: int, key: str = "serial") -> DataFrame:
    """(type, self_n, other_n, n): atoms by type, by neighbours of their own side and of
    the other one. Atoms without a neighbour of their own are left out; the number of
    their own counts from zero; both are clamped to most - 1."""
    near = pairs_within(points, points, max(self_reach, other_reach), ["complex"])
    own = (F.col("a_side") == F.col("b_side")) & (F.col("d") <= self_reach) & (F.col(f"a_{key}") != F.col(f"b_{key}"))
    other = (F.col("a_side") != F.col("b_side")) & (F.col("d") <= other_reach)
    # The type goes with the key, as sums by it need no order; pairs that count nowhere do not.
    each = near.where(own | other).groupBy("complex", "a_side", F.col(f"a_{key}").alias(key), F.col("a_type").alias("type")).agg(F.count_if(own).alias("own"), F.count_if(other).alias("other")).where("own > 0")
    return each.groupBy("complex", "type", F.least(F.col("own") - 1, F.lit(most_self - 1)).alias("self_n"), F.least("other", F.lit(most_other - 1)).alias("other_n")).agg(F.count("*").alias("n"))


def distance_sums(points: DataFrame, reach: float) -> DataFrame:
    """(complex, type_a, type_b, inverse, inverse_square), pairs at distance 0 left out."""
    near = cross_pairs(points, reach).where("d > 0")
    return by_types(near, ["complex"], ("inverse", F.sum(1 / F.col("d"))), ("inverse_square", F.sum(1 / (F.col("d") * F.col("d")))))


def power_sums(points: DataFrame, reach: float, powers: tuple[int, ...] = (-2, -1, 0, 1)) -> DataFrame:
    """(complex, type_a, type_b, sum_<k>...): sums of powers of the distances above 0."""
    near = cross_pairs(points, reach).where("d > 0")
    return by_types(near, ["complex"], *[(f"sum_{k}", F.sum(_power(F.col("d"), p))) for k, p in enumerate(powers)])


def _power(d: Column, p: int) -> Column:
    """Small powers by products, which cost a fraction of a general power."""
    one = F.lit(1.0)
    for _ in range(abs(p)):
        one = one * d
    return 1 / one if p < 0 else one


def contact_weights(points: DataFrame, scale: float, reach: float) -> DataFrame:
    """(complex, type_a, type_b, weight): sums of exp(-d / scale)."""
    return by_types(cross_pairs(points, reach), ["complex"], ("weight", F.sum(F.exp(-F.col("d") / scale))))


def residue_contacts(points: DataFrame, reach: float, residue: str = "res_no") -> DataFrame:
    """(complex, type_a, type_b, n): pairs of residues with any atoms within `reach`."""
    near = cross_pairs(points, reach).select("complex", F.col(f"a_{residue}").alias("ra"), F.col(f"b_{residue}").alias("rb"), F.least("a_type", "b_type").alias("type_a"), F.greatest("a_type", "b_type").alias("type_b"))
    return near.distinct().groupBy("complex", "type_a", "type_b").agg(F.count("*").alias("n"))


def hydrogen_triples(points: DataFrame, own_reach: float = 3.0, other_reach: float = 5.0) -> DataFrame:
    """(complex, d, h, a, donor_type, acceptor_type): each hydrogen with the nearest other
    atom of its side (of equally near ones, the smallest serial), and every other atom
    of the other side near it."""
    heavy = points.where(~F.startswith("type", F.lit("H")))
    own = pairs_within(points.where(F.startswith("type", F.lit("H"))), heavy, own_reach, ["complex", "side"]).where("d > 0")
    xyz = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in "xyz"])
    donor = own.groupBy("complex", "side", "a_serial").agg(F.min(F.struct("d", "b_serial", xyz("b").alias("at"), "b_type")).alias("m"), F.first(xyz("a")).alias("h"))
    hydrogens = donor.select("complex", (3 - F.col("side")).alias("side"), "h.*", F.col("m.at").alias("donor"), F.col("m.b_type").alias("donor_type"))
    triples = pairs_within(hydrogens, heavy, other_reach, ["complex", "side"]).where("d > 0")
    return triples.select("complex", F.col("a_donor").alias("d"), xyz("a").alias("h"), xyz("b").alias("a"), F.col("a_donor_type").alias("donor_type"), F.col("b_type").alias("acceptor_type"))


def hydrogen_bonds(triples: DataFrame, bins: int = 10, low: float = 1.0, high: float = 5.0, least_angle: float = 0.5) -> DataFrame:
    """(complex, donor_type, acceptor_type, angle_bin, distance_bin, n) of rows with
    structs d, h and a (x, y, z): by donor-acceptor distance in [low, high] and angle
    at the hydrogen in [least_angle, pi]; the last bin takes its upper edge."""
    dot = lambda u, v: sum((u[k] * v[k] for k in range(1, 3)), u[0] * v[0])
    part = lambda p, q: [F.col(f"{q}.{c}") - F.col(f"{p}.{c}") for c in "xyz"]
    dh, ha, da = part("d", "h"), part("h", "a"), part("d", "a")
    cosine = dot(dh, ha) / F.sqrt(dot(dh, dh) * dot(ha, ha))
    rows = triples.withColumns({"distance": F.sqrt(dot(da, da)), "angle": F.pi() - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))})
    rows = rows.where(F.col("distance").between(low, high) & (F.col("angle") >= least_angle))
    bin_ = lambda c, a, width: F.least(F.floor((F.col(c) - a) / width * bins), F.lit(bins - 1)).cast("int")
    rows = rows.withColumns({"angle_bin": bin_("angle", F.lit(least_angle), F.pi() - least_angle), "distance_bin": bin_("distance", F.lit(low), F.lit(high - low))})
    return rows.groupBy("complex", "donor_type", "acceptor_type", "angle_bin", "distance_bin").agg(F.count("*").alias("n"))


def surrogate_score(points: DataFrame, reach: float, seed: int) -> DataFrame:
    """(complex, score): sums of w / d^2 over pairs, w by type pair from the seed."""
    sums = distance_sums(points, reach)
    weight = uniform("w", seed, F.col("type_a"), F.col("type_b")) / F.lit(4294967296.0)
    return sums.groupBy("complex").agg(F.sum(weight * F.col("inverse_square")).alias("score"))


def inventory(points: DataFrame) -> DataFrame:
    """(type, n): atoms by type, the most frequent first."""
    return points.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("type"))


def long_form(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(complex, name, value) of a feature table: names are the keys, and the value's."""
    name = lambda v: F.concat_ws("|", *[F.lpad(F.col(k).cast("string"), 3, "0") if k.endswith("bin") else F.col(k).cast("string") for k in keys], F.lit(v))
    entry = F.explode(F.array(*[F.struct(name(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values]))
    return table.select("complex", entry.alias("x")).select("complex", "x.*")


def dictionary(long: DataFrame) -> DataFrame:
    """(name, code): codes from 0 in the order of all names, by ranks over ranges of them."""
    names = long.select("name").distinct().withColumn("all", F.lit(0))
    ranked = running(names, ["all"], [F.col("name")], {"code": F.lit(1).cast("long")})
    return ranked.select("name", (F.col("code") - 1).cast("int").alias("code"))


def sparse(coded: DataFrame) -> DataFrame:
    """(complex, entries) from rows (complex, code, value): codes and values, in order of
    codes; null codes are none."""
    entry = F.when(F.col("code").isNotNull(), F.struct(F.col("code").cast("int").alias("code"), F.col("value").cast("double").alias("value")))
    return coded.groupBy("complex").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def dense(vectors: DataFrame, width: int) -> DataFrame:
    """(complex, features) of sparse vectors: `width` numbers, 0 where there is no entry.
    The plan is the same for any width."""
    kind = vectors.schema["complex"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                entries = part.column("entries")
                counts = np.diff(entries.offsets.to_numpy())
                flat = entries.flatten()
                out = np.zeros((part.num_rows, width))
                row = np.repeat(np.arange(part.num_rows), counts)
                out[row, flat.field("code").to_numpy(zero_copy_only=False)] = flat.field("value").to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * width), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("complex"), lists], names=["complex", "features"])

    return vectors.select("complex", "entries").mapInArrow(work, f"complex {kind}, features array<double>")


def as_vectors(long: DataFrame) -> DataFrame:
    """(complex, features): values in the order of all names, 0 where a complex has none."""
    long = keep(long)
    codes = keep(dictionary(long))
    return dense(sparse(long.join(codes, "name").select("complex", "code", "value")), codes.count())
