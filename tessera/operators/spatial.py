"""Spatial joins of points within a complex.

Points are rows (complex, side, type, x, y, z); residues add `res_no` and `res_type`.
Pairs meet through a grid: cells as wide as the reach, so only neighbouring cells hold
what is near. Axes along which cells leave out fewer pairs than their copies cost are
left out of it, so small complexes meet whole. The equi-join on complex and cell keeps the
work in proportion to the points; those of a crowded cell are dealt over salts of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def distance(a: str = "a", b: str = "b") -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [(F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) * (F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) for c in AXES]))


#: Points of one side that a task holds of one cell.
CROWD = 20_000


#: What a copy of a point for a cell by it costs, in pairs that are tested.
COPY = 250


def pruning_axes(left: DataFrame, right: DataFrame, reach: float, keys: list[str]) -> tuple[list[str], int]:
    """The axes to cut into cells, none if points of a complex are so few that testing all
    their pairs costs less than a copy of each for every cell by it; and the right points
    of the largest complex.

    A cell has about as much of a complex's right points as it has of its length."""
    sizes = bounds(right, keys, F.count("*").alias("r")).join(left.groupBy(*keys).agg(F.count("*").alias("l")), keys)
    shares = {c: F.least(F.lit(1.0), F.lit(3.0 * reach) / F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(1e-300))) if reach > 0 else F.lit(1.0) for c in AXES}
    pairs = F.col("l").cast("double") * F.col("r")
    # Sums over complexes of the pairs that each choice of axes leaves, all in one pass.
    ways = [[c for i, c in enumerate(AXES) if way >> i & 1] for way in range(8)]
    found = sizes.agg(F.sum("l").alias("l"), F.max("r").alias("r"), *[F.sum(reduce(lambda s, c: s * shares[c], way, pairs)).alias(f"w{i}") for i, way in enumerate(ways)]).first()
    if not found["l"]:
        return [], 0
    return min(ways, key=lambda way: (found[f"w{ways.index(way)}"] + COPY * (3 ** len(way) - 1) * found["l"], len(way))), found["r"]


def cells(points: DataFrame, reach: float, axes: list[str], around: bool) -> DataFrame:
    """`points` with their cell, or with `around` a row for each of the cells by it."""
    own = [F.floor(F.col(c) / F.lit(float(reach))) for c in axes]
    out = points.withColumns({f"cell_{c}": v for c, v in zip(axes, own)})
    if around:
        for c in axes:
            out = out.withColumn(f"cell_{c}", F.explode(F.sequence(F.col(f"cell_{c}") - 1, F.col(f"cell_{c}") + 1)))
    return out


def pairs_within(left: DataFrame, right: DataFrame, reach: float, keys: list[str] | None = None) -> DataFrame:
    """(*keys, a_<column>..., b_<column>..., d): pairs of one complex at a distance up to
    `reach`, with the columns of both points, of which unused ones are pruned. Exact:
    the grid only finds candidates.

    The planner's own exchange deals cells over tasks, so the adaptive rules may split
    a cell of many left points; one of over `CROWD` right points has a salt for each
    `CROWD` of them, and left points meet all salts.
    """
    keys = keys or ["complex"]
    axes, most = pruning_axes(left, right, reach, keys)
    cell = [*keys, *[f"cell_{c}" for c in axes]]
    mark = lambda df, side: [F.col(c).alias(f"{side}_{c}") for c in df.columns]
    a = cells(left, reach, axes, True).select(*cell, *mark(left, "a"))
    b = cells(right, reach, axes, False).select(*cell, *mark(right, "b"))
    crowded = None if most <= CROWD else b.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(*cell, F.ceil(F.col("n") / CROWD).cast("int").alias("salts"))
    if crowded is not None and not crowded.isEmpty():
        salts = F.coalesce("salts", F.lit(1))
        a = a.join(crowded, cell, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        b = b.join(crowded, cell, "left").withColumn("salt", F.pmod(F.xxhash64(*[f"b_{c}" for c in right.columns]), salts).cast("int")).drop("salts")
        cell = [*cell, "salt"]
    square = reduce(lambda s, t: s + t, [(F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in AXES])
    # A square just over the bound may have a root on it, so the root decides again.
    near = a.join(b.hint("merge"), cell).where(square <= float(reach) * float(reach) * (1 + 1e-12)).drop(*[c for c in cell if c not in keys])
    return near.withColumn("d", distance()).where(F.col("d") <= float(reach))


def cross_pairs(points: DataFrame, reach: float) -> DataFrame:
    """Pairs of a point of side 1 with one of side 2 within `reach`."""
    return pairs_within(points.where("side = 1"), points.where("side = 2"), reach)


def by_types(pairs: DataFrame, by: list[str], *sums: tuple[str, Column]) -> DataFrame:
    """(*by, type_a, type_b, sums...) of pairs, the two types in order. Sums are taken by
    the types as they come, and types are put in order after that."""
    first = pairs.groupBy(*by, "a_type", "b_type").agg(*[c.alias(name) for name, c in sums])
    ordered = first.groupBy(*[c for c in by], F.least("a_type", "b_type").alias("type_a"), F.greatest("a_type", "b_type").alias("type_b"))
    return ordered.agg(*[F.sum(name).alias(name) for name, _ in sums]).select(by[0], "type_a", "type_b", *by[1:], *[name for name, _ in sums])


def nearest(left: DataFrame, right: DataFrame, reach: float, keys: list[str], by: list[str]) -> DataFrame:
    """(*keys, *by, d): for each group of `left` rows, the least distance to a `right`
    row of the same keys, up to `reach`; without one, no row."""
    near = pairs_within(left, right, reach, keys)
    return near.groupBy(*keys, *[F.col(f"a_{c}").alias(c) for c in by]).agg(F.min("d").alias("d"))


def without_type(points: DataFrame, kind: str) -> DataFrame:
    """`points` without those of one type."""
    return points.where(F.col("type") != kind)


def hydrogen_donors(points: DataFrame, reach: float = 3.0) -> DataFrame:
    """(complex, side, serial, donor, d): of each hydrogen, the nearest other atom of
    its own side; of equally near ones, the smallest serial."""
    h, heavy = points.where(F.startswith("type", F.lit("H"))), points.where(~F.startswith("type", F.lit("H")))
    near = pairs_within(h, heavy, reach, ["complex", "side"])
    best = near.groupBy("complex", "side", F.col("a_serial").alias("serial")).agg(F.min(F.struct("d", F.col("b_serial").alias("s"))).alias("m"))
    return best.select("complex", "side", "serial", F.col("m.s").alias("donor"), F.col("m.d").alias("d"))


def interface_acceptors(points: DataFrame, reach: float = 3.0) -> DataFrame:
    """(complex, side, serial, acceptor, d): as `hydrogen_donors`, on the other side."""
    h = points.where(F.startswith("type", F.lit("H")))
    other = points.where(~F.startswith("type", F.lit("H"))).withColumn("own_side", F.col("side")).withColumn("side", 3 - F.col("side"))
    near = pairs_within(h, other, reach, ["complex", "side"])
    best = near.groupBy("complex", "side", F.col("a_serial").alias("serial")).agg(F.min(F.struct("d", F.col("b_serial").alias("s"))).alias("m"))
    return best.select("complex", "side", "serial", F.col("m.s").alias("acceptor"), F.col("m.d").alias("d"))


def clashes(points: DataFrame, threshold: float) -> DataFrame:
    """Pairs across the sides that are closer than `threshold`."""
    return cross_pairs(points, threshold).where(F.col("d") < float(threshold))


def bounds(points: DataFrame, keys: list[str] | None = None, *more: Column) -> DataFrame:
    """Least and greatest coordinate of each complex on each axis."""
    return points.groupBy(*(keys or ["complex"])).agg(*more, *[f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))])


def transform(points: DataFrame, rotation: list[list[float]], shift: list[float]) -> DataFrame:
    """Points moved by a rotation and then a shift."""
    new = [reduce(lambda s, t: s + t, [F.lit(float(r)) * F.col(c) for r, c in zip(row, AXES)]) + F.lit(float(t)) for row, t in zip(rotation, shift)]
    return points.withColumns(dict(zip(AXES, new)))
