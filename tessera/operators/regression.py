"""Regressors: exact trees and forests, and weighted least squares."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import keep
from .vectors import k_least, squared_distances


#: Digits to which errors of splits are compared, as shares of the node's own error: sums
#: of floating numbers depend on their order beyond that, and splits that part the rows
#: alike must not be told apart by it.
DIGITS = 9


@dataclass(frozen=True)
class ForestOptions:
    """trees; leaf: least rows on the right of a split, one less than on the left; shares
    of rows and of features that a tree sees, drawn without replacement. stratified:
    rows are drawn from the clusters in turn, in a random order of both."""

    trees: int = 100
    leaf: int = 1
    data_bag: float = 0.5
    feature_bag: float = 1.0
    seed: int = 1
    stratified: bool = False


@dataclass
class Tree:
    """Nodes in arrays: feature (-1 at a leaf), threshold, children, prediction, squared error."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    error: list[float]
    rows: list[int]

    def paths(self) -> list[str]:
        """The way to each node: L or R for every split above it."""
        out = [""] * len(self.feature)
        for at, f in enumerate(self.feature):  # parents come before their children
            if f >= 0:
                out[self.left[at]], out[self.right[at]] = out[at] + "L", out[at] + "R"
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return value[at]
            node = at[inner]
            less = x[inner, f[inner]] < threshold[node]
            at[inner] = np.where(less, left[node], right[node])

    def splits(self) -> int:
        return sum(f >= 0 for f in self.feature)

    def residual(self) -> float:
        return sum(e for f, e in zip(self.feature, self.error) if f < 0)


def draw(*parts) -> int:
    """As `functions.text.uniform`: an integer in [0, 2^32) from the MD5 of the parts."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray, leaf: int) -> tuple[int, float] | None:
    """(feature, threshold) of least weighted squared error; of errors that agree to
    `DIGITS` of the node's own, the first feature's and least threshold's.

    Left gets at least leaf + 1 rows, right at least leaf; equal values are not parted.
    """
    n = len(y)
    if n < 2 * leaf + 1:
        return None
    y = y - np.average(y, weights=w)
    part = x[:, features]
    order = np.argsort(part, axis=0, kind="stable")
    v = np.take_along_axis(part, order, axis=0)
    ws, wy, wyy = (np.cumsum(a[order], axis=0) for a in (w, w * y, w * y * y))
    sse = lambda s0, s1, s2: s2 - s1 * s1 / s0
    left = sse(ws[:-1], wy[:-1], wyy[:-1])
    right = sse(np.maximum(ws[-1] - ws[:-1], 1e-300), wy[-1] - wy[:-1], wyy[-1] - wyy[:-1])
    own = sse(ws[-1], wy[-1], wyy[-1])
    total = np.round((left + right) / np.where(own > 0, own, 1.0), DIGITS)
    total[v[1:] <= v[:-1]] = np.inf
    count = np.arange(1, n)
    total[(count < leaf + 1) | (n - count < leaf)] = np.inf
    k = total.argmin(axis=0)
    f = int(total[k, np.arange(total.shape[1])].argmin())
    if not np.isfinite(total[k[f], f]):
        return None
    return int(features[f]), float((v[k[f], f] + v[k[f] + 1, f]) / 2)


def build_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray, leaf: int) -> Tree:
    tree = Tree([], [], [], [], [], [], [])
    stack = [(np.arange(len(y)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        node = len(tree.feature)
        if parent >= 0:
            (tree.right if side else tree.left)[parent] = node
        mean = float(np.average(y[rows], weights=w[rows]))
        tree.value.append(mean)
        tree.rows.append(len(rows))
        tree.error.append(abs(float(np.average(y[rows] ** 2, weights=w[rows])) - mean * mean))
        split = best_split(x[rows], y[rows], w[rows], features, leaf) if len(rows) > leaf else None
        tree.feature.append(split[0] if split else -1)
        tree.threshold.append(split[1] if split else 0.0)
        tree.left.append(node)
        tree.right.append(node)
        if split:
            less = x[rows, split[0]] < split[1]
            stack += [(rows[~less], node, 1), (rows[less], node, 0)]
    return tree


def bag(draws: np.ndarray, size: int, clusters: np.ndarray | None = None, turns: dict | None = None) -> np.ndarray:
    """`size` of the rows, first those of least draw, of equal ones the first; with
    `clusters`, one of each in turn, in the order of `turns`, until there are enough."""
    order = np.argsort(draws, kind="stable")
    if clusters is not None:
        seen: dict = {}
        place = []
        for c in clusters[order]:
            seen[c] = seen.get(c, 0) + 1
            place.append((seen[c], turns[c], c))
        order = order[sorted(range(len(order)), key=place.__getitem__)]
    return np.sort(order[:size])


def drawn_features(options: ForestOptions, model: str, tree: int, width: int) -> np.ndarray:
    """The features that a tree may split by, ascending; as `forests.chosen_features`."""
    most = max(1, int(options.feature_bag * width))
    if most == width:
        return np.arange(width)
    return np.sort(np.argsort([draw(options.seed, "feature", model, tree, f) for f in range(width)], kind="stable")[:most])


def build_forest(x: np.ndarray, y: np.ndarray, w: np.ndarray, options: ForestOptions, model: str, ids: list, clusters: np.ndarray | None = None) -> list[Tree]:
    """The trees of one model whose rows, in the order of their ids, one group can hold;
    `forests.grow` draws the same bags and takes the same splits without one."""
    trees, n, width = [], len(y), x.shape[1]
    o, size = options, max(1, int(options.data_bag * len(y)))
    for k in range(o.trees):
        rows = np.arange(n)
        if o.data_bag < 1:
            draws = np.array([draw(o.seed, "bag", model, k, i) for i in ids])
            turns = {c: draw(o.seed, "cluster", model, k, c) for c in np.unique(clusters)} if o.stratified else None
            rows = bag(draws, size, clusters if o.stratified else None, turns)
        trees.append(build_tree(x[rows], y[rows], w[rows], drawn_features(o, model, k, width), o.leaf))
    return trees


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return np.mean([t.predict(x) for t in trees], axis=0)


def least_squares(x: np.ndarray, y: np.ndarray, w: np.ndarray, bias: bool = False) -> np.ndarray:
    """Weighted coefficients; directions without variation get none. A bias comes last."""
    a = np.column_stack([x, np.ones(len(x))]) if bias else x
    root = np.sqrt(w)
    return np.linalg.lstsq(a * root[:, None], y * root, rcond=None)[0]


def nearest_mean(x: np.ndarray, train: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Plain mean of the k nearest; of equally near rows, the first."""
    out = np.empty(len(x))
    for at in range(0, len(x), 16):
        for r, near in k_least(squared_distances(x[at : at + 16], train), k):
            out[at + r] = y[near].mean()
    return out


def linear_prediction(model: Column, features: Column) -> Column:
    """Inner product, with the model's last number as bias if it is one longer."""
    bias = F.when(F.size(model) == F.size(features) + 1, F.element_at(model, -1)).otherwise(0.0)
    return F.aggregate(F.zip_with(F.slice(model, 1, F.size(features)), features, lambda m, x: m * x), F.lit(0.0), lambda s, v: s + v) + bias


#: Rows that a group turns into its factor, as a multiple of what the factor has.
REDUCE = 16


def factor(a: np.ndarray) -> np.ndarray:
    """R of QR: as many rows as columns at most, with the same inner products as `a`."""
    return np.linalg.qr(a, mode="r") if len(a) > a.shape[1] else a


def factors(rows: DataFrame, width: int) -> DataFrame:
    """(g, v): for each g of `rows` (g, v) the R factor of its vectors of `width` numbers,
    as `width` rows at most. Tasks factor what they read, groups of bounded size factor
    what is left of a g until one can hold it: the logarithm of its rows in rounds."""
    most = REDUCE * width

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        count = 0
        for batch in batches:
            names = batch.column("g").dictionary_encode()
            code = names.indices.to_numpy()
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for c, name in enumerate(names.dictionary.to_pylist()):
                held.setdefault(name, []).append(x[code == c])
            count += batch.num_rows
            if count > max(most, 10_000):
                held = {name: [factor(np.concatenate(parts))] for name, parts in held.items()}
                count = sum(len(p[0]) for p in held.values())
                if count > max(most, 10_000) // 2:  # of very many g
                    yield from map(_factor_rows, held, (p[0] for p in held.values()))
                    held, count = {}, 0
        for name, parts in held.items():
            yield _factor_rows(name, factor(np.concatenate(parts)))

    def joined(group: pa.Table) -> pa.Table:
        x = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1)
        return pa.Table.from_batches([_factor_rows(group.column("g")[0].as_py(), factor(x))])

    now = keep(rows.mapInArrow(squeezed, "g string, v array<double>"))
    while True:
        sizes = now.groupBy("g").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("salts"))
        dealt = now.join(sizes, "g").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))
        more = (sizes.agg(F.max("salts")).first()[0] or 1) > 1
        now = keep(dealt.groupBy("g", "salt").applyInArrow(joined, "g string, v array<double>"))
        if not more:
            return now


def _factor_rows(name: str, r: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * r.shape[1]), pa.array(np.ascontiguousarray(r, dtype=np.float64).ravel()))
    return pa.RecordBatch.from_arrays([pa.array([name] * len(r), pa.string()), lists], names=["g", "v"])


def solve(r: np.ndarray) -> np.ndarray:
    """Least squares from a factor (or stacked ones) whose last column is the response."""
    return np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0]


def weighted_rows(g: Column, features: Column, response: Column, weight: Column, bias: bool = False) -> list[Column]:
    """The columns (g, v) of rows for `factors`: features, a one for a bias, the response,
    all by the root of the weight."""
    parts = [features.cast("array<double>"), *([F.array(F.lit(1.0))] if bias else []), F.array(response.cast("double"))]
    root = F.sqrt(weight.cast("double"))
    return [g.alias("g"), F.transform(F.concat(*parts), lambda x: x * root).alias("v")]


def fit_linear(rows: DataFrame, features: str = "features", response: str = "response", weight: str | None = None, bias: bool = False) -> list[float]:
    """Coefficients by QR, which loses no digits to squares; the driver gets one factor."""
    w = F.col(weight) if weight else F.lit(1.0)
    width = rows.select(F.max(F.size(features))).first()[0]
    if width is None:
        raise ValueError("no rows")
    found = factors(rows.select(*weighted_rows(F.lit(""), F.col(features), F.col(response), w, bias)), width + 1 + bias)
    return solve(np.array([r["v"] for r in found.select("v").collect()])).tolist()
