"""Single linkage, exactly, and tables of clusterings.

Tables of any size go through joins. What is few, by count, is finished in one group or
broadcast, which gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import keep
from .digests import list_digests
from .running import running
from .vectors import _blocked, _exact_squares, _matrix, _swift_squares, meetings, met_blocks, near_squares, vector_kind


#: Links that one group takes, and nodes that are broadcast: some 50 MB.
FEW = 2_000_000


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 .. n - 1 that each is linked with, over any number of links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def forest(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links are in the minimum spanning forest, the earlier of equal ones by ids:
    each component takes its least link, again and again."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = np.sort(codes.reshape(2, -1), axis=0)
    order = np.lexsort((b, a, d)) if a.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (d[i], a[i], b[i])), dtype=np.int64)
    ends, label, kept = ends[:, order], np.arange(len(names)), np.zeros(len(d), bool)
    open_ = np.arange(len(d))
    while len(open_):
        x, y = label[ends[:, open_]]
        open_, x, y = open_[x != y], x[x != y], y[x != y]
        best = np.full(len(names), len(d))
        np.minimum.at(best, x, open_)
        np.minimum.at(best, y, open_)
        took = np.unique(best[best < len(d)])
        kept[took] = True
        label = least_labels(len(names), *label[ends[:, took]])[label]
    return np.sort(order[kept])


def _thinned(links: DataFrame) -> DataFrame:
    """`links` (id_a, id_b, d) without those that are in no minimum spanning forest of
    what a task has read lately: it holds up to `FEW` links and keeps their forest."""
    schema = links.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def thin() -> list[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            a, b, d = (table.column(c).to_numpy() for c in ("id_a", "id_b", "d"))
            return table.take(pa.array(forest(d, a, b))).to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > FEW:
                held = thin()
                size = sum(h.num_rows for h in held)
                if size > FEW // 2:  # of very many nodes
                    yield from held
                    held, size = [], 0
        if size:
            yield from thin()

    return links.mapInArrow(work, schema)


#: Rows of a part whose vectors meet; all distances of two are held.
BLOCK = 1024


def _block_forest(x: np.ndarray, y: np.ndarray | None, below: float = float("inf")) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of y and squared distances of a minimum spanning forest of all
    links between the two; of all within x without y. It may lack links that are not
    shorter than `below`.

    The links up to a bound that nine in ten components have one under are taken at a
    time, and those within a component left out. Products find them, differences decide.
    """
    z, first = (x, 0) if y is None else (y, len(x))
    near, off = near_squares(x, z)
    near[np.isnan(near)] = np.inf
    if below < np.inf:
        near[near > below * below * (1 + 1e-9) + 2 * off] = np.inf
    if y is None:
        near[np.tril_indices(len(x))] = np.inf
    nodes = first + len(z)
    a = b = np.empty(0, np.int64)
    d, label = np.empty(0), np.arange(nodes)
    while True:
        rows, columns = label[: len(x)], label[first:]
        near[rows[:, None] == columns] = np.inf
        low = np.full(nodes, np.inf)
        np.minimum.at(low, rows, near.min(axis=1))
        np.minimum.at(low, columns, near.min(axis=0))
        low = np.sort(low[np.isfinite(low)])
        if not len(low):
            return a, b - first, d
        bound = low[int(0.9 * (len(low) - 1))]
        if np.count_nonzero(near <= bound + 2 * off) > 32 * nodes:
            bound = low[(len(low) - 1) // 2]
        i, j = np.divmod(np.flatnonzero(near <= bound + 2 * off), len(z))
        e = _exact_squares(x, z, i, j)
        own = e <= bound + off
        a, b, d = np.concatenate([a, i[own]]), np.concatenate([b, j[own] + first]), np.concatenate([d, e[own]])
        kept = forest(d, a, b)
        a, b, d = a[kept], b[kept], d[kept]
        label = least_labels(nodes, a, b)


def linkage_order(nodes: int, d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 .. nodes - 1 in an order in which each cluster of a forest's links is a stretch, and
    for each place the distance at which it and the next one come to be in one cluster, so
    that between any two the largest of these is the longest link on their way; infinite
    where none is."""
    root, first, last, after, gap = list(range(nodes)), list(range(nodes)), list(range(nodes)), [-1] * nodes, [float("inf")] * nodes
    order = np.argsort(d, kind="stable")
    for w, x, y in zip(d[order].tolist(), a[order].tolist(), b[order].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        gap[last[x]], after[last[x]] = w, first[y]
        root[y], last[x] = x, last[y]
    out = []
    for x in range(nodes):
        if root[x] == x:
            x = first[x]
            while x >= 0:
                out.append(x)
                x = after[x]
    out = np.array(out, dtype=np.int64)
    return out, np.array(gap)[out]


def _widest(gaps: np.ndarray):
    """(lo, hi) -> the largest of `gaps` from lo up to before hi, for many at once; nothing
    where they are the same."""
    table = [gaps]
    while 2 ** len(table) <= len(gaps):
        half = 2 ** (len(table) - 1)
        table.append(np.maximum(table[-1][:-half], table[-1][half:]))

    def between(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out, power = np.zeros(len(lo)), np.frexp(np.maximum(hi - lo, 1))[1] - 1
        for k in np.unique(power[hi > lo]):
            own = (power == k) & (hi > lo)
            out[own] = np.maximum(table[k][lo[own]], table[k][hi[own] - 2**k])
        return out

    return between


#: Rows and columns of the products that are looked through at a time, and links held.
TILE, LINKS = (512, 4096), 2**20


def shorter_links(x: np.ndarray, at: np.ndarray, y: np.ndarray | None, to: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of y and distances of links between the two (within x without y), the
    forest of them, that are shorter than the largest of `gaps` between their places, `at`
    and `to`, in order: what is not as short is in no minimum spanning tree together with
    the links that the gaps are of. Products find them, differences decide."""
    z = x if y is None else y
    here = np.unique(np.concatenate([at, to]))
    reach = np.maximum.reduceat(gaps, here)[:-1] if len(here) > 1 else np.zeros(1)
    between = _widest(reach)
    at, to = np.searchsorted(here, at), np.searchsorted(here, to)
    finite = reach[np.isfinite(reach) & (reach > 0)]
    links = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    if not (reach > 0).any() or not len(x) or not len(z):
        return tuple(links)
    swift = _swift_squares(x, z)
    if swift and len(finite) and swift[3] > 0.01 * float(np.median(finite)) ** 2:  # too coarse to tell what is shorter
        swift = None
    parts, size = [links], 0
    for r in range(0, len(x), TILE[0]):
        for c in range(r // TILE[1] * TILE[1] if y is None else 0, len(z), TILE[1]):
            rows, columns = slice(r, r + TILE[0]), slice(c, c + TILE[1])
            p, q = at[rows], to[columns]
            most = between(np.array([min(p[0], q[0])]), np.array([max(p[-1], q[-1])]))[0]
            if most <= 0:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                if swift:
                    left, right, own, off = swift
                    near = left[rows] @ right[:, columns]
                    bound = np.nextafter((most * most * (1 + 1e-9) + off - own[rows]).astype(np.float32), np.float32(np.inf))[:, None]
                else:
                    near, off = near_squares(x[rows], z[columns])
                    bound = most * most * (1 + 1e-9) + 2 * off
                found = np.flatnonzero(near <= bound)
            for some in np.array_split(found, -(-len(found) // LINKS)) if len(found) else []:
                i, j = np.divmod(some, near.shape[1])
                i, j = i + r, j + c
                if y is None:
                    i, j = i[i < j], j[i < j]
                d = np.sqrt(_exact_squares(x, z, i, j))
                short = d < between(np.minimum(at[i], to[j]), np.maximum(at[i], to[j]))
                parts.append([v[short] for v in (i, j, d)])
                size += int(short.sum())
                if size > LINKS:
                    links = _forest_of(parts, len(x) if y is not None else 0)
                    parts, size = [links], 0
    return tuple(_forest_of(parts, len(x) if y is not None else 0))


def _forest_of(parts: list, first: int) -> list[np.ndarray]:
    """The forest of links (a, b, d), the ends b being numbered from `first` on."""
    a, b, d = (np.concatenate(p) for p in zip(*parts))
    kept = forest(d, a, b + first)
    return [a[kept], b[kept], d[kept]]


def _group_forest(x: np.ndarray, below: float = float("inf"), block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and distances of links of x that hold a minimum spanning tree, or what hangs
    together by links `below` one: the forests of parts that share some rows bound what
    of the rest may be in it."""
    n = len(x)
    if n <= 2 * block:
        a, b, d = _block_forest(x, None, below)
        d = np.sqrt(d.astype(float))
        return a[d < below], b[d < below], d[d < below]
    shared = np.arange(max(1, block // 4))
    parts = []
    for at in range(len(shared), n, block):
        rows = np.concatenate([shared, np.arange(at, min(n, at + block))])
        a, b, d = _block_forest(x[rows], None, below)
        d = np.sqrt(d.astype(float))
        parts.append([rows[a][d < below], rows[b][d < below], d[d < below]])
    a, b, d = _forest_of(parts, 0)
    order, gaps = linkage_order(n, d, a, b)
    more = shorter_links(x[order], np.arange(n), None, np.arange(n), _open(gaps, below))
    return tuple(_forest_of([[a, b, d], [order[more[0]], order[more[1]], more[2]]], 0))


def _open(gaps: np.ndarray, below: float) -> np.ndarray:
    """Gaps that shorter links may close: with `below`, those that no shorter link did."""
    return gaps if below == np.inf else np.where(np.isfinite(gaps), 0.0, below)


#: Rows of a block at most, of which two meet in a task; rows that all blocks share.
WIDE, SHARED = 32768, 1024


def forest_links(vectors: DataFrame, ident: str = "id", vector: str = "vector", below: float = float("inf"), block: int = BLOCK, wide: int = WIDE, few: int | None = None) -> DataFrame:
    """(id_a, id_b, d) of some pairs of vectors, by Euclidean distance, that hold a minimum
    spanning tree of all pairs, or link what hangs together by distances `below` the one
    given.

    First blocks that share some rows give their forests. Up to `few` nodes, these are put
    in an order in which clusters are stretches, so that for each pair the longest link
    on its way is known; then blocks of that order meet, and only links that are shorter
    than that leave a task. Beyond that all blocks meet and give their forests. Time grows
    with the square of the rows, what is sent and written with the rows and their blocks.
    """
    few = FEW if few is None else few
    rows = vectors.select(F.col(ident).alias("id"), F.col(vector).cast(vector_kind(vectors.schema[vector].dataType.simpleString())).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))  # is near nothing
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd)
    count = rows.count()
    n = max(1, -(-count // max(1, min(wide, max(2 * block, count // 12)))))
    kind = rows.schema["id"].dataType.simpleString()
    shape, names = f"id_a {kind}, id_b {kind}, d double", ["id_a", "id_b", "d"]
    said = lambda ids, a, b, d: pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(d)], names=names)
    if count > few:
        def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for same, ids, v in met_blocks(batches):
                yield said(ids[0] if same else pa.concat_arrays(ids), *_group_forest((v[0] if same else np.concatenate(v)).astype(float), below, block))

        return keep(meetings(_blocked(rows, n, "own"), n).mapInArrow(all_, shape).where("id_a <> id_b"))
    context = rows.sparkSession.sparkContext
    some = context.broadcast(rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max(1, min(SHARED, count // (4 * n))) if n > 1 else 0).drop("h").toArrow().combine_chunks())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            mine = pa.Table.from_batches(held).select(["id", "v"])
            both = pa.concat_tables([some.value.cast(mine.schema), mine]).combine_chunks()
            ids = both.column("id").combine_chunks()
            yield said(ids, *_group_forest(_matrix(both.column("v")).astype(float), below, block))
            alone = np.arange(some.value.num_rows, len(ids))
            yield said(ids, alone, alone, np.zeros(len(alone)))  # so that all have a place

    links = keep(_blocked(rows, n, "own").repartitionById(n, "own").mapInArrow(own, shape))
    if n == 1:
        return links.where("id_a <> id_b")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            found = pa.Table.from_batches(held)
            ids, ends = np.unique(np.concatenate([found.column(c).to_numpy() for c in ("id_a", "id_b")]), return_inverse=True)
            (a, b), d = ends.reshape(2, -1), found.column("d").to_numpy()
            a, b, d = (v[a != b] for v in (a, b, d))
            kept = forest(d, a, b)
            order, gaps = linkage_order(len(ids), d[kept], a[kept], b[kept])
            yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(_open(gaps, below)), pa.array(np.arange(len(ids)))], names=["id", "gap", "place"])

    line = links.coalesce(1).mapInArrow(placed, f"id {kind}, gap double, place long").toArrow().sort_by("id")  # `few` at most
    gaps = np.empty(line.num_rows)
    gaps[line.column("place").to_numpy()] = line.column("gap").to_numpy()
    if not (gaps[:-1] > 0).any():
        return links.where("id_a <> id_b")
    held = context.broadcast((line.column("id").to_numpy(), line.column("place").to_numpy(), gaps))
    of = -(-len(gaps) // n)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, _ = held.value
        for batch in batches:
            own = place[np.searchsorted(known, batch.column("id").to_numpy(zero_copy_only=False))] // of
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns], names=["own", "id", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, gaps = held.value
        for same, ids, v in met_blocks(batches):
            at = [place[np.searchsorted(known, i.to_numpy(zero_copy_only=False))] for i in ids]
            order = [np.argsort(p, kind="stable") for p in at]
            (x, y), (p, q) = ([w[o] for w, o in zip(u, order)] for u in (v, at))
            a, b, d = shorter_links(x.astype(float), p, None if same else y.astype(float), q, gaps)
            yield said(pa.concat_arrays(ids), order[0][a], order[1][b] + len(p), d)

    number = rows.schema["v"].dataType.simpleString()
    met = meetings(rows.mapInArrow(dealt, f"own int, id {kind}, v {number}"), n).mapInArrow(meet, shape)
    return keep(links.unionByName(met).where("id_a <> id_b"))


def _rooted(parents: DataFrame) -> DataFrame:
    """(c, root) of a forest (c, p) in which roots have p = c, by jumping from parent to
    parent: rounds are the logarithm of its height."""
    now = keep(parents)
    while True:
        up = now.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        after = keep(now.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("c", F.col("p").alias("root"))
        now = after.select("c", "p")


def spanning_tree(distances: DataFrame, few: int = FEW) -> DataFrame:
    """Minimum spanning forest (id_a, id_b, d) of rows (id_a, id_b, d), of equal distances
    the first by ids. Links of an id with itself and null distances are none.

    Tasks drop links that are in no forest of their own, so that few of all pairs are
    shuffled. Then, while there are over `few`, every component takes its least link to
    another one, those so linked become one, and of the links between two components the
    least stays: the components halve at least. The rest is one group's.
    """
    c = F.col
    order = c("id_a") < c("id_b")
    ways = [F.when(order, c(x)).otherwise(c(y)) for x, y in (("id_a", "id_b"), ("id_b", "id_a"))]
    links = keep(_thinned(distances.where("id_a <> id_b AND d IS NOT NULL").select(ways[0].alias("id_a"), ways[1].alias("id_b"), c("d").cast("double").alias("d"))))
    while (size := links.count()) > max(few, FEW):  # tasks that read more of them drop more
        fewer = keep(_thinned(links.repartition(max(1, size // (4 * FEW)))))
        links, done = fewer, fewer.count() > size // 2
        if done:
            break
    edges = keep(links.select(c("id_a").alias("a"), c("id_b").alias("b"), F.struct("d", "id_a", "id_b").alias("link")))
    tree = []
    while edges.count() > few:
        both = edges.select(c("a").alias("c"), F.struct("link", c("b").alias("to")).alias("way")).unionByName(edges.select(c("b").alias("c"), F.struct("link", c("a").alias("to")).alias("way")))
        least = keep(both.groupBy("c").agg(F.min("way").alias("way")).select("c", "way.to", "way.link"))
        tree.append(least.select("link").distinct())
        # Two components that take the same link point at each other; the smaller is the root.
        other = least.select(c("c").alias("to"), c("to").alias("back"))
        parents = least.join(other, "to").select("c", F.when((c("back") == c("c")) & (c("c") < c("to")), c("c")).otherwise(c("to")).alias("p"))
        roots = _rooted(parents)
        for end in "ab":
            edges = edges.join(roots.select(c("c").alias(end), c("root").alias(f"root_{end}")), end)
        met = edges.where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"), "link")
        edges = keep(met.groupBy("a", "b").agg(F.min("link").alias("link")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            link = table.column("link").combine_chunks()
            # Components are the ends, links between them are told apart by their own ids.
            a, b = (table.column(x).to_numpy() for x in "ab")
            place = np.empty(table.num_rows, dtype=np.int64)
            first = {x: link.field(x).to_numpy(zero_copy_only=False) for x in ("d", "id_a", "id_b")}
            if first["id_a"].dtype == object:
                place[sorted(range(len(place)), key=list(zip(*first.values())).__getitem__)] = np.arange(len(place))
            else:
                place[np.lexsort((first["id_b"], first["id_a"], first["d"]))] = np.arange(len(place))
            yield from pa.Table.from_struct_array(link.take(pa.array(forest(place, a, b)))).select(["id_a", "id_b", "d"]).to_batches()

    kind = edges.schema["a"].dataType.simpleString()
    out = edges.coalesce(1).mapInArrow(finish, f"id_a {kind}, id_b {kind}, d double")  # at most `few` rows
    for part in tree:
        out = out.unionByName(part.select("link.id_a", "link.id_b", "link.d"))
    return keep(out)


def cuts(tree: DataFrame, nodes: int, fold: int) -> DataFrame:
    """(clustering_id, min_dist) of each clustering with at least `fold` clusters, from
    single members on; min_dist is the least distance left between clusters, and links
    under it are joined."""
    each = tree.groupBy("d").agg(F.count("*").cast("long").alias("n")).withColumn("all", F.lit(0))
    run = running(each, ["all"], [F.col("d")], {"upto": F.col("n"), "rank": F.lit(1).cast("long")})
    left = nodes - (F.col("upto") - F.col("n"))
    return run.where(left >= fold).select((F.col("rank") - 1).cast("int").alias("clustering_id"), F.col("d").alias("min_dist"))


def levels(distances: DataFrame, fold: int, few: int = FEW) -> DataFrame:
    """(clustering_id, min_dist, clusters, members) of each clustering that `single_linkage`
    lists: every link that is shorter joins two clusters, so none need be listed."""
    tree = spanning_tree(distances, few)
    nodes = distances.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().count()
    found = keep(cuts(tree, nodes, fold))
    shorter = tree.groupBy("d").agg(F.count("*").cast("long").alias("n")).withColumn("all", F.lit(0))
    run = running(shorter, ["all"], [F.col("d")], {"upto": F.col("n")})
    return found.join(run.select(F.col("d").alias("min_dist"), (F.lit(nodes) - F.col("upto") + F.col("n")).alias("clusters")), "min_dist").select("clustering_id", "min_dist", "clusters", F.lit(nodes).cast("long").alias("members"))


def member_digests(distances: DataFrame, fold: int, few: int = FEW) -> DataFrame:
    """(clustering_id, members): for each clustering that `single_linkage` lists, MD5 of its
    members as cluster_id:complex_id in the order of ids, joined by commas.

    All clusterings' members together are the square of the nodes at worst. With up to
    `few` nodes they never leave a task, which goes from one clustering to the next along
    the tree and hashes only from the first id on whose number changes; beyond that they
    are those of `single_linkage`.
    """
    tree = spanning_tree(distances, few)
    nodes = keep(distances.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct())
    found = keep(cuts(tree, nodes.count(), fold))
    if nodes.count() > few:
        text = F.concat_ws(":", F.col("cluster_id").cast("string"), F.col("complex_id").cast("string"))
        return list_digests(_cut_by_joins(tree, nodes, found), ["clustering_id"], [F.col("complex_id")], text, ",").withColumnRenamed("md5", "members")
    held = _broadcast_tree(tree, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, a, b, d = held.value
        size, label, done = len(names), np.arange(len(names)), 0
        number, first = np.arange(size), 0
        ids = pa.array(names) if names.dtype != object and names.dtype.kind in "iu" else pa.array(list(map(str, names.tolist())), pa.string())
        ids, numbers = (x.cast(pa.string()) for x in (ids, pa.array(number)))
        words = pa.concat_arrays([numbers, pc.binary_join_element_wise(":", ids, ",", "")])
        # What comes before the first id whose number changes is hashed already, to within a part.
        each = max(256, -(-size // 64))
        states = [hashlib.md5()]
        spots = np.empty((size, 2), np.int32)
        spots[:, 1] = np.arange(size, 2 * size)
        for batch in batches:
            out = []
            for low in batch.column("min_dist").to_pylist():
                k = int(np.searchsorted(d, low))
                if k - done > 20:
                    label, first = least_labels(size, a[:k], b[:k]), 0
                    number = np.cumsum(label == np.arange(size)) - 1
                else:
                    for x, y in zip(a[done:k], b[done:k]):
                        x, y = sorted((label[x], label[y]))
                        later = label[y:]
                        later[later == y] = x
                        number[y:] -= 1
                        first = min(first, y)
                done = k
                part = min(first // each, len(states) - 1)
                del states[part + 1 :]
                at = part * each
                spots[at:, 0] = number[label[at:]]
                lines = words.take(pa.array(spots[at:].reshape(-1)))
                ends, text = np.frombuffer(lines.buffers()[1], np.int32), memoryview(lines.buffers()[2])
                state = states[-1].copy()
                for to in range(at, size, each):
                    if to > at:
                        states.append(state.copy())
                    last = to + each >= size
                    state.update(text[ends[2 * (to - at)] : ends[2 * (size - at)] - 1 if last else ends[2 * (to + each - at)]])  # without the last comma
                out.append(state.hexdigest())
                first = size
            yield pa.RecordBatch.from_arrays([batch.column("clustering_id"), pa.array(out, pa.string())], names=["clustering_id", "members"])

    spread = found.repartitionByRange(max(1, min(found.count(), 400)), "clustering_id").sortWithinPartitions("clustering_id")
    return spread.mapInArrow(run, "clustering_id int, members string")


def _labelled(links: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """`labels` (*keys, id, component) with the least label reachable by `links` (*keys,
    u, v; both ways) of the same keys: repeated minima, and the label of the label, which
    halves the rounds."""
    label = labels
    while True:
        least = links.join(label.withColumnRenamed("id", "v"), [*keys, "v"]).groupBy(*keys, "u").agg(F.min("component").alias("m")).withColumnRenamed("u", "id")
        hop = label.join(least, [*keys, "id"], "left").select(*keys, "id", "component", F.least("component", F.coalesce("m", "component")).alias("next"))
        jump = label.select(*keys, F.col("id").alias("next"), F.col("component").alias("to"))
        best = F.least("next", "to")
        after = keep(hop.join(jump, [*keys, "next"]).select(*keys, "id", best.alias("component"), (best != F.col("component")).alias("moved")))
        label = after.drop("moved")
        if after.where("moved").isEmpty():
            return label


def single_linkage(distances: DataFrame, fold: int, few: int = FEW) -> DataFrame:
    """(clustering_id, min_dist, cluster_id, complex_id): every clustering between two
    distinct distances that has at least `fold` clusters, numbered from the finest;
    clusters are numbered by their smallest members' order. Equal distances are joined
    together; no distances, no clusterings.

    A clustering lists all members, so the result is as large as members times distinct
    distances of the tree. Trees of up to `few` links are broadcast, and a task works out
    one clustering after another; beyond that all clusterings find their clusters at
    once by joins, each along the links that are shorter than its distance.
    """
    tree = spanning_tree(distances, few)
    nodes = keep(distances.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct())
    found = keep(cuts(tree, nodes.count(), fold))
    if nodes.count() <= few:
        return _cut_in_tasks(tree, nodes, found)
    return _cut_by_joins(tree, nodes, found)


def _broadcast_tree(tree: DataFrame, nodes: DataFrame):
    """(names, a, b, d): the names in order, and places of the ends of links by distance."""
    links = tree.toArrow().sort_by("d")  # `FEW` at most, as are the nodes
    names = np.sort(nodes.toArrow().column("id").to_numpy())
    a, b = (np.searchsorted(names, links.column(x).to_numpy()) for x in ("id_a", "id_b"))
    return tree.sparkSession.sparkContext.broadcast((names, a, b, links.column("d").to_numpy()))


def _cut_in_tasks(tree: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    held = _broadcast_tree(tree, nodes)
    kind = nodes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, a, b, d = held.value
        for batch in batches:
            for number, low in zip(*(batch.column(c).to_pylist() for c in ("clustering_id", "min_dist"))):
                k, size = np.searchsorted(d, low), len(names)
                _, cluster = np.unique(least_labels(size, a[:k], b[:k]), return_inverse=True)
                yield pa.RecordBatch.from_pydict({"clustering_id": pa.array(np.full(size, number, np.int32)), "min_dist": np.full(size, low), "cluster_id": pa.array(cluster.astype(np.int32)), "complex_id": pa.array(names)})

    spread = found.repartition(max(1, min(found.count(), 200)), "clustering_id")
    return spread.mapInArrow(run, f"clustering_id int, min_dist double, cluster_id int, complex_id {kind}")


def _cut_by_joins(tree: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    c = F.col
    last = found.agg(F.max("clustering_id")).first()[0]
    if last is None:
        return found.join(nodes.withColumn("cluster_id", F.lit(0)), F.lit(False)).select("clustering_id", "min_dist", "cluster_id", c("id").alias("complex_id"))
    all_ = nodes.withColumn("clustering_id", F.explode(F.sequence(F.lit(0), F.lit(last))))
    ranks = found.select(c("clustering_id").alias("own"), c("min_dist").alias("d"))
    joined = tree.join(ranks, "d").where(c("own") < F.lit(last))  # links of later distances are in no clustering
    joined = joined.withColumn("clustering_id", F.explode(F.sequence(c("own") + 1, F.lit(last))))
    ways = F.array(F.struct(c("id_a").alias("u"), c("id_b").alias("v")), F.struct(c("id_b").alias("u"), c("id_a").alias("v")))
    links = keep(joined.select("clustering_id", F.explode(ways).alias("x")).select("clustering_id", "x.u", "x.v"))
    labels = _labelled(links, all_.select("clustering_id", "id", c("id").alias("component")), ["clustering_id"])
    firsts = running(labels.where("id = component").select("clustering_id", "component"), ["clustering_id"], [c("component")], {"place": F.lit(1)})
    numbered = labels.join(firsts, ["clustering_id", "component"]).join(found, "clustering_id")
    return numbered.select("clustering_id", "min_dist", (c("place") - 1).cast("int").alias("cluster_id"), c("id").alias("complex_id"))


def components_at(distances: DataFrame, threshold: float) -> DataFrame:
    """(id, component): members linked by distances under `threshold`, component being
    the smallest id; ids without links are their own."""
    # Both ways of each link, and each id with itself, in one pass over the distances.
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    loops = F.array(pair("id_a", "id_a"), pair("id_b", "id_b"))
    found = F.when(F.col("d") < threshold, F.concat(loops, F.array(pair("id_a", "id_b"), pair("id_b", "id_a")))).otherwise(loops)
    all_ = keep(distances.select(F.explode(found).alias("x")).select("x.u", "x.v").distinct())
    return _labelled(all_.where("u <> v"), all_.where("u = v").select(F.col("u").alias("id"), F.col("v").alias("component")), [])


def keep_measured(clusters: DataFrame, measured: DataFrame, key: str = "complex_id") -> DataFrame:
    """Members that were measured; clusters and clusterings left empty vanish."""
    return clusters.join(measured.select(key).distinct(), key, "left_semi")


def identities(clusters: DataFrame) -> DataFrame:
    """(clustering_id, cluster_id, identity): members in order, joined by colons."""
    return clusters.groupBy("clustering_id", "cluster_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("complex_id").cast("string"))), ":").alias("identity"))


def _few_components(links: DataFrame) -> DataFrame:
    """(id, component) of the ends of `links` (id_a, id_b), at most `FEW`, in one group."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            names, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("id_a", "id_b")]), return_inverse=True)
            a, b = ends.reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[least_labels(len(names), a, b)])], names=["id", "component"])

    kind = links.schema["id_a"].dataType.simpleString()
    return links.select("id_a", "id_b").coalesce(1).mapInArrow(work, f"id {kind}, component {kind}")


def components_of(vectors: DataFrame, threshold: float, ident: str = "id", vector: str = "vector", few: int | None = None) -> DataFrame:
    """(id, component), as `components_at` of all distances between vectors, of which only
    those that join components are kept."""
    few = FEW if few is None else few
    links = forest_links(vectors, ident, vector, threshold)
    if links.count() > few:
        links = spanning_tree(links)
    if links.count() <= few:
        ids = vectors.select(F.col(ident).alias("id")).distinct()
        return ids.join(_few_components(links), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    ways = F.array(F.struct(F.col("id_a").alias("u"), F.col("id_b").alias("v")), F.struct(F.col("id_b").alias("u"), F.col("id_a").alias("v")))
    both = keep(links.select(F.explode(ways).alias("x")).select("x.u", "x.v"))
    return _labelled(both, vectors.select(F.col(ident).alias("id")).distinct().withColumn("component", F.col("id")), [])
