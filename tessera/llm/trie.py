"""The prefix trie of conversations: every distinct sequence of first turns is a node.

A node belongs to its smallest member. Along a conversation, nodes belong to ever larger
members, so those it owns are its last ones: a chain. Chains hang on nodes of others, and
what holds for a subtree is added up from chain to chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .runs import running
from .store import drop, keep, slices

#: Parts of 32 bits of a prefix's digest, whose sums need no more than 63 bits.
PARTS = 4
#: Bytes of joined ids that a task makes before it passes them on.
PIECE = 1 << 16
DIGESTS = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
PIECES = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, at, sign, words): turns numbered from 0 within their conversation by turn
    (null first; equal turns by the digest of role and text), null role and text empty.
    Rows without a conv_id are of no conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    sign = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.unhex(sign).alias("sign"), word_count("text").alias("words"))
    return running(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("sign")], {"at": F.lit(1).cast("long")}).select("conv", (F.col("at") - 1).alias("at"), "sign", "words")


def shared_starts(turns: DataFrame, family: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations c rebuilt as the first h turns of c - c % `family` and then their own
    from the h-th on, h = crc32(c) % (`most` + 1): turns (conv, depth from 1, sign, words)
    and conversations (conv, length), those without turns too."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1), "base": F.col("conv") - F.col("conv") % family})
    lengths = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(lengths, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = keep(convs.withColumn("length", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs")
    starts = turns.where(F.col("at") < most).withColumnRenamed("conv", "base")
    lent = starts.join(convs.select("conv", "base", "h"), "base").where("at < h").select("conv", (F.col("at") + 1).alias("depth"), "sign", "words")
    own = turns.join(convs.select("conv", "h", "lent"), "conv").where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("lent") + 1).alias("depth"), "sign", "words")
    return lent.unionByName(own), convs.select("conv", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, prefix, words): the digest of the first `depth` turns. It is made of
    sums of what each turn and its depth hash to, so it is a running sum."""
    hashed = turns.withColumn("hash", F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("sign")), 256)).drop("sign")
    pieces: dict[str, Column] = {f"s{i}": F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long") for i in range(PARTS)}
    summed = running(hashed, "conv", [F.col("depth")], pieces)
    return summed.select("conv", "depth", F.unhex(F.md5(F.concat_ws(":", "depth", *pieces).cast("binary"))).alias("prefix"), "words")


def owned_from(prefixed: DataFrame, nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, length, first, above): the first depth that each conversation owns (one more
    than its length if none) and who owns the node before it (null: the root).

    Nodes of a conversation belong to others up to some depth and to itself from there
    on, so all conversations halve what is left to search in one round of joins."""
    longest = convs.agg(F.max("length")).first()[0] or 0
    state = convs.select("conv", "length", F.lit(1).cast("long").alias("first"), (F.col("length") + 1).alias("end"), F.lit(None).cast("long").alias("above"))
    owners, kept = nodes.select("prefix", "owner"), []
    for _ in range(int(longest).bit_length()):  # (length + 1) places take so many halvings
        probe = state.withColumn("depth", F.when(F.col("first") < F.col("end"), F.shiftright(F.col("first") + F.col("end"), 1)))
        met = probe.join(prefixed.select("conv", "depth", "prefix"), ["conv", "depth"], "left").join(owners, "prefix", "left")
        mine, open_ = F.col("owner") == F.col("conv"), F.col("depth").isNotNull()
        step = {"first": F.when(open_ & ~mine, F.col("depth") + 1).otherwise(F.col("first")), "end": F.when(open_ & mine, F.col("depth")).otherwise(F.col("end")), "above": F.when(open_ & ~mine, F.col("owner")).otherwise(F.col("above"))}
        state = keep(met.select("conv", "length", *(e.alias(n) for n, e in step.items())), "search")
        kept.append(state)
    for table in kept[:-1]:
        drop(table)
    return state.drop("end")


def added_up(chains: DataFrame, values: list[str]) -> DataFrame:
    """`chains` (conv, up, values) with each value summed over the chain and all below it.

    Every round adds what hangs exactly 1, 2, 4, ... chains below, which has by then the
    sum of as many levels, and doubles the reach: as many rounds as bits of the height."""
    now = keep(chains.select("conv", "up", *values), "sums")
    while not now.where("up IS NOT NULL").isEmpty():
        below = now.where("up IS NOT NULL").groupBy("up").agg(*(F.sum(v).alias(f"more_{v}") for v in values)).withColumnRenamed("up", "conv")
        next_up = now.select(F.col("conv").alias("up"), F.col("up").alias("up_up"))
        met = now.join(below, "conv", "left").join(next_up, "up", "left")
        after = keep(met.select("conv", F.col("up_up").alias("up"), *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values)), "sums")
        drop(now)
        now = after
    return now.drop("up")


def _joined(most: int):
    """Runs of ids of one node, in order, as comma-joined pieces with the id they begin at."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0
        for batch in batches:
            pieces = []
            for owner, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv")), strict=True):
                if node != (owner, depth) or size > most:
                    if held:
                        pieces.append((*node, first, ",".join(held)))
                    node, first, held, size = (owner, depth), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield _rows(PIECES, pieces)
        yield _rows(PIECES, [(*node, first, ",".join(held))] if held else [])

    return work


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order, fed one after the other."""
    node, sha = None, hashlib.sha256()
    for batch in slices(batches):
        out = []
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids")), strict=True):
            if node == (owner, depth):
                sha.update(b",")
            else:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = (owner, depth), hashlib.sha256()
            sha.update(ids.encode())
        yield _rows(DIGESTS, out)
    yield _rows(DIGESTS, [(*node, sha.hexdigest())] if node is not None else [])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(schema)], schema=schema)


def ends_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(owner, depth, ends_sha256) of `ends` (owner, depth, conv): SHA-256 of the ids of a
    node, ascending and comma-joined. Tasks join the ids of their range, so what one task
    hashes for a node with very many ends is a few long pieces, one at a time."""
    ranged = ends.repartitionByRange("owner", "depth", "conv").sortWithinPartitions("owner", "depth", "conv")
    pieces = ranged.mapInArrow(_joined(piece), "owner long, depth long, first long, ids string")
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(_hashed, "owner long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of `turns` (conv, depth from 1 without gaps, sign,
    words): conv_id (its smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `convs` (conv, length) are the members, those without turns too; none, no nodes. Equal
    conversations end at one node. Turns are equal if their signs are."""
    prefixed = keep(prefixes(turns), "prefixes")
    nodes = keep(prefixed.groupBy("prefix").agg(F.min("conv").alias("owner"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "nodes")
    search = owned_from(prefixed, nodes, convs)
    total = convs.agg(F.min("conv").alias("root"), F.count("*").alias("n")).first()
    search = keep(search.withColumn("above", F.coalesce("above", F.lit(total["root"]).cast("long"))), "chains")

    # The root is the top of the chain of the smallest conversation, so that one hangs on nothing.
    is_root = F.col("conv") == F.lit(total["root"])
    owned = search.where((F.col("first") <= F.col("length")) | is_root)
    hung = owned.where(~is_root).select(F.col("above").alias("owner"), (F.col("first") - 1).alias("depth"), "conv")
    children = keep(hung.groupBy("owner", "depth").agg(F.count("*").alias("hung")), "children")
    root = convs.groupBy().agg(F.min("conv").alias("owner"), F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("words")).where("owner IS NOT NULL")
    every = nodes.select("owner", "depth", "n_convs", F.col("words").cast("long").alias("words")).unionByName(root)
    every = every.join(children, ["owner", "depth"], "left").join(owned.select(F.col("conv").alias("owner"), "length", "first", "above"), "owner")
    every = keep(every.select("owner", "depth", "n_convs", "first", "above", F.coalesce("hung", F.lit(0)).alias("hung"), (F.col("depth") < F.col("length")).cast("long").alias("goes_on"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "every")

    own = every.groupBy(F.col("owner").alias("conv")).agg(F.sum(((F.col("hung") + F.col("goes_on")) == 0).cast("long")).alias("leaves"), F.sum("saved").alias("saved"))
    chains = own.join(owned.select("conv", F.when(~is_root, F.col("above")).alias("up")), "conv")
    sums = added_up(chains, ["leaves", "saved"])
    below = hung.join(sums, "conv").groupBy("owner", "depth").agg(F.sum("leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"))
    with_below = every.join(below, ["owner", "depth"], "left")
    leaf = ((F.col("hung") + F.col("goes_on")) == 0).cast("long")
    subtree = running(with_below, "owner", [F.col("depth").desc()], {"n_leaves": leaf + F.coalesce("below_leaves", F.lit(0)), "saved_tokens": F.col("saved") + F.coalesce("below_saved", F.lit(0))})

    at = F.when(F.col("length") == 0, F.lit(total["root"]).cast("long")).when(F.col("first") <= F.col("length"), F.col("conv")).otherwise(F.col("above"))
    ends = ends_digests(search.select(at.alias("owner"), F.col("length").alias("depth"), "conv"))
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") > F.col("first"), F.col("owner")).when(F.col("owner") == F.lit(total["root"]), F.col("owner")).otherwise(F.col("above"))
    out = subtree.join(ends, ["owner", "depth"], "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", (F.col("hung") + F.col("goes_on")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def shared_trie(conversations: DataFrame) -> DataFrame:
    """The trie of `conversations` (conv_id, turn, role, text) rebuilt by `shared_starts`."""
    turns, convs = shared_starts(keep(turns_of(conversations), "turns"))
    return trie(turns, convs)
