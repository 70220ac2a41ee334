import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import trie
from tessera.llm.runs import running

CONVS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All nodes by plain loops."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, trie_sign(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = lambda p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(path))))
        saved = sum((len(members[p]) - 1) * words(p[-1][1]) for p in below if p)
        up = min(members[path[:-1]]) if path else None
        out.append((min(cs), len(path), up, len(cs), len(children(path)), sum(not children(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_sign(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).digest()


def got(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(r) for r in trie.shared_trie(df).select(names).collect())


def hard_convs():
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c % 3} \t words") for c in (20, 21, 22, 23, 25, 40, 41, 47) for t in range(c % 5 + 1)]
    rows += [(60, None, "user", "first"), (60, 3, None, None), (60, 1, "user", ""), (61, 0, "a", "b"), (61, 0, "a", "b"), (61, 0, "", "a:b"), (85, 0, "user", "only"), (86, 0, None, "x"), (86, 5, None, "y")]
    rows += [(None, 0, "user", "of no conversation"), (99, 7, "user", "é \u0000 z"), (100, 0, "s", "y " * 5000), (101, 0, "s", "y " * 5000), (119, 2, "s", "y " * 5000)]
    return rows


def test_every_node_of_hard_conversations(spark):
    df = spark.createDataFrame(hard_convs(), CONVS).selectExpr("*", "1 AS at", "2 AS depth", "'x' AS owner", "3 AS first", "4 AS `a.b`")
    assert got(df) == brute(hard_convs())


def test_random_conversations_dealt_in_several_ways(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice("ab"), rng.choice(["x", "y y"])) for c in rng.sample(range(-5, 300), 120) if c >= 0 for t in range(rng.randrange(1, 9))]
    want = brute(rows)
    for parts in (1, 6):
        assert got(spark.createDataFrame(rows, CONVS).repartition(parts)) == want


def test_chains_that_hang_on_chains(spark):
    """Each conversation leaves the one before it a turn later: 40 chains, one below the other."""
    deep = [(c, t, "u", f"t{t}" if t < c - 1000 else f"own {c}") for c in range(1000, 1040) for t in range(42)]
    turns = trie.turns_of(spark.createDataFrame(deep, CONVS)).select("conv", (F.col("at") + 1).alias("depth"), "sign", "words")
    out = {(r.conv_id, r.depth): r for r in trie.trie(turns, turns.groupBy("conv").agg(F.count("*").alias("length"))).collect()}
    assert out[1000, 0].n_leaves == 40 and out[1000, 0].n_convs == 40 and out[1000, 0].n_children == 2
    assert [out[c, c - 1000].parent_conv_id for c in range(1002, 1039)] == list(range(1001, 1038))
    assert all(out[c, d].n_leaves == 1 and out[c, d].saved_tokens == 0 for c in range(1001, 1039) for d in (41, 42))
    assert out[1001, 1].saved_tokens == sum(39 - k for k in range(1, 40)) and len(out) == 1 + 39 + sum(42 - k for k in range(39)) + 42 - 39


def test_no_conversations_no_nodes(spark):
    assert got(spark.createDataFrame([], CONVS)) == []
    assert got(spark.createDataFrame([(None, 1, "a", "b")], CONVS)) == []


@pytest.mark.parametrize("piece", [0, 40])
def test_digests_of_very_many_ends(spark, piece):
    ids = [i * 3 % 1009 for i in range(1009)]
    df = spark.createDataFrame([(0, 2, c) for c in ids] + [(5, 2, 7)], "owner long, depth long, conv long").repartition(5)
    out = {(r.owner, r.depth): r.ends_sha256 for r in trie.ends_digests(df, piece).collect()}
    assert out == {(0, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (5, 2): hashlib.sha256(b"7").hexdigest()}


def test_running_sums_over_parts(spark):
    rows = [(k, i, i % 5) for k, n in ((1, 3000), (2, 5), (None, 400), (3, 1)) for i in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = running(spark.createDataFrame(rows, "k long, i long, x long").repartition(3), "k", [F.col("i").desc()], {"s": F.col("x"), "n": F.lit(1)})
        out = {(r.k, r.i): (r.s, r.n) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    sizes = {1: 3000, 2: 5, None: 400, 3: 1}
    assert out == {(k, i): (sum(j % 5 for j in range(i, sizes[k])), sizes[k] - i) for k, i, _ in rows}
