import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import shingles

from .helpers import DOCS, docs, prose
from .test_text import brute_components


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) * 5 >= len(a | b) * 4


def edited(seed, copies=6, words=300):
    """Prose and copies of it, with more words replaced in each."""
    rng = np.random.default_rng(seed)
    base = [f"w{v}" for v in rng.integers(0, 5000, words)]
    out = [" ".join(base)]
    for k in range(copies):
        own = list(base)
        for at in rng.choice(words, 1 + 2 * k, replace=False):
            own[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_stage_keeps_one_of_each_group_at_five_words_and_0_8(spark, block, monkeypatch):
    monkeypatch.setattr(shingles.one_of_each, "__defaults__", (*shingles.one_of_each.__defaults__[:-1], block))
    texts = [t for seed in range(25) for t in edited(seed)] + [None, "", " \n", "a b", "A  b", "a b c"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "a", 1), (None, texts[1], "en", "a", 1)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    label = brute_components([brute_shingles(t) for t in texts], alike)
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(i for i in label if label[i] == i)
    assert sum(r.doc_id is None for r in out) == 1


def test_stage_equals_brute_force_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = df.collect()
    label = brute_components([brute_shingles(r.text) for r in rows], alike)
    least = {}
    for i, r in enumerate(rows):
        least[label[i]] = min(least.get(label[i], r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, sf).collect()) == sorted(least.values())


def test_columns_of_any_name_stay(spark):
    df = docs(spark, [(2, prose(80), "en", "a", 1), (1, prose(80), "en", "a", 1)], clash=True)
    out = shingles.one_of_each(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]
    assert shingles.one_of_each(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1000, 100_000, 10_000_000, 10_000_000_000])
def test_candidates_recall_at_0_8(n):
    """Sets of a similarity of exactly 0.8: nearly all share a bucket and are confirmed."""
    rng = np.random.default_rng(1)
    gram = np.full((shingles.BITS, shingles.BITS), n / 4)
    np.fill_diagonal(gram, n / 2)
    groups, ts = shingles.plan(n, gram, 0.8)
    q = shingles.expected(0.8)
    most = q * shingles.CONFIRM + shingles.ERRORS * (shingles.CONFIRM * q * (1 - q)) ** 0.5
    hits = 0
    for _ in range(1000):
        x = rng.integers(0, 2**64, 90, dtype=np.uint64)  # 80 in both of 100
        a, b = (np.unpackbits(shingles.fingerprint(v).view(np.uint8), bitorder="little") for v in (x, np.append(x[10:], rng.integers(0, 2**64, 10, dtype=np.uint64))))
        apart = a != b
        hits += any(apart[g].sum() <= t for g, t in zip(groups, ts) if t >= 0) and apart[: shingles.CONFIRM].sum() <= most
    assert hits >= 990


def test_pairs_in_buckets_grow_slower_than_the_square():
    """Pairs compared for each row, by random bits: a thousand times the rows make far
    less than a thousand times of them, and no more buckets than the exponent allows."""
    compared, buckets = [], []
    for n in (10_000_000, 10_000_000_000):
        gram = np.full((shingles.BITS, shingles.BITS), n / 4)
        np.fill_diagonal(gram, n / 2)
        groups, ts = shingles.plan(n, gram, 0.8)
        used = [(len(g), shingles.probes(len(g), t)) for g, t in zip(groups, ts) if t >= 0]
        buckets.append(sum(v for _, v in used))
        compared.append(sum(v * v * n / 2 / 2**w for w, v in used))
    assert compared[1] < 20 * compared[0] and buckets[1] < 20 * buckets[0] and buckets[0] < 400


def test_groupings_differ():
    gram = np.full((shingles.BITS, shingles.BITS), 250.0)
    np.fill_diagonal(gram, 500.0)
    a, b = (shingles.grouping(1000, gram, 20, k) for k in (0, 1))
    assert list(map(len, a)) == list(map(len, b)) == [26] * 12 + [25] * 8
    for of in (a, b):
        assert sorted(i for g in of for i in g) == list(range(shingles.BITS))
    assert max(len(set(x) & set(y)) for x in a for y in b) < 10


def test_thresholds_add_up_to_the_recall():
    assert shingles.allocate([[5.0, 9.0], [1.0, 30.0]], [[1.0, 2.0], [1.0, 1.1]], 2.0)[1] == [0, 0]
    assert shingles.allocate([[50.0, 60.0], [1.0, 30.0]], [[1.0, 2.0], [1.0, 2.0]], 2.0)[1] == [-1, 1]
    assert shingles.allocate([[1.0, 2.0]], [[0.1, 0.2]], 2.0)[0] == float("inf")
