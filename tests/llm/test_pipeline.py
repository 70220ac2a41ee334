import hashlib
from collections import Counter

import numpy as np
import sentencepiece

import corpus_pipeline
from tessera.llm import toxicity
from tessera.llm.queries import tokenizer

from .helpers import docs, hard_rows
from .test_shingles import alike, brute_shingles
from .test_text import brute_components, brute_targets


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, (toxic, near, mixing, last) = docs.columns, [f for _, f in corpus_pipeline.STAGES]

    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert name == "last" or out.columns == names
        return out, out.collect()

    before = docs.collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    one, rows = written(toxic(spark, docs, sf), "toxic")
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before if model.score(r.text) < 0.5)

    two, kept = written(near(spark, one, sf), "near")
    label = brute_components([brute_shingles(r.text) for r in rows], alike)
    least = {}
    for i, r in enumerate(rows):
        least[label[i]] = min(least.get(label[i], r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in kept) == sorted(least.values())

    three, mixed = written(mixing(spark, two, sf), "mixed")
    size = {r.doc_id: len(r.text.encode().split()) for r in kept}
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    sums = Counter()
    for r in kept:
        sums[r.source] += size[r.doc_id]
    taken, target = Counter(), brute_targets(dict(sums))
    for r in mixed:
        taken[r.source] += size[r.doc_id]
    assert all(abs(taken[s] - t) <= max(size[r.doc_id] for r in kept if r.source == s) / 2 for s, t in target.items())

    _, out = written(last(spark, three, sf), "last")
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    ids = {r.doc_id: np.array(lib.encode(r.text, add_bos=True, add_eos=True), "<u4") for r in kept}
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out) == Counter((r.doc_id, len(ids[r.doc_id]), hashlib.sha256(ids[r.doc_id].tobytes()).hexdigest()) for r in mixed)


def test_each_stage_takes_hard_rows(spark, sf):
    """Nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""
    rows = docs(spark, clash=True)
    toxic, near, mixing, last = (f for _, f in corpus_pipeline.STAGES)
    count = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    all_ = Counter((r[0], r[1]) for r in hard_rows())
    one = toxic(spark, rows, sf)
    assert one.columns == rows.columns and not count(one) - all_ and (None, None) in count(one)
    two = near(spark, rows, sf)
    assert two.columns == rows.columns and sorted(i for i, _ in count(two).elements() if i is not None) == [1, 4, 7, 9, 10, 11]
    assert sum(n for (i, _), n in count(two).items() if i is None) == 2
    three = mixing(spark, rows, sf)
    assert three.columns == rows.columns and all(n <= 2 * all_[k] for k, n in count(three).items()) and set(count(three)) <= set(all_)
    four = last(spark, rows, sf)
    assert Counter(r.doc_id for r in four.collect()) == Counter(r[0] for r in hard_rows())
    for stage in (toxic, near, mixing, last):
        assert stage(spark, docs(spark, []), sf).collect() == []


def test_no_group_is_left_without_a_document(spark):
    """Documents of two texts: each text's group keeps one, whoever else has the ident."""
    from tessera.llm import shingles

    from .helpers import prose

    a, b, c = (prose(40, k) for k in (1, 2, 3))
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (1, a), (4, a + " x"), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `node of the text`", "2 AS node")
    kept = sorted((r.doc_id or 0, r.text) for r in shingles.one_of_each(df).collect())
    assert kept == sorted([(1, a), (1, b), (3, c), (0, b)])
