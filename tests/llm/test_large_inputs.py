import numpy as np
import pytest

from tessera.llm import pivots


def units(rng, n):
    x = rng.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("number", [256, 1024, 4096, 16_384])
def test_pivots_recall_at_each_number_of_pivots(spark, monkeypatch, number):
    """Pairs just over the threshold, with as many pivots as large tables get."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(pivots, "choose_pivots", lambda vectors, n: units(np.random.default_rng(5), n))
    a, r = units(rng, 1500), units(rng, 1500)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in pivots.near_duplicates(df, pivots=number).collect())
    print(f"{number} pivots: {found} of 3000")
    assert 0.99 * 3000 <= found <= 3000
