import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.residues import PROPERTIES, substitution_scores
from tessera.operators import alignment, clustering, crossval, features, regression, spatial, statistics, vectors
from tessera.plans import evaluation, options
from tessera.plans.options import Options


def points(spark, n=60, seed=0, spread=8.0):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(2)), int(rng.integers(1, 3)), "CHON"[rng.integers(4)], *map(float, (rng.random(3) - 0.5) * spread), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "complex int, side int, type string, x double, y double, z double, serial int")


def far(a, b):
    return float(np.linalg.norm(np.array(a[3:6]) - np.array(b[3:6])))


@pytest.mark.parametrize("reach", [0.7, 3.0, 20.0])
def test_grid_join_is_exact(spark, reach):
    rows, df = points(spark)
    got = sorted((r.a_serial, r.b_serial) for r in spatial.cross_pairs(df, reach).collect())
    assert got == sorted((a[6], b[6]) for a in rows for b in rows if a[0] == b[0] and a[1] == 1 and b[1] == 2 and far(a, b) <= reach)


def test_nearest_hydrogen_partners(spark):
    rows, df = points(spark, 80)
    for f, same in ((spatial.hydrogen_donors, True), (spatial.interface_acceptors, False)):
        got = {r.serial: r[3] for r in f(df).collect()}
        want = {}
        for a in rows:
            near = [(far(a, b), b[6]) for b in rows if a[2] == "H" != b[2] and a[0] == b[0] and (a[1] == b[1]) == same and far(a, b) <= 3]
            if near:
                want[a[6]] = min(near)[1]
        assert got == want


def test_histogram_bins_are_closed_above(spark):
    rows = [(1, 1, "C", 0.0, 0.0, 0.0)] + [(1, 2, "N", float(d), 0.0, 0.0) for d in (1.0, 2.0, 2.5, 4.0, 4.5)]
    df = spark.createDataFrame(rows, "complex int, side int, type string, x double, y double, z double")
    assert {r.bin: r.n for r in features.distance_histogram(df, 1.0, 4.0, 3).collect()} == {0: 1, 1: 1, 2: 1}
    edges = features.geometric_edges(1.0, 4.0, 3)
    assert edges[0] == 1.0 and edges[-1] == 4.0 and abs((edges[2] - edges[1]) / (edges[1] - edges[0]) - 1.5) < 1e-9
    vec = features.self_histogram_features(features.distance_histogram(df, 1.0, 4.0, 3), ["N", "C"], 3).first().features
    assert list(vec) == [0, 0, 0, 1, 1, 1, 0, 0, 0]


def test_hydrogen_bond_angle(spark):
    df = spark.sql("SELECT 1 complex, 'N' donor_type, 'O' acceptor_type, named_struct('x', 0D, 'y', 0D, 'z', 0D) d, named_struct('x', 1D, 'y', 0D, 'z', 0D) h, named_struct('x', 3D, 'y', 0D, 'z', 0D) a")
    row = features.hydrogen_bonds(df).first()
    assert row.angle_bin == 9 and row.distance_bin == 5


# -- alignment ---------------------------------------------------------------------


def slow_align(q, t, mode, scores, gaps):
    opened, extended = gaps
    local = mode == "local"
    m = np.zeros((len(q) + 1, len(t) + 1))
    gq, gt = np.full_like(m, -opened), np.full_like(m, -opened)
    best = -99_999_999
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            prior = [m[i - 1, j - 1], gq[i - 1, j - 1], gt[i - 1, j - 1]]
            m[i, j] = max([*prior, 0] if local else prior) + scores(q[i - 1], t[j - 1])
            floor = (lambda v: max(v, 0)) if local else (lambda v: v)
            ext = (lambda g: g - extended if g > 0 else -opened) if local else (lambda g: g - extended)
            gq[i, j] = max(floor(m[i, j - 1]) - opened, ext(gq[i, j - 1]))
            gt[i, j] = max(floor(m[i - 1, j]) - opened, ext(gt[i - 1, j]))
            if local or i == len(q) or j == len(t):
                best = max(best, m[i, j])
    return best


@settings(max_examples=60, deadline=None)
@given(st.text("ARNDWC", min_size=0, max_size=14), st.text("ARNDWC", min_size=0, max_size=14), st.sampled_from(["local", "overlap"]))
def test_alignment_matches_a_plain_program(q, t, mode):
    table = substitution_scores()
    score, qa, qb, ta, tb = alignment.align(q, t, mode)
    assert score == slow_align(q, t, mode, lambda a, b: table[a, b], alignment.PROTEIN_GAPS)
    if q and t:
        assert 0 <= qa <= qb < len(q) and 0 <= ta <= tb < len(t)


def test_alignment_of_nucleotides_and_ranges():
    assert alignment.align("ACGT", "acgt", alphabet="nucleotide") == (8, 0, 3, 0, 3)
    assert alignment.align("RRR", "AGA", alphabet="nucleotide")[0] == 6
    assert alignment.align("NAN", "AAA", alphabet="nucleotide", mask_n=True)[0] == 2
    assert alignment.align("GGGWWWGGG", "DDWWWDD")[1:] == (3, 5, 2, 4)
    assert alignment.align("", "A") == (-99_999_999, -1, -1, -1, -1)
    with pytest.raises(ValueError):
        alignment.align("A1", "A")


def test_substitution_scores():
    s = substitution_scores()
    assert len(s) == 23 * 23 and all(s[a, b] == s[b, a] for a, b in s)
    # The published rows of the ambiguous letters, and one of the rest.
    order = "ARNDCQEGHILKMFPSTWYVBZX"
    for letter, row in {"B": "-2 -1 3 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4 1 -1", "Z": "-1 0 0 1 -3 3 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -3 -2 -2 1 4 -1", "W": "-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11 2 -3 -4 -3 -1"}.items():
        assert [s[letter, x] for x in order] == list(map(int, row.split()))
    assert sum(map(len, PROPERTIES.values())) == 17


def test_alignment_distances(spark):
    seqs = [("a", 1, "ARNDW"), ("a", 2, "CCWWC"), ("b", 1, "CCWWC"), ("b", 2, "ARNDW"), ("c", 1, "GGGGG"), ("c", 2, "PPPPP")]
    got = {(r.id_a, r.id_b): r.d for r in alignment.alignment_distances(spark.createDataFrame(seqs, "complex_id string, side int, sequence string"), block=1).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and got["a", "b"] == 0.0 and abs(got["a", "c"] - got["b", "c"]) < 1e-12 and got["a", "c"] > 0.5


def test_batches_give_what_single_pairs_give():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("ARNDWCQEG"), int(rng.integers(0, 25))))
    pairs = [(word(), word()) for _ in range(120)] + [("", "A"), ("A", "")]
    for mode in ("local", "overlap"):
        one = [alignment.align(x, y, mode) for x, y in pairs]
        assert [tuple(r) for r in alignment.align_pairs(pairs, mode)] == one
        assert alignment.align_pairs(pairs, mode, starts=False)[:, 0].tolist() == [r[0] for r in one]


def test_a_cut_keeps_what_is_near(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list(part), 30)) for part in ("ARND", "ARND", "WCFY", "WCFY", "HKPT", "ARND")]
    seqs = [(f"c{i}", side, s[side:] + "AW"[side - 1]) for i, s in enumerate(base) for side in (1, 2)]
    df = spark.createDataFrame(seqs, "complex_id string, side int, sequence string")
    every = {(r.id_a, r.id_b): r.d for r in alignment.alignment_distances(df, block=2).collect()}
    assert len(every) == 15
    for cut in (0.0, 0.75, 0.9, 2.0):
        assert {(r.id_a, r.id_b): r.d for r in alignment.alignment_distances(df, block=2, cut=cut).collect()} == {k: d for k, d in every.items() if d <= cut}
    code, table = alignment.protein_table()
    for _, _, x in seqs:
        for _, _, y in seqs:
            assert alignment.align(x, y)[0] <= alignment.score_bound(alignment.encoded(x, code), alignment.encoded(y, code), table)


# -- clustering ----------------------------------------------------------------------


@pytest.mark.parametrize("few", [4, 500_000])
def test_single_linkage(spark, few):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 40, 14).astype(float)
    d = [(f"m{i:02}", f"m{j:02}", float(abs(x[i] - x[j]))) for i in range(14) for j in range(i + 1, 14)]
    out = clustering.single_linkage(spark.createDataFrame(d, "id_a string, id_b string, d double").repartition(5), 3, few).collect()
    by = {}
    for r in out:
        by.setdefault((r.clustering_id, r.min_dist), {}).setdefault(r.cluster_id, set()).add(r.complex_id)
    keys = sorted(by)
    assert [k[0] for k in keys] == list(range(len(keys))) and [k[1] for k in keys] == sorted({k[1] for k in keys})
    for (_, low), groups in by.items():
        assert len(groups) >= 3 and sum(map(len, groups.values())) == 14
        names = [f"m{i:02}" for i in range(14)]
        label = {v: min(g) for g in groups.values() for v in g}
        between = [abs(x[i] - x[j]) for i in range(14) for j in range(i) if label[names[i]] != label[names[j]]]
        assert min(between) == low
        for g in groups.values():  # linked by less than the distance
            seen, todo = set(), [min(g)]
            while todo:
                v = todo.pop()
                seen.add(v)
                todo += [u for u in g - seen if abs(x[int(u[1:])] - x[int(v[1:])]) < low]
            assert seen == g
    got = {r.id: r.component for r in clustering.components_at(spark.createDataFrame(d, "id_a string, id_b string, d double"), keys[1][1]).collect()}
    assert got == {v: min(g) for g in by[keys[1]].values() for v in g}


def plain_forest(links):
    """Links of the minimum spanning forest by (d, a, b), one after the other."""
    group = {v: {v} for _, a, b in links for v in (a, b)}
    out = []
    for d, a, b in sorted(links):
        if group[a] is not group[b]:
            out.append((d, a, b))
            group[a] |= group[b]
            for v in group[b]:
                group[v] = group[a]
    return out


@pytest.mark.parametrize("few", [0, 3, 10**6])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_spanning_trees_by_rounds_and_in_a_group(spark, few, kind):
    rng = np.random.default_rng(few % 7)
    name = (lambda i: int(i)) if kind == "long" else (lambda i: f"n{i:03}")
    links = {(int(rng.integers(0, 6)) / 2.0, name(a), name(b)) for a, b in rng.integers(0, 60, (150, 2)) if a < b}
    links |= {(1.0, name(100 + i), name(101 + i)) for i in range(40)}  # a long chain of equal distances
    rows = [(b, a, d) if i % 2 else (a, b, d) for i, (d, a, b) in enumerate(sorted(links))] + [(name(5), name(5), 0.0), (name(1), name(2), None)]
    df = spark.createDataFrame(rows, f"id_a {kind}, id_b {kind}, d double").repartition(4)
    got = sorted((r.d, r.id_a, r.id_b) for r in clustering.spanning_tree(df, few).collect())
    assert got == plain_forest(links)
    assert clustering.spanning_tree(df.where("false"), few).collect() == [] and clustering.single_linkage(df.where("false"), 2, few).collect() == []


# -- cross-validation, regressors, statistics ---------------------------------------------


def test_folds_are_whole_and_even(spark):
    members = spark.createDataFrame([(c, k, f"x{k}_{i}") for c in (0, 1) for k in range(7 if c == 0 else 3) for i in range(2)], "clustering_id int, cluster_id int, complex_id string")
    rows = crossval.folds(members, 4, 5, 1).collect()
    assert {r.clustering_id for r in rows} == {0} and len(rows) == 28
    for t in range(4):
        sizes = [sum(r.trial == t and r.fold == f for r in rows) for f in range(5)]
        assert sorted(sizes) == [1, 1, 1, 2, 2]
    assert len({tuple(r.fold for r in sorted(rows) if r.trial == t) for t in range(4)}) > 1


def slow_split(x, y, leaf):
    best = None
    for f in range(x.shape[1]):
        for t in sorted(set(x[:, f]))[1:]:
            left = x[:, f] < t
            if left.sum() < leaf + 1 or (~left).sum() < leaf:
                continue
            below = x[left, f].max()
            sse = sum(((v - v.mean()) ** 2).sum() for v in (y[left], y[~left]))
            if best is None or sse < best[0] - 1e-9:
                best = (sse, f, (below + t) / 2)
    return best


@pytest.mark.parametrize("leaf", [1, 3])
def test_best_split(spark, leaf):
    rng = np.random.default_rng(leaf)
    for n in (2, 3, 9, 40):
        x, y = rng.integers(0, 8, (n, 4)).astype(float), rng.normal(size=n)
        want, got = slow_split(x, y, leaf), regression.best_split(x, y, np.ones(n), np.arange(4), leaf)
        assert got == (want and want[1:])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:, 0], y)], "x double, y double")
    assert abs(crossval.best_splits(df, leaf).first().threshold - slow_split(x[:, :1], y, leaf)[2]) < 1e-9


def test_trees_fit_and_forests_repeat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = np.where(x[:, 2] > 0.3, 5.0, -1.0)
    tree = regression.build_tree(x, y, np.ones(80), np.arange(5), 1)
    assert tree.splits() >= 1 and tree.residual() < 1e-12 and np.allclose(tree.predict(x), y)
    options = regression.ForestOptions(trees=7, data_bag=0.5)
    one, two = (regression.predict(regression.build_forest(x, y, np.ones(80), options, "1:2", list(range(80))), x) for _ in range(2))
    assert (one == two).all() and np.corrcoef(one, y)[0, 1] > 0.9
    assert len(regression.build_tree(x[:2], y[:2], np.ones(2), np.arange(5), 1).feature) == 1  # two rows never split


def test_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    y, w = x @ [1.0, -2.0, 0.5] + 3, rng.random(50) + 0.1
    assert np.allclose(regression.least_squares(x, y, w, bias=True), [1, -2, 0.5, 3])
    df = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)], "features array<double>, response double, weight double")
    assert np.allclose(regression.fit_linear(df, weight="weight", bias=True), [1, -2, 0.5, 3])
    same = np.column_stack([x[:, 0], x[:, 0]])
    assert np.allclose(regression.least_squares(same, x[:, 0], np.ones(50)), [0.5, 0.5])


def test_statistics(spark):
    rng = np.random.default_rng(2)
    o, p, c = rng.normal(size=40), rng.normal(size=40), rng.integers(0, 5, 40)
    df = spark.createDataFrame([(float(a), float(b), int(k)) for a, b, k in zip(o, p, c)], "observed double, predicted double, cluster int")
    r = statistics.statistics(df).first()
    assert abs(r.pearson - np.corrcoef(o, p)[0, 1]) < 1e-9 and abs(r.rmse - np.sqrt(((o - p) ** 2).mean())) < 1e-9 and abs(r.r2 - (1 - ((o - p) ** 2).sum() / ((o - o.mean()) ** 2).sum())) < 1e-9
    w = np.array([1 / (c == k).sum() for k in c])
    r = statistics.statistics(df, equal_clusters=True).first()
    assert abs(r.rmse - np.sqrt((w * (o - p) ** 2).sum() / w.sum())) < 1e-9
    assert statistics.statistics(df.withColumn("predicted", df.predicted * 0)).first().pearson is None
    real = statistics.permutation_p(df.withColumn("predicted", df.observed), 40, 1).first()
    assert real.r == pytest.approx(1.0) and real.p == 0.0
    assert statistics.permutation_p(df, 40, 1).first() == statistics.permutation_p(df, 40, 1).first()
    assert statistics.permutation_p(df, 0, 1).first().p == -1.0 and statistics.permutation_p(df.where("cluster = 1"), 5, 1).first().p is None
    with pytest.raises(Exception, match="differ"):
        other = df.withColumn("id", df.cluster).limit(1)
        statistics.r2_against(other, other.withColumn("observed", other.observed + 1), "id").collect()


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(i)) for i, v in enumerate(x)], "id long, vector array<double>, response double")
    for itself in (False, True):
        got = {r.id: r.prediction for r in vectors.nearest_neighbours(df, df, 4, itself=itself, block=25).collect()}
        for i in range(60):
            order = sorted((((x[j] - x[i]) ** 2).sum(), j) for j in range(60) if itself or j != i)
            assert abs(got[i] - np.mean([j for _, j in order[:4]])) < 1e-9


def test_options_are_checked():
    for bad in ({"bins": 0}, {"low": 5.0, "high": 4.0}, {"fold": 1}, {"feature": "x"}, {"feature": "distance_histogram_log", "low": 0.0}, {"permutations": 1}, {"years": (2000, 1999)}, {"model": "x"}, {"forest": regression.ForestOptions(data_bag=0)}, {"scores": "a", "only_scores": "b"}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_experiment(spark, tmp_path):
    from .test_sources import HEADER, atom

    rng = np.random.default_rng(6)
    names, lines = "ALA GLY TRP SER LEU".split(), []
    for k in range(12):
        atoms = [atom(i, "AB"[i % 2], i // 2, names[rng.integers(5)], tuple(rng.random(3) * 6), "CNOH"[rng.integers(4)]) for i in range(24)]
        (tmp_path / f"{k:02}xy.pdb").write_text("\n".join(atoms))
        lines.append(f"{k:02}xy,NMR,2009,Kd,=,{10.0 ** -(4 + k % 5)}")
    (tmp_path / "aff.csv").write_text("\n".join([HEADER.rsplit(",", 2)[0], *lines, "zzzz,NMR,2009,Kd,=,1e-3"]))
    (tmp_path / "s.csv").write_text("\n".join(f"{k:02}xy,{k}" for k in range(12)))
    common = dict(structures=str(tmp_path), affinity=str(tmp_path / "aff.csv"), trials=2, fold=3, permutations=20, forest=regression.ForestOptions(trees=3, stratified=True), low=0.0, high=6.0, bins=2)
    out = evaluation.run(spark, Options(cluster_by="composition", clusters=str(tmp_path / "clusters"), scores=str(tmp_path / "s.csv"), output=str(tmp_path / "report"), histograms=str(tmp_path / "hist"), beside=("linear", "nn"), **common))
    assert [r.accession for r in out["unmatched"].collect()] == ["zzzz"] and out["complexes"].count() == 12
    table = out["statistics"].collect()
    assert table and table[0].number_of_clusters == 12 and all(r.ave_model_RMSE > 0 and 0 <= r.model_p_value <= 1 for r in table)
    assert len(out["statistics"].columns) == 18 + 6 and {"linear_p_value", "ave_nn_r", "stdev_nn_r", "ave_model_R2(baseline)"} <= set(out["statistics"].columns)
    assert {r.key: r.value for r in out["preamble"].collect()}["affinity_type.KD"] == "12"
    assert spark.read.csv(str(tmp_path / "report/statistics"), header=True, sep="\t").count() == len(table)
    assert len(list((tmp_path / "hist").glob("*.hist"))) == 12 and (tmp_path / "hist/00xy.hist").read_text().startswith("atom_1,atom_2,bin0,bin1\n")
    again = evaluation.run(spark, Options(clusters=str(tmp_path / "clusters"), model="nn", only_scores=str(tmp_path / "s.csv"), neighbours=2, **common))
    assert again["complexes"].count() == 12
    for control in ({"random_affinity": True}, {"surrogate_affinity": True, "model": "linear"}):
        out = evaluation.run(spark, Options(clusters=str(tmp_path / "clusters"), **{**common, "affinity": None, "trials": 1}, **control))
        assert out["complexes"].count() == 12
    assert len(out["statistics"].columns) == 9
    atoms = evaluation.structures.usable(evaluation.structures.read_structures(spark, str(tmp_path)))
    for name in options.FEATURES:
        vectors_ = evaluation.structure_vectors(atoms, Options(feature=name, low=0.5, high=6.0, bins=2)).collect()
        assert len(vectors_) == 12 and len({len(r.features) for r in vectors_}) == 1 and any(any(r.features) for r in vectors_), name


@pytest.mark.parametrize("crowd", [3, 20_000])
def test_crowded_cells_are_dealt_over_salts(spark, monkeypatch, crowd):
    monkeypatch.setattr(spatial, "CROWD", crowd)
    rows, df = points(spark, 90, spread=3.0)
    got = sorted((r.a_serial, r.b_serial) for r in spatial.cross_pairs(df, 1.5).collect())
    assert got == sorted((a[6], b[6]) for a in rows for b in rows if a[0] == b[0] and a[1] == 1 and b[1] == 2 and far(a, b) <= 1.5)


def test_stratified_bags_take_clusters_in_turn():
    clusters = np.array([0] * 50 + [1] * 3 + [2] * 3)
    for size, want in ((6, [2, 2, 2]), (9, [3, 3, 3]), (20, [14, 3, 3])):
        rows = regression.bag(np.random.default_rng(1).integers(0, 1 << 32, 56), size, clusters, {0: 5, 1: 3, 2: 9})
        assert len(set(rows)) == size and np.bincount(clusters[rows]).tolist() == want


def test_alignment_of_tables(spark):
    df = spark.createDataFrame([(1, "GGGWWWGGG", "DDWWWDD"), (2, None, "A"), (3, "", "A")], "id int, q string, t string")
    out = {r.id: r for r in alignment.pair_scores(df, "q", "t", ranges=True).collect()}
    assert (out[1].query_start, out[1].query_stop, out[1].target_start, out[1].target_stop) == (3, 5, 2, 4)
    assert out[2].score is None and out[3].score == -99_999_999
    na = spark.createDataFrame([("ACGTN", "acgtn")], "q string, t string")
    assert alignment.pair_scores(na, "q", "t", alphabet="nucleotide", mask_n=True).first().score == 8


def slow_tree(x, y, features, leaf):
    """Predictions by a plain recursion over all thresholds."""
    if len(y) <= leaf or not (split := slow_split(x[:, features], y, leaf)):
        return lambda v: y.mean()
    f, t = features[split[1]], split[2]
    less = x[:, f] < t
    left, right = slow_tree(x[less], y[less], features, leaf), slow_tree(x[~less], y[~less], features, leaf)
    return lambda v: left(v) if v[f] < t else right(v)


@pytest.mark.parametrize("model", ["forest", "linear"])
def test_cross_validation_matches_a_plain_program(spark, model):
    rng = np.random.default_rng(9)
    n, x = 40, rng.normal(size=(40, 4))
    y, cluster = x @ [1.0, 2.0, 0.0, -1.0] + rng.normal(size=40), np.arange(40) % 8
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(n)], "complex_id long, features array<double>, response double")
    members = spark.createDataFrame([(0, int(c), i) for i, c in enumerate(cluster)], "clustering_id int, cluster_id int, complex_id long")
    how = Options(trials=2, fold=4, model=model, forest=regression.ForestOptions(trees=4, leaf=2, feature_bag=0.3))
    got = evaluation.cross_validate(members, rows, how).collect()
    for r in got:
        train = np.array(sorted(q.complex_id for q in got if (q.trial, q.fold) == (r.trial, r.fold) and q.training))
        if model == "linear":
            a = x[train]
            want = x[r.complex_id] @ np.linalg.solve(a.T @ a, a.T @ y[train])
        else:
            trees = []
            for k in range(4):
                name = f"0:{r.trial}:{r.fold}:{k}"
                number = lambda what, i: int(hashlib.md5(f"1:{what}:{name}:{i}".encode()).hexdigest()[:8], 16)  # noqa: B023, E731
                own = np.array(sorted(sorted(train, key=lambda i: number("bag", i))[: len(train) // 2]))  # noqa: B023
                features = np.array([min(range(4), key=lambda f: number("feature", f))])  # of several, two may part the rows alike; noqa: B023
                trees.append(slow_tree(x[own], y[own], features, 2)(x[r.complex_id]))
            want = np.mean(trees)
        assert abs(r.predicted - want) < 1e-9
    with pytest.raises(ValueError, match="no features"):
        evaluation.cross_validate(members, rows.where("complex_id < 30"), how)


def test_permuted_places_are_a_bijection(spark):
    from pyspark.sql import functions as F

    df = spark.range(1, 60).selectExpr("id AS n", "explode(sequence(0L, id - 1)) AS place", "id % 3 AS perm")
    rows = df.withColumn("to", statistics.permuted(F.col("place"), F.col("n"), "p", 1, F.col("perm"))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.n, []).append(r.to)
    assert all(sorted(v) == list(range(n)) for n, v in by.items())
    # Over many keys every place goes everywhere about as often.
    keys = spark.range(3000).selectExpr("id AS perm", "explode(sequence(0L, 4L)) AS place").withColumn("to", statistics.permuted(F.col("place"), F.lit(5), "p", 1, F.col("perm")))
    counts = [r["count"] for r in keys.groupBy("place", "to").count().collect()]
    assert len(counts) == 25 and all(abs(c - 600) < 120 for c in counts)


def test_sparse_features_become_vectors(spark):
    rows = [("a", "z", 1.0), ("a", "b", 2.0), ("b", "b", 3.0), ("c", "q", 0.0), ("b", "é", 4.0)]
    df = spark.createDataFrame(rows, "complex string, name string, value double").repartition(3)
    names = sorted({n for _, n, _ in rows}, key=lambda n: n.encode())
    assert {r.name: r.code for r in features.dictionary(df).collect()} == {n: i for i, n in enumerate(names)}
    got = {r.complex: r.features for r in features.as_vectors(df).collect()}
    assert got == {c: [next((v for k, m, v in rows if (k, m) == (c, n)), 0.0) for n in names] for c in "abc"}
    assert features.as_vectors(df.where("false")).collect() == []
    histogram = spark.createDataFrame([(1, "C", "N", 0, 5), (1, "N", "N", 1, 2), (2, "X", "Y", 0, 9), (3, "N", "C", 0, 1), (3, "C", "C", 7, 1)], "complex int, type_a string, type_b string, bin int, n int")
    out = {r.complex: r.features for r in features.self_histogram_features(histogram, ["N", "C"], 2).collect()}
    assert out == {1: [0, 0, 5, 0, 0, 2], 2: [0] * 6, 3: [0] * 6}


@pytest.mark.parametrize("most", [3, 1 << 20])
def test_digests_of_long_lists(spark, most):
    from pyspark.sql import functions as F

    from tessera.operators.digests import list_digests

    rows = [(k, str(i)) for k, n in ((1, 400), (2, 1), (3, 70)) for i in range(n)] + [(3, None), (4, None)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    got = {r.k: r.md5 for r in list_digests(df, ["k"], [F.col("t")], F.col("t"), ":", "7:", most).collect()}
    want = {k: "7:" + ":".join(sorted(t for j, t in rows if j == k and t is not None)) for k in (1, 2, 3, 4)}
    assert got == {k: hashlib.md5(v.encode()).hexdigest() for k, v in want.items()}


def test_random_affinity_does_not_carry_members(spark):
    """A name of all members for each member of a cluster grows with the square of it."""
    from pyspark.sql import functions as F

    n = 4000
    members = spark.range(n).select(F.lit(0).alias("clustering_id"), F.lit(1).alias("cluster_id"), F.col("id").alias("complex_id"))
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    got = {r.value for r in crossval.random_affinity(members, 5).collect()}
    name = "5:" + ":".join(sorted(map(str, range(n))))
    assert got == {int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32}
    assert shuffled() - before < 200 * n


@pytest.mark.parametrize("block", [7, 2048])
def test_linkage_of_vectors_without_their_matrix(spark, monkeypatch, block):
    """Near, equal and far vectors: the same tree, clusterings and components as by all
    distances, of which only forests leave a group."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(size=(40, 5)) / 4 for c in (0.0, 3.0, 50.0)] + [np.full((15, 5), 2.0), 1e6 + rng.normal(size=(9, 5))])
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(5)
    matrix = vectors.distance_matrix(df).cache()
    links = clustering.forest_links(df, block=block)
    assert links.count() < len(x) * (30 if block == 7 else 12) < matrix.count()
    monkeypatch.setattr(clustering, "FEW", 300)
    for few in (100, 500_000):
        weights = [sorted(round(r.d, 9) for r in clustering.spanning_tree(t, few).collect()) for t in (links, matrix)]
        assert weights[0] == weights[1]
    listed = clustering.single_linkage(matrix, 5).collect()
    by = {}
    for r in listed:
        by.setdefault(r.clustering_id, []).append(r)
    got = {r.clustering_id: r for r in clustering.levels(links, 5).collect()}
    assert {k: (r.clusters, r.members) for k, r in got.items()} == {k: (len({m.cluster_id for m in v}), len(v)) for k, v in by.items()}
    text = {k: ",".join(f"{m.cluster_id}:{m.complex_id}" for m in sorted(v, key=lambda m: m.complex_id)) for k, v in by.items()}
    for few in (100, 500_000):
        said = {r.clustering_id: r.members for r in clustering.member_digests(links, 5, few).collect()}
        assert said == {k: hashlib.md5(t.encode()).hexdigest() for k, t in text.items()}
    for threshold in (0.4, 20.0):
        want = {r.id: r.component for r in clustering.components_at(matrix, threshold).collect()}
        assert {r.id: r.component for r in clustering.components_of(df, threshold).collect()} == want
    assert clustering.levels(clustering.forest_links(df.where("id < 0")), 2).collect() == []


def test_small_complexes_meet_whole(spark):
    """Copies for cells by a point cost more than the pairs of small complexes; large ones are
    cut along the axes that pay."""
    rng = np.random.default_rng(3)
    made = lambda n, long: spark.createDataFrame([(0, *map(float, rng.random(3) * (long, 10, 10))) for _ in range(n)], "complex int, x double, y double, z double")
    few, many = made(200, 50), made(6000, 200)
    assert spatial.pruning_axes(few, few, 1.5, ["complex"]) == ([], 200)
    assert spatial.pruning_axes(many, many, 1.5, ["complex"]) == (["x"], 6000)
    assert spatial.pruning_axes(few.where("false"), few, 1.5, ["complex"]) == ([], 0)
    assert spatial.pairs_within(many, few, 0.0).count() == 0


@pytest.mark.parametrize("reach", [0.7, 2.0])
def test_cells_and_whole_complexes_find_the_same_pairs(spark, monkeypatch, reach):
    rows, df = points(spark, 120, spread=30.0)
    found = []
    for cost in (0, 1000):
        monkeypatch.setattr(spatial, "COPY", cost)
        axes, _ = spatial.pruning_axes(df, df, reach, ["complex"])
        found.append((len(axes), sorted((r.a_serial, r.b_serial) for r in spatial.pairs_within(df, df, reach).collect())))
    assert [n for n, _ in found] == [3, 0] and found[0][1] == found[1][1]
    assert found[0][1] == sorted((a[6], b[6]) for a in rows for b in rows if a[0] == b[0] and far(a, b) <= reach)


def test_components_of_few_links_and_by_joins_agree(spark):
    rng = np.random.default_rng(8)
    x = rng.random((300, 3))
    df = spark.createDataFrame([(int(i * 7 % 300), v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    few, joins = (sorted(map(tuple, clustering.components_of(df, 0.11, few=n).collect())) for n in (clustering.FEW, 0))
    assert few == joins and len(few) == 300 and 1 < len({c for _, c in few}) < 300


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1.0, 1e4), (1e-3, 5.0), (1e-25, 0.0), (1e25, 0.0), (1.0, 1e9)])
def test_block_screening_leaves_nothing_out(scale, shift, monkeypatch):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(900, 16)) * scale + shift
    x[100:140] = x[:40]
    q, k = x[:600], 4
    want = vectors.squared_distances(q, x)
    want[np.arange(600), np.arange(600)] = np.inf
    theta = np.partition(want, k + 3, axis=1)[:, k + 3].reshape(-1, 1)
    if scale == 1.0 and shift == 0.0:  # plain numbers are screened in single precision
        monkeypatch.setattr(vectors, "near_squares", None)
    none, all_ = np.full((600, 1), -2), np.zeros((900, 1), dtype=int)
    run, i, d, j = vectors._block_nearest(q, x, none, all_, theta, (np.arange(600), np.arange(900)), k)
    got = sorted(zip(i.tolist(), d.tolist(), j.tolist()))
    assert got == sorted((r, want[r, c], int(c)) for r, best in vectors.k_least(want, k) for c in best)


def test_long_work_is_dealt_however_few_bytes_it_has(spark):
    ids = spark.range(8, numPartitions=1)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert vectors.spread(ids, 8, 3).rdd.getNumPartitions() == min(3, most)
    assert vectors.spread(ids, 8, 8).rdd.getNumPartitions() == 1


def test_distance_matrix_copies_rows_to_few_blocks(spark, monkeypatch):
    """Near, equal, far and odd vectors have the distances of a plain program; a row is
    copied no more often than memory asks for, and a batch holds few pairs."""
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(size=(60, 6)) * s for c, s in ((0.0, 1.0), (9.0, 1e-7), (1e7, 1.0))] + [np.full((20, 6), 2.0)])
    x[5, 2], x[6, 1], x[7, 3] = np.inf, np.nan, -np.inf
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    with np.errstate(invalid="ignore"):
        want = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    monkeypatch.setattr(vectors, "BATCH", 16)
    for block in (2, 512):
        got = vectors.distance_matrix(df, block=block).collect()
        assert len({(r.id_a, r.id_b) for r in got}) == len(got) == len(x) * (len(x) - 1) // 2
        assert all(r.id_a < r.id_b for r in got)
        np.testing.assert_allclose([r.d for r in got], [want[int(r.id_a[1:]), int(r.id_b[1:])] for r in got], rtol=1e-13)
    # A group and a task for each two blocks, whatever the bytes: 200 rows are not cut into 100 blocks.
    assert vectors.distance_matrix(df, block=2).rdd.getNumPartitions() == vectors.BLOCKS * (vectors.BLOCKS + 1) // 2


@pytest.mark.parametrize("kind", ["float", "double"])
def test_distance_matrix_shuffles_a_row_once_whatever_it_meets(spark, kind):
    """A block is read by the tasks in which it meets others, not copied for them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(320, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id long, vector array<{kind}>")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    got = vectors.distance_matrix(df, block=20).collect()
    assert (shuffled() - before) / len(x) < 4 * 64 * (8 if kind == "double" else 4)
    assert len(got) == len({(r.id_a, r.id_b) for r in got}) == 320 * 319 // 2
    want = np.sqrt(vectors.squared_distances(x.astype(float), x.astype(float)))
    np.testing.assert_allclose([r.d for r in got], [want[r.id_a, r.id_b] for r in got], rtol=1e-13)


def test_forests_of_parts_and_of_blocks_are_those_of_all_pairs():
    """Parts bound what links of the rest may be in the tree: near, equal, rounded and far rows."""
    rng = np.random.default_rng(0)
    for trial in range(20):
        x = rng.normal(size=(int(rng.integers(30, 140)), int(rng.integers(1, 6)))) * rng.choice([1, 1e-3, 100]) + rng.choice([0, 1e5])
        x = np.round(x) if trial % 3 == 0 else x
        x = np.concatenate([x, x + 50, x + 1000, x[:9]]) if trial % 5 == 0 else x
        d, (i, j) = np.sqrt(vectors.squared_distances(x, x)), np.triu_indices(len(x), 1)
        kept = clustering.forest(d[i, j], i, j)
        want = np.sort(d[i, j][kept])
        for below in (np.inf, float(np.median(want)) * 1.2 + 1e-6):
            a, b, w = clustering._group_forest(x, below, 7)
            near = d[i, j] < below
            assert (clustering.least_labels(len(x), a, b) == clustering.least_labels(len(x), i[near], j[near])).all()
            if below == np.inf:
                np.testing.assert_array_equal(np.sort(w), want)
                order, gaps = clustering.linkage_order(len(x), w, a, b)
                assert sorted(order) == list(range(len(x))) and np.array_equal(np.sort(gaps[:-1]), want)


@pytest.mark.parametrize("few", [None, 0])
def test_components_shuffle_a_row_few_times(spark, few):
    """Whatever blocks a row meets; equal to the components of all pairs, and rows that are near nothing are alone."""
    rng = np.random.default_rng(9)
    x = np.concatenate([c + rng.normal(size=(300, 16)) / 8 for c in (0.0, 0.4, 30.0)] + [rng.normal(size=(100, 16)) * 9]).astype(np.float32)
    x[7, 3], x[8, 2] = np.nan, np.inf
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    links = clustering.forest_links(df, below=0.6, block=16, few=few).collect()
    assert (shuffled() - before) / len(x) < 5 * 16 * 4
    with np.errstate(invalid="ignore"):
        d = np.sqrt(vectors.squared_distances(x.astype(float), x.astype(float)))
    i, j = np.nonzero(d < 0.6)
    want = clustering.least_labels(len(x), i, j)
    a, b = (np.array([r[c] for r in links]) for c in ("id_a", "id_b"))
    assert all(r.d < 0.6 and r.id_a != r.id_b and abs(d[r.id_a, r.id_b] - r.d) < 1e-12 for r in links)
    assert (clustering.least_labels(len(x), a, b) == want).all() and 50 < len(set(want.tolist())) < 500


@pytest.mark.parametrize("kind", ["long", "string"])
def test_member_digests_go_on_from_what_is_hashed(spark, kind):
    """Over several parts of ids, a link or many at a time: the digests of a plain program;
    the vectors' forest shuffles a row few times, whatever blocks it meets."""
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.choice([1.0, 1.0, *(1 + rng.random(40))], 900))[rng.permutation(900)]
    name = (lambda i: 3 * i) if kind == "long" else (lambda i: f"é{i:04}")
    df = spark.createDataFrame([(name(i), [float(v)]) for i, v in enumerate(x)], f"id {kind}, vector array<double>").repartition(3)
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    links = clustering.forest_links(df, block=32)
    assert links.count() < 8 * len(x) and (shuffled() - before) / len(x) < 150
    got = {r.clustering_id: r.members for r in clustering.member_digests(links, 5).collect()}
    order = np.argsort(x)
    gaps = np.diff(x[order])
    want = {}
    for k, low in enumerate(sorted(set(np.abs(gaps).tolist()))):
        stretch = np.concatenate([[0], np.cumsum(gaps >= low)])
        if stretch[-1] + 1 < 5:
            break
        cluster = np.empty(len(x), int)
        cluster[order] = stretch
        number = {}
        text = ",".join(f"{number.setdefault(c, len(number))}:{name(i)}" for i, c in enumerate(cluster.tolist()))
        want[k] = hashlib.md5(text.encode()).hexdigest()
    assert len(want) > 30 and got == want
