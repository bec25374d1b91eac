"""Small exact cases of the clustering, alignment, signal and verdict operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as vec
from tidemark.functions.hashing import config_hash, derived_seed
from tidemark.operators import alignment, clustering, evaluation, external, nested, signals


def points(spark, rows, **columns):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "row_id long, x array<double>")


def with_u(spark, rows, u):
    return spark.createDataFrame([(i, [float(v) for v in r], [float(v) for v in w]) for i, (r, w) in enumerate(zip(rows, u, strict=True))], "row_id long, x array<double>, u array<double>")


def pairs(spark, a, b):
    return spark.createDataFrame([([float(v) for v in x], [float(v) for v in y]) for x, y in zip(a, b, strict=True)], "u_ref array<double>, u_cand array<double>")


def test_memberships(spark):
    got = spark.createDataFrame([([1.0, 3.0],), ([2.0, 0.0],), ([0.0, 0.0],)], "d array<double>").select(vec.fuzzy_memberships(F.col("d"), 2.0)).collect()
    assert np.allclose([r[0] for r in got], [[0.9, 0.1], [0, 1], [0.5, 0.5]])
    assert np.allclose(clustering.fuzzy(np.array([[2.0, 0, 5], [0, 3, 0]]), 2.0), [[0, 1, 0], [0.5, 0, 0.5]])


def test_memberships_small_fuzzifier(spark):
    d = [[1.0, 1.001, 5.0]]
    one = np.array(spark.createDataFrame([(d[0],)], "d array<double>").select(vec.fuzzy_memberships(F.col("d"), 1.03125)).first()[0])
    assert np.allclose(one, clustering.fuzzy(np.array(d), 1.03125)[0]) and math.isclose(one.sum(), 1)


def test_fuzzifier():
    assert vec.fuzzifier(1) == 3.0 and vec.fuzzifier(64) == 1.03125 and vec.fuzzifier(1000) == 1.01
    assert vec.fuzzifier(5, "fixed", 2.5) == 2.5
    with pytest.raises(ValueError):
        vec.fuzzifier(5, "fixed", 1.0)


def test_center_sums():
    x, u = np.array([[0.0, 0], [2, 0], [0, 2]]), np.array([[0.8, 0.2], [0.6, 0.4], [0.1, 0.9]])
    top, mass = clustering.split_sums(clustering.center_sums(x, u**2), 2)
    assert np.allclose(top / mass[:, None], [[0.72 / 1.01, 0.02 / 1.01], [0.32 / 1.01, 1.62 / 1.01]])


def test_soft_jaccard(spark):
    o = alignment.soft_jaccard(pairs(spark, [[0.8, 0.2], [0.1, 0.9]], [[0.7, 0.3], [0.4, 0.6]]))
    assert np.allclose(o, [[2 / 3, 2 / 7], [3 / 8, 2 / 3]])


def test_scales(spark):
    s, _, _ = alignment.reference_scales(with_u(spark, [[0], [2], [4]], [[1], [1], [1]]), np.array([[2.0]]))
    assert np.allclose(s, [math.sqrt(8 / 3)])


def test_assignment_beats_greedy():
    p, cost = alignment.assignment(np.array([[1.0, 2], [2, 10]]))
    assert p == [1, 0] and cost == 4


def test_assignment_against_all_permutations():
    import itertools

    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 5, 6):
        for _ in range(20):
            c = rng.random((k, k))
            best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(k)))
            p, cost = alignment.assignment(c)
            assert sorted(p) == list(range(k)) and math.isclose(cost, best)
            if k > 1:
                every = sorted(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(k)))
                assert math.isclose(alignment.align(c).margin, every[1] - every[0], abs_tol=1e-9)


def test_ambiguous_and_clear(spark):
    half = [[0.5, 0.5]] * 4
    tie = alignment.align_models(np.array([[-1.0, 0], [1, 0]]), np.array([[0.0, -1], [0, 1]]), np.ones(2), pairs(spark, half, half))
    assert tie.ambiguous and tie.margin <= 1e-8
    clear = alignment.align_models(np.array([[-10.0, 0], [10, 0]]), np.array([[-9.9, 0], [10.1, 0]]), np.ones(2), pairs(spark, half, half))
    assert not clear.ambiguous and clear.margin > 1 and clear.identity


def test_divergence(spark):
    got = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.3, 0.7], [0.3, 0.7])], "p array<double>, q array<double>").select(vec.js_divergence(F.col("p"), F.col("q"))).collect()
    assert got[0][0] == 1.0 and got[1][0] == 0.0


def test_entropy_change(spark):
    r = signals.entropy_shift(pairs(spark, [[1, 0], [0, 1]], [[0.7, 0.3], [0.4, 0.6]])).first()
    assert round(r["D_H"], 6) == 0.926121


def test_mass_reversal(spark):
    _, _, d = signals.mass_shift(pairs(spark, [[0.9, 0.1]] * 5, [[0.1, 0.9]] * 5))
    assert round(d, 6) == 0.531004


def test_prototype_movement():
    m = signals.prototype_movement(np.array([[0.0, 0], [1, 1]]), np.array([[0.5, 0], [1, 1]]), np.ones(2))
    assert math.isclose(m["D_V"], 0.25, rel_tol=1e-9)


def test_mmd(spark):
    a, b = points(spark, [[0, 0], [1, 1], [2, 2]]), points(spark, [[5, 5], [6, 6], [7, 7]])
    assert round(signals.mmd(a, b, 1.0)[0], 6) == 1.001783
    assert math.isclose(signals.mmd(a, b, 1.0)[0], signals.mmd(b, a, 1.0)[0]) and signals.mmd(a, a, 1.0)[0] < 1e-12


def test_validity(spark):
    t = with_u(spark, [[0], [4]], [[0.8, 0.2], [0.6, 0.4]])
    assert math.isclose(signals.partition_indices(t).first()["fpc"], 0.60)
    even = with_u(spark, [[0], [4]], [[0.5, 0.5]] * 2)
    assert math.isclose(signals.partition_indices(even).first()["pe"], math.log(2))
    v = np.array([[0.0], [4.0]])
    assert signals.xie_beni(with_u(spark, [[0], [4]], [[1, 0], [0, 1]]), v) == 0
    assert signals.xie_beni(even, v) == 0.25
    assert signals.xie_beni(even, np.zeros((2, 1))) is None


def test_simplex(spark):
    with pytest.raises(ValueError):
        signals.check_simplex(with_u(spark, [[0]], [[0.7, 0.7]]), "u")
    signals.check_simplex(with_u(spark, [[0]], [[0.7, 0.3]]), "u")


def test_external(spark):
    same = spark.createDataFrame([(c, 2 - c) for c in (0, 0, 0, 1, 1, 1, 2, 2, 2)], "label int, cluster int")
    cells = external.contingency(same)
    assert external.adjusted_rand(cells).first()[0] == 1.0
    assert math.isclose(external.normalised_mutual_information(cells), 1.0) and math.isclose(external.adjusted_mutual_information(cells), 1.0)


def test_verdicts():
    strong = evaluation.verdict({"P0": 0.2, "P3": 0.19, "P4": 0.15}, [0.02] * 12, [0.02] * 7, [0.02] * 7, 0.01, 0.01)
    weak = evaluation.verdict({"P0": 0.2, "P3": 0.199, "P4": 0.198}, [0.02] * 6 + [-0.02] * 6, [0.02] * 3 + [-0.01] * 4, [0.02] * 7, -0.01, -0.01)
    fails = evaluation.verdict({"P0": 0.2, "P3": 0.18, "P4": 0.22}, [-0.02] * 12, [-0.02] * 7, [-0.04] * 7, -0.05, -0.05)
    assert [v["verdict"] for v in (strong, weak, fails)] == ["SURVIVES_STRONGLY", "BORDERLINE", "FAILS_PRIMARY_FALSIFICATION"]
    assert fails["severe_family_failure"] and not strong["severe_family_failure"]


def test_seeds():
    assert derived_seed(2026090704, "aps_failure", 3, "clean", "spec") == 2109479718
    assert config_hash({"b": 1, "a": [1, 2]}) == config_hash({"a": [1, 2], "b": 1})


def test_ridge_against_normal_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=60) * 0.1
    rows = spark.createDataFrame([(*map(float, r), float(v), f"g{i % 4}") for i, (r, v) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y double, g string")
    got = {r["observed"]: r["predicted"] for r in nested.nested_ridge(rows, {"P0": ["a", "b", "c"]}, "y", "g", inner="g", alphas=[2.0], folds=3)[0].collect()}
    for g in range(4):
        tr = np.arange(60) % 4 != g
        mean, sd = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - mean) / sd
        w = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y[tr] - y[tr].mean()))
        for xi, yi in zip(x[~tr], y[~tr], strict=True):
            assert math.isclose(got[float(yi)], float(y[tr].mean() + ((xi - mean) / sd) @ w), abs_tol=1e-8)


def test_forbidden_features(spark):
    with pytest.raises(ValueError):
        evaluation.check_features(["D_X", "ARI_clean"])


def test_fits_find_groups(spark):
    rng = np.random.default_rng(0)
    centers = np.array([[0.0, 0], [8, 0], [0, 8]])
    truth = rng.integers(0, 3, 300)
    p = points(spark, centers[truth] + rng.normal(size=(300, 2)) * 0.5)
    for method in ("fcm", "fcm2", "pfcm", "gk", "kmeans", "gmm"):
        model = clustering.fit(method, p, 3, 1)
        assert model.status == "SUCCESS", method
        near = clustering.distances(centers, model.centers).min(1)
        assert (near < 0.5).all(), method
        u = np.array([r[0] for r in model.memberships(p).select("u").collect()])
        assert np.allclose(u.sum(1), 1)
    with pytest.raises(ValueError):
        clustering.fit("other", p, 3)


def test_posteriors():
    x, mean, cov = np.array([[0.0], [4.0], [2.0]]), np.array([[0.0], [4.0]]), np.ones((2, 1, 1))
    for df in (None, 3.0):
        u = clustering.posterior(x, np.array([0.5, 0.5]), mean, cov, df)
        assert np.allclose(u.sum(1), 1) and np.allclose(u[2], 0.5) and u[0, 0] > 0.9
