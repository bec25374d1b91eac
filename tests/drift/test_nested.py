"""The nested evaluation against a plain one with NumPy, and the rules on who trains whom."""

import numpy as np
import pytest

from tidemark.operators import boosting, nested
from tidemark.operators.evaluation import check_features
from tidemark.operators.statistics import quantiles

BLOCKS = {"P0": ["a"], "P5": ["a", "b", "c"]}
ALPHAS = (0.01, 1.0, 100.0)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for d in range(7):
        for fam in ("clean", "location", "scale", "mcar"):
            for _ in range(6 + d):
                a, b, c = rng.normal(size=3) * (1, 5, 0.1)
                y = 0.4 * a - 0.1 * b + rng.normal() * 0.3 + 0.02 * d
                out.append((f"d{d}", fam, None if rng.random() < 0.1 else float(a), None if rng.random() < 0.2 else float(b), float(c), float(y)))
    return out


def plain(rows, outer, features, test):
    """Predictions and penalty for one outer group, row by row."""
    at = {"a": 2, "b": 3, "c": 4}
    x = np.array([[np.nan if r[at[f]] is None else r[at[f]] for f in features] for r in rows])
    y = np.array([r[5] for r in rows])
    o, g = np.array([r[outer] for r in rows]), np.array([r[0] for r in rows])

    def fit(train, alpha):
        m = np.nanmedian(x[train], 0)
        z = np.where(np.isnan(x), m, x)
        mu, sd = z[train].mean(0), z[train].std(0)
        z = (z - mu) / np.where(sd < 1e-12, 1, sd)
        w = np.linalg.solve(z[train].T @ z[train] + alpha * np.eye(len(features)), z[train].T @ (y[train] - y[train].mean()))
        return z @ w + y[train].mean()

    train = o != test
    names, sizes = np.unique(g[train], return_counts=True)
    folds = nested.group_folds(dict(zip(names.tolist(), sizes.tolist(), strict=True)))
    of = np.array([folds.get(v, -1) for v in g])
    mae = {a: np.mean([np.abs(fit(train & (of != f), a) - y)[train & (of == f)].mean() for f in range(5)]) for a in ALPHAS}
    best = max(a for a in ALPHAS if mae[a] - min(mae.values()) <= 1e-7)
    return fit(train, best)[o == test], best


@pytest.mark.parametrize("outer, column", [("dataset_id", 0), ("shift_family", 1)])
def test_against_plain(spark, rows, outer, column):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "dataset_id string, shift_family string, a double, b double, c double, y double, row int")
    found, tried = nested.nested_ridge(df, BLOCKS, "y", outer, alphas=ALPHAS, keep=["row"])
    got = {(r["feature_block"], r["row"]): (r["predicted"], r["alpha"], r["outer_test_group"]) for r in found.collect()}
    tests = sorted({r[column] for r in rows} - {"clean"})
    assert len(got) == 2 * sum(r[column] in tests for r in rows)
    for block, features in BLOCKS.items():
        for t in tests:
            want, alpha = plain(rows, column, features, t)
            for i, w in zip([i for i, r in enumerate(rows) if r[column] == t], want, strict=True):
                assert got[block, i][1:] == (alpha, t) and abs(got[block, i][0] - w) < 1e-8
    assert tried.where("selected").count() == len(tests) * len(BLOCKS) * nested.INNER_FOLDS


def test_no_group_on_both_sides(spark, rows):
    df = spark.createDataFrame(rows, "dataset_id string, shift_family string, a double, b double, c double, y double")
    plan = nested.planned(df, "shift_family")
    assert plan.tests == ["location", "mcar", "scale"] and len(plan.cells) == 28
    assert not (plan.train & (plan.valid | plan.hold)).any()
    for k, t in enumerate(plan.tests):
        own = slice(k * 6, k * 6 + 6)
        outside = np.array([o != t for o, _ in plan.cells])
        assert (plan.hold[k * 6 + 5] == ~outside).all() and plan.hold[own].sum() == 7
        assert (plan.valid[own].sum(0) == outside).all() and (plan.train[own].sum(0) == 5 * outside).all()
        for f in range(6):
            names = lambda m: {i for (_, i), x in zip(plan.cells, m, strict=True) if x}
            assert not names(plan.train[k * 6 + f]) & names(plan.valid[k * 6 + f])
    one, two = plan.inner_hashes("scale", 0), plan.inner_hashes("scale", 1)
    assert len({*one, *two}) == 4 and one == plan.inner_hashes("mcar", 0)
    with pytest.raises(ValueError, match="inner folds"):
        nested.planned(df.where("dataset_id < 'd4'"), "dataset_id")


def test_tie_goes_to_the_larger_penalty(spark):
    rows = [(f"d{d}", "location", 0.0, float(d)) for d in range(7) for _ in range(3)]
    df = spark.createDataFrame(rows, "dataset_id string, shift_family string, a double, y double")
    _, tried = nested.nested_ridge(df, {"P0": ["a"]}, "y", "dataset_id", alphas=ALPHAS)
    assert {(r["alpha"], r["selected"], r["tie_status"]) for r in tried.collect()} == {(0.01, False, True), (1.0, False, True), (100.0, True, True)}


def plain_boosting(x, y, train, columns, setting, least=20):
    """One fit, one split after the other."""
    bins = boosting.binned(boosting.filled(x, train), train)
    p = np.full(len(y), y[train].mean())

    def first_best(gains):
        top = max(gains)
        return next(k for k, g in enumerate(gains) if g >= top - 1e-9 * abs(top))

    for _ in range(setting.rounds):
        g = p - y

        def split(rows, g=g):
            t, found = rows & train, [(-np.inf, 0, 0)]
            for d in columns:
                for c in range(int(bins[:, d].max())):
                    low = t & (bins[:, d] <= c)
                    high = t & ~low
                    if min(low.sum(), high.sum()) >= least:
                        found.append((sum(g[z].sum() ** 2 / (z.sum() + setting.l2) for z in (low, high)) - g[t].sum() ** 2 / (t.sum() + setting.l2), d, c))
            return found[first_best([f[0] for f in found])]

        parts = [np.ones(len(y), bool)]
        best = [split(parts[0])]
        while len(parts) < setting.leaves:
            k = first_best([max(b[0], -1.0) for b in best])
            gain, d, c = best[k]
            if gain <= 1e-12:
                break
            high = parts[k] & (bins[:, d] > c)
            parts[k] = parts[k] & ~high
            parts.append(high)
            best[k] = split(parts[k])
            best.append(split(high))
        for rows in parts:
            t = rows & train
            p[rows] -= setting.rate * g[t].sum() / (t.sum() + setting.l2)
    return p


GRID = tuple(boosting.Setting(leaves, rounds, l2, 0.2) for leaves in (3, 6) for rounds in (2, 5) for l2 in (0.0, 3.0))


@pytest.mark.parametrize("limit", [10**6, 10])
def test_boosting_against_plain(spark, rows, monkeypatch, limit):
    """Tuned boosted trees of two blocks, with the table sent whole and with rows dealt out by fit."""
    monkeypatch.setattr(nested, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(nested, "TASK_ROWS", 700)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "dataset_id string, shift_family string, a double, b double, c double, y double, row int")
    found, tried = nested.nested_boosting(df, BLOCKS, "y", "shift_family", grid=GRID, tests=["location", "scale"], keep=["row"])
    got = {(r["feature_block"], r["row"]): (r["predicted"], r["params"]) for r in found.collect()}
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows])
    y, fam, data = np.array([r[5] for r in rows]), np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    scores = {(r["outer_test_group"], r["feature_block"], r["candidate_params"], r["inner_fold"]): r["inner_fold_mae"] for r in tried.collect()}
    assert len(scores) == 2 * 2 * len(GRID) * 5 and tried.where("selected").count() == 2 * 2 * 5
    for test in ("location", "scale"):
        train = fam != test
        folds = nested.group_folds({g: int((data[train] == g).sum()) for g in np.unique(data)})
        of = np.array([folds[g] for g in data])
        for block, columns in (("P0", [0]), ("P5", [0, 1, 2])):
            mae = [[np.abs(plain_boosting(x, y, train & (of != f), columns, s) - y)[train & (of == f)].mean() for f in range(5)] for s in GRID]
            assert all(abs(scores[test, block, s.text(), f] - mae[k][f]) < 1e-9 for k, s in enumerate(GRID) for f in range(5))
            mean = np.mean(mae, 1)
            best = min((s for k, s in enumerate(GRID) if mean[k] - mean.min() <= 1e-7), key=lambda s: (s.leaves, s.rounds, -s.l2, s.rate))
            want = plain_boosting(x, y, train, columns, best)
            for i in np.flatnonzero(fam == test):
                assert got[block, i][1] == best.text() and abs(got[block, i][0] - want[i]) < 1e-9
    assert len(got) == 2 * sum(r[1] in ("location", "scale") for r in rows)


def test_bins():
    x = np.arange(1000.0)
    assert len(boosting.thresholds(x)) == 254 and boosting.thresholds(x[:3]).tolist() == [0.5, 1.5]
    counts = np.bincount(boosting.binned(x[:, None], np.ones(1000, bool))[:, 0])
    assert len(counts) == 255 and counts.min() >= 3 and counts.max() <= 5
    assert len(boosting.GRID) == 16 and boosting.GRID[0].text() == "l2_regularization=0.0, learning_rate=0.05, max_iter=150, max_leaf_nodes=7"


def test_medians_of_fits(spark):
    """Medians of many sets of cells, with ties, gaps, outliers and cells without values."""
    rng = np.random.default_rng(7)
    rows = [(int(c), *(None if rng.random() < 0.2 else float(v) for v in (rng.normal(), rng.integers(0, 3), rng.choice([1e-300, 1.0, 1e300])))) for c in rng.integers(0, 6, 4000)] + [(6, None, float("nan"), None)] * 3
    train = rng.random((20, 7)) < 0.5
    train[0], train[1] = False, [False] * 6 + [True]
    df = spark.createDataFrame(rows, "__cell int, u double, v double, w double")
    got = nested.medians_of(df.repartition(5), ["u", "v", "w"], train)
    for f in range(20):
        for k in range(3):
            held = [r[k + 1] for r in rows if train[f, r[0]] and r[k + 1] is not None and r[k + 1] == r[k + 1]]
            assert got[f, k] == (np.median(held) if held else 0.0)


@pytest.mark.parametrize("name", ["seed", "Condition", "shift_spec_sha256", "dimension_D", "k"])
def test_forbidden_predictors(name):
    with pytest.raises(ValueError, match="not allowed"):
        check_features(["D_X", name])


def test_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(size=60_001), np.full(30_000, 0.25)))
    df = spark.createDataFrame([("p", float(v)) for v in x] + [("q", 1.0), ("q", None), ("q", 2.0)], "g string, v double")
    got = {r["g"]: r["q"] for r in quantiles(df, ["v"], [0.05, 0.5, 0.95], ["g"]).collect()}
    assert np.allclose(got["p"], np.quantile(x, [0.05, 0.5, 0.95]), rtol=0, atol=1e-12) and np.allclose(got["q"], [1.05, 1.5, 1.95])
