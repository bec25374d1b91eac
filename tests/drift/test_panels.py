"""Many fits in shared passes against single ones, failures that stay their own, and the panels against plain numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform
from tidemark.operators import clustering, external, signals
from tidemark.operators.passes import Draw, FitFailed, Sum, _uniform, together
from tidemark.plans import panels, scenarios


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, k, d, n in (("a", 3, 2, 240), ("b", 2, 4, 150)):
        centers = rng.normal(size=(k, d)) * 6
        rows += [(name, i, [float(v) for v in centers[i % k] + rng.normal(size=d)], f"l{i % k}") for i in range(n)]
    rows += [("flat", i, [1.0, 2.0], "x") for i in range(30)]
    return spark.createDataFrame(rows, "dataset string, row_id long, x array<double>, label string").repartition(4).cache()


def test_draws_are_those_of_columns(spark):
    rows = spark.range(50).select("id", uniform(7, "init-0", "id").alias("u")).collect()
    assert all(r["u"] == _uniform("7:init-0", r["id"]) for r in rows)


def test_many_fits_are_single_fits(spark, points):
    runs = {(d, m, s): (d, m, k, s) for d, k in (("a", 3), ("b", 2)) for m in ("fcm", "fcm2", "pfcm", "gk", "kmeans", "gmm") for s in (1, 2)}
    runs["flat"] = ("flat", "kmeans", 2, 1)
    runs["nowhere"] = ("missing", "kmeans", 2, 1)
    found, passes = clustering.fit_many(points, runs, "dataset")
    assert passes == max(o.passes for o in found.values()) < sum(o.passes for o in found.values()) / 5
    assert "distinct rows" in found.pop("flat").error and found.pop("nowhere").error == "no points"
    for (d, m, s), o in found.items():
        alone = clustering.fit(m, points.where(F.col("dataset") == d), 3 if d == "a" else 2, s)
        assert o.model.status == alone.status and o.model.iterations == alone.iterations
        assert np.allclose(o.model.centers, alone.centers, atol=1e-9) and np.isclose(o.model.objective, alone.objective)


def test_a_failure_stays_its_own(points):
    def works():
        s = yield Sum(lambda a: a.sum(0))
        t = yield Draw("w", [(1, [])])
        return s, t

    def breaks():
        yield Sum(lambda a: np.linalg.cholesky(-np.eye(2)))

    def recovers():
        try:
            yield Draw("r", [(1, [np.array([1.0, 2.0])])])
        except FitFailed:
            return "none left"

    found, passes = together(points, {1: ("a", works()), 2: ("a", breaks()), 3: ("flat", recovers())}, "dataset")
    assert passes == 2 and found[1].error is None and len(found[1].model[1]) == 1
    assert found[2].model is None and "positive definite" in found[2].error and found[3].model == "none left"
    with pytest.raises(FitFailed, match="distinct rows"):
        clustering.initial_centers(points.where("dataset = 'flat'"), 2, 1)


def test_baseline_panel(points):
    found, passes = panels.baseline_panel(points, {"a": 3, "flat": 2}, ["kmeans", "fcm2", "gmm"], [1, 2])
    rows = found.collect()
    assert len(rows) == 12 and all(r["status"] == "NUMERICAL_FAILURE" and r["ari"] is None and r["error"] for r in rows if r["dataset"] == "flat")
    own = points.where("dataset = 'a'")
    for r in rows:
        if r["dataset"] == "a":
            model = clustering.fit(r["method"], own, 3, r["seed"])
            cells = external.contingency(model.predict(own))
            assert r["ari"] == pytest.approx(external.adjusted_rand(cells).first()[0]) and r["nmi"] == pytest.approx(external.normalised_mutual_information(cells))
            assert r["ami"] == pytest.approx(external.adjusted_mutual_information(cells))
            assert r["silhouette"] == pytest.approx(signals.silhouette(model.predict(own)))
            if r["method"] != "kmeans":
                index = signals.partition_indices(model.memberships(own)).first()
                assert (r["fpc"], r["pe"]) == (pytest.approx(index["fpc"]), pytest.approx(index["pe"]))
            assert r["xb"] == (pytest.approx(signals.xie_beni(model.memberships(own), model.centers)) if r["method"] == "fcm2" else None)
    assert passes >= max(r["iterations"] for r in rows)


def test_models_of_a_fold_share_passes(points):
    rows = points.where("dataset = 'a'").select("row_id", "x")
    setting = scenarios.Setting(rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1"), 3, 11)
    grid = [(c, m, s) for c in (None, "clean", "location_severe") for m in ("fcm2", "gmm") for s in (1, 2)]
    passes = setting.fit(grid)
    assert passes == max(setting.models[g].passes for g in grid) and setting.fit(grid) == 0
    one = clustering.fit("gmm", setting.shifted("location_severe"), 3, 2)
    assert np.allclose(setting.model("gmm", 2, "location_severe").centers, one.centers, atol=1e-9)


def test_nested_banks(spark, points):
    from tidemark.functions.hashing import draw

    rows = points.withColumn("x", F.col("x")).repartition(7)
    got = signals.nested_banks(rows, 5, "sizes", 40, "dataset").collect()
    want = {}
    for r in rows.select("dataset", "row_id", draw(5, "sizes", "row_id").alias("d")).collect():
        want.setdefault(r["dataset"], []).append((r["d"], r["row_id"]))
    for name, each in want.items():
        mine = sorted((r["place"], r["row_id"]) for r in got if r["key"] == name)
        assert mine == [(k, i) for k, (_, i) in enumerate(sorted(each)[:40])]
    assert signals.nested_banks(rows.where("false"), 5, "sizes", 40).count() == 0


def test_bank_sizes(spark, points):
    rows = points.where("dataset = 'a'").select("row_id", "x")
    moved = rows.withColumn("x", F.transform("x", lambda v: v + 0.5))
    got = {r["bank"]: r for r in panels.bank_sizes(rows, moved, 3, sizes=(50, 100, 240, 400), usual=240).collect()}
    assert [got[s]["rows"] for s in (50, 100, 240, 400)] == [50, 100, 240, 240] and all(r["same_permutation"] for r in got.values())
    assert got[240]["cost_change"] == 0 and got[400]["cost"] == pytest.approx(got[240]["cost"]) and got[50]["cost_change"] > 0
