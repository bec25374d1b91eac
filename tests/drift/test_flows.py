"""The passes from synthetic rows to a joined table, and landed provider files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, nested, shifts
from tidemark.operators.statistics import source_statistics
from tidemark.plans import scenarios
from tidemark.sources import artifacts, ingest, providers, synthetic


@pytest.fixture(scope="module")
def rows(spark):
    return synthetic.generate(spark, synthetic.Mixture.spread(3, 2, 8.0), 400, 5).cache()


def test_synthetic(spark, rows):
    assert rows.count() == 400
    wrong = rows.where(F.array_position("tau", F.array_max("tau")) - 1 != F.col("label")).count()
    assert wrong <= 2
    n = rows.groupBy("label").count().collect()
    assert len(n) == 3 and all(90 < r["count"] < 180 for r in n)
    heavy = synthetic.generate(spark, synthetic.Mixture.spread(2, 2, 8.0, df=3), 50, 5)
    assert heavy.select(F.sum(F.element_at("tau", 1) + F.element_at("tau", 2))).first()[0] == pytest.approx(50)


def test_passes(spark, rows, tmp_path):
    side = F.col("row_id") % 2 == 0
    points = rows.select("row_id", "x")
    setting = scenarios.Setting(points.where(side), points.where(~side), 3, 11)
    results = artifacts.ResultTable(spark, f"file://{tmp_path}/signals", evaluation.KEY, "p")
    args = ("s", 0, ["clean", "scale_severe"], ["kmeans"], [1])
    got = scenarios.signal_pass(setting, *args, results)
    assert got.count() == 2 and got.where("usable").count() == 2
    d = {r["condition"]: r for r in got.collect()}
    assert d["scale_severe"]["D_X"] > d["clean"]["D_X"] >= 0
    again = scenarios.signal_pass(setting, *args, results)
    assert again.exceptAll(got).count() == 0
    measured = artifacts.ResultTable(spark, f"file://{tmp_path}/quality", evaluation.KEY, "p")
    labels = rows.select("row_id", "label")
    first = scenarios.quality_pass(setting, labels, "s", 0, ["clean"], ["kmeans"], [1], measured)
    assert first.count() == 1
    calls, plain = [], setting.shifted
    setting.shifted = lambda c: calls.append(c) or plain(c)
    quality = scenarios.quality_pass(setting, labels, *args, measured)
    assert scenarios.quality_pass(setting, labels, *args, measured).exceptAll(quality).count() == 0
    assert sorted(calls) == ["clean", "scale_severe"]  # the clean condition again, as the base; nothing the third time
    clean = quality.where("condition = 'clean'").first()
    assert clean["delta_ari"] == 0 and clean["ari_clean"] > 0.9 and clean["nmi_condition"] > 0.8 and clean["ami_condition"] > 0.8
    joined = evaluation.strict_join(got, quality, spark.createDataFrame([("s", 2)], "dataset_id string, dimension_D int"))
    assert joined.where("shift_family = 'scale' and severity = 'severe'").count() == 1


@pytest.mark.parametrize("condition", ["clean", "mcar_mild", "class_prevalence_severe", "local_overlap_severe"])
def test_every_family_by_name(spark, rows, condition):
    wide, names = scenarios.widened(rows.select("row_id", "label", "x"))
    wide = wide.withColumn("f_1", F.when(F.col("row_id") % 9 > 0, F.col("f_1")))
    stats = shifts.collected(source_statistics(wide, names))
    out, status, reason = shifts.generate(condition, wide, wide, names, stats, 5)
    assert (status, reason) == ("APPLICABLE", None) and out.columns == wide.columns and out.count() == 400
    assert out.select("row_id").distinct().count() == 400
    changed = shifts.differing_cells(wide, out, names)
    if condition == "clean":
        assert changed.isEmpty()
    elif condition == "local_overlap_severe":
        assert 0 < changed.select("row_id").distinct().count() <= 122
        assert out.where("f_1 is null").count() == wide.where("f_1 is null").count()
    else:
        assert not changed.isEmpty()


def test_families_that_do_not_apply(spark, rows):
    wide, names = scenarios.widened(rows.select("row_id", "label", "x").where("label = 0"))
    stats = shifts.collected(source_statistics(wide, names))
    for family in ("class_prevalence", "local_overlap"):
        out, status, reason = shifts.generate(f"{family}_mild", wide, wide, names, stats, 5)
        assert out is None and status == "NOT_APPLICABLE" and "fewer than two classes" in reason


def test_evaluation_resumes(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"d{d}", f, c, "fcm", s, fam, sev, float(rng.normal()), float(rng.normal()), float(rng.normal())) for d in range(6) for f in range(2) for s in range(2) for c, fam, sev in (("clean", "clean", "none"), ("scale_mild", "scale", "mild"), ("noise_mild", "noise", "mild"))]
    joined = spark.createDataFrame(rows, "dataset_id string, outer_fold int, condition string, method string, seed int, shift_family string, severity string, D_X double, D_V double, delta_ari double")
    blocks = {"P0": ["D_X"], "P9": ["D_X", "D_V"]}
    results = artifacts.ResultTable(spark, f"file://{tmp_path}/e", [*nested.JOB, *evaluation.KEY], nested.protocol(joined, blocks, (1.0,)))
    done, plain = [], nested.evaluate
    monkeypatch.setattr(nested, "evaluate", lambda *a, **k: done.append(sorted(k["blocks"])) or plain(*a, **k))
    one = nested.resumed(joined, "primary", "LODO", results, blocks={"P0": ["D_X"]}, alphas=(1.0,))
    both = nested.resumed(joined, "primary", "LODO", results, blocks=blocks, alphas=(1.0,))
    again = nested.resumed(joined, "primary", "LODO", results, blocks=blocks, alphas=(1.0,))
    assert (one.count(), both.count(), again.count()) == (48, 96, 96) and done == [["P0"], ["P9"]]
    changed = joined.withColumn("D_X", F.col("D_X") + 1)
    other = artifacts.ResultTable(spark, f"file://{tmp_path}/e", results.key, nested.protocol(changed, blocks, (1.0,)))
    assert nested.resumed(changed, "primary", "LODO", other, blocks=blocks, alphas=(1.0,)).count() == 96 and len(done) == 3
    records, _ = plain(joined, "primary", "LODO", blocks=blocks, alphas=(1.0,))
    assert records.select("record_sha256").distinct().count() == 96


def test_labels_are_refused(rows):
    with pytest.raises(ValueError, match="without labels"):
        scenarios.Setting(rows, rows, 3, 1)


def test_provider_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text(" 1.0  2.0\n3.0 4.0\n")
    t = providers.blank_parted(spark, [f"file://{tmp_path}/x.txt"], ["a", "a"])
    assert t.columns == ["a", "a_1", "part"] and t.agg(F.sum("a_1")).first()[0] == 6.0
    (tmp_path / "h.csv").write_text("race,age,time,readmitted,admission_source_id\nA,[0-10),3,NO,7\n?,[0-10),4,<30,7\nB,[10-20),x,>30,1\n")
    h = providers.readmissions(spark, f"file://{tmp_path}/h.csv", ["time"]).collect()
    assert [(r["time"], r["target"], r["admission_source_id"]) for r in h] == [(3.0, 0, 7), (None, 1, 1)]
    ids = spark.createDataFrame([("309_1",), ("a_b_2",)], "m string").select(providers.group_of("m").alias("g"))
    assert [r["g"] for r in ids.collect()] == ["309", "a_b"]


def test_manifest(spark, rows, tmp_path):
    path = f"file://{tmp_path}/one"
    b = ingest.isolate(rows.select("row_id", F.element_at("x", 1).alias("a"), "label"), "row_id", label="label")
    hashes = artifacts.write_bundle(b, path)
    paths = {"one": path, "two": f"file://{tmp_path}/two"}
    m = {r["part"]: r for r in providers.manifest(spark, paths).collect()}
    assert set(m) == {"features", "labels"} and m["features"]["sha256"] == hashes["features"]
    assert {r["dataset_id"]: r["status"] for r in providers.statuses(spark, paths).collect()} == {"one": "canonicalized", "two": "unavailable"}
