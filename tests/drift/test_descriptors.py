"""Stored artifacts: hashes, refusals, replay with missing cells, fingerprints."""

import numpy as np
import pytest

from tidemark.operators import shifts, signals
from tidemark.sources import catalogue, providers
from tidemark.sources import descriptors as d
from tidemark.sources.ingest import with_row_id


def test_replay_puts_missing_cells_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), None if i == 3 else i / 2) for i in range(50)], "row_id long, a double, b double")
    after = shifts.mcar_shift(shifts.scale_shift(rows, {"a": (2.0, 1.0, 2.0)}, "mild"), ["a", "b"], "severe", 3)
    made = d.shift_descriptor("x", 1, "mcar_severe", 3, "b", "s", "p") | {"descriptor_sha256": "h"}
    d.save_replay(rows, after, ["a", "b"], f"file://{tmp_path}/r", made)
    cells, found = d.load(spark, f"file://{tmp_path}/r")
    assert found["shift_spec_sha256"] == "h" and not {"label", "y"} & set(cells.columns)
    assert shifts.differing_cells(after, shifts.overlay(rows, cells, ["a", "b"]), ["a", "b"]).isEmpty()
    assert not cells.where("value is null").isEmpty()


def test_split_sides(spark, tmp_path):
    what = {"dataset_id": "x", "strategy": "kfold", "seed": 1, "bundle_sha256": "b", "protocol_sha256": "p"}
    both = spark.createDataFrame([(0, "source", 1), (0, "target", 1)], "fold int, side string, row_id long")
    with pytest.raises(ValueError, match="both sides"):
        d.save_split(both, f"file://{tmp_path}/s", **what)
    d.save_split(both.limit(1), f"file://{tmp_path}/s", **what)
    with pytest.raises(ValueError, match="split_seed"):
        d.load(spark, f"file://{tmp_path}/s", d.split_descriptor(**what | {"seed": 2}))
    assert d.split_hashes(spark, {"s": f"file://{tmp_path}/s"}).first()["rows"] == 1


def test_bank_limits(spark, tmp_path):
    what = {"dataset_id": "x", "outer_fold": 0, "seed": 1, "bundle_sha256": "b", "split_sha256": "s", "protocol_sha256": "p"}
    ids = spark.range(5).withColumnRenamed("id", "row_id")
    with pytest.raises(ValueError, match="at most 4"):
        d.save_bank(ids, f"file://{tmp_path}/b", 4, kind="reference", **what)
    with pytest.raises(ValueError, match="no shift"):
        d.bank_descriptor("reference", shift_sha256="h", **what)
    d.save_bank(ids, f"file://{tmp_path}/b", 5, kind="reference", **what)
    assert d.bank_rows(ids, spark, f"file://{tmp_path}/b").count() == 5
    with pytest.raises(ValueError, match="lacks"):
        d.bank_rows(ids.where("row_id < 4"), spark, f"file://{tmp_path}/b")


def test_hashes(spark, tmp_path):
    centers = np.array([[0.1, 0.2], [1.0, 2.0]])
    one = d.model_fingerprint("fcm", {"k": 2}, 1, centers)
    assert one == d.model_fingerprint("fcm", {"k": 2}, 1, centers.copy()) != d.model_fingerprint("fcm", {"k": 2}, 1, centers + 1e-16 + 1e-12)
    assert one != d.model_fingerprint("fcm", {"k": 2}, 2, centers)
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert d.file_hash(spark, f"file://{tmp_path}/f.bin") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert d.pair_hash("a", "b") != d.pair_hash("b", "a")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert d.key_universe_hash(df, ["k"]) == d.key_universe_hash(df.orderBy("v", ascending=False).withColumn("v", df.k.cast("string")), ["k"])


@pytest.mark.parametrize("n", [0, 1, 200_000])
def test_row_ids_are_one_to_one(spark, n):
    """Many rows over many ranges, read more than once."""
    df = with_row_id(spark.range(n).selectExpr("(id * 7919) % 1000003 as k", "id as v").repartition(16), ["k", "v"])
    got = df.selectExpr("count(distinct row_id) as d", "min(row_id) as lo", "max(row_id) as hi").first()
    assert got["d"] == n and (not n or (got["lo"], got["hi"]) == (0, n - 1))
    if n:
        assert df.selectExpr("sum(hash(row_id, k, v)) as s").first() == df.selectExpr("sum(hash(row_id, k, v)) as s").first()
        assert df.where("row_id = 0").first()["k"] == 0


def test_registry(spark, tmp_path):
    good = '{"id": "a", "dataset_group": "controlled_real", "source_provider": "p", "target": "y", "feature_roles": {"x": "numeric"}}'
    (tmp_path / "r.json").write_text(good + "\n" + good.replace('"a"', '"b"'))
    table = catalogue.registry(spark, f"file://{tmp_path}/r.json")
    assert catalogue.listed(table, provider="p") == ["a", "b"] and catalogue.spec(table, "a")["target"] == "y"
    (tmp_path / "w.json").write_text("\n".join([good, good, good.replace('"a"', '"c"').replace("numeric", "colour"), good.replace('"a"', '"d"').replace('"target": "y", ', "")]))
    with pytest.raises(ValueError, match=r"\['a', 'c', 'd'\]"):
        catalogue.registry(spark, f"file://{tmp_path}/w.json")
    assert catalogue.synthetic_spec("s03")["dimension"] == 100
    with pytest.raises(KeyError):
        catalogue.synthetic_spec("s99")


def test_domain_files(spark, tmp_path):
    (tmp_path / "ca.csv").write_text("age,work,inc\n30,a,1\nx,b,0\n")
    (tmp_path / "ny.csv").write_text("age,inc\n40,1\n")
    got = providers.domain_files(spark, {"CA": f"file://{tmp_path}/ca.csv", "NY": f"file://{tmp_path}/ny.csv"}, "inc", ["age"])
    assert sorted(map(tuple, got.select("domain", "age", "work", "target").collect()), key=str) == [("CA", 30.0, "a", "1"), ("CA", None, "b", "0"), ("NY", 40.0, None, "1")]
    with pytest.raises(ValueError, match="no column"):
        providers.domain_files(spark, {"CA": f"file://{tmp_path}/ca.csv"}, "other")


@pytest.mark.parametrize("rows, message", [([[0.1, 0.9], [1.0]], "one dimension"), ([[0.5, float("nan")]], "finite"), ([[0.5, 0.6]], "off the simplex"), ([[1.5, -0.5]], "outside"), ([[0.2, 0.3, 0.5]], "2 clusters")])
def test_memberships_are_checked(spark, rows, message):
    df = spark.createDataFrame([(r,) for r in rows], "u array<double>")
    with pytest.raises(ValueError, match=message):
        signals.check_memberships(df, "u", 2)


def test_centers_are_checked():
    signals.check_centers(np.zeros((2, 3)), 2, 3)
    for bad in (np.zeros((3, 3)), np.full((2, 3), np.nan), np.zeros(6)):
        with pytest.raises(ValueError, match="centers must be"):
            signals.check_centers(bad, 2, 3)
