"""A whole store against its universe with seeded faults, and a stored evaluation in which one value is flipped."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import nested
from tidemark.sources import descriptors as d
from tidemark.sources import store

WHAT = {"bundle_sha256": "b", "split_sha256": "s", "protocol_sha256": "p"}


@pytest.fixture
def banks(spark, tmp_path):
    root = f"file://{tmp_path}/banks"
    universe, positions = [], []
    for name in ("iris", "wine"):
        for fold in range(3):
            rows = [(p, 100 * fold + 7 * p) for p in range(20)]
            d.save_bank(spark.createDataFrame(rows, "position int, row_id long"), f"{root}/{name}/fold_{fold}", 50, kind="reference", dataset_id=name, outer_fold=fold, seed=1, **WHAT)
            universe.append((f"{name}/fold_{fold}", {"dataset_id": name, "outer_fold": str(fold), "canonical_bundle_sha256": "b"}))
            positions += [(f"{name}/fold_{fold}", *r) for r in rows]
    return root, spark.createDataFrame(universe, "artifact string, expected map<string,string>"), spark.createDataFrame(positions, "artifact string, position int, row_id long")


def found(*args):
    return sorted((r["artifact"], r["problem"]) for r in store.store_problems(*args).collect())


def test_a_sound_store(spark, banks):
    root, universe, positions = banks
    assert found(spark, root, universe, (positions, "position", "row_id")) == []
    assert store.listing(spark, root).groupBy("part").count().count() == 2


def test_seeded_faults_are_named(spark, banks):
    root, universe, positions = banks
    at = root.removeprefix("file://")
    shutil.rmtree(f"{at}/iris/fold_0")
    shutil.rmtree(f"{at}/iris/fold_1/descriptor.json")
    shutil.copytree(f"{at}/wine/fold_0", f"{at}/wine/fold_9")
    (open(f"{at}/stray.txt", "w")).write("x")
    text = spark.read.text(f"{root}/wine/fold_1/descriptor.json", wholetext=True).first()[0]
    changed = json.loads(text) | {"canonical_bundle_sha256": "other"}
    spark.createDataFrame([(json.dumps(changed),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/wine/fold_1/descriptor.json")
    swapped = [(p, 200 + 7 * (p ^ 1 if p < 2 else p)) for p in range(20)]
    spark.createDataFrame(swapped, "position int, row_id long").write.mode("overwrite").parquet(f"{root}/wine/fold_2/table.parquet")
    spark.createDataFrame([("not json",)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/iris/fold_2/descriptor.json")
    assert found(spark, root, universe, (positions, "position", "row_id")) == [
        ("iris/fold_0", "missing"), ("iris/fold_1", "no descriptor"), ("iris/fold_2", "unreadable"), ("stray.txt", "orphan"), ("wine/fold_1", "altered descriptor"), ("wine/fold_1", "canonical_bundle_sha256 is not the expected one"),
        ("wine/fold_2", "2 misplaced rows"), ("wine/fold_2", "altered table"), ("wine/fold_9", "20 misplaced rows"), ("wine/fold_9", "orphan"),
    ]


def test_an_evaluation_is_recomputed(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(7):
        for fold in range(2):
            for seed in range(2):
                for family, severity in (("clean", "none"), ("location", "mild"), ("scale", "severe")):
                    x = [float(v) for v in rng.normal(size=10)]
                    rows.append((f"d{k}", fold, "clean" if family == "clean" else f"{family}_{severity}", "fcm", seed, family, severity, *x, float(x[0] * 0.3 + rng.normal() * 0.1)))
    names = ["D_X", "D_U_R", "D_U_C", "D_V", "D_H", "D_M", "fpc", "pe", "xb", "silhouette"]
    joined = spark.createDataFrame(rows, "dataset_id string, outer_fold int, condition string, method string, seed int, shift_family string, severity string, " + ", ".join(f"{n} double" for n in names) + ", delta_ari double")
    blocks = {b: nested.BLOCKS[b] for b in ("P0", "P3", "P4")}
    first, records = nested.run_evaluation(joined, scopes=[("primary", "LODO"), ("primary", "LOSFO")], regressor=nested.RIDGE, control=None, blocks=blocks, alphas=(1.0, 10.0))
    path = f"file://{tmp_path}/evaluation"
    chain = nested.save_evaluation(records, path, nested.RIDGE)
    assert store.differences(json.loads(json.dumps(first)), chain["report"]) == [] and nested.evaluation_problems(spark, path, nested.RIDGE) == []
    # one flipped value: its file, its record and every number that follows from it are named
    table = f"{path}/primary_LODO_ridge.parquet"
    kept = spark.read.parquet(table)
    one = kept.orderBy("record_sha256").first()
    flipped = kept.withColumn("predicted", F.when(F.col("record_sha256") == one["record_sha256"], F.col("predicted") + 0.5).otherwise(F.col("predicted")))
    flipped = spark.createDataFrame(flipped.toPandas(), kept.schema)
    flipped.write.mode("overwrite").parquet(table)
    bad = nested.evaluation_problems(spark, path, nested.RIDGE)
    assert any(p.startswith("primary_LODO_ridge/") for p in bad) and "primary_LODO_ridge: 1 records are not those of their hash" in bad
    assert any(p.startswith(f"report/mae/primary_LODO_ridge/{one['feature_block']}") for p in bad) and not any("LOSFO" in p for p in bad)


def test_differences():
    assert store.differences({"a": [1.0, 2], "b": True}, {"a": [1.0 + 1e-12, 2], "b": True}) == []
    assert store.differences({"a": [1.0, 2], "c": 1}, {"a": [1.1, 2], "b": 1}) == ["/a/0: 1.0 and 1.1", "/b: on one side only", "/c: on one side only"]
