"""Queries and operators on tables beyond the size of a bank, and on rows that are computed anew with other last digits."""

import os
import shutil
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import nested
from tidemark.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def larger(tmp_path_factory, sf):
    """The small tables with 9,000 embeddings, so that source and target have more rows than a bank."""
    at = tmp_path_factory.mktemp("larger")
    for f in os.listdir(sf):
        shutil.copy(f"{sf}/{f}", at / f)
    os.chmod(at / "embeddings.parquet", 0o644)
    n = duckdb.sql(f"SELECT max(vec_id) + 1, count(*) FROM '{sf}/embeddings.parquet'").fetchall()[0]
    duckdb.sql(f"COPY (SELECT * REPLACE (vec_id + k * {n[0]} AS vec_id) FROM '{sf}/embeddings.parquet', range({-(-9000 // n[1])}) r(k)) TO '{at}/embeddings.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["current_bank", "bank_provenance_check"])
def test_banks_of_every_row(spark, larger, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{larger}/embeddings.parquet'")
    df = QUERIES[name](spark, larger)
    want = con.sql(SQL[name])
    assert sorted(tuple(r) for r in df.select(*want.columns).collect()) == sorted(want.fetchall())


def test_medians_of_rows_that_waver(spark):
    """Each pass over these rows gives other last digits, as sums in another order do."""

    def waver(batches):
        for b in batches:
            x = b.column(1).to_numpy() * (1 + 1e-13 * np.random.default_rng(time.time_ns()).choice([-1, 0, 1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x)], ["__cell", "x"])

    rows = spark.range(0, 400, 1, 4).select((F.col("id") % 2).cast("int").alias("__cell"), (F.col("id") * 1.5 + 1).alias("x")).mapInArrow(waver, "__cell int, x double")
    train = np.array([[True, False], [False, True], [True, True]])
    for _ in range(5):
        got = nested.medians_of(rows, ["x"], train)[:, 0]
        assert np.allclose(got, [1.5 * 199 - 0.5, 1.5 * 200 + 1, 1.5 * 199.5 + 1], atol=1.6)


def test_monotonicities_are_those_of_joins(spark):
    from tidemark.operators import shifts

    rows = spark.createDataFrame([(i, float(i % 50), None if i % 9 == 0 else i / 7) for i in range(300)], "row_id long, x double, y double")
    stats = {"x": (24.5, 14.4, 24.5), "y": (21.0, 12.0, 21.0)}
    got = {r["family"]: tuple(r) for r in shifts.monotonicities(rows, stats, ["x", "y"], 5, ["noise", "outliers", "mcar"]).collect()}
    for f in ("noise", "outliers", "mcar"):
        one, two = (shifts.shifted(f"{f}_{s}", rows, stats, ["x", "y"], 5) for s in shifts.SEVERITIES)
        want = tuple(shifts.monotonicity(rows, one, two, ["x", "y"], f).first())
        assert got[f][0] == want[0] and got[f][3] == want[3] and np.allclose(got[f][1:3], want[1:3])


def test_points_in_blocks(spark, tmp_path):
    from tidemark.operators.passes import packed

    rows = spark.range(0, 20_000, 1, 1).select(F.concat(F.lit("k"), F.col("id") % 2).alias("key"), "id", F.array(F.col("id") * 1.0, F.col("id") * 2.0).alias("x"))
    found = packed(rows).collect()
    assert {r["n"] for r in found} <= {8192, 1808} and sorted(i for r in found for i in r["id"]) == list(range(20_000))
    for r in found:
        x = np.frombuffer(r["x"], np.float64).reshape(r["n"], 2)
        assert (x[:, 0] == r["id"]).all() and (x[:, 1] == 2 * x[:, 0]).all() and {f"k{i % 2}" for i in r["id"]} == {r["key"]}


def test_a_row_on_both_sides(spark, tmp_path):
    from tidemark.sources import descriptors as d

    what = {"dataset_id": "a", "strategy": "kfold", "seed": 1, "bundle_sha256": "b", "protocol_sha256": "p"}
    sound = spark.createDataFrame([(0, "source", 1), (63, "target", 1), (1, "target", 2)], "fold int, side string, row_id long")
    assert d.save_split(sound, str(tmp_path / "sound"), **what)["rows"] == 3
    with pytest.raises(ValueError, match="both sides"):
        d.save_split(sound.union(spark.createDataFrame([(1, "source", 2)], sound.schema)), str(tmp_path / "bad"), **what)
