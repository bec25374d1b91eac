"""Passes that read each different row once, draws of whole blocks, and alignment by all source rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import alignment, clustering, passes, signals
from tidemark.plans import audits, panels, scenarios


@pytest.fixture(scope="module")
def copies(spark):
    """Three groups of 150 different rows; row i stands there 1 + i % 4 times."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        x = [float(v) for v in np.array([[0, 0, 0], [9, 0, 5], [0, 9, -5]])[i % 3] + rng.normal(size=3) + 100]
        rows += [("a", f"{i}-{c}", x) for c in range(1 + i % 4)]
    return spark.createDataFrame(rows, "of string, row_id string, x array<double>").repartition(5).cache()


def driven(program, x, ids):
    """What a program finds over a matrix, all rows at once."""
    try:
        request = next(program)
        while True:
            request = program.send(request.answer(request.part(x, ids)))
    except StopIteration as end:
        return end.value


@pytest.mark.parametrize("method", ["kmeans", "fcm", "fcm2", "gmm", "pfcm", "gk"])
def test_fits_of_copies(copies, method):
    rows = copies.collect()
    x, ids = np.array([r["x"] for r in rows]), [r["row_id"].encode() for r in rows]
    want, got = driven(clustering.program(method, 3, 2), x, ids), clustering.fit(method, copies, 3, 2)
    assert got.status == want.status and got.iterations == want.iterations
    assert np.allclose(got.centers, want.centers, atol=1e-8) and np.isclose(got.objective, want.objective)


def test_different_rows_are_read_once(copies):
    def sizes(a, n=None):
        return np.array([len(a), len(a) if n is None else n.sum()])

    def program():
        first = yield passes.Sum(sizes, counted=True)
        second = yield passes.Sum(sizes, counted=True)
        every = yield passes.Sum(lambda a: np.array([len(a)]))
        return [*first, *second, *every]

    total = copies.count()
    for written in (False, True):
        found, _ = passes.together(passes.Points(copies, "of", written=written), {"it": ("a", program())})
        assert found["it"].model == [total, total, 150, total, total]


def test_a_bad_key_leaves_others(spark, copies):
    bad = spark.createDataFrame([("b", "1", [1.0]), ("b", "2", [1.0, 2.0])], copies.schema)
    found, _ = clustering.fit_many(copies.unionByName(bad), {k: (k, "kmeans", 2, 1) for k in "ab"}, "of")
    assert found["a"].error is None and found["b"].error


@pytest.mark.parametrize("ids", [pa.array(["", "x", "é" * 40]), pa.array([-5, 7, 10**18]), pa.array([1, None, 3]), pa.array(["a", "b", "c"]).slice(1), pa.array([], pa.string())])
def test_draws_of_blocks(ids):
    for prefix in ("1:init-0", "9001:init-12"):
        assert passes._uniforms(prefix, passes._texts(ids)).tolist() == [passes._uniform(prefix, i) for i in ids.to_pylist()]


def test_a_step_of_gk_is_one_pass(copies):
    found, n = clustering.fit_many(copies, {"it": (0, "gk", 3, 1)})
    assert n <= 3 + found["it"].model.iterations + 1


def test_blocks_are_cut(spark):
    rows = spark.range(0, 30_000, 1, 1).select(F.lit("k").alias("key"), "id", F.array(F.col("id") * 1.0).alias("x"))
    for few in ("700", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
        found = [r["n"] for r in passes.packed(rows).collect()]
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(found) == [30_000 - 3 * 8192, 8192, 8192, 8192]


def test_banks_of_sizes_read_copies_once(spark, copies, monkeypatch):
    seen, asked = [], passes._asked
    monkeypatch.setattr(passes, "_asked", lambda points, requests, copies=False: (seen.append((copies, any(r.ids for *_, r in requests))), asked(points, requests, copies))[1])
    rows = copies.select("row_id", "x")
    panels.bank_sizes(rows, rows.withColumn("x", F.transform("x", lambda v: v + 1)), 3, sizes=(20, 40), usual=40)
    assert len(seen) > 4 and all(counted or draws for counted, draws in seen) and seen[-1] == (True, False)


def test_merging_takes_no_models():
    from pyspark.cloudpickle import dumps

    model = np.zeros(500_000)
    for request in (passes.Sum(lambda a: a @ model, counted=True), passes.Draw("init", [(1, [model])])):
        assert len(dumps(request)) > 1_000_000 and len(dumps(request.bare())) < 10_000


def test_a_source_of_one_file_is_dealt_out(spark, tmp_path):
    spark.range(0, 4000, 1, 1).select(F.col("id").alias("row_id"), F.array(F.col("id") * 1.0, F.col("id") % 7 * 1.0).alias("x")).write.parquet(f"{tmp_path}/one")
    rows = spark.read.parquet(f"{tmp_path}/one")
    setting = scenarios.Setting(rows.where("row_id % 4 > 0"), rows.where("row_id % 4 = 0"), 2, 1)
    assert len(setting.source.inputFiles()) > 4 and setting.source.count() == 3000
    # scales are those of all source rows, not of the bank's 2048
    scales = setting.source_scales("kmeans", 1)
    model = setting.model("kmeans", 1)
    assert np.allclose(scales, alignment.reference_scales(model.memberships(setting.source), model.centers)[0], rtol=1e-12)
    assert not np.allclose(scales, alignment.reference_scales(model.memberships(setting.reference), model.centers)[0], rtol=1e-6)


def test_alignment_by_all_source_rows(spark, copies, monkeypatch):
    monkeypatch.setattr(signals, "bank", lambda *a, **k: pytest.fail("a bank is a sample"))
    source = copies.select("row_id", "x")
    moved = source.withColumn("x", F.transform("x", lambda v: v + 0.5))
    points = passes.Points(source.withColumn("of", F.lit("source")).unionByName(moved.withColumn("of", F.lit("clean"))), "of")
    got = audits.aligned_runs(points, {(c, m, s): (c, m, 3, s) for c, s in (("source", 1), ("clean", 3)) for m in ("fcm2", "kmeans")})
    for method, condition, seed, cost, _, overlap, *_ in got:
        ref, cand = clustering.fit(method, source, 3, 1), clustering.fit(method, moved, 3, 3)
        scales, _, _ = alignment.reference_scales(ref.memberships(source), ref.centers)
        both = cand.memberships(ref.memberships(source, out="u_ref"), out="u_cand")
        want = alignment.align_models(ref.centers, cand.centers, scales, both)
        o = alignment.soft_jaccard(both)
        assert (condition, seed) == ("clean", 3) and cost == pytest.approx(want.cost) and overlap == pytest.approx(np.mean([o[i, j] for i, j in enumerate(want.permutation)]))
    assert len(got) == 2
