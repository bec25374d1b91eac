"""Properties of shifts, folds, preprocessing, artifacts and checks."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, folds, shifts, signals, statistics
from tidemark.sources import artifacts, catalogue, ingest


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i), 3.0, "ab"[i % 2], i % 3) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, x1 double, x2 double, flat double, c string, label int")


COLUMNS = ["x1", "x2", "flat"]


@pytest.fixture(scope="module")
def stats(table):
    return shifts.collected(statistics.source_statistics(table, COLUMNS))


def changes(table, after, c):
    both = table.alias("b").join(after.alias("a"), "row_id").select((F.col(f"a.{c}") - F.col(f"b.{c}")).alias("d"), F.col(f"a.{c}").alias("a"), F.col(f"b.{c}").alias("b"))
    return both.collect()


def test_constant_columns_do_not_move(table, stats):
    assert set(stats) == {"x1", "x2"}
    for f in ("location", "scale", "noise", "outliers"):
        for r in changes(table, shifts.shifted(f"{f}_severe", table, stats, COLUMNS, 1), "flat"):
            assert r["d"] == 0


@pytest.mark.parametrize(("family", "ratio"), [("location", 2.0), ("noise", 3.0)])
def test_severe_is_a_multiple_of_mild(table, stats, family, ratio):
    mild, severe = (shifts.shifted(f"{family}_{s}", table, stats, COLUMNS, 1) for s in shifts.SEVERITIES)
    moved = 0
    for c in ("x1", "x2"):
        for a, b in zip(changes(table, mild, c), changes(table, severe, c), strict=True):
            assert (a["d"] is None) == (b["d"] is None)
            if a["d"]:
                moved += 1
                assert abs(b["d"] / a["d"] - ratio) < 1e-6
    assert moved


def test_outliers_and_mcar_are_nested(table, stats):
    for family, hit in (("outliers", lambda r: r["d"] not in (0, None)), ("mcar", lambda r: r["a"] is None and r["b"] is not None)):
        mild, severe = ([hit(r) for r in changes(table, shifts.shifted(f"{family}_{s}", table, stats, COLUMNS, 1), "x1")] for s in shifts.SEVERITIES)
        assert all(b for a, b in zip(mild, severe, strict=True) if a) and sum(severe) > sum(mild) > 0


def test_scale_keeps_the_mean(table, stats):
    after = shifts.scale_shift(table, stats, "severe").agg(F.avg("x1")).first()[0]
    assert abs(after - stats["x1"][0]) < 1e-9


def test_conditions():
    assert len(shifts.CONDITIONS) == 15


def test_replay(table, stats):
    after = shifts.outlier_shift(table, stats, "severe", 4)
    cells = shifts.differing_cells(table, after, COLUMNS)
    assert shifts.overlay(table, cells, COLUMNS).exceptAll(after).count() == 0


def test_not_applicable(spark):
    p = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 3.0], 0)], "row_id long, x array<double>, label int")
    with pytest.raises(ValueError, match="not applicable"):
        shifts.class_prevalence_shift(p, p, "mild", 1)
    with pytest.raises(ValueError, match="not applicable"):
        shifts.local_overlap_shift(p, p, "mild")


def test_unsupervised_shifts_ignore_labels(table, stats):
    swapped = table.withColumn("label", 2 - F.col("label"))
    for f in ("location", "noise", "outliers", "mcar"):
        a, b = (shifts.shifted(f"{f}_mild", t, stats, COLUMNS, 1).drop("label") for t in (table, swapped))
        assert a.exceptAll(b).count() == 0


def test_temporal_folds_keep_ties_together(spark):
    rows = spark.createDataFrame([(i, f"2020-0{1 + i // 13}-01") for i in range(100)], "row_id long, d string").withColumn("d", F.col("d").cast("date"))
    got = folds.temporal_folds(rows, "d").join(rows, "row_id")
    for r in got.groupBy("fold").agg(F.max(F.when(F.col("side") == "source", F.col("d"))).alias("a"), F.min(F.when(F.col("side") == "target", F.col("d"))).alias("b")).collect():
        assert r["a"] is None or r["b"] is None or r["a"] < r["b"]


def test_group_folds_are_disjoint_and_balanced(spark):
    rows = spark.range(1000).selectExpr("id as row_id", "cast(sqrt(id) as int) as g")
    got = folds.group_kfold(rows, "g").collect()
    assert len({r["g"] for r in got}) == len(got)
    load = [sum(r["n"] for r in got if r["fold"] == k) for k in range(5)]
    assert max(load) - min(load) < 70


def test_folds_cover_once(spark):
    f = folds.kfold(spark.range(103).withColumnRenamed("id", "row_id"))
    assert f.where("side = 'target'").select("row_id").distinct().count() == f.where("side = 'target'").count() == 103
    assert f.count() == 515


@pytest.mark.parametrize("n", [10, 2047, 2048, 2049])
def test_bank_size(spark, n):
    assert signals.bank(spark.range(n).withColumnRenamed("id", "row_id"), 1, "bank").count() == min(n, 2048)


def test_preprocessor(spark):
    rows = spark.createDataFrame([(1, 1.0, "a", "low", "yes"), (2, None, "b", "high", "no"), (3, 3.0, None, None, None), (4, 5.0, "a", "low", "1")], "row_id int, n double, c string, o string, b string")
    p = statistics.fit_preprocessor(rows, {"n": "numeric", "c": "categorical", "o": "ordinal", "b": "boolean"}, {"o": ["low", "high"]})
    assert p.numeric["n"][0] == 3.0 and p.categorical["c"][0] == "a" and p.ordinal["o"][1] == "low" and p.boolean["b"] is True
    assert p.names() == ["n", "c=a", "c=b", "o", "b"]
    x = {r["row_id"]: r["features"] for r in p.transform(rows, ["row_id"]).collect()}
    assert x[3][1:3] == [1.0, 0.0] and x[3][4] == 1.0 and abs(x[2][0]) < 1e-6
    new = spark.createDataFrame([("z",), ("a",), (None,)], "c string")
    assert p.unseen(new).first()["n_unseen"] == 1
    empty = statistics.fit_preprocessor(rows.withColumn("n", F.lit(None).cast("double")).withColumn("c", F.lit(None).cast("string")).withColumn("b", F.lit(None).cast("string")), {"n": "numeric", "c": "categorical", "b": "boolean"})
    assert empty.numeric["n"] == (0.0, 0.0, 1.0) and empty.categorical["c"][0] == statistics.MISSING and empty.boolean["b"] is False


def test_infinite_values_are_refused(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0)], "row_id int, n double")
    p = statistics.fit_preprocessor(rows, {"n": "numeric"})
    with pytest.raises(Exception, match="infinite"):
        p.transform(spark.createDataFrame([(1, float("inf"))], "row_id int, n double"), ["row_id"]).collect()


def test_booleans(spark):
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "b string").select(statistics.as_boolean(F.col("b"))).collect()


def test_isolation_and_row_ids(spark, table):
    b = ingest.isolate(table, "row_id", label="label", drop=["flat"])
    assert b.features.columns == ["row_id", "x1", "x2", "c"] and b.labels.columns == ["row_id", "label"]
    assert b.roles == {"x1": "numeric", "x2": "numeric", "c": "categorical"}
    ids = ingest.with_row_id(table.drop("row_id").repartition(7), ["x1", "x2", "c"]).select("row_id").collect()
    assert sorted(r[0] for r in ids) == list(range(200))


def test_bundle_round_trip(spark, table, tmp_path):
    b = ingest.isolate(table, "row_id", label="label")
    hashes = artifacts.write_bundle(b, f"file://{tmp_path}/bundle")
    back = artifacts.read_bundle(spark, f"file://{tmp_path}/bundle", b.roles)
    assert artifacts.table_hash(back.features.repartition(5)) == hashes["features"]
    artifacts.verified(back.labels, hashes["labels"])
    with pytest.raises(ValueError):
        artifacts.verified(back.labels.limit(3), hashes["labels"])


def test_result_table_resumes(spark, tmp_path):
    key = ["dataset_id", "seed"]
    universe = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "dataset_id string, seed int")
    t = artifacts.ResultTable(spark, f"file://{tmp_path}/results", key, "p1")
    assert t.todo(universe).count() == 3
    t.append(universe.where("dataset_id = 'a'").withColumn("v", F.lit(0.5)), 1)
    assert [tuple(r) for r in t.todo(universe).collect()] == [("b", 1)]
    with pytest.raises(ValueError):
        t.assembled(universe)
    t.append(universe.withColumn("v", F.lit(0.25)), 2)
    assert [(r["dataset_id"], r["seed"], r["v"]) for r in t.assembled(universe).collect()] == [("a", 1, 0.25), ("a", 2, 0.25), ("b", 1, 0.25)]
    assert artifacts.ResultTable(spark, f"file://{tmp_path}/results", key, "p2").todo(universe).count() == 3


def test_strict_join_refuses(spark):
    key = "dataset_id string, outer_fold int, condition string, method string, seed int"
    s = spark.createDataFrame([("a", 0, "clean", "fcm", 1, 0.5)], f"{key}, D_X double")
    q = spark.createDataFrame([("a", 0, "clean", "fcm", 1, 0.1)], f"{key}, delta_ari double")
    d = spark.createDataFrame([("a", 10)], "dataset_id string, dimension_D int")
    assert evaluation.strict_join(s, q, d).first()["dimension_stratum"] == "low_D"
    for bad in (q.union(q), q.where("false"), q.withColumn("seed", F.lit(2))):
        with pytest.raises(ValueError):
            evaluation.strict_join(s, bad, d)


def test_catalogue(spark):
    t = catalogue.catalogue(spark)
    assert catalogue.spec(t, "embeddings")["n_classes"] == 10 and "orders" in catalogue.listed(t, group="natural_shift")
    with pytest.raises(KeyError):
        catalogue.spec(t, "nothing")


def test_signals_do_not_read_labels(spark, sf):
    """The plan of a label-free signal does not touch the label column."""
    p = ingest.embedding_points(spark, sf).drop("label")
    plan = signals.bank(p, 1, "bank")._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan
