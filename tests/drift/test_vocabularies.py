"""Vocabularies as tables: codes in order, sparse rows equal to dense ones, a million categories, hot values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import statistics as st


def dense(df, n):
    out = {}
    for r in df.collect():
        assert r["size"] == n and r["indices"] == sorted(r["indices"])
        x = np.zeros(n, np.float32)
        x[r["indices"]] = r["values"]
        out[r["id"]] = x.tolist()
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    values = [f"v{int(k):03d}" for k in rng.zipf(1.4, 3000).clip(max=400)]
    rows = [(i, None if i % 17 == 0 else v, float(i % 5), "yes" if i % 3 else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, c string, x double, b string")


@pytest.mark.parametrize("broadcast", [10**6, 0])
@pytest.mark.parametrize("frequency", [0.01, 0.0, 0.9])
def test_sparse_rows_are_the_dense_ones(spark, rows, monkeypatch, broadcast, frequency):
    roles = {"x": "numeric", "c": "categorical", "b": "boolean"}
    source, target = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    plain = st.fit_preprocessor(source, roles, min_frequency=frequency)
    want = {r["id"]: list(r["features"]) for r in plain.transform(target, ["id"]).collect()}
    names = plain.names()
    monkeypatch.setattr(st, "LITERALS", 5)
    monkeypatch.setattr(st, "BROADCAST_VALUES", broadcast)
    table = st.fit_preprocessor(source, roles, min_frequency=frequency)
    assert isinstance(table.categorical["c"], st.Vocabulary) and table.names() == names
    assert dense(table.sparse(target, ["id"]), len(names)) == want == dense(plain.sparse(target, ["id"]), len(names))
    assert sorted(map(tuple, table.unseen(target).collect())) == sorted(map(tuple, plain.unseen(target).collect()))
    with pytest.raises(ValueError, match="categories"):
        table.transform(target, ["id"])


def test_a_million_categories(spark):
    df = spark.range(1_200_000).select("id", F.when(F.col("id") % 6 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("c"))
    p = st.fit_preprocessor(df, {"c": "categorical"}, min_frequency=0.0)
    v = p.categorical["c"]
    assert (v.kept, v.rare, v.fill) == (1_000_001, False, "hot")
    out = p.sparse(df, ["id"])
    assert out.where(F.size("indices") != 1).count() == 0
    assert out.select(F.count_distinct(F.col("indices")[0]), F.max(F.col("indices")[0])).first() == (1_000_001, 1_000_000)
    assert p.unseen(df.limit(10).union(spark.createDataFrame([(1, "new"), (2, "new")], "id long, c string"))).first()[1:] == (2, 1)


def test_no_values(spark):
    df = spark.createDataFrame([(1, None)], "id long, c string")
    assert st.Vocabulary.fit(df, "c", 0.1) is None and st.Vocabulary.fit(df.where("false"), "c", 0.1) is None
