"""Groups and chains of near copies against brute force, and rows that stay the same whatever shuffles made them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.jaccard_join import components, jaccard_classes, keep_one_per_class


def shingle_matrix(texts):
    ids, rows, cols = {}, [], []
    for r, t in enumerate(texts):
        w = t.split()
        for s in {tuple(w[i : i + 5]) for i in range(len(w) - 4)}:
            rows.append(r)
            cols.append(ids.setdefault(s, len(ids)))
    seen = np.bincount(cols)
    used = np.flatnonzero(seen > 1)
    place = np.full(len(seen), -1)
    place[used] = np.arange(len(used))
    m = np.zeros((len(texts), len(used)), np.float32)
    r, c = np.array(rows), place[np.array(cols)]
    m[r[c >= 0], c[c >= 0]] = 1
    return m, np.bincount(rows, minlength=len(texts))


def test_unlike_near_copies(spark, monkeypatch):
    """2,000 copies of one text, edited so much that about one pair in six links; lists and deals are cut."""
    monkeypatch.setattr(jaccard_join, "DEAL", 3000)
    monkeypatch.setattr(jaccard_join, "CHUNK", 700)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(2000):
        w = list(base)
        for p in rng.integers(0, 200, rng.integers(0, 9)):
            w[p] = f"x{rng.integers(1e9)}"
        texts.append(" ".join(w))
    m, n = shingle_matrix(texts)
    common = (m @ m.T).astype(np.int64)
    link = 100 * common >= 80 * (n[:, None] + n - common)
    np.fill_diagonal(link, False)
    first = {}
    equal = np.array([first.setdefault(t, i) for i, t in enumerate(texts)])
    link &= equal[:, None] != equal
    one = equal == np.arange(len(texts))
    label = np.arange(len(texts))
    while True:
        low = np.minimum(label, np.where(link, label, len(texts)).min(1))
        low = low[equal] if (low[equal] != low).any() else low
        if (low == label).all():
            break
        label = low
    got = {r["id"]: (r["component_id"], r["n_links"]) for r in jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert 0.05 < link.mean() < 0.5
    assert got == {i: (int(label[i]), int(link[i, one].sum())) for i in range(len(texts))}


def test_chain_of_revisions(spark):
    edges = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    other = spark.range(2000, 2100).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    roots = {r["node"]: r["root"] for r in components(edges.unionByName(other)).collect()}
    assert len({roots[k] for k in range(1001)}) == 1 and len({roots[k] for k in [5000, *range(2000, 2100)]}) == 1
    assert len(roots) == 1102 and roots[0] != roots[5000]


@pytest.mark.parametrize("size", ["4m", "64k"])
def test_shuffled_inputs_lose_nothing(spark, size):
    """Inputs that a shuffle made, whose partitions adaptive execution merges differently for other columns."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        text = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("doc_id") % 5000) for k in range(30)])
        docs = spark.range(6000).select((F.col("id") * 7919 % 6000).alias("doc_id")).withColumn("text", text).withColumn("extra", F.repeat("text", 3))
        docs = docs.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("extra").alias("extra"))
        for keep in (exact_dedup, keep_one_per_class):
            assert sorted(r[0] for r in keep(docs).select("doc_id").collect()) == list(range(5000))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
