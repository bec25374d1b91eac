"""Agreement of clusters with labels, from the contingency table alone."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counts of a cell that are summed at once.
COUNTS = 100_000
#: Labels times clusters that the driver takes; the tables compared here are small.
CELLS = 1_000_000


def contingency(rows: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n):
    return n * (n - 1) / 2


def adjusted_rand(cells: DataFrame) -> DataFrame:
    """ari of a contingency table; 1.0 where all pairs agree by necessity."""
    a = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"))
    b = cells.groupBy("cluster").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("b"))
    c = cells.agg(F.sum(_pairs(F.col("n"))).alias("c"), F.sum("n").alias("n"))
    one = c.join(F.broadcast(a)).join(F.broadcast(b))  # one row each
    expected = F.col("a") * F.col("b") / F.greatest(_pairs(F.col("n")), F.lit(1))
    most = (F.col("a") + F.col("b")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("c") - expected) / F.nullif(most - expected, F.lit(0.0))).alias("ari"))


def _counts(cells: DataFrame) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    return _margins(_taken(cells))


def _taken(cells: DataFrame) -> list:
    found = cells.limit(CELLS + 1).collect()
    if len(found) > CELLS:
        raise ValueError("the contingency table is too large")
    return found


def _margins(found: list) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    labels = {v: i for i, v in enumerate(dict.fromkeys(r["label"] for r in found))}
    clusters = {v: i for i, v in enumerate(dict.fromkeys(r["cluster"] for r in found))}
    a, b = [0] * len(labels), [0] * len(clusters)
    out = []
    for r in found:
        i, j = labels[r["label"]], clusters[r["cluster"]]
        a[i] += r["n"]
        b[j] += r["n"]
        out.append((i, j, r["n"]))
    return a, b, out


def _entropy(counts: list[int], n: int) -> float:
    return -sum(c / n * math.log(c / n) for c in counts if c)


def _mutual(a, b, cells, n) -> float:
    return max(sum(c / n * math.log(c * n / (a[i] * b[j])) for i, j, c in cells if c), 0.0)


def normalised_mutual_information(cells: DataFrame) -> float:
    """Mutual information over the mean of both entropies; 1.0 for two partitions of one part each."""
    a, b, c = _counts(cells)
    n = sum(a)
    h = (_entropy(a, n) + _entropy(b, n)) / 2 if n else 0.0
    return _mutual(a, b, c, n) / h if h > 0 else 1.0


def expected_mutual_informations(spark: SparkSession, margins: list[tuple[list[int], list[int]]]) -> list[float]:
    """Of random tables with each of these pairs of margins (hypergeometric). The possible counts of all cells are dealt out in chunks."""
    cells = [(r, sum(a), x, y) for r, (a, b) in enumerate(margins) for x in a for y in b]
    pairs = spark.createDataFrame([(r, n, x, y, max(1, x + y - n), min(x, y)) for r, n, x, y in cells], "r int, n long, x long, y long, lo long, hi long").where("lo <= hi")
    chunks = pairs.select("r", "n", "x", "y", "hi", F.explode(F.sequence("lo", "hi", F.lit(COUNTS))).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lg = math.lgamma
        for batch in batches:
            total: dict[int, float] = {}
            for r, n, x, y, hi, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
                ks = np.arange(k, min(k + COUNTS, hi + 1), dtype=np.float64)
                # each probability follows from the one before
                step = np.log(x - ks[:-1]) + np.log(y - ks[:-1]) - np.log(ks[1:]) - np.log(n - x - y + ks[1:])
                log = first + np.concatenate(([0.0], np.cumsum(step)))
                total[r] = total.get(r, 0.0) + float((ks / n * np.log(n * ks / (x * y)) * np.exp(log)).sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], ["r", "e"])

    parts = chunks.repartition(min(64, spark.sparkContext.defaultParallelism)).mapInArrow(run, "r int, e double")
    found = {r["r"]: r["e"] for r in parts.groupBy("r").agg(F.sum("e").alias("e")).collect()}
    return [found.get(r, 0.0) for r in range(len(margins))]


def _adjusted(a: list[int], b: list[int], cells: list[tuple[int, int, int]], expected: float) -> float:
    n = sum(a)
    low = (_entropy(a, n) + _entropy(b, n)) / 2 - expected
    return (_mutual(a, b, cells, n) - expected) / (low if abs(low) > 1e-15 else math.copysign(1e-15, low))


def _trivial(a: list[int], b: list[int]) -> bool:
    return sum(a) == 0 or len(a) == len(b) == 1 or len(a) == len(b) == sum(a)


def adjusted_mutual_information(cells: DataFrame) -> float:
    a, b, c = _counts(cells)
    return 1.0 if _trivial(a, b) else _adjusted(a, b, c, expected_mutual_informations(cells.sparkSession, [(a, b)])[0])


def agreements(cells: DataFrame) -> dict:
    """(ari, nmi, ami) of each run of a table run, label, cluster, n; all expected values come from one job."""
    by_run: dict = {}
    for r in _taken(cells):
        by_run.setdefault(r["run"], []).append(r)
    tables = {run: _margins(found) for run, found in by_run.items()}
    hard = [run for run, (a, b, _) in tables.items() if not _trivial(a, b)]
    expected = dict(zip(hard, expected_mutual_informations(cells.sparkSession, [tables[r][:2] for r in hard]), strict=True)) if hard else {}
    out = {}
    for run, (a, b, c) in tables.items():
        n = sum(a)
        pairs = [sum(_pairs(x) for x in xs) for xs in (a, b, (v for _, _, v in c))]
        by_chance, most = pairs[0] * pairs[1] / max(_pairs(n), 1), (pairs[0] + pairs[1]) / 2
        h = (_entropy(a, n) + _entropy(b, n)) / 2
        out[run] = (1.0 if most == by_chance else (pairs[2] - by_chance) / (most - by_chance), _mutual(a, b, c, n) / h if h > 0 else 1.0, _adjusted(a, b, c, expected[run]) if run in expected else 1.0)
    return out
