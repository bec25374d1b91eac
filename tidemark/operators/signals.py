"""Label-free drift signals between a source and a candidate model, and validity controls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.vectors import js_divergence, normalised_entropy, simplex_error
from .alignment import EPSILON
from .statistics import quantiles
from .sums import as_matrix, summed

BANK = 2048
BANDWIDTH_POINTS = 1024
SIMPLEX_TOLERANCE = 1e-5
PRIMARY = ["D_X", "D_U_R", "D_U_C", "D_V", "D_H", "D_M"]
VALIDITY = ["fpc", "pe", "xb", "silhouette"]
#: The feature blocks of the evaluation.
BLOCKS = {
    "P0": ["D_X"],
    "P1": VALIDITY,
    "P2": ["D_U_R", "D_U_C", "D_V", "D_H", "D_M"],
    "P3": ["D_X", *VALIDITY],
    "P4": PRIMARY,
    "P5": [*PRIMARY, *VALIDITY],
}


def bank(rows: DataFrame, seed: int, purpose: str, size: int | None = BANK, row_id: str = "row_id") -> DataFrame:
    """At most `size` rows, uniformly without replacement (all if there are fewer, or if size is None: then no row is put in order); rows that repeat stay repeated."""
    if size is None:
        return rows
    return rows.withColumn("__draw", draw(seed, purpose, row_id)).orderBy("__draw", row_id).limit(size).drop("__draw")


def nested_banks(rows: DataFrame, seed: int, purpose: str, most: int, key: str | None = None, row_id: str = "row_id", x: str = "x") -> DataFrame:
    """key, row_id, x, place: of each key the `most` rows with the smallest draws, place from 0 in their order.

    The bank of any smaller size is the rows with a place under it, so one pass gives all sizes, each inside the next. Tasks
    keep a sketch of the smallest draws of each key; sketches are merged by key and part, then by key. Equal draws are in
    the order of row ids.
    """
    at = [(F.col(key) if key else F.lit("")).cast("string").alias("key"), draw(seed, purpose, row_id).alias("draw"), F.col(row_id).alias("row_id"), F.col(x).alias("x")]

    def kept(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, pa.Table] = {}
            for batch in batches:
                for k in batch.column(0).unique():
                    some = pa.Table.from_batches([batch.filter(pc.equal(batch.column(0), k))])
                    every = pa.concat_tables([held[k.as_py()], some]) if k.as_py() in held else some
                    held[k.as_py()] = every.take(pc.sort_indices(every.select(["draw", "row_id"]), [("draw", "ascending"), ("row_id", "ascending")])[:most])
            for t in held.values():
                if last:
                    t = t.append_column("place", pa.array(np.arange(t.num_rows, dtype=np.int32)))
                yield from t.combine_chunks().to_batches()

        return run

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = f"key string, draw long, row_id {kinds[row_id].simpleString()}, x {kinds[x].simpleString()}"
    parts = rows.select(*at).mapInArrow(kept(False), schema)
    parts = parts.withColumn("part", F.pmod(F.xxhash64("draw"), F.lit(16))).repartition("key", "part").drop("part").mapInArrow(kept(False), schema)
    return parts.repartition("key").mapInArrow(kept(True), schema + ", place int").select("key", "row_id", "x", "place")


def bank_hash(rows: DataFrame, row_id: str = "row_id") -> str:
    """SHA-256 of the sorted ids of a bank (a bank is at most BANK rows)."""
    return rows.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(row_id)), lambda v: v.cast("string")), ","), 256)).first()[0]


def same_bank(a: str, b: str) -> None:
    if a != b:
        raise ValueError("memberships of different banks cannot be compared")


def check_simplex(rows: DataFrame, u: str, tolerance: float = SIMPLEX_TOLERANCE) -> None:
    worst = rows.agg(F.max(simplex_error(F.col(u)))).first()[0]
    if worst is not None and worst > tolerance:
        raise ValueError(f"{u} is off the simplex by {worst}")


def check_points(rows: DataFrame, x: str = "x") -> int:
    """The common dimension of a column of points; ValueError if they differ, are missing, or hold a null, NaN or infinity."""
    v = F.col(x)
    bad = v.isNull() | F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    low, high, wrong = rows.agg(F.min(F.size(v)), F.max(F.size(v)), F.max(bad.cast("int"))).first()
    if wrong or low != high:
        raise ValueError(f"{x} must have finite points of one dimension (found {low} to {high})")
    return high or 0


def check_memberships(rows: DataFrame, u: str, k: int, tolerance: float = SIMPLEX_TOLERANCE) -> None:
    """ValueError unless every row has k finite memberships that are not negative and sum to one."""
    if check_points(rows, u) not in (0, k):
        raise ValueError(f"{u} does not have {k} clusters")
    if not rows.where(F.exists(u, lambda c: (c < -tolerance) | (c > 1 + tolerance))).isEmpty():
        raise ValueError(f"{u} has memberships outside 0 to 1")
    check_simplex(rows, u, tolerance)


def check_centers(centers: np.ndarray, k: int, d: int) -> None:
    """ValueError unless a model's centers are k finite points of d dimensions."""
    if np.shape(centers) != (k, d) or not np.isfinite(centers).all():
        raise ValueError(f"centers must be {k} finite points of dimension {d}, not {np.shape(centers)}")


def membership_drift(rows: DataFrame, u_source: str = "u_ref", u_candidate: str = "u_cand") -> DataFrame:
    """mean, median and p95 of the row-wise Jensen-Shannon divergence."""
    js = js_divergence(F.col(u_source), F.col(u_candidate))
    each = rows.select(js.alias("js"))
    q = quantiles(each, ["js"], [0.5, 0.95]).select(F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))
    return each.agg(F.avg("js").alias("mean")).join(F.broadcast(q), how="left")


def entropy_shift(rows: DataFrame, u_source: str = "u_ref", u_candidate: str = "u_cand") -> DataFrame:
    """source, candidate (mean normalised entropies), change, D_H (its absolute value)."""
    both = rows.agg(F.avg(normalised_entropy(F.col(u_source))).alias("source"), F.avg(normalised_entropy(F.col(u_candidate))).alias("candidate"))
    return both.select("source", "candidate", (F.col("candidate") - F.col("source")).alias("change"), F.abs(F.col("candidate") - F.col("source")).alias("D_H"))


def cluster_masses(rows: DataFrame, u: str) -> np.ndarray:
    """Mean membership of each cluster, normalised."""
    s = summed(rows, lambda a: a.sum(0), u)
    return s / s.sum()


def js_of(p: np.ndarray, q: np.ndarray) -> float:
    mid = (p + q) / 2
    kl = lambda a: float(np.where(a > 0, a * np.log(np.where(a > 0, a, 1) / np.where(mid > 0, mid, 1)), 0).sum())
    return min(max((kl(p) + kl(q)) / (2 * math.log(2)), 0.0), 1.0)


def mass_shift(rows: DataFrame, u_source: str = "u_ref", u_candidate: str = "u_cand") -> tuple[np.ndarray, np.ndarray, float]:
    """Masses under both models and D_M, the divergence between them."""
    p, q = cluster_masses(rows, u_source), cluster_masses(rows, u_candidate)
    return p, q, js_of(p, q)


def prototype_movement(source: np.ndarray, candidate: np.ndarray, scales: np.ndarray) -> dict[str, float]:
    """mean, median and max distance of aligned centers in units of the reference scales."""
    move = np.sqrt(((source - candidate) ** 2).sum(1)) / (scales + EPSILON)
    return {"D_V": float(move.mean()), "median": float(np.median(move)), "max": float(move.max())}


def collected_bank(rows: DataFrame, x: str = "x", most: int = 2 * BANK) -> np.ndarray:
    """A bank as a matrix in the driver; refuses more rows than a bank may have."""
    found = rows.select(x).limit(most + 1).toArrow().column(x).combine_chunks()
    if len(found) > most:
        raise ValueError(f"a bank has at most {most} rows")
    return as_matrix(found)


def kernel_sum(rows: DataFrame, other: np.ndarray, sigma: float, x: str = "x", block: int = 512) -> float:
    """Sum of exp(-|a-b|^2 / 2 sigma^2) over all rows and all rows of the other bank, block by block in the tasks."""

    def fn(a: np.ndarray) -> np.ndarray:
        total = 0.0
        for k in range(0, len(other), block):
            b = other[k : k + block]
            d2 = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
            total += np.exp(-np.maximum(d2, 0) / (2 * sigma**2)).sum()
        return np.array([total])

    return float(summed(rows, fn, x)[0])


def mmd(a: DataFrame, b: DataFrame, sigma: float, x: str = "x", sum_aa: float | None = None) -> tuple[float, float]:
    """D_X, the biased squared maximum mean discrepancy of two banks, and the kernel sum of the first one (to be passed again as sum_aa); slightly negative values count as 0."""
    ma, mb = collected_bank(a, x), collected_bank(b, x)
    aa = kernel_sum(a, ma, sigma, x) if sum_aa is None else sum_aa
    value = aa / len(ma) ** 2 + kernel_sum(b, mb, sigma, x) / len(mb) ** 2 - 2 * kernel_sum(a, mb, sigma, x) / (len(ma) * len(mb))
    if value < -1e-10:
        raise ValueError(f"negative discrepancy {value}")
    return max(value, 0.0), aa


def bandwidth(reference: DataFrame, seed: int, x: str = "x", row_id: str = "row_id") -> tuple[float, str]:
    """Median positive distance between at most BANDWIDTH_POINTS seeded rows of the reference bank; 1.0 if there is none."""
    p = collected_bank(bank(reference, seed, "bandwidth", BANDWIDTH_POINTS, row_id), x)
    d = np.sqrt(np.maximum((p**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * p @ p.T, 0))[np.triu_indices(len(p), 1)]
    d = d[d > 1e-7]
    return (float(np.median(d)), "SUCCESS") if len(d) else (1.0, "FALLBACK")


def partition_indices(rows: DataFrame, u: str = "u") -> DataFrame:
    """fpc, pe, pe_normalised of a table of memberships."""
    k = F.max(F.size(u))
    fpc = F.avg(F.aggregate(u, F.lit(0.0), lambda s, v: s + v * v))
    pe = F.avg(F.aggregate(u, F.lit(0.0), lambda s, v: s + F.when(v > 0, -v * F.ln(v)).otherwise(0.0)))
    return rows.agg(fpc.alias("fpc"), pe.alias("pe"), k.alias("k")).select("fpc", "pe", F.when(F.col("k") <= 1, 0.0).otherwise(F.least(F.greatest(F.col("pe") / F.ln(F.col("k").cast("double")), F.lit(0.0)), F.lit(1.0))).alias("pe_normalised"))


def xie_beni(points: DataFrame, centers: np.ndarray, m: float = 2.0, x: str = "x", u: str = "u") -> float | None:
    """Compactness over separation; None for one cluster or centers that coincide."""
    if len(centers) < 2:
        return None
    between = ((centers[:, None] - centers[None]) ** 2).sum(2)[np.triu_indices(len(centers), 1)].min()
    if math.sqrt(between) <= 1e-12:
        return None
    s = summed(points, lambda a, w: np.array([((w**m) * ((a[:, None] - centers[None]) ** 2).sum(2)).sum(), len(a)]), x, u)
    return float(s[0] / (s[1] * between))


def silhouettes(points: DataFrame, labelings: dict, x: str = "x") -> dict:
    """silhouette of a bank under each of many labelings, functions from the bank's matrix to hard labels; a task has some labelings."""
    found = points.select(x).limit(2 * BANK + 1).toArrow()
    if found.num_rows > 2 * BANK:
        raise ValueError("the silhouette is taken on banks only")
    if not labelings:
        return {}
    p = as_matrix(found.column(x).combine_chunks())
    spark = points.sparkSession
    held = spark.sparkContext.broadcast((p, [np.asarray(of(p)) for of in labelings.values()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, labels = held.value
        d = np.sqrt(np.maximum((p**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * p @ p.T, 0))
        for batch in batches:
            for k in batch.column(0).to_pylist():
                names, code = np.unique(labels[k], return_inverse=True)
                value = None
                if 2 <= len(names) < len(p):
                    one = np.eye(len(names))[code]
                    size, at = one.sum(0), np.arange(len(p))
                    sums = d @ one
                    inside, means = sums[at, code] / np.maximum(size[code] - 1, 1), sums / size
                    means[at, code] = np.inf
                    other = means.min(1)
                    value = float(np.where(size[code] > 1, (other - inside) / np.maximum(np.maximum(other, inside), 1e-300), 0).mean())
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([value], pa.float64())], ["k", "s"])

    order = list(labelings)
    rows = spark.createDataFrame([(k,) for k in range(len(order))], "k int").repartition(min(len(order), spark.sparkContext.defaultParallelism), "k").mapInArrow(run, "k int, s double")
    return {order[r["k"]]: r["s"] for r in rows.collect()}


def silhouette(points: DataFrame, x: str = "x", label: str = "cluster") -> float | None:
    """Mean silhouette (Euclidean) of a bank under hard labels; None for fewer than two labels or as many as rows."""
    found = points.select(x, label).limit(2 * BANK + 1).toArrow()
    if found.num_rows > 2 * BANK:
        raise ValueError("the silhouette is taken on banks only")
    p, y = as_matrix(found.column(x).combine_chunks()), found.column(label).to_numpy()
    names, code = np.unique(y, return_inverse=True)
    if not 2 <= len(names) < len(y):
        return None
    one = np.eye(len(names))[code]
    size = one.sum(0)

    def fn(a: np.ndarray, mine: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * a @ p.T, 0))
        sums = d @ one
        own = np.searchsorted(names, mine)
        at = np.arange(len(a))
        inside = sums[at, own] / np.maximum(size[own] - 1, 1)
        means = sums / size
        means[at, own] = np.inf
        other = means.min(1)
        s = np.where(size[own] > 1, (other - inside) / np.maximum(np.maximum(other, inside), 1e-300), 0)
        return np.array([s.sum(), len(a)])

    s = summed(points, fn, x, label)
    return float(s[0] / s[1])
