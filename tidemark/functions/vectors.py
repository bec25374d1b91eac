"""Expressions over arrays of doubles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[literal(r) for r in rows])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distances(x: Column, centers: Sequence[Sequence[float]]) -> Column:
    """Euclidean distances of x to each center."""
    return F.transform(matrix(centers), lambda c: F.sqrt(squared_distance(x, c)))


def argmin(a: Column) -> Column:
    """Index of the smallest entry, the first of equals."""
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def fuzzy_memberships(d: Column, m: float) -> Column:
    """Memberships from distances: softmax of -2/(m-1) ln d; centers at distance 0 share the whole."""
    zero = F.size(F.filter(d, lambda v: v == 0))
    logs = F.transform(d, lambda v: F.ln(F.greatest(v, F.lit(1e-15))) * (-2.0 / (m - 1)))
    shifted = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    soft = F.transform(shifted, lambda v: v / total(shifted))
    return F.when(zero > 0, F.transform(d, lambda v: F.when(v == 0, 1.0 / zero).otherwise(0.0))).otherwise(soft)


def fuzzifier(dimension: int, policy: str = "adaptive", value: float = 2.0) -> float:
    """The fuzzifier: a fixed value, or max(1.01, 1 + 2 / D)."""
    if policy == "fixed":
        if value <= 1:
            raise ValueError("a fuzzifier must be above 1")
        return value
    if dimension <= 0:
        raise ValueError("the dimension must be positive")
    return max(1.01, 1 + 2 / dimension)


def entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


def entropy(u: Column) -> Column:
    return total(F.transform(u, entropy_term))


def normalised_entropy(u: Column) -> Column:
    """Entropy over ln K, clipped to [0, 1]; 0 for K of one."""
    k = F.size(u)
    return F.when(k <= 1, 0.0).otherwise(F.least(F.greatest(entropy(u) / F.ln(k.cast("double")), F.lit(0.0)), F.lit(1.0)))


def _kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence over ln 2, clipped to [0, 1]."""
    mid = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    js = (_kl(p, mid) + _kl(q, mid)) / (2 * math.log(2))
    return F.least(F.greatest(js, F.lit(0.0)), F.lit(1.0))


def simplex_error(u: Column) -> Column:
    """How far a row is from the probability simplex: the distance of its sum from one, or infinity if an entry is negative or not finite."""
    bad = F.exists(u, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (F.abs(v) == float("inf")))
    return F.when(u.isNull() | bad, F.lit(float("inf"))).otherwise(F.abs(total(u) - 1))


def permuted(u: Column, permutation: Sequence[int]) -> Column:
    return F.array(*[F.element_at(u, int(j) + 1) for j in permutation])
