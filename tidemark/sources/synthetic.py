"""Synthetic mixtures drawn row by row from hashed numbers: any number of rows, no order, no driver data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import normal, uniform
from ..functions.vectors import literal, total
from ..operators.clustering import posterior
from ..operators.sums import vector_map


@dataclass(frozen=True)
class Mixture:
    """Components with priors, means and covariances; df: degrees of freedom of Student components (None: normal)."""

    priors: Sequence[float]
    means: Sequence[Sequence[float]]
    covariances: Sequence[Sequence[Sequence[float]]]
    df: int | None = None

    @staticmethod
    def spread(k: int, d: int, distance: float = 4.0, df: int | None = None) -> Mixture:
        """k equal spherical components whose centers lie on the axes in turn."""
        means = [[distance * (1 + c // d) if i == c % d else 0.0 for i in range(d)] for c in range(k)]
        return Mixture([1 / k] * k, means, [np.eye(d).tolist()] * k, df)


def generate(spark: SparkSession, mixture: Mixture, n: int, seed: int) -> DataFrame:
    """row_id, x, label, tau (exact posterior memberships) of n rows."""
    edges = np.cumsum(mixture.priors)
    u = uniform(seed, "component", "row_id")
    label = F.lit(len(edges) - 1)
    for c in range(len(edges) - 2, -1, -1):
        label = F.when(u < float(edges[c]), c).otherwise(label)
    rows = spark.range(n).withColumnRenamed("id", "row_id").withColumn("label", label)
    d = len(mixture.means[0])
    z = F.array(*[normal(seed, f"x-{i}", "row_id") for i in range(d)])
    rows = rows.withColumn("__z", z)
    scale = F.lit(1.0)
    if mixture.df is not None:
        chi = sum((F.pow(normal(seed, f"chi-{j}", "row_id"), 2) for j in range(mixture.df)), F.lit(0.0))
        scale = F.sqrt(F.lit(float(mixture.df)) / chi)
    factors = [np.linalg.cholesky(np.array(s)) for s in mixture.covariances]
    pick = lambda per: F.element_at(F.array(*per), F.col("label") + 1)
    x = F.array(*[pick([F.lit(float(m[i])) for m in mixture.means]) + total(F.zip_with(pick([literal(f[i]) for f in factors]), "__z", lambda a, b: a * b)) * scale for i in range(d)])
    rows = rows.select("row_id", x.alias("x"), "label")
    priors, means, covs, df = (np.array(v, float) for v in (mixture.priors, mixture.means, mixture.covariances, mixture.df or 0))
    return vector_map(rows, lambda a: posterior(a, priors, means, covs, float(df) or None), "x", "tau")
