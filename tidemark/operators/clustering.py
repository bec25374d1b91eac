"""Soft and hard clusterings fitted by one tree-merged sum over the points for each step.

Points are a DataFrame with row_id and x (array of doubles). A model is small (K centers of D numbers, and
K covariances for two methods) and lives in the driver; memberships of any number of rows are columns. Each method is
a program (see passes), so that one fit runs alone and many share their passes over the points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax, fuzzifier
from .passes import Draw, Outcome, Points, Program, Sum, alone, together
from .sums import summed, vector_map

TOLERANCE = 1e-5
MAX_ITERATIONS = 150
#: When a solution counts as degenerate.
SAME_CENTER, FLAT_FPC, FLAT_MAX = 0.02, 0.02, 0.15


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows by centers; one center at a time, so that no block of rows x centers x features is held."""
    return np.sqrt(np.stack([_squares(x - c) for c in v], 1))


def _squares(t: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", t, t)


def raised(u: np.ndarray, m: float) -> np.ndarray:
    return u * np.sqrt(u) if m == 1.5 else u**m


def fuzzy(d: np.ndarray, m: float) -> np.ndarray:
    """Memberships from distances, in the log domain or by their shares of the nearest; centers at distance 0 share the whole."""
    power, far = 2.0 / (m - 1), np.maximum(d, 1e-15)
    if power in (2.0, 4.0):
        u = (far.min(1, keepdims=True) / far) ** 2
        u = u if power == 2.0 else u * u
    else:
        log = -power * np.log(far)
        u = np.exp(log - log.max(1, keepdims=True))
    u /= u.sum(1, keepdims=True)
    zero = d == 0
    hit = zero.any(1)
    u[hit] = zero[hit] / zero[hit].sum(1, keepdims=True)
    return u


@dataclass
class Model:
    """A fitted clustering. shape: covariances' metric matrices where the method has them."""

    method: str
    centers: np.ndarray
    m: float = 2.0
    status: str = "SUCCESS"
    iterations: int = 0
    objective: float = float("nan")
    shape: np.ndarray | None = None
    weights: np.ndarray | None = None
    gamma: np.ndarray | None = None
    history: list[float] = field(default_factory=list)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Memberships of a matrix of rows."""
        if self.method == "kmeans":
            return np.eye(len(self.centers))[distances(x, self.centers).argmin(1)]
        if self.method == "gmm":
            log = log_gaussians(x, self.centers, self.shape) + np.log(self.weights)
            u = np.exp(log - log.max(1, keepdims=True))
            return u / u.sum(1, keepdims=True)
        d = mahalanobis(x, self.centers, self.shape) if self.method == "gk" else distances(x, self.centers)
        return fuzzy(d, self.m)

    def memberships(self, points: DataFrame, x: str = "x", out: str = "u") -> DataFrame:
        return vector_map(points, self.of, x, out)

    def predict(self, points: DataFrame, x: str = "x", out: str = "cluster") -> DataFrame:
        """The cluster of the largest membership, the first of equals."""
        return self.memberships(points, x, "__u").withColumn(out, argmax(F.col("__u"))).drop("__u")

    def typicalities(self, points: DataFrame, b: float = 1.0, eta: float = 2.0, x: str = "x", out: str = "t") -> DataFrame:
        """Possibilistic typicalities of a fitted pfcm model; rows need not sum to one."""
        if self.gamma is None:
            raise ValueError("only pfcm models have typicalities")
        return vector_map(points, lambda a: typical(distances(a, self.centers), self.gamma, b, eta), x, out)


def typical(d: np.ndarray, gamma: np.ndarray, b: float, eta: float) -> np.ndarray:
    return np.clip(1 / (1 + (b * d**2 / gamma) ** (1 / (eta - 1))), 0, 1)


def mahalanobis(x: np.ndarray, v: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(np.maximum(np.einsum("ij,ij->i", (x - c) @ s, x - c), 0)) for c, s in zip(v, a, strict=True)], 1)


def log_gaussians(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    out = []
    for c, s in zip(mean, cov, strict=True):
        low = np.linalg.cholesky(s)
        out.append(-0.5 * _squares((x - c) @ np.linalg.inv(low).T) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi))
    return np.stack(out, 1)


def log_student(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, df: float) -> np.ndarray:
    d, out = x.shape[1], []
    for c, s in zip(mean, scale, strict=True):
        low = np.linalg.cholesky(s)
        q = (np.linalg.solve(low, (x - c).T) ** 2).sum(0)
        out.append(math.lgamma((df + d) / 2) - math.lgamma(df / 2) - 0.5 * d * math.log(df * math.pi) - np.log(np.diag(low)).sum() - 0.5 * (df + d) * np.log1p(q / df))
    return np.stack(out, 1)


def posterior(x: np.ndarray, priors: np.ndarray, mean: np.ndarray, cov: np.ndarray, df: float | None = None) -> np.ndarray:
    """Memberships in a known mixture of normal or Student components."""
    log = (log_gaussians(x, mean, cov) if df is None else log_student(x, mean, cov, df)) + np.log(priors)
    u = np.exp(log - log.max(1, keepdims=True))
    return u / u.sum(1, keepdims=True)


def drawn(k: int, seeds: Sequence[int]) -> Program:
    """For each seed k rows drawn by squared distance to those drawn before; all seeds draw in the same k passes."""
    centers: list[list[np.ndarray]] = [[] for _ in seeds]
    for j in range(k):
        rows = yield Draw(f"init-{j}", [(s, list(c)) for s, c in zip(seeds, centers, strict=True)])
        for c, row in zip(centers, rows, strict=True):
            c.append(row)
    return [np.array(c) for c in centers]


def initial_centers(points: DataFrame, k: int, seed: int, x: str = "x", row_id: str = "row_id") -> np.ndarray:
    """k rows drawn by squared distance to those drawn before (an exponential race on seeded draws).

    One pass for each center; repeated runs give the same rows. Fewer distinct rows than k raise.
    """
    return alone(points, drawn(k, [seed]), x, row_id)[0]


def times(w: np.ndarray, n: np.ndarray | None) -> np.ndarray:
    """Weights of rows that stand for n rows each; for one each if n is None."""
    return w if n is None else w * (n if w.ndim == 1 else n[:, None])


def center_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sums and masses, flat."""
    return np.concatenate(((w.T @ x).ravel(), w.sum(0)))


def split_sums(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return s[:-k].reshape(k, -1), s[-k:]


def fcm_sums(v: np.ndarray, m: float) -> Callable[[np.ndarray], np.ndarray]:
    """The objective, weighted sums and masses of fuzzy c-means at centers v."""

    def fn(a: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        d = distances(a, v)
        w = times(raised(fuzzy(d, m), m), n)
        return np.concatenate(([(w * d**2).sum()], center_sums(a, w)))

    return fn


def fcm_moved(s: np.ndarray, k: int) -> tuple[np.ndarray, float, float]:
    """New centers, the objective at the old ones, and the smallest mass of a cluster."""
    top, mass = split_sums(s[1:], k)
    return top / np.maximum(mass, 1e-15)[:, None], float(s[0]), float(mass.min())


def fcm_step(points: DataFrame, v: np.ndarray, m: float, x: str = "x") -> tuple[np.ndarray, float, float]:
    """New centers, the objective at v, and the smallest mass of a cluster."""
    return fcm_moved(summed(points, fcm_sums(v, m), x), len(v))


def _degeneracy(model: Model) -> Program:
    k = len(model.centers)

    def fn(a: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        u, one = model.of(a), times(np.ones(len(a)), n)
        entropy = -(u * np.log(np.maximum(u, 1e-15))).sum(1)
        return np.concatenate(([one.sum(), one @ (u**2).sum(1), one @ entropy, one @ u.max(1), one @ (a**2).sum(1)], one @ a))

    s = yield Sum(fn, counted=True)
    n, mean = s[0], s[5:] / s[0]
    scale = math.sqrt(max(s[4] / n - (mean**2).sum(), 0))
    between = distances(model.centers, model.centers) + np.where(np.eye(k) > 0, np.inf, 0)
    nearest = float(between.min()) / max(scale, 1e-12) if k > 1 else 0.0
    close = between <= SAME_CENTER * max(scale, 1e-12)
    distinct: list[int] = []
    for i in range(k):
        if not close[i, distinct].any():
            distinct.append(i)
    out = {"fpc_gap": s[1] / n - 1 / k, "pe_gap": math.log(k) - s[2] / n, "mean_max": s[3] / n, "nearest": nearest, "distinct": len(distinct)}
    out["degenerate"] = out["fpc_gap"] < FLAT_FPC and out["mean_max"] < 1 / k + FLAT_MAX and (nearest < SAME_CENTER or len(distinct) < k)
    return out


def degeneracy(points: DataFrame, model: Model, x: str = "x") -> dict[str, float | bool]:
    """Partition coefficient and entropy gaps, mean largest membership, distance of the nearest centers over the data's spread, distinct centers."""
    return alone(points, _degeneracy(model), x)


def _finished(model: Model, moved: float) -> Program:
    if model.status == "SUCCESS":
        found = yield from _degeneracy(model)
        model.status = "DEGENERATE_SOLUTION" if found["degenerate"] else "SUCCESS" if moved < TOLERANCE else "MAX_ITER_REACHED"
    return model


def _started(k: int, seed: int, start: np.ndarray | None) -> Program:
    if start is not None:
        return np.array(start, float)
    centers = yield from drawn(k, [seed])
    return centers[0]


def fcm(k: int, seed: int = 0, m: float | None = None, start: np.ndarray | None = None, max_iterations: int = MAX_ITERATIONS) -> Program:
    """Fuzzy c-means; m defaults to the adaptive fuzzifier of the dimension."""
    v = yield from _started(k, seed, start)
    model = Model("fcm", v, fuzzifier(v.shape[1]) if m is None else m)
    moved = math.inf
    for step in range(max_iterations):
        s = yield Sum(fcm_sums(model.centers, model.m), counted=True)
        new, model.objective, least = fcm_moved(s, k)
        model.history.append(model.objective)
        model.iterations = step + 1
        if least < 1e-15:
            model.status = "EMPTY_CLUSTER"
            break
        moved = float(np.linalg.norm(new - model.centers))
        model.centers = new
        if moved < TOLERANCE:
            break
    return (yield from _finished(model, moved))


def pfcm(k: int, seed: int = 0, m: float = 2.0, a: float = 1.0, b: float = 1.0, eta: float = 2.0, scale: float = 1.0, max_iterations: int = MAX_ITERATIONS, start: np.ndarray | None = None) -> Program:
    """Possibilistic fuzzy c-means: gamma is frozen after a fuzzy warm start, then both weights move the centers."""
    warm = yield from fcm(k, seed, m, start, max_iterations)

    def spread(p: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        d = distances(p, warm.centers)
        w = times(raised(fuzzy(d, m), m), n)
        return np.concatenate(((w * d**2).sum(0), w.sum(0)))

    s = yield Sum(spread, counted=True)
    gamma = np.maximum(scale * s[:k] / np.maximum(s[k:], 1e-15), 1e-6)
    model = Model("pfcm", warm.centers, m, gamma=gamma)
    moved = math.inf
    for step in range(max_iterations):
        v = model.centers

        def fn(p: np.ndarray, n: np.ndarray | None = None, v: np.ndarray = v) -> np.ndarray:
            d = distances(p, v)
            t = typical(d, gamma, b, eta)
            w = times(a * raised(fuzzy(d, m), m) + b * t**eta, n)
            return np.concatenate(([(w * d**2).sum() + (gamma * times((1 - t) ** eta, n).sum(0)).sum()], center_sums(p, w)))

        s = yield Sum(fn, counted=True)
        top, mass = split_sums(s[1:], k)
        new = top / np.maximum(mass, 1e-15)[:, None]
        moved = float(np.linalg.norm(new - v))
        model.centers, model.objective, model.iterations = new, float(s[0]), step + 1
        model.history.append(model.objective)
        if moved < TOLERANCE:
            break
    return (yield from _finished(model, moved))


def regularised(cov: np.ndarray, least: float = 1e-6, condition: float = 1e8, ridge: float = 1e-5) -> np.ndarray:
    """The symmetric part; where its least eigenvalue is under `least` or its condition beyond `condition`, eigenvalues
    are raised to a share `ridge` of their mean (1e-4 at least), or to `least`."""
    cov = (cov + cov.T) / 2
    value, vector = np.linalg.eigh(cov)
    if value[0] < least or value[-1] / max(value[0], 1e-300) > condition:
        value = np.maximum(value, max(least, ridge * max(value.mean(), 1e-4)))
        cov = (vector * value) @ vector.T
    return cov


def gk(k: int, seed: int = 0, m: float = 2.0, max_iterations: int = MAX_ITERATIONS, start: np.ndarray | None = None) -> Program:
    """Gustafson-Kessel: a metric of unit volume for each cluster, from its fuzzy covariance."""
    v = yield from _started(k, seed, start)
    d = v.shape[1]
    model = Model("gk", v, m, shape=np.stack([np.eye(d)] * k))
    moved = math.inf
    for step in range(max_iterations):
        centers, shape = model.centers, model.shape

        def fn(p: np.ndarray, n: np.ndarray | None = None, centers: np.ndarray = centers, shape: np.ndarray = shape) -> np.ndarray:
            far = mahalanobis(p, centers, shape)
            w = times(raised(fuzzy(far, m), m), n)
            about = [(((p - c).T * w[:, j]) @ (p - c)).ravel() for j, c in enumerate(centers)]
            return np.concatenate(([(w * far**2).sum()], *about, center_sums(p, w)))

        s = yield Sum(fn, counted=True)
        model.objective = float(s[0])
        model.history.append(model.objective)
        top, mass = split_sums(s[1 + k * d * d :], k)
        new = top / np.maximum(mass, 1e-15)[:, None]
        # the spread about the new centers is that about the old ones less that of the step
        by = new - centers
        cov = (s[1 : 1 + k * d * d].reshape(k, d, d) - mass[:, None, None] * by[:, :, None] * by[:, None, :]) / np.maximum(mass, 1e-15)[:, None, None]
        shapes = []
        for c in cov:
            c = regularised(c)
            sign, log = np.linalg.slogdet(c)
            if sign <= 0:
                model.status = "SINGULAR_METRIC"
            shapes.append(np.exp(log / d) * np.linalg.inv(c))
        moved = float(np.linalg.norm(new - model.centers))
        model.centers, model.shape, model.iterations = new, np.stack(shapes), step + 1
        if moved < TOLERANCE or model.status != "SUCCESS":
            break
    return (yield from _finished(model, moved))


def nearest_sums(centers: np.ndarray) -> Callable[..., np.ndarray]:
    """For each of several sets of centers (sets, K, D) the sum of squares to the nearest, weighted sums and masses, one after the other.

    Distances to all of them come from one product, about the mean of the centers; what they round differently can only decide between
    centers that are as near."""
    sets, k, dim = centers.shape
    origin = centers.reshape(-1, dim).mean(0)
    about = (centers - origin).reshape(-1, dim)
    half = (about**2).sum(1)[:, None] / 2

    def fn(p: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        t = p - origin
        near = (half - about @ t.T).reshape(sets, k, len(p))
        least, at = near[:, 0].copy(), np.zeros((sets, len(p)), np.int32)
        for j in range(1, k):
            closer = near[:, j] < least
            at[closer] = j
            np.minimum(least, near[:, j], out=least)
        one = times(np.ones(len(p)), n)
        squares = np.maximum(2 * least + _squares(t), 0) @ one
        w = np.stack([(at == j) * one for j in range(k)], 1)
        sums, mass = w.reshape(sets * k, -1) @ p, w.sum(2)
        return np.concatenate((squares[:, None], sums.reshape(sets, -1), mass), 1).ravel()

    return fn


def kmeans(k: int, seed: int = 0, starts: int = 10, max_iterations: int = 300, start: np.ndarray | None = None) -> Program:
    """Lloyd's k-means, the best of several starts; all starts move in the same pass over the points."""
    if start is not None:
        runs = [np.array(start, float)]
    else:
        runs = yield from drawn(k, [seed + 1000 * i for i in range(starts)])
    best = [math.inf] * len(runs)
    live = set(range(len(runs)))
    for step in range(max_iterations):
        order = sorted(live)
        now = [runs[i] for i in order]

        s = yield Sum(nearest_sums(np.array(now)), counted=True)
        parts = s.reshape(len(order), -1)
        for i, part in zip(order, parts, strict=True):
            top, mass = split_sums(part[1:], k)
            new = np.where(mass[:, None] > 0, top / np.maximum(mass, 1)[:, None], runs[i])
            best[i] = float(part[0])
            if np.linalg.norm(new - runs[i]) < 1e-9:
                live.discard(i)
            runs[i] = new
        if not live:
            break
    # starts that end in the same clustering differ by rounding only: the first of them counts
    i = next(k for k, b in enumerate(best) if b <= min(best) * (1 + 1e-9))
    return Model("kmeans", runs[i], objective=best[i], iterations=step + 1, status="SUCCESS" if i not in live else "MAX_ITER_REACHED")


def gmm(k: int, seed: int = 0, ridge: float = 1e-6, tolerance: float = 1e-3, max_iterations: int = 100, start: np.ndarray | None = None) -> Program:
    """Full-covariance normal mixture by expectation maximisation from k-means centers."""
    first = yield from kmeans(k, seed, starts=1, start=start)
    d = first.centers.shape[1]
    model = Model("gmm", first.centers, weights=np.full(k, 1 / k), shape=np.stack([np.eye(d)] * k))
    previous = -math.inf
    for step in range(max_iterations):
        hard = step == 0

        def fn(p: np.ndarray, n: np.ndarray | None = None, centers: np.ndarray = model.centers, shape: np.ndarray = model.shape, weights: np.ndarray = model.weights, hard: bool = hard) -> np.ndarray:
            log = log_gaussians(p, centers, shape) + np.log(weights)
            top = log.max(1, keepdims=True)
            r = np.exp(log - top)
            one = times(np.ones(len(p)), n)
            like = one @ (top[:, 0] + np.log(r.sum(1)))
            r = times(first.of(p) if hard else r / r.sum(1, keepdims=True), n)
            outer = [((p.T * r[:, j]) @ p).ravel() for j in range(k)]
            return np.concatenate(([like, one.sum()], *outer, center_sums(p, r)))

        s = yield Sum(fn, counted=True)
        n, outer = s[1], s[2 : 2 + k * d * d].reshape(k, d, d)
        top, mass = split_sums(s[2 + k * d * d :], k)
        mass = np.maximum(mass, 1e-10)
        mean = top / mass[:, None]
        model.shape = outer / mass[:, None, None] - mean[:, :, None] * mean[:, None, :] + ridge * np.eye(d)
        model.centers, model.weights, model.iterations = mean, mass / mass.sum(), step + 1
        model.objective = float(s[0] / n)
        if step > 1 and abs(model.objective - previous) < tolerance:
            return model
        previous = model.objective if step else -math.inf
    model.status = "MAX_ITER_REACHED"
    return model


#: Methods by name: fcm has the adaptive fuzzifier, fcm2 has m = 2.
PROGRAMS: dict[str, Callable[..., Program]] = {"fcm": fcm, "fcm_adaptive": fcm, "fcm2": partial(fcm, m=2.0), "pfcm": pfcm, "gk": gk, "kmeans": kmeans, "gmm": gmm}


def program(method: str, k: int, seed: int = 0, **options) -> Program:
    if method not in PROGRAMS:
        raise ValueError(f"unknown method {method}")
    return PROGRAMS[method](k, seed, **options)


def fit(method: str, points: DataFrame, k: int, seed: int = 0, x: str = "x", **options) -> Model:
    """A clustering by name; one that fails raises."""
    return alone(points, program(method, k, seed, **options), x)


def fit_many(points: DataFrame | Points, runs: Mapping[Hashable, tuple[object, str, int, int]], key: str | None = None, x: str = "x", **options) -> tuple[dict[Hashable, Outcome], int]:
    """(outcomes, passes) of runs by name: (key value of its points, method, k, seed), all in the same passes over the points.

    Each fit is the one that fit gives over its own points, up to the order of sums; a fit that fails has its error."""
    return together(points, {name: (of, program(method, k, seed, **options)) for name, (of, method, k, seed) in runs.items()}, key, x)


def fit_fcm(points: DataFrame, k: int, seed: int = 0, m: float | None = None, start: np.ndarray | None = None, max_iterations: int = MAX_ITERATIONS, x: str = "x") -> Model:
    return alone(points, fcm(k, seed, m, start, max_iterations), x)


def fit_pfcm(points: DataFrame, k: int, seed: int = 0, x: str = "x", **options) -> Model:
    return alone(points, pfcm(k, seed, **options), x)


def fit_gk(points: DataFrame, k: int, seed: int = 0, x: str = "x", **options) -> Model:
    return alone(points, gk(k, seed, **options), x)


def fit_kmeans(points: DataFrame, k: int, seed: int = 0, x: str = "x", **options) -> Model:
    return alone(points, kmeans(k, seed, **options), x)


def fit_gmm(points: DataFrame, k: int, seed: int = 0, x: str = "x", **options) -> Model:
    return alone(points, gmm(k, seed, **options), x)
