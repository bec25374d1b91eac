"""Nested evaluation: leave one group out, tune inside by grouped folds, impute and scale on training rows only.

All fits of all feature blocks are made together, and no row is copied for a fit. Rows fall into cells (outer group,
inner group), a fit trains on some of the cells. Ranks are counted by cell, so any fit's median is read from sums over
its cells; moments are summed by cell and pattern of missing features, and what a fit fills in is added to them by algebra.
Errors are summed in tasks over all fits that a row's cell validates. A ridge fit in the driver is the solution of a
system as large as its block; boosted fits run in tasks, one set of training rows each (see boosting).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import config_hash, record_hash
from ..sources import store
from ..sources.artifacts import ResultTable, table_hash
from ..sources.shared import stored
from . import boosting
from .evaluation import ALPHAS, KEY, check_features, paired_bootstrap, paired_deltas, regression_metrics, verdict
from .signals import BLOCKS, PRIMARY

INNER_FOLDS = 5
TIE = 1e-7
#: The families that a leave-one-family-out evaluation leaves out; clean is only ever trained on.
CLEAN = "clean"
#: Names of the primary regressor and its linear control.
BOOSTED, RIDGE = "hist_gradient_boosting", "ridge"
#: P4 without one structural signal, and the shift signal with one structural signal.
ABLATIONS = {f"P4_minus_{s}": [c for c in PRIMARY if c != s] for s in PRIMARY[1:]}
INCREMENTS = {f"DX_plus_{s}": ["D_X", s] for s in PRIMARY[1:]}
#: Groups that the driver deals out to folds.
MOST_GROUPS = 100_000
#: Buckets that ranks are counted in, and distinct values that are read of the buckets with medians.
BUCKETS, MOST_VALUES = 500, 1_000_000
#: Rows of a table that boosted fits get whole (some 100 bytes each); rows of a larger one are dealt out by fit.
BROADCAST_ROWS = 300_000
#: Rows times fits of a boosting task.
TASK_ROWS = 4_000_000


def group_folds(sizes: Mapping[str, int], folds: int = INNER_FOLDS) -> dict[str, int]:
    """Each group, the largest first (ties: the later name first), to the fold with the fewest rows so far."""
    if len(sizes) < folds:
        raise ValueError(f"{len(sizes)} groups cannot make {folds} inner folds")
    load, out = [0] * folds, {}
    for g in sorted(sorted(sizes, reverse=True), key=lambda g: -sizes[g]):
        out[g] = min(range(folds), key=lambda f: (load[f], f))
        load[out[g]] += sizes[g]
    return out


@dataclass
class Plan:
    """tests: the outer groups. cells: the pairs (outer value, inner value). Fit (t, f) has number t * (folds + 1) + f;
    f = folds is the one that predicts. train, valid, hold: fits x cells, whether a fit trains on, validates or tests a
    cell. groups: the fold of each inner group, by outer group."""

    tests: list[str]
    folds: int
    cells: list[tuple[str, str]]
    train: np.ndarray
    valid: np.ndarray
    hold: np.ndarray
    groups: dict[str, dict[str, int]]

    def fit(self, test: str, fold: int) -> int:
        return self.tests.index(test) * (self.folds + 1) + fold

    def inner_hashes(self, test: str, fold: int) -> tuple[str, str]:
        """SHA-256 of the sorted names of the inner groups that a fold trains on, and of those that it validates."""
        of = self.groups[test]
        sha = lambda names: hashlib.sha256(json.dumps(sorted(names)).encode()).hexdigest()
        return sha([g for g, f in of.items() if f != fold]), sha([g for g, f in of.items() if f == fold])

    def marked(self, rows: DataFrame, outer: str, inner: str) -> DataFrame:
        """rows with the number of their cell, __cell."""
        table = rows.sparkSession.createDataFrame([(*c, k) for k, c in enumerate(self.cells)], "__o string, __i string, __cell int")
        return rows.join(F.broadcast(table), (F.col(outer) == F.col("__o")) & (F.col(inner) == F.col("__i"))).drop("__o", "__i")


def planned(rows: DataFrame, outer: str, inner: str = "dataset_id", tests: Sequence[str] | None = None, folds: int = INNER_FOLDS) -> Plan:
    """Who trains, validates and tests; ValueError if too few groups are left for the folds, or more than the driver deals out."""
    sizes = rows.groupBy(F.col(outer).alias("o"), F.col(inner).alias("i")).count().limit(MOST_GROUPS + 1).collect()
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    tests = sorted(tests if tests is not None else {r["o"] for r in sizes if r["o"] != CLEAN})
    cells = sorted((r["o"], r["i"]) for r in sizes)
    train, valid, hold = (np.zeros((len(tests) * (folds + 1), len(cells)), bool) for _ in range(3))
    groups = {}
    for k, test in enumerate(tests):
        left: dict[str, int] = {}
        for r in sizes:
            if r["o"] != test:
                left[r["i"]] = left.get(r["i"], 0) + r["count"]
        groups[test] = of = group_folds(left, folds)
        at = k * (folds + 1)
        for c, (o, i) in enumerate(cells):
            if o == test:
                hold[at + folds, c] = True
            else:
                train[at : at + folds + 1, c] = True
                train[at + of[i], c] = False
                valid[at + of[i], c] = True
    return Plan(tests, folds, cells, train, valid, hold, groups)


def _matrix(batch: pa.RecordBatch | pa.Table, first: int) -> np.ndarray:
    """Columns from the one at `first`, as doubles, null as NaN."""
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(first, batch.num_columns)])


def medians_of(rows: DataFrame, names: Sequence[str], train: np.ndarray) -> np.ndarray:
    """fits x names: each fit's median of the values that are present, over the cells it trains on (0 if there are none).

    rows: __cell and names. Values are counted by bucket and cell, from which each fit's middle ranks are located; only the
    distinct values of buckets with a median are read. The bounds of the buckets come from a sketch and need not be exact.
    The values are written once: means that are summed anew in another order would change buckets between the passes.
    """
    names = list(names)
    narrow = rows.select("__cell", *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in names])
    narrow = stored(narrow, "medians")
    steps = [k / BUCKETS for k in range(BUCKETS + 1)]
    sketch = narrow.agg(*[F.percentile_approx(c, steps, 20 * BUCKETS).alias(f"e{k}") for k, c in enumerate(names)]).first()
    edges = [np.unique(np.array(sketch[k] if sketch[k] is not None else [0.0])) for k in range(len(names))]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, x = batch.column(0).to_numpy(), _matrix(batch, 1)
            for k, e in enumerate(edges):
                real = ~np.isnan(x[:, k])
                at, n = np.unique(np.searchsorted(e, x[real, k], "left") * len(train[0]) + cell[real], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at // len(train[0])), pa.array(at % len(train[0])), pa.array(n)], ["k", "bucket", "cell", "n"])

    found = narrow.mapInArrow(counted, "k int, bucket long, cell long, n long").groupBy("k", "bucket", "cell").agg(F.sum("n").alias("n")).collect()
    counts = [np.zeros((len(e) + 1, len(train[0]))) for e in edges]
    for r in found:
        counts[r["k"]][r["bucket"], r["cell"]] = r["n"]
    out = np.zeros((len(train), len(names)))
    ranks, needed = [], []
    for by_cell in counts:
        upto = (by_cell @ train.T.astype(float)).cumsum(0)  # buckets x fits
        total = upto[-1]
        two = np.stack(((total - 1) // 2, total // 2))
        at = np.stack([(upto <= t).sum(0) for t in two]).clip(max=len(by_cell) - 1)
        ranks.append((total, two - np.where(at > 0, np.take_along_axis(upto, np.maximum(at - 1, 0), 0), 0), at))
        needed.append(np.unique(at[:, total > 0]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, x = batch.column(0).to_numpy(), _matrix(batch, 1)
            for k, e in enumerate(edges):
                some = np.flatnonzero(~np.isnan(x[:, k]) & np.isin(np.searchsorted(e, x[:, k], "left"), needed[k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(x[some, k]), pa.array(cell[some], pa.int64())], ["k", "x", "cell"])

    values = narrow.mapInArrow(read, "k int, x double, cell long").groupBy("k", "x", "cell").agg(F.count(F.lit(1)).alias("n")).limit(MOST_VALUES + 1).collect()
    if len(values) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} distinct values stand where the medians are")
    for k, (total, rest, at) in enumerate(ranks):
        mine = [r for r in values if r["k"] == k]
        if not mine:
            continue
        x, place = np.unique([r["x"] for r in mine], return_inverse=True)
        by_cell = np.zeros((len(x), len(train[0])))
        by_cell[place, [r["cell"] for r in mine]] = [r["n"] for r in mine]
        by_fit = by_cell @ train.T.astype(float)
        bucket = np.searchsorted(edges[k], x, "left")
        middle = np.zeros((2, len(train)))
        for j in range(2):
            for b in np.unique(at[j]):
                fits = np.flatnonzero((at[j] == b) & (total > 0))
                own = np.flatnonzero(bucket == b)
                if len(fits):
                    upto = by_fit[np.ix_(own, fits)].cumsum(0)
                    middle[j, fits] = x[own[(upto <= rest[j, fits]).sum(0)]]
        out[:, k] = np.where(total > 0, middle[0] + (middle[1] - middle[0]) / 2, 0.0)
    return out


class TrainingOnly:
    """Medians, means and scales of the training rows of each fit, and the moments that ridge regression needs."""

    def __init__(self, rows: DataFrame, plan: Plan, names: Sequence[str], target: str):
        """rows: __cell, names and target."""
        self.names, p = list(names), len(names)
        self.medians = medians_of(rows, names, plan.train)
        gone = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in names]
        pattern = F.array(*[F.when(g, 1.0).otherwise(0.0) for g in gone])
        zeroed = rows.select("__cell", pattern.alias("gap"), *[F.when(g, 0.0).otherwise(F.col(c).cast("double")).alias(f"x{k}") for k, (c, g) in enumerate(zip(names, gone, strict=True))], F.col(target).cast("double").alias(f"x{p}"))
        pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
        sums = zeroed.groupBy("__cell", "gap").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"x{i}") for i in range(p + 1)]).alias("s"), F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("q")).collect()
        fits = len(plan.train)
        self.n, self.s, self.q = np.zeros(fits), np.zeros((fits, p + 1)), np.zeros((fits, p + 1, p + 1))
        for r in sums:
            of = np.flatnonzero(plan.train[:, r["__cell"]])
            s, q = np.array(r["s"]), np.zeros((p + 1, p + 1))
            for (i, j), v in zip(pairs, r["q"], strict=True):
                q[i, j] = q[j, i] = v
            put = np.zeros((len(of), p + 1))  # what each fit puts into the gaps
            put[:, :p] = self.medians[of] * np.array(r["gap"])
            self.n[of] += r["n"]
            self.s[of] += s + r["n"] * put
            self.q[of] += q + put[:, :, None] * s + s[:, None] * put[:, None] + r["n"] * put[:, :, None] * put[:, None]

    def ridge(self, fit: int, features: Sequence[str], alpha: float) -> tuple[np.ndarray, float]:
        """Weights over all names (0 for those outside features) and intercept, on features scaled by the fit's own sds."""
        at = np.array([self.names.index(c) for c in features] + [len(self.names)])
        n, s, q = self.n[fit], self.s[fit][at], self.q[fit][np.ix_(at, at)]
        mean = s / n
        cov = q / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
        sd[sd < 1e-12] = 1.0
        w = np.linalg.solve(cov[:-1, :-1] / np.outer(sd, sd) * n + alpha * np.eye(len(sd)), cov[:-1, -1] / sd * n) / sd
        out = np.zeros(len(self.names))
        out[at[:-1]] = w
        return out, float(mean[-1] - w @ mean[:-1])


def _errors(rows: DataFrame, names: Sequence[str], target: str, plan: Plan, medians: np.ndarray, models: Mapping[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each fit the mean absolute error, over the cells that it validates, of each of its models (a row of weights and the intercept)."""
    held = rows.sparkSession.sparkContext.broadcast((plan.valid, medians, dict(models)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        valid, middle, own = held.value
        sums = {f: np.zeros(len(m)) for f, m in own.items()}
        n = dict.fromkeys(own, 0)
        for batch in batches:
            cell, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch, 2)
            for c in np.unique(cell).tolist():
                at = cell == c
                for f in np.flatnonzero(valid[:, c]).tolist():
                    full = np.where(np.isnan(x[at]), middle[f], x[at])
                    sums[f] += np.abs(full @ own[f][:, :-1].T + own[f][:, -1] - y[at][:, None]).sum(0)
                    n[f] += int(at.sum())
        for f, e in sums.items():
            if n[f]:
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(e), pa.int32()), pa.array(np.arange(len(e)), pa.int32()), pa.array(e), pa.array([n[f]] * len(e), pa.int64())], ["fit", "model", "e", "n"])

    parts = rows.select("__cell", F.col(target).cast("double"), *[F.col(c).cast("double") for c in names]).mapInArrow(run, "fit int, model int, e double, n long")
    out = {f: np.zeros(len(m)) for f, m in models.items()}
    for r in parts.groupBy("fit", "model").agg((F.sum("e") / F.sum("n")).alias("mae")).collect():
        out[r["fit"]][r["model"]] = r["mae"]
    return out


def _numbers(rows: DataFrame, blocks: Mapping[str, Sequence[str]], target: str, outer: str, inner: str, tests: Sequence[str] | None, folds: int, keep: Sequence[str]) -> tuple[DataFrame, Plan, list[str], list[str]]:
    """The rows that have a target and groups, written once with __cell and __row, the plan, the features and the columns kept."""
    for features in blocks.values():
        check_features(features)
    names = sorted({c for features in blocks.values() for c in features})
    keep = [c for c in keep if c not in names and c != target]
    needed = list(dict.fromkeys([outer, inner, target, *names, *keep]))
    whole = stored(rows.dropna(subset=[target, outer, inner]).select(*needed), "evaluated")
    plan = planned(whole, outer, inner, tests, folds)
    return plan.marked(whole, outer, inner), plan, names, keep


_TRIED = "inner_fold int, inner_fold_mae double, mean_candidate_mae double, selected boolean, tie_status boolean, inner_training_group_sha256 string, inner_validation_group_sha256 string"


def nested_ridge(
    rows: DataFrame, blocks: Mapping[str, Sequence[str]], target: str, outer: str, *, inner: str = "dataset_id", tests: Sequence[str] | None = None, alphas: Sequence[float] = ALPHAS, folds: int = INNER_FOLDS, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(predictions, candidates) of ridge models of each block, each outer group predicted by a model of the others.

    The penalty of a block and outer group is the one with the least mean over the inner folds of the mean
    absolute error (ties within 1e-7: the larger). Missing features are the medians, and scales the population
    sds, of the rows that a fit trains on. predictions: keep, outer_test_group, feature_block, observed,
    predicted, alpha. candidates: outer_test_group, feature_block, alpha, inner_fold, inner_fold_mae,
    mean_candidate_mae, selected, tie_status, and hashes of the groups that the fold trains on and validates. Rows with a
    null target or group are left out; too few groups raise ValueError.
    """
    marked, plan, names, keep = _numbers(rows, blocks, target, outer, inner, tests, folds, keep)
    fitted = TrainingOnly(marked, plan, names, target)
    tried = [(block, a) for block in blocks for a in sorted(alphas)]
    models = {}
    for test in plan.tests:
        for f in range(folds):
            fit = plan.fit(test, f)
            models[fit] = np.array([np.append(*fitted.ridge(fit, blocks[block], a)) for block, a in tried])
    errors = _errors(marked, names, target, plan, fitted.medians, models)
    chosen, candidates = [], []
    for test in plan.tests:
        mae = np.array([errors[plan.fit(test, f)] for f in range(folds)])
        mean = mae.mean(0)
        last = plan.fit(test, folds)
        middle = [float(v) for v in fitted.medians[last]]
        for block, features in blocks.items():
            own = [k for k, (b, _) in enumerate(tried) if b == block]
            tied = [k for k in own if mean[k] - mean[own].min() <= TIE]
            best = max(tied, key=lambda k: tried[k][1])
            w, b = fitted.ridge(last, features, tried[best][1])
            chosen.append((test, block, tried[best][1], [float(v) for v in w], b, middle))
            candidates += [(test, block, tried[k][1], f, float(mae[f, k]), float(mean[k]), k == best, len(tied) > 1 and k in tied, *plan.inner_hashes(test, f)) for k in own for f in range(folds)]
    spark = rows.sparkSession
    table = spark.createDataFrame(chosen, "outer_test_group string, feature_block string, alpha double, __w array<double>, __b double, __m array<double>")
    x = F.array(*[F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in names])
    full = F.zip_with(x, "__m", lambda x, m: F.coalesce(x, m))
    dot = F.aggregate(F.zip_with(full, "__w", lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    held = marked.join(F.broadcast(table), F.col(outer) == F.col("outer_test_group"))
    predictions = held.select(*keep, "outer_test_group", "feature_block", F.col(target).cast("double").alias("observed"), (dot + F.col("__b")).alias("predicted"), "alpha")
    return predictions, spark.createDataFrame(candidates, f"outer_test_group string, feature_block string, alpha double, {_TRIED}")


@dataclass(frozen=True)
class Fit:
    """A boosted fit: its block, the place of its setting in the grid, and the rounds at which it is read."""

    block: str
    setting: int
    stops: tuple[int, ...]


def _boosted(y: np.ndarray, x: np.ndarray, train: np.ndarray, fits: Sequence[Fit], names: Sequence[str], blocks: Mapping[str, Sequence[str]], grid: Sequence[boosting.Setting]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place of the fit, rounds, predictions of all rows); missing features are the training rows' medians."""
    bins = boosting.binned(boosting.filled(x, train), train)
    uses = np.array([[c in blocks[f.block] for c in names] for f in fits])
    kind = [grid[f.setting] for f in fits]
    stops = sorted({s for f in fits for s in f.stops})
    for done, predicted in boosting.boost(bins, y, train, uses, np.array([s.rate for s in kind]), np.array([s.leaves for s in kind]), np.array([s.l2 for s in kind]), stops):
        for k, f in enumerate(fits):
            if done in f.stops:
                yield k, done, predicted[k]


def _boosted_sets(marked: DataFrame, plan: Plan, names: Sequence[str], target: str, blocks: Mapping[str, Sequence[str]], grid: Sequence[boosting.Setting], sets: Mapping[int, Sequence[Fit]], whole: bool, key: str) -> DataFrame:
    """fit, block, setting, rounds and, with whole, key and predicted of each tested row, else the error sum e over n validated rows.

    sets: the boosted fits of each set of training rows, by the plan's number of that set. A task has some of the fits of
    one set. A table of up to BROADCAST_ROWS rows is sent to all tasks; of a larger one, tasks get the rows of their set.
    """
    spark = marked.sparkSession
    n = marked.count()
    per = max(1, TASK_ROWS // max(1, n))
    jobs = [(s, k, list(fits[a : a + per])) for s, fits in sets.items() for k, a in enumerate(range(0, len(fits), per))]
    specs = {(s, k): fits for s, k, fits in jobs}
    role = plan.hold if whole else plan.valid
    schema = "fit int, block string, setting int, rounds int, " + ("row long, predicted double" if whole else "e double, n long")
    numbers = marked.select("__cell", F.col(key).cast("long"), F.col(target).cast("double"), *[F.col(c).cast("double") for c in names])

    def results(s: int, part: int, table: pa.Table | pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cell, row, y = (table.column(k).to_numpy() for k in range(3))
        x = _matrix(table, 3)
        fits = specs[s, part]
        use = plan.train[s] | role[s]
        some = np.flatnonzero(use[cell])
        some = some[np.lexsort((*x[some].T, y[some], cell[some]))]  # sums do not follow the order of rows
        cell, row, y, x = cell[some], row[some], y[some], x[some]
        asked = role[s][cell]
        for k, rounds, predicted in _boosted(y, x, plan.train[s][cell], fits, names, blocks, grid):
            m = int(asked.sum()) if whole else 1
            first = [pa.array([s] * m, pa.int32()), pa.array([fits[k].block] * m, pa.string()), pa.array([fits[k].setting] * m, pa.int32()), pa.array([rounds] * m, pa.int32())]
            last = [pa.array(row[asked]), pa.array(predicted[asked])] if whole else [pa.array([float(np.abs(predicted[asked] - y[asked]).sum())]), pa.array([int(asked.sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays([*first, *last], [c.split()[0] for c in schema.split(", ")])

    deal = spark.createDataFrame([(s, k) for s, k, _ in jobs], "s int, part int")
    if n <= BROADCAST_ROWS:
        data = spark.sparkContext.broadcast(numbers.toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from results(s, part, data.value)

        return deal.repartition(len(jobs), "s", "part").mapInArrow(run, schema)
    of = [(c, s, part) for s, part, _ in jobs for c in np.flatnonzero(plan.train[s] | role[s]).tolist()]
    roles = spark.createDataFrame(of, "__cell int, s int, part int")
    dealt = numbers.join(F.broadcast(roles), "__cell")

    def grouped(group: pa.Table) -> pa.Table:
        s, part = group.column("s")[0].as_py(), group.column("part")[0].as_py()
        return pa.Table.from_batches(list(results(s, part, group.drop_columns(["s", "part"]))))

    return dealt.groupBy("s", "part").applyInArrow(grouped, schema)


def nested_boosting(
    rows: DataFrame, blocks: Mapping[str, Sequence[str]], target: str, outer: str, *, inner: str = "dataset_id", tests: Sequence[str] | None = None, grid: Sequence[boosting.Setting] = boosting.GRID, folds: int = INNER_FOLDS, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """As nested_ridge, with histogram gradient boosting tuned over grid; candidate_params and params name a setting.

    Settings that differ in their rounds only share a run. Of settings tied within 1e-7 fewer leaves, then fewer rounds, the
    larger penalty and the slower steps are taken. The rows are scenario results: one fit's rows fit into a task.
    """
    marked, plan, names, keep = _numbers(rows, blocks, target, outer, inner, tests, folds, keep)
    marked = stored(marked.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    runs: dict[tuple, list[int]] = {}
    for k, s in enumerate(grid):
        runs.setdefault((s.leaves, s.l2, s.rate), []).append(k)
    tuned = [Fit(b, of[0], tuple(sorted({grid[k].rounds for k in of}))) for b in blocks for of in runs.values()]
    sets = {plan.fit(t, f): tuned for t in plan.tests for f in range(folds)}
    found = _boosted_sets(marked, plan, names, target, blocks, grid, sets, False, "__row")
    setting = {(of[0], grid[k].rounds): k for of in runs.values() for k in of}
    mae = {t: {b: np.zeros((len(grid), folds)) for b in blocks} for t in plan.tests}
    for r in found.groupBy("fit", "block", "setting", "rounds").agg((F.sum("e") / F.sum("n")).alias("mae")).collect():
        t, f = divmod(r["fit"], folds + 1)
        mae[plan.tests[t]][r["block"]][setting[r["setting"], r["rounds"]], f] = r["mae"]
    candidates, last, taken = [], {}, []
    for test in plan.tests:
        last[plan.fit(test, folds)] = of = []
        for block in blocks:
            one = mae[test][block]
            mean = one.mean(1)
            tied = [k for k in range(len(grid)) if mean[k] - mean.min() <= TIE]
            best = min(tied, key=lambda k: grid[k].preference())
            of.append(Fit(block, best, (grid[best].rounds,)))
            taken.append((test, block, grid[best].text()))
            candidates += [(test, block, grid[k].text(), f, float(one[k, f]), float(mean[k]), k == best, len(tied) > 1 and k in tied, *plan.inner_hashes(test, f)) for k in range(len(grid)) for f in range(folds)]
    spark = rows.sparkSession
    settings = spark.createDataFrame(taken, "outer_test_group string, feature_block string, params string")
    predicted = _boosted_sets(marked, plan, names, target, blocks, grid, last, True, "__row").select(F.col("row").alias("__row"), F.col("block").alias("feature_block"), "predicted")
    held = marked.join(predicted, "__row").withColumn("outer_test_group", F.col(outer)).join(F.broadcast(settings), ["outer_test_group", "feature_block"])
    predictions = held.select(*keep, "outer_test_group", "feature_block", F.col(target).cast("double").alias("observed"), "predicted", "params")
    return predictions, spark.createDataFrame(candidates, f"outer_test_group string, feature_block string, candidate_params string, {_TRIED}")


SCOPES = {("primary", "LODO"): "dataset_id", ("primary", "LOSFO"): "shift_family", ("secondary", "LODO"): "dataset_id", ("secondary", "LOSFO"): "shift_family"}
#: The fields of a prediction that its record hash covers, in order.
RECORD = ["analysis_scope", "outer_eval_type", "outer_test_group", "dataset_id", "outer_fold", "condition", "shift_family", "severity", "method", "seed", "feature_block", "regressor", "observed", "predicted", "absolute_error", "squared_error"]


def scoped(joined: DataFrame, scope: str) -> DataFrame:
    """The rows of a scope: primary leaves the clean condition out, secondary has all."""
    if scope not in ("primary", "secondary"):
        raise ValueError(f"no scope named {scope}")
    return joined.where(F.col("condition") != CLEAN) if scope == "primary" else joined


def evaluate(
    joined: DataFrame, scope: str, kind: str, *, regressor: str = RIDGE, blocks: Mapping[str, Sequence[str]] | None = None, alphas: Sequence[float] = ALPHAS, grid: Sequence[boosting.Setting] = boosting.GRID, folds: int = INNER_FOLDS
) -> tuple[DataFrame, DataFrame]:
    """(prediction records, candidates) of one scope (primary or secondary), kind (LODO or LOSFO) and regressor.

    Primary LODO has the ablations and increments beside the six blocks. Records have absolute and squared
    errors and record_sha256 over their fields, doubles rounded to 7 places.
    """
    if regressor not in (RIDGE, BOOSTED):
        raise ValueError(f"no regressor named {regressor}")
    blocks = blocks or (BLOCKS | ABLATIONS | INCREMENTS if (scope, kind) == ("primary", "LODO") else BLOCKS)
    options = {"folds": folds, "keep": [*KEY, "shift_family", "severity"]}
    fitted = nested_ridge if regressor == RIDGE else nested_boosting
    found, tried = fitted(scoped(joined, scope), blocks, "delta_ari", SCOPES[scope, kind], **options, **({"alphas": alphas} if regressor == RIDGE else {"grid": grid}))
    e = F.col("observed") - F.col("predicted")
    out = found.withColumns({"analysis_scope": F.lit(scope), "outer_eval_type": F.lit(kind), "regressor": F.lit(regressor), "absolute_error": F.abs(e), "squared_error": e * e})
    return out.withColumn("record_sha256", prediction_hash(out)), tried.withColumns({"analysis_scope": F.lit(scope), "outer_eval_type": F.lit(kind), "regressor": F.lit(regressor)})


def prediction_hash(rows: DataFrame) -> Column:
    """SHA-256 of a prediction's fields."""
    kinds = dict(rows.dtypes)
    return record_hash(*[F.round(c, 7) if kinds[c] in ("double", "float") else F.col(c) for c in RECORD])


JOB = ["analysis_scope", "outer_eval_type", "outer_test_group", "feature_block", "regressor"]


def protocol(joined: DataFrame, blocks: Mapping[str, Sequence[str]] = BLOCKS, alphas: Sequence[float] = ALPHAS, folds: int = INNER_FOLDS, grid: Sequence[boosting.Setting] = boosting.GRID) -> str:
    """What a stored evaluation is bound to: the joined table, the blocks and the tuning."""
    return config_hash({"joined": table_hash(joined), "blocks": {k: list(v) for k, v in blocks.items()}, "alphas": list(alphas), "folds": folds, "grid": [s.text() for s in grid]})


def resumed(joined: DataFrame, scope: str, kind: str, results: ResultTable, *, regressor: str = RIDGE, **options) -> DataFrame:
    """The prediction records of one evaluation: those that results has, which must be of this protocol, and the
    rest of the jobs (outer group and block), which are computed and appended."""
    blocks = options.pop("blocks", BLOCKS)
    spark, outer = joined.sparkSession, SCOPES[scope, kind]
    rows = scoped(joined, scope)
    groups = sorted(r[0] for r in rows.where(F.col(outer) != CLEAN).select(outer).distinct().limit(MOST_GROUPS + 1).collect())
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    jobs = spark.createDataFrame([(scope, kind, g, b, regressor) for g in groups for b in blocks], ", ".join(f"{c} string" for c in JOB))
    held = rows.where(F.col(outer).isin(groups)).select(F.col(outer).alias("outer_test_group"), *KEY)
    universe = jobs.join(held, "outer_test_group").select(*JOB, *KEY)
    open_ = sorted(r[0] for r in results.todo(universe).select("feature_block").distinct().collect())
    if open_:
        found, _ = evaluate(joined, scope, kind, regressor=regressor, blocks={b: blocks[b] for b in open_}, **options)
        results.append(found.drop("record_sha256", "alpha", "params"), sorted(SCOPES).index((scope, kind)))
    return results.valid().join(F.broadcast(jobs), JOB, "left_semi")


def run_evaluation(joined: DataFrame, *, scopes: Sequence[tuple[str, str]] = tuple(SCOPES), regressor: str = BOOSTED, control: str | None = RIDGE, results: ResultTable | None = None, **options) -> tuple[dict, dict[tuple[str, str, str], DataFrame]]:
    """The evaluations of the scopes, their errors by block, and the verdict on the primary ones; (report, prediction records).

    The verdict is on the regressor; the control is fitted beside it where data sets are left out of the primary scope. The joined
    table and the records are written once to the shared folder and read from there; with results, jobs that it has are not
    run again, and those that are run are appended to it.
    """
    joined = stored(joined, "joined")
    runs = [(*k, regressor) for k in scopes] + ([("primary", "LODO", control)] if control and control != regressor else [])

    def records_of(scope: str, kind: str, name: str) -> DataFrame:
        if results is not None:
            return resumed(joined, scope, kind, results, regressor=name, **options)
        return evaluate(joined, scope, kind, regressor=name, **options)[0]

    records = {k: stored(records_of(*k), "predictions") for k in runs}
    return report(records, regressor), records


def report(records: Mapping[tuple[str, str, str], DataFrame], regressor: str = BOOSTED) -> dict:
    """Errors by block of each evaluation (scope, kind, regressor), paired deltas, bootstrap bounds and the verdict, all from the prediction records."""
    mae = {k: {r["feature_block"]: r["mae"] for r in regression_metrics(p, ["feature_block"]).collect()} for k, p in records.items()}
    pairs = [("P0", "P4"), ("P3", "P4")]
    by_set = paired_deltas(records["primary", "LODO", regressor], "dataset_id", pairs)
    families = paired_deltas(records["primary", "LOSFO", regressor], "shift_family", pairs).orderBy("shift_family").collect()
    boot = {c: paired_bootstrap(by_set, c, "dataset_id").first() for c in ("delta_04", "delta_34")}
    sets = by_set.orderBy("dataset_id").collect()
    v = verdict(mae["primary", "LODO", regressor], [r["delta_04"] for r in sets], [r["delta_04"] for r in families], [r["delta_34"] for r in families], *(boot[c]["lo"] for c in boot))
    deltas = {"dataset_id": {r["dataset_id"]: [r["delta_04"], r["delta_34"]] for r in sets}, "shift_family": {r["shift_family"]: [r["delta_04"], r["delta_34"]] for r in families}}
    return {"mae": {"_".join(k): m for k, m in mae.items()}, "deltas": deltas, "bootstrap": {c: [r["lo"], r["hi"]] for c, r in boot.items()}, **v}


def save_evaluation(records: Mapping[tuple[str, str, str], DataFrame], path: str, regressor: str = BOOSTED) -> dict:
    """The prediction tables and the report that follows from them, chained by their hashes; the chain is stored with them."""
    spark = next(iter(records.values())).sparkSession
    names = {"_".join(k): k for k in records}
    for name, k in names.items():
        records[k].write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    kept = {k: spark.read.parquet(f"{path}/{name}.parquet") for name, k in names.items()}
    chain = store.chained({name: store.leaves(spark, f"{path}/{name}.parquet") for name in names}, report(kept, regressor))
    spark.createDataFrame([(json.dumps(chain, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/chain.json")
    return chain


def evaluation_problems(spark: SparkSession, path: str, regressor: str = BOOSTED, tolerance: float = 1e-9) -> list[str]:
    """What speaks against a stored evaluation: files of prediction tables that changed, records whose hash is not
    their own, and numbers of the report that do not follow from the predictions (by more than the tolerance)."""
    chain = json.loads(spark.read.text(f"{path}/chain.json", wholetext=True).first()[0])
    names = sorted(chain["leaves"])
    out = store.changed(spark, chain, {name: f"{path}/{name}.parquet" for name in names})
    if any("cannot be read" in p for p in out):
        return out
    records = {tuple(name.split("_", 2)): spark.read.parquet(f"{path}/{name}.parquet") for name in names}
    for k, rows in records.items():
        bad = rows.where(~F.col("record_sha256").eqNullSafe(prediction_hash(rows))).count()
        if bad:
            out.append(f"{'_'.join(k)}: {bad} records are not those of their hash")
    now = json.loads(json.dumps(report(records, regressor)))
    return out + [f"report{d}" for d in store.differences(chain["report"], now, tolerance)]
