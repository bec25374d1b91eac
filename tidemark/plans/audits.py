"""Panels and audits: objective landscapes of the fuzzifier, recovery of permutations,
sensitivity to the weight of the two costs, and verification of signal and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import fuzzifier
from ..operators import alignment, clustering, nested, signals
from ..operators import evaluation as ev
from ..operators.passes import Points, Program, together
from ..operators.sums import summed
from ..sources.shared import stored
from .data_queries import rounded
from .evaluation_queries import _PRED, _UNIVERSE, CONDITIONS, TABLES, predictions, signal_table
from .model_queries import BASE, M, memberships, moved, parts, second_model
from .registry import query

GRID = (1.1, 1.5, 2.0)
ETAS = (0.0, 0.25, 0.5, 0.75, 1.0)


def grand_objective(points: DataFrame, k: int, m: float, x: str = "x") -> float:
    """The fuzzy objective where all k centers are the mean and all memberships 1 / k: sums of squares suffice."""
    s = summed(points, lambda a: np.concatenate(([len(a), (a**2).sum()], a.sum(0))), x)
    spread = s[1] - (s[2:] ** 2).sum() / s[0]
    return float(k * (1 / k) ** m * spread)


def landscape(points: DataFrame, k: int, seed: int, grid: Sequence[float] = GRID, start: np.ndarray | None = None) -> list[dict]:
    """For each fuzzifier the objective at the start, at the end and at the grand mean, and whether the end is degenerate.

    All fits go on until they rest, in the same passes."""
    fits, _ = together(points, {m: (0, clustering.fcm(k, seed, m, start)) for m in grid})
    out = []
    for m in grid:
        model = fits[m].model
        grand = grand_objective(points, k, m)
        found = clustering.degeneracy(points, model)
        out.append(
            {"m": float(m), "first": model.history[0], "last": model.objective, "grand": grand, "grand_is_lower": bool(model.objective - grand > 1e-4), "is_grand": bool(abs(model.objective - grand) < 1e-4 * max(abs(grand), 1e-9))}
            | {"degenerate": bool(found["degenerate"]), "distinct": int(found["distinct"]), "fpc_gap": float(found["fpc_gap"])}
        )
    return out


@query("grand_centroid_objective", f"WITH {BASE}, s AS (SELECT sum(v) FROM (SELECT i, sum(pow(v, 2)) - pow(sum(v), 2) / count(*) AS v FROM src GROUP BY 1)), k AS (SELECT count(DISTINCT label) AS k FROM src) SELECT m, round(k * pow(1.0 / k, m) * (SELECT * FROM s), 4) AS objective FROM k, (VALUES (1.1::DOUBLE), (1.5), (2.0)) t(m)")
def grand_centroid_objective(spark: SparkSession, sf: str) -> DataFrame:
    source, _, v = parts(spark, sf)
    return spark.createDataFrame([(m, round(grand_objective(source, len(v), m), 4)) for m in GRID], "m double, objective double")


@query("fuzzifier_landscape")
def fuzzifier_landscape(spark: SparkSession, sf: str) -> DataFrame:
    """Fits from class means for each fuzzifier of the grid."""
    source, _, v = parts(spark, sf)
    rows = landscape(stored(source, "source"), len(v), 1, start=v)
    return rounded(spark.createDataFrame([tuple(r.values()) for r in rows], "m double, first double, last double, grand double, grand_is_lower boolean, is_grand boolean, degenerate boolean, distinct int, fpc_gap double"))


@query("fuzzifier_policies")
def fuzzifier_policies(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed fuzzifier 2 against the one of the dimension, from seeded centers."""
    source, _, v = parts(spark, sf)
    source, out = stored(source, "source"), []
    policies = (("fixed", 2.0), ("dimension", fuzzifier(v.shape[1])))
    fits, _ = together(source, {policy: (0, clustering.fcm(len(v), 1, m)) for policy, m in policies})
    for policy, m in policies:
        model = fits[policy].model
        d = clustering.degeneracy(source, model)
        out.append((policy, float(m), model.status, float(d["fpc_gap"]), float(d["mean_max"]), int(d["distinct"]), bool(d["degenerate"])))
    return rounded(spark.createDataFrame(out, "policy string, m double, status string, fpc_gap double, mean_max double, distinct int, degenerate boolean"))


def eta_panel(source: DataFrame, v: np.ndarray, candidate: np.ndarray, etas: Sequence[float] = ETAS, m: float = M) -> list[tuple[float, list[int], float, float, bool]]:
    """For each weight of the center costs: permutation, cost, margin, ambiguous. One pass gives all overlaps."""
    bank = signals.bank(source, 1, "reference-bank")
    scales, _, _ = alignment.reference_scales(memberships(source, v, m=m), v)
    overlap = alignment.soft_jaccard(memberships(memberships(bank, v, "u_ref", m), candidate, "u_cand", m))
    costs = alignment.center_costs(v, candidate, scales)
    found = [(e, alignment.align(alignment.combined_costs(costs, overlap, e))) for e in etas]
    return [(e, a.permutation, a.cost, a.margin, a.ambiguous) for e, a in found]


@query("permutation_recovery", f"WITH {BASE}, k AS (SELECT count(DISTINCT label) AS k FROM src) SELECT unnest(range(k))::INTEGER AS cluster, (k - 1 - unnest(range(k)))::INTEGER AS candidate FROM k")
def permutation_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """A model whose clusters stand in reverse order, moved by a shift, is put back: all clusters, both costs."""
    source, _, v = parts(spark, sf)
    [(_, permutation, *_)] = eta_panel(source, v, second_model(v)[::-1], [0.5])
    return spark.createDataFrame(list(enumerate(permutation)), "cluster int, candidate int")


@query("eta_sensitivity")
def eta_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment of the whole models under five weights of the two costs."""
    source, _, v = parts(spark, sf)
    rows = [(e, ",".join(map(str, p)), c, g, bool(a)) for e, p, c, g, a in eta_panel(source, v, second_model(v))]
    return rounded(spark.createDataFrame(rows, "eta double, permutation string, cost double, margin double, ambiguous boolean"))


def aligned_runs(points: Points, runs: dict[tuple[str, str, int], tuple[str, str, int, int]]) -> list[tuple]:
    """Records of runs by (condition, method, seed), each aligned with the run of its method on the source (seed 1), whose rows give scales and overlaps."""
    fits, _ = clustering.fit_many(points, runs)
    pairs = {name: (fits["source", name[1], 1], found) for name, found in fits.items() if name[0] != "source"}
    ready = {name: (ref.model, cand.model) for name, (ref, cand) in pairs.items() if ref.model is not None and cand.model is not None}
    asked: dict[tuple, tuple[str, Program]] = {name: ("source", alignment.overlap_program(ref.of, cand.of)) for name, (ref, cand) in ready.items()}
    asked |= {("scales", m): ("source", alignment.scales_program(fits["source", m, 1].model.of, fits["source", m, 1].model.centers)) for m in {m for _, m, _ in ready}}
    measured, _ = together(points, asked)
    out: list[tuple] = []
    for (condition, method, seed), (ref, cand) in pairs.items():
        errors = [ref.error, cand.error] if (condition, method, seed) not in ready else [measured["scales", method].error, measured[condition, method, seed].error]
        if any(errors):
            out.append((method, condition, seed, None, None, None, None, *errors))
            continue
        (scales, _, _), overlap = measured["scales", method].model, measured[condition, method, seed].model
        a = alignment.align(alignment.combined_costs(alignment.center_costs(ref.model.centers, cand.model.centers, scales), overlap))
        out.append((method, condition, seed, float(a.cost), float(a.margin), float(np.mean([overlap[i, j] for i, j in enumerate(a.permutation)])), bool(a.ambiguous), ref.model.status, cand.model.status))
    return out


@query("alignment_panel")
def alignment_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Fits of a target and of a shifted one, by four methods and two seeds, aligned with the source's fit: cost, margin, overlap, status.

    Scales and overlaps are those of all source rows, which take one more pass."""
    source, target, v = parts(spark, sf)
    tables = {"source": source, "clean": target, "location": moved(target)}
    rows = reduce(DataFrame.unionByName, [t.select("row_id", "x", F.lit(name).alias("of")) for name, t in tables.items()])
    points = Points(stored(rows.repartition(2 * spark.sparkContext.defaultParallelism), "panel"), "of", written=True)
    methods, seeds = ("fcm", "fcm2", "kmeans", "gmm"), (3, 4)
    runs = {("source", m, 1): ("source", m, len(v), 1) for m in methods} | {(c, m, s): (c, m, len(v), s) for c in ("clean", "location") for m in methods for s in seeds}
    out = aligned_runs(points, runs)
    return rounded(spark.createDataFrame(out, "method string, condition string, seed int, cost double, margin double, overlap double, ambiguous boolean, source_status string, candidate_status string"))


def signal_problems(rows: DataFrame, universe: DataFrame, bounds: dict[str, tuple[float | None, float | None]], constant: dict[str, list[str]]) -> DataFrame:
    """check, n: keys that are missing, extra or repeated, values out of bounds, columns that vary where they may not."""
    keys = ev.missing_and_extra(rows, universe).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    names = rows.sparkSession.createDataFrame([("missing",), ("extra",), ("repeated",)], "problem string")
    out = names.join(F.broadcast(keys), "problem", "left").select(F.concat(F.lit("keys "), "problem").alias("check"), F.coalesce("n", F.lit(0)).alias("n"))
    out = out.unionByName(ev.out_of_bounds(rows, bounds).select(F.concat(F.lit("bounds "), "column").alias("check"), F.coalesce("n_bad", F.lit(0)).alias("n")))
    for column, by in constant.items():
        out = out.unionByName(ev.not_constant(rows, by, column).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"constant {column}").alias("check"), "n"))
    return out


@query(
    "signal_verification",
    f"""WITH {TABLES}, {_UNIVERSE}, c AS (SELECT max("D_X") - min("D_X") AS d FROM sig GROUP BY dataset_id, outer_fold, condition)
SELECT 'keys missing' AS "check", count(*) AS n FROM uni ANTI JOIN sig USING (dataset_id, outer_fold, condition, method, seed) UNION ALL SELECT 'keys extra', count(*) FROM sig ANTI JOIN uni USING (dataset_id, outer_fold, condition, method, seed)
UNION ALL SELECT 'keys repeated', 0 UNION ALL SELECT 'bounds D_X', count(*) FILTER ("D_X" < 0 OR "D_X" > 12) FROM sig UNION ALL SELECT 'bounds D_U_C', count(*) FILTER ("D_U_C" < 0) FROM sig UNION ALL SELECT 'constant D_X', count(*) FILTER (d > 0) FROM c""",
)
def signal_verification(spark: SparkSession, sf: str) -> DataFrame:
    """All checks of a signal table, against a universe with one fold too many and one seed too few."""
    rows = signal_table(spark, sf)
    names = rows.select("dataset_id").distinct().withColumn("condition", F.explode(F.array(*[F.lit(c) for c in CONDITIONS.values()])))
    grid = names.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("method", F.lit("fcm"))
    return signal_problems(rows, grid.select(*ev.KEY), {"D_X": (0.0, 12.0), "D_U_C": (0.0, None)}, {"D_X": ["dataset_id", "outer_fold", "condition"]})


def prediction_problems(records: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """check, n: records whose hash or errors are not their own, repeated ones, clean ones in a primary scope, and
    rows that their own group did not hold out."""
    e = F.col("observed") - F.col("predicted")
    held = F.when(F.col("outer_eval_type") == "LODO", F.col("dataset_id")).otherwise(F.col("shift_family"))
    checks = {
        "hash": F.col("record_sha256") != nested.prediction_hash(records),
        "absolute error": F.abs(F.col("absolute_error") - F.abs(e)) > tolerance,
        "squared error": F.abs(F.col("squared_error") - e * e) > tolerance,
        "clean": (F.col("analysis_scope") == "primary") & (F.col("condition") == nested.CLEAN),
        "held out": held != F.col("outer_test_group"),
    }
    flat = records.agg(*[F.sum(c.cast("long")).alias(n) for n, c in checks.items()])
    out = flat.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("n")) for n in checks])).alias("r")).select("r.*")
    twice = records.groupBy(*nested.JOB, *ev.KEY).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(twice.select(F.lit("repeated").alias("check"), "n"))


@query("prediction_verification", f"WITH {TABLES}, {_PRED}, n AS (SELECT count(*) FILTER (seed = 3) AS k, count(*) FILTER (seed = 1) AS t FROM pred) SELECT unnest(['hash', 'absolute error', 'squared error', 'clean', 'held out', 'repeated']) AS \"check\", unnest([k, k, k, 0, 0, t]) AS n FROM n")
def prediction_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the fixed rules; those of one seed were altered after hashing, those of another stand twice."""
    p = predictions(spark, sf)
    e = F.col("observed") - F.col("predicted")
    made = p.withColumns({"analysis_scope": F.lit("primary"), "outer_eval_type": F.lit("LODO"), "outer_test_group": F.col("dataset_id"), "regressor": F.lit("rule"), "absolute_error": F.abs(e), "squared_error": e * e})
    made = made.withColumn("record_sha256", nested.prediction_hash(made))
    altered = made.withColumn("observed", F.when(F.col("seed") == 3, F.col("observed") + 100).otherwise(F.col("observed")))
    return prediction_problems(altered.unionByName(altered.where("seed = 1")))
