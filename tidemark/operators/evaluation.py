"""From signal and quality tables to a verdict: strict join, grouped evaluation, metrics, bootstrap, rules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from .statistics import quantiles
from .sums import summed

KEY = ["dataset_id", "outer_fold", "condition", "method", "seed"]
#: The penalties that the linear control is tuned over.
ALPHAS = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
REPETITIONS = 10_000
SEED = 2026090707
#: Columns that no predictor may be (labels, quality and what follows from them).
FORBIDDEN = {
    "y", "label", "labels", "quality labels", "target", "n_evaluation_rows",
    "ari_clean", "ari_condition", "delta_ari", "nmi_condition", "ami_condition", "quality_target", "quality_record_sha256",
    "dataset_id", "shift_family", "severity", "condition", "outer_fold", "method", "seed", "k", "n", "d", "dimension_d", "dimension_stratum",
    "source_model_fingerprint", "source_model_fingerprint_file_sha256", "shift_spec_sha256", "shift_replay_sha256", "shift_spec_file_sha256",
    "probe_spec_sha256", "probe_spec_file_sha256", "alignment_doc_sha256", "alignment_doc_file_sha256",
}


def check_features(names: Sequence[str]) -> None:
    bad = sorted({n for n in names if n.lower() in FORBIDDEN})
    if bad:
        raise ValueError(f"not allowed as predictors: {bad}")


def stratum(dimension) -> F.Column:
    d = F.col(dimension) if isinstance(dimension, str) else dimension
    return F.when(d <= 20, "low_D").when(d <= 100, "mid_D").otherwise("high_D")


def family(condition: str = "condition"):
    """The family and severity of a condition's name; clean has neither."""
    c = F.col(condition)
    return F.when(c == "clean", "clean").otherwise(F.regexp_replace(c, "_(mild|severe)$", "")), F.when(c == "clean", "none").otherwise(F.regexp_extract(c, "_(mild|severe)$", 1))


def key_problems(signals: DataFrame, quality: DataFrame, key: list[str] = KEY) -> DataFrame:
    """side, problem, keys: repeated keys on each side and keys that the other side lacks."""
    out = None
    for name, one, other in (("signals", signals, quality), ("quality", quality, signals)):
        twice = one.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("keys")).select(F.lit(name).alias("side"), F.lit("repeated").alias("problem"), "keys")
        alone = one.join(other.select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("keys")).select(F.lit(name).alias("side"), F.lit("unmatched").alias("problem"), "keys")
        out = twice.unionByName(alone) if out is None else out.unionByName(twice).unionByName(alone)
    return out


def strict_join(signals: DataFrame, quality: DataFrame, dimensions: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row for each key, which both sides must have exactly once; raises ValueError otherwise.

    Adds family, severity, dimension_D and its stratum. Columns of quality that signals has too must agree
    to 1e-12 and are taken once.
    """
    bad = {(r["side"], r["problem"]): r["keys"] for r in key_problems(signals, quality, key).where("keys > 0").collect()}
    if bad:
        raise ValueError(f"keys do not match one to one: {bad}")
    fam, sev = family()
    extra = [c for c in quality.columns if c not in signals.columns]
    joined = signals.join(quality.select(*key, *extra), key).join(F.broadcast(dimensions), "dataset_id", "left")
    return joined.withColumn("shift_family", fam).withColumn("severity", sev).withColumn("dimension_stratum", stratum("dimension_D"))


def regression_metrics(predictions: DataFrame, by: list[str], observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """n, mae, rmse, median_ae, r2 of each group; r2 is 0 where the observed values do not vary."""
    e = F.col(observed) - F.col(predicted)
    g = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(F.abs(e), 0.5).alias("median_ae"), F.avg(e * e).alias("__mse"), F.var_pop(observed).alias("__var")
    )
    return g.withColumn("r2", F.when(F.col("__var") <= 1e-12, 0.0).otherwise(1 - F.col("__mse") / F.nullif("__var", F.lit(0.0)))).drop("__mse", "__var")


def paired_deltas(predictions: DataFrame, unit: str, pairs: Sequence[tuple[str, str]], block: str = "feature_block") -> DataFrame:
    """unit, the mean absolute error of each block, and delta_ab = mae_a - mae_b for the pairs."""
    names = sorted({x for p in pairs for x in p})
    e = F.abs(F.col("observed") - F.col("predicted"))
    wide = predictions.groupBy(unit).agg(*[F.avg(F.when(F.col(block) == n, e)).alias(f"mae_{n}") for n in names])
    return wide.select("*", *[(F.col(f"mae_{a}") - F.col(f"mae_{b}")).alias(f"delta_{a[1:]}{b[1:]}") for a, b in pairs])


def paired_bootstrap(deltas: DataFrame, value: str, unit: str, repetitions: int = REPETITIONS, seed: int = SEED) -> DataFrame:
    """n, mean, lo, hi: mean of the deltas and the 2.5 and 97.5 percentiles over resampled units.

    Units are few (data sets or families). Each repetition draws as many units as there are, with
    replacement, by hashed numbers: repetitions x units rows, spread over tasks.
    """
    w = Window.orderBy(unit)
    units = deltas.select(F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("place"))
    n = units.count()
    each = deltas.sparkSession.range(repetitions).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    each = each.withColumn("place", (draw(seed, "boot", F.concat_ws("-", "rep", "slot")) % n).cast("int"))
    means = each.join(F.broadcast(units), "place").groupBy("rep").agg(F.avg("v").alias("m"))
    return means.agg(F.avg("m").alias("boot_mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi")).withColumn("n", F.lit(n))


#: The thresholds of the eight rules.
LEAST_R04, LEAST_R34, DATASET_WINS, FAMILY_WINS = 0.05, 0.02, 7, 4


def verdict(mae: dict[str, float], datasets_04: Sequence[float], families_04: Sequence[float], families_34: Sequence[float], lo_04: float = float("-inf"), lo_34: float = float("-inf")) -> dict:
    """Eight rules on the errors of blocks P0, P3 and P4 and on the paired deltas, and their outcome.

    All rules: SURVIVES_STRONGLY. P4 better than both others on the whole, but not all rules: BORDERLINE.
    """

    def gain(a: str) -> float:
        return (mae[a] - mae["P4"]) / mae[a] if mae[a] > 0 else 0.0

    def wins(deltas: Sequence[float]) -> int:
        return sum(d > 0 for d in deltas)

    better = {a: mae["P4"] < mae[a] for a in ("P0", "P3")}
    rules = {
        "beats_P0": better["P0"],
        "clearly_beats_P0": gain("P0") >= LEAST_R04 or lo_04 > 0,
        "beats_P3": better["P3"],
        "clearly_beats_P3": gain("P3") >= LEAST_R34 or lo_34 > 0,
        "median_dataset": float(np.median(datasets_04)) > 0,
        "dataset_wins": wins(datasets_04) >= DATASET_WINS,
        "family_wins_P0": wins(families_04) >= FAMILY_WINS,
        "family_wins_P3": wins(families_34) >= FAMILY_WINS,
    }
    outcome = "FAILS_PRIMARY_FALSIFICATION"
    if all(better.values()):
        outcome = "SURVIVES_STRONGLY" if all(rules.values()) else "BORDERLINE"
    return {"verdict": outcome, "rules": rules, "R04": gain("P0"), "R34": gain("P3"), "severe_family_failure": wins(families_04) < FAMILY_WINS}


def missing_and_extra(rows: DataFrame, universe: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key, problem: keys of the universe without a row, rows outside it, and keys with several rows."""
    missing = universe.join(rows.select(*key), key, "left_anti").select(*key, F.lit("missing").alias("problem"))
    extra = rows.join(universe, key, "left_anti").select(*key, F.lit("extra").alias("problem"))
    twice = rows.groupBy(*key).count().where("count > 1").select(*key, F.lit("repeated").alias("problem"))
    return missing.unionByName(extra).unionByName(twice)


def out_of_bounds(rows: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """column, n_bad: values beyond their bounds, null or not finite; one aggregation."""
    parts = []
    for c, (lo, hi) in bounds.items():
        bad = F.col(c).isNull() | F.isnan(c)
        bad = bad | (F.col(c) < lo) if lo is not None else bad
        bad = bad | (F.col(c) > hi) if hi is not None else bad
        parts.append(F.struct(F.lit(c).alias("column"), F.sum(bad.cast("long")).alias("n_bad")))
    return rows.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def not_constant(rows: DataFrame, by: list[str], column: str, tolerance: float = 0.0) -> DataFrame:
    """Groups in which a column that should have one value has several."""
    return rows.groupBy(*by).agg((F.max(column) - F.min(column)).alias("spread")).where(F.col("spread") > tolerance)


def value_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, min, median, mean, p95, max of each column, over values that are present."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.min(c).cast("double").alias("min"), F.avg(c).alias("mean"), F.max(c).cast("double").alias("max")) for c in columns]
    rest = rows.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    q = quantiles(rows, columns, [0.5, 0.95]).select("column", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))
    return rest.join(F.broadcast(q), "column", "left").select("column", "n", "min", "median", "mean", "p95", "max")


def root_mean(rows: DataFrame, x: str) -> float:
    s = summed(rows, lambda a: np.array([(a**2).sum(), a.size]), x)
    return float(np.sqrt(s[0] / s[1]))
