"""Queries of the evaluation: strict join, checks, grouped regression, metrics, bootstrap, verdict.

Their signal and quality tables are aggregates of the events table, keyed like scenarios.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sql_draw
from ..operators import evaluation as ev
from ..operators import nested, signals
from .data_queries import NUDGE, rounded
from .registry import query

#: Event types as conditions.
CONDITIONS = {"click": "clean", "view": "location_mild", "purchase": "location_severe", "error": "scale_mild", "signup": "scale_severe"}
FEATURES = ["D_X", "D_U_C", "D_V"]
_KEY = "'d' || lpad((user_id % 12)::VARCHAR, 2, '0') AS dataset_id, (user_id // 12 % 5)::INTEGER AS outer_fold, coalesce(map_extract_value(MAP {m}, event_type), 'other') AS condition, 'fcm' AS method, (event_id % 5)::INTEGER AS seed".replace("{m}", "{" + ", ".join(f"'{k}': '{v}'" for k, v in CONDITIONS.items()) + "}")
TABLES = f"""sig AS (SELECT {_KEY}, avg(value) AS "D_X", coalesce(stddev_pop(value), 0) AS "D_U_C", max(value) - min(value) AS "D_V", count(*) AS n FROM events GROUP BY ALL),
qua AS (SELECT {_KEY}, avg(value * (event_id % 7)) / 60 AS delta_ari FROM events GROUP BY ALL),
dims AS (SELECT DISTINCT 'd' || lpad((user_id % 12)::VARCHAR, 2, '0') AS dataset_id, (user_id % 12 * 12)::INTEGER AS "dimension_D" FROM events),
j AS (SELECT dataset_id, outer_fold, condition, method, seed, "D_X", "D_U_C", "D_V", n, delta_ari, "dimension_D",
      CASE WHEN condition = 'clean' THEN 'clean' ELSE regexp_replace(condition, '_(mild|severe)$', '') END AS shift_family,
      CASE WHEN condition = 'clean' THEN 'none' ELSE regexp_extract(condition, '_(mild|severe)$', 1) END AS severity,
      CASE WHEN "dimension_D" <= 20 THEN 'low_D' WHEN "dimension_D" <= 100 THEN 'mid_D' ELSE 'high_D' END AS dimension_stratum
      FROM sig JOIN qua USING (dataset_id, outer_fold, condition, method, seed) JOIN dims USING (dataset_id))"""


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    names = F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv])
    return e.select(
        F.concat(F.lit("d"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0")).alias("dataset_id"),
        (F.floor(F.col("user_id") / 12) % 5).cast("int").alias("outer_fold"),
        F.coalesce(F.element_at(names, F.col("event_type")), F.lit("other")).alias("condition"),
        F.lit("fcm").alias("method"),
        (F.col("event_id") % 5).cast("int").alias("seed"),
        "value",
        "event_id",
        "user_id",
    )


def signal_table(spark: SparkSession, sf: str) -> DataFrame:
    g = _keyed(spark, sf).groupBy(*ev.KEY)
    return g.agg(F.avg("value").alias("D_X"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("D_U_C"), (F.max("value") - F.min("value")).alias("D_V"), F.count(F.lit(1)).alias("n"))


def quality_table(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(spark, sf).groupBy(*ev.KEY).agg((F.avg(F.col("value") * (F.col("event_id") % 7)) / 60).alias("delta_ari"))


def dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """A data set's dimension (12 data sets)."""
    return _keyed(spark, sf).select("dataset_id", (F.col("user_id") % 12 * 12).cast("int").alias("dimension_D")).distinct()


def joined_table(spark: SparkSession, sf: str) -> DataFrame:
    return ev.strict_join(signal_table(spark, sf), quality_table(spark, sf), dimensions(spark, sf))


@query(
    "signal_quality_join",
    f"""WITH {TABLES} SELECT dataset_id, outer_fold, condition, method, seed, round("D_X" + {NUDGE}, 6) AS "D_X", round("D_U_C" + {NUDGE}, 6) AS "D_U_C", round("D_V" + {NUDGE}, 6) AS "D_V", n, round(delta_ari + {NUDGE}, 6) AS delta_ari, "dimension_D", shift_family, severity, dimension_stratum FROM j""",
)
def signal_quality_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joined_table(spark, sf), nudge=NUDGE)


_UNIVERSE = "uni AS (SELECT d.dataset_id, f::INTEGER AS outer_fold, c.condition, 'fcm' AS method, s::INTEGER AS seed FROM (SELECT DISTINCT dataset_id FROM sig) d, range(6) r(f), (SELECT DISTINCT condition FROM sig) c, range(4) q(s))"


@query(
    "key_universe_check",
    f"""WITH {TABLES}, {_UNIVERSE} SELECT dataset_id, outer_fold, condition, method, seed, 'missing' AS problem FROM uni ANTI JOIN sig USING (dataset_id, outer_fold, condition, method, seed)
UNION ALL SELECT dataset_id, outer_fold, condition, method, seed, 'extra' FROM sig ANTI JOIN uni USING (dataset_id, outer_fold, condition, method, seed)""",
)
def key_universe_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rows against a universe with one fold too many and one seed too few."""
    rows = signal_table(spark, sf)
    names = rows.select("dataset_id").distinct().withColumn("condition", F.explode(F.array(*[F.lit(c) for c in CONDITIONS.values()])))
    grid = names.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("method", F.lit("fcm"))
    return ev.missing_and_extra(rows, grid.select(*ev.KEY))


@query("key_match_check", f"WITH {TABLES}, h AS (SELECT * FROM qua WHERE seed <> 4) SELECT * FROM (VALUES ('signals', 'repeated', 0::BIGINT), ('signals', 'unmatched', (SELECT count(*) FROM sig WHERE seed = 4)), ('quality', 'repeated', 0), ('quality', 'unmatched', 0)) t(side, problem, keys)")
def key_match_check(spark: SparkSession, sf: str) -> DataFrame:
    """Key problems when the quality of one seed is missing (the fault is the check's feature)."""
    return ev.key_problems(signal_table(spark, sf), quality_table(spark, sf).where("seed != 4"))


@query("signal_bounds_check", f"""WITH {TABLES} SELECT 'D_X' AS "column", count(*) FILTER ("D_X" < 0 OR "D_X" > 12) AS n_bad FROM sig UNION ALL SELECT 'D_U_C', count(*) FILTER ("D_U_C" < 0) FROM sig UNION ALL SELECT 'D_V', count(*) FILTER ("D_V" < 0 OR "D_V" > 30) FROM sig""")
def signal_bounds_check(spark: SparkSession, sf: str) -> DataFrame:
    return ev.out_of_bounds(signal_table(spark, sf), {"D_X": (0.0, 12.0), "D_U_C": (0.0, None), "D_V": (0.0, 30.0)})


@query("dx_constancy", f"""WITH {TABLES} SELECT dataset_id, outer_fold, condition, round(max("D_X") - min("D_X"), 6) AS spread FROM sig GROUP BY ALL HAVING max("D_X") - min("D_X") > 1.0""")
def dx_constancy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.not_constant(signal_table(spark, sf), ["dataset_id", "outer_fold", "condition"], "D_X", 1.0))


_SUMMARY = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(\"{c}\") AS n, round(min(\"{c}\"), 6) AS min, round(median(\"{c}\"), 6) AS median, round(avg(\"{c}\"), 6) AS mean, round(quantile_cont(\"{c}\", 0.95), 6) AS p95, round(max(\"{c}\"), 6) AS max FROM sig" for c in FEATURES)


@query("signal_summary", f"WITH {TABLES} {_SUMMARY}")
def signal_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.value_summary(signal_table(spark, sf), FEATURES))


#: A fixed linear prediction for each block, so that metrics can be checked without a fit.
_RULES = {"P0": {"D_X": 0.05}, "P3": {"D_X": 0.04, "D_V": 0.001}, "P4": {"D_X": 0.045, "D_U_C": 0.002}}
_PRED = "pred AS (" + " UNION ALL ".join(f"SELECT j.*, '{b}' AS feature_block, delta_ari AS observed, " + " + ".join(f'{w} * "{c}"' for c, w in r.items()) + " AS predicted FROM j WHERE condition <> 'clean'" for b, r in _RULES.items()) + ")"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the primary rows (not clean) under each block's fixed rule."""
    j = joined_table(spark, sf).where("condition != 'clean'")
    blocks = F.array(*[F.struct(F.lit(b).alias("feature_block"), sum((F.col(c) * w for c, w in r.items()), F.lit(0.0)).alias("predicted")) for b, r in _RULES.items()])
    return j.withColumn("observed", F.col("delta_ari")).withColumn("b", F.explode(blocks)).select("*", "b.*").drop("b")


_METRICS = "count(*) AS n, round(avg(abs(observed - predicted)), 6) AS mae, round(sqrt(avg(pow(observed - predicted, 2))), 6) AS rmse, round(median(abs(observed - predicted)), 6) AS median_ae, round(1 - avg(pow(observed - predicted, 2)) / var_pop(observed), 6) AS r2"


@query("regression_metrics", f"WITH {TABLES}, {_PRED} SELECT feature_block, dataset_id, {_METRICS} FROM pred GROUP BY ALL")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.regression_metrics(predictions(spark, sf), ["feature_block", "dataset_id"]))


@query("strata_audit", f"WITH {TABLES}, {_PRED} SELECT feature_block, dimension_stratum, {_METRICS} FROM pred GROUP BY ALL")
def strata_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.regression_metrics(predictions(spark, sf), ["feature_block", "dimension_stratum"]))


@query("ablation", f"WITH {TABLES}, {_PRED}, m AS (SELECT feature_block, avg(abs(observed - predicted)) AS mae FROM pred GROUP BY 1) SELECT feature_block, round(mae, 6) AS mae, round(mae - (SELECT mae FROM m WHERE feature_block = 'P0'), 6) + 0.0 AS change FROM m")
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    m = ev.regression_metrics(predictions(spark, sf), ["feature_block"]).select("feature_block", "mae")
    base = m.where("feature_block = 'P0'").first()["mae"]
    return rounded(m.withColumn("change", F.col("mae") - base))


_MAES = "avg(abs(observed - predicted)) FILTER (feature_block = 'P0') AS p0, avg(abs(observed - predicted)) FILTER (feature_block = 'P3') AS p3, avg(abs(observed - predicted)) FILTER (feature_block = 'P4') AS p4"
PAIRS = [("P0", "P4"), ("P3", "P4")]


@query(
    "paired_deltas",
    f'WITH {TABLES}, {_PRED}, d AS (SELECT dataset_id, {_MAES} FROM pred GROUP BY 1) SELECT dataset_id, round(p0, 6) AS "mae_P0", round(p3, 6) AS "mae_P3", round(p4, 6) AS "mae_P4", round(p0 - p4, 6) + 0.0 AS delta_04, round(p3 - p4, 6) + 0.0 AS delta_34 FROM d',
)
def paired_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.paired_deltas(predictions(spark, sf), "dataset_id", PAIRS))


_SLOT = "concat_ws('-', rep, slot)"
_BOOT = f"""u AS (SELECT v, row_number() OVER (ORDER BY dataset_id) - 1 AS place FROM (SELECT dataset_id, p0 - p4 AS v FROM d)),
r AS (SELECT rep, {sql_draw(ev.SEED, 'boot', _SLOT)} % 12 AS place FROM range({ev.REPETITIONS}) a(rep), range(12) b(slot)),
m AS (SELECT rep, avg(v) AS m FROM r JOIN u USING (place) GROUP BY 1)"""


@query("paired_bootstrap", f"WITH {TABLES}, {_PRED}, d AS (SELECT dataset_id, {_MAES} FROM pred GROUP BY 1), {_BOOT} SELECT round(avg(m), 6) AS boot_mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, 12 AS n FROM m")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.paired_bootstrap(ev.paired_deltas(predictions(spark, sf), "dataset_id", PAIRS), "delta_04", "dataset_id"))


@query("falsification_verdict")
def falsification_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on the fixed rules' predictions (tests check the rules)."""
    p = predictions(spark, sf)
    mae = {r["feature_block"]: r["mae"] for r in ev.regression_metrics(p, ["feature_block"]).collect()}
    deltas = ev.paired_deltas(p, "dataset_id", PAIRS)
    units = deltas.collect()
    families = ev.paired_deltas(p, "shift_family", PAIRS).collect()
    lo = [ev.paired_bootstrap(deltas, c, "dataset_id").first()["lo"] for c in ("delta_04", "delta_34")]
    v = ev.verdict(mae, [r["delta_04"] for r in units], [r["delta_04"] for r in families], [r["delta_34"] for r in families], *lo)
    return spark.createDataFrame([(v["verdict"], float(round(v["R04"], 6)), float(round(v["R34"], 6)), sum(v["rules"].values()))], "verdict string, R04 double, R34 double, rules_held int")


_LODO = """g AS (SELECT dataset_id, count(*) AS n, sum("D_X") AS x, sum(delta_ari) AS y, sum("D_X" * "D_X") AS xx, sum("D_X" * delta_ari) AS xy FROM j WHERE condition <> 'clean' GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM g),
o AS (SELECT dataset_id, t.n - g.n AS n, t.x - g.x AS x, t.y - g.y AS y, t.xx - g.xx AS xx, t.xy - g.xy AS xy FROM g, t),
w AS (SELECT dataset_id, (xy / n - x * y / n / n) * n / (xx / n - x * x / n / n) / (n + 10.0) AS w, x / n AS mx, y / n AS my FROM o)"""


@query(
    "lodo_ridge_one_feature",
    f"""WITH {TABLES}, {_LODO} SELECT dataset_id, outer_fold, condition, seed, round(delta_ari + {NUDGE}, 6) AS observed, round(my + w * ("D_X" - mx), 5) + 0.0 AS predicted FROM j JOIN w USING (dataset_id) WHERE condition <> 'clean'""",
)
def lodo_ridge_one_feature(spark: SparkSession, sf: str) -> DataFrame:
    """Leave one data set out with one feature and one penalty, which has a closed form in SQL."""
    rows = joined_table(spark, sf).where("condition != 'clean'")
    out, _ = nested.nested_ridge(rows, {"P0": ["D_X"]}, "delta_ari", "dataset_id", alphas=[10.0], keep=["dataset_id", "outer_fold", "condition", "seed"])
    return out.select("dataset_id", "outer_fold", "condition", "seed", F.round(F.col("observed") + NUDGE, 6).alias("observed"), (F.round("predicted", 5) + F.lit(0.0)).alias("predicted"))


def _one_block(spark: SparkSession, sf: str, kind: str, regressor: str, setting: str) -> DataFrame:
    records, _ = nested.evaluate(joined_table(spark, sf), "primary", kind, regressor=regressor, blocks={"all": FEATURES})
    return rounded(ev.regression_metrics(records, ["outer_test_group", setting]))


@query("lodo_ridge")
def lodo_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """All features and penalties, tuned inside each outer split; errors by data set."""
    return _one_block(spark, sf, "LODO", nested.RIDGE, "alpha")


@query("losfo_ridge")
def losfo_ridge(spark: SparkSession, sf: str) -> DataFrame:
    return _one_block(spark, sf, "LOSFO", nested.RIDGE, "alpha")


@query("losfo_gbt")
def losfo_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram boosting over all sixteen settings, a family left out at a time."""
    return _one_block(spark, sf, "LOSFO", nested.BOOSTED, "params")


@query("lodo_gbt")
def lodo_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram boosting over all sixteen settings, a data set left out at a time."""
    return _one_block(spark, sf, "LODO", nested.BOOSTED, "params")


def wide_table(spark: SparkSession, sf: str) -> DataFrame:
    """The joined table with all ten signals; the control `silhouette` is missing on some rows."""
    j = joined_table(spark, sf)
    return j.select(
        "*",
        (F.col("D_U_C") * 0.8 + F.col("n") % 7 / 10).alias("D_U_R"),
        (F.col("D_V") / (F.col("D_X") + 1)).alias("D_H"),
        (F.col("D_U_C") / (F.col("D_V") + 1)).alias("D_M"),
        (1 / (F.col("D_U_C") + 1)).alias("fpc"),
        F.log1p("D_V").alias("pe"),
        (F.col("D_X") * F.col("D_U_C") / 10).alias("xb"),
        F.when(F.col("n") % 5 > 0, F.col("D_X") / 20).alias("silhouette"),
    )


def _by_block(spark: SparkSession, sf: str, scope: str, kind: str) -> DataFrame:
    records, _ = nested.evaluate(wide_table(spark, sf), scope, kind)
    return rounded(ev.regression_metrics(records, ["outer_test_group", "feature_block", "alpha"]))


@query("evaluation_lodo")
def evaluation_lodo(spark: SparkSession, sf: str) -> DataFrame:
    """All blocks, ablations and increments, each data set left out; errors of each."""
    return _by_block(spark, sf, "primary", "LODO")


@query("evaluation_losfo")
def evaluation_losfo(spark: SparkSession, sf: str) -> DataFrame:
    return _by_block(spark, sf, "primary", "LOSFO")


@query("evaluation_secondary_lodo")
def evaluation_secondary_lodo(spark: SparkSession, sf: str) -> DataFrame:
    return _by_block(spark, sf, "secondary", "LODO")


@query("evaluation_secondary_losfo")
def evaluation_secondary_losfo(spark: SparkSession, sf: str) -> DataFrame:
    return _by_block(spark, sf, "secondary", "LOSFO")


@query("evaluation_inner_folds")
def evaluation_inner_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate penalty of every block with its inner errors, and which one was taken."""
    return rounded(nested.evaluate(wide_table(spark, sf), "primary", "LODO")[1])


@query("boosted_losfo")
def boosted_losfo(spark: SparkSession, sf: str) -> DataFrame:
    """The primary regressor on the six blocks, a family left out at a time: errors and the setting taken."""
    records, _ = nested.evaluate(wide_table(spark, sf), "primary", "LOSFO", regressor=nested.BOOSTED)
    return rounded(ev.regression_metrics(records, ["outer_test_group", "feature_block", "params"]))


@query("boosted_candidates")
def boosted_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting of the grid with its inner errors and the hashes of its inner groups, for two blocks."""
    blocks = {b: signals.BLOCKS[b] for b in ("P0", "P4")}
    return rounded(nested.evaluate(wide_table(spark, sf), "secondary", "LOSFO", regressor=nested.BOOSTED, blocks=blocks)[1])


@query("evaluation_verdict")
def evaluation_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """From the joined table to the verdict on the primary regressor: both primary evaluations of the blocks that the eight rules read, and the linear control."""
    blocks = {b: signals.BLOCKS[b] for b in ("P0", "P3", "P4")}
    report, _ = nested.run_evaluation(wide_table(spark, sf), scopes=[("primary", "LODO"), ("primary", "LOSFO")], blocks=blocks)
    rows = [(name, block, round(v, 6), report["verdict"], sum(report["rules"].values())) for name, m in report["mae"].items() for block, v in m.items()]
    return spark.createDataFrame(rows, "evaluation string, feature_block string, mae double, verdict string, rules_held int")


@query("training_medians", f"""WITH {TABLES}, w AS (SELECT *, CASE WHEN n % 5 > 0 THEN "D_X" / 20 END AS silhouette FROM j WHERE condition <> 'clean'), t AS (SELECT DISTINCT dataset_id AS test FROM w)
SELECT test, round(median(silhouette), 6) AS silhouette, round(median("D_V"), 6) AS "D_V" FROM t JOIN w ON dataset_id <> test GROUP BY 1""")
def training_medians(spark: SparkSession, sf: str) -> DataFrame:
    """What missing signals are filled with when a data set is left out: medians of the training rows alone."""
    rows = nested.scoped(wide_table(spark, sf), "primary")
    plan = nested.planned(rows, "dataset_id")
    found = nested.medians_of(plan.marked(rows, "dataset_id", "dataset_id"), ["silhouette", "D_V"], plan.train)
    table = [(t, *(float(v) for v in found[plan.fit(t, plan.folds)])) for t in plan.tests]
    return rounded(spark.createDataFrame(table, "test string, silhouette double, D_V double"))
