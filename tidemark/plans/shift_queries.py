"""Queries of the seven shift families, their replay and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sql_draw, sql_normal, sql_student3, sql_uniform, uniform
from ..operators import shifts, statistics
from ..sources.ingest import LINE_FEATURES, LINE_SQL, embedding_points, line_rows
from ..sources.shared import stored
from .data_queries import POINTS, SEED, SOURCE, STATS, rounded, side, sql_side
from .registry import query

_TARGET = f"tgt AS (SELECT * FROM ({LINE_SQL}) WHERE {sql_side('target')})"
_WIDE = "w AS (SELECT " + ", ".join(f"max(mean) FILTER (\"column\" = '{c}') AS {c}_m, max(sd) FILTER (\"column\" = '{c}') AS {c}_s" for c in LINE_FEATURES) + " FROM stats)"


def _sql(family: str, cell) -> str:
    parts = [f"SELECT row_id, '{s}' AS severity, " + ", ".join(f"round({cell(c, k)}, 5) + 0.0 AS {c}" for c in LINE_FEATURES) + " FROM tgt, w" for s, k in zip(shifts.SEVERITIES, shifts.STRENGTH[family], strict=True)]
    return f"WITH {STATS}, {_TARGET}, {_WIDE} " + " UNION ALL ".join(parts)


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, shifts.Stats]:
    """row_id and features of the target rows, and the source's statistics. The rows are written once: their ids and side are
    hashed once, whatever passes over them."""
    lines = line_rows(spark, sf).select("row_id", *LINE_FEATURES, (uniform(SEED, "split", "row_id") < SOURCE).alias("in_source"))
    lines = stored(lines, "lines")
    stats = shifts.collected(statistics.source_statistics(lines.where("in_source"), LINE_FEATURES, medians=False))
    return lines.where("not in_source").drop("in_source"), stats


def _shifted(spark: SparkSession, sf: str, family: str) -> DataFrame:
    rows, stats = _sides(spark, sf)
    return rounded(shifts.both_severities(family, rows, stats, LINE_FEATURES, SEED), 5)


_MOVED = shifts.moved_features(dict.fromkeys(LINE_FEATURES, (0.0, 1.0, 0.0)), SEED)


@query("shift_location", _sql("location", lambda c, k: f"{c} + {k} * {c}_s" if c in _MOVED else c))
def shift_location(spark: SparkSession, sf: str) -> DataFrame:
    return _shifted(spark, sf, "location")


@query("shift_scale", _sql("scale", lambda c, k: f"{c} * {k} + (1 - {k}) * {c}_m"))
def shift_scale(spark: SparkSession, sf: str) -> DataFrame:
    return _shifted(spark, sf, "scale")


@query("shift_noise", _sql("noise", lambda c, k: f"{c} + {sql_normal(SEED, f'noise-{c}', 'row_id')} * {k} * {c}_s"))
def shift_noise(spark: SparkSession, sf: str) -> DataFrame:
    return _shifted(spark, sf, "noise")


_HIT = f"row_number() OVER (ORDER BY {sql_draw(SEED, 'outlier-rows', 'row_id')}, row_id) <= round_even(count(*) OVER () * {{k}}, 0)"
_OUTLIERS = _sql("outliers", lambda c, k: f"CASE WHEN {_HIT.format(k=k)} THEN {c} + {sql_student3(SEED, f'outlier-{c}', 'row_id')} * 3.0 * {c}_s ELSE {c} END")


@query("shift_outliers", _OUTLIERS)
def shift_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return _shifted(spark, sf, "outliers")


_GONE = "{c} IS NOT NULL AND row_number() OVER (PARTITION BY {c} IS NULL ORDER BY {d}, row_id) <= round_even(count({c}) OVER () * {k}, 0)"


@query("shift_mcar", _sql("mcar", lambda c, k: f"CASE WHEN NOT ({_GONE.format(c=c, k=k, d=sql_draw(SEED, f'mcar-{c}', 'row_id'))}) THEN {c} END"))
def shift_mcar(spark: SparkSession, sf: str) -> DataFrame:
    return _shifted(spark, sf, "mcar")


_PREVALENCE = f"""WITH pts AS ({POINTS}), src AS (SELECT * FROM pts WHERE {sql_side('source')}), tgt AS (SELECT * FROM pts WHERE {sql_side('target')}),
a AS (SELECT label FROM src WHERE label IN (SELECT label FROM tgt) GROUP BY label ORDER BY count(*), label::VARCHAR LIMIT 1),
w AS (SELECT label, count(*) AS n, count(*) * CASE WHEN label = (SELECT label FROM a) THEN 4.0 ELSE 1.0 END AS w FROM tgt GROUP BY label),
e AS (SELECT label, n, sum(w) OVER (ORDER BY label::VARCHAR) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY label::VARCHAR) - w) / sum(w) OVER () AS lo,
      row_number() OVER (ORDER BY label::VARCHAR DESC) = 1 AS last FROM w),
p AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS place FROM tgt),
d AS (SELECT t.row_id AS new_id, e.label, {sql_draw(SEED, 'place', 't.row_id')} % e.n AS place FROM tgt t JOIN e ON {sql_uniform(SEED, 'class', 't.row_id')} >= lo AND ({sql_uniform(SEED, 'class', 't.row_id')} < hi OR last))
SELECT d.new_id, p.row_id, d.label FROM d JOIN p USING (label, place)"""


@query("shift_class_prevalence", _PREVALENCE)
def shift_class_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    p = embedding_points(spark, sf)
    return shifts.class_prevalence_shift(side(p, "target"), side(p, "source"), "severe", SEED)


_OVERLAP = f"""WITH pts AS ({POINTS}), src AS (SELECT row_id, label, i, x[i] AS v FROM pts, range(1, 65) r(i) WHERE {sql_side('source')}),
tgt AS (SELECT row_id, label, i, x[i] AS v FROM pts, range(1, 65) r(i) WHERE {sql_side('target')}),
sd AS (SELECT i, stddev_samp(v) AS s FROM src GROUP BY i), c AS (SELECT label AS c, i, avg(v) AS m FROM src GROUP BY label, i),
d AS (SELECT row_id, label, c, sqrt(sum(pow(v / s - m / s, 2))) AS d FROM tgt JOIN sd USING (i) JOIN c USING (i) WHERE label <> c GROUP BY ALL),
n AS (SELECT row_id, label, arg_min(c, d) AS c, min(d) AS d FROM d GROUP BY ALL),
m AS (SELECT row_id, label, c, row_number() OVER (PARTITION BY label ORDER BY d, row_id) <= round_even(count(*) OVER (PARTITION BY label) * 0.3, 0) AS moved FROM n)
SELECT row_id, label, moved, round(sum(CASE WHEN moved THEN v * 0.5 + m.m * 0.5 ELSE v END * i), 5) AS checksum
FROM tgt JOIN (SELECT m.*, c.i, c.m FROM m JOIN c USING (c)) m USING (row_id, label, i) GROUP BY ALL"""


@query("shift_local_overlap", _OVERLAP)
def shift_local_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Each target row with a checksum of its shifted vector (entries weighted by position)."""
    p = embedding_points(spark, sf)
    out = shifts.local_overlap_shift(side(p, "target"), side(p, "source"), "severe")
    sum_ = F.aggregate(F.zip_with("x", F.sequence(F.lit(1), F.size("x")), lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)
    return rounded(out.select("row_id", "label", "moved", sum_.alias("checksum")), 5)


@query("shift_replay_overlay", _OUTLIERS)
def shift_replay_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """The outlier shift stored as differing cells and replayed onto the target rows."""
    rows, stats = _sides(spark, sf)
    drawn, new = shifts.severities("outliers", rows, stats, LINE_FEATURES, SEED)
    out = []
    for s in shifts.SEVERITIES:
        cells = stored(shifts.changed_cells(drawn, new[s]), "cells")
        out.append(shifts.overlay(rows, cells, LINE_FEATURES).withColumn("severity", F.lit(s)))
    return rounded(out[0].unionByName(out[1]), 5)


@query("severity_monotonicity")
def severity_monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(shifts.monotonicities(*_sides(spark, sf), LINE_FEATURES, SEED))
