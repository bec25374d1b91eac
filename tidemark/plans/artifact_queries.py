"""Queries of stored artifacts: written to the shared folder, read back, verified, and found out when altered."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, shifts, signals, statistics
from ..sources import descriptors as d
from ..sources.ingest import LINE_FEATURES, LINE_SQL, line_rows
from ..sources.shared import shared_dir, stored
from .registry import query

HASHES = {"bundle_sha256": "b" * 64, "split_sha256": "5" * 64, "protocol_sha256": "9" * 64}
WHERE = {"dataset_id": "lineitem", "outer_fold": 0, "seed": 7}


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


@query("split_artifact", f"WITH l AS ({LINE_SQL}), n AS (SELECT count(*) AS n FROM l), f AS (SELECT unnest(range(5))::INTEGER AS fold) SELECT fold, 'target' AS side, (n + 4 - fold) // 5 AS rows, 0::INTEGER AS problems FROM n, f UNION ALL SELECT fold, 'source', n - (n + 4 - fold) // 5, 0 FROM n, f")
def split_artifact(spark: SparkSession, sf: str) -> DataFrame:
    """A five-fold split of the line items, stored, verified and read back."""
    # ids of lines repeat: the split is of their numbers, which the written table binds to them
    lines = stored(line_rows(spark, sf).select("row_id", F.monotonically_increasing_id().alias("number")), "ids")
    rows = lines.select(F.col("number").alias("row_id"))
    what = {"dataset_id": "lineitem", "strategy": "kfold", "seed": folds.SEED, "bundle_sha256": HASHES["bundle_sha256"], "protocol_sha256": HASHES["protocol_sha256"]}
    path = _place(spark, "split")
    d.save_split(folds.kfold(rows), path, **what)
    bad = d.problems(spark, path, d.split_descriptor(**what))
    table, _ = d.load(spark, path)
    return table.groupBy("fold", "side").agg(F.count(F.lit(1)).alias("rows")).withColumn("problems", F.lit(len(bad)))


_MCAR = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round_even(count({c}) * 0.1, 0)::BIGINT AS cells FROM l" for c in LINE_FEATURES)


@query("shift_artifact", f"WITH l AS (SELECT DISTINCT ON (row_id) * FROM ({LINE_SQL})) SELECT *, 0::INTEGER AS problems FROM ({_MCAR})")
def shift_artifact(spark: SparkSession, sf: str) -> DataFrame:
    """The cells that a mild loss of values takes, stored with what they were made from, verified, and replayed."""
    rows = stored(line_rows(spark, sf).dropDuplicates(["row_id"]).select("row_id", *LINE_FEATURES), "lines")
    drawn, new = shifts.severities("mcar", rows, {}, LINE_FEATURES, 7)
    root, what = _place(spark, "shift"), WHERE | HASHES | {"condition": "mcar_mild"}
    made = d.save_shift(shifts.changed_cells(drawn, new["mild"]), root, **what)
    bad = d.shift_problems(spark, root, **what)
    path = _place(spark, "replay")
    d.save_replay(drawn, new["mild"], LINE_FEATURES, path, made)
    cells, _ = d.load(spark, path, {"shift_spec_sha256": made["descriptor_sha256"]})
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("cells")).withColumn("problems", F.lit(len(bad)))


@query("bank_artifact", f"WITH l AS (SELECT DISTINCT row_id FROM ({LINE_SQL})), s AS (SELECT least(count(*), {signals.BANK}) AS n FROM l) SELECT * FROM (SELECT 'reference' AS kind, n, true AS distinct_ids, 0::INTEGER AS problems FROM s UNION ALL SELECT 'current', n, true, 0 FROM s)")
def bank_artifact(spark: SparkSession, sf: str) -> DataFrame:
    """Reference and current banks of the line items, stored, verified, and joined back to their features."""
    rows = stored(line_rows(spark, sf).dropDuplicates(["row_id"]).select("row_id", *LINE_FEATURES), "lines")
    out = []
    for kind in ("reference", "current"):
        more = {"condition": "mcar_mild", "shift_sha256": "a" * 64} if kind == "current" else {}
        what, path = WHERE | HASHES | more | {"kind": kind}, _place(spark, f"{kind}-bank")
        d.save_bank(signals.bank(rows, 7, f"{kind}-bank").select("row_id"), path, signals.BANK, **what)
        found = d.bank_rows(rows, spark, path, d.bank_descriptor(**what))
        n, different = found.agg(F.count(F.lit(1)), F.count_distinct("row_id")).first()
        out.append((kind, n, n == different, len(d.problems(spark, path, d.bank_descriptor(**what)))))
    return spark.createDataFrame(out, "kind string, n long, distinct_ids boolean, problems int")


_CASES = [
    ("sound", ""),
    ("other split", "split_sha256 is not the expected one"),
    ("rows lost", "rows were lost or added; the table was altered"),
    ("value changed", "the table was altered"),
    ("descriptor changed", "the descriptor was altered"),
    ("no descriptor", "cannot be read: AnalysisException"),
]


@query("artifact_faults", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _CASES) + ") t(fault, problems)")
def artifact_faults(spark: SparkSession, sf: str) -> DataFrame:
    """What verification says of a sound artifact and of five broken ones."""
    nation = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name")
    broken = {
        "sound": nation,
        "other split": nation,
        "rows lost": nation.where("n_nationkey > 0"),
        "value changed": nation.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "X").otherwise(F.col("n_name"))),
    }
    out = []
    for case, _ in _CASES:
        path = _place(spark, "fault")
        made = d.save(nation, path, {"kind": "fault", "split_sha256": "5" * 64})
        if case in broken:
            broken[case].write.mode("overwrite").parquet(f"{path}/{d.TABLE}")
        elif case == "descriptor changed":
            spark.createDataFrame([(json.dumps(made | {"kind": "other"}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{d.DESCRIPTOR}")
        else:
            path += "-elsewhere"
        out.append((case, "; ".join(d.problems(spark, path, {"split_sha256": ("6" if case == "other split" else "5") * 64}))))
    return spark.createDataFrame(out, "fault string, problems string")


@query("input_lock_check", "SELECT * FROM (VALUES ('same', ''), ('nation changed', 'table:nation changed'), ('config changed', 'config:shifts changed'), ('region gone', 'table:region is gone')) t(input, problems)")
def input_lock_check(spark: SparkSession, sf: str) -> DataFrame:
    """A lock over two tables and a configuration against the same inputs, changed ones and fewer."""
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    tables, configs = {"nation": read("nation"), "region": read("region")}, {"shifts": shifts.STRENGTH}
    lock = d.input_lock(spark, tables, configs)
    now = {
        "same": (tables, configs),
        "nation changed": (tables | {"nation": read("nation").limit(24)}, configs),
        "config changed": (tables, {"shifts": shifts.STRENGTH | {"mcar": (0.1, 0.4)}}),
        "region gone": ({"nation": tables["nation"]}, configs),
    }
    return spark.createDataFrame([(k, "; ".join(d.lock_problems(lock, d.input_lock(spark, *v)))) for k, v in now.items()], "input string, problems string")


@query("transformation_audit", "SELECT * FROM (VALUES ('sound', ''), ('fewer rows', 'rows were lost or added'), ('another width', 'rows have another width than names')) t(input, problems)")
def transformation_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A preprocessed table of line items against its raw one, whole, short of rows, and with a name too many."""
    rows = stored(line_rows(spark, sf).dropDuplicates(["row_id"]).select("row_id", *LINE_FEATURES), "lines")
    fitted = statistics.fit_preprocessor(rows, dict.fromkeys(LINE_FEATURES, "numeric"))
    done = fitted.transform(rows, ["row_id"])
    cases = {"sound": (done, fitted.names()), "fewer rows": (done.where("row_id % 7 > 0"), fitted.names()), "another width": (done, [*fitted.names(), "more"])}
    return spark.createDataFrame([(k, "; ".join(d.transformed_problems(rows, *v))) for k, v in cases.items()], "input string, problems string")
