"""Landed provider files as bundles. Nothing is fetched: a file that is not there is a status, not a download."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import table_hash
from .ingest import read_table


def group_of(identifier: str) -> Column:
    """The group part of identifiers like 309_1: all but the last underscore and what follows."""
    return F.regexp_replace(F.col(identifier), "_[^_]*$", "")


def deduplicated(names: list[str]) -> list[str]:
    """Column names with a counter after repeats."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n] = seen.get(n, -1) + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def blank_parted(spark: SparkSession, parts: list[str], names: list[str]) -> DataFrame:
    """Text files of numbers parted by blanks, appended in order of part, with part and the names given."""
    out = None
    for k, p in enumerate(parts):
        one = read_table(spark, p, "blanks")
        one = one.select(*[F.col(c).cast("double").alias(n) for c, n in zip(one.columns, deduplicated(names), strict=True)], F.lit(k).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out


def readmissions(spark: SparkSession, path: str, numeric: list[str], domain: str = "admission_source_id") -> DataFrame:
    """A hospital table as CSV: rows of known race, readmission as 0/1 target, numbers cast (bad ones null)."""
    t = spark.read.option("header", True).csv(path).where("race != '?'")
    cast = [F.expr(f"try_cast(`{c}` as double)").alias(c) for c in numeric]
    rest = [c for c in t.columns if c not in {*numeric, "readmitted", domain}]
    return t.select(*cast, *rest, F.col(domain).cast("long").alias(domain), (F.col("readmitted") != "NO").cast("int").alias("target"))


def present(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read at path."""
    try:
        spark.read.parquet(path).limit(0).collect()
        return True
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def statuses(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """dataset_id, status (canonicalized or unavailable) of each data set's features table."""
    return spark.createDataFrame([(k, "canonicalized" if present(spark, f"{p}/features.parquet") else "unavailable") for k, p in paths.items()], "dataset_id string, status string")


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """dataset_id, part, n_rows, n_columns, sha256 of every part of the data sets that are there."""
    rows = []
    for k, p in paths.items():
        for part in ("features", "labels", "groups", "domains"):
            if present(spark, f"{p}/{part}.parquet"):
                t = spark.read.parquet(f"{p}/{part}.parquet")
                rows.append((k, part, t.count(), len(t.columns), table_hash(t)))
    return spark.createDataFrame(rows, "dataset_id string, part string, n_rows long, n_columns int, sha256 string")


def domain_files(spark: SparkSession, paths: dict[str, str], target: str, numeric: list[str] | None = None) -> DataFrame:
    """Landed CSV files of one task, a file or folder for each domain, as one table with columns domain and target.

    Numbers are cast (bad ones null); a column that some domains lack is null there. A domain whose file is not
    there raises.
    """
    out = None
    for domain, path in sorted(paths.items()):
        t = spark.read.option("header", True).csv(path)
        if target not in t.columns:
            raise ValueError(f"{path} has no column {target}")
        cast = [F.expr(f"try_cast(`{c}` as double)").alias(c) for c in t.columns if c != target and (numeric is None or c in numeric)]
        rest = [F.col(c) for c in t.columns if c != target and not (numeric is None or c in numeric)]
        one = t.select(F.lit(domain).alias("domain"), *cast, *rest, F.col(target).alias("target"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
