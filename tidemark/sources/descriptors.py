"""Stored artifacts: a table beside a descriptor that binds its content to what it was made from.

A descriptor is a flat record written as one line of JSON. It names the artifact's kind and coordinates, the
hashes of its inputs and protocols, the hash of its table, and a hash over all of that. Reading verifies the
chain; every way in which it can break has a name. All files go through Spark, so any store will do.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegralType

from ..functions.hashing import config_hash, derived_seed
from .artifacts import table_hash

TABLE, DESCRIPTOR = "table.parquet", "descriptor.json"
OWN = ("content_sha256", "rows", "descriptor_sha256")


def scenario_hash(bundle_sha256: str, split_sha256: str, dataset_id: str, outer_fold: int) -> str:
    """Binds a scenario's inputs: bundle, split, data set and fold."""
    return config_hash({"bundle": bundle_sha256, "dataset_id": dataset_id, "outer_fold": outer_fold, "split": split_sha256})


def pair_hash(source_sha256: str, target_sha256: str) -> str:
    """Binds a source and a target bundle."""
    return hashlib.sha256(f"source:{source_sha256}\ntarget:{target_sha256}".encode()).hexdigest()


def key_universe_hash(rows: DataFrame, key: list[str]) -> str:
    """A hash of a table's keys, whatever their order."""
    return table_hash(rows.select(*key))


def model_fingerprint(method: str, config: Mapping, seed: int, centers, extra: Mapping | None = None) -> str:
    """SHA-256 of a fitted model: what it was fitted with and its centers, as 17 significant digits."""
    digits = [[f"{float(v):.17g}" for v in row] for row in centers]
    return config_hash({"method": method, "config": dict(config), "seed": seed, "centers": digits, "extra": dict(extra or {})})


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, or of the sorted hashes of a folder's files (names and hidden files left out)."""
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"))
    joined = files.agg(F.sort_array(F.collect_list("h")).alias("h"))
    return joined.select(F.when(F.size("h") == 1, F.col("h")[0]).otherwise(F.sha2(F.array_join("h", "|"), 256))).first()[0]


def save(table: DataFrame, path: str, descriptor: Mapping) -> dict:
    """Write table and descriptor under path; the descriptor with its hashes. An artifact that is there is replaced."""
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{path}/{TABLE}")
    kept = spark.read.parquet(f"{path}/{TABLE}")
    out = {k: v for k, v in descriptor.items() if k not in OWN} | {"content_sha256": table_hash(kept), "rows": kept.count()}
    out["descriptor_sha256"] = config_hash(out)
    spark.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{DESCRIPTOR}")
    return out


def descriptor(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{DESCRIPTOR}", wholetext=True).first()[0])


def problems(spark: SparkSession, path: str, expected: Mapping | None = None) -> list[str]:
    """What speaks against an artifact, in a fixed order; empty if it is sound and was made from what is expected."""
    try:
        found = descriptor(spark, path)
        table = spark.read.parquet(f"{path}/{TABLE}")
    except (AnalysisException, ValueError, TypeError) as e:
        return [f"cannot be read: {type(e).__name__}"]
    out = [f"{k} is not the expected one" for k, v in sorted((expected or {}).items()) if found.get(k) != v]
    if found.get("descriptor_sha256") != config_hash({k: v for k, v in found.items() if k != "descriptor_sha256"}):
        out.append("the descriptor was altered")
    if table.count() != found.get("rows"):
        out.append("rows were lost or added")
    if table_hash(table) != found.get("content_sha256"):
        out.append("the table was altered")
    return out


def load(spark: SparkSession, path: str, expected: Mapping | None = None) -> tuple[DataFrame, dict]:
    """A sound artifact's table and descriptor; ValueError tells what is wrong with another."""
    bad = problems(spark, path, expected)
    if bad:
        raise ValueError(f"{path}: " + "; ".join(bad))
    return spark.read.parquet(f"{path}/{TABLE}"), descriptor(spark, path)


def split_descriptor(dataset_id: str, strategy: str, seed: int, bundle_sha256: str, protocol_sha256: str) -> dict:
    return {"kind": "split", "dataset_id": dataset_id, "split_strategy": strategy, "split_seed": seed, "canonical_bundle_sha256": bundle_sha256, "split_protocol_sha256": protocol_sha256}


def save_split(split: DataFrame, path: str, **what) -> dict:
    """A split (fold, side, row_id, and inner_fold where there are inner folds) with its provenance. No row may
    stand on both sides of a fold."""
    of = split.where("side in ('source', 'target')")
    # a row's folds as bits of two numbers, so that one row a row is shuffled; folds that share a bit are told apart after
    place = "cast(fold as bigint)" if isinstance(split.schema["fold"].dataType, IntegralType) else "xxhash64(fold)"
    bits = lambda side: F.bit_or(F.when(F.col("side") == side, F.expr(f"shiftleft(1L, cast(pmod({place}, 63) as int))")))
    near = of.groupBy("row_id").agg(bits("source").alias("s"), bits("target").alias("t")).where("s & t != 0").select("row_id")
    if not near.isEmpty() and not of.join(near, "row_id", "left_semi").groupBy("fold", "row_id").agg(F.count_distinct("side").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a row stands on both sides of a fold")
    return save(split, path, split_descriptor(**what))


def split_hashes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """name, split_sha256, rows of stored splits: the descriptors' own hashes."""
    found = {name: descriptor(spark, p) for name, p in sorted(paths.items())}
    return spark.createDataFrame([(n, d["descriptor_sha256"], d["rows"]) for n, d in found.items()], "name string, split_sha256 string, rows long")


def shift_descriptor(dataset_id: str, outer_fold: int, condition: str, seed: int, bundle_sha256: str, split_sha256: str, protocol_sha256: str, status: str = "APPLICABLE", reason: str | None = None) -> dict:
    family, _, severity = ("clean", "", "none") if condition == "clean" else condition.rpartition("_")
    return {
        "kind": "shift", "dataset_id": dataset_id, "outer_fold": outer_fold, "condition": condition, "family": family, "severity": severity, "status": status, "reason": reason,
        "canonical_bundle_sha256": bundle_sha256, "split_sha256": split_sha256, "shift_protocol_sha256": protocol_sha256,
        "scenario_input_sha256": scenario_hash(bundle_sha256, split_sha256, dataset_id, outer_fold), "derived_seed": derived_seed(seed, dataset_id, outer_fold, family, "spec"),
    }


def shift_path(root: str, dataset_id: str, outer_fold: int, condition: str) -> str:
    return f"{root.rstrip('/')}/{dataset_id}/fold_{outer_fold}/{condition}"


def save_shift(cells: DataFrame, root: str, **what) -> dict:
    """A shift's changed cells (row_id, column, value), under its place below root."""
    made = shift_descriptor(**what)
    return save(cells, shift_path(root, made["dataset_id"], made["outer_fold"], made["condition"]), made)


def shift_problems(spark: SparkSession, root: str, **what) -> list[str]:
    """problems of a stored shift against its present inputs, seeds and protocol. Its status and reason are its own."""
    made = shift_descriptor(**what)
    return problems(spark, shift_path(root, made["dataset_id"], made["outer_fold"], made["condition"]), {k: v for k, v in made.items() if k not in ("status", "reason")})


def bank_descriptor(kind: str, dataset_id: str, outer_fold: int, seed: int, bundle_sha256: str, split_sha256: str, protocol_sha256: str, condition: str = "clean", shift_sha256: str | None = None) -> dict:
    """kind: reference (source rows) or current (shifted target rows, bound to their shift)."""
    if kind not in ("reference", "current") or (kind == "current") != (shift_sha256 is not None):
        raise ValueError("a reference bank has no shift, a current one has")
    return {
        "kind": f"{kind}_bank", "dataset_id": dataset_id, "outer_fold": outer_fold, "condition": condition, "canonical_bundle_sha256": bundle_sha256, "split_sha256": split_sha256, "probe_protocol_sha256": protocol_sha256,
        "shift_spec_sha256": shift_sha256, "derived_seed": derived_seed(seed, dataset_id, outer_fold, f"{kind}-bank", *([condition] if kind == "current" else [])),
    }


def save_bank(positions: DataFrame, path: str, most: int, **what) -> dict:
    """A bank's row ids, at most `most` of them."""
    if positions.count() > most:
        raise ValueError(f"a bank has at most {most} rows")
    return save(positions, path, bank_descriptor(**what))


def bank_rows(features: DataFrame, spark: SparkSession, path: str, expected: Mapping | None = None, row_id: str = "row_id") -> DataFrame:
    """The features of a stored bank's rows, as often as the bank has them; ValueError if one is missing."""
    positions, found = load(spark, path, expected)
    out = features.join(F.broadcast(positions.select(row_id)), row_id)
    if out.count() < found["rows"]:
        raise ValueError("the bank has rows that the table lacks")
    return out


def save_replay(before: DataFrame, after: DataFrame | Mapping[str, Column], columns: list[str], path: str, shift: Mapping, row_id: str = "row_id") -> dict:
    """The cells in which after differs from before, without labels, bound to the shift's descriptor.

    The cells are put into before and compared with after; a difference raises ValueError. A cell that went
    missing is a null value. after may be the new values as expressions over before's rows, which saves the joins of both.
    """
    from ..operators.shifts import changed_cells, differing_cells, overlay

    own = isinstance(after, Mapping)
    cells = changed_cells(before, dict(after), row_id) if own else differing_cells(before, after, columns, row_id)
    keep = {k: shift[k] for k in ("dataset_id", "outer_fold", "condition", "canonical_bundle_sha256", "split_sha256", "shift_protocol_sha256")}
    made = save(cells, path, keep | {"kind": "replay", "shift_spec_sha256": shift["descriptor_sha256"], "columns": sorted(columns)})
    kept = before.sparkSession.read.parquet(f"{path}/{TABLE}")
    if own:
        both = before.select(row_id, *columns, *[e.alias(f"__after_{c}") for c, e in after.items()])
        replayed = overlay(both, kept, columns, row_id)
        other = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"__after_{c}" if c in after else c)) for c in columns], F.lit(False))
        wrong = replayed.where(other)
    else:
        wrong = differing_cells(after, overlay(before, kept, columns, row_id), columns, row_id)
    if not wrong.isEmpty():
        raise ValueError("the stored cells do not reproduce the shift")
    return made


def input_lock(spark: SparkSession, tables: Mapping[str, DataFrame], configs: Mapping[str, object]) -> dict:
    """Hashes of all tables and configurations that a pass reads, and one over them."""
    parts = {f"table:{n}": table_hash(t) for n, t in tables.items()} | {f"config:{n}": config_hash(c) for n, c in configs.items()}
    return parts | {"lock_sha256": config_hash(parts)}


def lock_problems(lock: Mapping[str, str], now: Mapping[str, str]) -> list[str]:
    """Inputs that were changed, lost or added since the lock was taken, and a lock that was altered."""
    names = lambda m: {k for k in m if k != "lock_sha256"}
    out = [f"{k} changed" for k in sorted(names(lock) & names(now)) if lock[k] != now[k]]
    out += [f"{k} is gone" for k in sorted(names(lock) - names(now))] + [f"{k} is new" for k in sorted(names(now) - names(lock))]
    if lock.get("lock_sha256") != config_hash({k: v for k, v in lock.items() if k != "lock_sha256"}):
        out.append("the lock was altered")
    return out


def transformed_problems(raw: DataFrame, transformed: DataFrame, names: list[str], features: str = "features", row_id: str = "row_id") -> list[str]:
    """What speaks against a preprocessed table: rows lost or added, another width, values that are not finite."""
    if not isinstance(transformed.schema[features].dataType, ArrayType) or not isinstance(transformed.schema[features].dataType.elementType, (DoubleType, FloatType)):
        return ["features are not an array of numbers"]
    out = []
    both = raw.select(row_id).join(transformed.select(row_id, F.lit(True).alias("__there")), row_id, "full")
    if raw.count() != transformed.count() or not both.where("__there is null").isEmpty():
        out.append("rows were lost or added")
    bad = transformed.agg(F.max((F.size(features) != len(names)).cast("int")).alias("w"), F.max(F.exists(features, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).cast("int")).alias("v")).first()
    return out + ["rows have another width than names"] * bool(bad["w"]) + ["values are missing or infinite"] * bool(bad["v"])
