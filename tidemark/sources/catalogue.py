"""The catalogue of data sets: a table of specifications with lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, dataset_group string, source_provider string, n_rows long, n_features int, n_classes int, target string, split_strategy string, feature_roles map<string,string>, license string"
#: The tables of the driver as data sets.
DRIVER_SPECS = [
    ("embeddings", "controlled_real", "driver", None, 64, 10, "label", "kfold", {}, ""),
    ("lineitem", "controlled_real", "driver", None, 4, 3, "l_returnflag", "kfold", {"l_quantity": "numeric", "l_linestatus": "categorical"}, ""),
    ("events", "controlled_real", "driver", None, 1, 5, "event_type", "group_kfold", {"value": "numeric"}, ""),
    ("orders", "natural_shift", "driver", None, 1, 3, "o_orderstatus", "temporal", {"o_totalprice": "numeric"}, ""),
    ("customer", "natural_shift", "driver", None, 1, 5, "c_mktsegment", "leave_one_domain_out", {"c_acctbal": "numeric"}, ""),
]
#: Synthetic families: id, distribution, K, dimension, rows, degrees of freedom.
SYNTHETIC = [("s01", "gaussian", 3, 10, 10_000, None), ("s02", "gaussian", 4, 10, 10_000, None), ("s03", "gaussian", 5, 100, 10_000, None), ("s04", "student", 3, 10, 10_000, 3.0)]


def catalogue(spark: SparkSession, specs: Iterable[tuple] = DRIVER_SPECS) -> DataFrame:
    return spark.createDataFrame(list(specs), SCHEMA)


def spec(table: DataFrame, name: str):
    """The row of one data set; KeyError if there is none."""
    found = table.where(F.col("id") == name).limit(2).collect()
    if len(found) != 1:
        raise KeyError(name)
    return found[0]


def listed(table: DataFrame, group: str | None = None, provider: str | None = None) -> list[str]:
    if group:
        table = table.where(F.col("dataset_group") == group)
    if provider:
        table = table.where(F.col("source_provider") == provider)
    return [r["id"] for r in table.select("id").orderBy("id").collect()]


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue in a file of JSON records, one a line, with SCHEMA's fields. ValueError names records without an
    id or target, repeated ids, and roles that no column can have."""
    table = spark.read.schema(SCHEMA).json(path)
    roles = F.exists(F.map_values(F.coalesce("feature_roles", F.create_map().cast("map<string,string>"))), lambda r: ~r.isin("numeric", "categorical", "ordinal", "boolean"))
    twice = table.groupBy("id").count().where("count > 1").select("id")
    wrong = table.where(F.col("id").isNull() | F.col("target").isNull() | roles).select("id").unionByName(twice)
    bad = sorted({str(r["id"]) for r in wrong.limit(1000).collect()})
    if bad:
        raise ValueError(f"not sound in the registry: {bad}")
    return table


def synthetic_spec(name: str) -> dict:
    """A synthetic family by id; KeyError if there is none."""
    found = {s[0]: dict(zip(("id", "distribution", "k", "dimension", "rows", "df"), s, strict=True)) for s in SYNTHETIC}
    return found[name]
