"""Bringing tables in: formats, row ids, role inference, isolation of labels, groups and domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from .shared import stored


@dataclass
class Bundle:
    """A data set in parts that share row_id: labels never stand beside features."""

    features: DataFrame
    labels: DataFrame | None
    groups: DataFrame | None
    domains: DataFrame | None
    roles: dict[str, str]


def read_table(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A table by file kind: parquet, csv, json, orc, or blanks (text columns parted by blanks, named c0, c1, ...)."""
    kind = kind or ("parquet" if path.rstrip("/").endswith(".parquet") else path.rsplit(".", 1)[-1].lower())
    if kind == "csv":
        return spark.read.options(header=True, inferSchema=True, **options).csv(path)
    if kind == "blanks":
        parts = F.split(F.trim("value"), r"\s+")
        text = spark.read.text(path)
        width = text.agg(F.max(F.size(parts))).first()[0] or 0
        return text.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(f"c{i}") for i in range(width)])
    return spark.read.format(kind).options(**options).load(path)


def with_row_id(df: DataFrame, key: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """Rows numbered from 0 in the order of key (default: all columns), the same whatever the partitioning.

    One range sort, written once (its ranges come from a sample, which another run draws otherwise), counts of the
    partitions, and an offset for each; no task holds all rows.
    """
    key = key or df.columns
    ordered = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in key]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in key])
    numbered = stored(ordered.withColumn("__id", F.monotonically_increasing_id()), "row-ids")
    part = F.shiftright("__id", 33)
    sizes = {r[0]: r[1] for r in numbered.groupBy(part.alias("p")).count().collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    table = df.sparkSession.createDataFrame(offsets, "__p long, __before long")
    inside = F.col("__id") - F.shiftleft(part, 33)
    return numbered.withColumn("__p", part).join(F.broadcast(table), "__p").withColumn(row_id, F.col("__before") + inside).drop("__id", "__p", "__before")


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def infer_roles(df: DataFrame, skip: list[str] | None = None) -> dict[str, str]:
    """Booleans are boolean, numbers numeric, everything else categorical."""
    return {f.name: "boolean" if isinstance(f.dataType, BooleanType) else "numeric" if isinstance(f.dataType, NumericType) else "categorical" for f in df.schema.fields if f.name not in (skip or [])}


def isolate(df: DataFrame, row_id: str, label: str | None = None, group: str | None = None, domain: str | None = None, drop: list[str] | None = None, roles: dict[str, str] | None = None) -> Bundle:
    """Features without label, group, domain and dropped columns; each of those in a table of its own."""
    side = {c for c in (label, group, domain, *(drop or [])) if c}
    missing = sorted(side - set(df.columns))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    features = nan_to_null(df.select(*[c for c in df.columns if c not in side]))
    part = lambda c: df.select(row_id, c) if c else None
    return Bundle(features, part(label), part(group), part(domain), roles or infer_roles(features, [row_id]))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, x (array of doubles), label of the embeddings table."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


#: The numeric features of lineitem.
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _digits(c: str) -> Column:
    """A time as yyyyMMddHHmmss; years of four digits by arithmetic, which takes a fraction of a formatter's time."""
    number = ((F.year(c).cast("long") * 10000 + F.month(c) * 100 + F.dayofmonth(c)) * 1000000) + (F.hour(c) * 10000 + F.minute(c) * 100 + F.floor(F.second(c)))
    return F.when(F.year(c).between(1000, 9999), number.cast("string")).otherwise(F.date_format(c, "yyyyMMddHHmmss"))


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a row_id hashed from all its columns, the same on every engine (its own key repeats)."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = [F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.round(F.col("l_extendedprice") * 100).cast("long"), _digits("l_shipdate")]
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return df.withColumn("row_id", F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"))


LINE_SQL = """SELECT *, ('0x' || substr(sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * 100)::BIGINT,
    strftime(l_shipdate, '%Y%m%d%H%M%S'))), 1, 15))::BIGINT AS row_id FROM lineitem"""
