"""Verification of a whole store of artifacts, and of results that follow from stored tables.

A store is a folder of artifacts of one kind (see descriptors). Its file listing, all descriptors and all tables are read
as three DataFrames, whatever the number of artifacts, and joined with the universe of keys that is expected. Results
are chained to their tables by a tree of hashes: files are leaves, a table's hash is that of its leaves, so a changed file
is named, and only what depends on a changed table is computed again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import config_hash
from .descriptors import DESCRIPTOR, TABLE
from .shared import stored

_PART = rf"^(.*?)/?({TABLE}|{DESCRIPTOR})/[^/]*$"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """artifact (the path below root), part (table or descriptor, null for other files), file, bytes of every file of a store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    below = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    start = "/" + root.partition(":")[2].strip("/") if ":" in root else root.rstrip("/")
    rest = F.expr(f"substring(__below, {len(start) + 2})")
    out = files.withColumn("__below", below).withColumn("__rest", rest)
    hidden = F.col("__rest").rlike(r"(^|/)[._][^/]*$")
    part = F.when(F.regexp_extract("__rest", _PART, 2) == TABLE, "table").when(F.regexp_extract("__rest", _PART, 2) == DESCRIPTOR, "descriptor")
    return out.where(~hidden).select(F.when(part.isNotNull(), F.regexp_extract("__rest", _PART, 1)).otherwise(F.col("__rest")).alias("artifact"), part.alias("part"), F.col("path").alias("file"), F.col("length").alias("bytes"))


def descriptors(spark: SparkSession, files: DataFrame) -> DataFrame:
    """artifact, found (its fields as text), own (whether its hash is that of its fields) of all descriptors of a listing; unreadable ones have no fields."""
    paths = [r["file"] for r in files.where("part = 'descriptor'").select("file").toLocalIterator()]
    schema = "artifact string, found map<string,string>, own boolean"
    if not paths:
        return spark.createDataFrame([], schema)
    where = files.where("part = 'descriptor'").select(F.col("file"), "artifact")
    name = F.regexp_replace(F.input_file_name(), r"^[a-z]+:/*", "/")
    texts = spark.read.text(paths, wholetext=True).select(name.alias("__file"), "value")
    rows = texts.join(where.withColumn("__file", F.regexp_replace("file", r"^[a-z]+:/*", "/")), "__file").select("artifact", "value")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, own = [], []
            for text in batch.column(1).to_pylist():
                try:
                    d = json.loads(text)
                    found.append([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in d.items()])
                    own.append(d.get("descriptor_sha256") == config_hash({k: v for k, v in d.items() if k != "descriptor_sha256"}))
                except (ValueError, AttributeError):
                    found.append(None)
                    own.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.map_(pa.string(), pa.string())), pa.array(own)], ["artifact", "found", "own"])

    return rows.mapInArrow(read, schema)


def _content(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """by, rows, sha256: the hash of artifacts.table_hash of each group of rows."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)"))
    shape = ",".join(f"{c}:{k}" for c, k in sorted(df.select(*columns).dtypes))
    got = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), total(1).alias("a"), total(2).alias("b"))
    sha = F.sha2(F.concat_ws("|", F.lit(shape), *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("rows", "a", "b")]), 256)
    return got.select(by, "rows", sha.alias("sha256"))


def tables(spark: SparkSession, root: str, files: DataFrame) -> tuple[DataFrame, list[str]] | None:
    """The rows of all tables of a store, with artifact, and the tables' columns; None if it has none."""
    some = files.where("part = 'table' and bytes > 0").select("file").first()
    if some is None:
        return None
    schema = spark.read.parquet(some["file"]).schema
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    names = files.where("part = 'table'").select(F.regexp_replace("file", r"^[a-z]+:/*", "/").alias("__file"), "artifact")
    return rows.withColumn("__file", F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/*", "/")).join(names, "__file").drop("__file"), schema.names


def store_problems(spark: SparkSession, root: str, universe: DataFrame, gathered: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """artifact, problem of a store against the universe (artifact, expected: the fields that its descriptor must have).

    Problems: missing, orphan (an artifact or file that no key has), no table, no descriptor, unreadable, altered
    descriptor, field not as expected, rows lost or added, altered table. gathered: (positions, position, row id), where
    positions has artifact, position and row id; a table's row whose id is not the one at its position is misplaced.
    """
    files = stored(listing(spark, root), "listing")
    known = files.where("part is not null").groupBy("artifact").agg(F.max((F.col("part") == "table").cast("int")).alias("table"), F.max((F.col("part") == "descriptor").cast("int")).alias("descriptor"))
    both = universe.select("artifact", F.lit(True).alias("wanted")).join(known, "artifact", "full")
    say = lambda when, text: F.when(when, text)
    shape = F.array_compact(F.array(say(F.col("table").isNull() & F.col("descriptor").isNull(), "missing"), say(F.col("wanted").isNull(), "orphan"), say(F.col("table") == 0, "no table"), say(F.col("descriptor") == 0, "no descriptor")))
    out = both.select("artifact", F.explode(shape).alias("problem"))
    out = out.unionByName(files.where("part is null").select("artifact", F.lit("orphan").alias("problem")))
    found = descriptors(spark, files)
    out = out.unionByName(found.select("artifact", F.explode(F.array_compact(F.array(say(F.col("found").isNull(), "unreadable"), say(F.col("found").isNotNull() & ~F.col("own"), "altered descriptor")))).alias("problem")))
    fields = universe.select("artifact", F.explode("expected").alias("field", "value")).join(found.where("found is not null"), "artifact")
    out = out.unionByName(fields.where(~F.col("value").eqNullSafe(F.element_at("found", F.col("field")))).select("artifact", F.concat("field", F.lit(" is not the expected one")).alias("problem")))
    held = tables(spark, root, files)
    if held is not None:
        rows, columns = held
        now = _content(rows, "artifact", columns)
        compared = found.where("found is not null").join(now, "artifact", "left").join(known.where("table = 1").select("artifact"), "artifact")
        n, sha = F.coalesce("rows", F.lit(0)), F.coalesce("sha256", F.lit(""))
        wrong = F.array_compact(F.array(say(n.cast("string") != F.element_at("found", "rows"), "rows lost or added"), say((n > 0) & (sha != F.element_at("found", "content_sha256")), "altered table")))
        out = out.unionByName(compared.select("artifact", F.explode(wrong).alias("problem")))
        if gathered is not None:
            positions, at, row_id = gathered
            right = positions.select("artifact", at, F.col(row_id).alias("__right"))
            off = rows.join(right, ["artifact", at], "left").where(~F.col(row_id).eqNullSafe(F.col("__right")))
            out = out.unionByName(off.groupBy("artifact").agg(F.count(F.lit(1)).alias("n")).select("artifact", F.concat(F.col("n").cast("string"), F.lit(" misplaced rows")).alias("problem")))
    return out


def leaves(spark: SparkSession, path: str) -> dict[str, str]:
    """The hash of each file's rows of a Parquet table, by the file's name: the leaves of its tree."""
    rows = spark.read.parquet(path)
    named = rows.withColumn("__file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return {r["__file"]: r["sha256"] for r in _content(named, "__file", rows.columns).collect()}


def chained(tables_: Mapping[str, Mapping[str, str]], report: Mapping) -> dict:
    """A report bound to the trees of the tables that it follows from."""
    roots = {name: config_hash(dict(sorted(of.items()))) for name, of in tables_.items()}
    body = {"leaves": {name: dict(of) for name, of in tables_.items()}, "roots": roots, "report": json.loads(json.dumps(report))}
    return body | {"chain_sha256": config_hash(body)}


def changed(spark: SparkSession, chain: Mapping, paths: Mapping[str, str]) -> list[str]:
    """Tables' files that were altered, lost or added since the chain was made, and a chain that was altered itself."""
    out = []
    if chain.get("chain_sha256") != config_hash({k: v for k, v in chain.items() if k != "chain_sha256"}):
        out.append("the chain was altered")
    for name, path in sorted(paths.items()):
        then = chain["leaves"].get(name, {})
        try:
            now = leaves(spark, path)
        except AnalysisException:
            out.append(f"{name} cannot be read")
            continue
        if config_hash(dict(sorted(now.items()))) != chain["roots"].get(name):
            out += [f"{name}/{f} was {'lost' if f not in now else 'added' if f not in then else 'altered'}" for f in sorted(then.keys() | now.keys()) if then.get(f) != now.get(f)]
    return out


def differences(want: object, got: object, tolerance: float = 1e-9, at: str = "") -> list[str]:
    """Where two reports of numbers, texts, lists and mappings differ; numbers may by the tolerance."""
    if isinstance(want, Mapping) and isinstance(got, Mapping):
        keys = sorted(want.keys() | got.keys())
        return [d for k in keys for d in (differences(want[k], got[k], tolerance, f"{at}/{k}") if k in want and k in got else [f"{at}/{k}: on one side only"])]
    if isinstance(want, list | tuple) and isinstance(got, list | tuple) and len(want) == len(got):
        return [d for k, (a, b) in enumerate(zip(want, got, strict=True)) for d in differences(a, b, tolerance, f"{at}/{k}")]
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    same = abs(want - got) <= tolerance * max(1.0, abs(want)) if number(want) and number(got) else want == got
    return [] if same else [f"{at}: {want} and {got}"]
