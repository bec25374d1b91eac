"""Queries of ingest, audits, preprocessing, splits and banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import derived_seed_column, record_hash, sql_draw, sql_record, sql_uniform, uniform
from ..operators import folds, shifts, signals, statistics
from ..sources.ingest import LINE_FEATURES, LINE_SQL, embedding_points, isolate, line_rows, with_row_id
from ..sources.shared import stored
from .registry import query

SEED = 20260907
SOURCE = 0.6


#: Added before rounding where values may stand half-way between two roundings by construction.
NUDGE = 3e-9


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show; negative zero is written as zero."""
    return df.select(*[(F.round(F.col(c) + nudge if nudge else c, digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def side(df: DataFrame, which: str, row_id: str = "row_id") -> DataFrame:
    """Source or target rows of a fixed seeded split."""
    u = uniform(SEED, "split", row_id)
    return df.where(u < SOURCE if which == "source" else u >= SOURCE)


def sql_side(which: str, row_id: str = "row_id") -> str:
    return f"{sql_uniform(SEED, 'split', row_id)} {'<' if which == 'source' else '>='} {SOURCE}"


POINTS = "SELECT vec_id AS row_id, embedding::DOUBLE[] AS x, label FROM embeddings"
LONG = "SELECT row_id, label, i, x[i] AS v FROM pts, range(1, 65) t(i)"


@query("label_isolation_bundle", "SELECT vec_id AS row_id, len(embedding) AS n_features, false AS has_label FROM embeddings")
def label_isolation_bundle(spark: SparkSession, sf: str) -> DataFrame:
    b = isolate(embedding_points(spark, sf), "row_id", label="label")
    return b.features.select("row_id", F.size("x").alias("n_features"), F.lit("label" in b.features.columns).alias("has_label"))


_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM lineitem" for c in LINE_FEATURES)


@query("feature_audit", f'SELECT "column", count(*) FILTER (v IS NULL OR isnan(v)) AS n_missing, count(*) FILTER (isinf(v)) AS n_infinite, min(v) = max(v) AS constant FROM ({_CELLS}) GROUP BY 1')
def feature_audit(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.feature_audit(spark.read.parquet(f"{sf}/lineitem.parquet"), LINE_FEATURES)


@query("duplicate_rows", "SELECT sum(n) AS n_rows, sum(n - 1) AS n_duplicates FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.duplicate_rows(spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type"))


#: A role table with faults, for the check.
ROLE_ROWS = [("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "number"), ("l_returnflag", "categorical"), ("l_returnflag", "boolean"), ("l_color", "categorical")]
_ROLES = ", ".join(f"('{c}', '{r}')" for c, r in ROLE_ROWS)


@query(
    "role_validation",
    f"""WITH roles("column", role) AS (VALUES {_ROLES}), have AS (SELECT column_name AS "column" FROM (DESCRIBE lineitem))
SELECT "column", 'no role' AS problem FROM have WHERE "column" NOT IN (SELECT "column" FROM roles)
UNION ALL SELECT "column", 'no such column' FROM roles WHERE "column" NOT IN (SELECT "column" FROM have)
UNION ALL SELECT "column", 'unknown role' FROM roles WHERE role NOT IN ('numeric', 'categorical', 'ordinal', 'boolean')
UNION ALL SELECT "column", 'repeated' FROM roles GROUP BY 1 HAVING count(*) > 1""",
)
def role_validation(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.role_errors(spark.read.parquet(f"{sf}/lineitem.parquet"), spark.createDataFrame(ROLE_ROWS, "column string, role string"))


_SRC = f"src AS (SELECT * FROM ({LINE_SQL}) WHERE {sql_side('source')})"
_SRC_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM src" for c in LINE_FEATURES)
STATS = f"""{_SRC}, stats AS (SELECT "column", count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, median(v) AS median FROM ({_SRC_CELLS}) GROUP BY 1)"""


@query("source_statistics", f'WITH {STATS} SELECT "column", n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, sd <= 1e-12 AS zero_variance FROM stats')
def source_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.source_statistics(side(line_rows(spark, sf), "source"), LINE_FEATURES))


_GONE = "{c} IS NOT NULL AND row_number() OVER (PARTITION BY {c} IS NULL ORDER BY {d}, row_id) <= round_even(count({c}) OVER () * 0.1, 0)"
_MISSING = ", ".join(f"CASE WHEN NOT ({_GONE.format(c=c, d=sql_draw(SEED, f'mcar-{c}', 'row_id'))}) THEN {c} END AS {c}" for c in LINE_FEATURES)
_MED = ", ".join(f"median({c}) AS {c}" for c in LINE_FEATURES)
_FILL = ", ".join(f"coalesce(m.{c}, d.{c}) AS {c}" for c in LINE_FEATURES)
_SCALE = ", ".join(f"round((f.{c} - s.{c}_m) / s.{c}_s, 4) + 0.0 AS {c}" for c in LINE_FEATURES)
_MOM = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in LINE_FEATURES)


@query(
    "impute_scale_numeric",
    f"""WITH holes AS (SELECT row_id, {_MISSING} FROM ({LINE_SQL})), d AS (SELECT {_MED} FROM holes WHERE {sql_side('source')}),
filled AS (SELECT m.row_id, {_FILL} FROM holes m, d), s AS (SELECT {_MOM} FROM filled WHERE {sql_side('source')})
SELECT row_id, {_SCALE} FROM filled f, s WHERE NOT ({sql_side('source')})""",
)
def impute_scale_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Median imputation and population scaling fitted on source rows with missing cells, applied to target rows."""
    # the cells that stay and the side are found once; medians, moments and the result read them
    lines = stored(line_rows(spark, sf).select("row_id", *LINE_FEATURES), "lines")
    holes = stored(shifts.mcar_shift(lines, LINE_FEATURES, "mild", SEED), "holes")
    p = statistics.fit_preprocessor(side(holes, "source"), dict.fromkeys(LINE_FEATURES, "numeric"))
    return rounded(side(holes, "target").select("row_id", *[e.alias(c) for c, e in p.expressions().items()]), 4)


@query(
    "onehot_min_frequency",
    """WITH n AS (SELECT p_brand AS b, count(*) AS k, sum(count(*)) OVER () AS t FROM part GROUP BY 1), kept AS (SELECT b FROM n WHERE k >= 0.041 * t)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT b FROM kept) THEN p_brand ELSE 'infrequent' END AS category FROM part""",
)
def onehot_min_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """The one-hot column that is set for each part's brand, rare brands together."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    p = statistics.fit_preprocessor(part, {"p_brand": "categorical"}, min_frequency=0.041)
    names = [n.partition("=")[2] for n in p.names()]
    hot = F.array(*[e for e in p.expressions().values()])
    return part.select("p_partkey", F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(hot, 1.0).cast("int")).alias("category"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_CODE = f"list_position({PRIORITIES!r}, o_orderpriority) - 1"


@query("ordinal_encode", f"SELECT o_orderkey, round(({_CODE} - avg({_CODE}) OVER ()) / stddev_pop({_CODE}) OVER (), 6) AS code FROM orders")
def ordinal_encode(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    p = statistics.fit_preprocessor(orders, {"o_orderpriority": "ordinal"}, {"o_orderpriority": PRIORITIES})
    return rounded(orders.select("o_orderkey", p.expressions()["o_orderpriority"].alias("code")))


@query("boolean_normalise", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE value > 10 END AS flag FROM events")
def boolean_normalise(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE event_id % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'F' WHEN 2 THEN '' ELSE cast(cast(value > 10 as int) as string) END")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", statistics.as_boolean(text).alias("flag"))


@query(
    "unseen_categories",
    f"""WITH o AS (SELECT *, {sql_uniform(SEED, 'split', 'o_orderkey')} < {SOURCE} AS source FROM orders), v AS (SELECT 'o_custkey' AS "column", o_custkey::VARCHAR AS v, source FROM o UNION ALL SELECT 'o_clerk_day', strftime(o_orderdate, '%Y-%m-%d'), source FROM o),
s AS (SELECT DISTINCT "column", v FROM v WHERE source), t AS (SELECT v.*, s.v IS NULL AND v.v IS NOT NULL AS new FROM v LEFT JOIN s USING ("column", v) WHERE NOT source)
SELECT "column", count(*) FILTER (new) AS n_unseen, count(DISTINCT v) FILTER (new) AS n_values FROM t GROUP BY 1""",
)
def unseen_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and days of the target's orders that no order of the source has; both have vocabularies as tables."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_clerk_day"))
    p = statistics.fit_preprocessor(side(orders, "source", "o_orderkey"), {"o_custkey": "categorical", "o_clerk_day": "categorical"}, min_frequency=0.0)
    return p.unseen(side(orders, "target", "o_orderkey"))


@query(
    "sparse_one_hot",
    f"""WITH o AS (SELECT o_orderkey, o_custkey::VARCHAR AS v, {sql_uniform(SEED, 'split', 'o_orderkey')} < {SOURCE} AS source FROM orders), n AS (SELECT v, count(*) AS k, sum(count(*)) OVER () AS t FROM o WHERE source GROUP BY 1),
c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM n WHERE k >= 0.0005 * t), m AS (SELECT count(*) AS m, (SELECT count(*) FROM n) > count(*) AS rare FROM c)
SELECT o_orderkey, (m + rare::INTEGER)::INTEGER AS size, CASE WHEN code IS NOT NULL THEN code WHEN n.v IS NOT NULL THEN m END::INTEGER AS place FROM o LEFT JOIN c USING (v) LEFT JOIN n USING (v), m WHERE NOT source""",
)
def sparse_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The one-hot place of each target order's customer in the source's vocabulary; rare ones share the last, unseen ones have none."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    p = statistics.fit_preprocessor(side(orders, "source", "o_orderkey"), {"o_custkey": "categorical"}, min_frequency=0.0005)
    return p.sparse(side(orders, "target", "o_orderkey"), ["o_orderkey"]).select("o_orderkey", "size", F.get("indices", F.lit(0)).alias("place"))


def _rank(purpose: str, rid: str = "row_id") -> str:
    return f"row_number() OVER (ORDER BY {sql_draw(folds.SEED, purpose, rid)}, {rid}) - 1"


KFOLD = f"""of AS (SELECT row_id, ({_rank('outer')}) % 5 AS o FROM pts),
split AS (SELECT f::INTEGER AS fold, CASE WHEN o = f THEN 'target' ELSE 'source' END AS side, row_id FROM of, range(5) t(f))"""


@query("kfold_split", f"WITH pts AS ({POINTS}), {KFOLD} SELECT * FROM split")
def kfold_split(spark: SparkSession, sf: str) -> DataFrame:
    return folds.kfold(embedding_points(spark, sf))


_INNER_ID = "concat_ws('-', fold, row_id)"


@query(
    "inner_kfold",
    f"""WITH pts AS ({POINTS}), {KFOLD},
inner_ AS (SELECT fold, row_id, (row_number() OVER (PARTITION BY fold ORDER BY {sql_draw(folds.SEED, 'inner', _INNER_ID)}, row_id) - 1) % 3 AS o FROM split WHERE side = 'source')
SELECT fold, f::INTEGER AS inner_fold, CASE WHEN o = f THEN 'validation' ELSE 'train' END AS side, row_id FROM inner_, range(3) t(f)""",
)
def inner_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return folds.inner_kfold(folds.kfold(embedding_points(spark, sf)))


@query("group_kfold_split")
def group_kfold_split(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy balance has no plain SQL; tests check disjoint groups and balance."""
    return folds.group_kfold(spark.read.parquet(f"{sf}/events.parquet"), "user_id")


_TEMPORAL = """WITH n AS (SELECT count(*) AS n, count(*) // 6 AS b FROM orders),
d AS (SELECT o_orderdate AS t, count(*) AS k, sum(count(*)) OVER (ORDER BY o_orderdate) AS e FROM orders GROUP BY 1),
cuts AS (SELECT f, (f + 1) * b AS lo, CASE WHEN f = 4 THEN n ELSE (f + 2) * b END AS hi FROM n, range(5) r(f)),
sides AS (SELECT f, t, CASE WHEN e <= lo THEN 'source' WHEN e <= hi THEN 'target' END AS side FROM d, cuts)
SELECT f::INTEGER AS fold, side, o_orderkey AS row_id FROM orders JOIN sides ON o_orderdate = t WHERE side IS NOT NULL"""


@query("temporal_block_split", _TEMPORAL)
def temporal_block_split(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), "o_orderdate")
    return folds.temporal_folds(orders, "o_orderdate")


_DOMAIN = f"({sql_draw(folds.SEED, 'domain', chr(39) + chr(39) + ' || concat_ws(' + chr(39) + '-' + chr(39) + ', g, row_id)')}) % 5"


@query(
    "leave_one_domain_out",
    f"""WITH c AS (SELECT c_custkey AS row_id, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT g, row_id, region, {_DOMAIN} AS o FROM c, (SELECT DISTINCT region AS g FROM c))
SELECT g AS domain, f::INTEGER AS fold, CASE WHEN region = g THEN 'target' ELSE 'source' END AS side, row_id FROM e, range(5) r(f) WHERE region = g OR o <> f""",
)
def leave_one_domain_out(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").join(F.broadcast(spark.read.parquet(f"{sf}/nation.parquet")), F.col("c_nationkey") == F.col("n_nationkey"))
    return folds.leave_one_domain_out(c.select(F.col("c_custkey").alias("row_id"), F.col("n_regionkey").alias("region")), "region")


@query(
    "fixed_target_resampling",
    f"""WITH s AS (SELECT s_suppkey AS row_id, s_nationkey % 2 AS d FROM supplier), of AS (SELECT row_id, (row_number() OVER (ORDER BY {sql_draw(folds.SEED, 'resample', 'row_id')}, row_id) - 1) % 5 AS o FROM s WHERE d = 0)
SELECT f::INTEGER AS fold, 'source' AS side, row_id FROM of, range(5) t(f) WHERE o <> f UNION ALL SELECT f::INTEGER, 'target', row_id FROM s, range(5) t(f) WHERE d = 1""",
)
def fixed_target_resampling(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("row_id"), (F.col("s_nationkey") % 2).alias("d"))
    return folds.fixed_target(s.where("d = 0"), s.where("d = 1"))


def _bank_sql(purpose: str, rows: str, size: int) -> str:
    return f"SELECT row_id FROM ({rows}) ORDER BY {sql_draw(SEED, purpose, 'row_id')}, row_id LIMIT {size}"


REF_BANK = _bank_sql("reference-bank", f"SELECT * FROM pts WHERE {sql_side('source')}", signals.BANK)


@query("reference_bank", f"WITH pts AS ({POINTS}) {REF_BANK}")
def reference_bank(spark: SparkSession, sf: str) -> DataFrame:
    return signals.bank(side(embedding_points(spark, sf), "source"), SEED, "reference-bank").select("row_id")


@query("reference_bank_lineitem", f"WITH pts AS ({LINE_SQL}) {REF_BANK}")
def reference_bank_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """The bank's size, 2048, is the feature here: a sample of a table that is larger."""
    return signals.bank(side(line_rows(spark, sf), "source"), SEED, "reference-bank").select("row_id")


_REC = sql_record("o_orderkey", "o_custkey", "o_orderstatus", "round(o_totalprice * 100)::BIGINT")


@query("record_hash", f"SELECT o_orderkey, sha256({_REC}) AS record_sha256 FROM orders")
def record_hash_query(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", record_hash(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.round(F.col("o_totalprice") * 100).cast("long")).alias("record_sha256"))


@query("derive_seed", "SELECT n_nationkey, (('0x' || substr(sha256('2026090704:' || n_name || ':3:clean:spec'), 1, 16))::UBIGINT % 2147483647)::BIGINT AS seed FROM nation")
def derive_seed(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return n.select("n_nationkey", derived_seed_column(F.lit(2026090704), F.col("n_name"), F.lit(3), F.lit("clean"), F.lit("spec")).alias("seed"))


@query("key_universe_sha256", "SELECT sha256(string_agg(k, chr(10) ORDER BY k)) AS sha256 FROM (SELECT DISTINCT c_nationkey || ':' || c_mktsegment AS k FROM customer)")
def key_universe_sha256(spark: SparkSession, sf: str) -> DataFrame:
    """A hash of the distinct keys (a scenario universe is small by design; here 125 keys)."""
    keys = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat_ws(":", "c_nationkey", "c_mktsegment").alias("k")).distinct()
    return keys.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("k")), "\n"), 256).alias("sha256"))


@query("row_ids", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_id FROM lineitem")
def row_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Line items numbered in the order of their keys and price."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return with_row_id(lines).drop("l_extendedprice")
