"""Column statistics, audits and preprocessing fitted on source rows only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

ROLES = ("numeric", "categorical", "ordinal", "boolean")
ZERO_SD = 1e-12
#: Groups up to this size are put in order whole; of larger ones the values within BRACKET of a quantile's rank, as a sketch of SKETCH points finds them.
SMALL, BRACKET, SKETCH = 2000, 0.0015, 5000
#: Values of a column that are encoded by expressions; the vocabulary of a column with more is a table.
LITERALS = 1000
#: Vocabularies are broadcast up to this many values; of larger ones the values with at least this share of rows are.
BROADCAST_VALUES, HOT_SHARE = 200_000, 0.001
MISSING = "__MISSING_SOURCE__"
#: Texts read as booleans.
TRUE = ("true", "t", "yes", "y", "1", "1.0")
FALSE = ("false", "f", "no", "n", "0", "0.0")


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row for each row and column: the kept columns, column, value (double)."""
    return df.select(*(keep or []), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("cell")).select(*(keep or []), "cell.*")


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """by, column, n, q (array: the interpolated quantile of each probability), over values that are present.

    Exact without one task's seeing a column: a sketch brackets each quantile by a narrow range of values, whose
    distinct values are counted; only they, about 0.3 % of a large group, are put in order. A group or column
    without values has no row.
    """
    by = by or []
    cells = long_form(df, columns, by).where("value is not null and not isnan(value)")
    near = [min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-BRACKET, BRACKET)]
    bounds = cells.groupBy(*by, "column").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", near, SKETCH).alias("near"))
    edge = lambda k, up: F.when(F.col("n") <= SMALL, F.lit(float("inf" if up else "-inf"))).otherwise(F.col("near")[2 * k + up])
    ranges = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p"), edge(k, 0).alias("lo"), edge(k, 1).alias("hi")) for k, p in enumerate(probabilities)])
    ranges = bounds.select(*by, "column", "n", F.explode(ranges).alias("r")).select(*by, "column", "n", "r.*")
    key = [*by, "column", "k"]
    # below the range only the number of values matters
    inside = cells.join(F.broadcast(ranges), [*by, "column"]).where("value <= hi").withColumn("value", F.when(F.col("value") >= F.col("lo"), F.col("value")))
    counts = inside.groupBy(*key, "n", "p", "value").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*key).orderBy(F.col("value").asc_nulls_first())
    upto = counts.withColumn("upto", F.sum("c").over(order)).where("value is not null")
    place = F.col("p") * (F.col("n") - 1)
    first, second = F.floor(place), F.ceil(place)
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("value")))
    found = upto.groupBy(*key, "n", "p").agg(at(first).alias("a"), at(second).alias("b"))
    found = found.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (place - first))
    return found.groupBy(*by, "column", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q"))


def source_statistics(df: DataFrame, columns: list[str], medians: bool = True) -> DataFrame:
    """column, n, mean, sd (sample), median, zero_variance of the numeric columns, over values that are present.

    Moments in one aggregation, medians (null unless asked for) by quantiles; the result has a row for each column.
    """
    x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    aggregates = [a for k, v in enumerate(x) for a in (F.count(v).alias(f"n{k}"), F.avg(v).alias(f"m{k}"), F.stddev_samp(v).alias(f"s{k}"))]
    wide = df.agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n"), F.col(f"m{k}").alias("mean"), F.col(f"s{k}").alias("sd")) for k, c in enumerate(columns)])
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    if medians:
        middle = quantiles(df, columns, [0.5]).select("column", F.col("q")[0].alias("median"))
        out = out.join(F.broadcast(middle), "column", "left")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    return out.withColumn("zero_variance", F.coalesce(F.col("sd"), F.lit(0.0)) <= ZERO_SD)


def feature_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_missing, n_infinite, n_distinct, constant: one aggregation over the table."""
    x = {c: F.col(c).cast("double") for c in columns}
    aggregates = []
    for k, v in enumerate(x.values()):
        gone = v.isNull() | F.isnan(v)
        aggregates += [F.sum(gone.cast("long")).alias(f"a{k}"), F.sum((F.abs(v) == float("inf")).cast("long")).alias(f"b{k}"), F.min(F.when(~gone, v)).alias(f"lo{k}"), F.max(F.when(~gone, v)).alias(f"hi{k}")]
    wide = df.agg(*aggregates)
    rows = [F.struct(F.lit(c).alias("column"), F.coalesce(f"a{k}", F.lit(0)).alias("n_missing"), F.coalesce(f"b{k}", F.lit(0)).alias("n_infinite"), F.coalesce(F.col(f"lo{k}") == F.col(f"hi{k}"), F.lit(True)).alias("constant")) for k, c in enumerate(x)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows and n_duplicates (rows beyond the first of equal ones)."""
    each = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return each.agg(F.sum("__n").alias("n_rows"), F.sum(F.col("__n") - 1).alias("n_duplicates"))


def role_errors(df: DataFrame, roles: DataFrame) -> DataFrame:
    """column, problem: columns without a role, roles without a column, unknown roles, repeated roles."""
    spark = df.sparkSession
    have = spark.createDataFrame([(c,) for c in df.columns], "column string")
    out = have.join(roles, "column", "left_anti").select("column", F.lit("no role").alias("problem"))
    out = out.unionByName(roles.join(have, "column", "left_anti").select("column", F.lit("no such column").alias("problem")))
    out = out.unionByName(roles.where(~F.col("role").isin(*ROLES)).select("column", F.lit("unknown role").alias("problem")))
    return out.unionByName(roles.groupBy("column").count().where("count > 1").select("column", F.lit("repeated").alias("problem")))


def as_boolean(c: Column) -> Column:
    """Booleans from usual texts and numbers; null and '' stay null; anything else raises."""
    text = F.lower(F.trim(c.cast("string")))
    wrong = F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("boolean")).when(text.isin(*TRUE), True).when(text.isin(*FALSE), False).otherwise(wrong)


@dataclass
class Vocabulary:
    """The values of a source column as a written table: value, n, code. Kept values have codes from 0 in their order;
    infrequent ones share the code behind (rare, if there are any). hot: the commonest values, few enough to broadcast."""

    table: DataFrame
    fill: str
    kept: int
    rare: bool
    values: int

    @staticmethod
    def fit(df: DataFrame, column: str, min_frequency: float) -> Vocabulary | None:
        """Of the values that are present (None if there are none); missing ones count as the commonest."""
        counts = stored(df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")), "values")
        total, gone, values = counts.agg(F.sum("n"), F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.count("value")).first()
        if not values:
            return None
        fill = counts.where("value is not null").orderBy(F.desc("n"), "value").first()["value"]
        full = counts.where("value is not null").withColumn("n", F.when(F.col("value") == fill, F.col("n") + (gone or 0)).otherwise(F.col("n")))
        keep = F.col("n") >= min_frequency * total
        # numbered range by range: no task orders the whole vocabulary
        parts = full.where(keep).repartitionByRange("value").sortWithinPartitions("value").select("value", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
        parts = stored(parts, "kept-values")
        sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        first, kept = [], 0
        for p in sorted(sizes):
            first.append((p, kept))
            kept += sizes[p]
        spark = df.sparkSession
        offsets = spark.createDataFrame(first, "part int, first long")
        coded = parts.join(F.broadcast(offsets), "part").select("value", "n", (F.col("first") + F.col("at")).cast("int").alias("code"))
        rest = full.where(~keep).select("value", "n", F.lit(kept).alias("code"))
        table = stored(coded.unionByName(rest), "vocabulary")
        return Vocabulary(table, fill, kept, values > kept, values)

    def coded(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """df with the code of each row's value (missing: that of the fill; null: a value that the source did not have)."""
        value = F.coalesce(F.col(column).cast("string"), F.lit(self.fill))
        if self.values <= BROADCAST_VALUES:
            small = F.broadcast(self.table.select(F.col("value").alias("__value"), F.col("code").alias(out)))
            return df.withColumn("__of", value).join(small, F.col("__of") == F.col("__value"), "left").drop("__of", "__value")
        total = self.table.agg(F.sum("n")).first()[0]
        hot = self.table.where(F.col("n") >= HOT_SHARE * total).select(F.col("value").alias("__hot"), F.col("code").alias("__hot_code"))  # 1 / HOT_SHARE values at most
        some = df.withColumn("__of", value).join(F.broadcast(hot), F.col("__of") == F.col("__hot"), "left")
        # rows of hot values are done: they are spread over the tasks of the join by a key that no value has
        salt = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
        some = some.withColumn("__key", F.when(F.col("__hot").isNull(), F.col("__of")).otherwise(salt))
        cold = self.table.where(F.col("n") < HOT_SHARE * total).select(F.col("value").alias("__value"), F.col("code").alias("__cold_code"))
        return some.join(cold, F.col("__key") == F.col("__value"), "left").withColumn(out, F.coalesce("__hot_code", "__cold_code")).drop("__of", "__hot", "__hot_code", "__key", "__value", "__cold_code")


@dataclass
class Preprocessor:
    """Expressions fitted on source rows: imputation, scaling and encoding by role.

    numeric: (median, mean, population sd after imputation); categorical: (fill, kept categories, infrequent
    categories), or a vocabulary where there are many; ordinal: (order, mode, mean, sd of the codes); boolean: mode.
    """

    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    categorical: dict[str, tuple[str, list[str], list[str]] | Vocabulary] = field(default_factory=dict)
    ordinal: dict[str, tuple[list[str], str, float, float]] = field(default_factory=dict)
    boolean: dict[str, bool] = field(default_factory=dict)

    def _numeric(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c, (median, mean, sd) in self.numeric.items():
            x = F.col(c).cast("double")
            x = F.when(x.isNull() | F.isnan(x), F.lit(median)).when(F.abs(x) == float("inf"), F.raise_error(F.lit(f"infinite value in {c}")).cast("double")).otherwise(x)
            out[c] = (x - mean) / sd
        return out

    def _one_hot(self, c: str) -> dict[str, Column]:
        fill, kept, rare = self.categorical[c]
        x = F.coalesce(F.col(c).cast("string"), F.lit(fill))
        out = {f"{c}={v}": (x == v).cast("double") for v in kept}
        return out | ({f"{c}=infrequent": x.isin(*rare).cast("double")} if rare else {})

    def _rest(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c, (order, mode, mean, sd) in self.ordinal.items():
            x = F.coalesce(F.col(c).cast("string"), F.lit(mode))
            code = F.array_position(F.array(*[F.lit(v) for v in order]), x).cast("double") - 1
            out[c] = (code - mean) / sd
        for c, mode in self.boolean.items():
            out[c] = F.coalesce(as_boolean(F.col(c)), F.lit(mode)).cast("double")
        return out

    def expressions(self) -> dict[str, Column]:
        """Output columns in order: numeric, categorical, ordinal, boolean; ValueError if a vocabulary is a table (see sparse)."""
        many = [c for c, v in self.categorical.items() if isinstance(v, Vocabulary)]
        if many:
            raise ValueError(f"{', '.join(many)}: more than {LITERALS} categories have no expressions of their own")
        out = self._numeric()
        for c in self.categorical:
            out |= self._one_hot(c)
        return out | self._rest()

    def names(self) -> list[str]:
        """Names of the output columns, in order; those of a vocabulary are read from its table."""
        out = [*self.numeric]
        for c, v in self.categorical.items():
            if isinstance(v, Vocabulary):
                kept = v.table.where(F.col("code") < v.kept).orderBy("code").select("value").toLocalIterator()
                out += [f"{c}={r['value']}" for r in kept] + ([f"{c}=infrequent"] if v.rare else [])
            else:
                out += [*self._one_hot(c)]
        return out + [*self._rest()]

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep, features: the transformed row as an array of floats; a NaN raises."""
        x = F.array(*[e.cast("float") for e in self.expressions().values()])
        checked = F.when(F.exists(x, lambda v: F.isnan(v) | v.isNull()), F.raise_error(F.lit("missing value after preprocessing")).cast("array<float>")).otherwise(x)
        return df.select(*keep, checked.alias("features"))

    def sparse(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep, size, indices, values: the transformed row without its zeros, for any number of categories; a NaN raises.

        Columns with many categories are joined with their vocabularies, one column after the other."""
        one = lambda i, e: F.struct(F.lit(i).alias("i"), e.cast("float").alias("v"))
        entries, at = [], 0
        for e in self._numeric().values():
            entries.append(one(at, e))
            at += 1
        for k, (c, v) in enumerate(self.categorical.items()):
            if isinstance(v, Vocabulary):
                df = v.coded(df, c, f"__code_{k}")
                entries.append(F.struct((F.col(f"__code_{k}") + at).alias("i"), F.lit(1.0).cast("float").alias("v")))
                at += v.kept + v.rare
            else:
                for e in self._one_hot(c).values():
                    entries.append(one(at, e))
                    at += 1
        for e in self._rest().values():
            entries.append(one(at, e))
            at += 1
        cells = F.filter(F.array(*entries), lambda x: x["i"].isNotNull() & (x["v"].isNull() | (x["v"] != 0)))
        checked = F.when(F.exists(cells, lambda x: F.isnan(x["v"]) | x["v"].isNull()), F.raise_error(F.lit("missing value after preprocessing")).cast("array<struct<i:int,v:float>>")).otherwise(cells)
        return df.select(*keep, checked.alias("__cells")).select(*keep, F.lit(at).alias("size"), F.col("__cells.i").alias("indices"), F.col("__cells.v").alias("values"))

    def unseen(self, df: DataFrame) -> DataFrame:
        """column, n_unseen, n_values: values of the categorical columns that the source did not have."""
        few = {c: v for c, v in self.categorical.items() if not isinstance(v, Vocabulary)}
        parts = []
        if few:
            rows = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), (~F.col(c).cast("string").isin(*kept, *rare, fill)).alias("new")) for c, (fill, kept, rare) in few.items()]
            parts.append(df.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
        for c, v in self.categorical.items():
            if isinstance(v, Vocabulary):
                parts.append(v.coded(df.select(c), c, "__code").select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col("__code").isNull().alias("new")))
        cells = reduce(DataFrame.unionByName, parts)
        by_value = cells.groupBy("column", "value").agg(F.sum(F.coalesce(F.col("new").cast("long"), F.lit(0))).alias("n"))
        return by_value.groupBy("column").agg(F.sum("n").alias("n_unseen"), F.sum((F.col("n") > 0).cast("long")).alias("n_values"))


def fit_preprocessor(df: DataFrame, roles: dict[str, str], orders: dict[str, list[str]] | None = None, min_frequency: float = 0.01) -> Preprocessor:
    """Fit on df (source rows). Two aggregations for the numeric columns and one for each categorical vocabulary.

    A categorical column with more than LITERALS values gets a vocabulary. A numeric column without values gets median 0; a categorical one a fill of its own; a boolean one False.
    An ordinal column without an order is one-hot encoded.
    """
    p = Preprocessor()
    orders = orders or {}
    numeric = [c for c, r in roles.items() if r == "numeric"]
    if numeric:
        x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
        middle = {r["column"]: r["q"][0] for r in quantiles(df, numeric, [0.5]).collect()}
        medians = [middle.get(c, 0.0) for c in numeric]
        filled = {c: F.coalesce(x[c], F.lit(m)) for c, m in zip(numeric, medians, strict=True)}
        row = df.agg(*[a for c in numeric for a in (F.avg(filled[c]), F.stddev_pop(filled[c]))]).first()
        for k, c in enumerate(numeric):
            p.numeric[c] = (medians[k], row[2 * k] or 0.0, row[2 * k + 1] or 1.0)
    for c, role in roles.items():
        if role == "categorical" or role == "ordinal" and c not in orders:
            counts = df.groupBy(F.col(c).cast("string").alias("v")).count()
            listed = counts.limit(LITERALS + 2).collect()
            if len(listed) > LITERALS + 1:
                p.categorical[c] = Vocabulary.fit(df, c, min_frequency)
                continue
            size = {r["v"]: r["count"] for r in listed}
            gone, total = size.pop(None, 0), sum(r["count"] for r in listed)
            fill = min(size, key=lambda v: (-size[v], v)) if size else MISSING
            if size:
                size[fill] += gone
            kept = sorted(v for v, k in size.items() if k >= min_frequency * total)
            p.categorical[c] = (fill, kept, sorted(set(size) - set(kept)))
        elif role == "ordinal":
            order = orders[c]
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(1).collect()
            mode = counts[0]["v"] if counts else order[0]
            code = F.array_position(F.array(*[F.lit(v) for v in order]), F.coalesce(F.col(c).cast("string"), F.lit(mode))).cast("double") - 1
            mean, sd = df.agg(F.avg(code), F.stddev_pop(code)).first()
            p.ordinal[c] = (order, mode, mean or 0.0, sd or 1.0)
        elif role == "boolean":
            b = as_boolean(F.col(c))
            yes, no = df.agg(F.sum(b.cast("long")), F.sum((~b).cast("long"))).first()
            p.boolean[c] = (yes or 0) > (no or 0)
    return p
