"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate (its target share of the output over its share of the input). A
document's count is drawn by inverting the Poisson distribution at a uniform number hashed from seed and
id; the document is exploded by its count and all copies are shuffled by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: A rate above this is split into equal parts, each drawn on its own (sums of Poisson counts are Poisson).
PART = 16.0
#: Terms of the distribution kept for a part; beyond them less than 2^-53 is left at a rate of 16.
TERMS = 90
#: Sources are broadcast up to this many (about 0.8 kB each), else joined on salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the SHA-256 of the parts, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, power: float, total: int | None) -> DataFrame:
    """source, n, rate, parts, cdf: the mean repetitions of each source and its cumulative distribution.

    weights: target shares by source, normalised over the sources present; else shares follow n^power.
    A source without a weight gets rate 0. total: expected output rows (default: as many as the input).
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        keys = list(weights)
        found = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("source"))
        share = F.when(found > 0, F.element_at(F.array(*[F.lit(float(weights[k])) for k in keys]), found.cast("int"))).otherwise(0.0)
    counts = counts.withColumn("share", share)
    shares, rows = counts.agg(F.coalesce(F.sum("share"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rate = F.col("share") / F.lit(shares or 1.0) * F.lit(float(total or rows)) / F.col("n")
    rates = counts.select("source", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    each = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-each).alias("p"), F.array(F.exp(-each)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * each / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return rates.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["cdf"]))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, total: int | None = None, seed: int = 17, copy_col: str = "copy", key_col: str = "shuffle_key"
) -> DataFrame:
    """docs repeated to the target weights and shuffled; adds copy_col (1, 2, ...) and key_col, the global order.

    A null source is a source of its own; a null id is hashed as the word null, so rows without an id
    share one draw. Repeated rows draw alike. An empty table stays empty. If docs has columns named as
    the added ones, underscores are appended to the added names.
    """
    copy_col, key_col = free_name(docs, copy_col), free_name(docs, key_col)
    rates = source_rates(docs, source_col, weights, power, total)
    side = rates.select(F.struct("rate", "parts", "cdf").alias("r"), "source")
    r, s, salt = (free_name(docs, x) for x in ("rates", "mix_source", "salt"))
    side = side.withColumnsRenamed({"r": r, "source": s})
    if side.select(s).limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(side), F.col(source_col).eqNullSafe(F.col(s)))
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        side = side.withColumn(f"{salt}_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(side, F.col(source_col).eqNullSafe(F.col(s)) & (F.col(salt) == F.col(f"{salt}_"))).drop(salt, f"{salt}_")
    id_ = F.col(id_col)

    def drawn(part: Column) -> Column:
        u = hashed_uniform(F.lit(seed), id_, part)
        return F.size(F.filter(F.col(r)["cdf"], lambda c: c <= u))

    one = drawn(F.lit(1))
    more = F.aggregate(F.sequence(F.lit(1), F.col(r)["parts"]), F.lit(0), lambda acc, j: acc + drawn(j))
    count = F.when(F.col(r)["rate"] <= 0, 0).when(F.col(r)["parts"] == 1, one).otherwise(more)
    copies = joined.withColumn(copy_col, count).where(F.col(copy_col) > 0).drop(r, s)
    copies = copies.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(copy_col))))
    key = F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(id_.cast("string"), F.lit("null")), F.col(copy_col).cast("string")), 256), 1, 16)
    return copies.withColumn(key_col, key).repartition(key_col).sortWithinPartitions(key_col)
