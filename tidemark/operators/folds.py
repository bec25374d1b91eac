"""Reproducible source/target splits as long tables (fold, side, row_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw

SEED = 20260907


def shuffled_rank(df: DataFrame, seed: int, purpose: str, row_id: str = "row_id", by: list[str] | None = None) -> DataFrame:
    """Adds position (from 0) in a seeded order of the rows, within the groups of `by`.

    Without groups, positions come from a count of rows in each of many equal ranges of the draw and a
    rank inside the range, so that no task sorts the whole table.
    """
    drawn = df.withColumn("__draw", draw(seed, purpose, row_id))
    return ranked(drawn.withColumn("__range", F.shiftright("__draw", 44)), ["__draw", row_id], by).drop("__draw", "__range")


def ranked(df: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """Adds position (from 0) in the order of `order`, within the groups of `by`; df has __range, a coarse key whose
    order agrees with it.

    The counts of a group's ranges (at most 65,536 of them) are summed in one task, the rows ranked in many.
    """
    by = by or []
    sizes = df.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.sum("__n").over(upto)).select(*by, "__range", F.coalesce("__before", F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)) - 1
    side = before if by else F.broadcast(before)
    return df.withColumn("__inside", inside).join(side, [*by, "__range"]).withColumn("position", (F.col("__before") + F.col("__inside")).cast("long")).drop("__before", "__inside")


def kfold(rows: DataFrame, folds: int = 5, seed: int = SEED, row_id: str = "row_id", purpose: str = "outer") -> DataFrame:
    """fold, side, row_id: each fold's target rows are every folds-th of a seeded order, all others its source."""
    of = shuffled_rank(rows.select(row_id), seed, purpose, row_id).select(row_id, (F.col("position") % folds).cast("int").alias("__of"))
    each = of.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return each.select("fold", F.when(F.col("__of") == F.col("fold"), "target").otherwise("source").alias("side"), row_id)


def inner_kfold(split: DataFrame, folds: int = 3, seed: int = SEED, row_id: str = "row_id") -> DataFrame:
    """fold, inner_fold, side (train or validation), row_id over the source rows of each outer fold."""
    source = split.where("side = 'source'").select("fold", row_id, draw(seed, "inner", F.concat_ws("-", "fold", row_id)).alias("__draw"))
    placed = ranked(source.withColumn("__range", F.shiftright("__draw", 44)), ["__draw", row_id], ["fold"])
    of = placed.withColumn("__of", (F.col("position") % folds).cast("int"))
    each = of.withColumn("inner_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return each.select("fold", "inner_fold", F.when(F.col("__of") == F.col("inner_fold"), "validation").otherwise("train").alias("side"), row_id)


def group_kfold(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """group, fold: groups in order of size, each to the fold with the fewest rows so far.

    The counts of the groups are what the driver sees; it refuses more than a million groups.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.limit(1_000_001).collect()
    if len(listed) > 1_000_000:
        raise ValueError("more than a million groups: split them by a hash of the group instead")
    load = [0] * folds
    out = []
    for r in sorted(listed, key=lambda r: (-r["n"], str(r[group]))):
        k = min(range(folds), key=lambda i: (load[i], i))
        load[k] += r["n"]
        out.append((r[group], k, r["n"]))
    kind = rows.schema[group].dataType.simpleString()
    return rows.sparkSession.createDataFrame(out, f"`{group}` {kind}, fold int, n long")


def temporal_folds(rows: DataFrame, time: str, folds: int = 5, row_id: str = "row_id") -> DataFrame:
    """fold, side, row_id: expanding windows in time order; equal times never stand on both sides.

    The rows are cut at multiples of n / (folds + 1). A cut moves back to the first row of its time, so
    tied rows go to the target; a fold whose source is empty has no rows.
    """
    sizes = rows.groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    year = F.date_trunc("month", F.col(time))
    months = sizes.groupBy(year.alias("__m")).agg(F.sum("n").alias("__k"))
    months = months.withColumn("__base", F.sum("__k").over(Window.orderBy("__m")) - F.col("__k")).select("__m", "__base")
    within = F.sum("n").over(Window.partitionBy("__m").orderBy(time)) - F.col("n")
    starts = sizes.withColumn("__m", year).withColumn("__in", within).join(F.broadcast(months), "__m").select(time, (F.col("__base") + F.col("__in")).alias("first"), "n")
    n = rows.count()
    block = n // (folds + 1)
    cuts = [(k, (k + 1) * block, n if k == folds - 1 else (k + 2) * block) for k in range(folds)]
    cut = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi")) for k, a, b in cuts])
    each = rows.select(time, row_id).join(starts, time).select(row_id, "first", F.col("first").alias("__first"), (F.col("first") + F.col("n")).alias("__end"), F.explode(cut).alias("c"))
    side = F.when(F.col("__end") <= F.col("c.lo"), "source").when(F.col("__end") <= F.col("c.hi"), "target")
    # a time that straddles the source's cut belongs to the target, one that straddles the target's end to a later fold
    return each.withColumn("side", side).where("side is not null").select(F.col("c.fold").alias("fold"), "side", row_id)


def leave_one_domain_out(rows: DataFrame, domain: str, row_id: str = "row_id", candidates: list | None = None, folds: int = 5, seed: int = SEED) -> DataFrame:
    """domain, fold, side, row_id: each candidate domain is the target; the others are source but for one fold of them."""
    of = rows.select(row_id, domain)
    names = candidates or [r[0] for r in of.select(domain).distinct().orderBy(domain).limit(1000).collect()]
    each = of.withColumn("__target", F.explode(F.array(*[F.lit(x) for x in names])))
    hashed = (draw(seed, "domain", F.concat_ws("-", "__target", row_id)) % folds).cast("int")
    each = each.withColumn("__of", hashed).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    side = F.when(F.col(domain) == F.col("__target"), "target").when(F.col("__of") != F.col("fold"), "source")
    return each.withColumn("side", side).where("side is not null").select(F.col("__target").alias("domain"), "fold", "side", row_id)


def fixed_target(source: DataFrame, target: DataFrame, folds: int = 5, seed: int = SEED, row_id: str = "row_id") -> DataFrame:
    """fold, side, row_id: each fold's source leaves out one part of the source rows; the target is always whole."""
    kept = kfold(source, folds, seed, row_id, "resample").where("side = 'source'")
    whole = target.select(row_id).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return kept.unionByName(whole.select("fold", F.lit("target").alias("side"), row_id))
