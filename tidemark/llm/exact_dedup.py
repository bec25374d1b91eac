"""Exact deduplication by a tree merge of sorted digest runs.

Each input partition is a run of digests. In every round FAN_IN neighbouring runs are merged into one,
keeping for each digest the smallest identifier and the number of rows; the last round leaves one run,
range-free and spread by digest. Answers go down the same way: merged run -> first-level run -> row, so
that no task ever gets more rows of one digest than an input partition or the number of runs holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_name, numbered, scratch, small_side, with_seq, written

FAN_IN = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(rows: DataFrame) -> DataFrame:
    """id, seq, sha (32 bytes), check (an independent fingerprint: length and 64-bit hash) of each row of (id, seq, text)."""
    return (
        rows.select("id", "seq", normalised(F.col("text")).alias("norm"))
        .select("id", "seq", F.unhex(F.sha2("norm", 256)).alias("sha"), F.struct(F.length("norm").alias("n"), F.xxhash64("norm").alias("h")).alias("check"))
    )


def merge_runs(runs: DataFrame) -> DataFrame:
    """One round's merge: equal digests whose fingerprints agree become one entry with the smallest identifier."""
    return runs.groupBy("run", "sha", "check").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def tree_groups(rows: DataFrame) -> DataFrame:
    """One row per row of (id, seq, sha, check): id, seq, sha, keep_id, keep_seq, group_size, kept.

    Rows with equal sha and check form a group; its row with the smallest id stays (null last, ties by
    seq). rows is read more than once and should be a written table.
    """
    first = F.struct(F.col("id").isNull().alias("none"), "id", "seq").alias("first")
    base = rows.select(F.shiftright("seq", 33).alias("run"), "sha", "check", "id", "seq")
    leaves = merge_runs(base.select("run", "sha", "check", first, F.lit(1).cast("long").alias("n")))
    runs = (base.agg(F.max("run")).first()[0] or 0) + 1
    top = leaves
    while runs > 1:
        top = merge_runs(top.withColumn("run", F.floor(F.col("run") / FAN_IN)))
        runs = -(-runs // FAN_IN)
    many = top.where("n > 1").select("sha", "check", F.col("first").alias("keep"), F.col("n").alias("size"))
    answers = leaves.select("run", "sha", "check").join(many, ["sha", "check"])
    return base.join(answers, ["run", "sha", "check"], "left").select(
        "id", "seq", "sha",
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("keep.seq", "seq").alias("keep_seq"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.seq") == F.col("seq"), F.lit(True)).alias("kept"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, seq, sha (hex), keep_id, keep_seq, group_size, kept.

    Texts are equal when identical after each run of white space is replaced by one space; null counts
    as empty. The row with the smallest id stays (a null id counts as larger than any other; among
    repeated ids the first row read). An empty table gives an empty result; other columns are ignored.
    """
    rows = with_seq(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "seq")
    return tree_groups(written(digests(rows), "digests")).withColumn("sha", F.lower(F.hex("sha")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text a kept row has; all columns stay as they are.

    docs is written once with its row numbers, so that a shuffled or recomputed input can't number them anew.
    """
    seq = free_name(docs, "seq")
    rows = numbered(docs, seq)
    with scratch(docs.sparkSession):
        marked = digests(rows.select(F.col(id_col).alias("id"), F.col(seq).alias("seq"), F.col(text_col).alias("text")))
        gone = written(tree_groups(written(marked, "digests")).where("not kept").select(F.col("seq").alias(seq)), "copies", keep=True)
    return rows.join(small_side(gone), seq, "left_anti").drop(seq)
