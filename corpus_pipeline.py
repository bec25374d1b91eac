"""The corpus pipeline: toxic documents go, exact and near copies go, sources are mixed, texts are encoded.

Each stage takes the documents that the stage before it kept, all of them, and is written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import toxicity
from tidemark.llm.common import table, written
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.jaccard_join import keep_one_per_class
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pieces import sample_segmentations
from tidemark.llm.queries import PIECES


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is under one half.

    Null and empty texts score as empty ones; repeated rows are judged alike. Columns stay as they are, whatever
    their names; an empty table, or labels of one class only, reject nothing.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id.

    Null and empty texts are equal; null ids count as larger than any other, and of rows that repeat an id the
    first read stays. Columns stay as they are; an empty table stays empty.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id.

    Null, empty and blank texts have no shingles and all stay; null ids count as larger than any other, and a
    repeated id over different texts is no link. Columns stay as they are; an empty table stays empty.
    """
    return keep_one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards shares by the square root of each source's size, in shuffled order.

    A null source is a source of its own; a null id is hashed as the word null; repeated rows draw alike. Columns
    stay as they are; an empty table stays empty.
    """
    return mix_sources(docs, power=0.5, seed=17).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two different sampled segmentations of each row; copies of a document, told apart by their number, draw apart.

    Rows of one id and text are numbered, so samples depend on ids, texts and how often they stand in docs, not on
    partitions. Null and empty texts are the one segmentation of the leading space; other columns are left out; an
    empty table gives an empty result.
    """
    return sample_segmentations(docs, PIECES, k=2, block=1 << 18, kept=1 << 19, apart=True)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("pieces", encode)]

#: The model of the first stage and the sampled pieces of the last are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
