"""A corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Every stage reads the table that the one before wrote to the shared folder, so a lost
executor costs the tasks of one stage. The mixing stage writes its rows in the order of the
mixture; packing reads that order back from file names and row numbers.
"""

from pyspark.sql import DataFrame, SparkSession

from terseframe.llm import golay_dedup, line_windows, pfair_mix, quality_crf, var_pack
from terseframe.llm.common import short_batches
from terseframe.llm.queries import TARGETS
from terseframe.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes for good."""
    short_batches(spark)
    return quality_crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines cut; documents with nothing left go."""
    short_batches(spark)
    return line_windows.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    short_batches(spark)
    return golay_dedup.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves the sources to TARGETS."""
    return pfair_mix.in_order(docs, TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of neighbouring documents of the mixture."""
    run, place = var_pack.stored_order(docs)
    return var_pack.pack(docs, run=run, place=place)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None  # a fitted classifier, fuzzy hashing and packing have no SQL form; tests hold most stage operators to brute force and run the whole


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
