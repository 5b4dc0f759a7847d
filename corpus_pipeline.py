"""From raw documents to packed training sequences, in five stages.

Every stage works on all that its predecessor kept, and all but the last return
the columns of ``documents``.  A stage's result is written as Parquet and read
again before the next one begins, so a lost executor costs at most one stage.
An empty table stays empty through all stages, and so does what a stage leaves
of it; rows with null ids are documents like any other.  Columns beyond those of
``documents`` go along whatever their names, and texts are worked on in parts, so
a stage's memory does not grow with the longest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import decontaminate, langid, packing, quality, simhash
from strataloom.llm._common import small_batches, stored, table


#: Pieces of text whose ids a worker remembers: it goes on to other stages with them.
REMEMBERED = 50_000
#: Bytes of an Arrow batch, less than the operators have alone: all stages share the executors.
BATCH_BYTES = 1 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoff stay.

    Null, empty and short texts go; repeated rows share their fate.
    """
    small_batches(spark, BATCH_BYTES)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay.

    Texts without a letter go, null and empty ones too; without any label in
    ``lang`` all others stay; repeated rows share their fate.
    """
    small_batches(spark, BATCH_BYTES)
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    All empty texts are one group; of rows that repeat an id and a fingerprint
    one stays.
    """
    small_batches(spark, BATCH_BYTES)
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word window of the benchmark stay.

    Null and empty texts have none; repeated rows share their fate.
    """
    small_batches(spark, BATCH_BYTES)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null or empty text is its end id alone; repeated rows are packed as often
    as they occur.
    """
    small_batches(spark, BATCH_BYTES)
    return packing.packed_documents(docs, REMEMBERED)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: Binomial bounds, n-gram models, XXH64 and tokenizers are not SQL; the tests
#: hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
