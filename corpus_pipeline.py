"""The corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of ``documents``. Each stage judges whole texts of any length and every row: a null or
empty text has no letter and goes with the first stage; of repeated rows one stays (the second stage); of ties the
smallest doc_id stays; an empty table gives an empty result; further columns, whatever their names, are carried.

Executors and their Python workers live through all stages: so texts go to Python in batches of BATCH_ROWS rows, which
bounds what both sides of the pipe hold of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisark.llm import bpe, decontamination, exact_dedup, language_id, near_dedup
from palisark.session import written


#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 500


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unclear: null, empty or without letters, or with encodings of nearly one size."""
    _small_batches(spark)
    return language_id.accepted(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, up to white space, the one with the smallest doc_id stays."""
    _small_batches(spark)
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (shingles of five words, similarity 0.8) the smallest doc_id stays."""
    _small_batches(spark)
    return near_dedup.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or re-parameterised."""
    _small_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document that is left."""
    _small_batches(spark)
    return bpe.digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("BPE", encode_tokens),
]

#: No SQL states compression sizes, MinHash components or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
