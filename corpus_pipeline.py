"""From raw documents to token ids: toxicity, exact and near deduplication, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. ``run``
writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, cgk, lsm_dedup, near, toxicity
from seqloom.llm.common import read_table, stored


#: Rows in a batch between the JVM and Python. Rows are whole documents here, and each core holds several batches at a time.
BATCH_ROWS = 1000
_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage):
    """The stage with small batches. Its plan runs when its rows are written, so the setting stays; ``run`` puts it back."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_batch)) <= BATCH_ROWS:
            spark.conf.set(_batch, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsm_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cgk.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, n_bytes and digest of what the ids decode to."""
    rows = bpe.bpe_encode(docs)
    decoded = F.encode("decoded", "UTF-8")
    return rows.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.octet_length("decoded").alias("n_bytes"), F.sha2(decoded, 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", in_small_batches(without_toxic)),
    ("exact dedup", in_small_batches(without_copies)),
    ("near dedup", in_small_batches(without_near_copies)),
    ("decontamination", in_small_batches(without_benchmark)),
    ("byte-level BPE", in_small_batches(as_tokens)),
]

#: SQL has no classifier, XXH64 or BPE; tests/llm compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = spark.conf.get(_batch)
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    finally:
        spark.conf.set(_batch, before)
    return docs
