"""Libraries as streams: row indices from a streaming source go through the same projection (no state is kept)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pool import Pool
from ..plans.runner import Run, _select


def stream_library(pool: Pool, indices: DataFrame, index_col: str = "value", seed: int = 0, report_design_cards: bool = False) -> DataFrame:
    """name and seq (and provenance) for each index of a streaming or batch DataFrame."""
    run = Run(indices.select(F.col(index_col).cast("long").alias("id")), pool, (), seed)
    return _select(run, pool, pool.num_states - 1, report_design_cards, (), "all", "type").withColumnRenamed("_row", "index")


def rate_library(spark: SparkSession, pool: Pool, rows_per_batch: int, start: int = 0, seed: int = 0) -> DataFrame:
    """An endless library, so many rows in each micro-batch; indices go on from ``start``."""
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    return stream_library(pool, source.withColumn("value", F.col("value") + start), seed=seed)
