"""Helpers shared by the corpus operators: tables, scratch tables, batches, bounded bit maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: Bytes of text that a vectorised kernel works on at once.
SLICE_BYTES = 1 << 21


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, so that extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls empty, and the offsets of its rows."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def bit_map(keys: DataFrame, key: str, most: int) -> np.ndarray:
    """A bit map over a long column of a stored table, built by a distributed bit_or.

    It has 16 bits or more for each key up to 2**most bits, so that is the most the driver gets whatever the number of keys;
    with more keys it lets more rows through to the exact step after it.
    """
    bits = int(np.clip(np.ceil(np.log2(16 * (keys.count() + 1))), 14, most))
    k = F.col(key)
    slot = k.bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        keys.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(words.column("w"))] = np.asarray(words.column("b"))
    return out.view(np.uint64)


def in_bit_map(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be among those of ``bit_map``."""
    slot = keys & np.uint64(len(words) * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def maybe_in(spark: SparkSession, words: np.ndarray, key: Column) -> Column:
    """The same test as a column: the map is the result of a scalar subquery, looked up by place."""
    bits = spark.createDataFrame(pa.table({"bits": pa.array([words.view(np.int64)], pa.list_(pa.int64()))})).scalar()
    slot = key.bitwiseAND(F.lit(len(words) * 64 - 1))
    word = F.get(bits, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


#: A key with more than one of this many parts of all rows is split in joins.
HOT_PARTS = 1000
#: Rows of a key that need not be split.
HOT_ROWS = 10_000


def join_split(rows: DataFrame, keyed: DataFrame, key: str, size: str, *by: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined (inner or left) with keyed, which has a row for each key and in ``size`` how many of rows have that key.

    A key with more than 1/HOT_PARTS of the rows (``total``, counted if it is not given) is split by a hash of the columns ``by``
    in parts of about that size. At most HOT_PARTS keys are that large, so the list of them, which is broadcast, is bounded
    whatever the input.
    """
    total = (keyed.agg(F.sum(size)).first()[0] or 0) if total is None else total
    if total <= HOT_ROWS:
        return rows.join(keyed.drop(size), key, how)
    share = max(total // HOT_PARTS, HOT_ROWS)
    parts = F.ceil(F.col(size) / share).cast("int")
    hot = F.broadcast(keyed.where(F.col(size) > share).select(key, parts.alias("_parts")))
    left = rows.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), "_parts").cast("int"), F.lit(0))).drop("_parts")
    copies = F.when(F.col(size) > share, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    return left.join(keyed.withColumn("_part", F.explode(copies)).drop(size), [key, "_part"], how).drop("_part")


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows, stored, with their place in this order: ``_stretch`` (of a range of the order) and ``_at`` (place in the part).

    A key of the order that holds many rows is cut as well, for the number of the row is the last one. Rows that are equal in
    ``order`` may take any order among themselves, so they have to be interchangeable for the caller. ``df`` is computed twice (once
    for the ranges), so it should be a stored table or near to one.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    by = [*order, F.col("_row")]
    ordered = numbered.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    place = F.col("_row")
    parts = ordered.withColumn("_stretch", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    return stored(parts.drop("_row"), name)


def running(rows: DataFrame, value: Column, name: str, *group: str) -> DataFrame:
    """rows of ``in_order`` with the sum of ``value`` over all earlier rows of their group as column ``name``.

    Sums of the parts are added up first, so a task handles a part of a group, and a group has a row for each part only.
    """
    keys = [*group, "_stretch"]
    valued = rows.withColumn("_value", value)
    sums = valued.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    upto = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias(f"_{k}_") for k in keys], F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = valued.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys]
    out = own.join(base, same).withColumn(name, F.col("_base") + F.col("_own"))
    return out.drop("_value", "_own", "_base", *[f"_{k}_" for k in keys])
