"""Exact deduplication with a log-structured merge index over text digests.

1. Every text is normalised (white space deleted) and digested once; the small table of digests is stored.
2. Tasks fill memtables with (digest, doc_id, length). A full memtable is sorted, equal digests become one entry with its
   best row and count, and it is flushed as a run: one block for each digest shard, each with a Bloom filter.
3. Compaction brings the blocks of a shard together and merges them into one level. A run's digests that the level's
   filter does not know are new; the others are looked up, and equal digests keep the best row (the longest text, then
   the smallest identifier) and the sum of the counts. Shards are as many as the number of documents needs, and each run
   has one entry for a digest, so a group of copies of any size puts few entries in a shard.
4. Rows whose digest has several members are hits. Their normalised bytes are compared with those of the kept row; rows
   that differ (a digest collision) are grouped again by the bytes themselves.

Defined cases: null text counts as empty, and empty texts are copies of one another; ties in length go to the smallest
doc_id, null doc_ids last; of repeated rows (same doc_id and text) all count in group_size and the first read is kept;
other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_map, in_bit_map, join_split, maybe_in, only, slices, stored

WHITE = b" \t\n\x0b\x0c\r"
MEMTABLE = 200_000
SHARD_ROWS = 250_000
FILTER_BITS = 30
GONE_BITS = 26
NO_ID = np.iinfo(np.int64).max


def tags(texts: list[bytes]) -> pa.Array:
    """What Spark's xxhash64 gives for these strings."""
    return pa.array(np.array([xxhash.xxh64_intdigest(b, 42) for b in texts], np.uint64).view(np.int64))


def digests(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_chars, sha (of the normalised text), tag (xxhash64 of the text as it is) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            text = batch.column("text").fill_null("")
            raw = text.cast(pa.binary()).to_pylist()
            shas = [hashlib.sha256(b.translate(None, WHITE)).digest() for b in raw]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(shas))), batch.column("doc_id").cast(pa.int64()), pc.utf8_length(text).cast(pa.int64()), pa.array(shas, pa.binary()), tags(raw)],
                names=["row", "doc_id", "n_chars", "sha", "tag"],
            )
            row += len(shas)

    return only(docs, "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_chars long, sha binary, tag long")


class Bloom:
    """A filter of fixed size over 128-bit keys (two uint64), which can be joined with others of its size."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.words = np.zeros(1 << max(0, bits - 3), np.uint8) if data is None else np.frombuffer(data, np.uint8).copy()

    def _slots(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        for i in range(4):
            yield ((keys[:, 0] + np.uint64(i) * (keys[:, 1] | np.uint64(1))) >> np.uint64(7)) & mask

    def add(self, keys: np.ndarray) -> None:
        for s in self._slots(keys):
            np.bitwise_or.at(self.words, (s >> np.uint64(3)).astype(np.int64), (1 << (s & np.uint64(7))).astype(np.uint8))

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for s in self._slots(keys):
            out &= (self.words[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def join(self, other: Bloom) -> None:
        self.words |= other.words


def merge_entries(keys: np.ndarray, ids: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """One sorted entry for each key: the longest text, then the smallest identifier; counts added."""
    order = np.lexsort((ids, -chars, keys[:, 1], keys[:, 0]))
    keys, ids, chars, counts = keys[order], ids[order], chars[order], counts[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return keys[at], ids[at], chars[at], np.add.reduceat(counts, at) if len(at) else counts


def key_of(shas: pa.Array, key_bytes: int) -> np.ndarray:
    """The first 16 bytes of each digest as two uint64; fewer bytes (for tests of collisions) leave the rest 0."""
    raw = np.frombuffer(b"".join(x[:key_bytes].ljust(16, b"\0") for x in shas.to_pylist()), ">u8").reshape(-1, 2)
    return raw.astype(np.uint64)


RUN = "shard int, run long, filter_bits int, filter binary, keys binary, ids array<long>, chars array<long>, counts array<long>"


def flushed_runs(table: DataFrame, shard_bits: int, filter_bits: int, key_bytes: int, memtable: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([h[0] for h in held])
            ids, chars = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            keys, ids, chars, counts = merge_entries(keys, ids, chars, np.ones(len(ids), np.int64))
            shard = (keys[:, 0] >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(ids), np.int64)
            at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            blocks = []
            for a, b in zip(at, [*at[1:], len(ids)]):
                bloom = Bloom(filter_bits)
                bloom.add(keys[a:b])
                blocks.append((int(shard[a]), (part << 20) + number, filter_bits, bloom.words.tobytes(), keys[a:b].tobytes(), ids[a:b], chars[a:b], counts[a:b]))
            cols = list(zip(*blocks))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "run", "filter_bits", "filter", "keys", "ids", "chars", "counts"])

        for batch in batches:
            held.append((key_of(batch.column("sha"), key_bytes), np.asarray(batch.column("doc_id").fill_null(NO_ID)), np.asarray(batch.column("n_chars"))))
            rows += batch.num_rows
            if rows >= memtable:
                yield flush()
                number, held, rows = number + 1, [], 0
        if rows:
            yield flush()

    return table.select("sha", "doc_id", "n_chars").mapInArrow(run, RUN)


def compacted(runs: DataFrame) -> DataFrame:
    """key binary, keep_id, keep_chars, size of every digest key with several members."""

    def merge(table: pa.Table) -> pa.Table:
        level, bloom = None, None
        for r in sorted(table.to_pylist(), key=lambda r: r["run"]):
            entries = (np.frombuffer(r["keys"], np.uint64).reshape(-1, 2), *(np.array(r[k], np.int64) for k in ("ids", "chars", "counts")))
            own = Bloom(r["filter_bits"], r["filter"])
            if level is None:
                level, bloom = entries, own
                continue
            hit = bloom.may_have(entries[0])  # the others are new for certain
            bloom.join(own)
            old = own.may_have(level[0])
            met = merge_entries(*(np.concatenate([x[old], y[hit]]) for x, y in zip(level, entries)))
            level = tuple(np.concatenate([x[~old], y[~hit], z]) for x, y, z in zip(level, entries, met))
        several = level[3] > 1
        keys = level[0][several].astype(">u8").tobytes()
        return pa.table(
            {
                "key": pa.array([keys[i : i + 16] for i in range(0, len(keys), 16)], pa.binary()),
                "keep_id": pa.array(level[1][several], mask=level[1][several] == NO_ID),
                "keep_chars": pa.array(level[2][several]),
                "size": pa.array(level[3][several]),
            }
        )

    return runs.groupBy("shard").applyInArrow(merge, "key binary, keep_id long, keep_chars long, size long")


def exact_dedup(docs: DataFrame, key_bytes: int = 16, memtable: int = MEMTABLE) -> DataFrame:
    """row, doc_id, sha, tag, keep_id, group_size, kept of each row of docs."""
    table = stored(digests(docs), "digests")
    rows = table.count()
    shard_bits = min(24, max(0, int(np.ceil(np.log2(max(1, rows) / SHARD_ROWS)))) + (4 if rows > 10_000 else 0))
    filter_bits = int(np.clip(np.ceil(np.log2(10 * max(1, rows) / (1 << shard_bits))), 10, 22))
    groups = stored(compacted(flushed_runs(table, shard_bits, filter_bits, key_bytes, memtable)), "groups")
    key = F.expr(f"rpad(substring(sha, 1, {key_bytes}), 16, X'00')")
    table = table.withColumn("key", key)

    words = bit_map(groups.select(_long("key").alias("k")), "k", FILTER_BITS)
    held = docs.sparkSession.sparkContext.broadcast(words)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").fill_null("")
                raw = texts.cast(pa.binary()).to_pylist()
                norm = [b.translate(None, WHITE) for b in raw]
                shas = pa.array([hashlib.sha256(b).digest() for b in norm], pa.binary())
                keys = key_of(shas, key_bytes)
                may = pa.array(in_bit_map(held.value, keys[:, 0]))
                out = pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(norm))), part.column("doc_id").cast(pa.int64()), pc.utf8_length(texts).cast(pa.int64()), shas, pa.array(norm, pa.binary()), tags(raw)],
                    names=["row", "doc_id", "n_chars", "sha", "norm", "tag"],
                )
                row += len(norm)
                yield out.filter(may)

    found = stored(only(docs, "doc_id", "text").mapInArrow(hits, "row long, doc_id long, n_chars long, sha binary, norm binary, tag long"), "hits").withColumn("key", key)
    # rows of one digest are many where a text has many copies, so joins on it split such keys
    keepers = (
        found.join(groups, (found["key"] == groups["key"]) & found["doc_id"].eqNullSafe(groups["keep_id"]) & (found["n_chars"] == groups["keep_chars"]))
        .groupBy(found["key"].alias("key"), groups["size"].alias("size"))
        .agg(F.min_by("norm", "row").alias("kept_norm"))
    )
    verified = stored(
        join_split(found, stored(keepers, "keepers"), "key", "size", "row").select("row", "doc_id", "n_chars", "sha", "tag", F.struct("key", F.when(F.col("norm") != F.col("kept_norm"), F.col("norm")).alias("other")).alias("text")),
        "verified",
    )
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    final = stored(verified.groupBy("text").agg(F.count(F.lit(1)).alias("group_size"), F.count(F.lit(1)).alias("size"), F.min(best).alias("best")), "final")
    copies = join_split(verified, final, "text", "size", "row").select(
        "row", "doc_id", "sha", "tag", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept")
    )
    single = table.join(groups.select("key"), "key", "left_anti").select("row", "doc_id", "sha", "tag", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return single.unionByName(copies)


def _long(column: str):
    """The first 8 bytes of a binary as a long."""
    return F.expr(f"cast(conv(hex(substring({column}, 1, 8)), 16, -10) as long)")


def dedup_digests(docs: DataFrame, **options) -> DataFrame:
    return exact_dedup(docs, **options).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns; one row of each group, also of repeated rows."""
    decided = exact_dedup(docs, **options).where(~F.col("kept")).select("doc_id", "tag", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("same_id"))
    gone = stored(decided, "gone")
    return without_rows(docs, gone.where("not same_id"), gone.where("same_id"))


def without_rows(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose doc_id and tag (xxhash64 of the text) are in gone; of those in repeated one row stays.

    Rows that a bit map of bounded size shows not to be in gone (a stored table) stay where they are; only the others are joined.
    """
    tagged = docs.withColumn("_tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    match = tagged["doc_id"].eqNullSafe(F.col("_id")) & (tagged["_tag"] == F.col("_of"))
    named = lambda x: x.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_of")).distinct()
    words = bit_map(gone.select(F.xxhash64("doc_id", "tag").alias("k")), "k", GONE_BITS)
    maybe = maybe_in(docs.sparkSession, words, F.xxhash64(F.col("doc_id").cast("long"), "_tag"))
    left = tagged.where(~maybe).unionByName(tagged.where(maybe).join(named(gone), match, "left_anti"))
    if repeated is not None and not repeated.isEmpty():
        marked = left.join(named(repeated), match, "left")
        order = F.row_number().over(Window.partitionBy("doc_id", "_tag").orderBy(F.lit(0)))
        left = marked.withColumn("_n", order).where("_of is null or _n = 1").drop("_n", "_id", "_of")
    return left.drop("_tag")
