"""Importance resampling towards a target distribution: hashed bags of words and pairs, exact bucket totals, a Gumbel draw.

A feature is a word, or with ``pairs`` also two consecutive words joined by a space; its bucket is the CRC-32 of its UTF-8 bytes
modulo ``BUCKETS``. A bucket's gain is the log ratio of its share in the target texts to its share in all documents, both
smoothed by one; a document weighs the mean gain of its features. Weights with Gumbel noise from a hash of the doc_id rank the
documents; the highest are drawn.

Head-tail vocabulary: one pass over all texts finds the frequent words (and pairs). Their CRC states (and the buckets of the
pairs) go to all tasks, at most ``HEAD`` words of at most ``HEAD_BYTES`` bytes and ``HEAD`` pairs, whatever the corpus. A word outside
gets its CRC directly, a pair outside continues the state of its first word. Which words are in the head changes no result. The
second pass writes the buckets of each document with their counts; exact totals and weights are taken from these.

Defined cases: null and empty texts have no features and weight 0; null doc_ids draw one number; equal doc_ids are in order of
score, then of the number of features, and rows equal in all are interchangeable; texts and words of any length are taken whole;
an empty target gives gains of the smoothing alone; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, only, running, slices, stored, text_bytes
from .words import LOWER, spans

BUCKETS = 10_000
HEAD = 20_000
HEAD_BYTES = 64
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes that are not in words, after lower-casing: all of ASCII but digits and letters.
NOT_WORD = np.ones(256, bool)
NOT_WORD[128:] = False
NOT_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column as one binary array, and for each row (and the end) the number of words before it."""
    buf, off = text_bytes(column)
    buf = LOWER[buf]
    starts, ends, first = spans(buf, off, NOT_WORD)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    data = np.ascontiguousarray(buf[~NOT_WORD[buf]])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), first


def pair_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Which words have a next word in the same row."""
    on = np.ones(n, bool)
    on[first[1:][first[1:] > first[:-1]] - 1] = False
    return np.flatnonzero(on)


class Head:
    """The frequent words with their CRC states, and the frequent pairs with their buckets."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        self.words, self.buckets = pa.array(words, pa.large_binary()), buckets
        self.states = np.array([zlib.crc32(w) for w in words], np.int64)
        place = {w: i for i, w in enumerate(words)}
        known = sorted((place[a] * HEAD + place[b], zlib.crc32(a + b" " + b) % buckets) for a, b in pairs if a in place and b in place)
        self.pairs, self.pair_buckets = (np.array([x[k] for x in known], np.int64) for k in (0, 1))

    def word_states(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The CRC of each distinct word, and its place in the head or -1."""
        at = np.asarray(pc.index_in(distinct, value_set=self.words).fill_null(-1), dtype=np.int64)
        out = self.states[at] if len(self.states) else np.zeros(len(at), np.int64)
        tail = np.flatnonzero(at < 0)
        out[tail] = [zlib.crc32(w.as_buffer()) for w in distinct.take(pa.array(tail))]
        return out, at

    def pair_buckets_of(self, distinct: pa.Array, states: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The buckets of pairs, given by the places of their words among the distinct ones."""
        n = max(len(distinct), 1)
        pairs, back = np.unique(one * n + two, return_inverse=True)
        a, b = pairs // n, pairs % n
        out = np.empty(len(pairs), np.int64)
        keys = np.where((at[a] >= 0) & (at[b] >= 0), at[a] * HEAD + at[b], -1) if len(pairs) else pairs
        spot = np.minimum(np.searchsorted(self.pairs, keys), max(len(self.pairs) - 1, 0))
        known = self.pairs[spot] == keys if len(self.pairs) else np.zeros(len(pairs), bool)
        out[known] = self.pair_buckets[spot[known]] if len(self.pairs) else 0
        rest = np.flatnonzero(~known)
        out[rest] = [zlib.crc32(w.as_buffer(), zlib.crc32(b" ", int(s))) % self.buckets for w, s in zip(distinct.take(pa.array(b[rest])), states[a[rest]])]
        return out[back.reshape(-1)]

    def features(self, column: pa.Array, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of words of each row, and for each feature its row and bucket."""
        words, first = words_of(column)
        n_words = np.diff(first)
        rows = np.repeat(np.arange(len(n_words)), n_words)
        coded = words.dictionary_encode()
        distinct, codes = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        states, at = self.word_states(distinct)
        buckets = (states % self.buckets)[codes]
        if pairs:
            i = pair_starts(first, len(codes))
            more = self.pair_buckets_of(distinct, states, at, codes[i], codes[i + 1])
            rows, buckets = np.concatenate([rows, rows[i]]), np.concatenate([buckets, more])
        return n_words, rows, buckets


def frequent(texts: DataFrame, pairs: bool, head: int = HEAD, buckets: int = BUCKETS) -> Head:
    """The head of all texts. A batch proposes what makes up 1/HEAD of its words at least, and ``head`` rows at most."""

    def most(count: np.ndarray, of: int) -> np.ndarray:
        often = np.flatnonzero((count > 1) & (count * HEAD >= of))
        return often[np.argsort(-count[often], kind="stable")[:head]]

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, first = words_of(part.column(0))
                short = np.asarray(pc.binary_length(words)) <= HEAD_BYTES
                coded = words.dictionary_encode()
                codes = np.asarray(coded.indices, dtype=np.int64)
                n = len(coded.dictionary)
                count = np.bincount(codes[short], minlength=n)
                often = most(count, len(codes))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(often)).cast(pa.binary()), pa.nulls(len(often), pa.binary()), pa.array(count[often])], ["a", "b", "n"])
                if pairs and len(codes):
                    i = pair_starts(first, len(codes))
                    i = i[short[i] & short[i + 1]]
                    found, count = np.unique(codes[i] * n + codes[i + 1], return_counts=True)
                    often = most(count, len(codes))
                    one, two = (coded.dictionary.take(pa.array(x)).cast(pa.binary()) for x in (found[often] // n, found[often] % n))
                    yield pa.RecordBatch.from_arrays([one, two, pa.array(count[often])], ["a", "b", "n"])

    counts = stored(only(texts, "text").mapInArrow(propose, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "dsir-head")
    first = [F.desc("n"), "a", "b"]
    words = [bytes(r["a"]) for r in counts.where("b IS NULL").orderBy(*first).limit(head).collect()]
    both = [(bytes(r["a"]), bytes(r["b"])) for r in counts.where("b IS NOT NULL").orderBy(*first).limit(head).collect()] if pairs else []
    return Head(words, both, buckets)


def bucketed(texts: DataFrame, key: str | None, head: Head, pairs: bool) -> DataFrame:
    """The key (if any), n_words, n_features, buckets and counts of each row, stored."""
    kind = texts.schema[key].dataType.simpleString() if key else "long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, rows, buckets = head.features(part.column(part.schema.get_field_index("text")), pairs)
                pairs_, counts = np.unique(rows * head.buckets + buckets, return_counts=True)
                ends = np.searchsorted(pairs_, np.arange(part.num_rows + 1) * head.buckets).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs_ % head.buckets, counts)]
                n = np.bincount(rows, minlength=part.num_rows)
                ids = part.column(part.schema.get_field_index(key)) if key else pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n), *lists], ["id", "n_words", "n_features", "buckets", "counts"])

    columns = only(texts, *filter(None, [key, "text"]))
    return stored(columns.mapInArrow(encode, f"id {kind}, n_words long, n_features long, buckets array<int>, counts array<int>"), "dsir-buckets")


def totals(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features all rows have in each bucket, counted by tasks and added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (np.asarray(batch.column(i).flatten()) for i in (0, 1))
            np.add.at(out, at, n)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["bucket", "n"])

    rows = only(features, "buckets", "counts").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[np.asarray(rows.column("bucket"))] = np.asarray(rows.column("n"))
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the shares, floored."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and weight: the floored mean gain."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at, n = np.asarray(lists.flatten()), np.asarray(batch.column(4).flatten())
            sums = np.zeros(len(at) + 1, np.int64)
            np.cumsum(gain[at] * n, out=sums[1:])
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))])
            many = np.asarray(batch.column(2))
            weight = np.diff(sums[ends]) // np.maximum(many, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    kind = features.schema["id"].dataType.simpleString()
    return features.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number from a hash of the seed and the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("-"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, pairs: bool = False, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, head: int = HEAD
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document; ``target`` has a column text."""
    known = frequent(docs, pairs, min(head, HEAD), buckets)
    features = bucketed(docs, "doc_id", known, pairs)
    gain = gains(totals(features, buckets), totals(bucketed(target, None, known, pairs), buckets))
    scored = weighed(features, gain).withColumnRenamed("id", "doc_id")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("out", F.col("n_words") < least)
    ordered = in_order(stored(scored, "dsir-scores"), [F.col("out"), -F.col("score"), F.col("doc_id"), F.col("n_features")], "dsir-order")
    fit = ordered.agg(F.count_if(~F.col("out"))).first()[0]
    place = running(ordered, F.lit(1), "before")
    rank = F.when(~F.col("out") & (F.col("before") < percent * fit // 100), F.col("before") + 1)
    return place.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def drawn(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is drawn."""
    ids = ranked.where("rank IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
