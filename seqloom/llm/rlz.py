"""Substring deduplication by relative Lempel-Ziv parsing against the whole corpus.

The reference is every document, indexed by content-chosen anchors: of the word 12-grams in a window of 35 words the one with
the least hash, so equal windows have equal anchors wherever they stand. Consecutive windows with one anchor are a block; a
block that stands elsewhere too has its first other place as its reference.

1. Count anchors over all documents (map-side first). Those that stand at several places go into a bit map.
2. Read the documents again. Blocks whose anchor may stand elsewhere are candidates; documents without any are done.
3. Count blocks, map-side first, and find their references. The other blocks are where factors begin and end.
4. At these borders single windows are looked up: those of each border block among those of one copy of every distinct block
   with the same anchor, since a greedy factor hides repeats that begin inside it and end beyond it.
5. Parse each document greedily from left to right: a factor goes on as long as the reference that it began in does. Factors
   of 35 words and more, and the windows across their borders, are duplicate spans and are cut.

Blocks and windows are compared by 128 bits of hash of their words, not word by word: that would bring the text of each
reference to each of its copies, several times the corpus. Among 10**13 blocks some two differ and agree in 128 bits with a
chance of 10**-13.

No step brings the occurrences of one block or window together in a task: counts are pre-aggregated, and joins split the keys
that many rows have.

Defined cases: null text has no words; documents under 35 words keep all; repeated rows are places of their own, so
their windows repeat; overlapping windows of one document count as different places; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, in_bit_map, join_split, only, slices, stored, text_bytes
from .words import BASES, mix, powers, sliding, spans, window_hashes, word_hashes

WINDOW = 35
GRAM = 12
MAP_BITS = 30


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A hash of the words from each start to each end."""
    up, down = powers(len(words) + 1, BASES[which])
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _windows(buf: np.ndarray, off: np.ndarray, window: int) -> tuple:
    starts, ends, first = spans(buf, off)
    n = max(0, len(starts) - window + 1)
    edge = np.zeros(n + 1, np.int64)
    lengths = np.diff(first)
    long = np.flatnonzero(lengths >= window)
    np.add.at(edge, first[long], 1)
    np.add.at(edge, first[long + 1] - window + 1, -1)
    return starts, ends, first, np.cumsum(edge[:n]) > 0


def anchors(words: np.ndarray, valid: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor hash, and the hashes of the anchors' places (one for each place)."""
    width = window - gram + 1
    grams = window_hashes(words, gram) | np.uint64(1)
    least = sliding(grams, width, np.minimum)
    shown = np.where(valid, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate((pad, shown, pad)), width, np.maximum)
    return least, grams[best == grams]


def anchor_counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = text_bytes(part.column("text"))
                starts, ends, _, valid = _windows(buf, off, window)
                if not valid.any():
                    continue
                _, places = anchors(word_hashes(buf, starts, ends), valid, window, gram)
                keys, n = np.unique(places, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    return only(docs, "text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


CANDIDATES = "row long, doc_id long, n_words long, sha string, text binary, blocks array<struct<anchor long, b1 long, b2 long, at int, n int, places int>>"
BLOCK = pa.struct([("anchor", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("places", pa.int32())])


def candidates(docs: DataFrame, held, window: int, gram: int, all_texts: bool = False) -> DataFrame:
    """A row for each document: its candidate blocks with hashes and its text, or its digest if there are none (or both)."""
    width = window - gram + 1

    def blocks_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where candidate blocks begin, and their columns but for the place in the document."""
        words = word_hashes(buf, starts, ends)
        least, _ = anchors(words, valid, window, gram)
        begins = valid & np.r_[True, (least[1:] != least[:-1]) | ~valid[:-1]]
        at = np.flatnonzero(begins)
        over = np.flatnonzero(valid & np.r_[(least[1:] != least[:-1]) | ~valid[1:], True])
        some = in_bit_map(held.value, least[at])
        at, n = at[some], (over - at + 1)[some]
        grams = window_hashes(words, gram) | np.uint64(1)
        size = n + width - 1
        owner = np.repeat(np.arange(len(at)), size)
        where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at, size)
        places = np.bincount(owner[grams[where] == least[at][owner]], minlength=len(at))
        end = at + n + window - 1
        b1 = range_hashes(words, at, end, 0)
        b2 = range_hashes(word_hashes(buf, starts, ends, 1), at, end, 1)
        return at, [least[at].view(np.int64), b1.view(np.int64), b2.view(np.int64), n.astype(np.int32), places.astype(np.int32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                rows = part.num_rows
                buf, off = text_bytes(part.column("text"))
                starts, ends, first, valid = _windows(buf, off, window)
                none = np.empty(0, np.int64)
                at, cols = blocks_of(buf, starts, ends, valid) if valid.any() else (none, [none, none, none, none.astype(np.int32), none.astype(np.int32)])
                bounds = np.searchsorted(at, first)
                some = np.diff(bounds) > 0
                data = buf.tobytes()
                sha, text = [], []
                for i in range(rows):
                    own = data[off[i] : off[i + 1]]
                    sha.append(None if some[i] else hashlib.sha256(b" ".join(own.split())).hexdigest())
                    text.append(own if some[i] or all_texts else None)
                local = at - first[np.searchsorted(first, at, "right") - 1] if len(at) else at
                anchor, b1, b2, n, places = cols
                structs = pa.StructArray.from_arrays([pa.array(x) for x in (anchor, b1, b2, local.astype(np.int32), n, places)], fields=list(BLOCK))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + rows)),
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(np.diff(first)),
                        pa.array(sha, pa.string()),
                        pa.array(text, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), structs),
                    ],
                    names=["row", "doc_id", "n_words", "sha", "text", "blocks"],
                )
                row += rows

    return only(docs, "doc_id", "text").mapInArrow(run, CANDIDATES)


def border_windows(texts: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """row, at, border, h1, h2: every window of the blocks in parts (row, at, n, border)."""
    listed = parts.groupBy("row").agg(F.collect_list(F.struct("at", "n", "border")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = text_bytes(part.column("text").cast(pa.string()))
                starts, ends, first = spans(buf, off)
                lists = part.column("parts")
                owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                values = lists.flatten()
                at, n = (np.asarray(values.field(k)).astype(np.int64) for k in ("at", "n"))
                border = np.asarray(values.field("border").cast(pa.int8())) > 0
                which = np.repeat(np.arange(len(at)), n)
                local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[which]
                place = local + first[owner[which]]
                h1 = window_hashes(word_hashes(buf, starts, ends), window)[place]
                h2 = window_hashes(word_hashes(buf, starts, ends, 1), window, 1)[place]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(pa.array(owner[which])), pa.array(local.astype(np.int32)), pa.array(border[which]), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    names=["row", "at", "border", "h1", "h2"],
                )

    return texts.select("row", "text").join(listed, "row").mapInArrow(run, "row long, at int, border boolean, h1 long, h2 long")


def covered(starts: np.ndarray, counts: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """Which words are covered by ``counts`` consecutive windows from each start."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + window - 1, -1)
    return np.cumsum(edge[:n_words]) > 0


def matches(docs: DataFrame, window: int, gram: int, all_texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table of ``candidates``, and row, parts array<struct<at, n, source, source_at>>: n windows from word ``at`` also start at
    word ``source_at`` of row ``source``."""
    repeated = stored(anchor_counts(docs, window, gram), "anchors")
    held = docs.sparkSession.sparkContext.broadcast(bit_map(repeated, "anchor", MAP_BITS))
    table = stored(candidates(docs, held, window, gram, all_texts), "candidates")
    open_ = table.where("text is not null")
    key = F.struct("anchor", "b1", "b2", "n")
    blocks = open_.select("row", F.inline("blocks")).select("row", "at", key.alias("key"), "places")
    distinct = stored(blocks.groupBy("key", "places").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "at")).alias("one"), F.max(F.struct("row", "at")).alias("other")), "blocks")
    # anchors with a block that occurs once, and with places elsewhere too
    anchored = distinct.select(F.col("key.anchor").alias("anchor"), "key", "places", "times", "one")
    shared = anchored.groupBy("anchor").agg(F.sum("places").alias("all_places"), F.min("times").alias("least"), F.count(F.lit(1)).alias("kinds")).where("all_places > 1 and least = 1").select("anchor", "kinds")
    parts = join_split(anchored, stored(shared, "shared"), "anchor", "kinds", "key").select("one.row", "one.at", F.col("key.n").alias("n"), (F.col("times") == 1).alias("border"))
    windows = stored(border_windows(open_, parts, window).select("row", "at", "border", F.struct("h1", "h2").alias("key")), "windows")
    places = [F.min(F.struct("row", "at")).alias("one"), F.max(F.struct("row", "at")).alias("other")]
    twice = windows.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.count_if("border").alias("borders"), *places).where("times > 1 and borders > 0").drop("times")
    # the source of a match is the first of the known places, or the last where it is the first itself
    own = (F.col("one.row") == F.col("row")) & (F.col("one.at") == F.col("at"))
    source = [F.when(own, F.col(f"other.{x}")).otherwise(F.col(f"one.{x}")).alias(y) for x, y in (("row", "source"), ("at", "source_at"))]
    at_borders = join_split(windows.where("border").select("row", "at", "key"), stored(twice, "twice"), "key", "borders", "row", "at").select("row", "at", F.lit(1).alias("n"), *source)
    inside = join_split(blocks.select("row", "at", "key"), distinct.where("times > 1").select("key", "times", "one", "other"), "key", "times", "row", "at").select("row", "at", F.col("key.n").alias("n"), *source)
    found = inside.unionByName(at_borders)
    return table, found.groupBy("row").agg(F.collect_list(F.struct("at", "n", "source", "source_at")).alias("parts"))


def parsed(parts: pa.StructArray) -> tuple[np.ndarray, ...]:
    """The greedy parse of one document by its matches: start, windows, source and source_at of each factor.

    A factor goes on with the match where it ends if that stands at the same distance from the same source.
    """
    at, n, source, source_at = (np.asarray(parts.field(k)).astype(np.int64) for k in ("at", "n", "source", "source_at"))
    order = np.argsort(at, kind="stable")
    at, n, source, source_at = at[order], n[order], source[order], source_at[order]
    goes_on = (at[1:] == at[:-1] + n[:-1]) & (source[1:] == source[:-1]) & (source_at[1:] - at[1:] == source_at[:-1] - at[:-1])
    first = np.flatnonzero(np.r_[True, ~goes_on])
    return at[first], np.add.reduceat(n, first), source[first], source_at[first]


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, start, words, source_doc_id, source_start: the long factors of each document, in words.

    Factors may overlap by less than a window, where a repeat crosses a border.
    """
    table, found = matches(docs, window, gram, True)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, parts in zip(batch.column("row"), batch.column("parts")):
                columns = parsed(parts.values)
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(columns[0]), pa.int64()), *map(pa.array, columns)], names=["row", "at", "n", "source", "source_at"])

    out = found.mapInArrow(parse, "row long, at long, n long, source long, source_at long")
    ids = table.select("row", "doc_id")
    named = out.join(ids, "row").join(ids.select(F.col("row").alias("source"), F.col("doc_id").alias("source_doc_id")), "source")
    return named.select("doc_id", F.col("at").alias("start"), (F.col("n") + (window - 1)).alias("words"), "source_doc_id", F.col("source_at").alias("source_start"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row (and kept, the words that stay, joined by one space)."""
    table, found = matches(docs, window, gram, with_text)
    open_ = table.where("text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, kept = [], [], []
            for text, parts, n in zip(batch.column("text"), batch.column("parts"), batch.column("n_words").to_pylist()):
                words = text.as_buffer().to_pybytes().split()
                if parts.is_valid:
                    start, many, _, _ = parsed(parts.values)
                    gone = covered(start, many, window, n)
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                left = b" ".join(words)
                removed.append(n - len(words))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    done = open_.select("row", "doc_id", "n_words", "text").join(found, "row", "left").mapInArrow(cut, schema)
    if with_text:
        return done
    whole = table.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return whole.unionByName(done.drop("kept"))
