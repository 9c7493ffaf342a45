"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit check.

Texts are words: runs of ASCII letters and digits (A-Z lower-cased) and of all non-ASCII characters. A document leaks an
item of m words if some passage of it is within floor(0.2 m) word insertions, deletions and replacements of the item.

Items are put in size classes; a class has windows of its shortest item's size, and each item gives its first and its last
window. A window is embedded by a random walk (three steps for each word; at each step the current word is written and
the pointer moves on or stays by a random bit of that word), which maps edit distance to Hamming distance. Each repetition
has its own walk and compares a few sampled places; the number of repetitions is raised until simulated edits at the
threshold are found with the target recall. Windows that hold too few words of the class's items cannot be within the
threshold and are not embedded. Each window that meets an item in some repetition is verified by exact edit distance.

Classes that miss the target with ``MOST_REPETITIONS``, and those of items over ``LONGEST`` words, are searched exactly: an
item with k edits allowed is cut into k + 1 pieces, of which one is left whole in every passage within the threshold. Each
place that holds a piece is verified by exact edit distance, so nothing is lost.

Items are taken in blocks of ``BLOCK``, so what is broadcast is bounded; each block is run against all documents.

Defined cases: null texts have no words; items without words are never leaked; items with equal words are found each;
a document that leaks an item several times gives one row (fewest edits, then earliest); repeated document rows give a row
each; null doc_ids are kept; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, slices, stored, text_bytes
from .lsm_dedup import tags, without_rows
from .words import LOWER, U64, mix, spans, window_hashes, word_hashes

DISTANCE = 0.2
RECALL = 0.98
SAMPLED = 3
MOST_REPETITIONS = 64
#: Words from which on a class is searched by pieces; the target is out of reach there, so that it is not simulated.
LONGEST = 200
BLOCK = 20_000
TABLE_BITS = 20

#: Bytes that are no part of a word: ASCII other than letters and digits.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def item_words(text: str | None) -> np.ndarray:
    buf = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = spans(buf, np.array([0, len(buf)]), APART)
    return word_hashes(buf, starts, ends)


def edit_search(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest edits between the item and any part of text, and where the best part that ends first ends."""
    n = len(text)
    row = np.zeros(n + 1, np.int64)
    steps = np.arange(n + 1)
    for i, w in enumerate(item, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (text != w), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    at = int(np.argmin(row))
    return int(row[at]), at


class Embedding:
    """The sampled places of ``repetitions`` walks over windows of ``size`` words."""

    def __init__(self, size: int, repetitions: int, seed: int = 7, sampled: int = SAMPLED):
        rng = np.random.default_rng(seed + size)
        self.size, self.steps = size, 3 * size
        self.salts = rng.integers(0, 1 << 63, (MOST_REPETITIONS, self.steps)).astype(U64)[:repetitions]
        # in the mean the walk reaches the window's end at twice its size
        self.places = np.sort(rng.integers(0, 2 * size, (MOST_REPETITIONS, sampled)), axis=1)[:repetitions]

    def keys(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A key for each repetition (rows) and window start (columns); a word past the window's end counts as 0."""
        shape = (len(self.salts), len(at))
        step = np.zeros(shape, np.int64)
        key = np.repeat(np.arange(1, shape[0] + 1, dtype=U64)[:, None], shape[1], axis=1)
        for j in range(int(self.places.max(initial=-1)) + 1):
            w = np.where(step < self.size, words[np.minimum(at + step, len(words) - 1)], U64(0))
            for places in self.places.T:
                rows = np.flatnonzero(places == j)
                if len(rows):
                    key[rows] = mix(key[rows] * U64(0x9E3779B97F4A7C15) + w[rows])
            step += (mix(w ^ self.salts[:, j, None]) & U64(1)).astype(np.int64)
        return key


def simulated_recall(items: list[np.ndarray], size: int, distance: float, seed: int = 11, cases: int = 48) -> np.ndarray:
    """Share of items, edited as often as the threshold allows, that meet the original within 1, 2, ... repetitions."""
    rng = np.random.default_rng(seed)
    embedding = Embedding(size, MOST_REPETITIONS)
    first = []
    for item in [items[i % len(items)] for i in range(cases)]:
        most, new = int(distance * len(item)), list(item)
        for _ in range(most):
            i, kind = int(rng.integers(0, max(1, len(new)))), int(rng.integers(0, 3))
            word = U64(rng.integers(1, 1 << 63))
            if kind == 0:
                new.insert(i, word)
            elif kind == 1 and len(new) > 1:
                del new[i]
            elif new:
                new[i] = word
        new = np.array([*new, *rng.integers(1, 1 << 63, size)], U64)
        tail = len(item) - size
        starts = np.unique(np.clip(np.r_[0 : most + 1, tail - most : tail + most + 1], 0, len(new) - size))
        own, found = embedding.keys(item, np.array([0, tail])), embedding.keys(new, starts)
        hits = np.flatnonzero((own[:, :, None] == found[:, None, :]).any(axis=(1, 2)))
        first.append(hits[0] if len(hits) else MOST_REPETITIONS)
    return np.array([np.mean(np.array(first) <= r) for r in range(MOST_REPETITIONS)])


class Index:
    """The items of one block: classes, their words and the keys of their windows."""

    def __init__(self, items: list[tuple[int, str]], distance: float = DISTANCE, target: float = RECALL):
        self.distance = distance
        self.items = [(i, w) for i, t in items if len(w := item_words(t))]
        self.items.sort(key=lambda x: len(x[1]))
        self.counts = [Counter(w.tolist()) for _, w in self.items]
        self.classes = []  # some twenty at most: sizes up to LONGEST, each a quarter above the one before
        self.table = np.zeros(1 << TABLE_BITS, np.uint64)
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        at = 0
        while at < len(self.items):
            size = len(self.items[at][1])
            end = at
            while end < len(self.items) and len(self.items[end][1]) <= size * 1.25:
                end += 1
            own = [w for _, w in self.items[at:end]]
            enough = np.flatnonzero(simulated_recall(own, size, distance) >= target) if len(own[-1]) <= LONGEST else []
            if not len(enough):
                for n, w in enumerate(own, at):
                    parts = int(distance * len(w)) + 1
                    length = len(w) // parts
                    grams = window_hashes(w, length)
                    pieces.setdefault(length, []).extend((int(grams[o]), n, o) for o in (len(w) * j // parts for j in range(parts)))
                at = end
                continue
            embedding = Embedding(size, int(enough[0]) + 1)
            keys, whose, offset = [], [], []
            for n, w in enumerate(own, at):
                for o in {0, len(w) - size}:
                    keys.append(embedding.keys(w, np.array([o]))[:, 0])
                    whose.append(n)
                    offset.append(o)
            keys = np.array(keys).T
            order = np.argsort(keys, axis=1, kind="stable")
            longest = max(map(len, own))
            self.classes.append((size, size - int(distance * longest), embedding, np.take_along_axis(keys, order, 1), np.array(whose)[order], np.array(offset)[order]))
            for w in own:
                self.table[(w & U64((1 << TABLE_BITS) - 1)).astype(np.int64)] |= U64(1 << (len(self.classes) - 1))
            at = end
        #: for each length of pieces: their hashes in order, the items they are of and their places in them
        self.pieces = [(length, *(np.array(x, t) for x, t in zip(zip(*sorted(held)), (U64, np.int64, np.int64)))) for length, held in pieces.items()]

    def by_pieces(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item number, edits, end) for each stretch of places that hold a piece of an item and are within the threshold."""
        for length, keys, whose, offset in self.pieces:
            grams = window_hashes(words, length)
            lo, hi = np.searchsorted(keys, grams), np.searchsorted(keys, grams, "right")
            p = np.flatnonzero(hi > lo)
            row = np.searchsorted(first, p, "right") - 1
            inside = p + length <= first[row + 1]
            p, row = p[inside], row[inside]
            starts: dict[tuple[int, int], list[int]] = {}
            for i, r in zip(p.tolist(), row.tolist()):
                for k in range(lo[i], hi[i]):
                    starts.setdefault((r, int(whose[k])), []).append(i - int(offset[k]))
            for (r, n), at in starts.items():
                item = self.items[n][1]
                most = int(self.distance * len(item))
                at = np.unique(at)
                for near in np.split(at, np.flatnonzero(np.diff(at) > most) + 1):
                    a, b = max(int(first[r]), int(near[0]) - most), min(int(first[r + 1]), int(near[-1]) + len(item) + most)
                    if (Counter(words[a:b].tolist()) & self.counts[n]).total() < len(item) - most:
                        continue
                    edits, end = edit_search(item, words[a:b])
                    if edits <= most:
                        yield r, n, edits, a + end - int(first[r])

    @staticmethod
    def possible(words: np.ndarray, first: np.ndarray, size: int, least: int, own: np.ndarray) -> np.ndarray:
        """Starts of the windows with ``least`` words or more of the class's items (own: 1 for these words).

        Nothing is lost: k edits leave all but k words of an item in a passage, so all but k of a window's are the item's.
        """
        sums = np.concatenate(([0], np.cumsum(own)))
        stop = np.minimum(np.arange(len(words)) + size, np.repeat(first[1:], np.diff(first)))
        return np.flatnonzero(sums[stop] - sums[:-1] >= max(1, least))

    def search(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item number, edits, end) of each leak in rows whose words are words[first[row]:first[row+1]]."""
        marks = self.table[(words & U64((1 << TABLE_BITS) - 1)).astype(np.int64)]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for row, n, *new in self.by_pieces(words, first):
            best[row, n] = min(best.get((row, n), tuple(new)), tuple(new))
        for c, (size, least, embedding, keys, whose, offset) in enumerate(self.classes):
            at = self.possible(words, first, size, least, ((marks >> U64(c)) & U64(1)).astype(np.int64))
            for i in range(0, len(at), 1 << 12):
                part = at[i : i + (1 << 12)]
                found = embedding.keys(words, part)
                for r in range(len(found)):
                    lo, hi = np.searchsorted(keys[r], found[r]), np.searchsorted(keys[r], found[r], "right")
                    for p in np.flatnonzero(hi > lo):
                        row = int(np.searchsorted(first, part[p], "right")) - 1
                        for k in range(lo[p], hi[p]):
                            n = int(whose[r][k])
                            item = self.items[n][1]
                            start = int(part[p]) - int(offset[r][k])
                            most = int(self.distance * len(item))
                            if (row, n, start) in tried or best.get((row, n), (1, 0))[0] == 0:
                                continue
                            tried.add((row, n, start))
                            a, b = max(int(first[row]), start - most), min(int(first[row + 1]), start + len(item) + most)
                            if (Counter(words[a:b].tolist()) & self.counts[n]).total() < len(item) - most:
                                continue  # each word of the item that the passage lacks is an edit
                            edits, end = edit_search(item, words[a:b])
                            if edits <= most:
                                new = (edits, a + end - int(first[row]))
                                best[row, n] = min(best.get((row, n), new), new)
        return [(row, n, *x) for (row, n), x in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE, target: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, tag, item_id, item_words, edits, end_word for each document and benchmark item that it holds."""
    items = only(benchmark, "item_id", "text").toLocalIterator()
    spark = docs.sparkSession
    schema = "doc_id long, tag long, item_id long, item_words int, edits int, end_word int"

    def against(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                for part in slices(batch, "text"):
                    buf, off = text_bytes(part.column("text"))
                    buf = LOWER[buf]
                    starts, ends, first = spans(buf, off, APART)
                    found = index.search(word_hashes(buf, starts, ends), first) if len(starts) else []
                    if not found:
                        continue
                    rows = pa.array([f[0] for f in found])
                    hit = part.take(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            hit.column("doc_id").cast(pa.int64()),
                            tags(hit.column("text").fill_null("").cast(pa.binary()).to_pylist()),
                            pa.array([index.items[f[1]][0] for f in found], pa.int64()),
                            pa.array([len(index.items[f[1]][1]) for f in found], pa.int32()),
                            pa.array([f[2] for f in found], pa.int32()),
                            pa.array([f[3] for f in found], pa.int32()),
                        ],
                        names=["doc_id", "tag", "item_id", "item_words", "edits", "end_word"],
                    )

        return only(docs, "doc_id", "text").mapInArrow(run, schema)

    out = None
    blocks = itertools.batched(((r["item_id"], r["text"]) for r in items), block)
    last, following = next(blocks, None), next(blocks, None)
    while last is not None:
        held = spark.sparkContext.broadcast(Index(list(last), distance, target))
        part = against(held)
        if following is not None or out is not None:  # one block is broadcast at a time
            part = stored(part, "leaks")
            held.unpersist()
        out = part if out is None else out.unionByName(part)
        last, following = following, next(blocks, None)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    return without_rows(docs, stored(leaks(docs, benchmark, **options).select("doc_id", "tag"), "leaks"))
