"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words as in ``cgk``; shingles of five words. A template with n shingles is cut in overlapping windows of the largest
power of two s <= n. Text windows of s shingles start at every shingle. Windows are signed by ``BANDS`` x ``ROWS``
minima; a text window and a template window with Jaccard similarity j share a band with probability
1 - (1 - j**ROWS)**BANDS: over 0.9999 at j = 0.6, the least that the best aligned windows can have at containment 0.8
when up to a fifth of the shingles are replaced in one place. A window whose minima are no template shingles cannot share a band, so only windows
with template shingles are signed. Retrieved pairs are verified: the share of the template's distinct shingles that a
stretch of the text, as long as the template and a quarter more on each side, contains must be 0.8 or more.

Where the text around is shorter than a template's window, the template is verified at once. Templates of under five words
have no shingle and are found where all their words stand one after the other. Templates are given as lists by license or as a
table of at most ``MOST`` rows (license, text).

Defined cases: null texts have no words; empty templates are never found; a document with several places of one license gives one row (the best containment, then the earliest);
repeated rows give rows each; null doc_ids are kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .cgk import APART, item_words
from .common import only, slices, text_bytes
from .license_texts import TEMPLATES
from .words import LOWER, U64, mix, sliding, spans, window_hashes, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 24, 2
TABLE_BITS = 20
#: Most templates that a table may hold: every task holds them all.
MOST = 100_000

class Templates:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, containment: float = CONTAINMENT, seed: int = 5):
        self.containment = containment
        self.seeds = np.random.default_rng(seed).integers(1, 1 << 63, BANDS * ROWS).astype(U64)
        worded = [(name, w) for name, texts in templates.items() for t in texts if len(w := item_words(t))]
        self.rows = [(name, window_hashes(w, SHINGLE)) for name, w in worded if len(w) >= SHINGLE]
        #: templates without a shingle: by their number of words, the hash of these and the license
        self.short: dict[int, dict[int, str]] = {}
        for name, w in worded:
            if len(w) < SHINGLE:
                self.short.setdefault(len(w), {})[int(window_hashes(w, len(w))[0])] = name
        self.sets = [np.unique(s) for _, s in self.rows]
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, U64)
        self.longest = max((len(s) for _, s in self.rows), default=0)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.bands: dict[int, dict[int, set[tuple[int, int]]]] = {}
        self.sized: dict[int, list[int]] = {}
        for n, (_, s) in enumerate(self.rows):
            self.table[(s & U64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
            size = 1 << (len(s).bit_length() - 1)
            self.sized.setdefault(size, []).append(n)
            keys = self.signed(s, size)
            where = self.bands.setdefault(size, {})
            for offset in range(keys.shape[1]):
                for k in keys[:, offset].tolist():
                    where.setdefault(k, set()).add((n, offset))
        self.sorted = {size: np.array(sorted(x), U64) for size, x in self.bands.items()}

    def places(self, s: np.ndarray) -> np.ndarray:
        """Where template shingles stand: by a table first, then by the shingles themselves."""
        near = np.flatnonzero(self.table[(s & U64((1 << TABLE_BITS) - 1)).astype(np.int64)])
        return near[np.isin(s[near], self.all)]

    def signed(self, s: np.ndarray, size: int) -> np.ndarray:
        """The band keys (rows) of every window of ``size`` shingles (columns)."""
        least = [sliding(mix(s ^ seed), size) for seed in self.seeds]
        out = []
        for b in range(BANDS):
            key = np.full(len(least[0]), b + 1, U64)
            for r in range(ROWS):
                key = mix(key * U64(0x9E3779B97F4A7C15) + least[b * ROWS + r])
            out.append(key)
        return np.array(out)

    def contained(self, n: int, s: np.ndarray, at: int) -> tuple[float, int]:
        """How much of template n a stretch of s has that begins about place at, and where the stretch begins."""
        length = len(self.rows[n][1])
        more = (length + 3) // 4
        return float(np.isin(self.sets[n], s[max(0, at - more) : max(0, at + length + more)]).mean()), max(0, at)

    def search(self, s: np.ndarray) -> list[tuple[str, float, int]]:
        """(license, containment, first shingle) found in the shingles of one text, the best place of each license."""
        hits = self.places(s)
        best: dict[str, tuple[float, int]] = {}
        if not len(hits):
            return []

        def verify(n: int, at: int) -> None:
            share, first = self.contained(n, s, at)
            if share >= self.containment:
                name = self.rows[n][0]
                best[name] = min(best.get(name, (0.0, 0)), (-share, first))

        cuts = np.flatnonzero(np.diff(hits) > 2 * self.longest) + 1
        for group in np.split(hits, cuts):
            a, b = max(0, int(group[0]) - self.longest), min(len(s), int(group[-1]) + self.longest + 1)
            region = s[a:b]
            tried = set()
            for size, known in self.sorted.items():
                if len(region) < size:  # shorter than the window: there is no other place for these templates
                    for n in self.sized[size]:
                        if len(region) >= self.containment * len(self.sets[n]):
                            verify(n, a)
                    continue
                keys = self.signed(region, size)
                at = np.searchsorted(known, keys)
                met = known[np.minimum(at, len(known) - 1)] == keys
                for band, p in zip(*np.nonzero(met)):
                    for n, offset in self.bands[size][int(keys[band, p])]:
                        if (n, p - offset) not in tried:
                            tried.add((n, p - offset))
                            verify(n, a + int(p) - offset)
        return [(name, -x[0], x[1]) for name, x in sorted(best.items())]


def listed(templates: DataFrame, most: int = MOST) -> dict[str, list[str]]:
    """The templates of a table (license, text), of which every task holds all; more than ``most`` are an error."""
    rows = only(templates, "license", "text").where("license is not null and text is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r["license"], []).append(r["text"])
    return out


def licenses(docs: DataFrame, templates: dict[str, list[str]] | DataFrame = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word of each license or notice that a document holds."""
    texts = templates if isinstance(templates, dict) else listed(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(texts, containment)
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = text_bytes(part.column("text"))
                buf = LOWER[buf]
                starts, ends, first = spans(buf, off, APART)
                words = word_hashes(buf, starts, ends)
                best: dict[tuple[int, str], tuple[float, int]] = {}
                for size, names in index.short.items():
                    grams = window_hashes(words, size)
                    at = np.flatnonzero(np.isin(grams, np.array(list(names), U64)))
                    row = np.searchsorted(first, at, "right") - 1
                    for p, r in zip(at.tolist(), row.tolist()):
                        if p + size <= first[r + 1]:
                            key = (r, names[int(grams[p])])
                            best[key] = min(best.get(key, (0.0, 0)), (-1.0, p - int(first[r])))
                marks = window_hashes(words, SHINGLE)
                at = index.places(marks)
                row = np.searchsorted(first, at, "right") - 1
                for r in np.unique(row[at + SHINGLE <= first[row + 1]]).tolist():
                    for name, share, place in index.search(marks[first[r] : first[r + 1] - SHINGLE + 1]):
                        best[r, name] = min(best.get((r, name), (0.0, 0)), (-share, place))
                out = [(*k, -x[0], x[1]) for k, x in sorted(best.items())]
                if out:
                    ids = part.column("doc_id").cast(pa.int64()).take(pa.array([o[0] for o in out]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([o[1] for o in out]), pa.array([o[2] for o in out]), pa.array([o[3] for o in out], pa.int64())], names=["doc_id", "license", "containment", "first_word"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, license string, containment double, first_word long")
