"""Toxicity by noisy-channel deobfuscation.

1. A character language model: letter trigrams (with word borders) counted over the whole texts of all documents.
2. Deobfuscation: a written form that may be disguised - letters mixed with digits or signs, a letter three times or more
   in a row, single letters set apart - is a lattice: a sign may stand for letters or for nothing, a repeated letter may be
   one letter, a gap may be none. Viterbi decoding under the trigram model picks the likeliest letters. Other words have
   one path only and stay as they are.
3. Score: logistic regression over the prefixes and whole words of the restored text. Document frequencies come from a
   bounded sample of labelled rows (``SAMPLE`` documents by hash of doc_id; all of them where there are fewer), as does the
   fit. Rows with crc32(doc_id as text) mod 4 = 2 are never learnt from.

Defined cases: null text counts as empty and gets the score of a text without features; labels that are null or name no
document are not used; a document with labels repeated counts once, as toxic if any says so; without labels of both kinds
every score is the share of toxic labels (0 without any); repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, stored

#: Most labelled documents that the fit reads (expected number: they are drawn by hash).
SAMPLE = 20_000
FEATURES = 1000
THRESHOLD = 0.3
#: Written forms kept in each of two generations, and features counted before they are passed on: bounds of a worker's memory.
CACHE = 40_000
COUNTED = 100_000
#: A feature is learnt from this many toxic documents on, whatever the number of labels.
LEAST = 2
#: Characters of a written form that are decoded at a time, which bounds the paths that are held.
PIECE = 1024

# --- language model -------------------------------------------------------------------------------------------------
SYMBOLS = 60  # 0: border; 1-26: a-z; 27-58: U+00E0-U+00FF; 59: any other letter


def symbol(char: str) -> int:
    c = ord(char)
    if 97 <= c <= 122:
        return c - 96
    if 0xE0 <= c <= 0xFF and c != 0xF7:
        return c - 0xE0 + 27
    return 59 if char.isalpha() else 0


_TABLE = np.array([symbol(chr(c)) for c in range(0x3000)], np.int32)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """code, n: how often each letter trigram occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                text = "\n\n" + "\n\n".join(t for t in part.column("text").to_pylist() if t).lower() + "\n\n"
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                s = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
                s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
                s = np.repeat(s, 1 + (s == 0))  # a border counts as two symbols
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    return only(docs, "text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_probabilities(counts: DataFrame) -> np.ndarray:
    """log p(c | a, b) with back-off to shorter histories; at most SYMBOLS**3 counts reach the driver."""
    rows = counts.toArrow()
    tri = np.zeros(SYMBOLS**3)
    tri[np.asarray(rows.column("code"))] = np.asarray(rows.column("n"))
    tri = tri.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    uni = tri.sum((0, 1)) + 1
    bi = (tri.sum(0) + 5 * uni / uni.sum()) / (tri.sum((0, 2))[:, None] + 5)
    return np.log((tri + 5 * bi[None]) / (tri.sum(2, keepdims=True) + 5)).astype(np.float32)


# --- noisy channel --------------------------------------------------------------------------------------------------
# What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "µ": "u", "*": "aeiou", "#": "h",
}
SAME, SWAP, DROP, REPEAT, GAP = -0.05, -1.0, -9.0, -0.7, -0.3
_left = re.compile(r"[^\w@$!|+€£¡§(\[{<]*")
_ends = frozenset("_@$|+€")
_word = re.compile(r"[^\W\d_]+")
_odd = re.compile(r"[^\W\d_].*[\d@$!|+€£¡§*(\[{<._\-].*|[\d@$!|+€£¡§(\[{<].*[^\W\d_].*|.*([^\W\d_])\1\1.*", re.S)
_spaced = re.compile(r"(?<!\S)[^\W_](?:[ ._\-*][^\W_]){2,}(?!\S)")


def bare(token: str) -> str:
    """The token without the signs around it that stand for nothing, in one pass from either end."""
    start, end = _left.match(token).end(), len(token)
    while end > start and not (token[end - 1].isalnum() or token[end - 1] in _ends):
        end -= 1
    return token[start:end]


class Channel:
    def __init__(self, model: np.ndarray):
        self.model = model

    def options(self, text: str, i: int) -> list[tuple[str, float]]:
        """What the character at i may mean, with log channel probabilities; '' is nothing and ' ' a border."""
        c = text[i]
        if c.isalpha():
            return [(c, SAME), ("", REPEAT)] if i and text[i - 1] == c else [(c, SAME)]
        if c.isspace():
            return [("", GAP), (" ", SWAP)]
        return [*((x, SWAP) for x in STANDS_FOR.get(c, "")), ("", DROP if c in STANDS_FOR else SWAP), (" ", DROP)]

    def decode(self, text: str) -> str:
        """The likeliest letters. Beyond ``PIECE`` characters the best state so far is settled, and the next piece begins in it."""
        text = re.sub(r"(.)\1{3,}", r"\1\1\1", text, flags=re.S)
        out, state = [], (0, 0)
        for i in range(0, len(text), PIECE):
            end = min(len(text), i + PIECE)
            found, state = self.likeliest(text, i, end, state, end == len(text))
            out.append(found)
        return "".join(out)

    def likeliest(self, text: str, start: int, end: int, state: tuple[int, int], last: bool) -> tuple[str, tuple[int, int]]:
        """Viterbi over text[start:end] from a state of the trigram model (the two symbols before); what was read, and its state."""
        model = self.model
        states: dict[tuple[int, int], tuple[float, object]] = {state: (0.0, None)}
        for i in range(start, end):
            after: dict[tuple[int, int], tuple[float, object]] = {}
            for c, cost in self.options(text, i):
                s = 0 if c == " " else symbol(c) if c else -1
                for (a, b), (p, path) in states.items():
                    if s < 0 or (s == 0 and b == 0):
                        key, q, way = (a, b), p + cost, path
                    elif s == 0:
                        key, q, way = (0, 0), p + cost + float(model[a, b, 0]), (path, c)
                    else:
                        key, q, way = (b, s), p + cost + float(model[a, b, s]), (path, c)
                    if key not in after or after[key][0] < q:
                        after[key] = (q, way)
            states = after
        state, (_, best) = max(states.items(), key=lambda x: x[1][0] + (float(model[x[0][0], x[0][1], 0]) if last else 0.0))
        out = []
        while best is not None:
            best, c = best
            out.append(c)
        return "".join(reversed(out)), state

    def words(self, token: str) -> list[str]:
        """The restored words of a written form without white space (lower case)."""
        if token.isalpha() and not _odd.fullmatch(token):
            return [token]
        inner = bare(token)
        if inner.isalpha() and not _odd.fullmatch(inner):
            return [inner]
        if _odd.fullmatch(inner):
            return _word.findall(self.decode(inner))
        return _word.findall(inner)


class Features:
    """Restored words of a text and their features, with a bounded cache of written forms."""

    def __init__(self, channel: Channel, known: dict[str, int] | None = None):
        self.channel, self.known = channel, known
        self.cache: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def of_words(self, words: list[str]) -> tuple:
        out = set()
        for w in words:
            out.add(w + "$")
            out.update(w[:k] for k in range(4, min(8, len(w)) + 1))
        if self.known is not None:
            return tuple(self.known[f] for f in out if f in self.known)
        return tuple(out)

    def of_text(self, text: str) -> set:
        low = text.lower()
        out: set = set()
        for token in set(low.split()):
            found = self.cache.get(token)
            if found is None:
                found = self.older.get(token)
                if found is None:
                    found = self.of_words(self.channel.words(token))
                if len(token) <= 64:
                    if len(self.cache) >= CACHE:
                        self.cache, self.older = {}, self.cache
                    self.cache[token] = found
            if found:
                out.update(found)
        for m in _spaced.finditer(low):
            out.update(self.of_words(_word.findall(self.channel.decode(m[0]))))
        return out


# --- classifier -----------------------------------------------------------------------------------------------------
def held_out(doc_id):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """y, text of the sampled labelled documents; the labels that are broadcast are ``sample`` in expectation."""
    usable = only(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = one.count()
    if n > sample:
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)
    return only(docs, "doc_id", "text").join(F.broadcast(one), "doc_id").select("y", F.coalesce("text", F.lit("")).alias("text"))


def fitted(rows: list[np.ndarray], y: np.ndarray, n: int, ridge: float = 0.1, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression over binary features, by accelerated gradient steps."""
    index = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, v, bias, vb = np.zeros(n), np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0
    vb = bias
    scale = 0.25 * np.bincount(index, minlength=n) * max(1.0, np.mean([len(r) for r in rows])) + ridge
    for k in range(1, steps + 1):
        z = np.bincount(owner, v[index], minlength=len(rows)) + vb
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = v - (np.bincount(index, d[owner], minlength=n) + ridge * v) / scale
        new_bias = vb - d.sum() / (0.25 * len(y) * 4)
        m = (k - 1) / (k + 2)
        v, w = new + m * (new - w), new
        vb, bias = new_bias + m * (new_bias - bias), new_bias
    return w, bias


def learnt(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> dict:
    """The model: trigram log probabilities, feature numbers, weights and bias."""
    model = log_probabilities(trigram_counts(docs))
    rows = stored(training_rows(docs, labels, sample), "sampled")
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, both = Features(Channel(held.value)), (Counter(), Counter())
        seen = [0, 0]

        def out() -> pa.RecordBatch:
            keys = list(both[0].keys() | both[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([both[0][k] for k in keys], pa.int64()), pa.array([both[1][k] for k in keys], pa.int64())], names=["feature", "neg", "pos"])
            both[0].clear()
            both[1].clear()
            return batch

        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                both[y > 0].update(make.of_text(text))
                seen[y > 0] += 1
                if len(both[0]) + len(both[1]) > COUNTED:
                    yield out()
        both[0][""], both[1][""] = seen
        yield out()

    counts = stored(rows.mapInArrow(count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")), "features")
    total = counts.where("feature = ''").first()
    n_neg, n_pos = (total["neg"], total["pos"]) if total else (0, 0)
    if not n_neg or not n_pos:
        share = 1 - 1e-6 if n_pos else 1e-6
        return {"model": model, "known": {}, "weights": np.zeros(0), "bias": math.log(share / (1 - share))}
    p, q = (F.col("pos") + 0.1) / (n_pos + 0.2), (F.col("neg") + 0.1) / (n_neg + 0.2)
    chosen = counts.where(f"feature <> '' and pos >= {LEAST}").select("feature", (p * F.log(p / q)).alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "feature").limit(features).toArrow()
    known = {f: i for i, f in enumerate(chosen.column("feature").to_pylist())}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(Channel(held.value), known)
        for batch in batches:
            ids = [sorted(make.of_text(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(ids, pa.list_(pa.int32()))], names=["y", "ids"])

    design = rows.mapInArrow(present, "y int, ids array<int>").toArrow()
    x = [np.asarray(r.values, np.int64) for r in design.column("ids").combine_chunks()]
    weights, bias = fitted(x, np.asarray(design.column("y"), float) > 0, len(known))
    return {"model": model, "known": known, "weights": weights, "bias": bias}


class Scorer:
    """The scores of texts under a model."""

    def __init__(self, model: dict):
        self.make = Features(Channel(model["model"]), model["known"])
        self.weights, self.bias = model["weights"].tolist(), model["bias"]

    def __call__(self, texts: list[str]) -> np.ndarray:
        z = [self.bias + sum(self.weights[i] for i in sorted(self.make.of_text(t))) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found = score(part.column("text").fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(found)], names=["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    rows = scores(docs, learnt(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; scored and judged in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(score(part.column("text").fill_null("").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
