"""Near-duplicates by the exact Jaccard similarity of word shingles: prefix filter, sets compared, connected components.

Shingles: A-Z lower-cased, words split at white space, every run of five words as a 64-bit hash (fewer words: the whole
sequence; none: no shingle). Texts with equal sets of shingles become one class first; two classes are linked if their sets
have a similarity of 4/5 or more. No link is lost: there is no sampling of pairs and no sketch.

Candidates: sets at 4/5 or more share at least 4/5 of either, so in any common order of shingles the first n - ceil(4n/5) + 1
of both have one in common. The order goes by counts of all shingles of all documents, the rarest first: shingles are
counted in 2**20 classes of their hashes, so that the table of counts has one size whatever the input, and a rare shingle may
be put back by others of its class. That only bears on how many candidates there are. A shared shingle gives a pair where
sizes and places still allow 4/5.

The first links come from SimHash fingerprints of the sets, by the tiles of ``simhash`` (within 2 of 64 bits, which finds the
closest copies only), and from comparing the members of a shared shingle with a few of them, in two rounds. What these links
connect needs no comparison among itself, so that the copies of a large cluster are not compared pair by pair; what is left
is compared in full. Every link is verified by the sets. A large group of texts that are all just below 4/5 of each other
has no links that could spare comparisons; then these are as many as its pairs.

Defined cases as in ``simhash``: null text is an empty one; empty texts are one class; null doc_ids stay rows and count last
as representatives; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import bit_map, maybe_in, only, slices, stored, text_bytes
from .lsm_dedup import tags
from .simhash import components, keep_one, placed
from .words import LOWER, spans, window_hashes, word_hashes

SHINGLE = 5
#: Classes of shingles that are counted, as a power of two, and classes in a row of partial counts.
CLASS_BITS = 20
BLOCK = 1 << 10
#: Members of a shared shingle that the others are compared with first, by rounds.
HUBS = (range(3), range(3, 15))
#: Words of 64 bits for the parities of a set.
WORDS = 8
TEXT_BITS = 24


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, off = text_bytes(texts)
    buf = LOWER[buf]
    starts, ends, first = spans(buf, off)
    words = word_hashes(buf, starts, ends)
    runs = window_hashes(words, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(runs[a : b - shingle + 1] if b - a >= shingle else window_hashes(words[a:b], b - a) if b > a else words[:0]))
    return out


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42) if len(shingles) else 0


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * WORDS classes of shingles: whether the set has an odd number of them."""
    odd = np.bincount(((shingles >> np.uint64(20)) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def class_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def class_counts(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How many shingles of all documents each class has (a shingle counts in every document that has it).

    Tasks add up their documents, then each block of classes is added up over the tasks; the driver gets 2**CLASS_BITS numbers.
    """
    shape = ((1 << CLASS_BITS) // BLOCK, BLOCK)

    def blocks(total: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(len(some) + 1) * BLOCK
        counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(total[some].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), counts], names=["block", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                np.add.at(total.ravel(), class_of(np.concatenate(shingle_sets(part.column("text"), shingle))), 1)
        yield blocks(total, np.flatnonzero(total.any(1)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for block, n in zip(batch.column("block").to_pylist(), batch.column("n").flatten().to_numpy().reshape(-1, BLOCK)):
                total[block] += n
        yield blocks(total, np.flatnonzero(total.any(1)))

    schema = "block int, n array<long>"
    table = only(docs, "text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toArrow()
    out = np.zeros(shape, np.int64)
    out[np.asarray(table.column("block"))] = np.asarray(table.column("n").combine_chunks().flatten()).reshape(-1, BLOCK)
    return out.ravel()


def prefixes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tag, fp (a key of the set), n (its size), prefix (its first shingles in the common order), sim (its SimHash) and odd (its parities) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(class_counts(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                firsts = [s[np.argsort(counts[class_of(s)], kind="stable")[: prefix_size(len(s))]].view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, firsts)])
                raw = part.column("text").fill_null("").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        tags(raw),
                        pa.array(np.array([set_key(s) for s in sets], np.uint64).view(np.int64)),
                        pa.array(list(map(len, sets)), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts))),
                        pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)),
                        pa.array([parity(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "tag", "fp", "n", "prefix", "sim", "odd"],
                )

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, tag long, fp long, n int, prefix array<long>, sim long, odd array<long>")


def sets_of(docs: DataFrame, table: DataFrame, keys: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """fp and the set of each of the keys, from one of its texts; other texts are not hashed again."""
    texts = stored(table.join(keys, "fp", "left_semi").groupBy("fp").agg(F.min("tag").alias("tag")), "texts")
    words = bit_map(texts, "tag", TEXT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                ends = np.cumsum([0, *map(len, sets)])
                fps = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fps), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], names=["fp", "shingles"])

    some = only(docs, "text").where(maybe_in(docs.sparkSession, words, F.xxhash64(F.coalesce("text", F.lit("")))))
    return some.mapInArrow(run, "fp long, shingles array<long>").join(keys, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))


def fits(a: str, b: str) -> Column:
    """Whether the sets of two members of a shingle can be at 4/5: the first one common to both must leave enough after it, so
    no pair is lost by looking at every common shingle alone."""
    x = lambda t, c: F.col(f"{t}.{c}")
    n, m = x(a, "n"), x(b, "n")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - x(a, "at"), m - x(b, "at")) >= 4 * (n + m))


def parities_fit(a: str, b: str) -> Column:
    """Sets at 4/5 differ in a ninth of their shingles at most, and each bit in which their parities differ takes a shingle that
    one of them lacks."""
    bits = [F.bit_count(F.col(f"{a}.o{i}").bitwiseXOR(F.col(f"{b}.o{i}"))) for i in range(WORDS)]
    return 9 * sum(bits[1:], bits[0]) <= F.col(f"{a}.n") + F.col(f"{b}.n")


def verified(docs: DataFrame, table: DataFrame, pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """src, dst: the pairs (a stored table) whose sets have a similarity of 4/5 or more.

    Parities come first; only the texts of what is left are hashed again, and only their sets are moved.
    """
    marks = parities(table).join(table.groupBy("fp").agg(F.first("n").alias("n")), "fp")
    a, b = marks.alias("a"), marks.alias("b")
    met = pairs.join(a, F.col("src") == F.col("a.fp")).join(b, F.col("dst") == F.col("b.fp")).where(parities_fit("a", "b"))
    near = stored(met.select("src", "dst"), "fit")
    sets = stored(sets_of(docs, table, near.select(F.explode(F.array("src", "dst")).alias("fp")).distinct(), shingle), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            same = [similar(a[i].values.to_numpy(), b[i].values.to_numpy()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(same, pa.bool_())) for x in (batch.column("src"), batch.column("dst"))], names=["src", "dst"])

    joined = near.join(sets.select(F.col("fp").alias("src"), F.col("shingles").alias("a")), "src").join(sets.select(F.col("fp").alias("dst"), F.col("shingles").alias("b")), "dst")
    return joined.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def parities(table: DataFrame) -> DataFrame:
    odd = table.groupBy("fp").agg(F.first("odd").alias("odd"))
    return odd.select("fp", *[F.col("odd")[i].alias(f"o{i}") for i in range(WORDS)])


def by_tiles(table: DataFrame) -> DataFrame:
    """src, dst: classes whose SimHash fingerprints are equal or linked by ``simhash.links``."""
    classes = table.groupBy("fp").agg(F.min("sim").alias("sim"))
    first = stored(classes.groupBy("sim").agg(F.min("fp").alias("first")), "sims")
    same = classes.join(first, "sim").where("fp <> first").select("fp", "first")
    near = simhash.links(first.select(F.col("sim").alias("fp")))
    a, b = (first.select(F.col("sim").alias(x), F.col("first").alias(y)) for x, y in (("src", "fp"), ("dst", "first")))
    pairs = same.unionByName(near.join(a, "src").join(b, "dst").select("fp", "first"))
    return pairs.select(F.least("fp", "first").alias("src"), F.greatest("fp", "first").alias("dst"))


def by_hubs(members: DataFrame, seeds: range) -> DataFrame:
    """src, dst: members of each shared shingle with a few members drawn for it, but for those that are connected with them."""
    own, same = F.struct(*[c for c in members.columns if c != "h"]), Window.partitionBy("h")
    hubs = F.array(*[F.min(F.struct(F.xxhash64("fp", F.lit(seed)).alias("by"), own.alias("hub"))).over(same)["hub"] for seed in seeds])
    met = members.repartition("h").select("h", own.alias("own"), hubs.alias("hubs")).select("own", F.explode(F.array_distinct("hubs")).alias("hub"))
    pairs = met.where((F.col("own.root") != F.col("hub.root")) & fits("own", "hub"))
    return pairs.select(F.least("own.fp", "hub.fp").alias("src"), F.greatest("own.fp", "hub.fp").alias("dst"))


def links(docs: DataFrame, table: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """src, dst: links that connect the classes as all pairs at 4/5 or more do."""
    first = table.select("fp", "n", F.posexplode("prefix").alias("at", "h")).repartition("h")
    same = Window.partitionBy("h")
    several = first.withColumn("lo", F.min("fp").over(same)).withColumn("hi", F.max("fp").over(same)).where("lo <> hi")
    shared = stored(several.groupBy("h", "fp").agg(F.first("n").alias("n"), F.first("at").alias("at")), "shared")

    members, near, done = shared.withColumn("root", F.col("fp")), None, None
    for seeds in HUBS:
        pairs = by_hubs(members, seeds)
        pairs = pairs.unionByName(by_tiles(table)).distinct() if done is None else pairs.distinct().join(done, ["src", "dst"], "left_anti")
        pairs = stored(pairs, "hubs")
        found = stored(verified(docs, table, pairs, shingle), "near-hubs")
        near, done = (found, pairs) if near is None else (near.unionByName(found), done.unionByName(pairs))
        roots = components(near).select(F.col("node").alias("fp"), "root")
        known = shared.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        # shingles whose members are all connected have nothing left to compare
        open_ = known.withColumn("lo", F.min("root").over(same)).withColumn("hi", F.max("root").over(same)).where("lo <> hi").drop("lo", "hi")
        members = stored(open_, "open")

    left = members.join(parities(table), "fp").repartition("h")
    a, b = left.alias("a"), left.alias("b")
    apart = (F.col("a.h") == F.col("b.h")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.root") != F.col("b.root"))
    rest = a.join(b, apart & fits("a", "b") & parities_fit("a", "b")).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")).distinct()
    rest = stored(rest.join(done, ["src", "dst"], "left_anti"), "pairs")
    return near.unionByName(stored(verified(docs, table, rest, shingle), "near-pairs"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tag, fp, component_id of each row: the smallest doc_id reachable over links."""
    table = stored(prefixes(docs, shingle), "prefixes")
    return placed(table.select("doc_id", "tag", "fp"), lambda classes: links(docs, table, shingle))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of which one of each group stays (the smallest doc_id), with all their columns."""
    return keep_one(docs, stored(near_groups(docs, **options), "near"))
