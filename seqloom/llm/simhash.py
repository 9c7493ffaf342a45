"""SimHash near-duplicates: fingerprints, exact tiled comparison, connected components.

Fingerprint: A-Z lower-cased, words split at white space, 3-word shingles with repeats (fewer words: the whole sequence;
none: fingerprint 0), XXH64 (seed 42) of each; a bit is 1 if it is set in over half of them.

Links: fingerprints at ``radius`` or fewer differing bits. Equal fingerprints become one first. The 64 bits are cut into
``radius + 2`` blocks; two fingerprints within the radius agree in at least two of them, so comparing those that share a
pair of blocks misses nothing. Rows are sorted by pair of blocks and population count and cut in tiles of ``TILE`` rows,
many keys to a tile. Tiles are compared with numpy exclusive-or and bit counts; of a key that fills several, tile pairs
whose counts differ beyond the radius are skipped. A key with more than ``MOST`` fingerprints is dealt out as pairs of
parts by population count, so no task holds more than two parts, or a run of small keys, at a time. What is returned are
links of a spanning forest of each key, which keep every connection and are fewer than its fingerprints.

Components: alternating large-star and small-star steps over the links until nothing changes, stored at each step.

Defined cases: null text is an empty one; empty texts share fingerprint 0 and link like any other; repeated rows each
give a row; null doc_ids stay rows and count last as representatives; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, only, slices, stored
from .lsm_dedup import tags, without_rows

RADIUS = 2
SHINGLE = 3
#: Rows of a tile; of a part of a large key; of a run of keys that a task holds at a time (or two parts, if that is more).
TILE = 64
MOST = 4096
RUN = 16_384
NO_ID = np.iinfo(np.int64).max


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: A-Z only, white space \x20 and \x09-\x0D only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (none: 0)."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tag, fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = part.column("text").fill_null("").cast(pa.binary()).to_pylist()
                fps = np.array([fingerprint(b, shingle) for b in raw], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), tags(raw), pa.array(fps)], names=["doc_id", "tag", "fp"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, tag long, fp long")


def near_links(keys: np.ndarray, sides: np.ndarray, two: np.ndarray, fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> list[tuple[int, int]]:
    """Links of a spanning forest of the rows of each key, by tiles of ``tile`` rows.

    Rows are in order of key and, within it, of side and population count. A tile is compared with itself and with the
    tiles after it that still have its last key, until their population counts are out of reach: those are skipped.
    Rows of keys with two sides link across sides only.
    """
    n = len(fps)
    ones = np.bitwise_count(fps).astype(np.int64)
    label = np.arange(n)

    def find(x: int) -> int:
        while (y := int(label[x])) != x:
            label[x] = x = int(label[y])
        return x

    links = []
    starts = range(0, n, tile)
    for i in starts:
        a = slice(i, min(n, i + tile))
        for j in range(i, n, tile):
            b = slice(j, min(n, j + tile))
            if j > i:
                end = a.stop - 1
                if keys[j] != keys[end]:
                    break
                # rows of this key are in order of population count, so all further tiles of it are out of reach too
                if not two[end] and ones[j] - ones[end] > radius:
                    break
            near = (np.bitwise_count(fps[a, None] ^ fps[None, b]) <= radius) & (keys[a, None] == keys[None, b])
            near &= ~two[a, None] | (sides[a, None] != sides[None, b])
            if i == j:
                near = np.triu(near, 1)
            near &= label[a, None] != label[None, b]
            x, y = np.nonzero(near)
            for p, q in zip((x + i).tolist(), (y + j).tolist()):
                if (r := find(p)) != (s := find(q)):
                    label[max(r, s)] = min(r, s)
                    links.append((p, q))
            if len(x):
                for rows in (a, b):
                    label[rows] = [find(k) for k in range(rows.start, rows.stop)]
    return links


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST, tile: int = TILE) -> DataFrame:
    """src, dst: links that connect the distinct fingerprints (column fp) as all pairs within the radius do."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    pairs = [masks[i] | masks[j] for i, j in itertools.combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    keyed = distinct.select(
        "fp",
        F.bit_count("fp").alias("ones"),
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("which", "bits"),
    )
    counts = keyed.groupBy("which", "bits", "ones").agg(F.count(F.lit(1)).alias("n"))
    sizes = (
        counts.groupBy("which", "bits")
        .agg(F.sum("n").alias("n"), F.collect_list(F.struct("ones", F.ceil(F.col("n") / most).cast("int").alias("tiles"))).alias("by_ones"))  # 65 counts at most
        .where("n > 1")
    )
    shared = keyed.join(sizes, ["which", "bits"])
    zero = F.lit(0).cast("long")
    alone = shared.where(F.col("n") <= most).select("which", "bits", zero.alias("t"), zero.alias("u"), F.lit(0).alias("side"), "ones", "fp")
    # in a large key the fingerprints of one population count fill parts; a part meets those of counts within the radius
    own = F.element_at(F.filter("by_ones", lambda x: x["ones"] == F.col("ones")), 1)["tiles"]
    number = lambda ones, i: F.shiftleft(ones.cast("long"), 40) + i + 1
    near = F.flatten(
        F.transform(
            F.filter("by_ones", lambda x: F.abs(x["ones"] - F.col("ones")) <= radius),
            lambda x: F.transform(F.sequence(F.lit(0), x["tiles"] - 1), lambda j: number(x["ones"], j)),
        )
    )
    many = shared.where(F.col("n") > most).select("which", "bits", "fp", "ones", number(F.col("ones"), F.pmod(F.xxhash64("fp"), own)).alias("mine"), F.explode(near).alias("other"))
    many = many.select("which", "bits", F.least("mine", "other").alias("t"), F.greatest("mine", "other").alias("u"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "ones", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of whole keys of about RUN rows; the last key of a batch may go on in the next."""
        held = pa.Table.from_batches([], pa.schema([(k, pa.int64()) for k in ("which", "bits", "t", "u", "side", "ones", "fp")]))

        def found(rows: pa.Table) -> pa.RecordBatch:
            which, bits, t, u, side, fp = (np.asarray(rows.column(k)) for k in ("which", "bits", "t", "u", "side", "fp"))
            change = np.r_[True, (which[1:] != which[:-1]) | (bits[1:] != bits[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1])]
            pairs = np.array(near_links(np.cumsum(change), side, t != u, fp.view(np.uint64), radius, tile), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], names=["src", "dst"])

        for batch in batches:
            rows = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(held.schema)])
            last = [np.asarray(rows.column(k)) for k in ("which", "bits", "t", "u")]
            same = np.logical_and.reduce([c == c[-1] for c in last])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut and len(rows) >= RUN:
                yield found(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks()
            else:
                held = rows
        if len(held):
            yield found(held)

    order = ["which", "bits", "t", "u"]
    dealt = alone.unionByName(many).repartition(*order).sortWithinPartitions(*order, "side", "ones")
    return dealt.mapInArrow(compare, "src long, dst long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root: the smallest node (as signed long) that each node of the edges (src, dst) is connected with.

    Large-star and small-star in turn; each step's links are stored in the shared folder.
    """

    def star(e: DataFrame, small: bool, edges: int) -> DataFrame:
        # each node's least neighbour, itself included; its neighbours are linked to that
        both = e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        if not small:
            both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        out = join_split(both, least, "u", "degree", "v", total=edges)  # the centre of a large star is one key
        if small:
            out = out.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))
        else:
            out = out.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        return out.where("src <> dst").distinct()

    e = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    state = (e.count(),)
    for _ in range(most):
        e = stored(star(star(e, False, 2 * state[0]), True, 2 * state[0]), "star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("root"))


def placed(table: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of table with component_id, by the links that ``linked`` gives for the classes of equal fp."""
    classes = stored(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    roots = components(linked(classes))
    joined = stored(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "roots")
    heads = stored(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")), "heads")
    named = join_split(joined, heads, "root", "classes", "fp").select("fp", "rows", "component_id")
    return join_split(table, stored(named, "named"), "fp", "rows", "doc_id")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST, tile: int = TILE) -> DataFrame:
    """doc_id, tag, fp, component_id of each row: the smallest doc_id reachable over links."""
    table = stored(fingerprints(docs, shingle), "fingerprints")
    return placed(table, lambda classes: links(classes.select("fp"), radius, most, tile))


def simhash_digests(docs: DataFrame, **options) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_groups(docs, **options).select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of which one of each group stays (the smallest doc_id), with all their columns."""
    return keep_one(docs, stored(near_groups(docs, **options), "near"))


def keep_one(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with one row of each component_id of rows (doc_id, tag, component_id of every row)."""
    one = rows.groupBy("doc_id", "tag", "component_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag"))
    heads = rows.groupBy("component_id").agg(best.alias("best")).select(F.col("component_id").alias("_c"), "best")
    judged = one.join(heads, F.col("component_id").eqNullSafe(F.col("_c"))).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tag") == F.col("best.tag")))
    judged = stored(judged.where("not stays or n > 1").select("doc_id", "tag", "stays"), "judged")
    return without_rows(docs, judged.where("not stays"), judged.where("stays"))
