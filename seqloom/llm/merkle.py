"""Merkle manifest of a dataset: a tree of hashes for each source, a tree of the sources, proofs of rows and their check.

A leaf is the digest of a row's columns, each by its length and value. Per source the leaves ascend by doc_id; every ``arity``
consecutive nodes become the digest of their digests (so do the fewer ones, even a single one, at the end) while there is
more than one. What remains is the source's subroot; the subroots, in order of the sources, give the root likewise.

Sibling shift: a level is a table of (tree, idx, digest). The rows in slot 0 of a run compute the indices of their siblings (idx XOR 1
in a binary tree, idx + 1 ... idx + arity - 1 otherwise), an equijoin on (tree, idx) fetches these, and the slot-0 row emits the
parent. The join's keys are unique, so a hot source is no hot key, and a run has ``arity`` digests at most. Leaves get their indices
from an order by ranges (``common.in_order``); the levels above have 1/arity of the rows each. Proofs go down level by level: a
run hands each of its nodes the digests left and right of it and what it got itself.

A proof has about arity * log(rows) digests; the joins move one for each run of leaves, not for each leaf.

Defined cases: a null column is ``-``; a null source is a tree of its own, the first; null doc_ids come first; of equal doc_ids the order is
that of their leaves, and equal rows are leaves of their own, interchangeable; a source of one row has its leaf as subroot and an
empty list of siblings there, one source alone gives the root; texts are hashed whole; extra columns are not read; an empty table
gives an empty one. The number of sources is not bounded.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, running, stored

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a proof says of a level: the digests left and right of the node, joined.
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-``, or the length in bytes of the value's UTF-8, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def leaves(docs: DataFrame, changed: Column | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """tree (key of the source), idx, doc_id, digest, and other: the digest with the text ``changed`` (null where that is null), stored."""
    values = [F.col(f"`{c}`") for c in columns]
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed.isNotNull(), leaf_digest(*[changed if c == "text" else v for c, v in zip(columns, values)]))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # joins want keys that are not null; "-" comes before "="
    rows = docs.select(tree.alias("tree"), F.col("doc_id"), leaf_digest(*values).alias("digest"), other.alias("other"))
    rows = stored(rows, "merkle-digests")  # the texts are read once; putting in order reads its rows twice
    placed = in_order(rows, [F.col("tree"), F.col("doc_id"), F.col("digest")], "merkle-order")
    return stored(running(placed, F.lit(1), "idx", "tree").drop("_stretch", "_at"), "merkle-leaves")


def runs(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """tree, run and its nodes array<struct<slot, digest, ...>>: the slot-0 rows with the siblings that an equijoin gives them."""
    zero = nodes.where(F.col("idx") % arity == 0).select("tree", F.col("idx").alias("base"))
    own = F.col("base")
    wanted = F.array(own, own.bitwiseXOR(F.lit(1))) if arity == 2 else F.sequence(own, own + (arity - 1))
    node = F.struct((F.col("idx") - own).cast("int").alias("slot"), *[c for c in nodes.columns if c not in ("tree", "idx")])
    met = zero.withColumn("idx", F.explode(wanted)).join(nodes, ["tree", "idx"])
    return met.groupBy("tree", "base").agg(F.array_sort(F.collect_list(node)).alias("nodes")).select("tree", F.expr(f"base div {arity}").alias("run"), "nodes")


def grow(nodes: DataFrame, arity: int = ARITY) -> tuple[DataFrame, list[DataFrame]]:
    """tree, depth and digest of each tree's root, and the stored runs of each level, from the leaves up.

    A tree that has come to its root goes on as a single node in the levels of the others; nothing reads it there.
    """
    powers = F.array(*[F.lit(arity**k) for k in range(63) if arity**k < 1 << 62])
    depth = F.size(F.filter(powers, lambda p: p < F.max("idx") + 1))
    trees = stored(nodes.groupBy("tree").agg(depth.alias("depth")), "merkle-trees")
    deepest = trees.agg(F.max("depth")).first()[0] or 0
    roots, levels, level = [], [], nodes
    for k in range(deepest + 1):
        top = level.where("idx = 0").select("tree", "digest")
        roots.append(top.join(trees.where(F.col("depth") == k), "tree").select("tree", "depth", "digest"))
        if k < deepest:
            made = stored(runs(level, arity), f"merkle-level{k}")
            levels.append(made)
            level = made.select("tree", F.col("run").alias("idx"), F.sha2(F.array_join(F.transform("nodes", lambda n: n["digest"]), ""), 256).alias("digest"))
    return stored(functools.reduce(DataFrame.unionByName, roots), "merkle-roots"), levels


def around(of: Column) -> Column:
    """A step of a proof: the digests before and after the node in its run."""

    def joined(which) -> Column:
        return F.array_join(F.transform(F.filter("nodes", lambda n: which(n["slot"])), lambda n: n["digest"]), "")

    return F.struct(joined(lambda slot: slot < of["slot"]).alias("left"), joined(lambda slot: slot > of["slot"]).alias("right"))


def descend(roots: DataFrame, levels: list[DataFrame], arity: int = ARITY) -> DataFrame:
    """The leaves' nodes (tree, node) with the columns of ``roots`` and ``steps``, the proof from the leaf up.

    ``roots`` has tree, depth, ``steps`` (of the root itself, upwards) and what else a leaf is to know of its tree.
    """
    known = [c for c in roots.columns if c not in ("tree", "depth", "steps")]
    nodes = None
    for k in reversed(range(len(levels))):
        made = levels[k]
        opened = made.where("run = 0").join(roots.where(F.col("depth") == k + 1), "tree").select("tree", "run", "nodes", "steps", *known)
        if nodes is not None:
            opened = opened.unionByName(made.join(nodes.withColumnRenamed("idx", "run").drop("node"), ["tree", "run"]).select("tree", "run", "nodes", "steps", *known))
        each = opened.withColumn("node", F.explode("nodes"))
        idx = F.col("run") * arity + F.col("node.slot")
        nodes = each.select("tree", idx.alias("idx"), "node", F.concat(F.array(around(F.col("node"))), "steps").alias("steps"), *known)
    return nodes


def proofs(docs: DataFrame, changed: Column | None = None, arity: int = ARITY, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The manifest: doc_id, leaf, other, subroot (of its source), root and steps array<struct<left, right>> of every row."""
    rows = leaves(docs, changed, columns)
    subroots, levels = grow(rows, arity)
    placed = running(in_order(subroots, [F.col("tree")], "merkle-sources"), F.lit(1), "idx")
    top = stored(placed.select(F.lit("").alias("tree"), "idx", "digest", F.col("tree").alias("of"), "depth"), "merkle-top")
    peak, above = grow(top.drop("of", "depth"), arity)
    none = F.array().cast(STEPS)
    over = peak.select("tree", "depth", F.col("digest").alias("root"), none.alias("steps"))
    if above:
        down = descend(over, above, arity).select("idx", "root", "steps")
        roots = top.drop("tree").join(down, "idx")
    else:
        roots = top.join(over.select("tree", "root", "steps"), "tree").drop("tree")  # one source: a row each
    roots = stored(roots.select(F.col("of").alias("tree"), "depth", F.col("digest").alias("subroot"), "root", "steps"), "merkle-paths")
    single = rows.where("idx = 0").join(roots.where("depth = 0"), "tree").select("doc_id", F.col("digest").alias("leaf"), "other", "subroot", "root", "steps")
    if not levels:
        return single
    below = descend(roots, levels, arity)
    return below.select("node.doc_id", F.col("node.digest").alias("leaf"), "node.other", "subroot", "root", "steps").unionByName(single)


def folded(leaf: Column, steps: str) -> Column:
    """The root that a leaf and the digests of a proof give."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def siblings(steps: str) -> Column:
    """All digests of a proof, from the leaf up, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def audit(docs: DataFrame, manifest: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """doc_id and verified of every row of the manifest against docs as they are now (doc_ids unique); a lost row is not verified."""
    now = docs.select(F.col("doc_id").alias("_id"), leaf_digest(*[F.col(f"`{c}`") for c in columns]).alias("_now"))
    met = manifest.join(now, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return met.select("doc_id", F.coalesce(folded(F.col("_now"), "steps") == F.col("root"), F.lit(False)).alias("verified"))


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, where each fifth row (by CRC) has its text lower-cased."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, LOWER))
    root = folded(F.coalesce("other", "leaf"), "steps")
    out = proofs(docs, changed).withColumn("folded_root", root)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("steps"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
