"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sources share a budget of words by weight; no source gets more than ``most`` times its size, and what is above goes to the
others by weight until none is above. A document of a source with target T is wanted e times, e in proportion to its
preference (1 if none is given) so that the wanted words of the source add up to T. It gets floor(e) copies for certain; for
the rest, pi = e - floor(e), documents are ranked by u / (1 - u) divided by pi / (1 - pi), u drawn by hash from the doc_id
(Rosen's Pareto sampling: a sample of fixed size with inclusion probabilities near pi). The sample's size is fixed in words: in this
order each document that still fits into what is left of the target is taken once; in the end the smallest one that is left is taken
too if that comes nearer. So a source misses its target by half of the smallest document with 0 < pi that was left at most.

A source is never handled by one task: rows are put in order by ranges (``common.in_order``), sums are taken over parts of it, and
the walk along the order takes few rounds. A round takes all documents up to the first that does not fit; the next one only regards
those that do.

Defined cases: null text has size 0 and takes nothing; a null source is a source of its own, the last; null doc_ids draw one number;
equal doc_ids are in order of size, and rows equal in both are interchangeable; a preference that is null, not a number or below 0
counts as 0, an infinite one is an error; a source without words, or with no preference above 0, has target 0 or takes nothing; other columns are
not read; an empty table gives an empty one. The number of sources is not bounded: they are a table, never a list on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, join_split, running, stored

#: Sources in order of code points weigh these, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix, in words of all documents.
SHARE = 1.5
#: Copies of a document, and size of a source in the mix, at most.
MOST = 2
SEED = 2024
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) with 52 bits of a hash of the seed and the key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("-"))), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def level(sizes: DataFrame, size: str, weight: str, budget: float, most: float) -> float:
    """The water level x at which min(most * size, weight * x) adds up to the budget; infinity where all are at their most."""
    cap, share = F.col(size) * F.lit(float(most)), F.col(weight)
    x, full = 0.0, -1
    while True:
        above = share * F.lit(x) > cap if full >= 0 else F.lit(False)
        row = sizes.agg(F.sum(F.when(above, cap)).alias("caps"), F.sum(F.when(~above, share).otherwise(0)).alias("shares"), F.count_if(above).alias("full")).first()
        if row["full"] == full:
            return x
        if not row["shares"]:
            return float("inf")
        x, full = (budget - (row["caps"] or 0.0)) / row["shares"], row["full"]


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (a row for each source: source, source_size and more) with the target of the source, stored."""
    ranked = running(in_order(sizes, [F.col("source").asc_nulls_last()], "mix-sources"), F.lit(1), "rank").drop("_stretch", "_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = stored(ranked.withColumn("weight", weight), "mix-weights")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    x = level(weighted, "source_size", "weight", share * total, most)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(x))
    return stored(weighted.withColumn("target", target).drop("rank", "weight"), "mix-targets")


def wanted(rows: DataFrame, of: DataFrame, total: int, most: float) -> DataFrame:
    """rows with ``e``: copies wanted of each, in proportion to ``preference``, at most ``most``, the target's words in all."""
    liked = F.col("preference") * F.col("size")
    mass = rows.groupBy("key").agg(F.sum(liked).alias("mass"))
    scale, seen = of.join(mass, "key").select("key", "n", "target", F.col("target").alias("left"), "mass"), -1
    while True:
        by = F.when(F.col("mass") > 0, F.greatest("left", F.lit(0.0)) / F.col("mass")).otherwise(float("inf"))  # else all are at their most
        scale = stored(scale.select("key", "n", "target", by.alias("scale")), "mix-scale")
        own = join_split(rows, scale.select("key", "n", "scale"), "key", "n", "doc_id", "size", total=total)
        e = F.when(liked > 0, F.col("preference") * F.col("scale")).otherwise(0.0)
        full = e >= most
        found = own.agg(F.count_if(full)).first()[0]
        if found == seen or not found:
            return own.withColumn("e", F.least(e, F.lit(float(most)))).drop("scale")
        seen = found
        rest = own.groupBy("key").agg(
            F.coalesce(F.sum(F.when(full, F.col("size") * F.lit(float(most)))), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, liked)), F.lit(0.0)).alias("mass"),
        )
        scale = scale.join(rest, "key").select("key", "n", "target", (F.col("target") - F.col("taken")).alias("left"), "mass")


def walk(ordered: DataFrame, left: DataFrame, total: int) -> DataFrame:
    """key, n and rounds: array<struct<after, upto, room>>, what to take along the order.

    A row is taken if its place (part, at) is after ``after`` and not beyond ``upto`` of a round of its source, and its size is
    within ``room``. ``left`` has for each key n and room: what is left of the target.
    """
    place = F.struct(F.col("_stretch").alias("part"), F.col("_at").alias("at"))
    start = F.struct(F.lit(-1).cast("long").alias("part"), F.lit(-1).cast("long").alias("at"))
    at = "struct<part:bigint,at:bigint>"
    none = F.array().cast(f"array<struct<after:{at},upto:{at},room:double>>")
    state = stored(left.select("key", "n", F.col("room").cast("double").alias("room"), start.alias("after"), none.alias("rounds"), (F.col("room") >= 1).alias("open")), "mix-round")
    while not state.where("open").isEmpty():
        near = join_split(ordered, state.where("open").select("key", "n", "room", "after"), "key", "n", "doc_id", "size", total=total)
        fits = near.where((place > F.col("after")) & (F.col("size") <= F.col("room")))
        summed = running(fits, F.col("size"), "before", "key")
        took = summed.where(F.col("before") + F.col("size") <= F.col("room")).groupBy("key").agg(F.sum("size").alias("took"), F.max(place).alias("upto"))
        found = F.col("took").isNotNull()
        state = state.join(took, "key", "left").select(
            "key",
            "n",
            F.when(found, F.concat("rounds", F.array(F.struct("after", "upto", "room")))).otherwise(F.col("rounds")).alias("rounds"),
            (F.col("room") - F.coalesce("took", F.lit(0))).alias("room"),
            F.coalesce("upto", "after").alias("after"),
            (found & (F.col("room") - F.col("took") >= 1)).alias("open"),
        )
        state = stored(state, "mix-round")
    # nearer to the target with the smallest row that is left, though it goes beyond?
    rest = join_split(ordered, state.select("key", "n", "room", "rounds"), "key", "n", "doc_id", "size", total=total)
    rest = rest.where(~taken("rounds") & (F.col("size") < 2 * F.col("room")))
    last = rest.groupBy("key").agg(F.min(F.struct("size", "_stretch", "_at")).alias("least"))
    part, spot = F.col("least._stretch"), F.col("least._at")
    one = F.struct(F.struct(part, spot - 1), F.struct(part, spot), F.col("least.size").cast("double"))
    more = F.when(F.col("least").isNotNull(), F.concat("rounds", F.array(one).cast(f"array<struct<after:{at},upto:{at},room:double>>"))).otherwise(F.col("rounds"))
    return state.join(last, "key", "left").select("key", "n", more.alias("rounds"))


def taken(rounds: str) -> Column:
    """Whether a round takes the row."""
    place = F.struct(F.col("_stretch").alias("part"), F.col("_at").alias("at"))
    return F.exists(rounds, lambda r: (place > r["after"]) & (place <= r["upto"]) & (F.col("size") <= r["room"]))


def mix(
    docs: DataFrame, preference: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """doc_id, source, size, source_size, target (of its source) and copies (whole ones the mix takes) of every row."""
    liked = F.lit(1.0) if preference is None else F.when(F.isnan(preference) | (preference < 0), 0.0).otherwise(F.coalesce(preference, F.lit(0.0))).cast("double")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # joins want keys that are not null
    sized = stored(docs.select(F.col("doc_id"), F.col("source"), key.alias("key"), n_words(F.col("text")).alias("size"), liked.alias("preference")), "mix-sizes")
    of = targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most)
    total = of.agg(F.sum("n")).first()[0] or 0
    of = of.drop("source")
    rows = join_split(sized, of, "key", "n", "doc_id", "size", total=total)
    if preference is None:
        rows = rows.withColumn("e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    else:
        rows = wanted(rows, of, total, most)
    u, pi = uniform(F.col("doc_id"), seed), F.col("e") - F.floor("e")
    odds = F.when((pi > 0) & (F.col("size") > 0), (u / (1 - u)) / (pi / (1 - pi)))
    ranked = rows.select("doc_id", "source", "key", "size", "source_size", "target", F.floor("e").cast("long").alias("whole"), odds.alias("odds"))
    ordered = in_order(ranked, [F.col(c) for c in ("key", "odds", "doc_id", "size")], "mix-order")
    certain = ordered.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    left = of.join(certain, "key").select("key", "n", (F.col("target") - F.col("certain")).alias("room"))
    rounds = walk(ordered.where(F.col("odds").isNotNull()), left, total)
    hit = F.col("odds").isNotNull() & taken("rounds")
    done = join_split(ordered, rounds, "key", "n", "doc_id", "size", total=total)
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + hit.cast("long")).alias("copies"))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes its doc_id (which must be unique there)."""
    copies = mixed.where("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    taken = docs.join(copies, F.col("doc_id") == F.col("_id")).drop("_id")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def mix_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words that the mix takes of each document, repeats counted."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
