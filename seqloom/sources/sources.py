"""Where sequences come from: literals, lists, tables, FASTA files, degenerate patterns, motifs, k-mers."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import BASES, IUPAC_TO_DNA, reverse_complement_column, strip_tags
from ..plans import styles
from ..plans.pool import Operation, Pool, as_pool, get_session, make, regions_in
from ..plans.states import LITERAL
from .scratch import scratch_path


def _within(pool: Pool | str | None, region: str | Sequence[int] | None) -> list[Pool]:
    """The parent whose region a source fills."""
    if (pool is None) != (region is None):
        raise ValueError("pool and region go together")
    return [] if pool is None else [as_pool(pool)]


def _styled(pool: Pool, style: str | None) -> Pool:
    if style is None:
        return pool
    from ..operators.fixed import stylize

    return stylize(pool, style=style)


def _painted(op: Operation, style: str | None) -> None:
    """All that the source makes is new, and has the style."""
    op.follow, op.style = styles.blank, style
    if style is not None:
        op.paint = lambda run, seqs, out, state: [(style, styles.fill(F.length(out), 1))]


def from_seq(seq: str, pool: Pool | str | None = None, region=None, remove_tags: bool | None = None, style: str | None = None, iter_order: int | None = None, prefix: str | None = None, name: str | None = None) -> Pool:
    """One constant sequence; its tags become regions."""
    parents = _within(pool, region)
    found = regions_in(seq, get_session())
    op = Operation(parents, factory="from_seq", prefix=prefix, iter_order=iter_order, region=region, remove_tags=bool(remove_tags), build=lambda run, args, s: F.lit(seq))
    op.follow = styles.blank
    return _styled(make(op, len(strip_tags(seq)), name, found, template=None if parents else seq), style)


def lookup(values: Sequence[str], index: Column) -> Column:
    """values[index] from literal arrays (in pieces when there are many)."""
    pieces = [values[i : i + LITERAL] for i in range(0, len(values), LITERAL)]
    arrays = [F.element_at(F.array(*map(F.lit, p)), (index % LITERAL + 1).cast("int")) for p in pieces]
    out = arrays[-1]
    for i in range(len(pieces) - 2, -1, -1):
        out = F.when(index < (i + 1) * LITERAL, arrays[i]).otherwise(out)
    return out


def from_seqs(seqs: Sequence[str], pool: Pool | str | None = None, region=None, style: str | None = None, seq_names: Sequence[str] | None = None, prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, name: str | None = None, remove_tags: bool | None = None) -> Pool:
    """A list: in order (sequential), one drawn for each row (random) or exactly one (fixed)."""
    seqs, n = list(seqs), len(seqs)
    if not n:
        raise ValueError("seqs must not be empty")
    if mode == "fixed" and n != 1:
        raise ValueError("fixed mode takes one sequence")
    if seq_names is not None and prefix is not None:
        raise ValueError("seq_names and prefix exclude each other")
    if seq_names is not None and len(seq_names) != n:
        raise ValueError("seq_names must be as many as seqs")
    names = list(seq_names) if seq_names is not None else [f"seq_{i}" for i in range(n)]
    parents = _within(pool, region)
    found = dict.fromkeys(r for s in seqs for r in regions_in(s, get_session()))

    def build(run, args, s):
        i = s % n
        return lookup(seqs, i), {"seq_name": lookup(names, i), "seq_index": i}

    def sample(run, args, draws):
        return build(run, args, run.add(f"_p{run.op.id}", draws.below(n, 0).cast("long")))

    def contributes(run, state):
        shown = run.card(run.op, "seq_name") if "seq_name" in run.cards[run.op] else lookup(names, state % n)
        return [F.when(state.isNotNull(), shown)]

    op = Operation(
        parents,
        factory="from_seqs",
        mode=mode,
        num_states=(num_states or n) if mode == "sequential" else num_states,
        natural=n,
        prefix=prefix,
        iter_order=iter_order,
        region=region,
        remove_tags=bool(remove_tags),
        build=build,
        sample=sample,
        cards={"seq_name": "string", "seq_index": "long"},
        name_parts=contributes if seq_names is not None else None,
    )
    _painted(op, style)
    lengths = {len(strip_tags(s)) for s in seqs}
    return make(op, lengths.pop() if len(lengths) == 1 else None, name, found)


class TableOp(Operation):
    """Rows of a DataFrame by a contiguous index; the state is joined to it (a hash or merge join, as Spark chooses)."""

    factory = "from_table"
    most_states = None

    def __init__(self, table: DataFrame, rows: int, parents: Sequence[Pool] = (), **options):
        self.table, self.rows = table, rows
        super().__init__(parents, mode="sequential", cards={"seq_index": "long", "seq_name": "string"}, **options)

    def columns(self) -> DataFrame:
        return self.table.select(*[F.col(c).alias(f"_t{self.id}{c[0]}") for c in ("idx", "seq", "name")])

    def build(self, run, args, s):
        key, seq, name = (f"_t{self.id}{x}" for x in "isn")
        if key not in run.df.columns:
            run.df = run.df.join(self.columns(), s % self.rows == F.col(key), "left")
        return F.col(seq), {"seq_index": F.col(key), "seq_name": F.col(name)}

    def name_parts(self, run, state, most):
        if self.prefix is not None:
            return super().name_parts(run, state, most)
        return [F.when(state.isNotNull(), F.col(f"_t{self.id}n"))]


def indexed(df: DataFrame) -> tuple[DataFrame, int]:
    """df with a contiguous ``idx`` in its present order; only a count for each partition reaches the driver.

    df must give the same rows in the same partitions each time (a stored table does).
    """
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    sizes = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    at, before = 0, []
    for p in sorted(sizes):
        before.append((p, at))
        at += sizes[p]
    starts = df.sparkSession.createDataFrame(before, "_p long, _start long")  # a row for each partition
    placed = marked.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return placed.withColumn("idx", F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_start"), at


def from_table(df: DataFrame, seq_col: str = "seq", name_col: str | None = None, index_col: str | None = None, num_rows: int | None = None, seq_length: int | None = None, regions: Sequence[str] = (), prefix: str | None = None, iter_order: int | None = None, num_states: int | None = None, name: str | None = None, plain: bool = False) -> Pool:
    """The rows of a DataFrame as sequential states. ``index_col`` holds 0..n-1 where the table has it already.

    ``plain`` states that sequences are of A, C, G and T alone, which makes for simpler plans.
    """
    cols = [F.col(seq_col).alias("seq"), (F.col(name_col) if name_col else F.lit(None).cast("string")).alias("name")]
    if index_col is not None:
        table = df.select(*cols, F.col(index_col).cast("long").alias("idx"))
        rows = table.count() if num_rows is None else num_rows
    else:
        table, rows = indexed(df.select(*cols))
    if not rows:
        raise ValueError("the table is empty")
    for r in regions:
        if r not in get_session().regions:
            get_session().register_region(r, None)
    op = TableOp(table, rows, num_states=num_states or rows, natural=rows, prefix=prefix, iter_order=iter_order)
    out = Pool(op, seq_length, name, regions=regions)
    out.plain = plain
    return out


def fasta_pieces(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, seq: the lines of FASTA files (a file or a folder) with the place in its record that each begins at.

    A file is read in splits. Places are counted within each split and over the splits of a file, of which there is a row each.
    """
    file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select(file, block, F.monotonically_increasing_id().alias("id"), F.trim("value").alias("line")).where("line <> ''")
    head = F.startswith("line", F.lit(">"))
    sized = lines.withColumn("n", F.when(head, 0).otherwise(F.length("line")).cast("long"))
    split = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = sized.withColumn("upto", F.sum("n").over(split))
    start = F.when(head, F.struct(F.regexp_extract("line", r"^>\s*(\S*)", 1).alias("chrom"), F.col("upto").alias("at")))
    within = counted.withColumn("record", F.last(start, True).over(split))
    # what each split begins with: the bases before it in its file, and the record that the splits before it end in
    totals = within.groupBy("file", "block").agg(F.sum("n").alias("bases"), F.max_by("record", "id").alias("record"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("bases").over(before), F.lit(0)))
    ends = F.when(F.col("record").isNotNull(), F.struct(F.col("record.chrom").alias("chrom"), (F.col("base") + F.col("record.at")).alias("at")))
    carried = totals.select("file", "block", "base", F.last(ends, True).over(before).alias("carried"))
    placed = within.where(~head).join(carried, ["file", "block"])
    first = F.when(F.col("record").isNotNull(), F.col("base") + F.col("record.at")).otherwise(F.col("carried.at"))
    return placed.select(F.coalesce("record.chrom", "carried.chrom").alias("chrom"), (F.col("base") + F.col("upto") - F.col("n") - first).alias("pos"), F.col("line").alias("seq"))


#: Bases of a block: pieces and intervals meet by the blocks that they touch.
FASTA_BLOCK = 10_000


def fasta_intervals(genome: DataFrame, coordinates: DataFrame) -> DataFrame:
    """coordinates (chrom, start, stop, strand; 0-based, half-open) with their seq; start > stop wraps about the origin.

    ``genome`` has pieces (chrom, pos, seq), or whole sequences without pos. Only the pieces that an interval touches meet it.
    """
    pieces = genome if "pos" in genome.columns else genome.select("chrom", F.lit(0).cast("long").alias("pos"), "seq")
    lengths = pieces.groupBy("chrom").agg(F.max(F.col("pos") + F.length("seq")).alias("_n"))
    key = ["chrom", "start", "stop", "strand"]
    known = coordinates.join(lengths, "chrom")
    a, b, n = F.col("start").cast("long"), F.col("stop").cast("long"), F.col("_n")
    part = lambda i, x, y: F.struct(F.lit(i).alias("part"), x.alias("a"), F.least(y, n).alias("b"))
    parts = F.when(a <= b, F.array(part(0, a, b))).otherwise(F.array(part(0, a, n), part(1, F.lit(0).cast("long"), b)))
    blocks = lambda x, y: F.sequence(F.floor(x / FASTA_BLOCK), F.floor((y - 1) / FASTA_BLOCK))
    wanted = known.select(*key, "_n").distinct().select(*key, F.inline(parts)).where("a < b").withColumn("block", F.explode(blocks(F.col("a"), F.col("b"))))
    size = F.length("seq")
    dealt = pieces.where(size > 0).select("chrom", "pos", "seq", F.explode(blocks(F.col("pos"), F.col("pos") + size)).alias("block"))
    lo, hi = F.greatest("a", "pos"), F.least(F.col("b"), F.col("pos") + size)
    met = wanted.join(dealt, ["chrom", "block"]).where((lo < hi) & (F.col("block") == F.floor(lo / FASTA_BLOCK)))  # once, where they first meet
    cut = F.struct("part", lo.alias("at"), F.col("seq").substr((lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int")).alias("seq"))
    found = met.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cut)), lambda x: x["seq"]), "").alias("seq"))
    whole = known.drop("_n").join(found, key, "left").withColumn("seq", F.coalesce("seq", F.lit("")))
    return whole.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement_column(F.col("seq"))).otherwise(F.col("seq")))


def from_fasta(fasta_path: str, coordinates, pool: Pool | str | None = None, region=None, remove_tags: bool | None = None, iter_order: int | None = None, prefix: str | None = None, style: str | None = None, name: str | None = None, spark: SparkSession | None = None) -> Pool:
    """Intervals of a genome: one tuple gives a constant, a list sequential states named ``chrom:start-stop(strand)``.

    The sequences of a list stay a table in the shared folder.
    """
    spark = spark or SparkSession.getActiveSession()
    single = isinstance(coordinates, tuple) and isinstance(coordinates[0], str)
    rows = [coordinates] if single else list(coordinates)
    if any(r[3] not in "+-" for r in rows):
        raise ValueError("strand is + or -")
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, chrom string, start long, stop long, strand string")
    title = F.format_string(f"{prefix + '_' if prefix else ''}%s:%d-%d(%s)", "chrom", "start", "stop", "strand")
    path = scratch_path(spark, "fasta")
    fasta_intervals(fasta_pieces(spark, fasta_path), frame).select(F.col("i").alias("idx"), "seq", title.alias("name")).write.parquet(path)
    table = spark.read.parquet(path)
    many, least, most = table.agg(F.count(F.lit(1)), F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if many < len(rows):
        unknown = frame.join(table.select(F.col("idx").alias("i")), "i", "left_anti").select("chrom").distinct().limit(10).collect()
        raise ValueError(f"unknown chromosome in {sorted(r['chrom'] for r in unknown)}")
    if single:
        return from_seq(table.first()["seq"], pool, region, remove_tags, style, iter_order, prefix, name)
    op = TableOp(table, many, _within(pool, region), num_states=many, natural=many, region=region, remove_tags=bool(remove_tags), iter_order=iter_order)
    return _styled(make(op, most if least == most else None, name), style)


def from_iupac(iupac_seq: str, pool: Pool | str | None = None, region=None, prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, style: str | None = None, name: str | None = None, remove_tags: bool | None = None) -> Pool:
    """All sequences of a degenerate pattern, the last position fastest."""
    options = []
    for c in iupac_seq:
        if c.upper() in IUPAC_TO_DNA:
            own = IUPAC_TO_DNA[c.upper()]
            options.append([x.lower() for x in own] if c.islower() else own)
        elif c.isalpha():
            raise ValueError(f"{c!r} is no IUPAC code")
        else:
            options.append([c])
    total = prod(map(len, options))
    strides = [prod(map(len, options[i + 1 :])) for i in range(len(options))]

    def build(run, args, s):
        v = s % total if total < 1 << 63 else s
        chars = [F.lit(o[0]) if len(o) == 1 else F.substring(F.lit("".join(o)), 1, 1) if t >= 1 << 63 else F.lit("".join(o)).substr((F.call_function("div", v, F.lit(t)) % len(o) + 1).cast("int"), F.lit(1)) for o, t in zip(options, strides)]
        return F.concat(*chars), {"iupac_state": v}

    def sample(run, args, draws):
        if total <= 1 << draws.BITS:
            return build(run, args, draws.below(total, 0).cast("long"))
        chars = [F.lit(o[0]) if len(o) == 1 else F.lit("".join(o)).substr(draws.below(len(o), 0, i) + 1, F.lit(1)) for i, o in enumerate(options)]
        return F.concat(*chars), {"iupac_state": F.lit(None).cast("long")}  # too many states for a number

    op = Operation(_within(pool, region), factory="from_iupac", mode=mode, num_states=(num_states or total) if mode == "sequential" else num_states, natural=total, prefix=prefix, iter_order=iter_order, region=region, remove_tags=bool(remove_tags), build=build, sample=sample, cards={"iupac_state": "long"})
    _painted(op, style)
    return make(op, len(iupac_seq), name)


def from_motif(prob_df, pool: Pool | str | None = None, region=None, prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, style: str | None = None, name: str | None = None, remove_tags: bool | None = None) -> Pool:
    """Draw each position from its row of a probability matrix (columns among A, C, G and T; missing ones are 0)."""
    if mode != "random":
        raise ValueError("from_motif is random only")
    import pandas as pd

    table = pd.DataFrame(prob_df)
    if not len(table) or not len(table.columns) or set(table.columns) - set(BASES):
        raise ValueError("columns must be among A, C, G and T, and rows there must be")
    p = table.reindex(columns=BASES, fill_value=0.0).to_numpy(float)
    if np.isnan(p).any() or (p < 0).any() or (p.sum(axis=1) == 0).any():
        raise ValueError("probabilities must be numbers of 0 or more, and not all 0 in a row")
    upto = np.cumsum(p / p.sum(axis=1, keepdims=True), axis=1)
    upto[:, -1] = 1.0

    def sample(run, args, draws):
        # a base for each position: as many bounds (all but the last) as are not above the number drawn
        bounds = F.array(*[F.array(*[F.lit(int(x * (1 << draws.BITS))).cast("long") for x in row[:-1]]) for row in upto.tolist()])
        drawn = F.transform(F.sequence(F.lit(0), F.lit(len(upto) - 1)), lambda i: F.struct(F.get(bounds, i).alias("bounds"), draws.long(0, i).alias("u")))
        state = run.add(f"_p{run.op.id}", F.transform(drawn, lambda x: F.size(F.filter(x["bounds"], lambda b: b <= x["u"]))))
        return F.array_join(F.transform(state, lambda x: F.lit("".join(BASES)).substr(x + 1, F.lit(1))), ""), {"prob_state": state}

    op = Operation(_within(pool, region), factory="from_motif", mode="random", num_states=num_states, prefix=prefix, iter_order=iter_order, region=region, remove_tags=bool(remove_tags), sample=sample, cards={"prob_state": "array<int>"})
    _painted(op, style)
    return make(op, len(p), name)


def _kmer(value: Column, length: int, letters: str) -> Column:
    """The bases of a number, two bits each, the last one fastest."""
    digits = F.sequence(F.lit(length - 1), F.lit(0))
    return F.array_join(F.transform(digits, lambda i: F.lit(letters).substr((F.call_function("shiftright", value, (i * 2).cast("int")).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))), "")


def get_kmers(length: int, pool: Pool | str | None = None, region=None, style: str | None = None, case: str = "upper", prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, name: str | None = None, remove_tags: bool | None = None) -> Pool:
    """All k-mers, the last base fastest, or one drawn base by base."""
    if length < 1:
        raise ValueError("length must be 1 or more")
    if case not in ("upper", "lower"):
        raise ValueError("case is upper or lower")
    letters = "ACGT" if case == "upper" else "acgt"
    total = 4**length

    def build(run, args, s):
        v = s % total if length < 31 else s
        kmer = _kmer(v, length, letters)
        return kmer, {"kmer_index": v, "kmer": kmer}

    def sample(run, args, draws):
        # a number of 62 bits gives 31 bases
        pieces = [_kmer(draws.below(4 ** min(31, length - i), 0, i // 31).cast("long"), min(31, length - i), letters) for i in range(0, length, 31)]
        kmer = F.concat(*pieces)
        return kmer, {"kmer_index": F.lit(None).cast("long"), "kmer": kmer}

    op = Operation(_within(pool, region), factory="get_kmers", mode=mode, num_states=(num_states or total) if mode == "sequential" else num_states, natural=total, prefix=prefix, iter_order=iter_order, region=region, remove_tags=bool(remove_tags), build=build, sample=sample, cards={"kmer_index": "long", "kmer": "string"})
    _painted(op, style)
    out = make(op, length, name)
    out.plain = pool is None
    return out


#: Rows of a pool that ``materialize`` numbers together; a count for each such block reaches the driver.
KEPT_BLOCK = 100_000


def materialize(pool: Pool, num_seqs: int | None = None, num_cycles: int | None = None, seed: int | None = None, discard_null_seqs: bool = True, max_iterations: int | None = None, min_acceptance_rate: float | None = None, attempts_per_rate_assessment: int = 100, name: str | None = None, prefix: str | None = None, path: str | None = None) -> Pool:
    """Run a pool now, keep its rows as a stored table and go on from there without its plan.

    The table is written to ``path``, or to the folder in ``spark.checkpoint.dir``.
    """
    if (num_seqs is None) == (num_cycles is None):
        raise ValueError("give num_seqs or num_cycles")
    from ..plans.runner import generate_library

    count = num_seqs if num_seqs is not None else num_cycles * pool.num_states
    df = generate_library(pool, num_seqs=count, seed=seed, init_state=0, discard_null_seqs=discard_null_seqs, max_iterations=max_iterations, min_acceptance_rate=min_acceptance_rate, attempts_per_rate_assessment=attempts_per_rate_assessment, with_index=True)
    path = path or scratch_path(df.sparkSession, "pool")
    # places within blocks of rows are stored with them, as a later run of a plan need not cut its partitions at the same rows
    block = F.call_function("div", F.col("_row").cast("long"), F.lit(KEPT_BLOCK).cast("long"))
    df.withColumn("_block", block).withColumn("_place", F.row_number().over(Window.partitionBy("_block").orderBy("_row"))).write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    starts, rows = [], 0
    for r in kept.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).orderBy("_block").collect():
        starts.append((r["_block"], rows))
        rows += r["n"]
    if not rows:
        raise ValueError("no sequences to keep")
    before = df.sparkSession.createDataFrame(starts, "_block long, _start long")  # a row for each block
    table = kept.join(F.broadcast(before), "_block").withColumn("idx", F.col("_start") + F.col("_place") - 1)
    op = TableOp(table.select("idx", "seq", "name"), rows, num_states=rows, natural=rows, prefix=prefix)
    op.factory = "materialize"
    return Pool(op, pool.seq_length, name, regions=pool.regions, kind=pool.kind)
