"""From a pool to a DataFrame: a range of row indices, state columns, then a projection for each operation."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import strip_tags_column
from . import states as st
from .pool import Operation, Pool
from .styles import gathered
from .tags import nontag_positions, parts


def sorted_operations(pools: Sequence[Pool]) -> list[Operation]:
    """Parents before children."""
    out: dict[Operation, None] = {}

    def visit(p: Pool) -> None:
        if p.operation not in out:
            for q in p.parents:
                visit(q)
            out[p.operation] = None

    for p in pools:
        visit(p)
    return list(out)


def all_pools(pools: Sequence[Pool]) -> list[Pool]:
    out: dict[Pool, None] = {}

    def visit(p: Pool) -> None:
        for q in p.parents:
            visit(q)
        out[p] = None

    for p in pools:
        visit(p)
    return sorted(out, key=lambda p: p.id)


class Run:
    """The DataFrame while it is put together."""

    def __init__(self, base: DataFrame, pool: Pool, others: Sequence[Pool], seed: int, styled: bool = False, offset: int = 0):
        """``base`` holds the row indices, less the offset, in column id, and maybe what tables have for them. ``styled``: follow styles too."""
        self.seed, self.pool, self.styled = seed, pool, styled
        self.layers: dict[Operation, dict[tuple, tuple[str, Column]]] = {}
        n = pool.state.num_values
        self.row = F.col("_row")
        more = [c for c in base.columns if c.startswith("_t")]
        row = (F.col("id") + st.number(offset)).cast(st.DECIMAL) if offset else F.col("id")
        #: row indices as a key of random draws
        self.row_key = (self.row % st.number(1 << 62)).cast("long") if offset else self.row
        self.df = base.select(row.alias("_row"), (row % st.number(n) if n <= st.LONG else row).cast(st.kind_of(n)).alias("_v"), *more)
        self.ops = sorted_operations([pool, *others])
        self.pools = all_pools([pool, *others])
        wanted = {o.state for o in self.ops} | {p.state for p in self.pools}
        joined = st.Joined(self.df)
        found = st.columns(pool.state, F.col("_v"), joined)
        self.df = joined.df.select("_row", *more, *[c.cast(st.kind_of(s.num_values)).alias(f"_s{s.id}") for s, c in found.items() if s in wanted])
        self.known = {s for s in found if s in wanted}
        self.cards: dict[Operation, list[str]] = {}
        #: what an operation has worked out for its sequences and needs again for their styles
        self.plans: dict[Operation, tuple] = {}
        #: what stands before, in and after a tag that an operation has just put in
        self.pieces: dict[tuple[Operation, str], tuple[Column, Column, Column]] = {}
        for op in self.ops:
            self.op = op
            args = [self.seq(p) for p in op.parents]
            seq, cards = op.evaluate(self, args, F.coalesce(self.state(op.state), F.lit(0).cast("long")))
            shown = {k: c for k, c in cards.items() if op.session.config.cards.get(op.factory, {}).get(k, True)}
            self.df = self.df.withColumns({f"_q{op.id}": seq} | {f"_c{op.id}.{k}": F.when(self.state(op.state).isNotNull() & seq.isNotNull(), c) for k, c in shown.items()})
            self.cards[op] = list(shown)
            if styled:
                out = F.col(f"_q{op.id}")
                made = op.layers(self, args, out, F.coalesce(self.state(op.state), F.lit(0).cast("long")), [self.layers[p.operation] for p in op.parents])
                named = {f"_y{op.id}.{i}": mask for i, (_, mask) in enumerate(made.values())}
                self.df = self.df.withColumns({k: F.when(out.isNotNull(), mask) for k, mask in named.items()})
                self.layers[op] = {k: (spec, F.col(f"`{c}`")) for (k, (spec, _)), c in zip(made.items(), named)}

    def parts(self, pool: Pool, seq: Column, region: str) -> tuple[Column, Column, Column]:
        """What stands before, in and after a region: as it was put in, or by its tags."""
        key = pool.operation, region
        if key not in self.pieces:  # columns of their own, as they are found by regular expressions and used many times
            self.pieces[key] = tuple(self.add(f"_z{pool.operation.id}_{region}_{i}", x) for i, x in enumerate(parts(seq, region)))
        return self.pieces[key]

    def add(self, name: str, column: Column) -> Column:
        self.df = self.df.withColumn(name, column)
        return F.col(name)

    def keeper(self):
        """For the present operation: keep(name, column) adds a column of its own and gives it back."""
        op = self.op
        return lambda name, value: self.add(f"_k{op.id}.{name}".replace(".", "_"), value)

    def state(self, s: st.State) -> Column:
        return F.col(f"_s{s.id}") if s in self.known else F.lit(None).cast("long")

    def seq(self, p: Pool) -> Column:
        return F.col(f"_q{p.operation.id}")

    def card(self, op: Operation, key: str) -> Column:
        return F.col(f"`_c{op.id}.{key}`")

    def name(self, most: int) -> Column | None:
        """The names of the rows; None if no operation adds to them."""
        pieces = []
        for op in sorted_operations([self.pool]):
            self.op = op
            pieces += op.name_parts(self, self.state(op.state), most)
        return F.nullif(F.concat_ws(".", *pieces), F.lit("")) if pieces else None


#: Most rows that one row of a table is expanded to in place.
EXPAND = 1_000_000
#: Blocks that are counted at a time to find where a number of sequences is reached; a count for each reaches the driver.
BLOCKS = 1000
#: From how many rows on the table is dealt out anew first, so that all cores expand it; with fewer, where so many rows in all have fewer
#: partitions than there are cores. Most rows of a partition then.
DEAL, MANY, DEALT = 8, 20_000, 8_000_000


def spans(state: st.State, op: Operation) -> list[tuple[int, int, int]] | None:
    """Where a table's rows stand in the index of a state: (first, step, many) says that row k has the ``many`` indices from first + k * step on.

    None where they do not stand together: the table has to be the slowest factor of each branch.
    """
    if op.state in state.group:
        whole = len(state.group) == 2 and state.num_values == op.rows == op.state.num_values
        return [(0, 1, 1)] if whole else None
    if len(state.group) > 1 or state.kind not in ("product", "stack"):
        return None
    if state.kind == "product":
        *faster, slowest = state.parents
        found = spans(slowest, op)
        if found is None or any(op.state in p.get_ancestors() for p in faster):
            return None
        inner = prod(p.num_values for p in faster)
        return [(a * inner, b * inner, n * inner) for a, b, n in found]
    out, at = [], 0
    for p in state.parents:
        found = spans(p, op)
        if found is None:
            return None
        out += [(a + at, b, n) for a, b, n in found]
        at += p.num_values
    return out


def table_rows(pool: Pool, start: int, count: int, partitions: int | None) -> DataFrame | None:
    """Row indices from the rows of a table: where a table is the slowest factor (of each branch of a stack, if there is one) and all rows
    are wanted, each of its rows is expanded where it stands, and nothing is joined."""
    tables = [op for op in sorted_operations([pool]) if hasattr(op, "table")]
    if start or count != pool.num_states or len(tables) != 1:
        return None
    op = tables[0]
    found = spans(pool.state, op)
    if found is None:
        return None
    inner = sum(n for _, _, n in found)
    if inner > EXPAND or inner * op.rows != count:
        return None
    rows = op.columns()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if inner >= DEAL or count >= MANY and rows.rdd.getNumPartitions() < cores:
        dealt = partitions or max(cores * 2, -(-count // DEALT))
        rows = rows.repartitionByRange(dealt, rows.columns[0]).sortWithinPartitions(rows.columns[0])
    key = F.col(rows.columns[0])
    if found == [(0, 1, 1)]:
        return rows.select("*", key.alias("id"))
    made = [F.sequence(key * step + first, key * step + (first + n - 1)) for first, step, n in found]
    return rows.select("*", F.explode(F.concat(*made) if len(made) > 1 else made[0]).alias("id"))


def generate_library(
    pool: Pool,
    num_cycles: int = 1,
    num_seqs: int | None = None,
    seed: int | None = None,
    init_state: int | None = None,
    seqs_only: bool = False,
    report_design_cards: bool = False,
    aux_pools: Sequence[Pool] = (),
    pools_to_report: str | Sequence[Pool] = "all",
    organize_columns_by: str = "type",
    discard_null_seqs: bool = False,
    max_iterations: int | None = None,
    min_acceptance_rate: float | None = None,
    attempts_per_rate_assessment: int = 100,
    *,
    report_styles: bool = False,
    spark: SparkSession | None = None,
    partitions: int | None = None,
    with_index: bool = False,
) -> DataFrame | list[str]:
    """One row for each index: ``name`` and ``seq``, with provenance columns if asked for.

    Row i depends on the plan, the seed and i alone. A later call without ``init_state`` goes on where the last ended.
    ``report_styles`` adds ``styles``, array<struct<spec, positions>>: which characters of seq (tags included) have which style.
    """
    if discard_null_seqs and num_seqs is None:
        raise ValueError("discard_null_seqs needs num_seqs")
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    count = num_cycles * pool.num_states if num_seqs is None else num_seqs
    if init_state is not None:
        pool.cursor = init_state
    if seed is not None or pool.seed is None:
        pool.seed = seed or 0
    start = pool.cursor

    far = start + count > st.LONG  # beyond what a range of longs reaches

    def rows(a: int, n: int) -> DataFrame:
        if far:
            return spark.range(0, n, 1, partitions) if partitions else spark.range(0, n)
        found = table_rows(pool, a, n, partitions) if not aux_pools else None
        if found is not None:
            return found
        return spark.range(a, a + n, 1, partitions) if partitions else spark.range(a, a + n)

    shown = lambda a, n: _select(Run(rows(a, n), pool, aux_pools, pool.seed, report_styles and not pool.session.config.suppress_styles, a if far else 0), pool, start + count - 1, report_design_cards, aux_pools, pools_to_report, organize_columns_by, report_styles)
    if discard_null_seqs:
        df, tried = _first(shown, start, count, pool, max_iterations, min_acceptance_rate, attempts_per_rate_assessment)
    else:
        df, tried = shown(start, count), count
    pool.cursor = start + tried
    if not with_index:
        df = df.drop("_row")
    return [r["seq"] for r in df.select("seq").collect()] if seqs_only else df


def _first(shown, start: int, count: int, pool: Pool, most: int | None, least_rate: float | None, every: int) -> tuple[DataFrame, int]:
    """The first ``count`` rows with a sequence: growing ranges are counted until there are enough, then one is read."""
    states = pool.num_states
    most = most or (states if states > 1 else count * 100)
    limit = min(most, states) if states > 1 else most
    size, tried, valid = min(limit, max(count * 2, every)), 0, 0
    while True:
        ok = F.col("seq").isNotNull()
        if least_rate is not None:
            blocks = {r["b"]: r["n"] for r in shown(start + tried, size).where(ok).groupBy(F.floor((F.col("_row") - st.number(start)).cast("long") / every).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
            for b in range(tried // every, (tried + size) // every):
                valid += blocks.get(b, 0)
                if valid >= count:
                    break
                if valid / ((b + 1) * every) < least_rate:
                    warnings.warn(f"acceptance rate {valid / ((b + 1) * every):.1%} is below {least_rate:.1%} after {(b + 1) * every} rows", stacklevel=3)
                    return shown(start, (b + 1) * every).where(ok), (b + 1) * every
        else:
            valid += shown(start + tried, size).where(ok).count()
        tried += size
        if valid >= count or tried >= limit:
            break
        size = min(limit - tried, max(every, 2 * tried))
    if valid < count:
        warnings.warn(f"only {valid} of {count} sequences after {tried} rows", stacklevel=3)
    else:
        tried = _end(shown, start, tried, count)
    return shown(start, tried).where(F.col("seq").isNotNull()), tried


def _end(shown, start: int, size: int, count: int) -> int:
    """How many rows from start on hold ``count`` sequences: blocks are counted, then smaller ones within that where it happens."""
    at = 0
    while size > 1:
        step = -(-size // BLOCKS)
        block = F.floor((F.col("_row") - st.number(start + at)).cast("long") / step)
        sizes = shown(start + at, size).where(F.col("seq").isNotNull()).groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        for b, n in sorted((r["b"], r["n"]) for r in sizes):
            if n >= count:
                at, size = at + b * step, min(step, size - b * step)
                break
            count -= n
    return at + size


def _select(run: Run, pool: Pool, most: int, cards: bool, aux: Sequence[Pool], to_report: str | Sequence[Pool], by: str, styled: bool = False) -> DataFrame:
    config = pool.session.config
    own = list(run.layers.get(pool.operation, {}).values())
    looks = [gathered(own, lambda name, column: run.add(f"_l_{name}", column)).alias("styles")] if styled else []
    seq = F.nullif(run.seq(pool), F.lit(""))
    own_name = run.name(most)
    name = (F.lit(None).cast("string") if own_name is None else F.when(seq.isNotNull(), own_name)).alias("name")
    if not cards:
        return run.df.select("_row", name, seq.alias("seq"), *looks)
    shown = [name] if config.show_name and own_name is not None else []  # with cards, a name that no row has is left out
    if config.suppress_cards:
        return run.df.select("_row", *shown, *([seq.alias("seq")] if config.show_seq else []), *looks)
    pools = run.pools if to_report == "all" else [pool] if to_report == "self" else list(to_report)
    pools = sorted({*pools, *aux, pool}, key=lambda p: p.id) if to_report != "all" else pools
    seqs = {p: [run.seq(p).alias(f"{p.name}.seq")] if config.show_pool_seqs else [] for p in pools}
    pool_states = {p: [run.state(p.state).alias(f"{p.name}.state")] if config.show_pool_states else [] for p in pools}
    op_states = {p: [run.state(p.operation.state).alias(f"{p.operation.name}.state")] if config.show_op_states else [] for p in pools}
    keys = {p: [run.card(p.operation, k).alias(f"{p.operation.name}.key.{k}") for k in run.cards[p.operation]] for p in pools}
    kinds = [seqs, pool_states, op_states, keys]
    if by == "type":
        rest = [c for kind in kinds for p in pools for c in kind[p]]
    else:
        rest = [c for p in reversed(pools) for kind in kinds for c in kind[p]]
    head = shown + ([seq.alias("seq")] if config.show_seq else [])
    return run.df.select("_row", *head, *rest, *looks)


def stripped(df: DataFrame) -> DataFrame:
    """Without tags; the places of styles then count the characters left, and those of tags have none."""
    if "styles" in df.columns:
        places = nontag_positions(F.col("seq"))
        moved = F.transform("styles", lambda s: F.struct(s["spec"].alias("spec"), F.filter(F.transform(s["positions"], lambda p: (F.array_position(places, p) - 1).cast("int")), lambda p: p >= 0).alias("positions")))
        df = df.withColumn("styles", F.filter(moved, lambda s: F.size(s["positions"]) > 0))
    return df.withColumn("seq", strip_tags_column(F.col("seq")))
