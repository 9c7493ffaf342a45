"""An algebra of index states: an output index is taken apart into the indices of its inputs.

A state is plan-time only. ``columns`` turns a state graph into one nullable long column for each state over an index
column; ``values`` does the same for one index in Python. NULL (None) is an inactive state.
"""

from __future__ import annotations

import builtins
import random
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar
from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ConflictingValueAssignmentError(Exception):
    """Two paths give one state different values."""


_active: ContextVar[Manager | None] = ContextVar("state_manager", default=None)
#: Values of a table in one array literal; longer tables are stored, so many rows at a time.
LITERAL, WRITTEN = 10_000, 1_000_000
#: From how many values on seeded permutations and samples are computed for each index instead of drawn as a table.
COMPUTED = 1000
#: Rounds of a computed permutation.
ROUNDS = 48


#: States of up to so many values have long columns; those of more, up to WIDEST, have columns of DECIMAL(38, 0).
LONG = 1 << 63
WIDEST = 10**32
DECIMAL = "decimal(38,0)"


def kind_of(n: int) -> str:
    """The type of a column of values below n."""
    if n > WIDEST:
        raise ValueError(f"{n} states are more than a column can hold ({WIDEST})")
    return "bigint" if n <= LONG else DECIMAL


def number(x: int) -> Column:
    return F.lit(x) if -LONG <= x < LONG else F.lit(Decimal(x)).cast(DECIMAL)


def quotient(v: Column, b: int, n: int) -> Column:
    """v div b, for values below n."""
    if b == 1:
        return v
    if n <= b:
        return F.when(v.isNotNull(), F.lit(0).cast("long"))
    if n <= LONG:
        return F.call_function("div", v, F.lit(b))
    whole = (v - v % number(b)) / number(b).cast(DECIMAL)
    return whole.cast(kind_of(-(-n // b)))


class Manager:
    """Registry of states; a context manager."""

    def __init__(self):
        self.states: list[State] = []
        self.order = "first_state_slowest"
        self._tokens = []

    def __enter__(self) -> Manager:
        self._tokens.append(_active.set(self))
        return self

    def __exit__(self, *_) -> None:
        _active.reset(self._tokens.pop())

    def print_graph(self) -> None:
        """The states that no other state is made of, as indented trees."""
        from ..sources.sinks import state_tree

        used = {p for s in self.states for p in s.parents}
        for s in self.states:
            if s not in used:
                print(state_tree(s))

    def get_ancestors(self, state: State) -> list[State]:
        return state.get_ancestors()

    def get_all_names(self) -> list[str]:
        return [s.name for s in self.states]

    def get_by_name(self, name: str) -> State:
        found = [s for s in self.states if s.name == name]
        if not found:
            raise KeyError(f"no state named {name!r}")
        return found[0]

    def clear_all_values(self) -> None:
        """Make every state inactive, without regard to what it is made of."""
        for s in self.states:
            s._value = None

    def inactivate_all(self, states: Sequence[State] | None = None) -> None:
        for s in self.states if states is None else states:
            s.value = None

    def reset_all(self, states: Sequence[State] | None = None) -> None:
        for s in self.states if states is None else states:
            s.reset()

    def get_iteration_df(self, state: State, spark: SparkSession | None = None, *, states: Sequence[State] | None = None) -> DataFrame:
        """One row for each index of ``state``: the values of all its ancestors, in order of creation, or of ``states`` after its own.

        A state that ``state`` is not made of is NULL.
        """
        spark = spark or SparkSession.getActiveSession()
        base = Joined(spark.range(state.num_values))
        cols = columns(state, F.col("id"), base)
        named = sorted(cols.items(), key=lambda x: x[0].id)
        if states is not None:
            named = [(s, cols.get(s, F.lit(None))) for s in dict.fromkeys([state, *states])]
        return base.df.select(*[c.cast(kind_of(s.num_values)).alias(s.name) for s, c in named])


def manager() -> Manager:
    found = _active.get()
    if found is None:
        raise RuntimeError("no active state manager")
    return found


class State:
    """A leaf, or the result of an operation on parents."""

    def __init__(self, num_values: int | None = 1, name: str | None = None, iter_order: int | None = None, parents: Sequence[State] = (), split: Callable | None = None, split_column: Callable | None = None, kind: str = "leaf"):
        owner = manager()
        # what is made of others may be empty, like a slice from 5 to 2
        if num_values is not None and (not isinstance(num_values, int) or num_values < (kind == "leaf")):
            raise ValueError("num_values must be a positive integer")
        self.num_values = 1 if num_values is None else num_values
        self.manager, self._id = owner, len(owner.states)
        owner.states.append(self)
        self.name = name or f"State[{self.id}]"
        self.parents, self.split, self.split_column, self.kind = list(parents), split, split_column, kind
        self.iter_order = min((p.iter_order for p in self.parents), default=0) if iter_order is None else iter_order
        self.group: list[State] = [self]
        #: gives the table (idx, value) of the only parent's values where that is joined rather than part of the plan
        self.stored: Callable[[SparkSession], DataFrame] | None = None
        self._value: int | None = None

    @property
    def id(self) -> int:
        return self._id

    def __repr__(self) -> str:
        op = f"op={self.kind.title()}Op, " if self.kind != "leaf" else ""
        return f"State(name={self.name!r}, id={self.id}, {op}num_values={self.num_values}, value={self._value}, iter_order={self.iter_order})"

    # stepping, one value at a time
    @property
    def value(self) -> int | None:
        return self._value

    @value.setter
    def value(self, new: int | None) -> None:
        if new is not None and not 0 <= new < self.num_values:
            raise ValueError(f"{new} is not in [0, {self.num_values})")
        found = values(self, new)
        if new is not None and any(m.parents for m in self.group):
            self.manager.clear_all_values()
        for s, v in found.items():
            s._value = v

    @property
    def is_active(self) -> bool:
        return self._value is not None

    def advance(self) -> None:
        """The next value, or the first after the last. What a synchronised state has counts if it is beyond this one's range."""
        known = next((m._value for m in self.group if m._value is not None), None)
        if known is None:
            raise RuntimeError("an inactive state cannot be advanced")
        self.value = (known + 1) % self.num_values

    def reset(self, value: int = 0) -> None:
        self.value = value

    def __iter__(self) -> Iterator[int]:
        """All values in turn; in the end the first one is set again."""
        for v in range(self.num_values):
            self.value = v
            yield v
        if self.num_values:
            self.reset()

    def __len__(self) -> int:
        return self.num_values

    def __getitem__(self, key: int | builtins.slice) -> State:
        return slice_state(self, key)

    def get_ancestors(self) -> list[State]:
        found: dict[State, None] = {}

        def visit(s: State) -> None:
            if s not in found:
                found[s] = None
                for p in [*s.parents, *s.group]:
                    visit(p)

        visit(self)
        return list(found)

    def get_states(self, include_inactive: bool = True, named_only: bool = True) -> dict[str, int | None]:
        """The present values of this state and what it is made of, nearest first; names given automatically are left out."""
        found, at = [self], 0
        while at < len(found):
            found += [p for p in dict.fromkeys(found[at].parents) if p not in found]
            at += 1
        shown = [s for s in found if not (named_only and s.name == f"State[{s.id}]") and (include_inactive or s.is_active)]
        return {s.name: s._value for s in shown}

    def print_states(self, include_inactive: bool = True, named_only: bool = True) -> None:
        print(", ".join(f"{k}={v}" for k, v in self.get_states(include_inactive, named_only).items()))

    def print_dag(self, style: str = "clean") -> None:
        from ..sources.sinks import state_tree

        print(state_tree(self, style))

    def get_iteration_df(self, spark: SparkSession | None = None) -> DataFrame:
        """One row for each of its indices: its value and those of its ancestors."""
        return self.manager.get_iteration_df(self, spark)

    def named(self, name: str) -> State:
        self.name = name
        return self

    def synced_parent(self, name: str | None = None) -> State:
        return synced_to(self, name=name)

    def sync_with(self, other: State) -> None:
        sync(self, other)

    def copy(self, name: str | None = None) -> State:
        """A state of its own made of the same parents, with the present value."""
        out = State(self.num_values, name, self.iter_order, self.parents, self.split, self.split_column, self.kind)
        out._value, out.stored = self._value, self.stored
        return out

    def deepcopy(self, name: str | None = None) -> State:
        """A copy that shares no state with this one, with the present values."""
        done: dict[State, State] = {}

        def clone(s: State) -> State:
            if s not in done:
                done[s] = State(s.num_values, None, s.iter_order, [clone(p) for p in s.parents], s.split, s.split_column, s.kind)
                done[s]._value, done[s].stored = s._value, s.stored
            return done[s]

        out = clone(self)
        out.name = name or out.name
        return out


def _derived(kind: str, n: int, parents: Sequence[State], split: Callable, split_column: Callable, name: str | None, iter_order: int | None) -> State:
    return State(n, name, iter_order, parents, split, split_column, kind)


def product(states: Sequence[State], name: str | None = None, iter_order: int | None = None) -> State:
    """Every combination; the first state varies fastest."""
    states = list(states)
    if len(set(states)) < len(states):
        raise ValueError("a product's states must be distinct")
    strides = [prod(s.num_values for s in states[:i]) for i in range(len(states))]
    sizes = [s.num_values for s in states]
    total = prod(sizes)
    return _derived(
        "product",
        total,
        states,
        lambda v: [v // t % n for t, n in zip(strides, sizes)],
        lambda v: [_digit(v, t, n, total) for t, n in zip(strides, sizes)],
        name,
        iter_order,
    )


def _digit(v: Column, stride: int, n: int, total: int) -> Column:
    if n == 1:
        return F.when(v.isNotNull(), F.lit(0).cast("long"))
    x = quotient(v, stride, total)
    return x if stride * n == total else (x % number(n)).cast(kind_of(n))


def set_product_order_mode(mode: str) -> None:
    if mode not in ("first_state_slowest", "first_state_fastest"):
        raise ValueError(f"unknown order {mode!r}")
    manager().order = mode


def get_product_order_mode() -> str:
    return manager().order


def ordered_product(states: Sequence[State], name: str | None = None, iter_order: int | None = None) -> State:
    """A product of the flattened, distinct factors, sorted by iter_order and then by age."""
    flat: dict[State, None] = {}

    def add(s: State) -> None:
        if s.kind == "product":
            for p in s.parents:
                add(p)
        else:
            flat[next((f for f in flat if f in s.group), s)] = None

    for s in states:
        add(s)
    sign = -1 if manager().order == "first_state_slowest" else 1
    return product(sorted(flat, key=lambda s: (s.iter_order, sign * s.id)), name, iter_order)


def stack(states: Sequence[State], name: str | None = None, iter_order: int | None = None) -> State:
    """One after the other; only one is active."""
    ends = [sum(s.num_values for s in states[: i + 1]) for i in range(len(states))]
    bounds = [(e - s.num_values, e) for e, s in zip(ends, states)]
    return _derived(
        "stack",
        sum(s.num_values for s in states),
        states,
        lambda v: [v - a if a <= v < b else None for a, b in bounds],
        lambda v: [F.when((v >= number(a)) & (v < number(b)), (v - number(a)).cast(kind_of(b - a))) for a, b in bounds],
        name,
        iter_order,
    )


def slice_state(state: State, key: int | builtins.slice, name: str | None = None, iter_order: int | None = None) -> State:
    if isinstance(key, int):
        key = builtins.slice(key, key + 1 or None)
    r = range(state.num_values)[key]
    count = max(0, -((r.start - r.stop) // r.step))
    kind = kind_of(state.num_values) if state.num_values <= WIDEST else DECIMAL
    return _derived("slice", count, [state], lambda v: [r[v]], lambda v: [(v.cast(kind) * number(r.step) + number(r.start)).cast(kind)], name, iter_order)


def slice(state: State, start: int | None = None, stop: int | None = None, step: int | None = None, name: str | None = None, iter_order: int | None = None) -> State:  # noqa: A001
    return slice_state(state, builtins.slice(start, stop, step), name, iter_order)


def repeat(state: State, times: int, name: str | None = None, iter_order: int | None = None) -> State:
    if times < 1:
        raise ValueError("times must be 1 or more")
    n = state.num_values
    return _derived("repeat", n * times, [state], lambda v: [v % n], lambda v: [(v % number(n)).cast(kind_of(n))], name, iter_order)


def _table(state: State, table: list[int], kind: str, name: str | None, iter_order: int | None) -> State:
    """Where the index is looked up: a literal array, or a stored table when it is long (literal arrays where nothing can be joined)."""

    def look(v: Column) -> list[Column]:
        pieces = [table[i : i + LITERAL] for i in range(0, len(table), LITERAL)]
        arrays = [F.element_at(F.array(*map(number, p)).cast(f"array<{kind_of(state.num_values)}>"), (v % LITERAL + 1).cast("int")) for p in pieces]
        out = arrays[-1]
        for i in range(len(pieces) - 2, -1, -1):
            out = F.when(v < (i + 1) * LITERAL, arrays[i]).otherwise(out)
        return [out]

    out = _derived(kind, len(table), [state], lambda v: [table[v]], look, name, iter_order)
    if LITERAL < len(table) and state.num_values <= LONG:
        out.stored = _kept(table)
    return out


def _kept(table: list[int]) -> Callable[[SparkSession], DataFrame]:
    """A list as a table (idx, value) in the shared folder, written piece by piece when it is first asked for."""
    paths: dict[SparkSession, str] = {}

    def stored(spark: SparkSession) -> DataFrame:
        from ..sources.scratch import scratch_path

        if spark not in paths:
            path = scratch_path(spark, "states")
            for a in range(0, len(table), WRITTEN):
                values = np.asarray(table[a : a + WRITTEN], np.int64)
                spark.createDataFrame(pa.table({"idx": np.arange(a, a + len(values)), "value": values})).write.mode("append").parquet(path)
            paths[spark] = path
        return spark.read.parquet(paths[spark])

    return stored


def _listed(table: DataFrame, state: State, kind: str, name: str | None, iter_order: int | None) -> State:
    """Where the index is looked up in a table (idx, value), which stays one."""
    table = table.select(F.col("idx").cast("long").alias("idx"), F.col("value").cast("long").alias("value"))
    n = state.num_values
    found = table.agg(F.count("idx"), F.count("value"), F.min("idx"), F.max("idx"), F.min("value"), F.max("value")).first()
    if tuple(found) != (n, n, 0, n - 1, 0, n - 1) or any(table.groupBy(c).count().where("count > 1").limit(1).count() for c in ("idx", "value")):
        raise ValueError("not a permutation of the state's values")

    def look(v: Column) -> list[Column]:
        raise ValueError("values in a table can only be joined")

    out = _derived(kind, n, [state], lambda v: [table.where(F.col("idx") == v).first()["value"]], look, name, iter_order)
    out.stored = lambda spark: table
    return out


class Joined:
    """A DataFrame to which the stored tables of states are joined."""

    def __init__(self, df: DataFrame):
        self.df = df

    def look(self, s: State, v: Column) -> list[Column]:
        key, value = f"_i{s.id}", f"_x{s.id}"
        table = s.stored(self.df.sparkSession).select(F.col("idx").alias(key), F.col("value").alias(value))
        self.df = self.df.join(table, v == F.col(key), "left").drop(key)
        return [F.col(value)]


def _hash(seed: int, *values: int | str) -> int:
    """What Spark's xxhash64 gives for longs and strings (the first one the seed of the draw)."""
    h = 42
    for x in (seed, *values):
        h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else (x % (1 << 64)).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def _wide(seed: int, *values: int | str) -> int:
    """A number of 120 bits from two hashes."""
    high, low = (_hash(seed, half, *values) & ((1 << 60) - 1) for half in (0, 1))
    return (high << 60) + low


def _wide_column(seed: int, v: Column) -> Column:
    high, low = (F.xxhash64(F.lit(seed).cast("long"), F.lit(half).cast("long"), v.cast("string")).bitwiseAND(F.lit((1 << 60) - 1)).cast(DECIMAL) for half in (0, 1))
    return (high * number(1 << 60).cast(DECIMAL) + low).cast(DECIMAL)


def _permuted(seed: int, n: int) -> tuple[Callable[[int], int], Callable[[Column], Column]]:
    """A permutation of range(n) in closed form, in Python and as a column: the swap-or-not shuffle.

    Each round pairs x with k - x modulo n, for a number k of the round, and swaps the pair or not by a bit of the larger one,
    so that each round is a permutation whatever n is, and nothing of size n is made.
    """
    wide = n > LONG
    keys = [(_wide(seed, str(r)) if wide else _hash(seed, r)) % n for r in range(ROUNDS)]

    def value(x: int) -> int:
        for r, k in enumerate(keys):
            y = k - x if k >= x else k - x + n
            if _hash(seed, r, str(max(x, y)) if wide else max(x, y)) & 1:
                x = y
        return x

    def column(x: Column) -> Column:
        kind = kind_of(n)
        rounds = F.array(*[F.struct(F.lit(r).cast("long").alias("r"), number(k).cast(kind).alias("k")) for r, k in enumerate(keys)])

        def swap(x: Column, t: Column) -> Column:
            y = F.when(t["k"] >= x, t["k"] - x).otherwise(t["k"] - x + number(n)).cast(kind)
            larger = F.greatest(x, y)
            bit = F.xxhash64(F.lit(seed).cast("long"), t["r"], larger.cast("string") if wide else larger).bitwiseAND(F.lit(1))
            return F.when(bit == 1, y).otherwise(x)

        return F.aggregate(rounds, x.cast(kind), swap)

    return value, column


def shuffle(state: State, seed: int | None = None, permutation: Sequence[int] | DataFrame | None = None, name: str | None = None, iter_order: int | None = None) -> State:
    """The values in another order, drawn by a seed or given. Up to ``COMPUTED`` values a seed gives the order of Python's generator, beyond that a
    permutation that is computed for each index. An explicit permutation is a list, part of the plan up to ``LITERAL`` values and stored as a
    table beyond, or a DataFrame (idx, value) that gives the same rows each time; tables are joined."""
    n = state.num_values
    if seed is not None and permutation is not None:
        raise ValueError("seed and permutation exclude each other")
    if permutation is None:
        seed = random.randint(0, 2**32 - 1) if seed is None else seed
        if n > COMPUTED:
            value, column = _permuted(seed, n)
            return _derived("shuffle", n, [state], lambda v: [value(v)], lambda v: [column(v)], name, iter_order)
        table = list(range(n))
        random.Random(seed).shuffle(table)
    elif isinstance(permutation, DataFrame):
        return _listed(permutation, state, "shuffle", name, iter_order)
    else:
        table = list(permutation)
        if len(table) != n or not np.array_equal(np.sort(np.asarray(table)), np.arange(n)):
            raise ValueError("not a permutation of the state's values")
    return _table(state, table, "shuffle", name, iter_order)


def sample(state: State, num_values: int | None = None, seed: int | None = None, sampled_states: Sequence[int] | None = None, with_replacement: bool = True, name: str | None = None, iter_order: int | None = None) -> State:
    """Values drawn at random, or an explicit list of them. Beyond ``COMPUTED`` values they are computed for each index: by a
    hash, or without replacement as the beginning of a permutation."""
    n = state.num_values
    if (num_values is None) == (sampled_states is None):
        raise ValueError("give num_values or sampled_states")
    if sampled_states is not None:
        if seed is not None:
            raise ValueError("seed and sampled_states exclude each other")
        table = list(sampled_states)
        if any(not 0 <= v < n for v in table):
            raise ValueError("a sampled state is out of range")
        return _table(state, table, "sample", name, iter_order)
    seed = random.randint(0, 2**32 - 1) if seed is None else seed
    if not with_replacement and num_values > n:
        raise ValueError("more samples than values")
    if num_values > COMPUTED or n > LONG or (not with_replacement and n > COMPUTED):
        if with_replacement and n > LONG:
            return _derived("sample", num_values, [state], lambda v: [_wide(seed, str(v)) % n], lambda v: [(_wide_column(seed, v) % number(n)).cast(DECIMAL)], name, iter_order)
        if with_replacement:
            value, column = lambda v: (_hash(seed, v) >> 1) % n, lambda v: F.shiftright(F.xxhash64(F.lit(seed).cast("long"), v.cast("long")), 1)
            return _derived("sample", num_values, [state], lambda v: [value(v)], lambda v: [F.pmod(column(v), F.lit(n).cast("long"))], name, iter_order)
        value, column = _permuted(seed, n)
        return _derived("sample", num_values, [state], lambda v: [value(v)], lambda v: [column(v)], name, iter_order)
    rng = random.Random(seed)
    return _table(state, rng.choices(range(n), k=num_values) if with_replacement else rng.sample(range(n), num_values), "sample", name, iter_order)


def interleave(states: Sequence[State], name: str | None = None, iter_order: int | None = None) -> State:
    """In turn: the first value of each, the second of each, ..."""
    k, n = len(states), states[0].num_values
    if k < 2 or any(s.num_values != n for s in states):
        raise ValueError("interleave takes two states or more of one size")
    return _derived(
        "interleave",
        k * n,
        states,
        lambda v: [v // k if v % k == i else None for i in range(k)],
        lambda v: [F.when(v % k == i, quotient(v, k, k * n).cast(kind_of(n))) for i in range(k)],
        name,
        iter_order,
    )


def split(state: State, parts: int | Sequence[float], names: Sequence[str] | None = None) -> list[State]:
    """Consecutive slices: so many of nearly equal size, or of given proportions (at least one value each)."""
    n = state.num_values
    if (parts if isinstance(parts, int) else len(parts)) < 2:
        raise ValueError("split gives 2 parts or more")
    if isinstance(parts, int):
        sizes = [n // parts + (i < n % parts) for i in range(parts)]
    else:
        shares = [p / sum(parts) * n for p in parts]
        sizes = [max(1, round(x)) for x in shares]
        # what rounding left over goes to those that lost most by it (of equals, the last), what it took too much comes from those that gained most
        lost = sorted(range(len(sizes)), key=lambda i: (shares[i] - sizes[i], i))
        for j in range(n - sum(sizes)):
            sizes[lost[-1 - j % len(lost)]] += 1
        while sum(sizes) > n >= len(sizes):
            sizes[next(i for i in lost if sizes[i] > 1)] -= 1
    if min(sizes) < 1 or sum(sizes) > n:
        raise ValueError("more parts than values")
    at = [sum(sizes[:i]) for i in range(len(sizes))]
    return [slice_state(state, builtins.slice(a, a + k), names[i] if names else None) for i, (a, k) in enumerate(zip(at, sizes))]


def synced_to(state: State, num_values: int | None = None, name: str | None = None) -> State:
    """A new leaf that always has the value of ``state``."""
    out = State(state.num_values if num_values is None else num_values, name, min(s.iter_order for s in state.group))
    sync(state, out)
    return out


def sync(a: State, b: State) -> None:
    """From now on a and b (and what they are synchronised with) have one value; NULL where it is out of a member's range."""
    if b not in a.group:
        joined = [*a.group, *b.group]
        for s in joined:
            s.group = joined


def values(root: State, value: int | None) -> dict[State, int | None]:
    """The value of every ancestor when ``root`` has this one."""
    out: dict[State, int | None] = dict.fromkeys(root.get_ancestors())

    def put(s: State, v: int | None) -> None:
        if v is None:
            return
        for m in s.group:
            own = v if v < m.num_values else None
            if own is None or out.get(m) == own:
                continue
            if out.get(m) is not None:
                raise ConflictingValueAssignmentError(f"{m.name}: {out[m]} and {own}")
            out[m] = own
            if m.split:
                for p, x in zip(m.parents, m.split(own)):
                    put(p, x)

    put(root, value)
    return out


def agreed(s: State, paths: Sequence[Column]) -> Column:
    """The value that several paths give a state; an error in a row where they differ. NULL overrides nothing."""
    value = F.coalesce(*paths)
    differs = F.lit(False)
    for p in paths:
        differs = differs | (p.isNotNull() & (p != value))
    return F.when(differs, F.raise_error(F.concat_ws(" ", F.lit(f"conflicting values of state {s.name}:"), *[p.cast("string") for p in paths]))).otherwise(value)


def columns(root: State, index: Column, base: Joined | None = None) -> dict[State, Column]:
    """A column for every ancestor of ``root`` over its index. Paths that meet in one state have to agree. Stored tables are joined to ``base``."""
    found: dict[State, list[Column]] = {}
    order: list[State] = []
    seen: set[State] = set()

    def visit(s: State) -> None:  # parents after all their children
        if s in seen:
            return
        seen.add(s)
        for m in s.group:
            seen.add(m)
            for p in m.parents:
                visit(p)
        order.append(s)

    visit(root)
    out: dict[State, Column] = {}
    found[root] = [index]
    for s in reversed(order):
        paths = [c for m in s.group for c in found.get(m, [])]
        if not paths:
            continue
        value = paths[0] if len(paths) == 1 else agreed(s, paths)
        most = max(m.num_values for m in s.group)
        for m in s.group:
            own = value if m.num_values == most else F.when(value < number(m.num_values), value).cast(kind_of(m.num_values))
            out[m] = own
            if m.split_column:
                for p, c in zip(m.parents, base.look(m, own) if base and m.stored else m.split_column(own)):
                    found.setdefault(p, []).append(c)
    return out
