"""Operators on the index space: union, repetition, slices, samples, permutations, synchronisation, filters."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import calc_complexity, calc_dust, calc_gc, has_homopolymer, site_regex, strip_tags_column
from ..plans import states as st
from ..plans.pool import Operation, Pool, as_pool, make, of_columns


class _Derived(Operation):
    """An operation whose pool has a state of its own making over the parents' states."""

    def __init__(self, parents, derive: Callable, **options):
        self._derive = derive
        super().__init__(parents, **options)

    def make_state(self) -> st.State:
        return self._derive(self, [p.state for p in self.parents])

    def clone_state(self, op: Operation, old: Pool) -> st.State:
        return self._derive(op, [p.state for p in op.parents])


def stack(pools: Sequence[Pool | str], prefix: str | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    """One pool's sequences after the other's."""
    pools = [as_pool(p) for p in pools]

    def derive(op, states):
        op.branches = st.stack(states, iter_order=iter_order)
        return op.branches

    ends = [sum(p.num_states for p in pools[: i + 1]) for i in range(len(pools))]

    def build(run, args, s):
        op, v = run.op, run.state(run.op.branches)
        which = F.lit(None).cast("long")
        for i in reversed(range(len(pools))):
            which = F.when(v < ends[i], F.lit(i).cast("long")).otherwise(which)
        which = run.add(f"_s{op.state.id}", which)
        run.known.add(op.state)
        out = F.lit(None).cast("string")
        for i in reversed(range(len(args))):
            out = F.when(which == i, args[i]).otherwise(out)
        return out, {"active_parent": which}

    op = _Derived(pools, derive, factory="stack", num_states=len(pools), mode="sequential", prefix=prefix, iter_order=iter_order, build=build, cards={"active_parent": "long"})
    op.follow = lambda run, masks, seqs, out, state: F.coalesce(*[F.when(run.state(run.op.state) == i, m) for i, m in enumerate(masks)])
    lengths = {p.seq_length for p in pools}
    return make(op, lengths.pop() if len(lengths) == 1 else None, name, dict.fromkeys(r for p in pools for r in p.regions), kind=pools[0].kind)


def repeat(pool: Pool | str, times: int, prefix: str | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    pool = as_pool(pool)
    if times < 1:
        raise ValueError("times must be 1 or more")
    op = Operation([pool], factory="repeat", num_states=times, mode="sequential", prefix=prefix, iter_order=iter_order, build=lambda run, args, s: (args[0], {"repeat_index": s}), cards={"repeat_index": "long"})
    return make(op, pool.seq_length, name, pool.regions, kind=pool.kind)


def _reindexed(pool: Pool, factory: str, derive: Callable, prefix: str | None, name: str | None) -> Pool:
    def derive_one(op: Operation, states: list[st.State]) -> st.State:
        op.derived = derive(states[0])
        return op.derived

    named = (lambda run, state: [F.when(run.state(op.derived).isNotNull(), F.lit(prefix))]) if prefix else None
    op = _Derived([pool], derive_one, factory=factory, prefix=prefix, build=lambda run, args, s: args[0], name_parts=named)
    return make(op, pool.seq_length, name, pool.regions, kind=pool.kind)


def state_slice(pool: Pool | str, key: int | slice | None = None, prefix: str | None = None, iter_order: int | None = None, *, start: int | None = None, stop: int | None = None, step: int | None = None, name: str | None = None) -> Pool:
    """OFFSET, LIMIT and step over the states, by index arithmetic only."""
    key = slice(start, stop, step) if key is None else key
    pool = as_pool(pool)
    if isinstance(key, int) and not -pool.num_states <= key < pool.num_states:
        raise IndexError(f"state {key} of {pool.num_states}")
    return _reindexed(pool, "state_slice", lambda s: st.slice_state(s, key, iter_order=iter_order), prefix, name)


def _drawn(seed: int | None, explicit: Sequence[int] | None) -> int | None:
    """A seed drawn once, so that copies of the pool have the same order."""
    return random.randint(0, 2**32 - 1) if seed is None and explicit is None else seed


def sample(pool: Pool | str, num_seqs: int | None = None, seq_states: Sequence[int] | None = None, seed: int | None = None, with_replacement: bool = True, prefix: str | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    if (num_seqs is None) == (seq_states is None):
        raise ValueError("give num_seqs or seq_states")
    pool, seed = as_pool(pool), _drawn(seed, seq_states)
    return _reindexed(pool, "sample", lambda s: st.sample(s, num_seqs, seed, seq_states, with_replacement, iter_order=iter_order), prefix, name)


def state_shuffle(pool: Pool | str, seed: int | None = None, permutation: Sequence[int] | DataFrame | None = None, prefix: str | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    """The states in another order: drawn by a seed, or a list or a DataFrame (idx, value) of them."""
    pool, seed = as_pool(pool), _drawn(seed, permutation)
    return _reindexed(pool, "state_shuffle", lambda s: st.shuffle(s, seed, permutation, iter_order=iter_order), prefix, name)


def sync(pools: Sequence[Pool]) -> None:
    """From now on these pools of equal size go in lockstep."""
    if len({p.num_states for p in pools}) > 1:
        raise ValueError("pools in lockstep must have as many states")
    for p in pools[1:]:
        st.sync(pools[0].state, p.state)


def filter(pool: Pool | str, predicate: Callable, name: str | None = None, prefix: str | None = None, native: bool | None = None) -> Pool:  # noqa: A001
    """NULL where the predicate does not hold. It takes a column (and gives one) or, as an Arrow UDF, a string. If it is not said
    which (``native``), a predicate that takes strings is one of strings."""
    pool = as_pool(pool)

    def build(run, args, s):
        clean = strip_tags_column(args[0])
        if of_columns(predicate, "ACGT", clean) if native is None else native:
            passed = predicate(clean)
        else:

            @F.pandas_udf("boolean")
            def holds(seqs: pd.Series) -> pd.Series:
                return pd.Series([None if v is None else bool(predicate(v)) for v in seqs], dtype=object)

            passed = run.add(f"_u{op.id}", holds(clean))
        return F.when(passed, args[0]), {"passed": passed}

    op = Operation([pool], factory="filter", prefix=prefix, build=build, cards={"passed": "boolean"})
    return make(op, None, name, pool.regions, kind=pool.kind)


filter_seq = filter


def filter_gc(pool: Pool | str, min_gc: float = 0.0, max_gc: float = 1.0, **options) -> Pool:
    if not 0 <= min_gc <= max_gc <= 1:
        raise ValueError("0 <= min_gc <= max_gc <= 1 must hold")
    return filter(pool, lambda s: calc_gc(s).between(min_gc, max_gc), native=True, **options)


def filter_homopolymer(pool: Pool | str, max_length: int, **options) -> Pool:
    if max_length < 1:
        raise ValueError("max_length must be 1 or more")
    return filter(pool, lambda s: ~has_homopolymer(s, max_length), native=True, **options)


def filter_complexity(pool: Pool | str, min_complexity: float, k_range: Sequence[int] = (1, 2, 3), **options) -> Pool:
    if not 0 <= min_complexity <= 1:
        raise ValueError("min_complexity must be in [0, 1]")
    return filter(pool, lambda s: calc_complexity(s, k_range) >= min_complexity, native=True, **options)


def filter_dust(pool: Pool | str, max_score: float = 2.0, **options) -> Pool:
    if max_score < 0:
        raise ValueError("max_score must be 0 or more")
    return filter(pool, lambda s: calc_dust(s) <= max_score, native=True, **options)


def filter_restriction_sites(pool: Pool | str, enzymes: str | Sequence[str] | None = None, sites: Sequence[str] | None = None, check_rc: bool = True, **options) -> Pool:
    pattern = site_regex(enzymes, sites, check_rc)
    return filter(pool, lambda s: ~F.upper(s).rlike(pattern), native=True, **options)
