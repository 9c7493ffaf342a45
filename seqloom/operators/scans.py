"""Scans: a window slides along the sequence and something happens there. All are compositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.pool import Pool, as_pool
from ..sources.sources import from_seq
from .fixed import add_prefix, passthrough
from .mutate import mutagenize, shuffle_seq
from .regions import extract_region, region_multiscan, region_scan, replace_region


def _window(pool: Pool, length: int, region, whole: bool = False) -> None:
    n = pool.region_length(region)
    if n is None:
        raise ValueError("a scan needs a sequence of known length")
    if not 0 < length < n + whole:
        raise ValueError(f"a window of {length} in {n} characters")


def _fresh(pool: Pool, base: str) -> str:
    """A tag name that the pool does not have."""
    return next(x for x in (base, *(f"{base}{i}" for i in range(1, 10_000))) if x not in pool.regions)


def _named(pool: Pool, name: str | None) -> Pool:
    return pool.named(name) if name else pool


def deletion_scan(pool: Pool | str, deletion_length: int, deletion_marker: str | None = "-", region=None, positions=None, prefix: str | None = None, mode: str = "random", num_states: int | None = None, style: str | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    """Replace each window by as many markers, or by nothing (marker None)."""
    pool = as_pool(pool)
    _window(pool, deletion_length, region)
    tag = _fresh(pool, "_del")
    marked = region_scan(pool, tag, positions, region, None, deletion_length, prefix, mode, num_states, iter_order)
    return _named(replace_region(marked, from_seq((deletion_marker or "") * deletion_length), tag, style=style), name)


def _site_and_insert(out: Pool, scan: Pool, inserts: Pool, prefix: str | None, prefix_position: str | None, prefix_insert: str | None) -> Pool:
    """Names of what stands where: a common number, and numbers of the place and of the insert."""
    many = inserts.num_states

    def names(run, state: Column) -> list[Column]:
        place = run.state(scan.operation.state)
        insert = F.coalesce(run.state(inserts.state), run.state(inserts.operation.state), F.lit(0).cast("long"))
        numbers = ((prefix, place * many + insert), (prefix_position, place), (prefix_insert, insert))
        return [F.when(place.isNotNull(), F.concat(F.lit(f"{p}_"), x.cast("string"))) for p, x in numbers if p is not None]

    return passthrough(out, names)


def insertion_scan(pool: Pool | str, ins_pool: Pool | str, positions=None, region=None, replace: bool = False, style: str | None = None, prefix: str | None = None, prefix_position: str | None = None, prefix_insert: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    """Put each insert at each place, between characters or over as many."""
    pool, inserts = as_pool(pool), as_pool(ins_pool)
    if inserts.seq_length is None:
        raise ValueError("inserts must have a known length")
    width = inserts.seq_length if replace else 0
    if replace:
        _window(pool, width, region, True)
    tag = _fresh(pool, "_rep" if replace else "_ins")
    marked = region_scan(pool, tag, positions, region, None, width, None, mode, num_states, iter_order)
    out = replace_region(marked, inserts, tag, style=style)
    if prefix is not None or prefix_position is not None or prefix_insert is not None:
        out = _site_and_insert(out, marked, inserts, prefix, prefix_position, prefix_insert)
    return _named(out, name)


def replacement_scan(pool: Pool | str, ins_pool: Pool | str, positions=None, region=None, style: str | None = None, prefix: str | None = None, prefix_position: str | None = None, prefix_insert: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    return insertion_scan(pool, ins_pool, positions, region, True, style, prefix, prefix_position, prefix_insert, mode, num_states, iter_order, name)


def _pair(x):
    return tuple(x) if isinstance(x, (tuple, list)) else (x, x)


def mutagenize_scan(pool: Pool | str, mutagenize_length: int, num_mutations: int | None = None, mutation_rate: float | None = None, positions=None, region=None, prefix=None, mode="random", num_states=None, iter_order=None, style: str | None = None, name: str | None = None) -> Pool:
    """Mutate within each window, whose tags stay. Options may be pairs: of the window and of the mutation."""
    pool = as_pool(pool)
    _window(pool, mutagenize_length, region, True)
    modes, counts, orders = _pair(mode), _pair(num_states), _pair(iter_order)
    prefixes = tuple(prefix) if isinstance(prefix, (tuple, list)) else (prefix, None)
    tag = _fresh(pool, "_mut")
    marked = region_scan(pool, tag, positions, region, None, mutagenize_length, prefixes[0], modes[0], counts[0], orders[0])
    return mutagenize(marked, tag, num_mutations=num_mutations, mutation_rate=mutation_rate, style=style, prefix=prefixes[1], mode=modes[1], num_states=counts[1], iter_order=orders[1], name=name)


def shuffle_scan(pool: Pool | str, shuffle_length: int, positions=None, region=None, shuffles_per_position: int = 1, prefix: str | None = None, prefix_position: str | None = None, prefix_shuffle: str | None = None, mode: str = "random", num_states: int | None = None, style: str | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    """Shuffle each window, so many times."""
    pool = as_pool(pool)
    _window(pool, shuffle_length, region, True)
    tag = _fresh(pool, "_shuf")
    marked = region_scan(pool, tag, positions, region, None, shuffle_length, prefix_position, mode, num_states, iter_order)
    out = shuffle_seq(marked, tag, style=style, prefix=prefix_shuffle, num_states=shuffles_per_position, iter_order=-1, remove_tags=True)
    return _named(add_prefix(out, prefix) if prefix else out, name)


def subseq_scan(pool: Pool | str, seq_length: int, positions=None, region=None, prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    """The windows themselves."""
    pool = as_pool(pool)
    _window(pool, seq_length, region, True)
    tag = _fresh(pool, "_subseq")
    marked = region_scan(pool, tag, positions, region, None, seq_length, prefix, mode, num_states, iter_order)
    return extract_region(marked, tag, name=name)


def _multi(pool: Pool, contents: Sequence[Pool], width: int, base: str, options: dict) -> Pool:
    tags = [f"{_fresh(pool, base)}_{i}" for i in range(len(contents))]
    out = region_multiscan(pool, tags, len(contents), region_length=width, **options)
    for tag, content in zip(tags, contents):
        out = replace_region(out, content, tag)
    return out


def deletion_multiscan(pool: Pool | str, deletion_length: int, num_deletions: int, deletion_marker: str | None = "-", positions=None, prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, *, region=None, name: str | None = None) -> Pool:
    """Several deletions in each sequence."""
    pool = as_pool(pool)
    _window(pool, deletion_length, region)
    options = {"region": region, "positions": positions, "prefix": prefix, "mode": mode, "num_states": num_states, "iter_order": iter_order}
    return _named(_multi(pool, [from_seq((deletion_marker or "") * deletion_length) for _ in range(num_deletions)], deletion_length, "_del", options), name)


def insertion_multiscan(pool: Pool | str, num_insertions: int, insertion_pools, positions=None, insertion_mode: str = "ordered", prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, *, replace: bool = False, region=None, name: str | None = None) -> Pool:
    """Several inserts in each sequence; a single pool of them is drawn from anew for each place."""
    pool = as_pool(pool)
    if isinstance(insertion_pools, (Pool, str)):
        one = as_pool(insertion_pools)
        inserts = [one, *(one.deepcopy() for _ in range(num_insertions - 1))]
    else:
        inserts = [as_pool(p) for p in insertion_pools]
    if len(inserts) != num_insertions:
        raise ValueError(f"{len(inserts)} pools for {num_insertions} insertions")
    widths = {p.seq_length for p in inserts}
    if replace and (len(widths) != 1 or None in widths):
        raise ValueError("replacements must have one known length")
    options = {"region": region, "positions": positions, "insertion_mode": insertion_mode, "prefix": prefix, "mode": mode, "num_states": num_states, "iter_order": iter_order}
    return _named(_multi(pool, inserts, widths.pop() if replace else 0, "_rep" if replace else "_ins", options), name)


def replacement_multiscan(pool: Pool | str, num_replacements: int, replacement_pools, *positional, **options) -> Pool:
    return insertion_multiscan(pool, num_replacements, replacement_pools, *positional, replace=True, **options)
