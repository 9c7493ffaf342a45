"""Operators that change each sequence in a fixed way."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement_column, strip_tags_column
from ..plans import styles
from ..plans.pool import Operation, Pool, as_pool, make, of_columns
from ..plans.tags import outside_tags
from ..sources.sources import _styled


def fixed_operation(parent_pools: Sequence[Pool | str], seq_from_seqs_fn: Callable, seq_length_from_pool_lengths_fn: Callable | None = None, region=None, remove_tags: bool = False, iter_order: int | None = None, prefix: str | None = None, name: str | None = None, factory: str = "fixed", native: bool | None = None, follow: Callable | None = None) -> Pool:
    """Any function of the parents' sequences: of columns (``native``), or of a list of strings (as an Arrow UDF). If it is not
    said which, a function that takes strings is one of strings."""
    pools = [as_pool(p) for p in parent_pools]

    def build(run, args, s):
        if of_columns(seq_from_seqs_fn, ["ACGT"] * len(args), args) if native is None else native:
            return seq_from_seqs_fn(args)

        @F.pandas_udf("string")
        def apply(*cols: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None for v in x) else seq_from_seqs_fn(list(x)) for x in zip(*cols)], dtype=object)

        return run.add(f"_u{op.id}", apply(*args))

    op = Operation(pools, factory=factory, region=region, remove_tags=remove_tags, iter_order=iter_order, prefix=prefix, build=build)
    op.follow = follow or styles.same
    lengths = [pools[0].region_length(region), *(p.seq_length for p in pools[1:])]
    length = seq_length_from_pool_lengths_fn(lengths) if seq_length_from_pool_lengths_fn else None
    return make(op, length, name, dict.fromkeys(r for p in pools for r in p.regions), kind=pools[0].kind)


def join(pools: Sequence[Pool | str], spacer_str: str = "", iter_order: int | None = None, prefix: str | None = None, name: str | None = None, style: str | None = None) -> Pool:
    """Side by side; the states multiply."""
    def glue(args: list[Column]) -> Column:
        return F.concat(*[x for i, a in enumerate(args) for x in ([F.lit(spacer_str), a] if i and spacer_str else [a])])

    def spaced(run, masks, seqs, out, state):
        return F.concat(*[x for i, m in enumerate(masks) for x in ([styles.fill(len(spacer_str)), m] if i and spacer_str else [m])])

    total = lambda ls: None if None in ls else sum(ls) + len(spacer_str) * (len(ls) - 1)
    return _styled(fixed_operation(pools, glue, total, iter_order=iter_order, prefix=prefix, name=name, factory="join", native=True, follow=spaced), style)


def _one(factory: str, f: Callable, length: Callable, drops_regions: bool = False, moved: Callable | None = None):
    """An operator of one parent; ``moved(mask, seq)`` is what it does to masks of styles (None: nothing)."""
    follow = (lambda run, masks, seqs, out, state: moved(masks[0], seqs[0])) if moved else None

    def operator(pool: Pool | str, region=None, remove_tags: bool | None = None, iter_order: int | None = None, prefix: str | None = None, name: str | None = None, style: str | None = None) -> Pool:
        out = fixed_operation([pool], lambda args: f(args[0]), length, region, bool(remove_tags), iter_order, prefix, name, factory, True, follow)
        if drops_regions and region is None:
            out.regions = {}
        return _styled(out, style)

    operator.__name__ = factory
    return operator


_same = lambda ls: ls[0]
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
rc = _one("rc", lambda s: reverse_complement_column(strip_tags_column(s)), _same, True, lambda m, s: F.reverse(styles.outside(m, s)))
upper = _one("upper", lambda s: outside_tags(s, F.upper), _same)
lower = _one("lower", lambda s: outside_tags(s, F.lower), _same)
swapcase = _one("swapcase", lambda s: outside_tags(s, lambda p: F.translate(p, _LOW + _UP, _UP + _LOW)), _same)
clear_gaps = _one("clear_gaps", lambda s: outside_tags(s, lambda p: F.regexp_replace(p, "[^ACGTacgt]", "")), lambda ls: None, moved=lambda m, s: styles.molecular(m, s, "ACGTacgt<>#"))
clear_annotation = _one("clear_annotation", lambda s: F.upper(F.regexp_replace(strip_tags_column(s), "[^ACGTacgt]", "")), lambda ls: None, True, styles.molecular)
clear_tags = _one("clear_tags", strip_tags_column, _same, True, styles.outside)


def sliced(s: Column, key: slice) -> Column:
    """Python's slice of a string."""
    n = F.length(s)
    step = key.step or 1
    if step == 1:
        def at(x: int | None, default: Column) -> Column:
            return default if x is None else F.least(F.lit(x), n) if x >= 0 else F.greatest(n + x, F.lit(0))

        a, b = at(key.start, F.lit(0)), at(key.stop, n)
        return s.substr(a + 1, F.greatest(b - a, F.lit(0)))
    chars = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n), lambda i: s.substr(i + 1, F.lit(1)))
    low = 0 if step > 0 else -1

    def bound(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        return F.greatest(F.least(F.lit(x) if x >= 0 else n + x, n if step > 0 else n - 1), F.lit(low))

    a = bound(key.start, F.lit(0) if step > 0 else n - 1)
    b = bound(key.stop, n if step > 0 else F.lit(-1))
    count = F.greatest(F.ceil((b - a) / step), F.lit(0)).cast("int")
    picks = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count)
    return F.array_join(F.transform(picks, lambda i: F.element_at(chars, (a + i * step + 1).cast("int"))), "")


def slice_seq(pool: Pool | str, region: str | Sequence[int] | None = None, start: int | None = None, stop: int | None = None, step: int | None = None, keep_context: bool = False, iter_order: int | None = None, prefix: str | None = None, style: str | None = None, name: str | None = None) -> Pool:
    """A slice of the sequence, or of a region's content (with its flanks if ``keep_context``)."""
    pool = as_pool(pool)
    if keep_context and region is None:
        raise ValueError("keep_context needs a region")
    key = slice(start, stop, step)
    length = pool.region_length(region)
    new = None if length is None else len(range(length)[key])
    source = pool
    if region is not None and not keep_context:
        source = extract(pool, region)
        region = None
    op = Operation([source], factory="slice_seq", region=region, remove_tags=True, iter_order=iter_order, prefix=prefix, build=lambda run, args, s: sliced(strip_tags_column(args[0]), key))
    op.follow = lambda run, masks, seqs, out, state: sliced(styles.outside(masks[0], seqs[0]), key)
    return _styled(make(op, new, name), style)


def extract(pool: Pool, region: str | Sequence[int], rc_: bool = False, **options) -> Pool:
    def build(run, args, s):
        inside = run.parts(run.op.parents[0], args[0], region)[1] if isinstance(region, str) else F.substring(args[0], region[0] + 1, region[1] - region[0])
        return reverse_complement_column(strip_tags_column(inside)) if rc_ else inside

    def follow(run, masks, seqs, out, state):
        start, stop = styles.within(seqs[0], region, lambda r: run.parts(pool, seqs[0], r), False)
        mask, inside = (F.substr(x, start + 1, F.greatest(stop - start, F.lit(0))) for x in (masks[0], seqs[0]))
        return F.reverse(styles.outside(mask, inside)) if rc_ else mask

    op = Operation([pool], factory="extract_region", build=build, **options)
    op.follow = follow
    return Pool(op, pool.region_length(region), kind=pool.kind)


def add_prefix(pool: Pool, prefix: str, iter_order: int | None = None, name: str | None = None) -> Pool:
    """A part of the names only."""
    op = Operation([pool], factory="add_prefix", prefix=prefix, iter_order=iter_order, build=lambda run, args, s: args[0])
    return make(op, pool.seq_length, name, pool.regions, kind=pool.kind)


def passthrough(pool: Pool, names: Callable) -> Pool:
    """The sequence as it is; ``names(run, state)`` gives parts of the names."""
    op = Operation([pool], factory="passthrough", build=lambda run, args, s: args[0], name_parts=names)
    return make(op, pool.seq_length, None, pool.regions, kind=pool.kind)


def stylize(pool: Pool | str, region=None, *, style: str, which: str = "contents", regex: str | None = None, iter_order: int | None = None, prefix: str | None = None, name: str | None = None) -> Pool:
    """Add a style to some characters; sequences stay as they are."""
    if which not in styles.CHOICES:
        raise ValueError(f"unknown {which!r}")
    pool = as_pool(pool)
    op = Operation([pool], factory="stylize", iter_order=iter_order, prefix=prefix, build=lambda run, args, s: args[0])
    op.style = style
    op.paint = lambda run, seqs, out, state: [(style, styles.stylized(out, region, lambda r: run.parts(op.parents[0], out, r), which, regex))]
    return make(op, pool.seq_length, name, pool.regions, kind=pool.kind)
