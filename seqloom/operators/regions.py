"""Operators on named regions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement_column, strip_tags_column
from ..plans import styles
from ..plans.pool import Operation, Pool, as_pool, make
from ..plans.tags import literal_prefix, nontag_positions, tagged
from ..sources.sources import lookup
from .fixed import clear_tags, extract, rc, stylize


def validate_positions(positions: Sequence[int] | slice | None, count: int, unique: bool = True) -> list[int]:
    """The positions meant: all, a slice of them, or a list without repeats."""
    if positions is None:
        return list(range(count))
    if isinstance(positions, slice):
        return list(range(count))[positions]
    out = list(positions)
    if any(not 0 <= p < count for p in out):
        raise ValueError(f"positions must be in [0, {count})")
    if unique and len(set(out)) < len(out):
        raise ValueError("positions must not repeat")
    return out


def insert_tags(pool: Pool | str, region_name: str, start: int, stop: int | None = None, iter_order: int | None = None, prefix: str | None = None, name: str | None = None) -> Pool:
    """Make the interval of characters outside tags a region (an empty one if it has no length)."""
    pool = as_pool(pool)
    stop = start if stop is None else stop
    n = pool.seq_length
    if start < 0 or stop < start or (n is not None and stop > n):
        raise ValueError(f"no interval of the sequence: {start}, {stop}")
    if region_name in pool.regions:
        raise ValueError(f"region {region_name!r} exists")
    pool.session.register_region(region_name, stop - start)

    def build(run, args, s):
        seq = args[0]
        a = literal_prefix(seq, F.lit(start), True) if pool.regions else F.substring(seq, 1, start)
        b = literal_prefix(seq, F.lit(stop), False) if pool.regions else F.substring(seq, 1, stop)
        b = F.when(F.length(b) < F.length(a), a).otherwise(b)
        return F.concat(a, tagged(region_name, seq.substr(F.length(a) + 1, F.length(b) - F.length(a))), seq.substr(F.length(b) + 1, F.length(seq)))

    def follow(run, masks, seqs, out, state):
        seq, mask = seqs[0], masks[0]
        a, b = (F.length(literal_prefix(seq, F.lit(x), through)) if pool.regions else F.lit(x) for x, through in ((start, True), (stop, False)))
        b = F.greatest(a, b)
        return F.concat(F.substr(mask, F.lit(1), a), styles.wrapped(region_name, F.substr(mask, a + 1, b - a)), F.substr(mask, b + 1, F.length(seq)))

    op = Operation([pool], factory="insert_tags", iter_order=iter_order, prefix=prefix, build=build)
    op.follow = follow
    return make(op, n, name, [*pool.regions, region_name], kind=pool.kind)


def around(run, pool: Pool, seq: Column, mask: Column, region: str) -> tuple[Column, Column, Column]:
    """A mask before, in and after a region."""
    known = lambda r: run.parts(pool, seq, r)
    a, d = styles.within(seq, region, known, True)
    b, c = styles.within(seq, region, known, False)
    return F.substr(mask, F.lit(1), a), F.substr(mask, b + 1, c - b), F.substr(mask, d + 1, F.length(seq) - d)


def remove_tags(pool: Pool | str, region_name: str, keep_content: bool = True, iter_order: int | None = None, prefix: str | None = None, name: str | None = None) -> Pool:
    pool = as_pool(pool)
    length = pool.region_length(region_name)

    def build(run, args, s):
        before, inside, after = run.parts(run.op.parents[0], args[0], region_name)
        return F.concat(before, inside, after) if keep_content else F.concat(before, after)

    def follow(run, masks, seqs, out, state):
        before, inside, after = around(run, pool, seqs[0], masks[0], region_name)
        return F.concat(before, inside, after) if keep_content else F.concat(before, after)

    op = Operation([pool], factory="remove_tags", iter_order=iter_order, prefix=prefix, build=build)
    op.follow = follow
    n = pool.seq_length if keep_content else None if None in (pool.seq_length, length) else pool.seq_length - length
    return make(op, n, name, [r for r in pool.regions if r != region_name], kind=pool.kind)


def extract_region(pool: Pool | str, region_name: str, rc: bool = False, iter_order: int | None = None, prefix: str | None = None, name: str | None = None) -> Pool:
    out = extract(as_pool(pool), region_name, rc, iter_order=iter_order, prefix=prefix)
    return out.named(name) if name else out


def replace_region(pool: Pool | str, content_pool: Pool | str, region_name: str, rc: bool = False, iter_order: int | None = None, prefix: str | None = None, name: str | None = None, style: str | None = None) -> Pool:
    """Put another pool's sequences in a region's place (tags go); the states multiply."""
    pool, content = as_pool(pool), as_pool(content_pool)
    old = pool.region_length(region_name)

    def build(run, args, s):
        before, _, after = run.parts(run.op.parents[0], args[0], region_name)
        return F.concat(before, reverse_complement_column(strip_tags_column(args[1])) if rc else args[1], after)

    def follow(run, masks, seqs, out, state):
        before, _, after = around(run, run.op.parents[0], seqs[0], masks[0], region_name)
        return F.concat(before, F.reverse(styles.outside(masks[1], seqs[1])) if rc else masks[1], after)

    def paint(run, seqs, out, state):
        before, _, after = run.parts(run.op.parents[0], seqs[0], region_name)
        a, b = F.length(before), F.length(after)
        return [(style, F.concat(styles.fill(a), styles.fill(F.length(out) - a - b, 1), styles.fill(b)))]

    op = Operation([pool, content], factory="replace_region", iter_order=iter_order, prefix=prefix, build=build)
    op.follow, op.style, op.paint = follow, style, paint if style else None
    n = None if None in (pool.seq_length, content.seq_length, old) else pool.seq_length - old + content.seq_length
    return make(op, n, name, [*(r for r in pool.regions if r != region_name), *content.regions], kind=pool.kind)


def keep_region(pool: Pool, content: Pool, region_name: str, reverse: bool = False) -> Pool:
    """Like ``replace_region``, with the tags kept about the new content."""
    old = pool.region_length(region_name)

    def build(run, args, s):
        before, _, after = run.parts(run.op.parents[0], args[0], region_name)
        return F.concat(before, tagged(region_name, reverse_complement_column(args[1]) if reverse else args[1]), after)

    def follow(run, masks, seqs, out, state):
        before, _, after = around(run, run.op.parents[0], seqs[0], masks[0], region_name)
        return F.concat(before, styles.wrapped(region_name, F.reverse(masks[1]) if reverse else masks[1]), after)

    op = Operation([pool, content], factory="replace_keeping_tags", build=build)
    op.follow = follow
    n = None if None in (pool.seq_length, content.seq_length, old) else pool.seq_length - old + content.seq_length
    return make(op, n, None, pool.regions, kind=pool.kind)


def apply_at_region(pool: Pool | str, region_name: str, transform_fn: Callable[[Pool], Pool], rc: bool = False, remove_tags: bool = True, iter_order: int | None = None, prefix: str | None = None, name: str | None = None) -> Pool:
    """Take a region's content out, transform that pool, and put the result back."""
    pool = as_pool(pool)
    new = transform_fn(extract_region(pool, region_name, rc))
    out = replace_region(pool, new, region_name, rc, iter_order, prefix) if remove_tags else keep_region(pool, new, region_name, rc)
    return out.named(name) if name else out


def annotate_region(pool: Pool | str, name: str, extent: Sequence[int] | None = None, style: str | None = None, iter_order: int | None = None, prefix: str | None = None) -> Pool:
    """Tag an interval (all of it by default), or style a region that exists."""
    pool = as_pool(pool)
    if name in pool.regions:
        if extent is not None:
            raise ValueError(f"region {name!r} exists; extent cannot be given")
        out, last = pool, {"iter_order": iter_order, "prefix": prefix}
    else:
        if extent is None and pool.seq_length is None:
            raise ValueError("extent is needed where the length varies")
        out, last = insert_tags(pool, name, *(extent or (0, pool.seq_length)), iter_order=iter_order, prefix=prefix), {}
    return stylize(out, region=name, style=style, **last) if style else out


def region_scan(pool: Pool | str, region: str = "region", positions: Sequence[int] | slice | None = None, region_constraint: str | Sequence[int] | None = None, remove_tags: bool | None = None, region_length: int = 0, prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    """Slide a region of so many characters along the sequence or a part of it (0: every place between characters)."""
    pool, tag_name, region = as_pool(pool), region, region_constraint
    n = pool.region_length(region)
    if n is None:
        raise ValueError("a scan needs a sequence of known length")
    if not 0 <= region_length <= n:
        raise ValueError(f"a window of {region_length} in {n} characters")
    sites = validate_positions(positions, n - region_length + 1)
    if not sites:
        raise ValueError("no positions")
    inner = pool.regions and (region is None or not isinstance(region, str) or pool.template is None or "<" in _content(pool, region))
    pool.session.register_region(tag_name, region_length)

    def site_at(index: Column) -> Column:
        return lookup(sites, index).cast("int") if sites != list(range(len(sites))) else index.cast("int")

    def split(seq: Column, site: Column) -> tuple[Column, Column, Column]:
        """What stands before, in and after the window at a site."""
        if inner:
            a = literal_prefix(seq, site, True)
            upto = literal_prefix(seq, site + region_length, True)
            b = F.when(site + region_length < n, upto).otherwise(literal_prefix(seq, site + region_length, False)) if region_length else a
            if not region_length:
                a = b = F.when(site < n, a).otherwise(seq)
            return a, seq.substr(F.length(a) + 1, F.length(b) - F.length(a)), seq.substr(F.length(b) + 1, F.length(seq))
        return seq.substr(F.lit(1), site), seq.substr(site + 1, F.lit(region_length)), seq.substr(site + region_length + 1, F.length(seq))

    def placed(run, seq: Column, index: Column) -> tuple[Column, dict[str, Column]]:
        site = site_at(index)
        a, marked, after = split(seq, site)
        content = strip_tags_column(marked) if inner else marked
        tag = tagged(tag_name, content) if region_length else F.lit(f"<{tag_name}/>")
        cards = {
            "position_index": index.cast("long"),
            "start": site.cast("long"),
            "stop": (site + region_length).cast("long"),
            "length": F.lit(region_length).cast("long"),
            "region_name": F.lit(tag_name),
            "region_content": marked if region_length else F.lit(""),
            "region_seq": tag,
        }
        if region is None:
            run.pieces[run.op, tag_name] = (a, content, after)
        return F.concat(a, tag, after), cards

    def build(run, args, s):
        return placed(run, args[0], s % len(sites))

    def sample(run, args, draws):
        return placed(run, args[0], run.add(f"_p{run.op.id}", draws.below(len(sites), 0)))

    def follow(run, masks, seqs, out, state):
        seq, mask = seqs[0], masks[0]
        index = F.col(f"_p{run.op.id}") if mode == "random" else state % len(sites)
        a, marked, after = split(seq, site_at(index))
        content = F.substr(mask, F.length(a) + 1, F.length(marked))
        if inner:
            content = styles.outside(content, marked)
        return F.concat(F.substr(mask, F.lit(1), F.length(a)), styles.wrapped(tag_name, content if region_length else F.lit("")), F.substr(mask, F.length(seq) - F.length(after) + 1, F.length(after)))

    keys = {"position_index": "long", "start": "long", "stop": "long", "length": "long", "region_name": "string", "region_content": "string", "region_seq": "string"}
    op = Operation([pool], factory="region_scan", mode=mode, num_states=len(sites) if mode == "sequential" else num_states, natural=len(sites), prefix=prefix, iter_order=iter_order, region=region, remove_tags=bool(remove_tags), build=build, sample=sample, cards=keys)
    op.follow = follow
    return make(op, n, name, [*pool.regions, tag_name], kind=pool.kind)


def _content(pool: Pool, region: str) -> str:
    from ..plans.tags import validate_single_region

    return validate_single_region(pool.template, region).content


def region_multiscan(pool: Pool | str, regions: Sequence[str] | str, num_insertions: int, positions: Sequence[int] | slice | None = None, region_length: int = 0, insertion_mode: str = "ordered", prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, *, region: str | Sequence[int] | None = None, remove_tags: bool | None = None, name: str | None = None) -> Pool:
    """Several regions at once at random places that do not overlap."""
    if mode != "random":
        raise ValueError("region_multiscan is random only")
    if insertion_mode not in ("ordered", "unordered"):
        raise ValueError("insertion_mode is ordered or unordered")
    pool, k, w = as_pool(pool), num_insertions, region_length
    names = [f"{regions}_{i}" for i in range(k)] if isinstance(regions, str) else list(regions)
    if k < 1 or len(names) < k or (insertion_mode == "ordered" and len(names) != k):
        raise ValueError(f"{len(names)} names for {k} insertions")
    n = pool.region_length(region)
    if n is None or k * w > n:
        raise ValueError("the regions do not fit in the sequence")
    for x in names:
        pool.session.register_region(x, w)
    sites = validate_positions(positions, n - w + 1 if w else n + 1, unique=False)

    def sample(run, args, draws):
        seq, i = args[0], run.op.id
        if positions is None and w:  # k places among those left when each region counts as one character; none overlap
            packed = draws.chosen(F.sequence(F.lit(0), F.lit(n - k * w + k - 1)), k, 0)
            found = F.transform(packed, lambda p, t: p + t * (w - 1))
        elif w:  # in random order, each that overlaps none before it
            none = F.array().cast("array<int>")
            fits = lambda have, p: (F.size(have) < k) & ~F.exists(have, lambda c: F.abs(p - c) < w)
            placed = F.aggregate(draws.ordered(F.array(*map(F.lit, dict.fromkeys(sites))), 0), none, lambda have, p: F.when(fits(have, p), F.concat(have, F.array(p))).otherwise(have))
            found = F.sort_array(placed)
        else:
            found = draws.chosen(F.array(*map(F.lit, dict.fromkeys(sites))), k, 0)
        found = run.add(f"_p{i}", found)
        if positions is not None and w:
            found = run.add(f"_p{i}", F.when(F.size(found) < k, F.raise_error(F.lit(f"{k} regions of {w} do not fit at the given positions"))).otherwise(found))
        numbers = F.sequence(F.lit(0), F.lit(k - 1)) if insertion_mode == "ordered" else F.slice(draws.ordered(F.sequence(F.lit(0), F.lit(len(names) - 1)), 1), 1, k)
        own = run.add(f"_o{i}", F.transform(numbers, lambda t: F.get(F.array(*map(F.lit, names)), t)))
        bare, places = (seq, None) if not pool.regions else (strip_tags_column(seq), run.add(f"_m{i}", nontag_positions(seq)))
        content = lambda p: bare.substr(p + 1, F.lit(w))
        empty, full = (lambda x: F.concat(F.lit("<"), x, F.lit("/>"))), (lambda x, c: F.concat(F.lit("<"), x, F.lit(">"), c, F.lit("</"), x, F.lit(">")))
        labels = run.add(f"_x{i}", F.zip_with(own, found, lambda x, p: F.when(content(p) == "", empty(x)).otherwise(full(x, content(p)))))
        return spliced(seq, seq, found, labels, places), {"indices": found, "region_tags": labels}

    def spliced(seq: Column, text: Column, found: Column, labels: Column, places: Column | None) -> Column:
        """The text (the sequence, or a mask of it) with labels in place of the windows found."""
        start = lambda p: p if places is None else F.coalesce(F.get(places, p), F.length(seq))
        stop = lambda p: start(p) if not w else p + w if places is None else F.coalesce(F.get(places, p + w), F.element_at(places, -1) + 1)
        before = lambda t: F.when(t > 0, stop(F.get(found, t - 1))).otherwise(0)
        pieces = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: F.concat(text.substr(before(t) + 1, start(F.get(found, t)) - before(t)), F.get(labels, t)))
        rest = text.substr(stop(F.element_at(found, -1)) + 1, F.length(seq))
        return F.concat(F.array_join(pieces, ""), rest)

    def follow(run, masks, seqs, out, state):
        seq, mask, i = seqs[0], masks[0], run.op.id
        found, own = F.col(f"_p{i}"), F.col(f"_o{i}")
        bare, places = (mask, None) if not pool.regions else (styles.outside(mask, seq), F.col(f"_m{i}"))
        content = lambda p: bare.substr(p + 1, F.lit(w))
        zeros = lambda x: F.repeat(F.lit("0"), x)
        labels = F.zip_with(own, found, lambda x, p: F.when(content(p) == "", zeros(F.length(x) + 3)).otherwise(F.concat(zeros(F.length(x) + 2), content(p), zeros(F.length(x) + 3))))
        return spliced(seq, mask, found, labels, places)

    op = Operation([pool], factory="region_multiscan", mode="random", num_states=num_states, prefix=prefix, iter_order=iter_order, region=region, remove_tags=bool(remove_tags), sample=sample, cards={"indices": "array<int>", "region_tags": "array<string>"})
    op.follow = follow
    return make(op, n, name, [*pool.regions, *names], kind=pool.kind)


__all__ = ["insert_tags", "remove_tags", "extract_region", "replace_region", "apply_at_region", "annotate_region", "region_scan", "region_multiscan", "clear_tags", "rc"]
