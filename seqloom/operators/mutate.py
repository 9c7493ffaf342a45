"""Substitutions, shuffles and recombination."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from math import comb, prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dna import IUPAC_TO_DNA, let, strip_tags_column
from ..plans import styles as masks_of
from ..plans.pool import Draws, Operation, Pool, as_pool, make, replaced
from ..plans.tags import molecular_positions
from ..sources.sources import _within, lookup


def div(a: Column, b: int) -> Column:
    return a if b == 1 else F.call_function("div", a, F.lit(b))


def _below(limit: Column):
    return lambda c: c < limit


def unranked(rank: Column, n: int, k: int, keep: Callable[[str, Column], Column] | None = None) -> list[Column]:
    """The rank-th of the k-subsets of range(n) in lexicographic order, in closed form. ``keep`` makes a column of an intermediate
    value, so that the expression grows with k and not with a power of it.

    With r elements to choose from position p on there are C(n - p, r) subsets, so the next element is n - x for the
    least x with C(x, r) >= what is left.
    """
    keep = keep or (lambda name, value: value)
    out: list[Column] = []
    left: Column = F.lit(comb(n, k)).cast("long") - rank  # subsets from this one on
    for r in range(k, 0, -1):
        table = F.array(*[F.lit(comb(x, r)) for x in range(n + 1)]).cast("array<bigint>")
        if r == 1:
            x = left.cast("int")
        elif r == 2:  # x (x - 1) / 2 >= left, by the square root and a step to either side
            x = F.ceil((F.sqrt(left * 8 + 1) + 1) / 2).cast("int")
            x = F.when(x * (x - 1) / 2 < left, x + 1).when((x - 1) * (x - 2) / 2 >= left, x - 1).otherwise(x)
        else:
            x = F.size(F.filter(table, _below(left)))
        x = keep(f"x{r}", x)
        out.append((F.lit(n) - x).cast("int"))
        # those that begin with later elements are C(x - 1, r); the rest begin with this one
        left = keep(f"left{r}", left - F.element_at(table, x)) if r > 1 else left
    return out


def digits(value: Column, base: int, count: int) -> list[Column]:
    """Digits of a number, the last one fastest."""
    return [div(value, base ** (count - 1 - i)) % base for i in range(count)]


def _masks(allowed: str, length: int | None) -> list[str]:
    if length is not None and len(allowed) != length:
        raise ValueError(f"allowed_chars has {len(allowed)} characters for {length} positions")
    return ["".join(sorted(IUPAC_TO_DNA[c.upper()])) for c in allowed]


#: IUPAC codes for several bases, in either case.
CODES = "".join(c + c.lower() for c in IUPAC_TO_DNA if c not in "ACGT")


def mutagenize(pool: Pool | str, region=None, num_mutations: int | None = None, mutation_rate: float | None = None, allowed_chars: str | None = None, style: str | None = None, prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, name: str | None = None, remove_tags: bool | None = None) -> Pool:
    """Substitute so many bases, or each with a probability; upper and lower case stay."""
    if (num_mutations is None) == (mutation_rate is None):
        raise ValueError("give num_mutations or mutation_rate")
    if num_mutations is not None and num_mutations < 1:
        raise ValueError("num_mutations must be 1 or more")
    if mutation_rate is not None and not 0 <= mutation_rate <= 1:
        raise ValueError("mutation_rate must be in [0, 1]")
    if mode == "sequential" and mutation_rate is not None:
        raise ValueError("mutation_rate is random only")
    pool = as_pool(pool)
    n, k = pool.molecular_length(region), num_mutations
    if n is not None and k is not None and k > n:
        raise ValueError(f"{k} mutations in {n} positions")
    plain = pool.plain and region is None
    masks = _masks(allowed_chars, n) if allowed_chars is not None else None
    open_ = [i for i, m in enumerate(masks) if len(m) > 1] if masks else None
    total, natural, enumerated = None, None, None
    if mode == "sequential":
        if n is None:
            raise ValueError("sequential mode needs a sequence of known length")
        if masks is None:
            natural = comb(n, k) * 3**k
        else:
            if k > len(open_):
                raise ValueError(f"{k} mutations in {len(open_)} positions that may change")
            enumerated = [(c, [len(masks[i]) - 1 for i in c]) for c in combinations(open_, k)]
            natural = sum(prod(a) for _, a in enumerated)
        total = num_states or natural

    def build(run, args, s):
        seq = args[0]
        v = s % natural
        if masks is None:
            positions = unranked(div(v, 3**k), n, k, run.keeper() if k > 2 else None)
            alternatives = digits(v % 3**k, 3, k)
        else:
            ends, at = [], 0
            for _, a in enumerated:
                at += prod(a)
                ends.append(at)
            which = F.size(F.filter(F.array(*map(F.lit, ends)).cast("array<bigint>"), lambda e: e <= v))
            chosen = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c, _ in enumerated]), which + 1)
            left = v - F.when(which == 0, F.lit(0)).otherwise(F.element_at(F.array(*map(F.lit, ends)).cast("array<bigint>"), F.greatest(which, F.lit(1))))
            sizes = F.element_at(F.array(*[F.array(*map(F.lit, a)) for _, a in enumerated]), which + 1)
            positions, alternatives = [], []
            for j in range(k):  # the first chosen position is the fastest
                positions.append(chosen[j])
                alternatives.append(left % sizes[j])
                left = F.call_function("div", left, sizes[j].cast("long"))
        places = None if plain else run.add(f"_m{run.op.id}", molecular_positions(seq))
        out, wts, muts = seq, [], []
        allowed = F.array(*map(F.lit, masks)) if masks else None
        if k > 2:  # as arrays
            picked, picks = (run.add(f"_{x}{run.op.id}", F.array(*y)) for x, y in (("p", positions), ("d", alternatives)))
            spots = picked if plain else run.add(f"_y{run.op.id}", F.transform(picked, lambda p: F.get(places, p)))
            old = run.add(f"_w{run.op.id}", F.transform(spots, lambda p: seq.substr(p + 1, F.lit(1))))
            rest = lambda p, wt: F.replace(F.element_at(allowed, p + 1) if masks else F.lit("ACGT"), F.upper(wt), F.lit(""))
            cased = lambda wt, c: F.when(wt == F.lower(wt), F.lower(c)).otherwise(c)
            new = run.add(f"_x{run.op.id}", F.transform(picked, lambda p, j: cased(F.get(old, j), rest(p, F.get(old, j)).substr((F.get(picks, j) + 1).cast("int"), F.lit(1)))))
            return replaced(seq, spots, new), {"positions": picked, "wt_chars": old, "mut_chars": new}
        if run.styled and k == 1:
            run.plans[run.op] = positions[0] if plain else F.get(places, positions[0])
        for p, d in zip(positions, alternatives):
            place = (p if plain else F.get(places, p)) + 1
            wt = seq.substr(place, F.lit(1))
            choice = F.replace(F.element_at(allowed, p + 1) if masks else F.lit("ACGT"), F.upper(wt), F.lit("")).substr((d + 1).cast("int"), F.lit(1))
            mut = F.when(wt == F.lower(wt), F.lower(choice)).otherwise(choice)
            out = F.overlay(out, mut, place, F.lit(1))
            wts.append(wt)
            muts.append(mut)
        return out, {"positions": F.array(*positions), "wt_chars": F.array(*wts), "mut_chars": F.array(*muts)}

    def sample(run, args, draws):
        seq, i = args[0], run.op.id
        if plain:
            place, count = (lambda p: p), F.length(seq)
        else:
            coded = strip_tags_column(seq).rlike(f"[{CODES}]")
            places = run.add(f"_m{i}", F.when(coded, F.raise_error(F.lit("the sequence holds IUPAC codes"))).otherwise(molecular_positions(seq)))
            place, count = (lambda p: F.get(places, p)), F.size(places)
        usable = F.array(*map(F.lit, open_)) if masks else F.slice(F.sequence(F.lit(0), count), 1, count)
        picked = draws.chosen(usable, k, 0) if k is not None else F.filter(usable, lambda p: draws.happens(mutation_rate, 0, p))
        picked = run.add(f"_p{i}", picked.cast("array<int>"))
        wts = run.add(f"_w{i}", F.transform(picked, lambda p: seq.substr(place(p) + 1, F.lit(1))))
        allowed = F.array(*map(F.lit, masks)) if masks else None

        def other(wt, p):
            rest = F.replace(F.element_at(allowed, p + 1) if masks else F.lit("ACGT"), F.upper(wt), F.lit(""))
            new = rest.substr(draws.below(F.length(rest), 1, p) + 1, F.lit(1))
            return F.when(wt == F.lower(wt), F.lower(new)).otherwise(new)

        muts = run.add(f"_x{i}", F.zip_with(wts, picked, other))
        spots = picked if plain else run.add(f"_y{i}", F.transform(picked, place))
        return replaced(seq, spots, muts), {"positions": picked, "wt_chars": wts, "mut_chars": muts}

    op = Operation([pool], factory="mutagenize", mode=mode, num_states=total if mode == "sequential" else num_states, natural=natural, prefix=prefix, iter_order=iter_order, region=region, remove_tags=bool(remove_tags), build=build, sample=sample, cards={"positions": "array<int>", "wt_chars": "array<string>", "mut_chars": "array<string>"})
    op.style = style

    def paint(run, seqs, out, state):
        place = run.plans.get(run.op)  # of a single mutation; a base never stays what it was
        return [(style, masks_of.differing(seqs[0], out) if place is None else masks_of.one(place, F.length(out)))]

    op.paint = paint if style else None
    out = make(op, pool.region_length(region), name, pool.regions, kind=pool.kind)
    out.plain = pool.plain
    return out


def inverse(order: Column) -> Column:
    """Where each place of a random order has gone."""
    numbered = F.transform(order, lambda p, j: F.shiftleft(p.cast("long"), Draws.PLACE).bitwiseOR(j.cast("long")))
    return F.transform(F.sort_array(numbered), lambda x: x.bitwiseAND(F.lit((1 << Draws.PLACE) - 1)).cast("int"))


def shuffle_seq(pool: Pool | str, region=None, prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, style: str | None = None, name: str | None = None, remove_tags: bool | None = None) -> Pool:
    """Permute the bases; gaps and tags keep their places."""
    if mode != "random":
        raise ValueError("shuffle_seq is random only")
    pool = as_pool(pool)

    def sample(run, args, draws):
        seq, i = args[0], run.op.id
        chars = run.add(f"_a{i}", F.split(seq, ""))
        if pool.plain and region is None:
            order = run.add(f"_p{i}", draws.ordered(F.sequence(F.lit(0), F.length(seq) - 1), 0))
            out = let(chars, lambda own: F.transform(order, lambda p: F.get(own, p)))
        else:
            places = run.add(f"_m{i}", molecular_positions(seq))
            order = run.add(f"_p{i}", draws.ordered(F.transform(places, lambda p, j: j), 0))
            out = let(chars, lambda own: let(places, lambda spots: F.transform(order, lambda p: F.get(own, F.get(spots, p)))))
            return replaced(seq, places, out), {"permutation": inverse(order)}
        return F.array_join(out, ""), {"permutation": inverse(order)}

    op = Operation([pool], factory="shuffle_seq", mode="random", num_states=num_states, prefix=prefix, iter_order=iter_order, region=region, remove_tags=bool(remove_tags), sample=sample, cards={"permutation": "array<int>"})
    op.style = style
    op.paint = (lambda run, seqs, out, state: [(style, masks_of.at(molecular_positions(out), F.length(out)))]) if style else None
    return make(op, pool.region_length(region), name, pool.regions, kind=pool.kind)


def recombine(pool: Pool | str | None = None, region=None, sources: Sequence[Pool | str] = (), num_breakpoints: int = 1, positions: Sequence[int] | None = None, mode: str = "random", num_states: int | None = None, prefix: str | None = None, styles: Sequence[str] | None = None, style_by: str = "order", iter_order: int | None = None, name: str | None = None, remove_tags: bool | None = None) -> Pool:
    """Segments of several sources of one length, neighbours from different ones. A breakpoint i is after index i.

    ``styles`` cycle over the segments in order, or with ``style_by='source'`` over the sources.
    """
    if styles is not None and not len(styles):
        raise ValueError("styles must not be empty")
    if style_by not in ("order", "source"):
        raise ValueError("style_by is order or source")
    sources = [as_pool(p) for p in sources]
    if len(sources) < 2:
        raise ValueError("two sources or more are needed")
    length = sources[0].seq_length
    if length is None or any(p.seq_length != length for p in sources):
        raise ValueError("sources must have one known length")
    k, n = num_breakpoints, len(sources)
    at = list(range(length - 1)) if positions is None else list(positions)
    if not 1 <= k <= length - 1 or k > len(at):
        raise ValueError(f"{k} breakpoints in {len(at)} positions")
    if any(not 0 <= p < length - 1 for p in at):
        raise ValueError(f"positions must be in [0, {length - 1})")
    parents = [*_within(pool, region), *sources]
    natural = comb(len(at), k) * n * (n - 1) ** k

    def segments(args, breaks, owners):
        args = args[-n:]
        out, start = [], F.lit(0)
        for j, o in enumerate(owners):
            end = breaks[j] + 1 if j < k else F.lit(length)
            picked = args[0]
            for i in range(1, n):
                picked = F.when(o == i, args[i]).otherwise(picked)
            out.append(picked.substr(start + 1, end - start))
            start = end
        return out

    def assembled(args, breaks, owners):
        whole = F.when(sum((F.when(a.isNull(), 1).otherwise(0) for a in args[-n:]), F.lit(0)) == 0, F.concat(*segments(args, breaks, owners)))
        return whole, {"breakpoints": F.array(*breaks), "pool_assignments": F.array(*owners)}

    def plan(run, s):
        """Breakpoints and owners of a state, as columns."""
        if mode == "fixed":
            return [F.lit(p) for p in sorted(at[:k])], [F.lit(i % 2) for i in range(k + 1)]
        v = s % natural
        inner = n * (n - 1) ** k
        keep = run.keeper()
        ranks = unranked(div(v, inner), len(at), k, keep)
        breaks = [keep(f"b{j}", lookup(at, r.cast("long"))) for j, r in enumerate(ranks)]
        if at != sorted(at):
            ordered = F.array_sort(F.array(*breaks))
            breaks = [ordered[i] for i in range(k)]
        rest = v % inner
        owners = [keep("o0", div(rest, (n - 1) ** k).cast("int"))]
        for d in digits(rest % (n - 1) ** k, n - 1, k):  # the d-th of the sources other than the one before
            owners.append(keep(f"o{len(owners)}", (d + F.when(d >= owners[-1], 1).otherwise(0)).cast("int")))
        return breaks, owners

    def build(run, args, s):
        run.plans[run.op] = plan(run, s)
        return assembled(args, *run.plans[run.op])

    def chosen(run, state):
        if mode == "random":
            return [F.col(f"_p{run.op.id}")[j] for j in range(k)], [F.col(f"_o{run.op.id}x{j}") for j in range(k + 1)]
        return run.plans[run.op]

    def follow(run, masks, seqs, out, state):
        return F.concat(*segments(masks, *chosen(run, state)))

    def paint(run, seqs, out, state):
        breaks, owners = chosen(run, state)
        ends = [*(b + 1 for b in breaks), F.lit(length)]
        sizes = [b - a for a, b in zip([F.lit(0), *ends], ends)]
        turns = [F.lit(j) for j in range(k + 1)] if style_by == "order" else owners
        return [(x, F.concat(*[F.repeat(F.when(t % len(styles) == q, "1").otherwise("0"), z.cast("int")) for t, z in zip(turns, sizes)])) for q, x in enumerate(styles) if x]

    def sample(run, args, draws):
        i = run.op.id
        ordered = run.add(f"_p{i}", draws.chosen(F.array(*map(F.lit, at)), k, 0))
        owners = [run.add(f"_o{i}x0", draws.below(n, 1))]
        for j in range(1, k + 1):
            d = draws.below(n - 1, 1, j)
            owners.append(run.add(f"_o{i}x{j}", (d + F.when(d >= owners[-1], 1).otherwise(0)).cast("int")))
        return assembled(args, [ordered[j] for j in range(k)], owners)

    op = Operation(parents, factory="recombine", mode=mode, num_states=(num_states or natural) if mode == "sequential" else num_states if mode == "random" else None, natural=natural, prefix=prefix, iter_order=iter_order, region=region, remove_tags=bool(remove_tags), build=build, sample=sample, cards={"breakpoints": "array<int>", "pool_assignments": "array<int>"})
    op.follow, op.paint = follow, paint if styles else None
    return make(op, length, name, parents[0].regions if pool is not None else (), kind=sources[0].kind)
