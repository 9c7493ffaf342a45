"""Reading frames: codon substitutions, translation and its reverse."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import functions as F

from ..functions.codons import UNIFORM_MUTATION_TYPES, VALID_MUTATION_TYPES, CodonTable
from ..functions.dna import reverse_complement_column, strip_tags_column
from ..plans import styles
from ..plans.pool import FRAMES, Operation, OrfRegion, Pool, as_pool, get_session, make, regions_in, replaced
from ..plans.tags import molecular_positions
from .fixed import stylize
from .mutate import digits, div, unranked
from .regions import insert_tags, validate_positions


def validate_orf_extent(extent: Sequence[int], length: int | None) -> None:
    a, b = extent
    if a < 0 or b <= a or (length is not None and b > length):
        raise ValueError(f"no interval of the sequence: {extent}")


def annotate_orf(pool: Pool | str, name: str, extent: Sequence[int] | None = None, frame: int = 1, style: str | None = None, style_codons: Sequence[str] | None = None, style_frames: Sequence[str] | None = None, iter_order: int | None = None, prefix: str | None = None) -> Pool:
    """Tag a reading frame and register it."""
    pool = as_pool(pool)
    if sum(x is not None for x in (style, style_codons, style_frames)) > 1:
        raise ValueError("give one of style, style_codons and style_frames")
    if frame not in FRAMES:
        raise ValueError(f"frame must be one of {FRAMES}")
    if name in pool.regions:
        if extent is not None:
            raise ValueError(f"region {name!r} exists; extent cannot be given")
        out, last = pool, {"iter_order": iter_order, "prefix": prefix}
    else:
        extent = extent or (0, pool.seq_length)
        validate_orf_extent(extent, pool.seq_length)
        out, last = insert_tags(pool, name, *extent, iter_order=iter_order, prefix=prefix), {}
    known = pool.session.get_region(name)
    if not isinstance(known, OrfRegion):
        pool.session.upgrade_to_orf_region(name, frame)
    elif known.frame != frame:
        raise ValueError(f"region {name!r} has frame {known.frame}, which cannot change")
    if style:
        return stylize(out, region=name, style=style, **last)
    if style_codons or style_frames:
        return stylize_orf(out, name, style_codons=style_codons, style_frames=style_frames, **last)
    return out


def stylize_orf(pool: Pool | str, region=None, style_codons: Sequence[str] | None = None, style_frames: Sequence[str] | None = None, frame: int | None = None, iter_order: int | None = None, prefix: str | None = None, name: str | None = None) -> Pool:
    """Cycle styles over codons, or over the three places in them; sequences stay."""
    if (style_codons is None) == (style_frames is None):
        raise ValueError("give style_codons or style_frames")
    if not (style_codons or style_frames) or (style_frames and len(style_frames) % 3):
        raise ValueError("style_codons must not be empty, and style_frames are so many times three")
    out = stylize(pool, region=region, style=(style_codons or style_frames)[0], iter_order=iter_order, prefix=prefix, name=name)
    op, frame = out.operation, _frame(out, region, frame)
    op.factory = "stylize_orf"
    op.paint = lambda run, seqs, seq, state: styles.framed(seq, region, lambda r: run.parts(op.parents[0], seq, r), style_codons, style_frames, frame, run.keeper())
    return out


def _frame(pool: Pool, region, frame: int | None = None) -> int:
    """The frame given, else that of the region, else 1 (for plain regions too)."""
    if frame is None:
        known = pool.session.regions.get(region) if isinstance(region, str) else None
        frame = known.frame if isinstance(known, OrfRegion) else 1
    if frame not in FRAMES:
        raise ValueError(f"frame must be one of {FRAMES}")
    return frame


def mutagenize_orf(pool: Pool | str, region=None, num_mutations: int | None = None, mutation_rate: float | None = None, mutation_type: str = "missense_only_first", codon_positions: Sequence[int] | slice | None = None, style: str | None = None, frame: int | None = None, prefix: str | None = None, mode: str = "random", num_states: int | None = None, iter_order: int | None = None, name: str | None = None) -> Pool:
    """Substitute whole codons. Frames 2 and 3 leave out the first 2 bases and the first one."""
    pool = as_pool(pool)
    if (num_mutations is None) == (mutation_rate is None):
        raise ValueError("give num_mutations or mutation_rate")
    if num_mutations is not None and num_mutations < 1:
        raise ValueError("num_mutations must be 1 or more")
    if mutation_rate is not None and (not 0 <= mutation_rate <= 1 or mode == "sequential"):
        raise ValueError("mutation_rate must be in [0, 1], and is random only")
    if mutation_type not in VALID_MUTATION_TYPES:
        raise ValueError(f"mutation_type must be one of {sorted(VALID_MUTATION_TYPES)}")
    if mode == "sequential" and mutation_type not in UNIFORM_MUTATION_TYPES:
        raise ValueError(f"sequential mode takes one of {sorted(UNIFORM_MUTATION_TYPES)}")
    length = pool.molecular_length(region)
    if length is None:
        raise ValueError("a reading frame needs a known length")
    frame = _frame(pool, region, frame)
    table: CodonTable = pool.session.codon_table
    skip, reverse = (4 - abs(frame)) % 3, frame < 0
    codons = (length - skip) // 3
    eligible = validate_positions(codon_positions, codons)
    k = num_mutations
    if k is not None and k > len(eligible):
        raise ValueError(f"{k} mutations in {len(eligible)} codons")
    alts = UNIFORM_MUTATION_TYPES.get(mutation_type)
    plain = pool.plain and region is None
    natural = comb(len(eligible), k) * alts**k if mode == "sequential" else None

    # alternatives of all codons one after the other, each in ``width`` places, and how many each has
    own = [table.get_mutations(c, mutation_type) for c in table.all_codons]
    width = max(map(len, own))
    known = ",".join(table.all_codons)
    written = "".join("".join(x).ljust(3 * width) for x in own)
    sizes, residues = "".join(chr(48 + len(x)) for x in own), "".join(table.codon_to_aa.get(c, "?") for c in table.all_codons)

    def substituted(run, seq, picked, pick):
        """The codons at these places changed; ``pick(n, codon place, j)`` says which of n alternatives the j-th one gets."""
        i = run.op.id
        places = None if plain else run.add(f"_m{i}", molecular_positions(seq))
        count = F.length(seq) if plain else F.size(places)
        first = (lambda c: count - skip - (c + 1) * 3) if reverse else (lambda c: c * 3 + skip)
        place = (lambda p: p) if plain else (lambda p: F.get(places, p))
        turned = reverse_complement_column if reverse else (lambda x: x)
        wts = run.add(f"_w{i}", F.transform(picked, lambda c: turned(F.upper(F.concat(*[seq.substr(place(first(c) + j) + 1, F.lit(1)) for j in range(3)])))))
        spot = run.add(f"_s_{i}", F.transform(wts, lambda c: F.instr(F.lit(known), c)))  # 4 for each codon before, and 1; 0: unknown
        index = lambda at: F.call_function("div", at, F.lit(4)).cast("int")
        many = lambda at: F.when(at > 0, F.ascii(F.lit(sizes).substr(index(at) + 1, F.lit(1))) - 48).otherwise(0)
        choices = run.add(f"_n{i}", F.transform(spot, lambda at, j: F.struct(index(at).alias("codon"), many(at).alias("n"), pick(many(at), F.get(picked, j), j).cast("int").alias("d"))))
        mut = lambda x, wt: F.when(x["n"] == 0, wt).when(x["d"] < x["n"], F.lit(written).substr((x["codon"] * width + x["d"]) * 3 + 1, F.lit(3)))
        muts = run.add(f"_x{i}", F.zip_with(choices, wts, mut))
        placed = F.array_sort(F.zip_with(picked, muts, lambda c, m: F.struct(first(c).cast("int").alias("at"), turned(m).alias("letters"))))
        placed = run.add(f"_o{i}", placed)
        spots = run.add(f"_y{i}", F.flatten(F.transform(placed, lambda x: F.array(*[place(x["at"] + j) for j in range(3)]))))
        letters = run.add(f"_l{i}", F.split(F.array_join(F.transform(placed, lambda x: x["letters"]), ""), ""))
        aas = lambda x: F.transform(x, lambda c: F.when(F.instr(F.lit(known), c) > 0, F.lit(residues).substr(index(F.instr(F.lit(known), c)) + 1, F.lit(1))).otherwise("?"))
        out = F.when(~F.exists(muts, lambda m: m.isNull()), replaced(seq, spots, letters))
        return out, dict(zip(run.op.cards, (picked, wts, muts, aas(wts), aas(muts))))

    def build(run, args, s):
        v = s % natural
        ranks = unranked(div(v, alts**k), len(eligible), k, run.keeper() if k > 1 else None)
        where = F.array(*map(F.lit, eligible))
        picked = run.add(f"_p{run.op.id}", F.array(*[F.element_at(where, r + 1) for r in ranks]))
        picks = run.add(f"_d{run.op.id}", F.array(*digits(v % alts**k, alts, k)))
        return substituted(run, args[0], picked, lambda n, c, j: F.get(picks, j))

    def sample(run, args, draws):
        usable = F.array(*map(F.lit, eligible))
        picked = draws.chosen(usable, k, 0) if k is not None else F.filter(usable, lambda c: draws.happens(mutation_rate, 0, c))
        picked = run.add(f"_p{run.op.id}", picked.cast("array<int>"))
        return substituted(run, args[0], picked, lambda n, c, j: draws.below(F.greatest(n, F.lit(1)), 1, c))

    cards = {"codon_positions": "array<int>", "wt_codons": "array<string>", "mut_codons": "array<string>", "wt_aas": "array<string>", "mut_aas": "array<string>"}
    op = Operation([pool], factory="mutagenize_orf", mode=mode, num_states=natural if mode == "sequential" else num_states, natural=natural, prefix=prefix, iter_order=iter_order, region=region, build=build, sample=sample, cards=cards)
    op.style = style
    op.paint = (lambda run, seqs, out, state: [(style, styles.at(F.col(f"_y{run.op.id}"), F.length(out)))]) if style else None
    return make(op, pool.region_length(region), name, pool.regions, kind=pool.kind)


def translate(pool: Pool | str, region=None, frame: int | None = None, include_stop: bool = True, preserve_codon_styles: bool = True, genetic_code: str | dict | None = None, iter_order: int | None = None, prefix: str | None = None, name: str | None = None) -> Pool:
    """DNA to protein; frame f leaves out |f| - 1 bases, unknown codons are '?'. The genetic code is the session's if none is given."""
    from .fixed import extract

    pool = as_pool(pool)
    frame = _frame(pool, region, frame)
    length = pool.region_length(region)
    source = pool if region is None else extract(pool, region)
    off = abs(frame) - 1
    table = pool.session.codon_table if genetic_code is None else CodonTable(genetic_code)

    def build(run, args, s):
        bases = F.upper(args[0] if source.plain else F.regexp_replace(strip_tags_column(args[0]), "[^ACGTacgt]", ""))
        bases = reverse_complement_column(bases) if frame < 0 else bases
        names = F.create_map(*[F.lit(x) for c, a in table.codon_to_aa.items() for x in (c, a)])
        codons = F.regexp_extract_all(bases.substr(F.lit(off + 1), F.length(bases)), F.lit("(.{3})"), 1)
        out = F.array_join(F.transform(codons, lambda c: F.coalesce(names[c], F.lit("?"))), "")
        return out if include_stop else F.replace(out, F.lit("*"), F.lit(""))

    def follow(run, masks, seqs, out, state):
        """A residue has the styles that all three bases have."""
        mask = styles.molecular(masks[0], seqs[0])
        mask = (F.reverse(mask) if frame < 0 else mask).substr(F.lit(off + 1), F.length(mask))
        shared = F.transform(F.regexp_extract_all(mask, F.lit("(.{3})"), 1), lambda x: F.when(x == "111", "1").otherwise("0"))
        if not include_stop:
            bases = F.upper(F.regexp_replace(strip_tags_column(seqs[0]), "[^ACGTacgt]", ""))
            bases = reverse_complement_column(bases) if frame < 0 else bases
            codons = F.regexp_extract_all(bases.substr(F.lit(off + 1), F.length(bases)), F.lit("(.{3})"), 1)
            stops = [c for c, a in table.codon_to_aa.items() if a == "*"]
            shared = F.zip_with(shared, codons, lambda m, c: F.when(c.isin(stops), "").otherwise(m))
        return F.array_join(shared, "")

    op = Operation([source], factory="translate", iter_order=iter_order, prefix=prefix, build=build)
    op.follow = follow if preserve_codon_styles else styles.blank
    n = max(0, (length - off) // 3) if length is not None and include_stop else None
    return Pool(op, n, name, kind="protein")


def from_protein(seq: str) -> Pool:
    regions_in(seq, get_session())
    return Pool(Operation([], factory="from_protein", build=lambda run, args, s: F.lit(seq)), len(seq), kind="protein", template=seq)


def reverse_translate(pool: Pool | str, region=None, codon_selection: str = "first", num_states: int | None = None, genetic_code: str | dict | None = None, iter_order: int | None = None, prefix: str | None = None, name: str | None = None) -> Pool:
    """Protein to DNA by each residue's most frequent codon, or by random ones."""
    if codon_selection not in ("first", "random"):
        raise ValueError("codon_selection is first or random")
    pool = from_protein(pool) if isinstance(pool, str) else pool
    codons = (pool.session.codon_table if genetic_code is None else CodonTable(genetic_code)).aa_to_codons
    letters = "".join(codons)

    def build(run, args, s):
        first = F.create_map(*[F.lit(x) for a, c in codons.items() for x in (a, c[0])])
        known = F.filter(F.split(F.upper(args[0]), ""), lambda a: first[a].isNotNull())
        return F.array_join(F.transform(known, lambda a: first[a]), "")

    def sample(run, args, draws):
        every = F.create_map(*[x for a, c in codons.items() for x in (F.lit(a), F.array(*map(F.lit, c)))])
        known = run.add(f"_a{run.op.id}", F.filter(F.split(F.upper(args[0]), ""), lambda a: F.instr(F.lit(letters), a) * F.length(a) > 0))
        return F.array_join(F.transform(known, lambda a, i: F.get(every[a], draws.below(F.size(every[a]), 0, i))), "")

    op = Operation([pool], factory="reverse_translate", mode="random" if codon_selection == "random" else "fixed", num_states=num_states if codon_selection == "random" else None, region=region, iter_order=iter_order, prefix=prefix, build=build, sample=sample)
    op.follow = lambda run, masks, seqs, out, state: F.array_join(F.zip_with(F.split(masks[0], ""), F.split(F.upper(seqs[0]), ""), lambda m, a: F.when((a != "") & (F.instr(F.lit(letters), a) > 0), F.repeat(m, F.lit(3))).otherwise("")), "")
    n = pool.region_length(region)
    return make(op, None if n is None else 3 * n, name, kind="dna")
