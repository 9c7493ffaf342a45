"""Styles of sequences as data: which characters of each row carry which style, whatever the operators have done since.

A style that an operator adds is a layer: its specification is known when the plan is made, and a row has a mask for it, a string of 0
and 1 as long as the sequence (tags included). An operator's ``follow`` moves masks as it moves the characters, so slices, joins,
reversals and inserts are the same string functions; its ``paint`` gives the masks of the layers it adds. Layers that no row of
the result needs are not computed, and without styles none is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dna import TAG, let

KIND = "array<struct<spec:string,positions:array<int>>>"


def fill(n: Column | int, bit: int = 0) -> Column:
    """A mask of one value."""
    return F.repeat(F.lit(str(bit)), F.lit(n) if isinstance(n, int) else n)


def blank(run, masks: Sequence[Column], seqs: Sequence[Column], out: Column, state: Column) -> Column:
    """For operators whose characters are all new."""
    return fill(F.length(out))


def same(run, masks: Sequence[Column], seqs: Sequence[Column], out: Column, state: Column) -> Column:
    """For operators that keep the first parent's characters in place."""
    n = F.length(out)
    return F.rpad(F.substr(masks[0], F.lit(1), n), n, F.lit("0"))


def marked_tags(seq: Column) -> Column:
    """The characters of tags become <, > and #."""
    return F.when(F.instr(seq, ">") == 0, seq).otherwise(F.regexp_replace(seq, r"[^<>](?=[^<>]*>)", "#"))


def untagged(seq: Column) -> Column:
    """The mask of the characters outside tags."""
    bare = (F.instr(seq, "<") == 0) & (F.instr(seq, ">") == 0) & (F.instr(seq, "#") == 0)
    return F.when(bare, fill(F.length(seq), 1)).otherwise(F.translate(F.regexp_replace(marked_tags(seq), "[^<>#]", "1"), "<>#", "000"))


def of_class(text: Column, members: str) -> Column:
    """The mask of the characters of a regular expression's class (without 0)."""
    return F.regexp_replace(F.regexp_replace(text, f"[^{members}]", "0"), "[^0]", "1")


def bases(seq: Column, alphabet: str = "ACGTacgt") -> Column:
    """The mask of the alphabet's characters outside tags."""
    return of_class(marked_tags(seq), alphabet)


def chars_where(mask: Column, seq: Column, test: Callable[[Column], Column]) -> Column:
    """The mask at the characters of seq (tags' ones as in ``marked_tags``) that pass the test."""
    return F.array_join(F.zip_with(F.split(mask, ""), F.split(marked_tags(seq), ""), lambda m, c: F.when((c != "") & test(c), m).otherwise("")), "")


def outside(mask: Column, seq: Column) -> Column:
    """The mask without the characters of tags."""
    return F.when(~seq.rlike("[<>#]"), mask).otherwise(chars_where(mask, seq, lambda c: F.instr(F.lit("<>#"), c) == 0))


def molecular(mask: Column, seq: Column, alphabet: str = "ACGTacgt") -> Column:
    return chars_where(mask, seq, lambda c: F.instr(F.lit(alphabet), c) > 0)


def tag_lengths(name: str) -> tuple[int, int]:
    return len(name) + 2, len(name) + 3


def wrapped(name: str, mask: Column) -> Column:
    """The mask of content once tags are put about it."""
    opening, closing = tag_lengths(name)
    return F.when(mask == "", fill(closing)).otherwise(F.concat(fill(opening), mask, fill(closing)))


def scattered(spots: Column, bits: Column, n: Column) -> Column:
    """The mask of n characters that has the bits at these places, which are in order."""
    ahead = lambda own, p, j: F.repeat(F.lit("0"), p - F.coalesce(F.get(own, j - 1), F.lit(-1)) - 1)
    placed = lambda own, bit: F.array_join(F.transform(own, lambda p, j: F.concat(ahead(own, p, j), bit.substr(j + 1, F.lit(1)))), "")
    return F.rpad(let(spots, lambda own: let(bits, lambda bit: placed(own, bit))), n, F.lit("0"))


def at(spots: Column, n: Column) -> Column:
    """The mask of n characters with these places set."""
    return let(F.array_sort(F.array_distinct(spots)), lambda own: scattered(own, F.repeat(F.lit("1"), F.size(own)), n))


def one(place: Column, n: Column) -> Column:
    """The mask of n characters with one place set."""
    return F.concat(fill(place), F.lit("1"), fill(n - place - 1))


def differing(before: Column, after: Column) -> Column:
    """Set where two sequences of one length differ."""
    return F.array_join(F.zip_with(F.split(before, ""), F.split(after, ""), lambda a, b: F.when(a == b, F.when(a == "", "").otherwise("0")).otherwise("1")), "")


def matching(seq: Column, pattern: str) -> Column:
    """Set at all characters of the pattern's matches."""
    pieces = F.split(F.regexp_replace(seq, f"(?:{pattern})", "\u0001$0\u0002"), "[\u0001\u0002]")
    return F.array_join(F.transform(pieces, lambda p, i: F.repeat(F.when(i % 2 == 1, "1").otherwise("0"), F.length(p))), "")


def within(seq: Column, region: str | Sequence[int] | None, parts: Callable, tags: bool) -> tuple[Column, Column]:
    """Start and stop of a region's content (or with its tags) in seq; an empty interval where there is none."""
    n = F.length(seq)
    if region is None:
        return F.lit(0), n
    if not isinstance(region, str):
        return F.least(F.lit(region[0]), n), F.least(F.lit(region[1]), n)
    before, inside, after = parts(region)
    start, stop = F.length(before), n - F.length(after)
    opening, closing = tag_lengths(region)
    if not tags:
        alone = F.length(inside) == 0
        start, stop = F.when(alone, stop).otherwise(start + opening), F.when(alone, stop).otherwise(stop - closing)
    return F.coalesce(start, F.lit(0)), F.coalesce(stop, F.lit(0))


#: For each choice of ``stylize``: a class of characters outside tags. The others are all characters, those outside tags, and tags.
CHOICES = {"all": None, "contents": None, "upper": "A-Z", "lower": "a-z", "gap": r"\-. ", "tags": None}


def stylized(seq: Column, region, parts: Callable, which: str, regex: str | None) -> Column:
    """The mask of a layer of ``stylize``."""
    if regex is None and which == "tags":
        regex = rf"</?{region}\s*/?>" if isinstance(region, str) else TAG
    n = F.length(seq)
    start, stop = within(seq, region, parts, not (which == "contents" and regex is None))
    size = F.greatest(stop - start, F.lit(0))
    own = lambda text: F.substr(text, start + 1, size)
    if regex is not None:
        mask = matching(own(seq), regex)
    elif which == "all":
        mask = fill(size, 1)
    else:
        mask = own(untagged(seq) if which == "contents" else of_class(marked_tags(seq), CHOICES[which]))
    return F.when(n == 0, F.lit("")).otherwise(F.rpad(F.concat(fill(start), mask), n, F.lit("0")))


def framed(seq: Column, region, parts: Callable, codons: Sequence[str] | None, frames: Sequence[str] | None, frame: int, keep: Callable[[str, Column], Column]) -> list[tuple[str, Column]]:
    """The layers of ``stylize_orf``: styles cycle over codons, or over the places in them and then over groups of three.

    What they do repeats after some bases, so a layer is a piece of a repeated string, put where the bases are. ``keep`` makes a column.
    """
    n = F.length(seq)
    start, stop = within(seq, region, parts, False)
    inside = keep("in", F.rpad(F.concat(fill(start), F.substr(bases(seq), start + 1, F.greatest(stop - start, F.lit(0)))), n, F.lit("0")))
    count = keep("count", F.length(F.replace(inside, F.lit("0"), F.lit(""))))
    first, _, gaps = stretch(inside)
    shift = abs(frame) - 1
    every = codons or frames
    period = 3 * len(codons) if codons else len(frames)
    turns = [(j + shift) // 3 % len(codons) if codons else j // 3 % (len(frames) // 3) * 3 + (j + shift) % 3 for j in range(period)]

    def layer(i: int, own: set[int]) -> Column:
        unit = "".join("1" if t in own else "0" for t in turns)
        bits = F.repeat(F.lit(unit), F.floor(count / period).cast("int") + 1).substr(F.lit(1), count)
        bits = keep(f"bits{i}", F.reverse(bits) if frame < 0 else bits)
        return F.when(gaps, scattered(every_place(inside), bits, n)).otherwise(F.rpad(F.concat(fill(first - 1), bits), n, F.lit("0")))

    return [(spec, layer(i, {t for t, x in enumerate(every) if x == spec})) for i, spec in enumerate(dict.fromkeys(every))]


def every_place(mask: Column) -> Column:
    found = F.transform(F.split(mask, ""), lambda c, i: F.when(c == "1", i))
    return F.filter(found, lambda i: i.isNotNull())


def stretch(mask: Column) -> tuple[Column, Column, Column]:
    """The first place that is set and the last of those right after it (from 1 on; 0: none is), and whether others follow."""
    locate = lambda bit, start: F.call_function("locate", F.lit(bit), mask, start)
    first = F.instr(mask, "1")
    clear = locate("0", first)
    last = F.when(clear == 0, F.length(mask)).otherwise(clear - 1)
    return first, last, locate("1", last + 1) > 0


def positions(mask: Column) -> Column:
    """The places that are set; those of a single stretch are a range."""
    first, last, more = stretch(mask)
    return F.when(first == 0, F.array().cast("array<int>")).when(~more, F.sequence(first - 1, last - 1)).otherwise(every_place(mask))


def gathered(layers: Sequence[tuple[str, Column]], keep: Callable[[str, Column], Column]) -> Column:
    """All layers that have a place, in order, as ``KIND``. ``keep`` makes a column of the places, so that they are found by compiled code."""
    if not layers:
        return F.array().cast(KIND)
    found = [(spec, keep(f"at{i}", positions(mask))) for i, (spec, mask) in enumerate(layers)]
    return F.array_compact(F.array(*[F.when(F.size(at) > 0, F.struct(F.lit(spec).alias("spec"), at.alias("positions"))) for spec, at in found]))
