"""Named regions inside strings: ``<name>content</name>`` and ``<name/>``, in Python and as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dna import TAG, strip_tags

_tag = re.compile(r"<(/?)(\w+)\s*(/?)>")


@dataclass(frozen=True)
class ParsedRegion:
    name: str
    start: int  # of the opening tag
    end: int  # after the closing tag
    content_start: int
    content_end: int
    content: str


def find_all_regions(seq: str) -> list[ParsedRegion]:
    """All regions by place; ValueError where tags do not match."""
    found, open_ = [], []
    for m in _tag.finditer(seq):
        closing, name, alone = m[1], m[2], m[3]
        if alone:
            found.append(ParsedRegion(name, m.start(), m.end(), m.end(), m.end(), ""))
        elif not closing:
            open_.append((name, m))
        elif not open_ or open_[-1][0] != name:
            raise ValueError(f"</{name}> closes nothing in {seq!r}")
        else:
            _, o = open_.pop()
            found.append(ParsedRegion(name, o.start(), m.end(), o.end(), m.start(), seq[o.end() : m.start()]))
    if open_:
        raise ValueError(f"<{open_[-1][0]}> is not closed in {seq!r}")
    return sorted(found, key=lambda r: (r.start, -r.end))


def has_region(seq: str, name: str) -> bool:
    return any(r.name == name for r in find_all_regions(seq))


def validate_single_region(seq: str, name: str) -> ParsedRegion:
    found = [r for r in find_all_regions(seq) if r.name == name]
    if len(found) != 1:
        raise ValueError(f"region {name!r} occurs {len(found)} times in {seq!r}, not once")
    return found[0]


def parse_region(seq: str, name: str) -> tuple[str, str, str]:
    r = validate_single_region(seq, name)
    return seq[: r.start], r.content, seq[r.end :]


strip_all_tags = strip_tags


def get_length_without_tags(seq: str) -> int:
    return len(strip_tags(seq))


def get_nontag_positions(seq: str) -> list[int]:
    inside = {i for m in _tag.finditer(seq) for i in range(m.start(), m.end())}
    return [i for i in range(len(seq)) if i not in inside]


def get_literal_positions(seq: str) -> list[int]:
    return list(range(len(seq)))


def nontag_pos_to_literal_pos(seq: str, pos: int) -> int:
    places = get_nontag_positions(seq)
    if not 0 <= pos <= len(places):
        raise ValueError(f"position {pos} is not in [0, {len(places)}]")
    return places[pos] if pos < len(places) else len(seq)


def build_region_tags(name: str, content: str) -> str:
    return f"<{name}>{content}</{name}>" if content else f"<{name}/>"


# --- column twins ---------------------------------------------------------------------------------------------------
def tagged(name: str, content: Column) -> Column:
    return F.when(content == "", F.lit(f"<{name}/>")).otherwise(F.concat(F.lit(f"<{name}>"), content, F.lit(f"</{name}>")))


def parts(seq: Column, name: str) -> tuple[Column, Column, Column]:
    """What stands before, in and after a region."""
    pattern = rf"(?s)^(.*?)<{name}\s*(?:/>|>(.*?)</{name}\s*>)(.*)$"
    return tuple(F.when(seq.rlike(pattern), F.regexp_extract(seq, pattern, i)) for i in (1, 2, 3))


def literal_prefix(seq: Column, n: Column, through_tags: bool) -> Column:
    """The beginning of seq that holds n characters outside tags (and the tags right after them)."""
    head = F.concat(F.lit(rf"^((?:(?:{TAG})*[^<]){{"), n.cast("string"), F.lit(rf"}}(?:{TAG})*)" if through_tags else "})"))
    return F.call_function("regexp_extract", seq, head, F.lit(1))


def outside_tags(seq: Column, f) -> Column:
    """f on the stretches between tags."""
    pieces = F.split(F.regexp_replace(seq, rf"({TAG})", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("<")), p).otherwise(f(p))), "")


def molecular_positions(seq: Column, alphabet: str = "ACGTacgt") -> Column:
    """0-based places of the alphabet's characters outside tags."""
    masked = F.when(F.instr(seq, ">") == 0, seq).otherwise(F.regexp_replace(seq, r"[^<>](?=[^<>]*>)", "#"))
    found = F.transform(F.split(masked, ""), lambda c, i: F.when((c != "") & (F.instr(F.lit(alphabet), c) > 0), i))
    return F.filter(found, lambda i: i.isNotNull())


def nontag_positions(seq: Column) -> Column:
    """0-based places of the characters outside tags."""
    masked = F.when(F.instr(seq, ">") == 0, seq).otherwise(F.regexp_replace(seq, r"[^<>](?=[^<>]*>)", "#"))
    found = F.transform(F.split(masked, ""), lambda c, i: F.when((c != "") & (F.instr(F.lit("<>#"), c) == 0), i))
    return F.filter(found, lambda i: i.isNotNull())
