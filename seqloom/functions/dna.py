"""DNA constants and per-sequence measures, for Python strings and for Spark columns alike."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ["A", "C", "G", "T"]
# IUPAC codes.
IUPAC_TO_DNA = {
    "A": ["A"], "C": ["C"], "G": ["G"], "T": ["T"], "U": ["T"],
    "R": ["A", "G"], "Y": ["C", "T"], "S": ["G", "C"], "W": ["A", "T"], "K": ["G", "T"], "M": ["A", "C"],
    "B": ["C", "G", "T"], "D": ["A", "G", "T"], "H": ["A", "C", "T"], "V": ["A", "C", "G"], "N": ["A", "C", "G", "T"],
}
_COMP = dict(zip("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"))
COMPLEMENT = _COMP | {k.lower(): v.lower() for k, v in _COMP.items()}
IGNORE_CHARS = {"-", ".", " "}
VALID_CHARS = set("ACGTacgt")
TAG = r"</?\w+\s*/?>"

# Recognition sites of restriction enzymes.
ENZYME_SITES = {
    "EcoRI": "GAATTC", "BamHI": "GGATCC", "HindIII": "AAGCTT", "XhoI": "CTCGAG", "NdeI": "CATATG", "XbaI": "TCTAGA", "SalI": "GTCGAC",
    "PstI": "CTGCAG", "SphI": "GCATGC", "SacI": "GAGCTC", "SacII": "CCGCGG", "KpnI": "GGTACC", "NcoI": "CCATGG", "NheI": "GCTAGC",
    "NotI": "GCGGCCGC", "EcoRV": "GATATC", "ClaI": "ATCGAT", "BglII": "AGATCT", "SpeI": "ACTAGT", "AvrII": "CCTAGG", "MluI": "ACGCGT",
    "NruI": "TCGCGA", "SnaBI": "TACGTA", "StuI": "AGGCCT", "ScaI": "AGTACT", "PvuI": "CGATCG", "PvuII": "CAGCTG", "ApaI": "GGGCCC",
    "BspEI": "TCCGGA", "AgeI": "ACCGGT", "AflII": "CTTAAG", "AscI": "GGCGCGCC", "FseI": "GGCCGGCC", "PacI": "TTAATTAA", "PmeI": "GTTTAAAC",
    "SwaI": "ATTTAAAT", "SfiI": "GGCCNNNNNGGCC", "AatII": "GACGTC", "AccI": "GTMKAC", "BstBI": "TTCGAA", "Eco53kI": "GAGCTC", "HpaI": "GTTAAC",
    "MfeI": "CAATTG", "NsiI": "ATGCAT", "SbfI": "CCTGCAGG", "SgrAI": "CRCCGGYG", "XmaI": "CCCGGG", "SmaI": "CCCGGG",
    "BsaI": "GGTCTC", "BsmBI": "CGTCTC", "BbsI": "GAAGAC", "SapI": "GCTCTTC", "AarI": "CACCTGC", "BspQI": "GCTCTTC", "BtgZI": "GCGATG",
    "BsmFI": "GGGAC", "FokI": "GGATG", "BtsI": "GCAGTG", "BspMI": "ACCTGC", "Esp3I": "CGTCTC", "BpiI": "GAAGAC", "LguI": "GCTCTTC",
    "DpnI": "GATC", "DpnII": "GATC", "Sau3AI": "GATC", "MboI": "GATC", "AluI": "AGCT", "HaeIII": "GGCC", "HhaI": "GCGC", "MspI": "CCGG",
    "HpaII": "CCGG", "TaqI": "TCGA", "RsaI": "GTAC", "CviQI": "GTAC", "HinP1I": "GCGC", "BfaI": "CTAG", "NlaIII": "CATG", "CviAII": "CATG",
    "HincII": "GTYRAC", "BalI": "TGGCCA", "DraI": "TTTAAA", "EcoICRI": "GAGCTC", "Ecl136II": "GAGCTC", "MscI": "TGGCCA", "NaeI": "GCCGGC",
    "PmlI": "CACGTG", "ZraI": "GACGTC", "BstYI": "RGATCY", "StyI": "CCWWGG", "BstNI": "CCWGG", "SfcI": "CTRYAG", "BsrFI": "RCCGGY",
    "PspGI": "CCWGG", "AvaI": "CYCGRG", "BanII": "GRGCYC", "HinfI": "GANTC", "DdeI": "CTNAG", "AflIII": "ACRYGT", "BanI": "GGYRCC",
    "AccB7I": "CCANNNNNTGG", "PflMI": "CCANNNNNTGG", "BstAPI": "GCANNNNNTGC", "DrdI": "GACNNNNNNGTC", "AhdI": "GACNNNNNGTC",
    "BsrDI": "GCAATG", "BsrGI": "TGTACA", "BsiWI": "CGTACG", "BlpI": "GCTNAGC", "Bsu36I": "CCTNAGG", "PsiI": "TTATAA", "MseI": "TTAA",
    "Tsp509I": "AATT",
}
# Named groups of enzymes.
ENZYME_PRESETS = {
    "golden_gate": "BsaI BsmBI BbsI SapI AarI BspQI Esp3I BpiI".split(),
    "common": "EcoRI BamHI HindIII XhoI NdeI XbaI SalI PstI SacI KpnI NcoI NheI NotI SpeI EcoRV SmaI BglII ClaI ApaI MluI".split(),
    "mcs": "EcoRI SacI KpnI SmaI BamHI XbaI SalI PstI SphI HindIII".split(),
    "gibson": "EcoRI BamHI HindIII XhoI NdeI NotI XbaI SpeI PstI SacI".split(),
    "frequent_cutters": "DpnI DpnII Sau3AI MboI AluI HaeIII HhaI MspI HpaII TaqI RsaI BfaI NlaIII MseI".split(),
    "rare_cutters": "NotI AscI FseI PacI PmeI SwaI SbfI".split(),
    "blunt": "EcoRV SmaI StuI ScaI PvuII HpaI NruI SnaBI AluI HaeIII DraI NaeI PmlI".split(),
}
_by_lower = {k.lower(): k for k in ENZYME_SITES}


def get_enzyme_site(name: str) -> str:
    if name.lower() not in _by_lower:
        raise ValueError(f"unknown restriction enzyme {name!r}")
    return ENZYME_SITES[_by_lower[name.lower()]]


def get_preset_enzymes(preset: str) -> list[str]:
    if preset.lower() not in ENZYME_PRESETS:
        raise ValueError(f"unknown enzyme preset {preset!r}")
    return list(ENZYME_PRESETS[preset.lower()])


def reverse_complement(seq: str) -> str:
    return seq.translate(str.maketrans(COMPLEMENT))[::-1]


def reverse_complement_column(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "".join(COMPLEMENT), "".join(COMPLEMENT.values())))


def strip_tags(seq: str) -> str:
    return re.sub(TAG, "", seq)


def strip_tags_column(seq: Column) -> Column:
    return F.regexp_replace(seq, TAG, "")


def iupac_regex(site: str) -> str:
    return "".join(o[0] if len(o := IUPAC_TO_DNA[c]) == 1 else f"[{''.join(o)}]" for c in site.upper())


def site_regex(enzymes: str | Sequence[str] | None = None, sites: Iterable[str] | None = None, check_rc: bool = True) -> str:
    """One pattern for all the sites, given by enzyme or preset names or as IUPAC strings, and their reverse complements."""
    found = list(sites or [])
    for name in [enzymes] if isinstance(enzymes, str) else enzymes or []:
        found += [get_enzyme_site(n) for n in (ENZYME_PRESETS[name.lower()] if name.lower() in ENZYME_PRESETS else [name])]
    if not found:
        raise ValueError("enzymes or sites must be given")
    if check_rc:
        found += [reverse_complement(s.upper()) for s in found]
    return "|".join(dict.fromkeys(iupac_regex(s) for s in found))


def calc_gc(seq: str | Column) -> float | Column:
    """Share of G and C among A, C, G and T; 0 where there are none."""
    if isinstance(seq, Column):
        u = F.upper(seq)
        n = F.length(F.regexp_replace(u, "[^ACGT]", ""))
        return F.when(n > 0, F.length(F.regexp_replace(u, "[^GC]", "")) / n).when(seq.isNotNull(), F.lit(0.0))
    u = seq.upper()
    n = sum(map(u.count, "ACGT"))
    return (u.count("G") + u.count("C")) / n if n else 0.0


def has_homopolymer(seq: str | Column, max_length: int) -> bool | Column:
    """Whether some character runs for more than ``max_length``, in either case."""
    pattern = rf"(?i)(.)\1{{{max_length},}}"
    return seq.rlike(pattern) if isinstance(seq, Column) else re.search(pattern, seq) is not None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body's inner functions use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kmers(seq: Column, k: int) -> Column:
    n = F.length(seq)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n - k + 1)
    return F.transform(starts, lambda i: seq.substr(i, F.lit(k)))


def calc_complexity(seq: str | Column, k_range: Sequence[int] = (1, 2, 3)) -> float | Column:
    """Mean over k of distinct k-mers by the most there can be; 1 where the sequence is too short for all k."""
    if isinstance(seq, Column):

        def mean(u: Column) -> Column:
            n = F.length(u)
            parts, used = [], []
            for k in k_range:
                share = F.size(F.array_distinct(_kmers(u, k))) / F.least(n - k + 1, F.lit(4**k))
                parts.append(F.when(n >= k, share).otherwise(0.0))
                used.append(F.when(n >= k, 1).otherwise(0))
            total = sum(used[1:], used[0])
            return F.when(total > 0, sum(parts[1:], parts[0]) / total).when(u.isNotNull(), F.lit(1.0))

        return let(F.upper(seq), mean)
    u = seq.upper()
    parts = [len({u[i : i + k] for i in range(len(u) - k + 1)}) / min(len(u) - k + 1, 4**k) for k in k_range if len(u) >= k]
    return sum(parts) / len(parts) if parts else 1.0


def calc_dust(seq: str | Column) -> float | Column:
    """Sum of c(c-1)/2 over the counts of triplets, by the length less two; 0 for fewer than three characters."""
    if isinstance(seq, Column):

        def score(triplets: Column) -> Column:
            def add(total: Column, x: Column) -> Column:
                c = F.size(F.filter(triplets, lambda y: y == x))
                return total + c * (c - 1) / 2

            return F.aggregate(F.array_distinct(triplets), F.lit(0.0), add) / F.size(triplets)

        dust = let(F.upper(seq), lambda u: let(_kmers(u, 3), score))
        return F.when(F.length(seq) >= 3, dust).when(seq.isNotNull(), F.lit(0.0))
    u = seq.upper()
    if len(u) < 3:
        return 0.0
    triplets = [u[i : i + 3] for i in range(len(u) - 2)]
    return sum(c * (c - 1) / 2 for c in map(triplets.count, set(triplets))) / (len(u) - 2)


def has_restriction_site(seq: str | Column, sites: Iterable[str], check_rc: bool = True) -> bool | Column:
    pattern = site_regex(sites=[sites] if isinstance(sites, str) else sites, check_rc=check_rc)
    return F.upper(seq).rlike(pattern) if isinstance(seq, Column) else re.search(pattern, seq.upper()) is not None
