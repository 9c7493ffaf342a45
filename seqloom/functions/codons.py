"""Genetic code and codon substitutions."""

from __future__ import annotations

from functools import cached_property

# The standard genetic code, codons by human usage, most frequent first.
STANDARD_GENETIC_CODE = {
    "F": ["TTC", "TTT"],
    "L": ["CTG", "CTC", "CTT", "TTG", "TTA", "CTA"],
    "I": ["ATC", "ATT", "ATA"],
    "M": ["ATG"],
    "V": ["GTG", "GTC", "GTT", "GTA"],
    "S": ["AGC", "TCC", "TCT", "TCA", "AGT", "TCG"],
    "P": ["CCC", "CCT", "CCA", "CCG"],
    "T": ["ACC", "ACA", "ACT", "ACG"],
    "A": ["GCC", "GCT", "GCA", "GCG"],
    "Y": ["TAC", "TAT"],
    "H": ["CAC", "CAT"],
    "Q": ["CAG", "CAA"],
    "N": ["AAC", "AAT"],
    "K": ["AAG", "AAA"],
    "D": ["GAC", "GAT"],
    "E": ["GAG", "GAA"],
    "C": ["TGC", "TGT"],
    "W": ["TGG"],
    "R": ["AGA", "AGG", "CGG", "CGC", "CGA", "CGT"],
    "G": ["GGC", "GGA", "GGG", "GGT"],
    "*": ["TGA", "TAA", "TAG"],
}
#: Alternatives of each codon for the mutation types that have as many for every codon.
UNIFORM_MUTATION_TYPES = {"any_codon": 63, "nonsynonymous_first": 20, "missense_only_first": 19, "nonsense": 3}
VALID_MUTATION_TYPES = {*UNIFORM_MUTATION_TYPES, "nonsynonymous_random", "missense_only_random", "synonymous"}


class CodonTable:
    def __init__(self, code: str | dict[str, list[str]] = "standard"):
        self.aa_to_codons = STANDARD_GENETIC_CODE if code == "standard" else {a: [c.upper() for c in cs] for a, cs in code.items()}
        self.codon_to_aa = {c: a for a, cs in self.aa_to_codons.items() for c in cs}
        self.all_codons = [c for cs in self.aa_to_codons.values() for c in cs]
        self.stop_codons = list(self.aa_to_codons.get("*", []))
        self.synonymous = {c: self.get_mutations(c, "synonymous") for c in self.all_codons}

    def get_mutations(self, codon: str, mutation_type: str) -> list[str]:
        """What a codon may become, in order."""
        codon, own = codon.upper(), self.codon_to_aa[codon.upper()]
        first, missense = mutation_type.endswith("_first"), mutation_type.startswith("missense")
        match mutation_type:
            case "any_codon":
                return [c for c in self.all_codons if c != codon]
            case "synonymous":
                return [c for c in self.aa_to_codons[own] if c != codon]
            case "nonsense":
                return [] if own == "*" else list(self.stop_codons)
            case _ if mutation_type in VALID_MUTATION_TYPES:
                others = [cs for a, cs in self.aa_to_codons.items() if a != own and not (missense and a == "*")]
                return [c for cs in others for c in (cs[:1] if first else cs)]
        raise ValueError(f"mutation_type must be one of {sorted(VALID_MUTATION_TYPES)}, got {mutation_type!r}")

    @cached_property
    def mutation_lookup(self) -> dict[str, dict[str, list[str]]]:
        """For each mutation type: what each codon may become."""
        return {t: {c: self.get_mutations(c, t) for c in self.all_codons} for t in sorted(VALID_MUTATION_TYPES)}

    def num_mutations(self, codon: str, mutation_type: str) -> int:
        return len(self.get_mutations(codon, mutation_type))

    def is_uniform(self, mutation_type: str) -> bool:
        return len({self.num_mutations(c, mutation_type) for c in self.all_codons}) == 1

    def uniform_num_mutations(self, mutation_type: str) -> int | None:
        return self.num_mutations(self.all_codons[0], mutation_type) if self.is_uniform(mutation_type) else None
