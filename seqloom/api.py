"""The public names, and the operators as methods of pools."""

from __future__ import annotations

from .functions.codons import CodonTable
from .functions.dna import (
    BASES,
    COMPLEMENT,
    ENZYME_PRESETS,
    ENZYME_SITES,
    IGNORE_CHARS,
    IUPAC_TO_DNA,
    VALID_CHARS,
    calc_complexity,
    calc_dust,
    calc_gc,
    get_enzyme_site,
    get_preset_enzymes,
    has_homopolymer,
    has_restriction_site,
)
from .operators.fixed import add_prefix, clear_annotation, clear_gaps, clear_tags, fixed_operation, join, lower, rc, slice_seq, stylize, swapcase, upper
from .operators.mutate import mutagenize, recombine, shuffle_seq
from .operators.orf import annotate_orf, mutagenize_orf, reverse_translate, stylize_orf, translate
from .operators.regions import annotate_region, apply_at_region, extract_region, insert_tags, region_multiscan, region_scan, remove_tags, replace_region
from .operators.scans import deletion_multiscan, deletion_scan, insertion_multiscan, insertion_scan, mutagenize_scan, replacement_multiscan, replacement_scan, shuffle_scan, subseq_scan
from .operators.state_ops import filter, filter_complexity, filter_dust, filter_gc, filter_homopolymer, filter_restriction_sites, filter_seq, repeat, sample, stack, state_shuffle, state_slice, sync
from .plans import states
from .plans.pool import DnaPool, Operation, OrfRegion, Pool, ProteinPool, Region, Session, configure_logging, get_session, init
from .plans.runner import generate_library
from .plans.states import Manager, State
from .sources.sinks import plan_tree, print_dag, print_library, print_named_colors, to_df, to_file
from .sources.sources import from_fasta, from_iupac, from_motif, from_seq, from_seqs, from_table, get_kmers, materialize

__version__ = "0.1.0"
Party, get_active_party = Session, get_session
StateManager = Manager


class _OfFactory(type):
    """Classes whose instances are the operations that one factory makes."""

    def __instancecheck__(cls, x: object) -> bool:
        return isinstance(x, Operation) and x.factory == cls.factory


_factories = {
    "AddPrefixOp": "add_prefix", "FixedOp": "fixed", "FromSeqsOp": "from_seqs", "FromIupacOp": "from_iupac", "FromMotifOp": "from_motif", "GetKmersOp": "get_kmers",
    "MaterializeOp": "materialize", "MutagenizeOp": "mutagenize", "MutagenizeOrfOp": "mutagenize_orf", "StylizeOrfOp": "stylize_orf", "TranslateOp": "translate", "ReverseTranslateOp": "reverse_translate",
    "RecombineOp": "recombine", "SeqShuffleOp": "shuffle_seq", "FilterOp": "filter", "StylizeOp": "stylize", "StackOp": "stack", "RepeatOp": "repeat",
    "StateSliceOp": "state_slice", "StateShuffleOp": "state_shuffle", "SampleOp": "sample",
}
globals().update({name: _OfFactory(name, (), {"factory": factory}) for name, factory in _factories.items()})


def clear_pools() -> None:
    get_session().clear_pools()


def load_config(path: str) -> None:
    get_session().load_config(path)


def load_defaults(path: str) -> None:
    get_session().load_defaults(path)


def set_default(key: str, value: object) -> None:
    get_session().set_default(key, value)


def toggle_styles(on: bool = True) -> None:
    get_session().config.suppress_styles = not on


def toggle_cards(on: bool = True) -> None:
    get_session().config.suppress_cards = not on


def _insert(source):
    def method(self: Pool, *args, region, **options) -> Pool:
        return source(*args, pool=self, region=region, **options)

    return method


_first = (
    add_prefix, annotate_orf, annotate_region, apply_at_region, clear_annotation, clear_gaps, clear_tags, deletion_multiscan, deletion_scan, extract_region,
    filter, filter_complexity, filter_dust, filter_gc, filter_homopolymer, filter_restriction_sites, filter_seq, generate_library, insert_tags, insertion_multiscan,
    insertion_scan, lower, materialize, mutagenize, mutagenize_orf, mutagenize_scan, print_dag, print_library, rc, region_multiscan, region_scan, remove_tags,
    repeat, replace_region, replacement_multiscan, replacement_scan, reverse_translate, sample, shuffle_scan, shuffle_seq, slice_seq, state_shuffle, state_slice,
    stylize, stylize_orf, subseq_scan, swapcase, to_df, to_file, translate, upper,
)
for _f in _first:
    setattr(Pool, _f.__name__, _f)
for _name, _f in {
    "shuffle_states": state_shuffle,
    "slice_states": state_slice,
    "insert_from_seq": _insert(from_seq),
    "insert_from_seqs": _insert(from_seqs),
    "insert_from_iupac": _insert(from_iupac),
    "insert_from_motif": _insert(from_motif),
    "insert_kmers": _insert(get_kmers),
    "recombine": lambda self, region, *sources, **options: recombine(self, region, *sources, **options),
    "stack_with": lambda self, other: stack([self, other]),
    "join_with": lambda self, *others, **options: join([self, *others], **options),
}.items():
    setattr(Pool, _name, _f)
