"""Operators called with arguments in their documented order, and options of the session."""

import logging

import pytest

import seqloom as sl


def seqs(pool, spark, **options):
    return [r["seq"] for r in sl.generate_library(pool, init_state=0, spark=spark, with_index=True, **options).orderBy("_row").collect()]


CALLS = {
    "insertion_scan": (lambda: sl.insertion_scan("ACGT", "T", [1], None, False, None, "i", None, None, "sequential"), ["ATCGT"]),
    "insertion over": (lambda: sl.from_seq("A<r>CG</r>T").insertion_scan("T", [0, 1], "r", True, mode="sequential"), ["A<r>TG</r>T", "A<r>CT</r>T"]),
    "replacement_scan": (lambda: sl.replacement_scan("ACGT", "TT", [2], None, None, None, None, None, "sequential"), ["ACTT"]),
    "deletion_scan": (lambda: sl.deletion_scan("ACGT", 2, "-", None, [1], None, "sequential"), ["A--T"]),
    "mutagenize_scan": (lambda: sl.mutagenize_scan("ACGT", 1, 1, None, [1], None, None, "sequential"), [f"A<_mut>{c}</_mut>GT" for c in "AGT"]),
    "subseq_scan": (lambda: sl.subseq_scan("ACGT", 2, [0, 2], None, None, "sequential"), ["AC", "GT"]),
    "region_scan": (lambda: sl.region_scan("ACGT", "w", [1], None, None, 2, None, "sequential"), ["A<w>CG</w>T"]),
    "region_scan in a region": (lambda: sl.from_seq("A<r>CGT</r>").region_scan("w", None, "r", region_length=2, mode="sequential"), ["A<r><w>CG</w>T</r>", "A<r>C<w>GT</w></r>"]),
    "slice_seq": (lambda: sl.slice_seq("A<r>CGTA</r>", "r", 1, 3, None, True), ["AGT"]),
    "annotate_region": (lambda: sl.annotate_region("ACGT", "r", (1, 3), "red"), ["A<r>CG</r>T"]),
    "annotate_orf": (lambda: sl.annotate_orf("AATGT", "o", (1, 4), -1), ["A<o>ATG</o>T"]),
    "recombine": (lambda: sl.recombine(None, None, ["AA", "CC"], 1, None, "sequential"), ["AC", "CA"]),
    "repeat": (lambda: sl.repeat(sl.from_seq("A"), 2, "copy"), ["A", "A"]),
    "state_slice": (lambda: sl.state_slice(sl.get_kmers(1, mode="sequential"), slice(1, 3), "s"), ["C", "G"]),
    "stack": (lambda: sl.stack([sl.from_seq("A"), sl.from_seq("C")], "branch"), ["A", "C"]),
    "fixed_operation": (lambda: sl.fixed_operation(["AC", "G"], lambda s: s[1] + s[0], lambda n: sum(n)), ["GAC"]),
}


@pytest.mark.parametrize("name", CALLS)
def test_order_of_arguments(spark, session, name):
    build, want = CALLS[name]
    assert seqs(build(), spark) == want


def test_functions_of_strings_and_of_columns(spark, session):
    """Slices, + and == exist for columns too, where they mean something else."""
    pool = sl.from_seqs(["ATGC", "GGCC", "TTAA"], mode="sequential")
    assert seqs(pool.filter(lambda s: s[1:3] == "TG"), spark) == ["ATGC", None, None]
    assert seqs(pool.filter(lambda s: s[0] == "T" or s == s[::-1]), spark) == [None, None, "TTAA"]
    assert seqs(pool.filter(lambda s: s.rlike("^G")), spark) == [None, "GGCC", None]
    assert seqs(sl.fixed_operation([pool, "N"], lambda x: x[0][:2] + x[1]), spark) == ["ATN", "GGN", "TTN"]
    plan = sl.generate_library(pool.filter(lambda s: s.startswith(("A", "T"))), spark=spark, init_state=0)
    assert [r["seq"] for r in plan.collect() if r["seq"]] == ["ATGC", "TTAA"]


def test_generate_library_takes_cycles_first(spark, session):
    pool = sl.from_seqs(["A", "C"], mode="sequential")
    assert pool.generate_library(2, spark=spark, init_state=0).count() == 4
    assert pool.generate_library(num_seqs=3, spark=spark, init_state=0).count() == 3


def test_prefixes_of_annotations(spark, session):
    for pool in (sl.annotate_region("ACGT", "r", (1, 3), prefix="p"), sl.from_seq("A<q>CG</q>T").annotate_region("q", style="red", prefix="p"), sl.annotate_orf("ACGT", "o", (0, 3), prefix="p"), sl.stylize_orf("ACG", style_codons=["red"], prefix="p")):
        assert [r["name"] for r in sl.generate_library(pool, spark=spark, init_state=0).collect()] == ["p"]


def test_genetic_codes(spark, session):
    code = {**{a: list(c) for a, c in sl.CodonTable("standard").aa_to_codons.items()}}
    code["W"], code["*"] = ["TGG", "TGA"], ["TAA", "TAG"]
    assert seqs(sl.translate("ATGTGATAA", genetic_code=code), spark) == ["MW*"]
    assert seqs(sl.translate("ATGTGATAA"), spark) == ["M**"]
    assert seqs(sl.reverse_translate("MW*", genetic_code=code), spark) == ["ATGTGGTAA"]


def test_kinds_of_pools(session):
    dna = sl.from_seq("ATG")
    protein = dna.translate()
    assert isinstance(dna, sl.DnaPool) and not isinstance(dna, sl.ProteinPool)
    assert isinstance(protein, sl.ProteinPool) and not isinstance(protein, sl.DnaPool) and isinstance(protein.reverse_translate(), sl.DnaPool)


def test_names_with_cards(spark, session):
    plain, named = sl.from_seqs(["A"], mode="sequential"), sl.from_seqs(["A"], mode="sequential", prefix="p")
    cards = lambda p: sl.generate_library(p, report_design_cards=True, spark=spark, init_state=0).columns
    assert "name" not in cards(plain) and cards(named)[:2] == ["name", "seq"]
    assert sl.generate_library(plain, spark=spark, init_state=0).columns == ["name", "seq"]


def test_file_types(spark, session, tmp_path):
    pool = sl.from_seqs(["A", "C"], mode="sequential", prefix="p")
    assert pool.to_file(tmp_path / "library", num_cycles=1) == 2
    assert sorted(r["seq"] for r in spark.read.csv(str(tmp_path / "library"), header=True).collect()) == ["A", "C"]
    with pytest.raises(ValueError):
        pool.to_file(tmp_path / "x", "xml", num_cycles=1)


def test_sessions_and_logging():
    session = sl.init(genetic_code="standard", log_level="info")
    try:
        logger = logging.getLogger("seqloom")
        assert logger.level == logging.INFO and len(logger.handlers) == 1
        own = logging.NullHandler()
        sl.configure_logging("ERROR", handler=own)
        assert logger.handlers == [own] and logger.level == logging.ERROR
    finally:
        session.__exit__()
