"""Styles as data: where each character's style is after every operator, and how previews show it."""

import time

import pytest
from pyspark.sql import functions as F

import seqloom as sl
from seqloom.plans.styles import positions
from seqloom.sources.sinks import rendered

COLORS = {"red": "91", "blue": "94", "green": "92"}


def rows(pool, spark, n=1, **options):
    """(sequence, {style: places}) of the first rows."""
    found = sl.generate_library(pool, num_seqs=n, init_state=0, seed=5, report_styles=True, spark=spark, with_index=True, **options).orderBy("_row").collect()
    return [(r["seq"], {s["spec"]: s["positions"] for s in r["styles"] or ()}) for r in found]


CASES = {
    "none": (lambda: sl.from_seq("ACGT").rc(), "ACGT", {}),
    "source": (lambda: sl.from_seqs(["ACG"], mode="sequential", style="red"), "ACG", {"red": [0, 1, 2]}),
    "mutation": (lambda: sl.mutagenize("ACGT", num_mutations=1, style="red", mode="sequential"), "CCGT", {"red": [0]}),
    "mutation in a region": (lambda: sl.from_seq("AA<t>CC</t>GG").mutagenize("t", num_mutations=1, style="red", mode="sequential"), "AA<t>AC</t>GG", {"red": [5]}),
    "mutation in an interval": (lambda: sl.from_seq("AACC").mutagenize([2, 4], num_mutations=1, style="red", mode="sequential"), "AAAC", {"red": [2]}),
    "tags removed": (lambda: sl.from_seq("AA<t>CC</t>GG").stylize([11, 13], style="blue").mutagenize("t", num_mutations=1, style="red", mode="sequential", remove_tags=True), "AAACGG", {"blue": [4, 5], "red": [2]}),
    "deletion": (lambda: sl.from_seq("AAA<t>CCCC</t>TTT").stylize("t", style="red").deletion_scan(2, region="t", mode="sequential", style="blue"), "AAA<t>--CC</t>TTT", {"red": [8, 9], "blue": [6, 7]}),
    "deletion without a marker": (lambda: sl.from_seq("AAACCC").stylize(style="red").deletion_scan(2, None, mode="sequential", style="blue"), "ACCC", {"red": [0, 1, 2, 3]}),
    "insertion": (lambda: sl.insertion_scan(sl.from_seq("AAAA", style="green"), sl.from_seq("TT", style="blue"), positions=[1], mode="sequential", style="red"), "ATTAAA", {"green": [0, 3, 4, 5], "blue": [1, 2], "red": [1, 2]}),
    "insertion at the end": (lambda: sl.insertion_scan("AAAA", "TT", positions=[4], mode="sequential", style="red"), "AAAATT", {"red": [4, 5]}),
    "replacement": (lambda: sl.replacement_scan(sl.from_seq("AAAA", style="blue"), "TT", positions=[1], mode="sequential", style="red"), "ATTA", {"blue": [0, 3], "red": [1, 2]}),
    "k-mers": (lambda: sl.from_seq("AA<bc/>TT").stylize(style="red").insert_kmers(2, region="bc", mode="sequential", style="blue"), "AA<bc>AA</bc>TT", {"red": [0, 1, 13, 14], "blue": [6, 7]}),
    "reversal": (lambda: sl.from_seq("AC<x>GG</x>T").stylize("x", style="red").rc(), "ACCGT", {"red": [1, 2]}),
    "join": (lambda: sl.join([sl.from_seq("AC", style="red"), sl.from_seq("G", style="blue")], "--", style="green"), "AC--G", {"red": [0, 1], "blue": [4], "green": [0, 1, 2, 3, 4]}),
    "one pool twice": (lambda: sl.join([(p := sl.from_seq("AC", style="red")), p]), "ACAC", {"red": [0, 1, 2, 3]}),
    "slice": (lambda: sl.from_seq("ACGTACGT").stylize([2, 5], style="red").slice_seq(start=1, stop=7, step=2), "CTC", {"red": [1]}),
    "slice of a region": (lambda: sl.from_seq("AA<x>CGT</x>").stylize("x", style="red").slice_seq("x", 1, keep_context=True), "AAGT", {"red": [2, 3]}),
    "recombination by source": (lambda: sl.recombine(sources=[sl.from_seq("AAA", style="bold"), "CCC"], num_breakpoints=1, mode="sequential", styles=["red", "blue"], style_by="source"), "ACC", {"bold": [0], "red": [0], "blue": [1, 2]}),
    "recombination in order": (lambda: sl.recombine(sources=["AAA", "CCC"], num_breakpoints=2, mode="fixed", styles=["red", "blue"]), "ACA", {"red": [0, 2], "blue": [1]}),
    "translation": (lambda: sl.from_seq("ATGGCTTAA").stylize([0, 5], style="red").translate(), "MA*", {"red": [0]}),
    "translation without styles": (lambda: sl.from_seq("ATGGCTTAA").stylize(style="red").translate(preserve_codon_styles=False), "MA*", {}),
    "translation without stops": (lambda: sl.from_seq("ATGTAAGCT").stylize([3, 9], style="red").translate(include_stop=False), "MA", {"red": [1]}),
    "reverse frame": (lambda: sl.from_seq("TTAAGCCAT").stylize([6, 9], style="red").translate(frame=-1), "MA*", {"red": [0]}),
    "reverse translation": (lambda: sl.from_seq("ATGGCTTAA").stylize([0, 3], style="red").translate().reverse_translate(), "ATGGCCTGA", {"red": [0, 1, 2]}),
    "codons": (lambda: sl.from_seq("A<o>GCTTTT</o>").mutagenize_orf("o", num_mutations=1, mode="sequential", style="red", codon_positions=[1]), "A<o>GCTCTG</o>", {"red": [7, 8, 9]}),
    "codon styles": (lambda: sl.from_seq("AA<o>GCTTTTG</o>").stylize_orf("o", style_codons=["red", "blue"]), "AA<o>GCTTTTG</o>", {"red": [5, 6, 7, 11], "blue": [8, 9, 10]}),
    "frame styles": (lambda: sl.from_seq("GCTTTT").stylize_orf(style_frames=["red", "blue", "green"], frame=-2), "GCTTTT", {"red": [0, 3], "blue": [2, 5], "green": [1, 4]}),
    "choices": (lambda: sl.from_seq("aC-G<z>A</z>").stylize(which="lower", style="red").stylize(which="gap", style="blue").stylize(which="tags", style="green"), "aC-G<z>A</z>", {"red": [0], "blue": [2], "green": [4, 5, 6, 8, 9, 10, 11]}),
    "a region's tags": (lambda: sl.from_seq("A<z>C</z>").stylize("z", which="tags", style="red").stylize("z", which="all", style="blue"), "A<z>C</z>", {"red": [1, 2, 3, 5, 6, 7, 8], "blue": [1, 2, 3, 4, 5, 6, 7, 8]}),
    "regex": (lambda: sl.from_seq("ACACGAC").stylize(regex="(AC)+", style="red").stylize([3, 5], regex="C|G", style="blue"), "ACACGAC", {"red": [0, 1, 2, 3, 5, 6], "blue": [3, 4]}),
    "tags inserted and removed": (lambda: sl.from_seq("ACGTAC").stylize([1, 5], style="red").insert_tags("p", 2, 4).remove_tags("p", keep_content=False), "ACAC", {"red": [1, 2]}),
    "extraction": (lambda: sl.from_seq("AA<z>CGT</z>").stylize([5, 7], style="red").extract_region("z", rc=True), "ACG", {"red": [1, 2]}),
    "put back": (lambda: sl.from_seq("A<z>CG</z>T").stylize(style="red").apply_at_region("z", lambda p: p.mutagenize(num_mutations=1, style="blue", mode="sequential"), remove_tags=False), "A<z>AG</z>T", {"red": [0, 4, 5, 10], "blue": [4]}),
    "gaps cleared": (lambda: sl.from_seq("A-C.<z>-T</z>").stylize(style="red").clear_gaps(), "AC<z>T</z>", {"red": [0, 1, 5]}),
    "annotation cleared": (lambda: sl.from_seq("a-C<z>T</z>").stylize(which="upper", style="red").clear_annotation(), "ACT", {"red": [1, 2]}),
    "states": (lambda: sl.stack([sl.from_seq("A", style="red"), sl.from_seq("C", style="blue")]).repeat(2)[2:], "C", {"blue": [0]}),
    "filtered": (lambda: sl.from_seq("ACG", style="red").filter(lambda s: s.startswith("A")), "ACG", {"red": [0, 1, 2]}),
    "clone": (lambda: sl.from_seq("AA<z>CG</z>").stylize("z", style="red").mutagenize("z", num_mutations=1, mode="sequential", style="blue").deepcopy(), "AA<z>AG</z>", {"red": [5, 6], "blue": [5]}),
}


@pytest.mark.parametrize("name", CASES)
def test_places(spark, session, name):
    build, seq, styles = CASES[name]
    assert rows(build(), spark) == [(seq, styles)]


def test_random_operators(spark, session):
    pool = sl.from_seq("ACGTACGTAC<z>GT</z>AC").stylize([0, 4], style="green")
    for seq, styles in rows(pool.mutagenize(num_mutations=3, style="red"), spark, 20):
        plain = "ACGTACGTAC<z>GT</z>AC"
        assert styles == {"green": [0, 1, 2, 3], "red": [i for i, (a, b) in enumerate(zip(plain, seq)) if a != b]} and len(styles["red"]) == 3
    for seq, styles in rows(pool.region_multiscan(["p", "q"], 2, region_length=2), spark, 20):
        assert "".join(seq[i] for i in styles["green"]) == "ACGT"
    for seq, styles in rows(pool.shuffle_seq("z", style="red"), spark, 5):
        assert styles["red"] == [13, 14]
    for seq, styles in rows(sl.recombine(sources=["AAAA", "CCCC"], num_breakpoints=2, styles=["red", "blue"], style_by="source"), spark, 10):
        assert styles == {"red": [i for i, c in enumerate(seq) if c == "A"], "blue": [i for i, c in enumerate(seq) if c == "C"]}
    for seq, styles in rows(sl.from_seq("ATGGCTTTT").mutagenize_orf(num_mutations=1, style="red"), spark, 10):
        assert [i // 3 for i in styles["red"]] == [styles["red"][0] // 3] * 3


def test_switched_off(spark, session):
    pool = sl.from_seq("ACGT", style="red")
    session.config.suppress_styles = True
    assert rows(pool, spark) == [("ACGT", {})]
    assert "styles" not in sl.generate_library(pool, spark=spark, init_state=0).columns
    session.config.suppress_styles = False


def test_rejected_rows_have_no_styles(spark, session):
    assert rows(sl.from_seqs(["ACG", "TTT"], mode="sequential", style="red").filter(lambda s: s.startswith("T")), spark, 2) == [(None, {}), ("TTT", {"red": [0, 1, 2]})]


def test_rendering():
    assert rendered("ACGT", []) == "ACGT"
    assert rendered("ACGT", [("red", [1])]) == "A\033[91mC\033[0mGT"
    assert rendered("ACGT", [("red", [0, 1]), ("blue bold", [1])]) == "\033[91mA\033[0m\033[94;1mC\033[0mGT"
    assert rendered("AC", [("on_red", [0]), ("on_blue", [0]), ("underline", [0, 1])]) == "\033[104;4mA\033[0m\033[4mC\033[0m"
    assert rendered("Ac", [("lower", [0]), ("upper red", [1])]) == "a\033[91mC\033[0m"
    with pytest.raises(ValueError):
        rendered("AC", [("red", [2])])


def test_previews_and_exports(spark, session, capsys, tmp_path):
    pool = sl.from_seq("AA<t>CC</t>G").mutagenize("t", num_mutations=1, style="red", mode="sequential", prefix="m")
    assert pool.print_library(num_seqs=1, show_header=False) is pool
    assert capsys.readouterr().out == "m_0\tAA<t>\033[91mA\033[0mC</t>G\n"
    sl.from_seq("ATGGCT", style="blue").translate().print_library(num_seqs=1, show_header=False, chars_per_aa=3, aa_separator="-")
    assert capsys.readouterr().out == "\033[94mMet\033[0m-\033[94mAla\033[0m\n"
    df = pool.to_df(num_cycles=1, write_style=True).orderBy("name").collect()
    assert (df[3]["seq"], [tuple(s) for s in df[3]["styles"]]) == ("AACAG", [("red", [3])])
    kept = pool.to_df(num_seqs=1, write_tags=True, write_style=True, include_design_cards=True).first()
    assert kept["seq"] == "AA<t>AC</t>G" and kept["styles"][0]["positions"] == [5] and "op[1]:mutagenize.key.positions" in kept.asDict()
    assert pool.to_file(tmp_path / "out.jsonl", num_cycles=1, write_style=True) == 6
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "out.jsonl")).collect()}
    assert '{"name":"m_0","seq":"AAACG","styles":[{"spec":"red","positions":[2]}]}' in lines
    assert pool.to_file(tmp_path / "out.csv", num_cycles=1, write_style=True) == 6


def test_exports_leave_out_rejected_rows(spark, session):
    pool = sl.get_kmers(2, mode="sequential").filter(lambda s: s.startswith("C"))
    assert [r["seq"] for r in pool.to_df(num_seqs=3).collect()] == ["CA", "CC", "CG"]
    assert pool.to_df(num_cycles=1).count() == 4 and pool.to_df(num_cycles=1, discard_null_seqs=False).count() == 16
    with pytest.raises(ValueError):
        pool.to_df(num_seqs=0)


def test_frames_of_long_sequences(spark, session):
    """The work for a layer grows with the length, not with its square times that of a regular expression."""
    texts = [f"{'ACGTAC-GTa' * 150}{'C' * i}" for i in range(120)]
    for frame, options in ((2, {"style_codons": ["red", "blue"]}), (-3, {"style_frames": ["red", "blue", "red"]})):
        began = time.monotonic()
        found = rows(sl.from_seqs(texts, mode="sequential").stylize_orf(frame=frame, **options), spark, len(texts))
        assert time.monotonic() - began < 40
        want = []
        for text in texts:
            spots = [p for p, c in enumerate(text) if c != "-"]
            styles = {"red": [], "blue": []}
            for j, p in enumerate(spots):
                j = len(spots) - 1 - j if frame < 0 else j
                styles[["red", "blue"][(j + 1) // 3 % 2] if frame == 2 else ["red", "blue", "red"][(j + 2) % 3]].append(p)
            want.append((text, styles))
        assert found == want


def test_a_table_in_one_file_is_dealt_to_all_cores(spark, session, tmp_path):
    spark.range(8000).select(F.col("id").alias("idx"), F.lit("ATGGCC").alias("seq")).coalesce(1).write.parquet(str(tmp_path / "one"))
    pool = sl.from_table(spark.read.parquet(str(tmp_path / "one")), index_col="idx", num_rows=8000, seq_length=6).stylize_orf(style_codons=["red", "blue"])
    pool = pool.mutagenize_orf(num_mutations=1, mutation_type="nonsense", mode="sequential", style="bold", codon_positions=[0])
    df = sl.generate_library(pool, report_styles=True, with_index=True, spark=spark, init_state=0)
    assert df.rdd.getNumPartitions() >= 4
    assert df.agg(F.count_distinct("_row"), F.max("_row"), F.count_distinct("styles")).first()[:] == (24_000, 23_999, 1)


def test_a_region_is_looked_for_once(spark, session):
    pool = sl.from_seqs(["AC<t>GGA</t>C<bc/>", "<t>GA</t><bc/>"], mode="sequential").stylize("t", style="red").stylize("t", style="bold", which="upper").insert_kmers(1, region="bc", mode="sequential", style="blue")
    df = sl.generate_library(pool, report_styles=True, with_index=True, spark=spark, init_state=0)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(.*?)<t") <= 12 and plan.count("(.*?)<bc") <= 6  # for each operator: is it there, and three pieces
    found = {(r["seq"], tuple((s["spec"], tuple(s["positions"])) for s in r["styles"])) for r in df.collect()}
    assert ("AC<t>GGA</t>C<bc>A</bc>", (("red", (5, 6, 7)), ("bold", (5, 6, 7)), ("blue", (17,)))) in found and len(found) == 8


def test_a_single_mutation_is_painted_by_its_place(spark, session):
    """Not by comparing all characters of each row; places of a stretch are not looked for one by one."""
    text = "aC<t>Gt</t>A"
    for pool, many in ((sl.from_seq(text).stylize([0, 2], style="bold").mutagenize(num_mutations=1, mode="sequential", style="red"), 15), (sl.from_seq(text).mutagenize("t", num_mutations=1, mode="sequential", style="red"), 6)):
        df = sl.generate_library(pool, report_styles=True, with_index=True, spark=spark, init_state=0)
        assert "zip_with" not in df._jdf.queryExecution().optimizedPlan().toString()
        found = [(r["seq"], {s["spec"]: s["positions"] for s in r["styles"]}) for r in df.collect()]
        assert len({s for s, _ in found}) == many
        for seq, styles in found:
            assert styles.pop("bold", [0, 1]) == [0, 1] and styles == {"red": [i for i, (a, b) in enumerate(zip(text, seq)) if a != b]}
    marks = spark.createDataFrame([("", []), ("000", []), ("0110", [1, 2]), ("11", [0, 1]), ("1001", [0, 3]), ("010110", [1, 3, 4]), (None, None)], "mask string, want array<int>")
    assert all(r["got"] == r["want"] for r in marks.select(positions(F.col("mask")).alias("got"), "want").collect())
