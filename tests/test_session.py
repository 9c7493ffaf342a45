"""What a session knows of its pools, operations, regions and defaults, and operators of one's own."""

import pytest
from pyspark.sql import functions as F

import seqloom as sl


def seqs(pool, spark, **options):
    return [r["seq"] for r in sl.generate_library(pool, init_state=0, spark=spark, with_index=True, **options).orderBy("_row").collect()]


def test_pools_and_operations_by_id_and_name(session):
    a, b = sl.from_seq("ACGT").named("a"), sl.from_seqs(["A", "C"], mode="sequential").named("b", "a")
    assert session.get_pool_by_id(0) is a and session.get_pool_by_name("b") is b
    assert session.get_op_by_id(1) is b.operation and session.get_op_by_name("a") is b.operation
    for look in (lambda: session.get_pool_by_id(9), lambda: session.get_op_by_id(9)):
        with pytest.raises(IndexError):
            look()
    for look in (lambda: session.get_pool_by_name("x"), lambda: session.get_op_by_name("x")):
        with pytest.raises(KeyError):
            look()


def test_names_are_unique_and_can_change(session):
    a, b = sl.from_seq("A").named("a"), sl.from_seq("C").named("b")
    a.name = "a"
    with pytest.raises(ValueError):
        b.name = "a"
    assert b.name == "b" and session.get_pool_by_name("a") is a
    a.name = "c"
    b.name = "a"
    assert session.get_pool_by_name("a") is b and session.get_pool_by_name("c") is a
    a.operation.name = "made"
    assert a.operation.state.name == "made.state"
    with pytest.raises(ValueError):
        b.operation.name = "made"


def test_regions(session):
    plain = session.register_region("r", 6)
    assert session.get_region_by_id(0) is plain and session.get_region_by_name("r") is plain and not plain.is_zero_length
    assert session.register_region("v").is_variable_length and session.register_region("z", 0).is_zero_length
    for bad in (lambda: session.register_orf_region("r", 6), lambda: session.upgrade_to_orf_region("x"), lambda: session.get_region_by_id(3), lambda: session.get_region("x")):
        with pytest.raises(ValueError):
            bad()
    orf = session.upgrade_to_orf_region("r", 2)
    assert (orf.frame, orf.seq_length) == (2, 6) and session.get_region_by_id(0) is orf
    assert session.register_orf_region("r", 6, 2) is orf
    for bad in (lambda: session.upgrade_to_orf_region("r", 2), lambda: session.register_orf_region("r", 6, 1), lambda: session.register_orf_region("r", 9, 2)):
        with pytest.raises(ValueError):
            bad()


def test_frames_stay(spark, session):
    pool = sl.annotate_orf("ATGGCTTAA", "o", frame=2)
    assert session.get_region("o").frame == 2
    assert seqs(sl.annotate_orf(pool, "o", frame=2), spark) == ["<o>ATGGCTTAA</o>"]
    for bad in (lambda: sl.annotate_orf(pool, "o", frame=1), lambda: sl.annotate_orf(pool, "o", (0, 3)), lambda: sl.stylize_orf(pool, "o", ["red"], frame=0)):
        with pytest.raises(ValueError):
            bad()


def test_clear_pools_keeps_settings(spark):
    with sl.Session() as session:
        code = {**{a: list(c) for a, c in sl.CodonTable("standard").aa_to_codons.items()}}
        code["W"], code["*"] = ["TGG", "TGA"], ["TAA", "TAG"]
        session.set_genetic_code(code)
        session.set_default("mode", "sequential")
        sl.from_seq("A<r>C</r>").named("a")
        session.output(session.get_pool_by_name("a"))
        assert list(session.outputs) == ["a"] and "a" in repr(session)
        sl.clear_pools()
        assert not session.pools and not session.ops and not session.outputs and not session.has_region("r") and not session.state_manager.states
        assert session.get_default("mode") == "sequential" and session.get_default("other", 3) == 3
        again = sl.from_seq("TGA").named("a")
        assert again.id == 0 and seqs(again.translate(), spark) == ["W"]
    with sl.Session(), sl.Session() as inner:
        inner.clear_pools()
        sl.from_seq("A")


def test_defaults_and_configuration_from_files(session, tmp_path):
    (tmp_path / "defaults.toml").write_text("marker = '-'\n[scan]\nlength = 3\n")
    sl.load_defaults(str(tmp_path / "defaults.toml"))
    assert session.get_default("marker") == "-" and session.get_default("scan") == {"length": 3}
    (tmp_path / "config.toml").write_text("[general]\nsuppress_cards = true\n")
    sl.load_config(str(tmp_path / "config.toml"))
    assert session.suppress_cards and not session.suppress_styles
    (tmp_path / "config.toml").write_text("[columns]\nname = false\n")
    sl.load_config(str(tmp_path / "config.toml"))
    assert not session.suppress_cards and not session.config.show_name


def test_measures_of_strings(session):
    text = "AC-<r>gN</r>"
    assert session.get_length_without_tags(text) == 5
    assert session.get_molecular_positions(text) == [0, 1, 6]
    assert session.get_effective_seq_length(text) == 3


@pytest.mark.parametrize(
    "build",
    [
        lambda: sl.from_seqs(["AA", "CC"], mode="sequential"),
        lambda: sl.mutagenize("ACG", num_mutations=1, mode="sequential"),
        lambda: sl.join([sl.get_kmers(1, mode="sequential"), "A"], "-"),
        lambda: sl.stack([sl.from_seq("A"), sl.get_kmers(1, mode="sequential")]),
        lambda: sl.repeat(sl.get_kmers(1, mode="sequential"), 2),
        lambda: sl.state_slice(sl.get_kmers(1, mode="sequential"), slice(1, 3)),
        lambda: sl.slice_seq("ACGT", start=1, stop=3),
        lambda: sl.recombine(sources=["AAA", "CCC"], num_breakpoints=1, mode="sequential"),
        lambda: sl.from_seq("A<r>C</r>").insert_kmers(1, region="r", mode="sequential"),
    ],
)
def test_copies(spark, session, build):
    pool = build()
    want, op = seqs(pool, spark), pool.operation
    shallow, deep = pool.copy(), pool.deepcopy()
    assert seqs(shallow, spark) == seqs(deep, spark) == want
    assert shallow.parents == pool.parents and not set(deep.parents) & set(pool.parents)
    assert shallow.name == f"{pool.name}.copy" and deep.name == f"{pool.name}.copy.2" and pool.copy().name == f"{pool.name}.copy.3" and pool.copy("mine").name == "mine"
    for made in (op.copy(), op.deepcopy(), op.copy("again")):
        assert made.id > op.id and made.state is not op.state and made.natural_num_states == op.natural_num_states and made.mode == op.mode
        assert seqs(sl.Pool(made, pool.seq_length, regions=pool.regions), spark) == want
    assert session.get_op_by_name("again").parent_pools == op.parent_pools


def test_deepcopy_keeps_what_is_shared(spark, session):
    source = sl.get_kmers(1, mode="sequential")
    pool = sl.join([source, source.rc()])
    assert seqs(pool.deepcopy(), spark) == seqs(pool, spark) == ["AT", "CG", "GC", "TA"]


def test_iter_order_can_change(spark, session):
    a, b = sl.get_kmers(1, mode="sequential"), sl.from_seqs(["x", "y"], mode="sequential")
    assert seqs(sl.join([a, b]), spark)[:2] == ["Ax", "Ay"]
    a.iter_order = -1
    assert a.iter_order == -1 and sl.from_seq("A", iter_order=4).iter_order == 0
    assert seqs(sl.join([a, b]), spark)[:2] == ["Ax", "Cx"]


def test_trees(session, capsys):
    pool = sl.join([sl.from_seq("A").named("left"), sl.from_seq("C").named("right")]).named("both")
    pool.print_dag("minimal")
    assert capsys.readouterr().out.splitlines() == ["both", "├── left", "└── right"]
    pool.print_dag("minimal", show_pools=False)
    shown = [line.split(":")[-1] for line in capsys.readouterr().out.splitlines()]
    assert shown[1:] == ["from_seq", "from_seq"] and not any("left" in x for x in shown)
    pool.operation.print_dag("minimal")
    assert capsys.readouterr().out.splitlines()[1:] == ["├── left", "└── right"]


class Tandem(sl.Operation):
    """Copies of the sequence in a row: 1, 2, ... ``most`` of them, one state for each."""

    factory = "tandem"

    def __init__(self, pool, most, **options):
        self.most = most
        super().__init__([pool], mode="sequential", num_states=most, cards={"copies": "long"}, **options)

    def build(self, run, args, state):
        return F.repeat(args[0], state.cast("int") + 1), {"copies": (state + 1).cast("long")}


class Spelled(sl.Operation):
    """A random operator in plain Python."""

    factory = "spelled"

    def __init__(self, pool, **options):
        super().__init__([pool], mode="random", draw=self.pick, cards={"place": "long"}, **options)

    @staticmethod
    def pick(rng, text):
        k = int(rng.integers(len(text)))
        return text[:k] + text[k].lower() + text[k + 1 :], k


def test_operators_of_ones_own(spark, session):
    pool = sl.Pool(Tandem(sl.from_seqs(["AC", "G"], mode="sequential"), 3, prefix="t"))
    assert sorted(seqs(pool, spark)) == sorted(["AC", "G", "ACAC", "GG", "ACACAC", "GGG"])
    rows = sl.generate_library(pool, init_state=0, report_design_cards=True, spark=spark).toPandas()
    copies = next(c for c in rows.columns if c.endswith("copies"))
    assert all(r["seq"].replace("AC", "G") == "G" * r[copies] for _, r in rows.iterrows())
    inside = sl.Pool(Tandem(sl.from_seq("T<r>AC</r>T"), 2, region="r"), regions=["r"])
    assert seqs(inside, spark) == ["T<r>AC</r>T", "T<r>ACAC</r>T"]
    assert seqs(inside.copy(), spark) == seqs(inside, spark) and isinstance(inside.copy().operation, Tandem)
    drawn = sl.Pool(Spelled(sl.from_seq("ACGT")))
    rows = sl.generate_library(drawn, num_seqs=20, seed=1, init_state=0, report_design_cards=True, spark=spark).toPandas()
    place = next(c for c in rows.columns if c.endswith("place"))
    assert all(r["seq"][r[place]] == "acgt"[r[place]] and r["seq"].upper() == "ACGT" for _, r in rows.iterrows()) and rows[place].nunique() > 1
    assert seqs(drawn, spark, num_seqs=9, seed=1) == seqs(drawn, spark, num_seqs=9, seed=1)


def test_empty_pools(spark, session):
    kmers = sl.get_kmers(1, mode="sequential", prefix="k")
    none = kmers[5:2]
    assert none.num_states == 0 and seqs(none, spark) == []
    assert seqs(none.mutagenize(num_mutations=1, mode="sequential", prefix="m"), spark) == []
    assert seqs(sl.join([none, kmers]), spark) == [] and seqs(none.repeat(2), spark) == []
    assert seqs(sl.stack([none, kmers, none]), spark) == ["A", "C", "G", "T"]
    assert none.to_df(num_cycles=1, include_design_cards=True).count() == 0


def test_order_of_slices_among_factors(spark, session):
    """A slice of a pool that is to vary fastest varies fastest."""
    fast, slow = sl.get_kmers(1, mode="sequential", iter_order=-1), sl.from_seqs(["x", "y"], mode="sequential")
    assert seqs(sl.join([fast[1:3], slow]), spark) == ["Cx", "Gx", "Cy", "Gy"]
    assert seqs(sl.join([sl.stack([fast[:1], fast[3:]]), slow]), spark) == ["Ax", "Tx", "Ay", "Ty"]
    assert fast[1:3].iter_order == -1
