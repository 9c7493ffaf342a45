import itertools
import math
import random

import pandas as pd
import pytest
import xxhash

import seqloom as sl
from seqloom.functions.dna import reverse_complement



@pytest.fixture(autouse=True)
def _session(session):
    return session


def rows(pool, **options):
    options.setdefault("init_state", 0)
    return [(r["name"], r["seq"]) for r in sl.generate_library(pool, **options).collect()]


def seqs(pool, **options):
    return [s for _, s in rows(pool, **options)]


def test_lists_clip_and_cycle(spark):
    four = ["A", "B", "C", "D"]
    assert seqs(sl.from_seqs(four, mode="sequential", num_states=2)) == ["A", "B"]
    assert seqs(sl.from_seqs(four, mode="sequential", num_states=6)) == ["A", "B", "C", "D", "A", "B"]


def test_names_are_padded_and_joined(spark):
    pool = sl.join([sl.from_seqs(["A"] * 12, mode="sequential", prefix="s"), sl.from_seqs(["C", "G"], mode="sequential", seq_names=["x", "y"])])
    assert [n for n, _ in rows(pool)][:3] == ["s_00.x", "s_00.y", "s_01.x"]


@pytest.mark.parametrize(("length", "k"), [(4, 1), (4, 2), (5, 3), (3, 3)])
def test_sequential_mutations_in_order(spark, length, k):
    base = "ACGTA"[:length]
    want = []
    for places in itertools.combinations(range(length), k):
        for digits in itertools.product(range(3), repeat=k):
            chars = list(base)
            for p, d in zip(places, digits):
                chars[p] = sorted(set("ACGT") - {base[p]})[d]
            want.append("".join(chars))
    assert seqs(sl.mutagenize(base, num_mutations=k, mode="sequential")) == want
    assert len(want) == math.comb(length, k) * 3**k == len(set(want))


def test_mutations_skip_gaps_and_tags_and_keep_case(spark):
    got = seqs(sl.mutagenize("a-<r>C</r>", num_mutations=1, mode="sequential"))
    assert got == ["c-<r>C</r>", "g-<r>C</r>", "t-<r>C</r>", "a-<r>A</r>", "a-<r>G</r>", "a-<r>T</r>"]


def test_random_rows_follow_the_seed_and_index_only(spark):
    pool = sl.mutagenize("ACGTACGTAC", num_mutations=2)
    some = seqs(pool, num_seqs=40, seed=3, partitions=1)
    assert some == seqs(pool, num_seqs=40, seed=3, partitions=7)
    assert some[15:20] == seqs(pool, num_seqs=5, seed=3, init_state=15)
    assert some != seqs(pool, num_seqs=40, seed=4)


def chained(*values):
    """xxHash of longs, one after the other."""
    h = 42
    for x in values:
        h = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), h)
    return h


def hashed(seed, op, state, stream, j=0):
    """A row's random 64-bit number, unsigned."""
    key = chained(seed, op, state, stream)
    return chained(key - (1 << 64 if key >> 63 else 0), j)


def test_random_draws_are_hashes_of_seed_operation_and_row(spark):
    pool = sl.get_kmers(6)
    want = [(hashed(9, pool.operation.id, r, 0) >> 2) % 4**6 for r in range(5)]
    assert seqs(pool, num_seqs=5, seed=9) == ["".join("ACGT"[v >> 2 * i & 3] for i in range(5, -1, -1)) for v in want]
    shuffled = sl.shuffle_seq("AACCGGTT")
    order = sorted(range(8), key=lambda j: (hashed(9, shuffled.operation.id, 0, 0, j) ^ 1 << 63) >> 24)
    assert seqs(shuffled, num_seqs=1, seed=9) == ["".join("AACCGGTT"[i] for i in order)]


def test_the_cursor_goes_on(spark):
    pool = sl.from_seqs(list("ABCD"), mode="sequential")
    assert seqs(pool, num_seqs=3) == ["A", "B", "C"]
    assert seqs(pool, num_seqs=3, init_state=None) == ["D", "A", "B"]


def test_stack_repeat_order(spark):
    lib = sl.stack([sl.from_seqs(["a0", "a1", "a2"], mode="sequential"), sl.from_seqs(["b0", "b1"], mode="sequential")])
    assert seqs(lib.repeat(2)) == ["a0", "a0", "a1", "a1", "a2", "a2", "b0", "b0", "b1", "b1"]
    assert seqs(lib.repeat(2, iter_order=1)) == ["a0", "a1", "a2", "b0", "b1"] * 2


def test_a_pool_used_twice_is_in_lockstep(spark):
    x = sl.from_seqs(["A", "C"], mode="sequential")
    assert seqs(sl.join([x, x])) == ["AA", "CC"]
    assert len(seqs(sl.join([x, x.deepcopy()]))) == 4


def test_regions(spark):
    t = sl.from_seq("AAA<reg>CCCC</reg>GGG<bc/>")
    assert seqs(t.extract_region("reg")) == ["CCCC"]
    assert seqs(t.remove_tags("reg", keep_content=False)) == ["AAAGGG<bc/>"]
    assert seqs(t.replace_region("TT", "reg")) == ["AAATTGGG<bc/>"]
    assert seqs(t.apply_at_region("reg", lambda p: p.lower(), remove_tags=False)) == ["AAA<reg>cccc</reg>GGG<bc/>"]
    assert seqs(t.insert_tags("x", 3, 5)) == ["AAA<reg><x>CC</x>CC</reg>GGG<bc/>"]
    with pytest.raises(ValueError):
        sl.from_seq("AC").extract_region("none")


def test_scans(spark):
    assert seqs(sl.deletion_scan("ACGT", 2, mode="sequential")) == ["--GT", "A--T", "AC--"]
    assert seqs(sl.deletion_scan("ACGT", 2, None, mode="sequential")) == ["GT", "AT", "AC"]
    assert seqs(sl.subseq_scan("ACGT", 3, mode="sequential")) == ["ACG", "CGT"]
    got = rows(sl.insertion_scan("AC", sl.from_seqs(["x", "y"], mode="sequential"), mode="sequential", prefix="i", prefix_position="p"))
    assert got[:4] == [("i_0.p_0", "xAC"), ("i_2.p_1", "AxC"), ("i_4.p_2", "ACx"), ("i_1.p_0", "yAC")]
    assert seqs(sl.replacement_scan("ACGT", "tt", mode="sequential")) == ["ttGT", "AttT", "ACtt"]
    with pytest.raises(ValueError):
        sl.deletion_scan("ACGT", 4)


def test_multiscans_do_not_overlap(spark):
    for s in seqs(sl.deletion_multiscan("ACGTACGTACGT", 3, 2), num_seqs=50, seed=1):
        assert s.count("-") == 6 and len(s) == 12
    for s in seqs(sl.insertion_multiscan("ACGT", 2, sl.from_seqs(["x", "y"])), num_seqs=50, seed=1):
        assert s.replace("x", "").replace("y", "") == "ACGT" and len(s) == 6


def test_translation_frames(spark):
    assert [seqs(sl.translate("ATGGCTTAA", frame=f))[0] for f in (1, 2, 3)] == ["MA*", "WL", "GL"]
    assert seqs(sl.translate("ATGGCTTAA", include_stop=False)) == ["MA"]
    assert seqs(sl.translate("TTAAGCCAT", frame=-1)) == ["MA*"]
    assert seqs(sl.translate("ATGNNN")) == ["M"]
    assert seqs(sl.reverse_translate("MA*")) == ["ATGGCCTGA"]


def test_codon_substitutions(spark):
    got = seqs(sl.mutagenize_orf("ATGGCT", num_mutations=1, mode="sequential"))
    assert len(got) == 38 and got[0] == "TTCGCT"
    assert {seqs(sl.translate(g))[0] for g in got[:3]} == {"FA", "LA", "IA"}
    back = seqs(sl.mutagenize_orf("AGCCAT", num_mutations=1, mutation_type="nonsense", frame=-1, mode="sequential"))
    assert back[0] == "AGCTCA"  # codon 0 is the last one, read on the other strand
    with pytest.raises(ValueError):
        sl.mutagenize_orf("ATGGCT", num_mutations=1, mutation_type="synonymous", mode="sequential")


def test_filters(spark):
    pool = sl.from_seqs(["AAAA", "GGGG", "ACGT", "GAATTC"], mode="sequential")
    assert seqs(pool.filter_gc(0.4, 0.6)) == [None, None, "ACGT", None]
    assert seqs(pool.filter_homopolymer(3)) == [None, None, "ACGT", "GAATTC"]
    assert seqs(pool.filter_restriction_sites("EcoRI")) == ["AAAA", "GGGG", "ACGT", None]
    assert seqs(pool.filter(lambda s: "A" in s), num_seqs=2, discard_null_seqs=True) == ["AAAA", "ACGT"]
    with pytest.warns(UserWarning):
        assert seqs(pool.filter_gc(0.9), num_seqs=3, discard_null_seqs=True) == ["GGGG"]
    with pytest.raises(ValueError):
        sl.generate_library(pool.filter_gc(0.5), discard_null_seqs=True)


@pytest.mark.parametrize("seq", ["", "A", "AC", "ACGTACGTTT", "aaaaaaaa", "NNN"])
def test_measures_agree_on_strings_and_columns(spark, seq):
    from pyspark.sql import functions as F

    c = F.lit(seq)
    got = spark.range(1).select(sl.calc_gc(c), sl.calc_complexity(c), sl.calc_dust(c), sl.has_homopolymer(c, 2)).first()
    want = (sl.calc_gc(seq), sl.calc_complexity(seq), sl.calc_dust(seq), sl.has_homopolymer(seq, 2))
    assert got == pytest.approx(want)


def test_cards_and_columns(spark):
    pool = sl.mutagenize("ACGT", num_mutations=1, mode="sequential", prefix="m")
    df = sl.generate_library(pool, report_design_cards=True, init_state=0)
    name = pool.operation.name
    assert df.columns[:2] == ["name", "seq"]
    row = df.first()
    assert row[f"{name}.key.positions"] == [0] and row[f"{name}.key.wt_chars"] == ["A"] and row[f"{name}.key.mut_chars"] == ["C"]
    sl.toggle_cards(False)
    assert sl.generate_library(pool, report_design_cards=True, init_state=0).columns == ["name", "seq"]


def test_materialize_keeps_order_however_a_run_is_cut(spark, session, tmp_path):
    """Ranges of a sampled sort differ from run to run; the places of rows must not follow from them."""
    texts = [f"{i:05d}" for i in range(12_000)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx long, seq string").repartition(7).write.parquet(str(tmp_path / "texts"))
    table = spark.read.parquet(str(tmp_path / "texts"))
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        pool = sl.from_table(table, index_col="idx", num_rows=12_000, seq_length=5)
        kept = pool.filter(lambda s: ~s.endswith("7"), native=True).materialize(num_cycles=1)
        df = kept.generate_library(with_index=True, init_state=0)
        for _ in range(2):
            assert [r["seq"] for r in df.orderBy("_row").collect()] == [t for t in texts if t[-1] != "7"]
    finally:
        spark.conf.set(name, before)


def test_materialize_cuts_the_plan(spark):
    kept = sl.from_seqs(["AAAA", "GGGG", "ACGT"], mode="sequential").filter(lambda s: "A" in s).materialize(num_seqs=2)
    assert kept.parents == [] and seqs(kept) == ["AAAA", "ACGT"]


def test_tables_are_pools(spark):
    df = spark.createDataFrame([("AC", "one"), ("GT", "two")], "s string, n string").coalesce(1)
    pool = sl.from_table(df, "s", "n")
    assert rows(pool.repeat(2)) == [("one", "AC"), ("one", "AC"), ("two", "GT"), ("two", "GT")] or sorted(rows(pool)) == [("one", "AC"), ("two", "GT")]


def test_fasta(spark, tmp_path):
    path = tmp_path / "g.fa"
    path.write_text(">chr1 first\nACGTACGT\nACGT\n>chr2\nAAAACCCC\n")
    pool = sl.from_fasta(str(path), [("chr1", 1, 5, "+"), ("chr2", 2, 6, "-"), ("chr1", 10, 2, "+")])
    assert rows(pool) == [("chr1:1-5(+)", "CGTA"), ("chr2:2-6(-)", "GGTT"), ("chr1:10-2(+)", "GTAC")]


def test_fasta_in_splits(spark, tmp_path, monkeypatch):
    """Records and lines that go over the borders of splits and blocks, several files, empty lines."""
    from seqloom.sources import sources

    rng, genome = random.Random(3), {}
    (tmp_path / "g").mkdir()
    for f in range(2):
        out = ""
        for c in range(7):
            name, seq = f"f{f}c{c}", "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 59, 60, 61, 900, 3000])))
            genome[name] = seq
            out += f">{name} words\n" + "".join(seq[i : i + 60] + "\n" + "\n" * (rng.random() < 0.1) for i in range(0, len(seq), 60))
        (tmp_path / "g" / f"{f}.fa").write_text(out)
    monkeypatch.setattr(sources, "FASTA_BLOCK", 100)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        pieces = sources.fasta_pieces(spark, str(tmp_path / "g"))
        assert spark.read.text(str(tmp_path / "g")).rdd.getNumPartitions() > 3
        got = {}
        for r in sorted(pieces.collect()):
            assert len(got.get(r["chrom"], "")) == r["pos"]
            got[r["chrom"]] = got.get(r["chrom"], "") + r["seq"]
        assert got == {k: v for k, v in genome.items() if v}
        wanted = [(c, a, b, rng.choice("+-")) for c, v in got.items() for _ in range(6) for a, b in [(rng.randrange(len(v) + 1), rng.randrange(len(v) + 1))]]
        pool = sl.from_fasta(str(tmp_path / "g"), wanted + wanted[:2])
        made = {r["_row"]: r for r in sl.generate_library(pool, init_state=0, with_index=True).collect()}
        for i, (c, a, b, strand) in enumerate(wanted + wanted[:2]):
            title, seq = made[i]["name"], made[i]["seq"]
            want = got[c][a:b] if a <= b else got[c][a:] + got[c][:b]
            assert title == (f"{c}:{a}-{b}({strand})" if want else None) and (seq or "") == (want if strand == "+" else reverse_complement(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(ValueError, match="none"):
        sl.from_fasta(str(tmp_path / "g"), [("none", 1, 2, "+")])
    inside = sl.from_fasta(str(tmp_path / "g"), [("f0c0", 0, 0, "+"), *[(c, 0, 5, "+") for c, v in got.items() if len(v) > 5]], pool="AA<r/>CC", region="r", remove_tags=True)
    assert sorted(map(len, seqs(inside))) == [4] + [9] * (inside.num_states - 1) and all(s.startswith("AA") for s in seqs(inside))


@pytest.mark.parametrize("kind", ["csv", "tsv", "jsonl", "parquet", "fasta"])
def test_files(spark, tmp_path, kind):
    pool = sl.from_seq("ACGT" * 20).mutagenize(num_mutations=1, mode="sequential", prefix="m")
    assert pool.to_file(str(tmp_path / "out"), kind, num_cycles=1) == 240
    if kind == "fasta":
        lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*"))).split("\n")
        assert lines[0] == ">m_000" and len(lines[1]) == 60 and len(lines[2]) == 20


def test_motifs(spark):
    got = seqs(sl.from_motif(pd.DataFrame({"A": [1.0, 0.5], "T": [0.0, 0.5]})), num_seqs=60, seed=1)
    assert set(got) == {"AA", "AT"}
    with pytest.raises(ValueError):
        sl.from_motif({"A": [0.0]})


def test_streams(spark, tmp_path):
    from seqloom.streaming.stream import stream_library

    spark.range(20).withColumnRenamed("id", "value").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("value long").parquet(str(tmp_path / "in"))
    pool = sl.mutagenize("ACGTACGT", num_mutations=1)
    query = stream_library(pool, source, seed=2).writeStream.format("memory").queryName("lib").start()
    query.processAllAvailable()
    query.stop()
    got = [r["seq"] for r in spark.sql("select * from lib order by `index`").collect()]
    assert got == seqs(pool, num_seqs=20, seed=2)


def test_previews(spark, capsys):
    pool = sl.from_seq("AC<r>GT</r>").stylize(region="r", style="bold red")
    pool.print_library()
    pool.print_dag()
    out = capsys.readouterr().out
    assert "\033[91;1m" in out and "stylize" in out


def test_styles():
    from seqloom.functions.colors import CSS_COLORS
    from seqloom.sources.sinks import ansi

    assert ansi("tomato on_navy") == "\033[38;2;255;99;71;48;2;0;0;128m" and ansi("38;5;208 underline #0a0B0c") == "\033[38;5;208;4;38;2;10;11;12m"
    assert ansi("on_red uppercase") == "\033[101m" and ansi("lower") == "" and len(CSS_COLORS) == 148
    with pytest.raises(ValueError, match="no_colour"):
        ansi("no_colour")


@pytest.mark.parametrize(
    "bad",
    [
        lambda: sl.from_seqs([]),
        lambda: sl.mutagenize("ACGT", num_mutations=0),
        lambda: sl.mutagenize("ACGT"),
        lambda: sl.mutagenize("ACGT", num_mutations=5),
        lambda: sl.get_kmers(0),
        lambda: sl.get_kmers(11, mode="sequential"),
        lambda: sl.shuffle_seq("AC", mode="sequential"),
        lambda: sl.recombine(sources=["AC"]),
        lambda: sl.recombine(sources=["AC", "ACG"]),
        lambda: sl.from_seq("A<r>C"),
        lambda: sl.from_seqs(["A"], seq_names=["a"], prefix="p"),
        lambda: sl.from_seq("AC").filter_gc(0.7, 0.2),
        lambda: sl.from_seq("AC").filter_restriction_sites("NoSuch"),
        lambda: sl.from_iupac("AZ"),
    ],
)
def test_refusals(bad):
    with pytest.raises(ValueError):
        bad()


def test_public_names(spark):
    pool = sl.mutagenize("ACGT", num_mutations=1)
    assert isinstance(pool.operation, sl.MutagenizeOp) and not isinstance(pool.operation, sl.StackOp)
    pool.add_region("r", 2)
    assert pool.has_region("r") and sl.states.get_product_order_mode() == "first_state_slowest"


def test_copies_of_scans_and_tables_are_their_own(spark):
    scan = sl.deletion_scan("ACGT", 2, mode="sequential")
    assert seqs(sl.join([scan, scan.deepcopy()])) == [a + b for a in ("--GT", "A--T", "AC--") for b in ("--GT", "A--T", "AC--")]
    table = spark.createDataFrame([(0, "A"), (1, "C")], "i long, s string")
    pool = sl.from_table(table, "s", index_col="i")
    assert sorted(seqs(sl.join([pool, pool.deepcopy()]))) == ["AA", "AC", "CA", "CC"]


def test_a_table_is_expanded_in_place(spark):
    table = spark.createDataFrame([(i, s) for i, s in enumerate(["ACGT", "GGGG", "TTTT"])], "i long, s string")
    pool = sl.from_table(table, "s", index_col="i", seq_length=4, plain=True).mutagenize(num_mutations=2, mode="sequential")
    df = sl.generate_library(pool, init_state=0, with_index=True)
    assert "Join" not in df._jdf.queryExecution().toString()
    whole = {r["_row"]: r["seq"] for r in df.collect()}
    some = {r["_row"]: r["seq"] for r in sl.generate_library(pool, num_seqs=30, init_state=50, with_index=True).collect()}
    assert len(whole) == 162 and some == {i: whole[i] for i in range(50, 80)}


@pytest.mark.parametrize("n", [2, 3, 10, 400])
def test_pairs_are_unranked_exactly(spark, n):
    from pyspark.sql import functions as F

    from seqloom.operators.mutate import unranked

    total = math.comb(n, 2)
    rows = spark.range(total).select("id", *[c.alias(x) for c, x in zip(unranked(F.col("id"), n, 2), "ab")]).orderBy("id").collect()
    assert [(r["a"], r["b"]) for r in rows] == list(itertools.combinations(range(n), 2))


def test_graphs(spark, session, capsys):
    sl.join([sl.from_seq("A"), "C"])
    session.print_graph("minimal")
    session.manager.print_graph()
    out = capsys.readouterr().out
    assert out.startswith("pool[2]\n├── pool[0]\n└── pool[1]") and "product" in out


def test_queries_over_whole_tables_and_texts(spark, tmp_path):
    import hashlib
    import itertools

    from seqloom.queries import QUERIES

    n = 130
    spark.range(1, n + 1).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    s = [hashlib.md5(str(k + 1).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4)) for k in range(n)]
    other = lambda c: "ACGT".replace(c, "")
    put = lambda t, at, c: t[:at] + c + t[at + 1 :]
    rich = [(k, t) for k, t in enumerate(s) if sum(t.count(c) for c in "GC") >= 16]
    assert len(rich) > 50
    two = [put(put(t, a, x), b, y) for t in s for a, b in itertools.combinations(range(32), 2) for x in other(t[a]) for y in other(t[b])]
    masked = []
    for t in s:
        w = "A" + t + "CC"
        masked += [put(w, 0, "G")] + [put(w, i, x) for i in range(1, 33) for x in other(w[i])] + [put(w, 34, "T")]
    mixed = [src[a][:p] + src[b][p:] for t in s for src in [(t, "AC" * 16, "GT" * 16)] for p in range(1, 32) for a in range(3) for b in range(3) if a != b]
    kmer = lambda k: "".join("ACGT"[k // 4**j % 4] for j in reversed(range(16)))
    want = {
        "mutagenize_two_whole": list(enumerate(two)),
        "mutagenize_masked": list(enumerate(masked)),
        "recombine": list(enumerate(mixed)),
        "state_shuffle": [(i, s[i * 7 % n]) for i in range(n)],
        "sync": [(k, t + kmer(k)) for k, t in enumerate(s)],
        "materialize": [(2 * j + v, t) for j, (_, t) in enumerate(rich) for v in range(2)],
        "discard_null_seqs": rich[: n // 3],
    }
    wrong = {}
    for name, rows in want.items():
        table = QUERIES[name](spark, str(tmp_path)).select("i", "seq").toPandas().sort_values("i")
        got = list(zip(table["i"].tolist(), table["seq"].tolist()))
        if got != rows:
            wrong[name] = (len(got), len(rows), got[:2], rows[:2])
    assert not wrong, wrong


def test_a_table_is_expanded_through_a_stack(spark, session, tmp_path):
    """Variants of several kinds of each row of a table: no row of the library is moved to be joined to the table."""
    texts = ["".join("ACGT"[i >> 2 * j & 3] for j in range(5)) for i in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "idx long, seq string").write.parquet(str(tmp_path / "texts"))
    older = sl.get_kmers(1, mode="sequential")
    wild = sl.from_table(spark.read.parquet(str(tmp_path / "texts")), index_col="idx", num_rows=300, seq_length=5, plain=True)
    kinds = [wild.deletion_scan(2, mode="sequential"), wild, sl.stack([wild.subseq_scan(2, mode="sequential"), wild.rc()])]
    df = sl.join([sl.stack(kinds), sl.get_kmers(1, mode="sequential")]).generate_library(with_index=True, init_state=0)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    back = str.maketrans("ACGT", "TGCA")
    made = [t[:v] + "--" + t[v + 2 :] for t in texts for v in range(4)] + texts + [t[v : v + 2] for t in texts for v in range(4)] + [t[::-1].translate(back) for t in texts]
    assert [tuple(r) for r in df.select("_row", "seq").orderBy("_row").collect()] == list(enumerate(s + c for s in made for c in "ACGT"))
    # a branch without the table, or with a factor that is slower, is joined as before
    assert sl.stack([wild, sl.get_kmers(2, mode="sequential")]).generate_library(init_state=0).count() == 316
    assert seqs(sl.stack([sl.join([older, wild]), wild])[:302])[298:] == ["A" + texts[298], "A" + texts[299], "C" + texts[0], "C" + texts[1]]
