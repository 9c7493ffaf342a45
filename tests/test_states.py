import random

import pytest
from pyspark.sql import functions as F

import seqloom as sl
from seqloom.plans import states as st


@pytest.fixture(autouse=True)
def manager():
    with st.Manager() as m:
        yield m


def test_nested_product():
    a, b, c = st.State(2, "a"), st.State(3, "b"), st.State(2, "c")
    ab = st.product([a, b])
    root = st.product([ab, c])
    found = st.values(root, 7)
    assert (found[ab], found[c], found[a], found[b]) == (1, 1, 1, 0)


def test_stack_is_exclusive():
    a, b = st.State(2), st.State(2)
    root = st.stack([a, b])
    assert [(st.values(root, v)[a], st.values(root, v)[b]) for v in range(4)] == [(0, None), (1, None), (None, 0), (None, 1)]


def test_ordered_product_shares_factors():
    a, b = st.State(2), st.State(3)
    root = st.ordered_product([st.product([a, b]), a])
    assert root.num_values == 6
    assert [st.values(root, v)[b] for v in range(3)] == [0, 1, 2]  # the later state is faster


def test_iter_order_comes_first():
    a, b = st.State(2), st.State(3, iter_order=1)
    assert [st.values(st.ordered_product([a, b]), v)[a] for v in range(3)] == [0, 1, 0]


def test_sync_out_of_range():
    a, b = st.State(4), st.State(2)
    st.sync(a, b)
    assert [st.values(a, v)[b] for v in range(4)] == [0, 1, None, None]


def test_conflict():
    a = st.State(3)
    root = st.product([st.slice_state(a, slice(None)), st.slice_state(a, slice(None, None, -1))])
    with pytest.raises(st.ConflictingValueAssignmentError):
        st.values(root, 0)


def test_seeded_tables_follow_the_standard_library():
    a = st.State(10)
    want = list(range(10))
    random.Random(5).shuffle(want)
    s = st.shuffle(a, seed=5)
    assert [st.values(s, v)[a] for v in range(10)] == want
    t = st.sample(a, 4, seed=2)
    assert [st.values(t, v)[a] for v in range(4)] == random.Random(2).choices(range(10), k=4)


def test_split_sizes():
    assert [p.num_values for p in st.split(st.State(10), 3)] == [4, 3, 3]
    assert sum(p.num_values for p in st.split(st.State(10), [0.2, 0.5, 0.3])) == 10


def test_stepping():
    a = st.State(3)
    a.value = 2
    a.advance()
    assert a.value == 0
    a._value = None
    with pytest.raises(RuntimeError):
        a.advance()


def test_columns_agree_with_values(spark, manager):
    a, b, c = st.State(4, "a"), st.State(3, "b"), st.State(2, "c")
    root = st.repeat(st.slice_state(st.stack([st.product([a, b]), st.interleave([c, st.State(2, "d")])]), slice(15, 1, -2)), 2, name="root")
    for row in manager.get_iteration_df(root, spark).collect():
        want = st.values(root, row["root"])
        assert row.asDict() == {s.name: want.get(s) for s in root.get_ancestors()}


@pytest.mark.parametrize("bad", [0, -1, 2.5])
def test_sizes_are_positive(bad):
    with pytest.raises(ValueError):
        st.State(bad)


@pytest.mark.parametrize("n", [1001, 4096, 5003])
def test_computed_permutations(spark, manager, n):
    a = st.State(n, "a")
    root = st.shuffle(a, seed=n, name="root")
    want = [st.values(root, v)[a] for v in range(n)]
    assert sorted(want) == list(range(n)) and want != sorted(want)
    got = {r["root"]: r["a"] for r in root.get_iteration_df(spark).collect()}
    assert [got[v] for v in range(n)] == want
    # no pattern: neighbours are as far apart as at random (a third of n in the mean)
    assert 0.3 < sum(abs(x - y) for x, y in zip(want, want[1:])) / n / n < 0.37


def test_computed_samples(spark, manager):
    a = st.State(10**12, "a")
    for replaced in (True, False):
        root = st.sample(a, 3000, seed=4, with_replacement=replaced, name=f"root{replaced}")
        got = {r[f"root{replaced}"]: r["a"] for r in root.get_iteration_df(spark).collect()}
        assert [got[v] for v in range(3000)] == [st.values(root, v)[a] for v in range(3000)]
        assert len(set(got.values())) == 3000 and 0 <= min(got.values()) < 10**10 and 99 * 10**10 < max(got.values()) < 10**12


def test_large_shuffles_are_planned_at_once(spark, manager):
    import time

    start = time.perf_counter()
    root = st.shuffle(st.State(10**9, "a"), seed=1)[5:25]
    assert len({r["a"] for r in root.get_iteration_df(spark).collect()}) == 20
    assert time.perf_counter() - start < 10


def test_names_and_values(manager, capsys):
    a, b = st.State(4, "a"), st.State(3)
    c = st.product([a, b], "c")
    c.value = 7
    assert manager.get_all_names() == ["a", "State[1]", "c"] and manager.get_by_name("a") is a and set(manager.get_ancestors(c)) == {a, b, c}
    assert c.get_states() == {"c": 7, "a": 3} and c.get_states(named_only=False) == {"c": 7, "a": 3, "State[1]": 1}
    c.print_states()
    c.print_dag()
    assert capsys.readouterr().out.startswith("c=7, a=3\nc [product, n=12]\n    a [leaf, n=4]")
    manager.inactivate_all([c])
    assert not a.is_active and c.get_states(include_inactive=False) == {}
    manager.reset_all()
    assert c.value == 0 == a.value
    manager.clear_all_values()
    assert c.value is None and b.value is None
    assert a.synced_parent("d").named("e").num_values == 4
    with pytest.raises(KeyError):
        manager.get_by_name("none")


# --- more values than a long holds ----------------------------------------------------------------------------------
def _wide_roots():
    leaves = [st.State(n, x) for n, x in ((10**6, "a"), (999_983, "b"), (10**6, "c"), (7, "d"), (999_979, "e"))]
    whole = st.product(leaves[:4])
    yield whole
    yield st.product([st.stack([whole, st.State(10**9, "f")]), leaves[4]])
    yield whole[10**18 : 10**18 + 10**6 : 3]
    yield whole[5 * 10**18 : 17 : -(10**13)]
    yield st.repeat(whole, 3)
    yield st.interleave([st.product([st.State(10**7), st.State(10**13)]), st.product([st.State(10**12), st.State(10**8)])])
    yield st.stack([whole, st.product([st.State(10**10), st.State(10**10)])])
    yield st.shuffle(whole, seed=3)
    yield st.sample(whole, 5000, seed=3)
    yield st.sample(whole, 7, seed=3)
    yield st.sample(whole, 5000, seed=3, with_replacement=False)
    yield st.sample(whole, sampled_states=[0, 10**18, 6 * 10**18])
    yield st.shuffle(st.product([st.State(10**16), st.State(10**16)]), seed=1)


@pytest.mark.parametrize("which", range(13))
def test_wide_states_as_columns(spark, which):
    """Columns of states beyond 2**63 values against the same in Python, at the ends, near 2**63 and at random."""
    rng = random.Random(which)
    with st.Manager():
        root = list(_wide_roots())[which]
        n = root.num_values
        spots = {0, 1, n - 1, n // 2, *(rng.randrange(n) for _ in range(20)), *(x for x in (2**63 - 1, 2**63, 2**63 + 1) if x < n)}
        table = spark.createDataFrame([(str(v),) for v in spots], "v string").select(F.col("v").cast(st.kind_of(n)).alias("v"))
        cols = st.columns(root, F.col("v"))
        for r in table.select(F.col("v"), *[c.alias(f"s{s.id}") for s, c in cols.items()]).collect():
            want = st.values(root, int(r["v"]))
            assert {s: None if r[f"s{s.id}"] is None else int(r[f"s{s.id}"]) for s in cols} == {s: want[s] for s in cols}


def test_libraries_beyond_longs(spark):
    import seqloom as sl

    with sl.Session():
        pool = sl.join([sl.get_kmers(9, mode="sequential") for _ in range(4)])
        assert pool.num_states == 4**36

        def kmer(v):
            return "".join("ACGT"[v >> 2 * i & 3] for i in reversed(range(36)))

        at = 10**21 + 12345
        read = lambda p, start, n=3: [r["seq"] for r in sl.generate_library(p, num_seqs=n, init_state=start, spark=spark, with_index=True).orderBy("_row").collect()]
        assert read(pool, at) == [kmer(at + i) for i in range(3)]
        assert read(pool, 4**36 - 1, 2) == [kmer(4**36 - 1), kmer(0)], "rows wrap at the end"
        assert read(pool[at : at + 9 : 4], 0) == [kmer(at + 4 * i) for i in range(3)]
        few = pool.sample(num_seqs=3000, seed=1)
        assert len(set(read(few, 0, 3000))) == 3000
        mutants = pool.mutagenize(num_mutations=2)
        assert read(mutants, at) == read(mutants, at) and all(sum(a != b for a, b in zip(x, y)) == 2 for x, y in zip(read(mutants, at), read(pool, at)))
        kept = sl.generate_library(pool.filter(lambda s: s.endswith("A")), num_seqs=4, discard_null_seqs=True, init_state=at, spark=spark, max_iterations=100)
        assert sorted(r["seq"] for r in kept.collect()) == [kmer(at + i) for i in range(16) if kmer(at + i).endswith("A")]


def test_paths_that_differ_are_errors(spark):
    with st.Manager() as m:
        a = st.State(4, "a")
        root = st.product([st.slice_state(a, slice(None)), st.slice_state(a, slice(None, None, -1))], "root")
        with pytest.raises(st.ConflictingValueAssignmentError):
            root.value = 0
        with pytest.raises(Exception, match="conflicting values of state a"):
            m.get_iteration_df(root, spark).collect()
        b = st.State(6, "b")
        agreeing = st.stack([b[:3], b[3:]], "agreeing")
        assert [r["b"] for r in m.get_iteration_df(agreeing, spark).orderBy("agreeing").collect()] == [0, 1, 2, 3, 4, 5]


def test_order_of_what_is_made_of_others():
    """Without an order of its own a state has the least one of its parents."""
    a, b, c = st.State(4, "a", iter_order=-1), st.State(2, "b"), st.State(4, "c", iter_order=3)
    made = [st.slice(a, stop=2), st.repeat(a, 2), st.shuffle(a, seed=1), st.sample(a, 2, 1), st.stack([b, a]), st.product([c, a]), st.interleave([c, a])]
    assert [s.iter_order for s in made] == [-1] * 7 and st.slice(a, iter_order=5).iter_order == 5 and st.slice(c).iter_order == 3
    root = st.ordered_product([st.slice(a, 1), b])
    assert [st.values(root, v)[a] for v in range(4)] == [1, 2, 3, 1]


def test_slices_and_empty_states(spark, manager):
    a = st.State(8, "a")
    assert [st.slice(a, start=3).num_values, st.slice(a, stop=3).num_values, st.slice(a, step=-3).num_values] == [5, 3, 3]
    for empty in (a[5:2], st.slice(a, 8), st.stack([]), st.product([a[5:2], a]), st.repeat(a[5:2], 2), st.stack([a[5:2], a[6:6]])):
        assert empty.num_values == 0 and list(empty) == [] and empty.get_iteration_df(spark).collect() == []
    assert st.product([]).num_values == 1 and st.stack([a[5:2], a]).num_values == 8


def test_proportional_splits():
    def sizes(n, parts):
        return [p.num_values for p in st.split(st.State(n), parts)]

    assert sizes(10, [1.0, 1.0]) == [5, 5] and sizes(10, [1, 3]) == [2, 8]
    assert sizes(10, [1, 1, 1, 1]) == [2, 2, 3, 3]  # 2.5 rounds to 2: the last two lost as much as the others
    assert sizes(11, [1, 1, 1]) == [3, 4, 4] and sizes(14, [1, 1, 1, 1]) == [2, 4, 4, 4]  # too much by rounding: the first gives until one is left
    assert sizes(3, [100, 1, 1]) == [1, 1, 1] and sizes(5, [98, 1, 1]) == [3, 1, 1]
    for bad in (1, [1.0], 11, [1] * 11):
        with pytest.raises(ValueError):
            st.split(st.State(10), bad)


def test_values_while_stepping(manager):
    a, b = st.State(3, "a"), st.State(4, "b")
    assert a.value is None and not a.is_active and "value=None" in repr(a)
    c = st.product([a, b], "c")
    assert "ProductOp" in repr(c) and "num_values=12" in repr(c)
    assert [(v, a.value, b.value) for v in c][:4] == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 0, 1)] and c.value == 0
    c.reset(7)
    shared, own = c.copy(), c.deepcopy()
    assert (shared.value, own.value, a.value) == (7, 7, 1) and shared.parents == c.parents and not set(own.parents) & {a, b}
    own.value = 4
    assert a.value is None and own.parents[0].value == 1  # what else the manager knows is inactive while a derived state has a value
    shared.value = 11
    assert (a.value, b.value) == (2, 3) and st.State(2).copy().value is None
    with pytest.raises(AttributeError):
        a.id = 5
    with pytest.raises(ValueError):
        c.reset(12)


def test_advancing_synchronised_states(manager):
    a = st.State(3, "a")
    b = st.synced_to(a, 5, "b")
    a.value = 2
    a.advance()
    assert (a.value, b.value) == (0, 0)
    b.value = 4
    assert a.value is None
    a.advance()  # (4 + 1) modulo 3
    assert (a.value, b.value) == (2, 2)
    b.value = 4
    b.advance()
    assert (a.value, b.value) == (0, 0)


def test_iteration_of_chosen_states(spark, manager):
    a, b, other = st.State(2, "a"), st.State(3, "b"), st.State(3, "other")
    c = st.stack([a, b], "c")
    df = manager.get_iteration_df(c, states=[b, c, other], spark=spark)
    assert df.columns == ["c", "b", "other"]
    assert [tuple(r) for r in df.orderBy("c").collect()] == [(0, None, None), (1, None, None), (2, 0, None), (3, 1, None), (4, 2, None)]


def test_arguments_that_exclude_each_other():
    a = st.State(3)
    for bad in (
        lambda: st.shuffle(a, seed=1, permutation=[0, 1, 2]),
        lambda: st.shuffle(a, permutation=[0, 1, 1]),
        lambda: st.shuffle(a, permutation=[0, 1]),
        lambda: st.sample(a),
        lambda: st.sample(a, 2, sampled_states=[0]),
        lambda: st.sample(a, sampled_states=[3]),
        lambda: st.sample(a, 4, seed=1, with_replacement=False),
    ):
        with pytest.raises(ValueError):
            bad()


def test_long_explicit_orders_are_tables(spark, manager):
    """A long list is stored and joined, not a literal for each value in the plan; a DataFrame never comes to the driver."""
    n = 25_000
    order = [i * 7 % n for i in range(n)]
    table = spark.range(n).select((F.col("id") * 7 % n).alias("value"), F.col("id").alias("idx"))
    for permutation in (order, table):
        a, p = st.State(n, "a"), st.State(2, "p")
        root = st.product([st.shuffle(a, permutation=permutation), p], "root").deepcopy("root")
        df = root.get_iteration_df(spark).select("root", root.get_ancestors()[2].name)
        assert "Join" in df._jdf.queryExecution().optimizedPlan().toString()
        assert [tuple(r) for r in df.orderBy("root").collect()] == [(v, order[v % n]) for v in range(2 * n)]
        assert st.values(st.shuffle(a, permutation=permutation), 5)[a] == 35
    with sl.Session():
        source = sl.from_table(spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("seq")), index_col="idx", num_rows=n)
        chosen = source.sample(seq_states=order[:12_000] + [3, 3]).state_shuffle(permutation=spark.range(12_002).select(F.col("id").alias("idx"), (12_001 - F.col("id")).alias("value")))
        found = sl.generate_library(chosen, with_index=True, spark=spark, init_state=0).orderBy("_row").collect()
        assert [r["seq"] for r in found] == [str(v) for v in reversed(order[:12_000] + [3, 3])]
    for wrong in (spark.range(4).select(F.col("id").alias("idx"), (F.col("id") % 3).alias("value")), spark.range(3).select(F.col("id").alias("idx"), F.col("id").alias("value"))):
        with pytest.raises(ValueError):
            st.shuffle(st.State(4), permutation=wrong)
