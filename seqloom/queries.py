"""Queries for each operator family, over DNA derived from the ``part`` table, and their SQL.

Every part gives 32 bases: its key's MD5 digest with hexadecimal digits mapped to A, C, G and T. A row's index is the key's
rank times the operator's states plus the state, as later states vary faster.
"""

from __future__ import annotations

import math
import random
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api as sl
from .functions.codons import CodonTable
from .operators.fixed import passthrough
from .plans import states as st
from .plans.pool import Pool, Session
from .sources.sinks import fasta_lines

DNA = "translate(md5(cast(p_partkey as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
#: The same in SQL: k is the rank of the key, s the sequence.
D = "WITH d AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS k, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part)"


def parts(spark: SparkSession, sf_dir: str, seq: str = "s", length: int | None = 32, regions: tuple = ()) -> Pool:
    """The parts as a pool; keys are contiguous in this table, so the rank is the key less the first one."""
    table = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(DNA).alias("s"))
    first, last, rows = table.agg(F.min("p_partkey"), F.max("p_partkey"), F.count(F.lit(1))).first()
    if last - first + 1 != rows:
        raise ValueError("the keys of part are not contiguous")
    return sl.from_table(table.select(F.expr(seq).alias("seq"), (F.col("p_partkey") - first).alias("idx")), index_col="idx", num_rows=rows, seq_length=length, regions=regions, plain=seq in (DNA, "s") or seq.startswith("substring(s"))


def library(build: Callable[[SparkSession, str], Pool], extra: tuple = (), **options) -> Callable[[SparkSession, str], DataFrame]:
    """A query: columns i (row index) and seq, and cards as ``extra`` (operation's factory, key, column name)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Session():
            pool = build(spark, sf_dir)
            df = sl.generate_library(pool, report_design_cards=bool(extra), with_index=True, spark=spark, init_state=0, **options)
            cards = [F.col(next(f"`{c}`" for c in df.columns if c.endswith(f":{f}.key.{k}"))).alias(a) for f, k, a in extra]
            return df.select(F.col("_row").alias("i"), "seq", *cards)

    return query


def per_row(expression: str, n: int = 1, cross: str = "", where: str = "") -> str:
    """SQL of i and seq: an expression of s (and v below n)."""
    v = f", range({n}) AS r(v)" if n > 1 else ""
    i = f"k * {n} + v" if n > 1 else "k"
    return f"{D} SELECT CAST({i} AS BIGINT) AS i, {expression} AS seq FROM d{v}{cross}{where}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# --- state algebra --------------------------------------------------------------------------------------------------
def states(build: Callable[[int], st.State], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the values of states, of which some have a value for each part."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with st.Manager() as m:
            root = build(spark.read.parquet(f"{sf_dir}/part.parquet").count())
            return m.get_iteration_df(root, spark).select("root", *names)

    return query


def _abc(n: int) -> list[st.State]:
    return [st.State(k, x) for k, x in ((n, "a"), (5, "b"), (3, "c"))]


def span(sql: str, rows: str) -> str:
    """SQL of the same, with n parts."""
    return f"SELECT v AS root, {sql} FROM (SELECT count(*) AS n FROM part), range(CAST({rows} AS BIGINT)) AS r(v)"


def for_each(state: Callable[[], st.State]) -> Callable[[int], st.State]:
    """All values of the state for each part (p)."""
    return lambda n: st.product([state(), st.State(n, "p")], "root")


add("state_product", states(lambda n: st.product(_abc(n), "root"), "a", "b", "c"), span("v % n AS a, v // n % 5 AS b, v // (5 * n) AS c", "15 * n"))
add("state_ordered_product", states(lambda n: st.ordered_product([st.product([(x := _abc(n))[0], x[1]]), x[2], x[0]], "root"), "a", "b", "c"), span("v // 15 AS a, v // 3 % 5 AS b, v % 3 AS c", "15 * n"))
add("state_stack", states(lambda n: st.stack(_abc(n), "root"), "a", "b", "c"), span("CASE WHEN v < n THEN v END AS a, CASE WHEN v >= n AND v < n + 5 THEN v - n END AS b, CASE WHEN v >= n + 5 THEN v - n - 5 END AS c", "n + 8"))
add("state_slice_algebra", states(lambda n: st.slice(st.State(n, "a"), n - 10, 10, -7, "root"), "a"), span("n - 10 - 7 * v AS a", "(n - 14) // 7"))
add("state_repeat", states(lambda n: st.repeat(st.State(n, "a"), 4, "root"), "a"), span("v % n AS a", "4 * n"))
add("state_interleave", states(lambda n: st.interleave([st.State(n, "a"), st.State(n, "b"), st.State(n, "c")], "root"), "a", "b", "c"), span("CASE WHEN v % 3 = 0 THEN v // 3 END AS a, CASE WHEN v % 3 = 1 THEN v // 3 END AS b, CASE WHEN v % 3 = 2 THEN v // 3 END AS c", "3 * n"))
add("state_sample_explicit", states(for_each(lambda: st.sample(st.State(50, "a"), sampled_states=[i * i % 50 for i in range(30)])), "a", "p"), span("(v % 30) * (v % 30) % 50 AS a, v // 30 AS p", "30 * n"))
add("state_shuffle_explicit", states(for_each(lambda: st.shuffle(st.State(101, "a"), permutation=[i * 7 % 101 for i in range(101)])), "a", "p"), span("v % 101 * 7 % 101 AS a, v // 101 AS p", "101 * n"))
add(
    "state_split",
    states(lambda n: st.stack(list(reversed(st.split(st.State(n, "a"), 3))), "root"), "a"),
    span("CASE WHEN v < n // 3 THEN v + n - n // 3 WHEN v < n // 3 + (n + 1) // 3 THEN v - n // 3 + (n + 2) // 3 ELSE v - n // 3 - (n + 1) // 3 END AS a", "n"),
)
# quarters of 4 m + 1: rounding gives m to each, the one that is left over goes to the last; a slice keeps the order of its state
add(
    "state_split_proportional",
    states(lambda n: st.ordered_product([*st.split(st.State(4 * n + 1, "a", iter_order=-1), [1, 1, 1, 1])[3:], st.State(3, "b")], "root"), "a", "b"),
    span("3 * n + v % (n + 1) AS a, v // (n + 1) AS b", "3 * (n + 1)"),
)


def _synced(n: int) -> st.State:
    a, b, c = st.State(n, "a"), st.State(n - 2, "b"), st.State(2, "c")
    st.sync(a, b)
    return st.product([a, c], "root")


add("state_sync", states(_synced, "a", "b", "c"), span("v % n AS a, CASE WHEN v % n < n - 2 THEN v % n END AS b, v // n AS c", "2 * n"))


def _led(n: int) -> st.State:
    a = st.State(n, "a")
    st.synced_to(a, n - 2, "b")
    return st.repeat(a, 2, "root")


add("state_synced_to", states(_led, "a", "b"), span("v % n AS a, CASE WHEN v % n < n - 2 THEN v % n END AS b", "2 * n"))


def _by_seed(how: Callable[[random.Random], list[int]]) -> str:
    """SQL: the values that Python's generator gives for seed 5, for each part."""
    values = how(random.Random(5))
    return f"CAST({values}[v % {len(values)} + 1] AS BIGINT) AS a, v // {len(values)} AS p"


def _mixed(rng: random.Random) -> list[int]:
    values = list(range(300))
    rng.shuffle(values)
    return values


add("state_shuffle_seeded", states(for_each(lambda: st.shuffle(st.State(300, "a"), 5)), "a", "p"), span(_by_seed(_mixed), "300 * n"))
add("state_sample_seeded", states(for_each(lambda: st.sample(st.State(300, "a"), 80, 5)), "a", "p"), span(_by_seed(lambda r: r.choices(range(300), k=80)), "80 * n"))
add("state_sample_without", states(for_each(lambda: st.sample(st.State(300, "a"), 80, 5, with_replacement=False)), "a", "p"), span(_by_seed(lambda r: r.sample(range(300), 80)), "80 * n"))

# --- sources --------------------------------------------------------------------------------------------------------
add("from_seq", library(lambda s, d: sl.join([parts(s, d), sl.from_seq("ACGTACGT")])), per_row("s || 'ACGTACGT'"))
add("from_seqs", library(lambda s, d: sl.join([parts(s, d), sl.from_seqs(["AC", "GT", "TTT"], mode="sequential", num_states=7)])), per_row("s || ['AC', 'GT', 'TTT'][v % 3 + 1]", 7))
add("from_table", library(parts), per_row("s"))
_iupac = "substr('AG', v // 16 + 1, 1) || substr('ACGT', v // 4 % 4 + 1, 1) || '-' || substr('CT', v // 2 % 2 + 1, 1) || substr('AT', v % 2 + 1, 1)"
add("from_iupac", library(lambda s, d: sl.join([parts(s, d), sl.from_iupac("RN-YW", mode="sequential")])), per_row(f"s || {_iupac}", 32))
add(
    "get_kmers",
    library(lambda s, d: sl.join([parts(s, d), sl.get_kmers(4, mode="sequential")]), extra=(("get_kmers", "kmer_index", "kmer_index"),)),
    f"{D} SELECT k * 256 + v AS i, s || list_aggregate(list_transform(range(4), lambda j: substr('ACGT', (v // CAST(pow(4, 3 - j) AS BIGINT)) % 4 + 1, 1)), 'string_agg', '') AS seq, v AS kmer_index FROM d, range(256) AS r(v)",
)


def _fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three intervals of every part, read from FASTA files with lines of 20 bases."""
    from .sources.scratch import scratch_path
    from .sources.sources import fasta_intervals, fasta_pieces

    table = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("chrom"), F.expr(DNA).alias("seq"))
    path = scratch_path(spark, "genome")
    fasta_lines(table.select(F.concat("chrom", F.lit(" a part")).alias("name"), "seq"), None, 20).write.text(path)
    wanted = table.select("chrom", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(c).alias("strand")) for a, b, c in ((2, 9, "+"), (4, 20, "-"), (28, 6, "+"))])).alias("x")).select("chrom", "x.*")
    return fasta_intervals(fasta_pieces(spark, path), wanted).select("chrom", "start", "stop", "strand", "seq")


add(
    "from_fasta_intervals",
    _fasta,
    "WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS chrom, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part) "
    "SELECT chrom, 2 AS start, 9 AS stop, '+' AS strand, substr(s, 3, 7) AS seq FROM d UNION ALL SELECT chrom, 4, 20, '-', reverse(translate(substr(s, 5, 16), 'ACGT', 'TGCA')) FROM d UNION ALL SELECT chrom, 28, 6, '+', substr(s, 29, 4) || substr(s, 1, 6) FROM d",
)


# --- fixed operators ------------------------------------------------------------------------------------------------
GAPS = "concat(substring(s, 1, 5), '-', lower(substring(s, 7, 10)), '.', substring(s, 18, 15))"
GAPS_SQL = "(substr(s, 1, 5) || '-' || lower(substr(s, 7, 10)) || '.' || substr(s, 18, 15))"
TAGGED = "concat(substring(s, 1, 8), '<cre>', substring(s, 9, 16), '</cre>', substring(s, 25, 8), '<bc/>')"


def tagged(spark: SparkSession, sf_dir: str) -> Pool:
    pool = parts(spark, sf_dir, TAGGED, 32, ("cre", "bc"))
    for name, n in (("cre", 16), ("bc", 0)):
        pool.session.regions[name] = sl.Region(name, n)
    return pool


add("join", library(lambda s, d: sl.join([parts(s, d), sl.get_kmers(2, mode="sequential")], "--")), per_row("s || '--' || substr('ACGT', v // 4 + 1, 1) || substr('ACGT', v % 4 + 1, 1)", 16))
add("rc", library(lambda s, d: sl.rc(parts(s, d))), per_row("reverse(translate(s, 'ACGT', 'TGCA'))"))
add("upper", library(lambda s, d: sl.upper(parts(s, d, GAPS))), per_row(f"upper({GAPS_SQL})"))
add("lower", library(lambda s, d: sl.lower(parts(s, d))), per_row("lower(s)"))
add("swapcase", library(lambda s, d: sl.swapcase(parts(s, d, GAPS))), per_row(f"translate({GAPS_SQL}, 'ACGTacgt', 'acgtACGT')"))
add("slice_seq", library(lambda s, d: sl.slice_seq(parts(s, d), None, 3, 29, 4)), per_row("substr(s, 4, 1) || substr(s, 8, 1) || substr(s, 12, 1) || substr(s, 16, 1) || substr(s, 20, 1) || substr(s, 24, 1) || substr(s, 28, 1)"))
add("slice_seq_region", library(lambda s, d: sl.slice_seq(tagged(s, d), "cre", -10, None, 3, keep_context=True)), per_row("substr(s, 1, 8) || substr(s, 15, 1) || substr(s, 18, 1) || substr(s, 21, 1) || substr(s, 24, 1) || substr(s, 25, 8) || '<bc/>'"))
add("slice_seq_backwards", library(lambda s, d: sl.slice_seq(parts(s, d), None, -3, 20, -4)), per_row("substr(s, 30, 1) || substr(s, 26, 1) || substr(s, 22, 1)"))
add("clear_gaps", library(lambda s, d: sl.clear_gaps(parts(s, d, GAPS, None))), per_row(f"regexp_replace({GAPS_SQL}, '[^ACGTacgt]', '', 'g')"))
add("clear_annotation", library(lambda s, d: sl.clear_annotation(parts(s, d, GAPS, None))), per_row(f"upper(regexp_replace({GAPS_SQL}, '[^ACGTacgt]', '', 'g'))"))
add("fixed_operation", library(lambda s, d: sl.fixed_operation([parts(s, d), "TT"], lambda x: F.concat(x[1], F.reverse(x[0])))), per_row("'TT' || reverse(s)"))

# --- regions --------------------------------------------------------------------------------------------------------
T_SQL = "(substr(s, 1, 8) || '<cre>' || substr(s, 9, 16) || '</cre>' || substr(s, 25, 8) || '<bc/>')"
add("clear_tags", library(lambda s, d: tagged(s, d).clear_tags()), per_row(f"regexp_replace({T_SQL}, '</?\\w+\\s*/?>', '', 'g')"))
add("insert_tags", library(lambda s, d: parts(s, d).insert_tags("x", 4, 10)), per_row("substr(s, 1, 4) || '<x>' || substr(s, 5, 6) || '</x>' || substr(s, 11)"))
add("insert_tags_tagged", library(lambda s, d: tagged(s, d).insert_tags("x", 2, 6)), per_row("substr(s, 1, 2) || '<x>' || substr(s, 3, 4) || '</x>' || substr(s, 7, 2) || '<cre>' || substr(s, 9, 16) || '</cre>' || substr(s, 25, 8) || '<bc/>'"))
add("remove_tags", library(lambda s, d: tagged(s, d).remove_tags("cre")), per_row("s || '<bc/>'"))
add("remove_tags_content", library(lambda s, d: tagged(s, d).remove_tags("cre", keep_content=False)), per_row("substr(s, 1, 8) || substr(s, 25, 8) || '<bc/>'"))
add("extract_region", library(lambda s, d: tagged(s, d).extract_region("cre", rc=True)), per_row("reverse(translate(substr(s, 9, 16), 'ACGT', 'TGCA'))"))
add("replace_region", library(lambda s, d: tagged(s, d).replace_region(sl.get_kmers(2, mode="sequential"), "bc")), per_row("substr(s, 1, 8) || '<cre>' || substr(s, 9, 16) || '</cre>' || substr(s, 25, 8) || substr('ACGT', v // 4 + 1, 1) || substr('ACGT', v % 4 + 1, 1)", 16))
add("apply_at_region", library(lambda s, d: tagged(s, d).apply_at_region("cre", lambda p: p.lower(), remove_tags=False)), per_row("substr(s, 1, 8) || '<cre>' || lower(substr(s, 9, 16)) || '</cre>' || substr(s, 25, 8) || '<bc/>'"))
add("annotate_region", library(lambda s, d: parts(s, d).annotate_region("all")), per_row("'<all>' || s || '</all>'"))
add("insert_kmers", library(lambda s, d: tagged(s, d).insert_kmers(1, region="bc", mode="sequential")), per_row("substr(s, 1, 8) || '<cre>' || substr(s, 9, 16) || '</cre>' || substr(s, 25, 8) || '<bc>' || substr('ACGT', v + 1, 1) || '</bc>'", 4))
add(
    "region_scan",
    library(lambda s, d: parts(s, d).region_scan("w", region_length=5, mode="sequential"), extra=(("region_scan", "start", "w_start"), ("region_scan", "region_content", "w_content"))),
    f"{D} SELECT k * 28 + v AS i, substr(s, 1, v) || '<w>' || substr(s, v + 1, 5) || '</w>' || substr(s, v + 6) AS seq, v AS w_start, substr(s, v + 1, 5) AS w_content FROM d, range(28) AS r(v)",
)

# --- scans ----------------------------------------------------------------------------------------------------------
add("deletion_scan", library(lambda s, d: parts(s, d).deletion_scan(5, mode="sequential")), per_row("substr(s, 1, v) || '-----' || substr(s, v + 6)", 28))
add("deletion_scan_region", library(lambda s, d: tagged(s, d).deletion_scan(4, None, "cre", mode="sequential")), per_row("substr(s, 1, 8) || '<cre>' || substr(s, 9, v) || substr(s, v + 13, 12 - v) || '</cre>' || substr(s, 25, 8) || '<bc/>'", 13))
add("insertion_scan", library(lambda s, d: parts(s, d).insertion_scan(sl.from_seq("TTT"), mode="sequential")), per_row("substr(s, 1, v) || 'TTT' || substr(s, v + 1)", 33))
add("replacement_scan", library(lambda s, d: parts(s, d).replacement_scan("GATTACA", mode="sequential", positions=slice(0, None, 5))), per_row("substr(s, 1, v * 5) || 'GATTACA' || substr(s, v * 5 + 8)", 6))
add("subseq_scan", library(lambda s, d: parts(s, d).subseq_scan(12, mode="sequential")), per_row("substr(s, v + 1, 12)", 21))
add("mutagenize_scan", library(lambda s, d: parts(s, d).mutagenize_scan(3, num_mutations=1, mode="sequential", positions=[0, 10, 20])), per_row("substr(s, 1, w) || '<_mut>' || substr(substr(s, w + 1, 3), 1, m // 3) || substr(replace('ACGT', substr(s, w + 1 + m // 3, 1), ''), m % 3 + 1, 1) || substr(substr(s, w + 1, 3), m // 3 + 2) || '</_mut>' || substr(s, w + 4)", 27).replace("range(27) AS r(v)", "(SELECT v, v // 9 * 10 AS w, v % 9 AS m FROM range(27) AS q(v)) AS r"))

# --- substitutions --------------------------------------------------------------------------------------------------
ONE = "substr(s, 1, v // 3) || substr(replace('ACGT', substr(s, v // 3 + 1, 1), ''), v % 3 + 1, 1) || substr(s, v // 3 + 2)"
add("mutagenize_one", library(lambda s, d: parts(s, d).mutagenize(num_mutations=1, mode="sequential")), per_row(ONE, 96))
add(
    "mutagenize_two",
    library(lambda s, d: parts(s, d).mutagenize(region=(4, 12), num_mutations=2, mode="sequential"), extra=(("mutagenize", "positions", "positions"),)),
    f"{D}, p AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS r, a, b FROM range(8) AS x(a), range(8) AS y(b) WHERE a < b) "
    "SELECT k * 252 + r * 9 + m AS i, substr(s, 1, a + 4) || substr(replace('ACGT', substr(s, a + 5, 1), ''), m // 3 + 1, 1) || substr(s, a + 6, b - a - 1) || substr(replace('ACGT', substr(s, b + 5, 1), ''), m % 3 + 1, 1) || substr(s, b + 6) AS seq, "
    "[CAST(a AS INTEGER), CAST(b AS INTEGER)] AS positions FROM d, p, range(9) AS q(m)",
)
# too many rows for SQL; a test compares it with plain Python
add("mutagenize_two_whole", library(lambda s, d: parts(s, d).mutagenize(num_mutations=2, mode="sequential"), extra=(("mutagenize", "positions", "positions"),)))
add(
    "mutagenize_masked",
    library(lambda s, d: parts(s, d, "concat('A', s, 'CC')", 35).mutagenize(num_mutations=1, allowed_chars="R" + "N" * 32 + "CY", mode="sequential")),
    per_row("CASE WHEN v = 0 THEN 'G' || s || 'CC' WHEN v < 97 THEN 'A' || substr(s, 1, (v - 1) // 3) || substr(replace('ACGT', substr(s, (v - 1) // 3 + 1, 1), ''), (v - 1) % 3 + 1, 1) || substr(s, (v - 1) // 3 + 2) || 'CC' ELSE 'A' || s || 'CT' END", 98),
)
SOURCES = f"[s, '{'AC' * 16}', '{'GT' * 16}']"
add(
    "recombine",
    library(lambda s, d: sl.recombine(sources=[parts(s, d), "AC" * 16, "GT" * 16], num_breakpoints=1, mode="sequential"), extra=(("recombine", "breakpoints", "breakpoints"), ("recombine", "pool_assignments", "owners"))),
    f"{D}, o AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS r, a, b FROM range(3) AS x(a), range(3) AS y(b) WHERE a <> b) "
    f"SELECT k * 186 + p * 6 + r AS i, substr({SOURCES}[a + 1], 1, p + 1) || substr({SOURCES}[b + 1], p + 2) AS seq, [CAST(p AS INTEGER)] AS breakpoints, [CAST(a AS INTEGER), CAST(b AS INTEGER)] AS owners FROM d, range(31) AS q(p), o",
)

# --- states of pools ------------------------------------------------------------------------------------------------
_two = "substr('ACGT', v // 4 % 4 + 1, 1) || substr('ACGT', v % 4 + 1, 1)"
add(
    "stack",
    library(lambda s, d: sl.stack([sl.join([parts(s, d), sl.get_kmers(3, mode="sequential")]), sl.join([sl.from_iupac("NN", mode="sequential"), parts(s, d)])]), extra=(("stack", "active_parent", "branch"),)),
    f"{D}, n AS (SELECT count(*) AS n FROM d) SELECT k * 64 + v AS i, s || substr('ACGT', v // 16 + 1, 1) || {_two} AS seq, CAST(0 AS BIGINT) AS branch FROM d, range(64) AS r(v) UNION ALL SELECT n * 64 + v * n + k, {_two} || s, 1 FROM d, n, range(16) AS r(v)",
)
add("repeat", library(lambda s, d: parts(s, d).repeat(3), extra=(("repeat", "repeat_index", "copy"),)), f"{D} SELECT k * 3 + v AS i, s AS seq, v AS copy FROM d, range(3) AS r(v)")
add("state_slice", library(lambda s, d: parts(s, d)[5:150:7]), f"{D} SELECT CAST((k - 5) // 7 AS BIGINT) AS i, s AS seq FROM d WHERE k >= 5 AND k < 150 AND (k - 5) % 7 = 0")
add("sample", library(lambda s, d: parts(s, d).sample(seq_states=[i * 11 % 97 for i in range(200)])), f"{D} SELECT v AS i, s AS seq FROM range(200) AS r(v) JOIN d ON k = v * 11 % 97")
def _shuffled(spark: SparkSession, sf_dir: str) -> Pool:
    """All parts by an explicit permutation: multiples of the first number from 7 on that has no divisor in common with theirs."""
    pool = parts(spark, sf_dir)
    n = pool.num_states
    step = next(k for k in range(7, n + 8) if math.gcd(k, n) == 1)
    return pool.state_shuffle(permutation=spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * step % n).alias("value")))


add("state_shuffle", library(_shuffled), f"{D}, n AS (SELECT count(*) AS n FROM d), t AS (SELECT min(v) AS step, any_value(n) AS n FROM n, range(7, n + 8) AS r(v) WHERE gcd(v, n) = 1) SELECT CAST(v AS BIGINT) AS i, s AS seq FROM t, range(n) AS r(v) JOIN d ON k = v * step % n")


def _lockstep(spark: SparkSession, sf_dir: str) -> Pool:
    a = parts(spark, sf_dir)
    b = sl.join([sl.get_kmers(8, mode="sequential"), sl.get_kmers(8, mode="sequential")])[: a.num_states]
    sl.sync([a, b])
    return sl.join([a, b])


add("sync", library(_lockstep), per_row("s || list_aggregate(list_transform(range(16), lambda j: substr('ACGT', (k // CAST(pow(4, 15 - j) AS BIGINT)) % 4 + 1, 1)), 'string_agg', '')"))
GC_RICH = "length(regexp_replace(s, '[^GC]', '', 'g')) >= 16"
add(
    "materialize",
    library(lambda s, d: parts(s, d).filter_gc(0.5, 1.0).materialize(num_cycles=1, discard_null_seqs=True).repeat(2)),
    f"{D}, g AS (SELECT row_number() OVER (ORDER BY k) - 1 AS j, s FROM d WHERE {GC_RICH}) SELECT j * 2 + v AS i, s AS seq FROM g, range(2) AS r(v)",
)

# --- filters --------------------------------------------------------------------------------------------------------
GC = "length(regexp_replace(s, '[^GC]', '', 'g')) / 32.0"
add("filter_gc", library(lambda s, d: parts(s, d).filter_gc(0.4, 0.6)), per_row(f"CASE WHEN {GC} BETWEEN 0.4 AND 0.6 THEN s END"))
add("filter_homopolymer", library(lambda s, d: parts(s, d).filter_homopolymer(3)), per_row("CASE WHEN NOT regexp_matches(s, 'A{4}|C{4}|G{4}|T{4}') THEN s END"))
add("filter_complexity", library(lambda s, d: parts(s, d).filter_complexity(0.9)), per_row("CASE WHEN (len(list_distinct(list_transform(range(1, 33), lambda j: substr(s, j, 1)))) / 4.0 + len(list_distinct(list_transform(range(1, 32), lambda j: substr(s, j, 2)))) / 16.0 + len(list_distinct(list_transform(range(1, 31), lambda j: substr(s, j, 3)))) / 30.0) / 3.0 >= 0.9 THEN s END"))
add("filter_dust", library(lambda s, d: parts(s, d).filter_dust(0.4)), f"{D}, t AS (SELECT k, u.t, count(*) AS c FROM d, unnest(list_transform(range(1, 31), lambda j: substr(s, j, 3))) AS u(t) GROUP BY k, u.t), x AS (SELECT k, sum(c * (c - 1) / 2.0) / 30.0 AS dust FROM t GROUP BY k) SELECT k AS i, CASE WHEN dust <= 0.4 THEN s END AS seq FROM d JOIN x USING (k)")
add("filter_restriction_sites", library(lambda s, d: parts(s, d).filter_restriction_sites("frequent_cutters", ["GGWCC"])), per_row("CASE WHEN NOT regexp_matches(s, 'GATC|AGCT|GGCC|GCGC|CCGG|TCGA|GTAC|CTAG|CATG|TTAA|GG[AT]CC') THEN s END"))
add("filter_callable", library(lambda s, d: parts(s, d).filter(lambda x: x.count("A") > x.count("C"))), per_row("CASE WHEN length(replace(s, 'A', '')) < length(replace(s, 'C', '')) THEN s END"))
def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Session():
        pool = parts(spark, sf_dir).filter_gc(0.5, 1.0)
        df = sl.generate_library(pool, num_seqs=pool.num_states // 3, discard_null_seqs=True, with_index=True, spark=spark, init_state=0)
        return df.select(F.col("_row").alias("i"), "seq")


# a third of the parts are asked for; more than that pass, so where to stop is what is tested
add("discard_null_seqs", _kept, f"{D}, g AS (SELECT k, s, row_number() OVER (ORDER BY k) AS j FROM d WHERE {GC_RICH}) SELECT k AS i, s AS seq FROM g WHERE j <= (SELECT count(*) // 3 FROM d)")


def _stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Less than nine tenths of the first hundred parts pass, the rate that is asked for, so no more are tried."""
    with Session(), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        pool = parts(spark, sf_dir).filter_gc(0.5, 1.0)
        df = sl.generate_library(pool, num_seqs=pool.num_states, discard_null_seqs=True, min_acceptance_rate=0.9, with_index=True, spark=spark, init_state=0)
        return df.select(F.col("_row").alias("i"), "seq")


add("acceptance_rate", _stopped, f"{D} SELECT k AS i, s AS seq FROM d WHERE k < 100 AND {GC_RICH}")


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("s")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(DNA).alias("s"))
    return rows.select("p_partkey", F.round(sl.calc_gc(seq), 6).alias("gc"), F.round(sl.calc_complexity(seq), 6).alias("complexity"), F.round(sl.calc_dust(seq), 6).alias("dust"), sl.has_homopolymer(seq, 3).alias("run"), sl.has_restriction_site(seq, ["GAATTC", "CCWGG"]).alias("site"))


add(
    "seq_measures",
    _measures,
    "WITH d AS (SELECT p_partkey, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part), "
    "t AS (SELECT p_partkey, u.t, count(*) AS c FROM d, unnest(list_transform(range(1, 31), lambda j: substr(s, j, 3))) AS u(t) GROUP BY ALL), x AS (SELECT p_partkey, sum(c * (c - 1) / 2.0) / 30.0 AS dust FROM t GROUP BY ALL) "
    "SELECT p_partkey, round(CAST(length(regexp_replace(s, '[^GC]', '', 'g')) AS DOUBLE) / 32, 6) AS gc, "
    "round((CAST(len(list_distinct(list_transform(range(1, 33), lambda j: substr(s, j, 1)))) AS DOUBLE) / 4 + CAST(len(list_distinct(list_transform(range(1, 32), lambda j: substr(s, j, 2)))) AS DOUBLE) / 16 + CAST(len(list_distinct(list_transform(range(1, 31), lambda j: substr(s, j, 3)))) AS DOUBLE) / 30) / 3, 6) AS complexity, "
    "round(CAST(dust AS DOUBLE), 6) AS dust, regexp_matches(s, 'A{4}|C{4}|G{4}|T{4}') AS run, regexp_matches(s, 'GAATTC|CC[AT]GG') AS site FROM d JOIN x USING (p_partkey)",
)

# --- reading frames -------------------------------------------------------------------------------------------------
ORF = "concat('ATG', substring(s, 1, 24), 'TAA')"
ORF_SQL = "('ATG' || substr(s, 1, 24) || 'TAA')"
_code = CodonTable()
#: The residues of all codons in the order of A, C, G, T.
RESIDUES = "".join(_code.codon_to_aa[a + b + c] for a in "ACGT" for b in "ACGT" for c in "ACGT")


def codon_number(seq: str, at: str) -> str:
    return " + ".join(f"(strpos('ACGT', substr({seq}, {at} + {j}, 1)) - 1) * {4 ** (2 - j)}" for j in range(3))


def translated(seq: str, n: int, off: int = 1) -> str:
    return f"list_aggregate(list_transform(range({n}), lambda j: substr('{RESIDUES}', {codon_number(seq, f'(j * 3 + {off})')} + 1, 1)), 'string_agg', '')"


add("translate", library(lambda s, d: parts(s, d, ORF, 30).translate()), per_row(translated(ORF_SQL, 10)))
add("translate_frame_2", library(lambda s, d: parts(s, d, ORF, 30).translate(frame=-2, include_stop=False)), per_row(f"replace({translated(f'reverse(translate({ORF_SQL}, $$ACGT$$, $$TGCA$$))', 9, 2)}, '*', '')"))
FIRST = {a: c[0] for a, c in _code.aa_to_codons.items()}


def _case(x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in FIRST.items()) + " END"


add("reverse_translate", library(lambda s, d: parts(s, d, ORF, 30).translate().reverse_translate()), per_row(f"list_aggregate(list_transform(string_split({translated(ORF_SQL, 10)}, ''), lambda a: {_case('a')}), 'string_agg', '')"))
add(
    "mutagenize_orf",
    library(lambda s, d: parts(s, d, ORF, 30).mutagenize_orf(num_mutations=1, mutation_type="nonsense", codon_positions=slice(1, 4), mode="sequential").filter(lambda x: F.length(x) == 30, native=True)),
    per_row("CASE WHEN instr('TGA TAA TAG', substr(s, c * 3 + 1, 3)) > 0 THEN 'ATG' || substr(s, 1, 24) || 'TAA' ELSE 'ATG' || substr(s, 1, c * 3) || ['TGA', 'TAA', 'TAG'][m + 1] || substr(s, c * 3 + 4, 21 - c * 3) || 'TAA' END", 9).replace("range(9) AS r(v)", "(SELECT v, v // 3 AS c, v % 3 AS m FROM range(9) AS q(v)) AS r"),
)
add("annotate_orf", library(lambda s, d: parts(s, d).annotate_orf("orf", (2, 29), frame=1)), per_row("substr(s, 1, 2) || '<orf>' || substr(s, 3, 27) || '</orf>' || substr(s, 30)"))


# --- names, cards and sinks -----------------------------------------------------------------------------------------
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Session():
        pool = sl.join([parts(spark, sf_dir), sl.from_seqs(["A", "C", "G"] * 4, mode="sequential", prefix="src"), sl.get_kmers(2, mode="sequential", prefix="bc")]).add_prefix("lib")
        return sl.generate_library(pool, spark=spark, init_state=0)


add("names", _names, f"{D} SELECT 'src_' || lpad(CAST(v // 16 AS VARCHAR), 2, '0') || '.bc_' || lpad(CAST(v % 16 AS VARCHAR), 2, '0') || '.lib' AS name, s || substr('ACG', v // 16 % 3 + 1, 1) || substr('ACGT', v // 4 % 4 + 1, 1) || substr('ACGT', v % 4 + 1, 1) AS seq FROM d, range(192) AS r(v)")


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Session():
        pool = passthrough(parts(spark, sf_dir), lambda run, state: [F.concat(F.lit("row"), run.row.cast("string")), F.lit("x")])
        return sl.generate_library(pool, spark=spark, init_state=0)


add("passthrough", _titled, f"{D} SELECT 'row' || CAST(k AS VARCHAR) || '.x' AS name, s AS seq FROM d")


def _fasta_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Session():
        pool = sl.join([parts(spark, sf_dir), parts(spark, sf_dir)[0]]).add_prefix("p")
        return fasta_lines(sl.to_df(pool, num_cycles=1, spark=spark), "n={name}", 20)


add("to_fasta", _fasta_out, f"{D}, x AS (SELECT s || (SELECT s FROM d WHERE k = 0) AS q FROM d) SELECT '>p n=p' || chr(10) || substr(q, 1, 20) || chr(10) || substr(q, 21, 20) || chr(10) || substr(q, 41, 20) || chr(10) || substr(q, 61) AS value FROM x")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Session():
        return fasta_lines(sl.to_df(parts(spark, sf_dir).add_prefix("p"), num_cycles=1, spark=spark), lambda row: f"{row['seq'].count('A')} of {len(row['seq'])}", None)


add("to_fasta_described", _described, f"{D} SELECT '>p ' || CAST(32 - length(replace(s, 'A', '')) AS VARCHAR) || ' of 32' || chr(10) || s AS value FROM d")


def _formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Session():
        pool = parts(spark, sf_dir).repeat(3, prefix="copy")
        made = sl.to_df(pool, num_cycles=1, include_design_cards=True, spark=spark)
        index = next(c for c in made.columns if c.endswith("key.repeat_index"))
        return fasta_lines(made.select("name", "seq", F.col(f"`{index}`").alias("copy")), "{copy:+04d} {copy:.1%} {seq:_^12.8} {{{name!s:>8}}}", None)


add(
    "to_fasta_formatted",
    _formatted,
    f"{D} SELECT '>copy_' || v || ' +00' || v || ' ' || CASE WHEN v = 0 THEN '' ELSE v || '0' END || '0.0% __' || substr(s, 1, 8) || '__ {{  copy_' || v || '}}' || chr(10) || s AS value FROM d, range(3) AS r(v)",
)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of file written and read back: what is in it, by kind. The files are removed at the end of the session."""
    from .sources.scratch import scratch_path

    with Session():
        pool = parts(spark, sf_dir).add_prefix("p")
        out = None
        for kind in ("csv", "tsv", "jsonl", "parquet", "fasta"):
            path = scratch_path(spark, f"sink-{kind}")
            pool.to_file(path, kind, num_cycles=1, spark=spark)
            if kind == "fasta":
                back = spark.read.text(path).select(F.lit(None).cast("string").alias("name"), F.col("value").alias("seq"))
            elif kind in ("jsonl", "parquet"):
                back = (spark.read.json if kind == "jsonl" else spark.read.parquet)(path).select("name", "seq")
            else:
                back = spark.read.csv(path, sep="," if kind == "csv" else "\t", header=True).select("name", "seq")
            back = back.select(F.lit(kind).alias("kind"), "name", "seq")
            out = back if out is None else out.unionByName(back)
    return out


add(
    "to_file",
    _round_trip,
    f"{D} SELECT kind, 'p' AS name, s AS seq FROM d, (VALUES ('csv'), ('tsv'), ('jsonl'), ('parquet')) AS t(kind) UNION ALL SELECT 'fasta', NULL, x FROM d, unnest(['>p', s]) AS u(x)",
)


# --- random operators: SQL draws the same numbers -------------------------------------------------------------------
# The primes of 64-bit xxHash.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WORD = 1 << 64
SEED = 11


def _rounds(h, x, mul: Callable, add_: Callable, rotate: Callable, xor: Callable) -> list:
    """The steps of xxHash of one long x with seed h; each refers to the one before it by the name it is given."""
    return [
        ("a", lambda v: mul(x, P2)),
        ("b", lambda v: rotate(v["a"], 31)),
        ("c", lambda v: xor(add_(h, P5 + 8), mul(v["b"], P1))),
        ("d", lambda v: rotate(v["c"], 27)),
        ("e", lambda v: add_(mul(v["d"], P1), P4)),
        ("f", lambda v: mul(xor(v["e"], v["e"], 33), P2)),
        ("g", lambda v: mul(xor(v["f"], v["f"], 29), P3)),
        ("h", lambda v: xor(v["g"], v["g"], 32)),
    ]


def xx64(h: int, *values: int) -> int:
    for x in values:
        made: dict[str, int] = {}
        for name, step in _rounds(h, x % WORD, lambda p, q: p * q % WORD, lambda p, q: (p + q) % WORD, lambda p, r: (p << r | p >> 64 - r) % WORD, lambda p, q, r=0: p ^ q >> r):
            made[name] = step(made)
        h = made["h"]
    return h


def _hashed(rows: str, name: str, h: int | str, x: str) -> str:
    """SQL: rows with a column of the xxHash of a long with a seed. Each step is a query of its own, so none is computed twice."""
    made = {n: f"{name}_{n}" for n in "abcdefgh"}
    operations = (
        lambda p, q: f"CAST((CAST({p} AS UHUGEINT) * {q}) % {WORD} AS UBIGINT)",
        lambda p, q: f"CAST((CAST({p} AS UHUGEINT) + {q}) % {WORD} AS UBIGINT)",
        lambda p, r: f"(CAST((CAST({p} AS UHUGEINT) * {1 << r}) % {WORD} AS UBIGINT) | ({p} >> {64 - r}))",
        lambda p, q, r=0: f"xor({p}, {q} >> {r})" if r else f"xor({p}, {q})",
    )
    for n, step in _rounds(h, f"CAST({x} AS UBIGINT)", *operations):
        rows = f"SELECT *, {step(made)} AS {name if n == 'h' else made[n]} FROM ({rows})"
    return f"SELECT * EXCLUDE ({', '.join(v for n, v in made.items() if n != 'h')}) FROM ({rows})"


def drawn(rows: str, n: int | str, op: int, *streams: int, state: str = "i") -> str:
    """SQL: rows (with i, the row index) for every j below n, with a random 64-bit number u0, u1, ... of each stream."""
    for t in streams:
        rows = _hashed(_hashed(rows, f"y{t}", xx64(42, SEED, op), state), f"z{t}", f"y{t}", str(t))
    rows = f"SELECT * FROM ({rows}), range({n}) AS n(j)"
    for t in streams:
        rows = _hashed(rows, f"x{t}", 42, f"z{t}")
        rows = _hashed(rows, f"u{t}", f"x{t}", "j")
    return rows


def below(n: int | str, stream: int = 0) -> str:
    return f"CAST((u{stream} >> 2) % {n} AS BIGINT)"


#: Places in random order: by a number's bits as a signed one, all but the last 24, then by place.
ORDER = f"xor(u0, CAST({1 << 63} AS UBIGINT)) >> 24, j"
PARTS = f"SELECT k AS i, s FROM ({D} SELECT * FROM d)"


def chosen(rows: str, n: int | str, op: int, k: int, *streams: int) -> str:
    """SQL of drawn with picked, whether j is among the k places drawn of n."""
    return f"SELECT *, row_number() OVER (PARTITION BY i ORDER BY {ORDER}) <= {k} AS picked FROM ({drawn(rows, n, op, 0, *streams)})"


def randomly(build: Callable[[SparkSession, str], Pool], extra: tuple = (), each: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """``each``: a pool without states of its own is drawn from once for each part."""
    if not each:
        return library(build, extra, seed=SEED)
    return lambda spark, sf_dir: library(build, extra, seed=SEED, num_seqs=spark.read.parquet(f"{sf_dir}/part.parquet").count())(spark, sf_dir)


MUTATED = f"substr(replace('ACGT', substr(s, j + 1, 1), ''), {below(3, 1)} + 1, 1)"


def mutated(rows: str) -> str:
    return f"SELECT i, string_agg(CASE WHEN picked THEN {MUTATED} ELSE substr(s, j + 1, 1) END, '' ORDER BY j) AS seq, coalesce(list(CAST(j AS INTEGER) ORDER BY j) FILTER (picked), []) AS positions FROM ({rows}) GROUP BY i"


add("mutagenize_random", randomly(lambda s, d: parts(s, d).mutagenize(num_mutations=3), (("mutagenize", "positions", "positions"),)), mutated(chosen(PARTS, 32, 1, 3, 1)))
add("mutagenize_rate", randomly(lambda s, d: parts(s, d).mutagenize(mutation_rate=0.125), (("mutagenize", "positions", "positions"),)), mutated(f"SELECT *, u0 >> 2 < {1 << 59} AS picked FROM ({drawn(PARTS, 32, 1, 0, 1)})"))
add(
    "shuffle_seq",
    randomly(lambda s, d: parts(s, d).shuffle_seq(), (("shuffle_seq", "permutation", "permutation"),)),
    f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY {ORDER}) - 1 AS r FROM ({drawn(PARTS, 32, 1, 0)})) SELECT i, string_agg(substr(s, j + 1, 1), '' ORDER BY r) AS seq, list(CAST(r AS INTEGER) ORDER BY j) AS permutation FROM o GROUP BY i",
)
MOTIF = {"A": [0.5, 0.0, 1.0, 0.25, 0.25], "C": [0.0, 0.0, 0.0, 0.25, 0.0], "G": [0.5, 0.25, 0.0, 0.25, 0.75], "T": [0.0, 0.75, 0.0, 0.25, 0.0]}
_below_bound = " + ".join(f"CAST(u0 >> 2 >= [{', '.join(str(int(sum(MOTIF[b][i] for b in 'ACGT'[: c + 1]) * (1 << 62))) for i in range(5))}][j + 1] AS INTEGER)" for c in range(3))
add("from_motif", randomly(lambda s, d: sl.from_motif(MOTIF), each=True), f"SELECT i, string_agg(substr('ACGT', {_below_bound} + 1, 1), '' ORDER BY j) AS seq FROM ({drawn(f'SELECT i FROM ({PARTS})', 5, 0, 0)}) GROUP BY i")
add(
    "get_kmers_random",
    randomly(lambda s, d: sl.get_kmers(40), each=True),
    f"SELECT i, string_agg(list_aggregate(list_transform(range(m), lambda x: substr('ACGT', CAST((w >> CAST(2 * (m - 1 - x) AS UBIGINT)) & 3 AS BIGINT) + 1, 1)), 'string_agg', ''), '' ORDER BY j) AS seq FROM (SELECT i, j, CASE WHEN j = 0 THEN 31 ELSE 9 END AS m, (u0 >> 2) % CAST(CASE WHEN j = 0 THEN {4**31} ELSE {4**9} END AS UBIGINT) AS w FROM ({drawn(f'SELECT i FROM ({PARTS})', 2, 0, 0)})) GROUP BY i",
)
add(
    "from_iupac_random",
    randomly(lambda s, d: sl.from_iupac("RN-YW"), (("from_iupac", "iupac_state", "iupac_state"),), each=True),
    f"SELECT i, substr('AG', v // 16 + 1, 1) || substr('ACGT', v // 4 % 4 + 1, 1) || '-' || substr('CT', v // 2 % 2 + 1, 1) || substr('AT', v % 2 + 1, 1) AS seq, v AS iupac_state FROM (SELECT i, {below(32)} AS v FROM ({drawn(f'SELECT i FROM ({PARTS})', 1, 0, 0)}))",
)
# two places out of 31, then three owners, each but the first another one than the last
_owners = f"SELECT i, any_value(s) AS s, any_value({below(3, 1)}) FILTER (j = 0) AS a, any_value({below(2, 1)}) FILTER (j = 1) AS x, any_value({below(2, 1)}) FILTER (j = 2) AS y, list(j ORDER BY j) FILTER (picked) AS p FROM ({chosen(PARTS, 31, 3, 2, 1)}) GROUP BY i"
_owners = f"SELECT *, y + CAST(y >= b AS BIGINT) AS c FROM (SELECT *, x + CAST(x >= a AS BIGINT) AS b FROM ({_owners}))"
add(
    "recombine_random",
    randomly(lambda s, d: sl.recombine(sources=[parts(s, d), "AC" * 16, "GT" * 16], num_breakpoints=2), (("recombine", "breakpoints", "breakpoints"), ("recombine", "pool_assignments", "owners"))),
    f"SELECT i, substr({SOURCES}[a + 1], 1, p[1] + 1) || substr({SOURCES}[b + 1], p[1] + 2, p[2] - p[1]) || substr({SOURCES}[c + 1], p[2] + 2) AS seq, list_transform(p, lambda v: CAST(v AS INTEGER)) AS breakpoints, [CAST(a AS INTEGER), CAST(b AS INTEGER), CAST(c AS INTEGER)] AS owners FROM ({_owners})",
)
# every window of six of every part, its bases in the order of the row's draws
add(
    "shuffle_scan",
    randomly(lambda s, d: parts(s, d).shuffle_scan(6, mode="sequential")),
    f"SELECT i, substr(any_value(s), 1, any_value(v)) || string_agg(substr(s, v + j + 1, 1), '' ORDER BY {ORDER}) || substr(any_value(s), any_value(v) + 7) AS seq FROM ({drawn(f'SELECT k * 27 + v AS i, s, v FROM ({D} SELECT * FROM d), range(27) AS r(v)', 6, 2, 0)}) GROUP BY i",
)
add("region_scan_random", randomly(lambda s, d: parts(s, d).region_scan("w", region_length=5)), f"SELECT i, substr(s, 1, v) || '<w>' || substr(s, v + 1, 5) || '</w>' || substr(s, v + 6) AS seq FROM (SELECT i, s, {below(28)} AS v FROM ({drawn(PARTS, 1, 1, 0)}))")


def several(op: int, width: int, k: int, *pieces: str) -> str:
    """SQL: k places p of windows that do not overlap: k out of the places that there are with each window counted as one."""
    places = f"SELECT i, any_value(s) AS s, list_transform(list(j ORDER BY j) FILTER (picked), lambda v, t: v + (t - 1) * {max(0, width - 1)}) AS p FROM ({chosen(PARTS, 32 - k * width + k if width else 33, op, k)}) GROUP BY i"
    return f"SELECT i, {' || '.join(pieces)} AS seq FROM ({places})"


add("region_multiscan", randomly(lambda s, d: parts(s, d).region_multiscan(["u", "v"], 2, region_length=4)), several(1, 4, 2, "substr(s, 1, p[1]) || '<u>' || substr(s, p[1] + 1, 4) || '</u>'", "substr(s, p[1] + 5, p[2] - p[1] - 4) || '<v>' || substr(s, p[2] + 1, 4) || '</v>'", "substr(s, p[2] + 5)"))
add("deletion_multiscan", randomly(lambda s, d: parts(s, d).deletion_multiscan(3, 2)), several(3, 3, 2, "substr(s, 1, p[1]) || '---'", "substr(s, p[1] + 4, p[2] - p[1] - 3) || '---'", "substr(s, p[2] + 4)"))
add("insertion_multiscan", randomly(lambda s, d: parts(s, d).insertion_multiscan(3, ["x", "yy", "z"])), several(4, 0, 3, "substr(s, 1, p[1]) || 'x'", "substr(s, p[1] + 1, p[2] - p[1]) || 'yy'", "substr(s, p[2] + 1, p[3] - p[2]) || 'z'", "substr(s, p[3] + 1)"))
add("replacement_multiscan", randomly(lambda s, d: parts(s, d).replacement_multiscan(2, "nnnn")), several(3, 4, 2, "substr(s, 1, p[1]) || 'nnnn'", "substr(s, p[1] + 5, p[2] - p[1] - 4) || 'nnnn'", "substr(s, p[2] + 5)"))


def alternatives(kind: str) -> str:
    """SQL: what each codon may become by a mutation type, from the genetic code."""
    table = {}
    for own, codons in _code.aa_to_codons.items():
        for c in codons:
            match kind:
                case "any_codon":
                    table[c] = [x for x in _code.all_codons if x != c]
                case "synonymous":
                    table[c] = [x for x in codons if x != c]
                case "nonsense":
                    table[c] = [] if own == "*" else _code.aa_to_codons["*"]
                case _:
                    others = [xs for a, xs in _code.aa_to_codons.items() if a != own and not (a == "*" and kind.startswith("missense"))]
                    table[c] = [x for xs in others for x in (xs[:1] if kind.endswith("first") else xs)]
    listed = ", ".join(f"('{c}', '{' '.join(xs)}')" for c, xs in table.items())
    return f"(VALUES {listed}) AS m(codon, alts)"


def codons_changed(rows: str, kind: str, frame: int, n: int) -> str:
    """SQL: the sequence with the picked codons j replaced, read in a frame (the bases left out come first, or last in reverse)."""
    skip = (4 - abs(frame)) % 3
    at = f"{32 - skip} - (j + 1) * 3" if frame < 0 else f"j * 3 + {skip}"
    turned = (lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))") if frame < 0 else (lambda x: x)
    wt = f"SELECT *, {at} AS spot, {turned(f'substr(s, {at} + 1, 3)')} AS wt FROM ({rows})"
    new = f"SELECT *, CASE WHEN picked AND alts <> '' THEN {turned(f'string_split(alts, $$ $$)[CAST((u1 >> 2) % len(string_split(alts, $$ $$)) AS BIGINT) + 1]')} ELSE substr(s, spot + 1, 3) END AS new FROM ({wt}) AS w JOIN {alternatives(kind)} ON wt = codon"
    edge = f"substr(any_value(s), 1, {skip if frame > 0 else 32 - skip - 3 * n}) || string_agg(new, '' ORDER BY spot) || substr(any_value(s), {3 * n + skip + 1 if frame > 0 else 33 - skip})"
    return f"SELECT i, {edge} AS seq FROM ({new}) GROUP BY i"


for _kind, _how, _frame in (("any_codon", "rate", 1), ("nonsynonymous_first", 2, 2), ("missense_only_first", 3, -3), ("nonsense", 1, 3), ("synonymous", 4, -1), ("nonsynonymous_random", "rate", -2), ("missense_only_random", 2, 1)):
    _n = (32 - (4 - abs(_frame)) % 3) // 3
    _options = {"mutation_rate": 0.25} if _how == "rate" else {"num_mutations": _how}
    _rows = f"SELECT *, u0 >> 2 < {1 << 60} AS picked FROM ({drawn(PARTS, _n, 1, 0, 1)})" if _how == "rate" else chosen(PARTS, _n, 1, _how, 1)
    add(f"mutagenize_orf_{_kind}", randomly(lambda s, d, kind=_kind, frame=_frame, options=_options: parts(s, d).mutagenize_orf(mutation_type=kind, frame=frame, **options)), codons_changed(_rows, _kind, _frame, _n))

_residues = f"SELECT i, j, u0, substr(t, j + 1, 1) AS a FROM ({drawn(f'SELECT k AS i, {translated(ORF_SQL, 10)} AS t FROM ({D} SELECT * FROM d)', 10, 2, 0)})"
_codons = ", ".join(f"('{a}', '{' '.join(c)}')" for a, c in _code.aa_to_codons.items())
add(
    "reverse_translate_random",
    randomly(lambda s, d: parts(s, d, ORF, 30).translate().reverse_translate(codon_selection="random")),
    f"SELECT i, string_agg(string_split(codons, ' ')[CAST((u0 >> 2) % len(string_split(codons, ' ')) AS BIGINT) + 1], '' ORDER BY j) AS seq FROM ({_residues}) AS r JOIN (VALUES {_codons}) AS c(b, codons) ON a = b GROUP BY i",
)


add("from_seqs_random", randomly(lambda s, d: sl.from_seqs(["AC", "GT", "TTT", "A"]), (("from_seqs", "seq_index", "seq_index"),), each=True), f"SELECT i, ['AC', 'GT', 'TTT', 'A'][v + 1] AS seq, v AS seq_index FROM (SELECT i, {below(4)} AS v FROM ({drawn(f'SELECT i FROM ({PARTS})', 1, 0, 0)}))")

# permutations and samples that are computed for each index
_keys = [(h, h - (WORD if h >> 63 else 0)) for h in (xx64(42, 5, r) for r in range(st.ROUNDS))]
_round = _hashed("SELECT v, w.x, w.r, keys.h, CASE WHEN keys.k >= w.x THEN keys.k - w.x ELSE keys.k - w.x + keys.n END AS y, greatest(w.x, CASE WHEN keys.k >= w.x THEN keys.k - w.x ELSE keys.k - w.x + keys.n END) AS m FROM w JOIN keys ON w.r = keys.r", "u", "h", "m")
_n = "(SELECT count(*) * 64 AS n FROM part)"
_values = ", ".join(f"({r}, CAST({h} AS UBIGINT), CAST({signed} AS BIGINT))" for r, (h, signed) in enumerate(_keys))
PERMUTED = f"WITH RECURSIVE keys AS (SELECT r, h, (s % n + n) % n AS k, n FROM (VALUES {_values}) AS t(r, h, s), {_n}), w AS (SELECT v, v AS x, 0 AS r FROM {_n}, range(n) AS q(v) UNION ALL SELECT v, CASE WHEN u & 1 = 1 THEN y ELSE x END, r + 1 FROM ({_round}))"
add(
    "state_shuffle_computed",
    library(lambda s, d: sl.join([parts(s, d), sl.get_kmers(3, mode="sequential")]).state_shuffle(seed=5)),
    f"{PERMUTED} SELECT v AS i, s || substr('ACGT', x % 64 // 16 + 1, 1) || substr('ACGT', x % 16 // 4 + 1, 1) || substr('ACGT', x % 4 + 1, 1) AS seq FROM w JOIN ({D} SELECT * FROM d) ON k = x // 64 WHERE r = {st.ROUNDS}",
)
_drawn = _hashed(f"SELECT k * 16 + q AS v FROM ({D} SELECT * FROM d), range(16) AS q(q)", "u", xx64(42, 5), "v")
_signed = f"(CASE WHEN u >= CAST({1 << 63} AS UBIGINT) THEN CAST(CAST(u AS HUGEINT) - {WORD} AS BIGINT) ELSE CAST(u AS BIGINT) END)"
add(
    "state_sample_computed",
    library(lambda s, d: (p := parts(s, d)).sample(16 * p.num_states, seed=5)),
    f"{D}, x AS (SELECT v, (({_signed} >> 1) % n + n) % n AS x FROM ({_drawn}), (SELECT count(*) AS n FROM part)) SELECT v AS i, s AS seq FROM x JOIN d ON k = x",
)


# --- more states than a long holds ----------------------------------------------------------------------------------
FAR, STRIDE, BEHIND = 10**20, 10**21 + 7, 4**36
_places = "[" + ", ".join(f"{4**j}::HUGEINT" for j in reversed(range(36))) + "]"
add(
    "state_slice_wide",
    library(lambda s, d: sl.join([parts(s, d), *[sl.get_kmers(9, mode="sequential") for _ in range(4)]])[FAR::STRIDE]),
    f"{D}, t AS (SELECT unnest(range(CAST(((SELECT count(*) FROM d)::HUGEINT * {BEHIND} - {FAR} + {STRIDE} - 1) // {STRIDE} AS BIGINT))) AS i), x AS (SELECT i, {FAR} + i::HUGEINT * {STRIDE} AS x FROM t) "
    f"SELECT i, s || array_to_string(list_transform({_places}, lambda p: substr('ACGT', CAST(x % {BEHIND} // p % 4 AS BIGINT) + 1, 1)), '') AS seq FROM x JOIN d ON d.k = x // {BEHIND}",
)


# --- styles ---------------------------------------------------------------------------------------------------------
def styled(build: Callable[[SparkSession, str], Pool], **options) -> Callable[[SparkSession, str], DataFrame]:
    """A query: i, seq, and in ``looks`` each style with the places of its characters: red:0,1;blue:5."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Session():
            df = sl.generate_library(build(spark, sf_dir), report_styles=True, with_index=True, spark=spark, init_state=0, **options)
            looks = F.array_join(F.transform("styles", lambda x: F.concat(x["spec"], F.lit(":"), F.array_join(x["positions"].cast("array<string>"), ","))), ";")
            return df.select(F.col("_row").alias("i"), "seq", looks.alias("looks"))

    return query


def looks(*layers: tuple[str, str]) -> str:
    """SQL of ``looks``: each style with a list of places; empty ones are left out."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN len({at}) > 0 THEN '{spec}:' || array_to_string({at}, ',') END" for spec, at in layers) + "], lambda x: x IS NOT NULL), ';') AS looks"


def styled_rows(expression: str, shown: str, n: int = 1) -> str:
    return per_row(f"{expression} AS seq, {shown}", n).replace(" AS seq FROM d", " FROM d")


def places(test: str, n: str = "32", of: str = "p") -> str:
    return f"list_transform(list_filter(range({n}), lambda p: {test}), lambda p: {of})"


CG = "substr(s, p + 1, 2) = 'CG' OR p > 0 AND substr(s, p, 2) = 'CG'"
add(
    "styled_mutagenize",
    styled(lambda s, d: parts(s, d).stylize([0, 8], style="bold").mutagenize(num_mutations=1, style="red", mode="sequential")),
    styled_rows(ONE, looks(("bold", "range(8)"), ("red", "[v // 3]")), 96),
)
add(
    "styled_deletion_scan",
    styled(lambda s, d: parts(s, d).stylize(regex="CG", style="blue").deletion_scan(5, mode="sequential", style="cyan")),
    styled_rows("substr(s, 1, v) || '-----' || substr(s, v + 6)", looks(("blue", places(f"({CG}) AND (p < v OR p > v + 4)")), ("cyan", "range(v, v + 5)")), 28),
)
add(
    "styled_insertion_scan",
    styled(lambda s, d: parts(s, d).stylize(regex="CG", style="blue").insertion_scan(sl.from_seq("TTT", style="bold"), mode="sequential", style="red")),
    styled_rows("substr(s, 1, v) || 'TTT' || substr(s, v + 1)", looks(("blue", places(CG, of="CASE WHEN p < v THEN p ELSE p + 3 END")), ("bold", "range(v, v + 3)"), ("red", "range(v, v + 3)")), 33),
)
add(
    "styled_join",
    styled(lambda s, d: sl.join([parts(s, d).stylize(regex="A", style="green").rc(), sl.from_seq("GG", style="on_blue")], "--")),
    styled_rows("reverse(translate(s, 'ACGT', 'TGCA')) || '--GG'", looks(("green", places("substr(s, 32 - p, 1) = 'A'")), ("on_blue", "[34, 35]"))),
)
add(
    "styled_region",
    styled(lambda s, d: tagged(s, d).stylize("cre", style="red").stylize(which="tags", style="faint").insert_kmers(1, region="bc", mode="sequential", style="blue")),
    styled_rows("substr(s, 1, 8) || '<cre>' || substr(s, 9, 16) || '</cre>' || substr(s, 25, 8) || '<bc>' || substr('ACGT', v + 1, 1) || '</bc>'", looks(("red", "range(13, 29)"), ("faint", "range(8, 13) || range(29, 35)"), ("blue", "[47]")), 4),
)
add(
    "styled_recombine",
    styled(lambda s, d: sl.recombine(sources=[parts(s, d).stylize(regex="T", style="bold"), "AC" * 16], num_breakpoints=1, mode="sequential", styles=["red", "blue"], style_by="source")),
    f"{D}, o AS (SELECT a, 1 - a AS b FROM range(2) AS x(a)), e AS (SELECT k, s, p AS cut, a, b FROM d, range(31) AS q(p), o) "
    "SELECT k * 62 + cut * 2 + a AS i, CASE WHEN a = 0 THEN substr(s, 1, cut + 1) || substr(repeat('AC', 16), cut + 2) ELSE substr(repeat('AC', 16), 1, cut + 1) || substr(s, cut + 2) END AS seq, "
    + looks(("bold", places("substr(s, p + 1, 1) = 'T' AND (p <= cut) = (a = 0)")), ("red", places("(p <= cut) = (a = 0)")), ("blue", places("(p <= cut) = (a = 1)")))
    + " FROM e",
)
add(
    "styled_translate",
    styled(lambda s, d: parts(s, d, ORF, 30).stylize([4, 20], style="red").stylize(regex="[AG]+", style="bold").translate()),
    styled_rows(translated(ORF_SQL, 10), looks(("red", "range(2, 6)"), ("bold", places(f"regexp_full_match(substr({ORF_SQL}, CAST(3 * p + 1 AS BIGINT), 3), '[AG]+')", "10")))),
)
add(
    "styled_orf",
    styled(lambda s, d: parts(s, d, ORF, 30).stylize_orf(style_codons=["red", "blue"], frame=2).mutagenize_orf(num_mutations=1, mutation_type="nonsense", mode="sequential", style="bold", codon_positions=[0])),
    styled_rows(f"['TGA', 'TAA', 'TAG'][v + 1] || substr({ORF_SQL}, 4)", looks(("red", places("(p + 1) // 3 % 2 = 0", "30")), ("blue", places("(p + 1) // 3 % 2 = 1", "30")), ("bold", "range(3)")), 3),
)


# --- a whole design -------------------------------------------------------------------------------------------------
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of variants of every part, each with four barcodes."""
    with Session():
        wild = parts(spark, sf_dir)
        kinds = [wild.mutagenize(num_mutations=1, mode="sequential", prefix="mut"), wild.deletion_scan(5, mode="sequential", prefix="del"), wild.insertion_scan("TTT", mode="sequential", prefix="ins")]
        pool = sl.join([sl.stack(kinds), "GGATCC", sl.get_kmers(1, mode="sequential", prefix="bc")])
        return sl.generate_library(pool, spark=spark, init_state=0)


_kinds = f"""{D}, n AS (SELECT count(*) AS n FROM d), x AS (
  SELECT k * 96 + v AS j, 'mut_' || lpad(CAST(v AS VARCHAR), 2, '0') AS a, {ONE} AS s FROM d, range(96) AS r(v)
  UNION ALL SELECT n * 96 + k * 28 + v, 'del_' || lpad(CAST(v AS VARCHAR), 2, '0'), substr(s, 1, v) || '-----' || substr(s, v + 6) FROM d, n, range(28) AS r(v)
  UNION ALL SELECT n * 124 + k * 33 + v, 'ins_' || CAST(v AS VARCHAR), substr(s, 1, v) || 'TTT' || substr(s, v + 1) FROM d, n, range(33) AS r(v))
SELECT a || '.bc_' || CAST(b AS VARCHAR) AS name, s || 'GGATCC' || substr('ACGT', b + 1, 1) AS seq FROM x, range(4) AS q(b)"""
add("mpra_library", flagship, _kinds)
