"""Operators 11 to 13 against plain Python, with nulls, ties, repeated rows, hot sources, empty tables and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm import common, importance, merkle, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, idx long, tree string, _stretch long, _row long, weight double, id long"


def docs(spark, rows, parts=3):
    """(doc_id, source, text) with extra columns whose names the operators use themselves."""
    data = [(i, t, None if i == 3 else "en", s, None if i == 4 else len(t or ""), "k", 7, 7, "t", 7, 7, 0.5, 7) for i, s, t in rows]
    return spark.createDataFrame(data, DOCS).repartition(parts)


def words(n, seed, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"W{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, "a", None), (2, "b", ""), (3, "b", " \n\t\x0b"), (4, None, "One two\x0bthree"), (5, "", "x"), (None, "é", "no id A"), (None, "é", "no id either here"), (7, "c", "same Same"), (7, "c", "same Same"), (7, "c", "other"), (8, "z", None)]
HOT = [(100 + i, "hot", words(1 + i % 37, i)) for i in range(400)]
CORPUS = ODD + HOT + [(1000 + i, f"s{i % 5}", words(30 + i % 11, i)) for i in range(90)] + [(2000, "s1", words(60_000, 5)), (2001, "s2", "é" * 30_000 + " b")]


def test_order_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(6), rng.randrange(5)) for _ in range(500)] + [("x", 3, 1)] * 300
    table = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    placed = common.in_order(table, [F.col("k")], "test-order")
    got = common.running(placed, F.col("v"), "before", "g").orderBy("_stretch", "_at").collect()
    sums = Counter()
    for r, k in zip(got, sorted(k for _, k, _ in rows)):
        assert r["k"] == k and r["before"] == sums[r["g"]]
        sums[r["g"]] += r["v"]
    assert Counter((r["g"], r["k"], r["v"]) for r in got) == Counter(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else such few rows become one partition
    hot = common.in_order(spark.createDataFrame([(1,)] * 4000, "k long").repartition(4), [F.col("k")], "test-hot")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert hot.select("_stretch").distinct().count() > 1, "a key with all rows is cut too"


# --- 11 -------------------------------------------------------------------------------------------------------------
def plain_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, budget = {}, set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / w for s in names}
        new = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not new:
            return target
        full |= new


def plain_mix(rows, weights=(5, 2, 1), share=1.5, most=2, seed=2024):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    target, out = plain_targets(sizes, weights, share, most), []
    for source in sizes:
        e = target[source] / sizes[source] if sizes[source] else 0
        whole, pi, own = int(e), e - int(e), []
        for i, s, n in sized:
            if s == source:
                u = (int(hashlib.sha256(f"{seed}:{'-' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                own.append((u / (1 - u) / (pi / (1 - pi)) if pi else 0, i is not None, i or 0, n))
        own.sort()
        room, taken, left = target[source] - whole * sizes[source], Counter(), []
        for row in own:
            if pi and 0 < row[3] <= room:
                room -= row[3]
                taken[row] += 1
            elif pi and row[3]:
                left.append(row)
        least = min(left, key=lambda r: r[3], default=None)
        if least and least[3] < 2 * room:
            taken[least] += 1
        for row in own:
            hit = taken[row] > 0
            taken[row] -= hit
            out.append((row[2] if row[1] else None, row[3], sizes[source], target[source], row[3] * (whole + hit)))
    return out


def rounded(rows):
    return sorted(((-1 if r[0] is None else r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in rows)


@pytest.mark.parametrize("split", [10_000, 50])
def test_mix(spark, monkeypatch, split):
    monkeypatch.setattr(common, "HOT_ROWS", split)  # 50: the hot source is split in joins
    got = [tuple(r) for r in mixing.mix_words(docs(spark, CORPUS)).collect()]
    assert rounded(got) == rounded(plain_mix(CORPUS))
    again = [tuple(r) for r in mixing.mix_words(docs(spark, CORPUS, 7)).collect()]
    assert rounded(got) == rounded(again), "reruns agree, whatever the partitions"
    assert all(r[4] <= 2 * r[1] for r in got)


def test_mix_near_targets(spark):
    rows = [(i, f"s{i % 4}", words(1 + i * 7 % 53, i)) for i in range(800)]
    by = {}
    for _, size, source_size, target, taken in (tuple(r) for r in mixing.mix_words(docs(spark, rows)).collect()):
        by.setdefault((source_size, target), [0])[0] += taken
    assert len(by) == 4 and all(abs(taken - target) <= 1 for (_, target), (taken,) in by.items())


def test_mix_edges(spark):
    assert mixing.mix_words(docs(spark, CORPUS).limit(0)).count() == 0
    assert sorted(tuple(r) for r in mixing.mix_words(docs(spark, [(1, None, None), (2, None, " ")])).collect()) == [(i, 0, 0, 0.0, 0) for i in (1, 2)]
    same = [tuple(r) for r in mixing.mix(docs(spark, [(1, "s", "a b c")] * 40)).select("doc_id", "size", "copies").collect()]
    assert sorted(same) == [(1, 3, 1)] * 20 + [(1, 3, 2)] * 20, "repeated rows share the copies"
    all_full = mixing.mix(docs(spark, HOT), share=3.0).select("copies").distinct().collect()
    assert [r["copies"] for r in all_full] == [2]


def test_mix_by_preference(spark):
    """Inclusion in proportion to a preference: certain copies, bounds, targets and the order within the rest."""
    rows = [(i, "ab"[i % 2], words(5 + i % 9, i)) for i in range(600)]
    liked = F.when(F.col("doc_id") % 10 == 0, 50.0).when(F.col("doc_id") % 10 == 1, F.lit(None)).otherwise(F.col("doc_id") % 3 + 1)
    table = docs(spark, rows)
    assert {r["copies"] for r in mixing.mix(table, preference=liked, share=2.0).where("doc_id % 10 <> 1").collect()} == {2}
    mixed = mixing.mix(table, preference=liked, share=0.9)
    got = {r["doc_id"]: r for r in mixed.collect()}
    assert len(got) == 600 and {got[i]["copies"] for i in range(0, 600, 10)} == {2} and {got[i]["copies"] for i in range(1, 600, 10)} == {0}
    for source in "ab":
        own = [r for r in got.values() if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) < 15
        mean = [sum(r["copies"] for r in own if r["doc_id"] % 3 == k and r["doc_id"] % 10 > 1) for k in range(3)]
        assert mean[0] < mean[1] < mean[2]
    assert mixing.repeated(table, mixed).groupBy("doc_id").count().where("count > 2").count() == 0
    assert mixing.repeated(table, mixed).count() == sum(r["copies"] for r in got.values())


# --- 12 -------------------------------------------------------------------------------------------------------------
def plain_features(text, pairs):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return found + [f"{a} {b}" for a, b in zip(found, found[1:])] * pairs, len(found)


def plain_resample(rows, target, pairs=False, buckets=10_000):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (Counter(bucket(f) for x in texts for f in plain_features(x, pairs)[0]) for texts in ([r[2] for r in rows], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for i, _, text in rows:
        f, n = plain_features(text, pairs)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'-' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: 10 * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


TARGET = [words(40, 9), "W1 w2 W3, é1!", None, ""]


@pytest.mark.parametrize("pairs,head", [(False, 20_000), (False, 5), (True, 20_000), (True, 30), (True, 0)])
def test_resampling(spark, pairs, head):
    target = spark.createDataFrame([(t, "x") for t in TARGET], "text string, id string")
    got = importance.resample(docs(spark, CORPUS), target, pairs=pairs, head=max(head, 1)) if head else None
    if head == 0:  # nothing in the head: all features are of the tail
        features = importance.bucketed(docs(spark, CORPUS), "doc_id", importance.Head([], [], 10_000), True)
        want = sum((Counter(zlib.crc32(f.encode()) % 10_000 for f in plain_features(t, True)[0]) for *_, t in CORPUS), Counter())
        have = importance.totals(features, 10_000)
        assert {int(b): int(have[b]) for b in have.nonzero()[0]} == want
        return
    assert Counter(tuple(r) for r in got.collect()) == plain_resample(CORPUS, TARGET, pairs)


def test_resampling_edges(spark):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert importance.resample(docs(spark, CORPUS).limit(0), target).count() == 0
    empty = importance.resample(docs(spark, HOT), target.limit(0))
    assert Counter(tuple(r) for r in empty.collect()) == plain_resample(HOT, [])
    repeated = [(1, "s", words(25, 1))] * 30
    ranks = sorted(r["rank"] for r in importance.resample(docs(spark, repeated), target).where("rank is not null").collect())
    assert ranks == [1, 2, 3]
    table = docs(spark, HOT)
    ranked = importance.resample(table, target)
    assert importance.drawn(table, ranked).count() == ranked.where("rank is not null").count() > 0


def test_head_states_are_exact(spark):
    head = importance.frequent(docs(spark, CORPUS), True, 50)
    assert 0 < len(head.words) <= 50 and 0 < len(head.pairs) <= 50
    assert head.states.tolist() == [zlib.crc32(w) for w in head.words.to_pylist()]


# --- 13 -------------------------------------------------------------------------------------------------------------
def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes, arity):
    """The root, and for each leaf its steps."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            base = i - i % arity
            steps[leaf].append(("".join(level[base:i]), "".join(level[i + 1 : base + arity])))
        level = [digest("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], steps


def plain_manifest(rows, arity=16):
    def leaf(r):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    by = defaultdict(list)
    for i, s, t in rows:
        r = (i, s, None if i == 3 else "en", None if i == 4 else len(t or ""), t)
        low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by[s].append((i is not None, i or 0, leaf(r), leaf((*r[:4], low)) if hit else leaf(r)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([r[2] for r in sorted(by[s])], arity) for s in names}
    root, over = plain_tree([trees[s][0] for s in names], arity)
    out = []
    for s, upper in zip(names, over):
        for r, steps in zip(sorted(by[s]), trees[s][1]):
            at = r[3]
            for a, b in steps + upper:
                at = digest(a + at + b)
            out.append((r[1] if r[0] else None, r[2], trees[s][0], root, digest("".join(a + b for a, b in steps + upper)), at, at == root))
    return Counter(out)


@pytest.mark.parametrize("rows", [CORPUS, ODD, HOT[:257], HOT[:256], HOT[:17], HOT[:1], [(i, f"s{i}", "A") for i in range(40)]], ids=["all", "odd", "257", "256", "17", "1", "sources"])
def test_manifest(spark, rows):
    got = Counter(tuple(r) for r in merkle.tampered_proofs(docs(spark, rows)).collect())
    assert got == plain_manifest(rows)
    assert all(len({r[k] for r in got}) <= 2 for k in (3, 6))


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_of_other_arities(spark, arity):
    made = merkle.proofs(docs(spark, CORPUS), arity=arity)
    got = Counter(tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings("steps"), 256), merkle.folded(F.col("leaf"), "steps") == F.col("root")).collect())
    want = Counter()
    for r, n in plain_manifest(CORPUS, arity).items():
        want[(*r[:5], True)] += n
    assert got == want


def test_audit_finds_changed_and_lost_rows(spark):
    before = [(i, "ab"[i % 2], words(9, i)) for i in range(60)]
    after = [(i, s, "changed" if i == 5 else t) for i, s, t in before if i != 6]
    found = merkle.audit(docs(spark, after), merkle.proofs(docs(spark, before)))
    assert sorted(r["doc_id"] for r in found.where("NOT verified").collect()) == [5, 6] and found.count() == 60


def test_manifest_of_nothing(spark):
    assert merkle.tampered_proofs(docs(spark, CORPUS).limit(0)).count() == 0
