"""The corpus operators against plain Python on small tables, with nulls, empty and long texts, ties, repeats and odd columns."""

import gzip
import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import bpe, cgk, chat, common, license_scan, lsm_dedup, near, rlz, simhash, style_tree, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, tag string, key string, hash string"


def docs(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use themselves."""
    data = [(i, t, "en", "s", len(t or ""), "r", "t", "k", "h") for i, t in rows]
    return spark.createDataFrame(data, DOCS).repartition(parts)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  two"), (5, "one  two"), (None, "alone here"), (6, "é ü 日本 <|im_end|> \x0b x"), (7, "a" * 5000), (8, "x " * 40_000)]
CORPUS = ODD + [(20 + i, words(120, i)) for i in range(12)] + [(40 + i, words(120, 3) + f" tail{i}") for i in range(6)] + [(60, words(120, 4)), (61, words(120, 4))]


# --- 1 --------------------------------------------------------------------------------------------------------------
TURNS = [
    (1, 1, "assistant", "reply <|im_end|>\n<|im_start|>assistant\nx"),
    (1, 0, "user", "ask <|| <|"),
    (2, 0, "assistant", None),
    (2, 0, "assistant", None),
    (3, 5, None, "no role"),
    (None, 0, "user", "no id"),
    (4, None, "user", "no turn"),
    (4, 3, "a\nb", "line feed in a role"),
    (5, 0, "user", ""),
    (6, 0, "user", "hi"),
    (6, 1, "assistant", "same"),
    (6, 1, "assistant", "same"),
    (6, 2, "user", "x"),
] + [(9, i, ("user", "assistant")[i % 2], f"turn {i} <") for i in range(300)]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_chat(spark, block):
    table = spark.createDataFrame([(*t, "x", "y") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, block string")
    made = {r["conv_id"]: r for r in chat.format_conversations(table, block).collect()}
    back = {r["conv_id"]: r for r in chat.chat_digests(table).collect()}
    by = defaultdict(list)
    for c, t, r, x in TURNS:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(made) == set(back) == set(by)
    for c, rows in by.items():
        rows.sort()
        turns = "".join(f"{r}\n{x}\n" for *_, r, x in rows)
        loss = "".join(x for *_, r, x in rows if r == "assistant")
        got = back[c]
        assert (got["n_turns"], got["turns_sha256"]) == (len(rows), hashlib.sha256(turns.encode()).hexdigest())
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got["formatted_chars"] == len(made[c]["formatted"]) and got["spans_ok"]
        spans = [made[c]["formatted"][s["start"] : s["start"] + s["chars"]].replace("<||", "<|") for s in made[c]["replies"]]
        assert "".join(spans) == loss


def test_chat_examples(spark):
    table = spark.createDataFrame(TURNS[:2], "conv_id long, turn long, role string, text string")
    row = chat.with_contexts(chat.format_conversations(table)).first()
    assert row["context"].endswith("<|im_start|>assistant\n") and row["target"].endswith(chat.END)
    one = chat.expand_examples(chat.format_conversations(table)).first()
    assert one["context_chars"] == len(row["context"]) and one["reply"] + chat.END == row["target"]
    assert chat.chat_digests(table.limit(0)).count() == 0


def test_repeated_replies_have_places_of_their_own(spark):
    """The first of two equal rows must not have its own reply in its context."""
    table = spark.createDataFrame([t for t in TURNS if t[0] == 6], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(table)
    one, two = sorted(r["context"] for r in chat.with_contexts(done).collect())
    assert len(one) == 52 and "same" not in one and two == one + "same" + chat.END + chat.START + "assistant\n"
    assert sorted((r["example"], r["context_chars"], r["reply"]) for r in chat.expand_examples(done).collect()) == [(0, len(one), "same"), (1, len(two), "same")]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 101])
def test_text_under_the_mask(spark, n):
    rng = random.Random(n)
    text, spans, at = words(600, n), [], 0
    for _ in range(n):
        at += rng.randrange(5)
        spans.append((at, chars := rng.randrange(12)))
        at += chars
    table = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start long, chars long>>")
    assert table.select(chat.masked(F.col("text"), F.col("spans")).alias("x")).first()["x"] == [text[a : a + k] for a, k in spans]


# --- 2 --------------------------------------------------------------------------------------------------------------
PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><!-- no --><div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p><b>First<br>line<p>Second &lt;b&gt;  part\n x</p></article><div id=comments>Bad</div><aside>Side</aside><form>F</form><footer>&copy; me</footer></body>"


def test_main_text():
    assert style_tree.main_text(PAGE) == "Head & more First line Second <b> part x"
    assert style_tree.main_text("") == "" == style_tree.main_text("<nav>a</nav>")
    assert style_tree.main_text("plain &eacute; text") == "plain é text"
    assert style_tree.main_text("<p>a<p>b<ul><li>c<li>d</ul><b>e</b>f") == "a b c d ef"
    assert style_tree.main_text("<div>a < b & c</div><script>never") == "a < b & c"
    assert style_tree.main_text("<p>" * 3000 + "deep") == "deep"


def test_style_tree_cuts_what_repeats(spark):
    pages = [(i, f"http://h.example/{i}", f"<div id=x><p>{words(30, i)}</p></div><div class=legal><p>All rights of nobody</p></div>", "h", "l") for i in range(8)]
    pages += [(100, None, None, "h", "l"), (101, "http://one.example/", "<div class=legal><p>Kept</p></div>", "h", "l"), (101, "http://one.example/", "<div class=legal><p>Kept</p></div>", "h", "l")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, host string, low string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in style_tree.extract(table).collect())
    assert got[:8] == [(i, words(30, i), len(words(30, i))) for i in range(8)]
    assert got[8:] == [(100, "", 0), (101, "Kept", 4), (101, "Kept", 4)]
    assert style_tree.extract(table.limit(0)).count() == 0


def plain_trees(pages, names):
    """Content and low branches of each host: entropies over plain counts, one host after the other."""
    out = {}
    for site in {h for h, _ in pages}:
        own = [p for h, p in pages if h == site]
        counts, size, above = defaultdict(Counter), Counter(), {}
        for page in own:
            for path, up, kind, value, n in set(style_tree.observed(page or "", names)):
                counts[path, kind][value] += 1
                above[path] = up
                size[path, value] += n if kind == "c" else 0
        entropy = {k: 1.0 if (n := c.total()) < 2 else -sum(x / n * math.log(x / n) for x in c.values()) / math.log(n) for k, c in counts.items()}
        words, weighed = Counter(), Counter()
        for path, kind in counts:
            if kind == "c":
                n = sum(size[path, v] for v in counts[path, "c"])
                for branch in (*above[path], path):
                    words[branch] += n
                    weighed[branch] += n * entropy[path, "c"]
        often = [p for p in above if p != style_tree.ROOT and (n := max(counts[p, k].total() for k in "pc")) >= style_tree.PAGES and n >= style_tree.SHARE * len(own)]
        content = [p for p in often if entropy.get((p, "p"), -1) >= style_tree.HIGH and words[p] > style_tree.MAIN * words[style_tree.ROOT]]
        low = [p for p in often if max(entropy.get((p, "p"), -1), weighed[p] / words[p] if words[p] else -1) < style_tree.LOW]
        out[site] = ({p for p in content if not any(p in above[q] for q in content)}, {p for p in low if not set(above[p]) & set(low)})
    return out


def site(host, n, seed, article="article", nav="nav", ad="div class=ad", footer="footer"):
    """Pages whose menus, adverts and footers all differ; only their form repeats."""
    rng = random.Random(seed)
    close = lambda x: f"</{x.split()[0]}>"
    for i in range(n):
        menu = "".join(f"<li><a href=/x>{rng.choice('abc')}{rng.randrange(99)}</a></li>" for _ in range(6))
        body = f"<h1>{words(8, rng.random(), 9999)}</h1>" + "".join(f"<p>{words(rng.randrange(2, 90), rng.random(), 9999)}</p>" + "<ul><li>x</ul>" * rng.randrange(2) for _ in range(rng.randrange(2, 12)))
        legal = "<div class=legal><p>All rights of nobody</p></div>"
        yield f"http://{host}/{i}", f"<html><body><{nav}><ul>{menu}</ul>{close(nav)}<{ad}>{words(rng.randrange(3, 12), rng.random())}{close(ad)}<{article}>{body}{close(article)}{legal}<{footer}>{words(9, rng.random())}{close(footer)}</body></html>", body


@pytest.mark.parametrize("names", [True, False])
def test_style_trees_against_plain_python(spark, names):
    pages = [*site("a.example", 30, 1), *site("b.example", 12, 2, "div", "div", "div", "div"), *site("c.example", 3, 3), *site("d.example", 9, 4, "section id=x", "div class=menu", "p", "header")]
    pages += [("http://e.example/", f"<div><div>{words(3, i % 2)}</div><div>same</div><section><p>{words(40, i)}<p>{words(i, i)}</section></div>", "") for i in range(11)] + [(None, None, ""), ("x", "", "")]
    table = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    sited = table.select(style_tree.host().alias("host"), "html")
    want = plain_trees([tuple(r) for r in sited.collect()], names)
    got = {r["host"]: (set(r["content"] or []), set(r["low"] or [])) for r in style_tree.trees(sited, names=names).collect()}
    assert got == want and sum(len(c) for c, _ in got.values()) >= 3 and sum(len(x) for _, x in got.values()) >= 2
    of = {r["host"]: r for r in style_tree.trees(sited, names=names).collect()}
    hosts = {r["page_id"]: r["host"] for r in table.select("page_id", style_tree.host().alias("host")).collect()}
    for r in style_tree.extract(table, names=names).collect():
        i = r["page_id"]
        assert r["text"] == style_tree.main_text(pages[i][1] or "", frozenset(of[hosts[i]]["content"] or ()), frozenset(of[hosts[i]]["low"] or ()), names)
        if pages[i][2] and (names or "c.example" not in pages[i][0]):  # three pages are too few for entropy
            assert r["text"] == style_tree.main_text(pages[i][2])


def test_names_in_articles():
    page = '<article><h2 id="related-work">Related work</h2><p>Body <math>x+y</math> text.</p><section id="discussion"><p>We discuss.</p></section><svg/><div class="comments">Bad</div><object>shown</object></article><div class=related>Bad</div>'
    assert style_tree.main_text(page) == "Related work Body x+y text. We discuss. shown"


def test_long_pages():
    start = time.perf_counter()
    assert style_tree.main_text("<p>one" + "<a " * 350_000) == " ".join(("one" + "<a " * 350_000).split())
    assert style_tree.main_text("<b a='" + "<a b='' c=\"" * 90_000 + "x") and style_tree.main_text('<a "x>"' * 150_000 + "y").endswith("y")
    assert style_tree.main_text("<div>" * 200_000 + "deep") == "deep" == style_tree.main_text("<div>" * 100_000 + "deep" + "</div></p></li>" * 100_000)
    assert style_tree.main_text("<li>" * 100_000 + "x<p>" * 3) == "x x x" and style_tree.main_text("<!" * 500_000)
    assert len(list(style_tree.observed("<div>x" * 20_000))) > 20_000
    assert time.perf_counter() - start < 20


def test_copied_articles_stay(spark):
    table = spark.createDataFrame([(i, "http://h.example/", PAGE) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in style_tree.extract(table).collect()} == {"Head & more First line Second <b> part x"}


# --- 3 --------------------------------------------------------------------------------------------------------------
def plain_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    by = defaultdict(list)
    for i, t in rows:
        by[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in by.items()}, norm


@pytest.mark.parametrize(("key_bytes", "memtable"), [(16, 100_000), (16, 4), (1, 5), (0, 3)])
def test_exact_dedup(spark, key_bytes, memtable):
    """Short keys make digests collide; the bytes then decide."""
    want, norm = plain_groups(CORPUS)
    got = lsm_dedup.dedup_digests(docs(spark, CORPUS), key_bytes=key_bytes, memtable=memtable).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter((i, *want[norm(t)]) for i, t in CORPUS)
    assert sum(r["kept"] for r in got) == len(want)


def test_drop_copies(spark):
    table = docs(spark, CORPUS)
    left = lsm_dedup.drop_copies(table)
    assert left.columns == table.columns
    want, norm = plain_groups(CORPUS)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(w[0] for w in want.values())
    assert lsm_dedup.drop_copies(table.limit(0)).count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------
def word_edits(a, b):
    """Fewest edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def planted():
    rng = random.Random(4)
    items = [(i, " ".join(f"b{rng.randrange(300)}" for _ in range(rng.randrange(12, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "B1, b2! b3?")]
    rows = [(i, words(200, i)) for i in range(30)] + [(None, None), (500, "")]
    for i, text in items[:25]:
        own = text.split()
        for _ in range(int(0.2 * len(own)) if i % 2 else 0):
            j, kind = rng.randrange(len(own)), rng.randrange(3)
            if kind == 0:
                own[j] = "zz"
            elif kind == 1:
                own.insert(j, "yy")
            elif len(own) > 1:
                del own[j]
        rows.append((1000 + i, f"{words(50, i)} {' '.join(own).upper()}, {words(40, i + 1)}"))
    return items, rows + [(2000, words(90, 1) + " b1 B2 b3")]


def test_decontamination_against_brute_force(spark):
    items, rows = planted()
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in cgk.leaks(docs(spark, rows), benchmark).collect()}
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = {}
    for (d, text), (i, item) in itertools.product(rows, items):
        own = split(item)
        if own and set(own) & set(split(text)) and (e := word_edits(own, split(text))) <= int(0.2 * len(own)):
            want[d, i] = e
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 20
    assert all(got[k] == 0 for k, e in want.items() if e == 0)  # exact copies are always found
    kept = cgk.decontaminate(docs(spark, rows), benchmark)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert cgk.leaks(docs(spark, rows).limit(0), benchmark).count() == 0
    assert cgk.leaks(docs(spark, rows), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("vocabulary", [3, 30, 3000])
def test_the_filter_before_the_walks_loses_nothing(vocabulary):
    """Windows about every place within the threshold pass, with repeated words and deletions between equal words as well."""
    rng = random.Random(vocabulary)
    cases = [("p0 q0 p0 p1 q1 p1 p2 q2 p2 p3 q3 p3 " + " ".join(f"z{i}" for i in range(8)), "p0 p0 p1 p1 p2 p2 p3 p3 " + " ".join(f"z{i}" for i in range(8)))]
    for n in range(40):
        item = words(rng.randrange(5, 60), n, vocabulary).split()
        edited = list(item)
        for _ in range(len(item) // 5):
            i, kind = rng.randrange(len(edited)), rng.randrange(3)
            edited[i : i + (kind > 0)] = [] if kind == 1 else [f"x{rng.randrange(10**6)}"]
        cases.append((" ".join(item), f"{words(9, n + 50, 10**6)} {' '.join(edited)} {words(9, n + 90, 10**6)}"))
    for item, text in cases:
        own, found = cgk.item_words(item), cgk.item_words(text)
        most = len(own) // 5
        assert cgk.edit_search(own, found)[0] <= most
        at = cgk.Index.possible(found, np.array([0, len(found)]), len(own), len(own) - most, np.isin(found, own).astype(np.int64))
        before = [e for e in range(len(found) + 1) if cgk.edit_search(own, found[e:])[0] <= most]
        assert at.min(initial=10**9) <= before[-1]  # the last place that a passage within the threshold can begin at


def test_deletions_between_equal_words():
    found = 0
    for seed in range(40):
        pairs, end = [(f"p{seed}x{i}", f"q{seed}x{i}") for i in range(4)], [f"z{seed}x{i}" for i in range(8)]
        item = [w for p, q in pairs for w in (p, q, p)] + end
        text = cgk.item_words(" ".join(["before it", *(w for p, _ in pairs for w in (p, p)), *end, "and after it"]))
        got = cgk.Index([(0, " ".join(item))]).search(text, np.array([0, len(text)]))
        assert [x[:3] for x in got] in ([], [(0, 0, 4)])
        found += len(got)
    assert found >= 36


def test_items_in_blocks(spark):
    items, rows = planted()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(map(tuple, cgk.leaks(docs(spark, rows), benchmark, block=b).select("doc_id", "item_id").collect()), key=str) for b in (100, 9))
    assert len(set(whole) ^ set(parts)) <= 1


def test_long_items_at_the_threshold():
    rng, held, texts = random.Random(2), [], []
    for n, m in enumerate([150, 250, 500, 500, 700, 1000]):
        item = words(m, 300 + n, 3000).split()
        held.append((n, " ".join(item)))
        edited = list(item)
        for _ in range(m // 5):
            i, kind = rng.randrange(len(edited)), rng.randrange(3)
            edited[i : i + (kind > 0)] = [] if kind == 1 else [f"x{rng.randrange(10**6)}"]
        texts.append(cgk.item_words(" ".join([words(40, n, 3000), *edited, words(40, n + 9, 3000)])))
    first = np.cumsum([0, *map(len, texts)])
    found = cgk.Index(held).search(np.concatenate(texts), first)
    assert {(r, n) for r, n, *_ in found} >= {(n, n) for n in range(6)}
    for r, n, edits, end in found:
        assert (edits, end) == cgk.edit_search(cgk.item_words(held[n][1]), texts[r])


def test_the_word_before_a_window_does_not_count():
    """Row 0 ends with the word that the leak in row 1 begins with."""
    for seed in range(5):
        item = [f"a{seed}x{i}" for i in range(10)]
        texts = [cgk.item_words(t) for t in ("before " + item[0], " ".join([*item[:8], "x", "y", "z"]))]
        found = cgk.Index([(0, " ".join(item))]).search(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
        assert [(r, n, e) for r, n, e, _ in found] == [(1, 0, 2)]


# --- 5 --------------------------------------------------------------------------------------------------------------
def test_licenses(spark):
    rows = [(i, words(300, i)) for i in range(6)] + [(None, None), (7, "")]
    texts = license_scan.TEMPLATES
    rows += [(100 + i, f"{words(40, i)}\n{t}\n{words(30, i)}") for i, t in enumerate(t for ts in texts.values() for t in ts)]
    long = texts["MIT"][2].split()
    rows += [(200, " ".join(long[:-8])), (201, " ".join(long[: len(long) // 2])), (202, "RELEASED under   the mit license!"), (203, "x " * 300_000 + texts["MPL-2.0"][0])]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in license_scan.licenses(docs(spark, rows)).collect()}
    names = [n for n, ts in texts.items() for _ in ts]
    for i, n in enumerate(names):
        assert got[100 + i, n] == 1.0
    assert (200, "MIT") in got and (201, "MIT") not in got and got[202, "MIT"] == 1.0 == got[203, "MPL-2.0"]
    assert not any(d is None or d < 100 for d, _ in got)
    assert license_scan.licenses(docs(spark, rows).limit(0)).count() == 0
    table = spark.createDataFrame([("own", "a notice of four words"), ("own", "w1"), (None, "x"), ("none", None), ("empty", "")], "license string, text string")
    found = license_scan.licenses(docs(spark, [(1, "here is A NOTICE, of four words."), (2, "w1 w1"), (3, "notice of four words")]), table).collect()
    assert sorted(tuple(r) for r in found) == [(1, "own", 1.0, 2), (2, "own", 1.0, 0)]
    with pytest.raises(ValueError, match="more than 2"):
        license_scan.listed(table, 2)


@pytest.mark.parametrize("spread", [True, False])
def test_licenses_against_every_place(spread):
    """All edited notices that contain 0.8 of a template or more, by trying every place of the text."""
    index, rng = license_scan.Templates(), random.Random(3)
    wanted = found = 0
    for n, (name, text) in enumerate((x, t) for x, ts in license_scan.TEMPLATES.items() for t in ts):
        own = cgk.item_words(text)
        if len(own) < 15:
            continue
        for trial in range(12):
            edited = own.copy()
            edits = max(1, int(len(own) * 0.02 * (trial % 4 + 1) / (1 if spread else 0.3)))
            at = rng.sample(range(len(own)), edits) if spread else range(x := rng.randrange(len(own)), min(len(own), x + edits))
            edited[list(at)] = [rng.getrandbits(63) for _ in at]
            around = [np.array([rng.getrandbits(63) for _ in range(rng.randrange(60))], np.uint64) for _ in range(2)]
            s = cgk.window_hashes(np.concatenate([around[0], edited, around[1]]), license_scan.SHINGLE)
            got = {x for x, _, _ in index.search(s)}
            for m, (other, _) in enumerate(index.rows):
                if other == name and max(index.contained(m, s, p)[0] for p in range(len(s))) >= license_scan.CONTAINMENT:
                    wanted += 1
                    found += name in got
                    break
            else:
                assert name not in got
    assert wanted > 100 and found >= 0.99 * wanted
    # texts shorter than a template's window
    bsd = cgk.window_hashes(cgk.item_words(license_scan.TEMPLATES["BSD"][0]), license_scan.SHINGLE)
    assert all("BSD" in {x for x, _, _ in index.search(part)} for part in (bsd[:14], bsd[2:], bsd[1:15]))


# --- 6 --------------------------------------------------------------------------------------------------------------
def labelled(n=400):
    rng = random.Random(8)
    bad, rows, labels = ["grubble", "snortik", "vexomar"], [], []
    for i in range(n):
        text = [f"{rng.choice(['mal', 'ter', 'on', 'di'])}{rng.choice(['ora', 'eni', 'as'])}{rng.choice(['t', 'm', 'r'])}" for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_and_disguised(spark):
    rows, labels = labelled()
    disguised = [(1000, "malorat GRUBBLE!! vex0mar terasm"), (1001, "g r u b b l e onenir s.n.o.r.t.i.k"), (1002, "snoooortik vexxxxomar dienit"), (1003, "v3x0m4r grubb1e")]
    extra = [(None, None), (2000, ""), (2001, "malorat terasm onenir 12:30 a.b"), (2001, "malorat terasm onenir 12:30 a.b")]
    table = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, rows + disguised + extra), table).collect()
    assert len(got) == len(rows + disguised + extra) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [(y, by[i]["predicted"]) for i, _, y in labels if by[i]["held_out"]]
    assert len(held) > 60 and np.mean([y == p for y, p in held]) > 0.97
    assert all(by[i]["predicted"] == 1 for i, _ in disguised)
    assert by[2001]["predicted"] == by[2000]["predicted"] == by[None]["predicted"] == 0


def test_decoding_is_the_best_of_all_paths(spark):
    """Viterbi against every path through the lattices of short forms."""
    model = toxicity.log_probabilities(toxicity.trigram_counts(docs(spark, CORPUS + [(1, "the bad cab is a sad idea; a good dog sees geese")])))
    channel = toxicity.Channel(model)

    def cost(text, path):
        a, b, total, out = 0, 0, 0.0, []
        for c, own in path:
            s = 0 if c == " " else toxicity.symbol(c) if c else -1
            total += own
            if s < 0 or (s == 0 and b == 0):
                continue
            total += float(model[a, b, s])
            a, b = (0, 0) if s == 0 else (b, s)
            out.append(c)
        return total + float(model[a, b, 0]), "".join(out)

    for text in ("b4d", "s@dd", "g00d", "1d3a", "c-a-b", "d o g", "g33s3", "$4d", "b!!g", "aaa", "d0.g5"):
        every = [cost(text, p) for p in itertools.product(*(channel.options(text, i) for i in range(len(text))))]
        best = max(every)[0]
        assert channel.decode(text) in {t for c, t in every if c > best - 1e-4}


def test_long_written_forms():
    channel = toxicity.Channel(np.zeros((toxicity.SYMBOLS,) * 3, np.float32))
    start = time.perf_counter()
    assert channel.words("a" + "-" * 1_000_000 + "a") == ["aa"] or channel.words("a-a")
    assert toxicity.bare("(-" * 10 + "x" + "-" * 1_000_000) == "(-" * 10 + "x" and toxicity.bare("-" * 1_000_000) == ""
    assert len("".join(channel.words("ab4" * 2000))) >= 4000
    assert time.perf_counter() - start < 5


def test_toxicity_without_labels(spark):
    rows, labels = labelled(20)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs(spark, rows), table.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs(spark, rows).limit(0), table).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------
def plain_removal(rows, window):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    count = Counter()
    for _, t in rows:
        w = split(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = split(t)
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "gram", "vocabulary"), [(35, 12, 400), (6, 3, 3), (5, 2, 12), (2, 1, 9)])
def test_substring_dedup(spark, window, gram, vocabulary):
    rng = random.Random(window)
    passages = [words(rng.randrange(window, 4 * window), 900 + i, vocabulary) for i in range(6)]
    rows = ODD[:7] + [(8, "x " * 300)] + [(9, " ".join(["For"] * (window + 1)))]
    for i in range(40):
        pieces = [words(rng.randrange(0, 3 * window), 50 + i, vocabulary)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split()
            a = rng.randrange(len(p))
            pieces += [" ".join(p[a:] if rng.random() < 0.5 else p), words(rng.randrange(window), 70 + i, vocabulary)]
        rows.append((10 + i, " ".join(pieces)))
    got = [tuple(r) for r in rlz.without_repeats(docs(spark, rows), window, gram).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert Counter(got) == Counter(plain_removal(rows, window))


def test_substring_dedup_texts_and_empty(spark):
    rows = [(1, words(80, 1)), (2, words(80, 1) + " end"), (3, words(50, 2))]
    got = {r["doc_id"]: r["kept"] for r in rlz.without_repeats(docs(spark, rows), with_text=True).collect()}
    assert got == {1: "", 2: "end", 3: words(50, 2)}
    assert rlz.without_repeats(docs(spark, rows).limit(0)).count() == 0


# --- 8 --------------------------------------------------------------------------------------------------------------
def test_archives_round_trip(spark, tmp_path):
    big, other = "é<p>" * 20_000, "z" * 999
    pages = [(1, "http://a/ b\n", big), (2, None, big), (7, "u", big), (7, "u", big), (3, "u", other), (4, "u", other), (5, "u", None), (6, "u", "0\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", big), (8, "u", "z" * 1000), (9, "u", "z" * 1000)]
    table = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, digest string, salt string").repartition(3)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(table, path)
    rows = warc.read_archives(spark, path, with_payload=True)
    payloads = Counter((r["page_id"], bytes(r["payload"]).decode()) for r in rows.where("record_type = 'response'").collect())
    assert payloads == Counter([(7, big), (7, big), (3, other), (4, other), (5, ""), (6, pages[7][2]), (9, "z" * 1000)])
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_digests(table).collect())
    keep = {big: 7, "z" * 1000: 9}
    want = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        to = keep.get(h) if len(data) >= 1000 and keep.get(h) != i else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to] += 1
    assert got == want
    assert warc.archive_digests(table.limit(0)).count() == 0


def test_a_missing_segment_is_noticed(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "q" * 50_000)], "page_id long, url string, html string")
    warc.write_archives(table, f"file://{tmp_path}/w")
    records = warc.read_records(spark, f"file://{tmp_path}/w")
    assert records.count() > 3
    with pytest.raises(Exception, match="segments missing"):
        warc.reassembled(records.where("segment is null or segment <> 2")).collect()


def test_damaged_archives(spark, tmp_path):
    """With strict=False a broken file, a lost segment and a wrong payload are rows of their own, and the rest is read."""
    path = tmp_path / "w"
    table = spark.createDataFrame([(i, "u", f"page {i} " + "q" * 300) for i in range(40)] + [(50, "u", "r" * 50_000)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(table, f"file://{path}")
    (file,) = path.glob("*.gz")
    data = gzip.decompress(file.read_bytes())
    whole = {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(spark, f"file://{path}", strict=False).collect()}
    assert len(whole) == 41
    (path / "half.gz").write_bytes(gzip.compress(data[: len(data) // 9]))
    (path / "short.gz").write_bytes(gzip.compress(data[:4000])[:-30])
    (path / "wrong.gz").write_bytes(gzip.compress(data.replace(b"page 7 ", b"page 8 ").replace(b"WARC-Segment-Number: 2", b"WARC-Segment-Number: 7")))
    with pytest.raises(Exception, match="cut short|missing|differs"):
        warc.read_archives(spark, f"file://{path}").collect()
    rows = warc.read_archives(spark, f"file://{path}", strict=False).collect()
    kinds = Counter(r["record_type"] for r in rows)
    reasons = {r["payload_digest"].split(":")[0] for r in rows if r["record_type"] == "damaged"}
    assert {"a payload differs from its digest", "segments missing or of another length"} <= reasons and any("cut short" in x for x in reasons)
    assert kinds["response"] > 41 + 38 and {r["page_id"] for r in rows if r["record_type"] == "response"} >= set(whole) - {50}


def test_large_records_are_inflated_piece_by_piece():
    rng = random.Random(1)
    blocks = [rng.randbytes(n) for n in (0, 1, 3_000_000, 1 << 20, 5)]
    files = [b"".join(f"WARC/1.1\r\nN: {i}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate(blocks))]
    members = b"".join(gzip.compress(files[0][i : i + 700_001]) for i in range(0, len(files[0]), 700_001))
    for data in (files[0], gzip.compress(files[0]), members):
        assert [(f["N"], b) for f, b in warc.parse(data)] == [(str(i), b) for i, b in enumerate(blocks)]
    bomb = gzip.compress(b"WARC/1.1\r\nContent-Length: 1000\r\n\r\n" + b"z" * 1000 + b"\r\n\r\n" + (b"WARC/1.1\r\nContent-Length: 100000\r\n\r\n" + b"z" * 100_000 + b"\r\n\r\n") * 600)
    tracemalloc.start()
    assert sum(len(b) for _, b in warc.parse(bomb)) == 60_001_000
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_chunks():
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\nA;x=1\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\n\r\nabc") == b"abc"


# --- 9 --------------------------------------------------------------------------------------------------------------
def plain_components(fps, ids, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints(spark):
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    table = docs(spark, CORPUS)
    tokens = F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " ")))
    hashes = table.select("doc_id", "text", tokens.alias("w")).select("doc_id", "text", F.when(F.size("w") > 0, shingles).alias("h")).collect()
    want = Counter()
    for r in hashes:
        h = [x % 2**64 for x in r["h"] or []]
        want[r["doc_id"], sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))] += 1
    got = Counter((r["doc_id"], r["fp"] % 2**64) for r in simhash.fingerprints(table).collect())
    assert got == want


@pytest.mark.parametrize(("most", "tile"), [(simhash.MOST, simhash.TILE), (3, 2)])
def test_near_groups(spark, most, tile):
    got = simhash.near_groups(docs(spark, CORPUS), most=most, tile=tile).collect()
    assert len(got) == len(CORPUS)
    want = plain_components([r["fp"] % 2**64 for r in got], [r["doc_id"] for r in got])
    assert [r["component_id"] for r in got] == want


@pytest.mark.parametrize(("most", "tile"), [(simhash.MOST, simhash.TILE), (5, 2), (40, 3)])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, most, tile):
    """With the settings as they are there are several tiles and runs; smaller ones deal out keys in parts."""
    monkeypatch.setattr(simhash, "RUN", 100)
    rng = random.Random(6)
    fps = [0, 2**64 - 1]
    for _ in range(60):
        fps.append(rng.getrandbits(64))
    for _ in range(400):
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps += [rng.choice(fps) & ~((1 << 32) - 1) | rng.getrandbits(32) for _ in range(300)]  # large keys, counts far apart
    fps += [7 << 40 | rng.getrandbits(32) for _ in range(150)] + [7 << 40 | 1 << rng.randrange(32) for _ in range(20)]
    fps = sorted(set(fps))
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.links(table, most=most, tile=tile)).collect()}
    label = [roots.get(f, f - (1 << 64) if f >> 63 else f) for f in fps]
    want = plain_components(fps, list(range(len(fps))))
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [("hot", i) for i in range(300)] + [(f"k{i % 7}", i) for i in range(60)] + [("none", 1)]
    counts = Counter(k for k, _ in rows if k != "none")
    table = spark.createDataFrame(rows, "k string, i long")
    keyed = spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items()], "k string, size long, v string")
    got = common.join_split(table, keyed, "k", "size", "i")
    assert Counter(map(tuple, got.select("k", "i", "v").collect())) == Counter((k, i, f"v{k}") for k, i in rows if k != "none")


def test_drop_near_copies(spark):
    table = docs(spark, CORPUS)
    left = simhash.drop_near_copies(table)
    groups = {r["component_id"] for r in simhash.near_groups(table).collect()}
    assert left.columns == table.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(groups)
    assert simhash.drop_near_copies(table.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 4, 30, 300, 5000])
def test_parities_lose_no_pair(size):
    """Sets at a similarity of 4/5 or more never differ in more parities than the comparison allows; most others do."""
    rng = np.random.default_rng(size)
    passed = Counter()
    for trial in range(200):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        gone = int(rng.integers(0, max(1, size // 2) + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, gone + 1))).astype(np.uint64)]))
        if len(b):
            odd = int(np.bitwise_count(near.parity(a).view(np.uint64) ^ near.parity(b).view(np.uint64)).sum())
            passed[near.similar(a, b), 9 * odd <= len(a) + len(b)] += 1
    assert passed[True, True] and not passed[True, False]
    assert size not in (30, 300) or passed[False, True] < 0.2 * passed[False, False]


def test_near_copies_of_the_pipeline(spark):
    """Links are exactly the pairs at a Jaccard similarity of 4/5 of five-word shingles, whatever the fingerprints' distance."""
    rng = random.Random(5)
    rows = list(CORPUS)
    for g in range(12):
        base = words(100 + 20 * g, 900 + g, 5000).split()
        for c in range(5):
            edited = list(base)
            for _ in range(rng.randrange(0, 4 + g // 2)):
                edited[rng.randrange(len(edited))] = f"new{rng.randrange(10**6)}"
            rows.append((1000 + 10 * g + c, " ".join(edited)))
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").lower().encode())
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    least = defaultdict(lambda: 10**9)
    for (i, _), g in zip(rows, group):
        least[g] = min(least[g], 10**9 if i is None else i)
    table = docs(spark, rows)
    got = Counter((r["doc_id"], 10**9 if r["component_id"] is None else r["component_id"]) for r in near.near_groups(table).collect())
    assert got == Counter((i, least[g]) for (i, _), g in zip(rows, group))
    assert near.drop_near_copies(table).count() == len(set(group))
    import corpus_pipeline

    one_word = [(1, words(100, 1, 5000)), (2, words(100, 1, 5000).replace(" ", " changed ", 1))]
    assert corpus_pipeline.without_near_copies(spark, docs(spark, one_word), "").count() == 1
    assert near.drop_near_copies(table.limit(0)).count() == 0


def test_common_order_counts_all_documents(spark):
    """The first shingles of each text are of those that no other text has, however many documents there are besides: shingles
    of as few as two documents are counted in all of them."""
    rows = [(i, f"filler{i}") for i in range(1000, 42_000)]
    for pair in range(20):
        shared = words(20, pair, 10**9)
        rows += [(2 * pair + c, f"{shared} {words(20, 100 + 2 * pair + c, 10**9)}") for c in range(2)]
    got = near.prefixes(docs(spark, rows)).where("doc_id < 1000").select("n", "prefix").collect()
    assert [(r["n"], len(r["prefix"])) for r in got] == [(36, 8)] * 40
    assert set(Counter(h for r in got for h in r["prefix"]).values()) == {1}


# --- 10 -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("leaf", [2, 7, 2048])
def test_tree_encoding_is_the_library_s(leaf):
    import public_tokenizers

    coder = bpe.TreeBPE(bpe.default_path(), public_tokenizers.PATTERN, leaf)
    rng = random.Random(leaf)
    texts = [t or "" for _, t in ODD[:8]] + ["it's  \n\n we'll\t\t  x   y", "1234567 " * 40]
    texts += ["".join(rng.choice("ab '\n\t .,1é日　\x1c's") for _ in range(rng.randrange(120))) for _ in range(300)]
    for t in texts:
        ids = coder.encode(t)
        assert ids == coder._encode(t) and coder.decode(ids).decode() == t


def test_encoding_of_tables(spark):
    rows = {r["doc_id"]: r for r in bpe.bpe_digests(docs(spark, CORPUS)).collect()}
    for i, t in dict(CORPUS).items():
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert rows[2]["n_tokens"] == 0 and rows[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.bpe_encode(docs(spark, CORPUS).limit(0)).count() == 0
    assert all(r["decoded"] == (dict(CORPUS)[r["doc_id"]] or "") for r in bpe.bpe_encode(docs(spark, CORPUS)).collect())


# --- the pipeline ---------------------------------------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled(120)
    rows = [(i, f"{t} {words(60, i)}") for i, t in rows] + [(500, rows[1][1] + " " + words(60, 1)), (501, None), (502, "")]
    items = [(0, words(30, 7)), (1, "never there at all in any of these documents")]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = table
        out = stage(spark, table, str(tmp_path))
        table = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r["doc_id"] for r in table.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert table.columns == before.columns
    ids = {i for i, _ in rows}
    toxic = {i for i, _, y in labels if y}
    assert len(toxic & seen["toxicity"]) <= 3 and not ids - toxic - seen["toxicity"]
    assert 500 not in seen["exact dedup"] and len(seen["exact dedup"] & {501, 502}) == 1
    assert 7 not in seen["decontamination"] and seen["near dedup"] - seen["decontamination"] == {7} and seen["byte-level BPE"] < ids
    got = {r["doc_id"]: r["decoded_sha256"] for r in table.collect()}
    assert got == {i: hashlib.sha256((dict(rows)[i] or "").encode()).hexdigest() for i in seen["byte-level BPE"]}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(got)


def test_factors_name_their_sources(spark):
    rng = random.Random(3)
    passages = [words(rng.randrange(40, 140), 800 + i) for i in range(4)]
    rows = [(i, f"{words(rng.randrange(60), i)} {rng.choice(passages)} {words(rng.randrange(60), 50 + i)} {rng.choice(passages)}") for i in range(20)]
    rows += [(100, "For " * 60), (101, None)]
    text = {i: (t or "").split() for i, t in rows}
    covered = defaultdict(set)
    for f in rlz.factors(docs(spark, rows)).collect():
        a, b = (text[d][s : s + f["words"]] for d, s in ((f["doc_id"], f["start"]), (f["source_doc_id"], f["source_start"])))
        assert a == b and len(a) == f["words"] >= 35
        assert (f["doc_id"], f["start"]) != (f["source_doc_id"], f["source_start"])
        covered[f["doc_id"]].update(range(f["start"], f["start"] + f["words"]))
    assert {(d, len(covered[d])) for d in text} == {(d, n) for d, _, n, _ in plain_removal(rows, 35)}
