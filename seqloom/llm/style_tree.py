"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. A node is a place in the layout: the path of tags with their classes (and, for
layout elements, their number among siblings of that name; levels below ``DEPTH`` count as the one at ``DEPTH``). Over the
host's pages each node has a distribution of presentations (the sequence of its children) and one of contents (its own text),
whose entropies are scaled to 1 where every page differs.

* A branch's importance is the larger of its presentation's entropy and the mean entropy of the contents below it, by words.
  Branches under ``LOW`` say the same on all pages: they are noise and are cut.
* The deepest branch that has more than half of the host's words and whose presentation's entropy is ``HIGH`` or more is the
  content: it is laid out anew on each page, and nothing in it is cut by entropy. What stands beside it is noise, be it ever so
  different from page to page.

Names are a prior where entropy cannot tell. Elements, roles and class or id words for noise (nav, footer, form, ad, cookie,
comments, ...) have importance 0, as reader comments differ from page to page like an article does. Words that are noise at
times only (related, share, ...) and ``header`` count outside content. Text in ``article`` and ``main`` is content and is never
cut by entropy, as an article may be copied to many pages; headings, sections and paragraphs in it are not judged by words.

Text: character references decoded, white space in a block made one space, trimmed, blocks joined by one space. If a page has
text in content, only that is taken.

Defined cases: null html is an empty page with empty text; pages with a null url have one host in common; tags left open end
with their parents, and one that is never closed by ``>`` is text; comments, scripts, styles, titles and the like are never
text; repeated rows each give a row; branches on fewer than ``PAGES`` pages or than ``SHARE`` of the host's (which bounds
their number by the size of a page) are never cut by entropy; other columns are not read. All steps take time in proportion
to a page's length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_split, only, slices, stored

LOW = 0.3
HIGH = 0.5
MAIN = 0.5
PAGES = 4
SHARE = 0.02
DEPTH = 64

_text = re.compile(r"[^<]+")
_name = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_unquoted = re.compile(r"[^>\"']*")
_attribute = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_words = re.compile(r"[a-z]+|[0-9]+", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
_ends = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LAYOUT = frozenset("div section table ul ol dl header aside nav footer form main article".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTENT = frozenset("article main".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p section blockquote figure figcaption pre table".split())
NOISE_TAGS = frozenset("nav footer aside form button select dialog menu label input".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent notice notices popup modal overlay comment comments disqus newsletter signup login pagination pager".split()
)
AT_TIMES = frozenset("promo promotion alert discussion respond share sharing social related recommended subscribe subscription toolbar widget".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) - (1 << 63)


class Node:
    __slots__ = ("tag", "name", "path", "above", "noise", "main", "children", "numbers")

    def __init__(self, tag: str, name: str, path: int, above: tuple[int, ...], noise: bool, main: bool):
        self.tag, self.name, self.path, self.above, self.noise, self.main, self.children, self.numbers = tag, name, path, above, noise, main, [], {}


ROOT = _hash("root")


class Ends:
    """Where tags end, each character looked at once: quotes that are never closed, or hide all ends, do not count."""

    def __init__(self, page: str):
        self.page, self.quoted = page, True
        self.last = {q: page.rfind(q) for q in "\"'>"}

    def find(self, at: int) -> int:
        page, i = self.page, at
        if at > self.last[">"]:
            return -1
        while self.quoted:
            i = _unquoted.match(page, i).end()
            if i == len(page):
                self.quoted = False
            elif page[i] == ">":
                return i
            else:
                i = i + 1 if i >= self.last[page[i]] else page.index(page[i], i + 1) + 1
        return page.find(">", at)


def named(tag: str, attributes: str, up: Node) -> tuple[bool, bool]:
    """Whether an element's name says that it is noise, or content."""
    found = {k.lower(): a or b or c or "" for k, a, b, c in _attribute.findall(attributes)} if "=" in attributes else {}
    role = found.get("role", "").lower()
    content = tag in CONTENT or role in CONTENT
    if tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in attributes.lower().split() or (tag == "header" and not up.main):
        return True, content
    if tag in ("html", "body") or (up.main and tag in PROSE):
        return False, content
    words = {w.lower() for w in _words.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    return not words.isdisjoint(NOISE_WORDS) or (not up.main and not words.isdisjoint(AT_TIMES)), content


def styled(tag: str, attributes: str) -> str:
    found = re.search(r"(?i)(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", attributes) if attributes else None
    classes = sorted((found[1] or found[2] or found[3] or "").lower().split()) if found else []
    return ".".join([tag, *classes])


def walk(page: str, names: bool = True) -> Iterator[tuple[str, Node, str]]:
    """('open', node, ''), ('text', node, decoded text), ('break', node, '') and ('close', node, '') in page order."""
    root = Node("", "", ROOT, (), False, False)
    stack, open_ = [root], Counter()
    ends, at = Ends(page), 0

    def closed() -> tuple[str, Node, str]:
        node = stack.pop()
        open_[node.tag] -= 1
        return "close", node, ""

    while at < len(page):
        if page[at] != "<":
            m = _text.match(page, at)
            at = m.end()
            yield "text", stack[-1], entities.unescape(m[0]) if "&" in m[0] else m[0]
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        m = _name.match(page, at)
        if not m and page[at + 1 : at + 2] not in ("!", "?"):
            yield "text", stack[-1], "<"
            at += 1
            continue
        end = ends.find(m.end()) if m else page.find(">", at) if at < ends.last[">"] else -1
        if end < 0:
            rest = page[at:]
            yield "text", stack[-1], entities.unescape(rest) if "&" in rest else rest
            break
        attributes, at = (page[m.end() : end] if m else ""), end + 1
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag]:
                while stack[-1].tag != tag:
                    yield closed()
                yield closed()
            elif tag not in INLINE:
                yield "break", stack[-1], ""
            continue
        if tag in VOID:
            yield "break", stack[-1], ""
            continue
        if tag in RAW:
            found = _ends[tag].search(page, at)
            at = found.end() if found else len(page)
            continue
        drop = 0
        if tag in CLOSES_P and open_["p"]:
            drop = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p")
        elif tag in SIBLINGS and any(open_[x] for x in SIBLINGS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    drop = i
                elif stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        while drop and len(stack) > drop:
            yield closed()
        up, name = stack[-1], styled(tag, attributes)
        noise, main = named(tag, attributes, up) if names else (False, False)
        noise |= up.noise
        up.children.append(name)
        path, above = up.path, up.above
        if len(above) < DEPTH:
            number = up.numbers.get(name, 0) if tag in LAYOUT else 0
            if tag in LAYOUT:
                up.numbers[name] = number + 1
            path, above = _hash(up.path, name, number), (*above, up.path)
        node = Node(tag, name, path, above, noise, (up.main or main) and not noise)
        if not attributes.endswith("/"):
            stack.append(node)
            open_[tag] += 1
            yield "open", node, ""
    while len(stack) > 1:
        yield closed()
    yield "close", root, ""


def observed(page: str, names: bool = True) -> Iterator[tuple[int, tuple[int, ...], str, int, int]]:
    """(path, the paths above it, kind, value, words): children's presentation ('p') and own content ('c') of nodes outside noise."""
    texts: list[list[str]] = [[]]
    for kind, node, text in walk(page, names):
        if kind == "open":
            texts.append([])
        elif kind == "text" and not node.noise and not text.isspace():
            texts[-1].append(text)
        elif kind == "close":
            own = "".join(texts.pop()).split()
            if not node.noise and node.children:
                yield node.path, node.above, "p", _hash(*node.children), 0
            if own:
                yield node.path, node.above, "c", _hash(" ".join(own)), len(own)


def main_text(page: str, content: frozenset[int] = frozenset(), low: frozenset[int] = frozenset(), names: bool = True) -> str:
    """The text of the page without noise: that in content only, if there is any."""
    inside, outside = [], []
    cut = core = 0
    for kind, node, text in walk(page, names):
        if kind == "text":
            if not node.noise and (node.main or core or not cut):
                (inside if node.main or core else outside).append(text)
            continue
        if kind != "break":
            step = 1 if kind == "open" else -1
            cut += step * (node.path in low)
            core += step * (node.path in content)
        if node.tag not in INLINE or kind == "break":
            inside.append(" ")
            outside.append(" ")
    return " ".join("".join(inside).split()) or " ".join("".join(outside).split())


def host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def branches(pages: DataFrame, names: bool = True) -> DataFrame:
    """host, path, above, entries, words, presentation and importance of each branch of the hosts' trees.

    Counts are added up in the tasks and across them; no host's tree is brought together in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                seen, words = Counter(), Counter()
                for site, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    for key, n in {(site, *x[:4]): x[4] for x in observed(page or "", names)}.items():
                        seen[key] += 1
                        words[key] += n
                cols = list(zip(*((*k, n, words[k]) for k, n in seen.items()))) or [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "path", "above", "kind", "value", "n", "words"])

    rows = pages.mapInArrow(run, "host string, path long, above array<long>, kind string, value long, n long, words long")
    counted = rows.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.first("above").alias("above"))
    n = F.col("n").cast("double")
    totals = counted.groupBy("host", "path", "kind").agg(F.sum("n").alias("entries"), F.sum(n * F.log(n)).alias("s"), F.sum("words").alias("words"), F.first("above").alias("above"))
    entropy = F.when(F.col("entries") > 1, (F.log("entries") - F.col("s") / F.col("entries")) / F.log("entries")).otherwise(1.0)
    own = F.struct("path", "above", "entries", F.when(F.col("kind") == "p", entropy).alias("presentation"))
    # what a node's contents add to its own branch and to those above it
    shares = totals.select("host", "kind", "words", (F.col("words") * entropy).alias("weighed"), own.alias("own"))
    spread = shares.withColumn("branch", F.explode(F.when(F.col("kind") == "c", F.concat("own.above", F.array("own.path"))).otherwise(F.array("own.path"))))
    mine = F.when(F.col("branch") == F.col("own.path"), F.col("own"))
    found = spread.groupBy("host", F.col("branch").alias("path")).agg(
        F.sum("words").alias("words"), F.sum("weighed").alias("weighed"), F.first(mine["above"], True).alias("above"), F.max(mine["entries"]).alias("entries"), F.max(mine["presentation"]).alias("presentation")
    )
    mean = F.when(F.col("words") > 0, F.col("weighed") / F.col("words"))
    return found.select("host", "path", "above", "entries", "words", "presentation", F.greatest("presentation", mean).alias("importance"))


def trees(pages: DataFrame, low: float = LOW, high: float = HIGH, least: int = PAGES, names: bool = True) -> DataFrame:
    """host, pages (their number), content array<long>, low array<long>: the branches of each host that are content or cut."""
    found = stored(branches(pages, names), "branches")
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(found.where(F.col("path") == ROOT).select("host", F.col("words").alias("all_words")), "host", "left")
    often = found.join(stored(hosts, "hosts"), "host").where((F.col("path") != ROOT) & (F.col("entries") >= least) & (F.col("entries") >= SHARE * F.col("pages")))
    is_content = (F.col("presentation") >= high) & (F.col("words") > MAIN * F.col("all_words"))
    is_low = F.col("importance") < low
    listed = often.where(is_content | is_low).groupBy("host").agg(
        F.collect_list(F.when(is_content, F.struct("path", "above"))).alias("content"), F.collect_list(F.when(is_low, F.struct("path", "above"))).alias("low")
    )
    paths = lambda x: F.transform(x, lambda y: y["path"])
    inner = F.filter("content", lambda x: ~F.exists("content", lambda y: F.array_contains(y["above"], x["path"])))
    outer = F.filter("low", lambda x: ~F.arrays_overlap(x["above"], paths(F.col("low"))))
    return hosts.select("host", "pages").join(listed.select("host", paths(inner).alias("content"), paths(outer).alias("low")), "host", "left")


def extract(pages: DataFrame, low: float = LOW, high: float = HIGH, least: int = PAGES, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each page. Without ``names`` entropy alone decides."""
    sited = only(pages, "page_id", "url", "html").withColumn("host", host())
    known = stored(trees(sited.select("host", "html"), low, high, least, names), "trees")
    joined = join_split(sited, known, "host", "pages", "page_id", "url").select("page_id", "url", "html", "content", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                columns = [part.column(k).to_pylist() for k in ("html", "content", "low")]
                texts = [main_text(p or "", frozenset(c or ()), frozenset(x or ()), names) for p, c, x in zip(*columns)]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
