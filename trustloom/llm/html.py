"""Main text of web pages by wrapper induction.

A page is parsed into a tree of block elements whose leaves are runs of text. For every host one page's tree serves as
reference (the one with the smallest hash); simple tree matching aligns every page of the host with it. Leaves of the
reference that show the same text on nearly all different pages of the host are template, the others are slots. A page's
main text is what its slots, and its blocks without a partner in the reference, hold, less what tags and class names
declare to be something else than the article.

Statistics cover all pages; equal pages count once. What is gathered per host is one small tree and two counts per leaf, so a
host with very many pages is no large group.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trustloom.llm.common import small, stored

# Element kinds of HTML, and names that declare what a part of a page is.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th
thead tr ul caption""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("""aside audio button canvas datalist dialog footer form head iframe input map math menu nav noembed noframes
noscript object option script search select style svg template textarea title video""".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo
promos promotion banner banners cookie cookies consent gdpr notice notices notification notifications popup popups modal overlay
sidebar sidebars aside rail menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar
comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe
subscription login signin signup search widget widgets pagination pager alert alerts skip copyright disclaimer""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
ARTICLE_WORDS = frozenset("article entry post content story".split())
SEPARATE = frozenset("comment comments reply replies respond ad ads advert sponsored promo related".split())
# A start tag in the first place ends an open element of the second.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
          "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/[^a-zA-Z>][^>]*+(?:>|\Z)|/>|(/?)([a-zA-Z][^\s/>]*+)"""
                  r"""((?:[^>"']++|(?<==)"[^"]*+"|(?<==)'[^']*+'|["'])*+)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"(?=(?<![A-Za-z])([A-Za-z]+))?([A-Z]?[a-z]+|[A-Z]+(?![a-z]))")  # whole runs of letters, and their humps
_TELLING = re.compile(r"(?i)\b(?:class|id|role|hidden|style)\b")
_RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*>?") for name in RAW}
MIN_PAGES, SHARE = 4, 0.8  # outside an article element; inside one a template needs more evidence
ARTICLE_PAGES, ARTICLE_SHARE = 20, 0.95
MENU_LINKS, MENU_SHARE = 3, 0.8


class Node:
    """A block element: label, children (nodes and leaves), whether it is declared not to be article, whether it is one."""

    __slots__ = ("label", "tag", "kids", "off", "article", "shape", "size")

    def __init__(self, tag: str, label: str, off: bool, article: bool):
        self.tag, self.label, self.kids, self.off, self.article = tag, label, [], off, article


class Leaf:
    """A run of text inside one block, with the number of its characters that are links."""

    __slots__ = ("text", "links", "shape", "size")

    def __init__(self, text: str, links: int):
        self.text, self.links, self.shape, self.size = text, links, 1, 1


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


@lru_cache(50_000)
def _kind(tag: str, source: str, in_article: bool) -> tuple[str, bool, bool]:
    """Label of an element, whether it is declared not to be article, and whether it is one."""
    attributes = _attributes(source)
    words = {w.lower() for key in ("class", "id") for m in _NAME.findall(attributes.get(key, "")) for w in m}
    role = attributes.get("role", "").lower()
    style = attributes.get("style", "").replace(" ", "").lower()
    off = (tag in DROPPED or role in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
           or "display:none" in style)
    if tag in ("article", "main"):
        off = off or bool(words & SEPARATE)
    elif tag not in ("html", "body"):
        titled = "header" in words and bool(words & ARTICLE_WORDS)
        off = off or bool((words - {"header"} if titled or tag == "header" else words) & NAMES) or (tag == "header" and not in_article)
    label = tag + "".join(sorted("." + w for w in attributes.get("class", "").lower().split()))
    return label, off, tag in ("article", "main") or role in ("article", "main")


def parse(source: str | None) -> Node:
    """Tree of a page. Bad markup never fails: unknown ends are skipped, open elements end with their parents."""
    source = source or ""
    root = Node("#page", "#page", False, False)
    stack: list[tuple[str, Node]] = [("#page", root)]  # every open element with the block it belongs to
    text: list[str] = []
    links = depth_a = articles = 0

    def flush():
        nonlocal links
        if text:
            run = " ".join(entities.unescape("".join(text)).split())
            if run:
                stack[-1][1].kids.append(Leaf(run, min(links, len(run))))
            text.clear()
        links = 0

    def close(at: int):
        nonlocal depth_a, articles
        while len(stack) > at:
            tag, node = stack.pop()
            depth_a -= tag == "a"
            if node is not stack[-1][1]:
                articles -= node.article

    at, end = 0, len(source)
    while at < end:
        tag = _TAG.search(source, at)
        part = source[at:tag.start() if tag else end]
        if part:
            text.append(part)
            links += len(part) if depth_a else 0
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name or not tag[0].endswith(">"):
            continue
        if tag[1]:
            if name == "p" and not any(t == "p" for t, _ in stack):
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if name in BLOCKS or any(n is not stack[i - 1][1] for _, n in stack[i:]):
                        flush()
                    close(i)
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an inline end does not end blocks
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in RAW:
            stop = _RAW_END[name].search(source, at)
            at = stop.end() if stop else end
            if name in ("textarea", "title"):
                text.append(" ")
            continue
        block = name in BLOCKS
        if block:
            flush()
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ENDS[name]:
                    flush()
                    close(i)
                    break
                if stack[i][0] in LIMITS[name]:
                    break
        if name in VOID:
            continue
        label, off, article = _kind(name, tag[3] if _TELLING.search(tag[3]) else "", articles > 0)
        if block or off or article:
            flush()
            node = Node(name, label, off, article)
            stack[-1][1].kids.append(node)
            articles += article
            stack.append((name, node))
        else:
            stack.append((name, stack[-1][1]))
        depth_a += name == "a"
    flush()
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Size of every subtree, and a hash of its shape (labels without texts)."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [k for k in n.kids if isinstance(k, Node)]
    for n in reversed(order):
        n.size = 1 + sum(k.size for k in n.kids)
        n.shape = hash((zlib.crc32(n.label.encode()), *[k.shape for k in n.kids]))


def _label(n) -> str:
    return n.label if isinstance(n, Node) else "#text"


class Matcher:
    """Simple tree matching: the largest number of node pairs that keeps labels, parents and the order of children."""

    def __init__(self):
        self.weights = {}

    def weight(self, a, b) -> int:
        if a.shape == b.shape:
            return a.size
        if _label(a) != _label(b):
            return 0
        key = id(a), id(b)
        if key not in self.weights:
            self.weights[key] = 1 + self._table(a.kids, b.kids)[0]
        return self.weights[key]

    def _table(self, a: list, b: list):
        """Best weight of two lists of children; equal shapes at both ends are paired at once, the table is for the rest."""
        i, total = 0, 0
        while i < len(a) and i < len(b) and a[i].shape == b[i].shape:
            total += a[i].size
            i += 1
        m, n = len(a), len(b)
        while m > i and n > i and a[m - 1].shape == b[n - 1].shape:
            m, n = m - 1, n - 1
            total += a[m].size
        rows = [[0] * (n - i + 1)]
        for x in a[i:m]:
            last, row = rows[-1], [0]
            for k, y in enumerate(b[i:n]):
                w = self.weight(x, y)
                row.append(max(last[k + 1], row[-1], last[k] + w if w else 0))
            rows.append(row)
        return total + rows[-1][-1], i, m, n, rows

    def pairs(self, a, b):
        """Matched leaves (of a, of b) of two matched nodes."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if isinstance(a, Leaf):
                yield a, b
                continue
            _, i, m, n, rows = self._table(a.kids, b.kids)
            todo += zip(a.kids[:i], b.kids[:i])
            todo += zip(a.kids[m:], b.kids[n:])
            p, q = m, n
            while p > i and q > i:
                w = self.weight(a.kids[p - 1], b.kids[q - 1])
                if w and rows[p - i][q - i] == rows[p - i - 1][q - i - 1] + w:
                    p, q = p - 1, q - 1
                    todo.append((a.kids[p], b.kids[q]))
                elif rows[p - i][q - i] == rows[p - i - 1][q - i]:
                    p -= 1
                else:
                    q -= 1


def _leaves(root: Node):
    """Leaves in page order with whether they are inside an article, and whether something declares them away."""
    todo = [(root, False, False)]
    while todo:
        n, inside, off = todo.pop()
        if isinstance(n, Leaf):
            yield n, inside, off
            continue
        off = off or n.off or (not inside and _menu(n))
        inside = inside or n.article and not off
        todo += [(k, inside, off) for k in reversed(n.kids)]


def _menu(n: Node) -> bool:
    """Whether a list outside an article is a menu: some items, nearly all of their text links."""
    if n.tag not in ("ul", "ol", "dl"):
        return False
    texts, todo = [], list(n.kids)
    while todo:
        k = todo.pop()
        if isinstance(k, Leaf):
            texts.append(k)
        else:
            todo += k.kids
    return len(texts) >= MENU_LINKS and sum(k.links for k in texts) >= MENU_SHARE * sum(len(k.text) for k in texts)


def _print(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def to_bytes(root: Node) -> bytes:
    """A reference tree as bytes: labels and hashes of the texts."""
    def plain(n):
        return _print(n.text) if isinstance(n, Leaf) else (n.label, [plain(k) for k in n.kids])

    return zlib.compress(pickle.dumps(plain(root)), 1)


def from_bytes(data: bytes) -> tuple[Node, list[Leaf]]:
    """The tree of a reference, and its leaves in order; a leaf's ``text`` is the hash."""
    leaves: list[Leaf] = []

    def tree(x):
        if isinstance(x, int):
            leaves.append(Leaf(x, 0))
            return leaves[-1]
        n = Node(x[0].split(".")[0], x[0], False, False)
        n.kids = [tree(k) for k in x[1]]
        return n

    root = tree(pickle.loads(zlib.decompress(data)))
    _measure(root)
    return root, leaves


def _trimmed(root: Node, depth: int = 60) -> Node:
    """Without elements deeper than any real template, so that recursion over a hostile page ends."""
    todo = [(root, 0)]
    while todo:
        n, d = todo.pop()
        if d >= depth:
            n.kids = [k for k in n.kids if isinstance(k, Leaf)]
        todo += [(k, d + 1) for k in n.kids if isinstance(k, Node)]
    _measure(root)
    return root


def extract(source: str | None, reference: tuple[Node, list[Leaf]] | None = None, template: frozenset[int] = frozenset(),
            fixed: frozenset[int] = frozenset()) -> str:
    """Main text of one page. ``template`` and ``fixed``: leaves of the reference that are template outside and inside of
    article elements."""
    root = parse(source)
    same: dict[int, int] = {}
    if reference and (template or fixed):
        place = {id(leaf): i for i, leaf in enumerate(reference[1])}
        same = {id(a): place[id(b)] for a, b in Matcher().pairs(root, reference[0]) if _print(a.text) == b.text}
    found = list(_leaves(root))
    articles = any(inside and not off for _, inside, off in found)
    return " ".join(leaf.text for leaf, inside, off in found if not off and (inside or not articles)
                    and same.get(id(leaf), -1) not in (fixed if inside else template))


def host_of(url: str):
    """Host of a URL column in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def references(pages: DataFrame) -> DataFrame:
    """``host, tree``: the tree of the page with the smallest hash per host; tasks pre-select, so a host costs a row per task."""

    def run(batches):
        best: dict[str, tuple[int, str]] = {}
        for batch in batches:
            for host, h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if host not in best or h < best[host][0]:
                    best[host] = h, source.as_py()
        hosts = list(best)
        for s in range(0, len(hosts), 500):
            part = hosts[s:s + 500]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([best[h][0] for h in part], pa.int64()),
                 pa.array([to_bytes(_trimmed(parse(best[h][1]))) for h in part], pa.binary())], ["host", "hash", "tree"])

    return pages.select("host", "hash", "html").mapInArrow(run, "host string, hash long, tree binary").groupBy("host").agg(
        F.min_by("tree", F.struct("hash", "tree")).alias("tree"))


def matches(pages: DataFrame) -> DataFrame:
    """``host, leaf, page, same``: for every page (by hash) the leaves of its host's reference that it has, and whether the text is the same."""

    def run(batches):
        trees, done = {}, set()
        for batch in batches:
            out = []
            for host, h, source, tree in zip(*[c.to_pylist() for c in batch.columns]):
                if (host, h) in done:
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add((host, h))
                if host not in trees:
                    if len(trees) > 2_000:
                        trees.clear()
                    root, leaves = from_bytes(tree)
                    trees[host] = root, {id(x): i for i, x in enumerate(leaves)}
                root, place = trees[host]
                out += [(host, place[id(b)], h, _print(a.text) == b.text) for a, b in Matcher().pairs(parse(source), root)]
            host, leaf, h, same = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(leaf, pa.int32()), pa.array(h, pa.int64()),
                                              pa.array(same, pa.bool_())], ["host", "leaf", "page", "same"])

    return pages.select("host", "hash", "html", "tree").mapInArrow(run, "host string, leaf int, page long, same boolean")


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, tree, template, fixed`` per host: the reference tree and the leaves of it that are template."""
    trees = stored(references(pages), "references")
    with_tree = pages.join(small(trees, trees.count()), "host")
    found = matches(with_tree).distinct().groupBy("host", "leaf").agg(
        F.count("*").alias("n"), F.count_if("same").alias("same"))
    template = (F.col("n") >= MIN_PAGES) & (F.col("same") >= F.col("n") * SHARE)
    fixed = (F.col("n") >= ARTICLE_PAGES) & (F.col("same") >= F.col("n") * ARTICLE_SHARE)
    leaves = found.where(template).groupBy("host").agg(
        F.collect_set("leaf").alias("template"), F.collect_set(F.when(fixed, F.col("leaf"))).alias("fixed"))
    return stored(trees.join(leaves, "host"), "wrappers")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row: the article's blocks in page order, joined by one space.

    Character references are decoded, white space inside a block becomes one space. Null and empty pages give an empty
    text. Pages without a host form one host of their own. Rows that repeat come out as often as they come in; an empty
    table gives no rows.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    source = source.withColumns({"host": host_of("url"), "hash": F.xxhash64(F.coalesce("html", F.lit("")))})
    made = wrappers(source)
    rows = source.join(small(made, made.count()), "host", "left")

    def run(batches):
        known = {}
        for batch in batches:
            out = []
            for html, host, tree, template, fixed in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                if tree is None:
                    out.append(extract(html))
                    continue
                if host not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[host] = from_bytes(tree), frozenset(template), frozenset(fixed)
                out.append(extract(html, *known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.select("id", "url", "html", "host", "tree", "template", "fixed").mapInArrow(run, f"id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
