import html as entities
import random
import re

import pyarrow.parquet as pq
import pytest

from trustloom.llm import html as H

PAGES = "page_id long, url string, html string, id string, host int, text string, tree string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], PAGES)


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a</p><p>b", "a b"), ("<p>a<b>b</b>c<br>d</p>", "abc d"),
    ("<p><b>one.<br><p>two</p>", "one. two"), ("<p>&amp;&lt;b&gt; &eacute;&#233;&#x1F600; &nbsp;x &unknown; &amp", "&<b> éé😀 x &unknown; &"),
    ("<nav>menu</nav><p>t</p><footer>f</footer>", "t"), ("<body><article><header><h1>T</h1></header><p>x</p></article><p>out</p>", "T x"),
    ("<header>site</header><main><p>in</p><aside>no</aside></main><div>out</div>", "in"),
    ("<script>var t='</p>';</script><p>a</p><style>p{}</style><!-- <p>no</p> --><p>b", "a b"), ("<p>a<!-- open", "a"),
    ("<div class='cookie-notice'>ok?</div><div id=sideBar>s</div><p class=text>t</p>", "t"),
    ("<article><p>t</p><section class='comments'><p>c</p></section><form><p>f</p></form></article>", "t"),
    ("<div><div class=ad>buy</div>real <span hidden>no</span> text</div>", "real text"),
    ("<ul><li><a href=1>x</a><li><a href=2>y</a><li><a href=3>z</a></ul><p>t</p>", "t"),
    ("<ul><li>first<li>second<li>third</ul>", "first second third"), ("a < b > c <3", "a < b > c <3"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<p title=\"a>b\">t</p>", "t"), ("<p title='x>t</p><p>u</p>", "t u"),
    ("<p>t</p><p", "t"), ("</div></p>t</b>", "t"), ("<b><p>x</b>y</p>", "xy"), ("<textarea><p>no</textarea><p>t", "t"),
    ("<article class='comment'>no</article><article><p>t</p></article>", "t"), ("<div role=navigation>no</div>t", "t"),
    ("<article></article><p>t</p>", "t"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("x" * 300000, "x" * 300000),
])
def test_extract(source, want):
    assert H.extract(source) == want


def brute_matching(a, b):
    """Size of the largest matching by its definition."""
    if H._label(a) != H._label(b):
        return 0
    if isinstance(a, H.Leaf):
        return 1
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + brute_matching(x, y))
    return 1 + best[-1][-1]


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(0, 4)):
        tag = rng.choice(["div", "p", "ul", "section"])
        out.append(f"<{tag}>{rng.choice(['a', 'b', ''])}{random_page(rng, depth + 1) if depth < 3 and tag != 'p' else ''}</{tag}>")
    return "".join(out)


def test_tree_matching_brute():
    rng = random.Random(4)
    for _ in range(200):
        a, b = H.parse(random_page(rng)), H.parse(random_page(rng))
        assert H.Matcher().weight(a, b) == brute_matching(a, b)
        ref, leaves = H.from_bytes(H.to_bytes(b))
        pairs = list(H.Matcher().pairs(a, ref))
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        assert all(any(y is z for z in leaves) for _, y in pairs)


def page(k, extra=""):
    return (f"<html><body><div class=top>Site name</div><div>Read our paper daily</div><div><p>Story {k} begins</p><p>and {k} ends</p>{extra}</div>"
            f"<div>All rights with us</div></body></html>")


def test_template_is_found(spark):
    rows = [(k, "http://a.example/x", page(k, f"<p>more {k}</p>" * (k % 3))) for k in range(12)]
    rows += [(100 + k, "http://a.example/y", page(3)) for k in range(50)]  # copies of one page say nothing about the template
    rows += [(200, "https://A.EXAMPLE:80/z", page(999)), (201, "http://b.example/", page(1)), (202, None, page(2)), (203, "junk", None),
             (None, "http://a.example/q", page(5)), (204, "http://c.example", "")]
    got = {(r.id, r.url): r for r in H.main_text(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert got[k, "http://a.example/x"].text == f"Story {k} begins and {k} ends" + f" more {k}" * (k % 3)
    assert got[200, "https://A.EXAMPLE:80/z"].text == "Story 999 begins and 999 ends"
    assert got[149, "http://a.example/y"].text == "Story 3 begins and 3 ends"
    assert got[None, "http://a.example/q"].text == "Story 5 begins and 5 ends"
    assert got[201, "http://b.example/"].text.startswith("Site name Read our") and got[203, "junk"].text == got[204, "http://c.example"].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert H.main_text(frame(spark, [])).count() == 0


def test_copies_of_an_article_stay(spark):
    """A host whose pages are copies and near copies of one article keeps the article."""
    rows = [(k, "http://a.example/x", f"<nav>n</nav><article><h1>T</h1><p>Same words</p><p>{'x' if k % 5 else k}</p></article>") for k in range(40)]
    for r in H.main_text(frame(spark, rows)).collect():
        assert r.text.startswith("T Same words")


def brute_article(source):
    found = re.search(r"<article>(.*?)</article>", source, re.S)
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", found[1]))
    texts = [" ".join(entities.unescape(re.sub(r"</?b>", "", p)).split()) for p in parts]
    return " ".join(t for t in texts if t)


def test_given_pages(spark):
    rows = {r["page_id"]: brute_article(r["html"]) for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()}
    got = H.main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert {r.id: r.text for r in got} == rows
