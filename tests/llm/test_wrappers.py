"""Wrappers: inference against brute-force matching, what the wrapper decides, and pages that are hard to read."""

import html
import random
import re
import time

import numpy as np
import pytest

pytest.importorskip("noticeflow.llm")

from noticeflow.llm import html_tree, html_wrappers as hw  # noqa: E402


def text_of(*pages):
    """The texts of pages of one host, without Spark: one wrapper, matching, statistics."""
    wrapper = hw.Wrapper(hw.spelled(hw.joined([hw.folded_tree(html_tree.parsed(p)[0]) for p in pages])))
    placed, known = [hw.placed(p, wrapper) for p in pages], {}
    for blocks in placed:
        by = {}
        for s, b in blocks:
            by.setdefault(s, []).append(b)
        whole = tuple(b.text for _, b in blocks)
        for s, bs in by.items():
            at = known.setdefault(s, [set(), set(), 0, 0])
            at[0].add(tuple(b.text for b in bs))
            at[1].add(whole)
            at[2] += sum(len(b.text) for b in bs)
            at[3] += sum(b.linked for b in bs)
    bits = {s: hw.LONE * (len(d) == 1) + hw.FIXED * (len(d) > 1 and len(t) == 1) + hw.LINKED * (2 * k > n) for s, (t, d, n, k) in known.items() if s >= 0}
    return [hw.main_text([(s, b.text, b.mark, b.kind, b.linked) for s, b in blocks], bits) for blocks in placed]


def stream(node):
    return f"<{node.label}>" + "#" * node.slot + "".join(map(stream, node.kids)) + "</>"


def pattern(node):
    inner = "#?" * node.slot + "".join(map(pattern, node.kids))
    made = inner if node.label.startswith("(") else f"{re.escape(f'<{node.label}>')}{inner}</>"
    return f"(?:{made})" + ("*" if node.many and node.maybe else "+" if node.many else "?" if node.maybe else "")


def random_page(rng):
    def some(depth):
        out = ""
        for _ in range(rng.randint(0, 3)):
            tag = rng.choice(["p", "h2", "div", "section", "ul", 'div class="x"'])
            inner = some(depth + 1) if tag not in ("p", "h2", "ul") and depth < 3 else "".join(f"<li>i{k}</li>" for k in range(rng.randint(1, 3))) if tag == "ul" else f"t{rng.randint(0, 9)}"
            out += f"<{tag}>{inner}</{tag.split()[0]}>" * rng.choice([1, 1, 1, 2, 3])
        return out

    return f"<body>{some(0)}</body>"


def test_wrapper_accepts_its_pages():
    """The inferred expression matches the tag stream of every page of its host, by Python's own regular expressions."""
    rng, placed, blocks = random.Random(3), 0, 0
    for _ in range(60):
        pages = [random_page(rng) for _ in range(rng.randint(1, 5))]
        made = hw.joined([hw.folded_tree(html_tree.parsed(p)[0]) for p in pages])
        wrapper = hw.Wrapper(hw.spelled(made))
        for p in pages:
            assert re.fullmatch(pattern(made), stream(html_tree.parsed(p)[0]))
            found = hw.placed(p, wrapper)
            placed += sum(s >= 0 for s, _ in found)
            blocks += len(found)
    assert placed > 0.95 * blocks


def test_expression():
    a, b = (hw.folded_tree(html_tree.parsed(p)[0]) for p in ("<div><h1>a</h1><p>b<p>c</div>", "<div><p>b</p><ul><li>x<li>y</ul></div>"))
    assert hw.expression(hw.merged(a, b)) == "<div>(<h1>#</>)? (<p>#</>)+ (<ul>(<li>#</>)+</>)?</>"
    wide = "".join(f"<{t}>x</{t}>" for t in ("h2", "p", "ul", "h3", "dl", "pre", "h4", "table")) * 3
    assert hw.expression(hw.folded_tree(html_tree.parsed(f"<div>{wide}</div>")[0])).endswith(")+</>")


def test_wrapper_decides():
    """The same element is main text or not by what the host's other pages have in its place."""
    page = lambda i, first: f"<body><p>{first}</p><h2>Title {i}</h2><p>body {i}</p><p>more {i}</p></body>"
    assert text_of(*(page(i, "Join us today") for i in range(3))) == [f"Title {i}\nbody {i}\nmore {i}" for i in range(3)]
    assert text_of(*(page(i, f"lead {i}") for i in range(3)))[1] == "lead 1\nTitle 1\nbody 1\nmore 1"
    assert text_of(page(0, "Join us today")) == ["Join us today\nTitle 0\nbody 0\nmore 0"]
    boxed = lambda i, box: f'<article><h1>T{i}</h1><div class="promo-box">{box}</div><p>b{i}</p></article>'
    assert text_of(*(boxed(i, "Buy now") for i in range(3)))[2] == "T2\nb2"
    assert text_of(*(boxed(i, f"about promo {i}") for i in range(3)))[2] == "T2\nabout promo 2\nb2"
    linked = lambda i: f'<body><div><a href="/{i}">other page {i}</a></div><p>text {i} goes on</p></body>'
    assert text_of(linked(0), linked(1)) == ["text 0 goes on", "text 1 goes on"]


def test_copies_are_one_page():
    assert text_of(*["<div><p>Only body text here</p></div>"] * 4) == ["Only body text here"] * 4


def test_hard_pages():
    assert text_of('<article><p>a</p><p><svg class="i"/> b</p><svg><title>t</title><g/></svg><p>c</p></article>') == ["a\nb\nc"]
    assert text_of("<article><p>a<select><option>x<option>y<p>b</p></article>") == ["a\nb"]
    assert text_of("<article><p>a<select><option>x</select> tail</p></article>") == ["a tail"]
    deep = "<div>" * 100
    assert text_of(f"<article>{deep}<p>in</p><nav>MENU</nav><p>end</p></article>") == ["in\nend"]
    assert text_of(f"{deep}<nav>MENU</nav><article><p>in</p></article><p>beside</p>") == ["in"]
    assert text_of("<div>" * 30_000 + "x") == ["x"]
    for name in ('class="social-history"', 'id="related-work"', 'class="notice-period"'):
        assert text_of(f"<article><p>a</p><div {name}>b</div></article>") == ["a\nb"]
    for name in ('class="ad"', 'class="site-footer"', 'id="comments"', 'class="cookie-notice"', 'class="share"', 'role="search"', "hidden"):
        assert text_of(f"<article><p>a</p><div {name}>b</div></article>") == ["a"]
    assert text_of('<div class="page-widget"><article><p>a</p></article></div>') == ["a"]
    assert text_of("<article><p>&eacute;&nbsp;&#x41;&amp;lt;</article>") == [" ".join(html.unescape("&eacute;&nbsp;&#x41;&amp;lt;").split())]
    long = "word " * 2_000_000
    assert text_of(f"<article><p>{long}</p></article>") == [long.strip()]


def test_null_repeated_and_empty(spark):
    rows = [(1, "http://h/a", "<p>same</p>"), (1, "http://h/a", "<p>same</p>"), (2, "http://h/a", None), (None, None, ""), (3, "http://k/", "<main><p>x</p></main>")]
    pages = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "page_id long, url string, html string, text string, host long, slot long")
    made = lambda: sorted((r.page_id or 0, r.text, r.n_chars) for r in hw.extract(pages).collect())
    expected = [(0, "", 0), (1, "same", 4), (1, "same", 4), (2, "", 0), (3, "x", 1)]
    assert made() == expected
    assert hw.extract(pages.limit(0)).count() == 0


def test_wide_join(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", f"<body><p>Join us</p><h2>T{i}</h2><p>b{i}</p></body>") for i in range(40)], "page_id long, url string, html string")
    small = sorted(map(tuple, hw.extract(pages).collect()))
    monkeypatch.setattr(hw, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, hw.extract(pages).collect())) == small and small[7][2] == "T7\nb7"


def test_article_or_main():
    long = "the text of main goes on " * 5
    assert text_of(f"<main><p>{long}</p></main><div><article><p>teaser</p></article></div>") == [long.strip()]
    assert text_of(f"<main><article><p>a</p></article><p>{long}</p></main>") == ["a\n" + long.strip()]
    assert text_of(f"<main><p>Home</p><article><p>{long}</p></article></main>") == [long.strip()]
    for name in ('class="ad-hoc"', 'class="comments-policy"', 'class="footer-note"'):
        assert text_of(f"<article><p>a</p><div {name}>b</div></article>") == ["a\nb"]
        assert text_of(f"<body><p>a</p><div {name}>b</div></body>") == ["a"]
    for name in ('class="ad-slot"', 'class="comments-section"', 'class="article sidebar-left"', 'id="main-nav"'):
        assert text_of(f"<article><p>a</p><div {name}>b</div></article>") == ["a"]
    for tag in ("fieldset", "menu"):
        assert text_of(f"<article><p>a</p><{tag}>b</{tag}></article>") == ["a\nb"]
        assert text_of(f"<article><p>a</p><form><{tag}>b</{tag}></form></article>") == ["a"]


def plain_width(ids, least):
    return next((w for w in range(least, len(ids) // 2 + 1) if any(ids[k : k + w] == ids[k + w : k + 2 * w] for k in range(len(ids) - 2 * w + 1))), 0)


def test_repeats_and_alignment_by_brute_force(monkeypatch):
    rng = random.Random(8)
    for short in (0, hw.SHORT_LIST):
        monkeypatch.setattr(hw, "SHORT_LIST", short)
        for _ in range(400):
            ids = [rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(2, 40))]
            ids = ids * rng.choice([1, 1, 2]) if rng.random() < 0.7 else ids[:5] + ids + ids
            least = rng.randint(1, 6)
            assert hw.repeat_width(np.array(ids), least) == plain_width(ids, least), ids
    monkeypatch.setattr(hw, "SHORT_PAIRS", 0)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 25))] for _ in range(2))
        i = k = 0
        for j, m, n in hw.matches(a, b):
            assert j >= i and m >= k and a[j : j + n] == b[m : m + n]
            i, k = j + n, m + n
        assert (j, m, n) == (len(a), len(b), 0)
    # with the long form everywhere the expression still accepts its pages
    monkeypatch.setattr(hw, "SHORT_LIST", 0)
    test_wrapper_accepts_its_pages()


def test_long_page():
    """100 000 different kinds of blocks in a row take seconds, alone and aligned with another page."""
    rng = random.Random(2)
    pages = ["<article>" + "".join(f"<{t}>x{k}</{t}>" for k, t in enumerate(rng.choices(["p", "h2", "h3", "pre", "blockquote", 'div class="a"', 'div class="b"'], k=100_000))).replace('</div class="a">', "</div>").replace('</div class="b">', "</div>") + "</article>" for _ in range(2)]
    began = time.time()
    trees = [hw.folded_tree(html_tree.parsed(p)[0]) for p in pages]
    made = hw.merged(*trees)
    placed = hw.placed(pages[1], hw.Wrapper(hw.spelled(made)))
    assert time.time() - began < 60
    assert len(placed) == 100_000 and sum(s >= 0 for s, _ in placed) > 90_000


def test_large_wrappers_are_made_by_classes(spark):
    """Where a host's wrapper would be too large there is one for each outline or shape, and each page matches its own."""
    rng = random.Random(4)
    bodies = [f"<body><div class='{chr(97 + i % 5)}'>{random_page(rng)[6:-7]}<p>end {i}</p></div></body>" for i in range(60)]
    bodies += [None, "", "<article>" + "".join(f"<h{k % 6 + 1}>t{k}</h{k % 6 + 1}>" + "<p>u</p>" * (k % 4) + f"<div class='c{chr(97 + k % 26)}'>v</div>" for k in range(40)) + "</article>"]
    bodies += ["<div>" * 6 + "".join(f"<{t}>x</{t}>" for t in rng.sample("p h1 h2 h3 h4 h5 h6 pre blockquote".split(), 4)) for _ in range(8)]
    pages = spark.createDataFrame([(i, f"http://h{i % 2 if i < 63 else 0}/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    assert {r.kind for r in hw.infer_wrappers(pages).collect()} == {""}
    for nodes, kinds in ((13, {"o", "s"}), (125, {""})):
        made = hw.infer_wrappers(pages, nodes=nodes)
        found = {(r.host, r.kind): hw.to_node(hw.json.loads(r.wrapper)) for r in made.collect()}
        assert {k[:1] for _, k in found} >= kinds and any(found)
        assert all(hw.size_of(w) <= nodes for (_, k), w in found.items() if k[:1] != "s")
        rows = pages.withColumn("host", hw._host("url"))
        for r in hw.with_kind(rows, made, nodes).collect():
            assert re.fullmatch(pattern(found[r.host, r.kind]), stream(html_tree.parsed(r.html)[0])), r
        texts = {r.page_id: r.text for r in hw.extract(pages, nodes=nodes).collect()}
        assert len(texts) == len(bodies) and texts[60] == "" and texts[62].startswith("t0\nv\nt1\nu")
