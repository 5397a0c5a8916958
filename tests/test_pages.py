"""Elements of pages against a brute-force reading of well-formed random pages, and pages that are hard to read."""

import random
import re
from xml.etree import ElementTree

from noticeflow.sources import pages


def random_page(rng):
    def some(depth):
        if depth > 5 or rng.random() < 0.25:
            return f"t{rng.randrange(50)} "
        tag = rng.choice(["div", "article", "section", "h2", "strong", "ul", "script", "nav", "a"])
        inner = "".join(some(depth + 1) for _ in range(rng.randint(0, 3)))
        return f'<a href="/{rng.randrange(9)}">{inner}</a>' if tag == "a" else f"<{tag}>{inner}</{tag}>"

    return "<body>" + "".join(some(0) for _ in range(6)) + "</body>"


def brute(page):
    """(tag, text, heading, href) of the containers, by an XML tree."""
    tree = ElementTree.fromstring(re.sub(r"<script>.*?</script>", "<script/>", page, flags=re.S))

    def pieces(e):
        if e.tag in pages.DROPPED:
            return []
        return [e.text or ""] + [x for k in e for x in [*pieces(k), k.tail or ""]]

    text = lambda e: " ".join(" ".join(x for x in pieces(e) if x.strip()).split())
    muted = {id(k) for e in tree.iter() if e.tag in pages.DROPPED for k in e.iter()}
    seen = lambda e: "" if id(e) in muted else text(e)
    out = []
    for e in tree.iter():
        if e.tag in pages.CONTAINERS:
            inside = list(e.iter())[1:]
            heading = next((seen(k) for h in pages.HEADINGS for k in inside if k.tag == h and seen(k)), None)
            out.append((e.tag, seen(e), heading, next((k.get("href") for k in inside if k.tag == "a"), None)))
    return out


def test_containers_against_brute_force():
    rng, n = random.Random(2), 0
    for _ in range(300):
        page = random_page(rng).replace("<script>", "<script>/*").replace("</script>", "*/</script>")
        if re.search(r"<script>(?:(?!</script>).)*<script>", page, re.S):
            continue  # scripts don't nest
        got = [(r["tag"], r["text"], r["heading"], r["href"]) for r in pages.read(page)[0] if r["kind"] == "container"]
        assert got == brute(page), page
        n += len(got)
    assert n > 200


def test_hard_pages():
    rows, title, body = pages.read("<div>" * 3000 + "<h1>Deep</h1><article><h2>In</h2><a href='/x'>go</a></article>")
    (article,) = [r for r in rows if r["tag"] == "article"]
    assert article["text"] == "In go" and article["heading"] == "In" and article["href"] == "/x" and title == "Deep" and body == "In go"
    assert pages.read(None) == ([], "", "") and pages.read("") == ([], "", "")
    assert pages.read("<body>plain<br>text")[2] == "plain text"
    long = "word " * 500_000
    assert pages.read(f"<article>{long}</article>")[0][0]["text"] == long.strip()


def test_titles_have_their_character_references_as_the_sql_says():
    import duckdb

    from noticeflow.plans import registry

    titles = ["a &amp; b", "cut at &amp", "cut at &am", "token = &quot;x&quot;", "&quo", "it&#x27;s &#39;so&#39;", "&amp;quot;", "1 &lt; 2 &gt", "one<b>two</b>\n three"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(k, f"<body><h1>{t}</h1><p>x</p></body>") for k, t in enumerate(titles)])
    got = dict(con.execute(registry.ORACLE_SQL["html_detail"]).fetchall())
    assert got == {k: pages.read(f"<body><h1>{t}</h1><p>x</p></body>")[1] for k, t in enumerate(titles)}
    assert got[1] == "cut at &" and got[3] == 'token = "x"'


def test_simple_pages_are_read_as_by_the_parser():
    """Random pieces, of which many make a page that the parser has to read; the same elements and texts either way."""
    rng, simple = random.Random(11), 0
    bits = ["<p>", "</p>", "<li>", "</li>", "<tr>", "<td>", "<th>", "</tr>", "<table>", "</table>", '<a href="/x?a=1">', "</a>", '<div class="a b" id="c">', "</div>", "<br>", "<h2>", "</h2>", "<nav>", "</nav>", "text ", "a &amp; b &lt &#39;", "&", "&am", "1 > 0", " \n "]
    odd = ["<br/>", "<script>a < b</script>", "<title>x</title>", "<!-- <p> -->", "<A HREF='y'>", '<a href="&amp;">', "< p", "<textarea>", "<p", "</ p>", "<![CDATA[x]]>"]
    for _ in range(3000):
        page = "".join(rng.choice(bits if rng.random() < 0.97 else odd) for _ in range(rng.randint(0, 25)))
        whole = pages._Reader()
        whole.feed(page)
        whole.close()
        own = pages._read(page)
        assert own.elements == whole.elements and [own.text(i) for i in range(len(own.elements))] == [whole.text(i) for i in range(len(whole.elements))], page
        simple += pages._simple(page, pages._Reader())
        assert pages.rows(own, "tr") == [r for r in pages.rows(own) if r["tag"] == "tr"]
    assert 1000 < simple < 2900
