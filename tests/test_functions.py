"""Small cases of the notice functions and operators."""

import random
import unicodedata
import urllib.robotparser
from datetime import UTC, datetime

from pyspark.sql import functions as F

from noticeflow.functions import dates, text, urls
from noticeflow.operators import classify, frontier, identity, lifecycle, search, snapshot, telemetry
from noticeflow.sources import pages, payloads


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()[0]


def score(spark, value):
    df = spark.createDataFrame([(value,)], "t string").select(text.normalize(F.col("t")).alias("t"))
    return df.select(classify.relevance_score(F.col("t")).alias("s")).first()[0]


def test_normalize_equals_python(spark):
    rows = [None, "", "  Città  Più-BELLA!! ", "ﬁne ½ ™ №5", "È̀ già", "straße", "１２ＡＢ", "日本", "a\tb\nc", "ĳssel", "K"] + ["".join(map(chr, range(k, k + 200))) for k in range(0x80, 0x600, 200)]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(text.normalize(F.col("t"))).collect()]
    for r, g in zip(rows, got, strict=True):
        assert g == text.plain(r), (r, g)


def test_folding_covers_the_basic_plane():
    single = sum(1 for c in range(0x80, 0xFFFF) if len(b := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and b.isascii() and b.isalnum())
    assert len(text._FROM) == len(text._TO) == single > 500


def test_short_terms_are_whole_words(spark):
    assert one(spark, F.array_join(classify.detect_areas(F.col("t")), ","), t="borsa di ricerca e risorsa") == "ricerca"
    assert one(spark, F.array_join(classify.detect_areas(F.col("t")), ","), t="psicologo in rsa") == "anziani"
    assert one(spark, classify.infer_category(F.col("t")), t="niente") == "altro"
    assert one(spark, F.array_join(classify.extract_requirements(F.col("t")), ","), t="classe lm 51 sezione a") == "laurea-psicologia,albo-sezione-a"


def test_relevance(spark):
    assert score(spark, "neuropsicologo") == 70
    assert score(spark, "Psicologo iscritto all'albo, minori") == 100
    assert score(spark, "salute mentale") == 10
    assert score(spark, None) == 0
    labels = [one(spark, classify.relevance_label(F.lit(s))) for s in (100, 70, 69, 35, 34, 15, 14, 0)]
    assert labels == ["alta", "alta", "media", "media", "bassa", "bassa", "esclusa", "esclusa"]


def test_parse_date(spark):
    cases = {"31/12/2026": "2026-12-31 22:59", "1.7.26": "2026-07-01 21:59", "2026-06-10": "2026-06-10 21:59", "entro il 5 Marzo 2026": "2026-03-05 22:59", "31/02/2026": None, "": None, "nessuna": None, "2026-06-10T10:00:00Z": "2026-06-10 10:00", "2026-01-10T10:00:00": "2026-01-10 09:00"}
    df = spark.createDataFrame(list(cases.items()), "t string, e string")
    for r in df.select("t", "e", F.date_format(dates.parse_date(F.col("t")), "yyyy-MM-dd HH:mm").alias("g")).collect():
        assert r.g == r.e, r


def test_latest_and_labelled_dates(spark):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    assert one(spark, day(dates.parse_latest_date(F.col("t"))), t="dal 01/02/2026 al 3 aprile 2026, poi 2/3/2026") == "2026-04-03"
    assert one(spark, day(dates.labelled_deadline(F.col("t"))), t="Pubblicato il 01/01/2026. Scadenza domande ore 12: 10/02/2026") == "2026-02-10"
    assert one(spark, day(dates.labelled_deadline(F.col("t"))), t="Scadenza graduatoria 10/02/2026") is None
    assert one(spark, day(dates.labelled_publication(F.col("t"))), t="Pubblicato il 01/01/2026, scade il 3/3/2026") == "2026-01-01"


def test_status_and_buckets(spark):
    at = F.lit("2026-06-01 12:00:00").cast("timestamp")
    days = lambda s: F.lit(s).cast("timestamp")
    got = [one(spark, dates.infer_status(days(s), at)) for s in (None, "2026-06-01 11:59:59", "2026-06-01 12:00:00", "2026-06-09 11:59:59", "2026-06-09 12:00:00")]
    assert got == ["review", "closed", "closing_soon", "closing_soon", "open"]
    bucket = lambda s, b: one(spark, dates.deadline_bucket(days(s), at, b))
    assert [bucket("2026-06-08 12:00:00", b) for b in ("7d", "30d", "future", "past", "missing", "odd", None)] == [True, True, True, False, False, True, True]
    assert [bucket(None, b) for b in ("7d", "missing", "odd")] == [False, True, False]


def test_urls(spark):
    cases = [("https://A.example/x/?q=psi", True, "a.example/xq=psi"), ("https://a.example/x?q=", False, "a.example/xq="), (None, False, ""), ("not a url", False, None), ("http://u:p@h.example:8080/p//#f", False, "u:p@h.example:8080/p")]
    df = spark.createDataFrame([(u,) for u, _, _ in cases], "u string")
    got = df.select("u", urls.search_url(F.col("u")).alias("s"), urls.normalized_url(F.col("u")).alias("n"), urls.safe_http_url(F.col("u")).alias("safe")).collect()
    for (u, s, n), r in zip(cases, got, strict=True):
        assert r.s == s and (n is None or r.n == n), r
    assert [r.safe for r in got] == [cases[0][0], cases[1][0], None, None, None]
    join = lambda h: one(spark, urls.urljoin(F.lit("https://a.example/d/p?x=1#f"), F.lit(h)))
    assert [join(h) for h in ("http://b/", "//c/y", "/z", "?q", "#t", "w", "")] == ["http://b/", "https://c/y", "https://a.example/z", "https://a.example/d/p?q", "https://a.example/d/p?x=1#t", "https://a.example/d/w", "https://a.example/d/p?x=1#f"]


def test_dotted_links_as_urllib_joins_them(spark):
    from urllib.parse import urljoin

    bases = ["https://a.example/d/e/p.html?x=1", "https://a.example", "http://b.example/d/"]
    hrefs = ["../w", "./w?q=../z", "../../../w#f", "x/../y/./z", "..", ".", "/a/../b", "/a/./", "w..x/.y", "../..", "/../g?h"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for row in rows.select("b", "h", urls.urljoin(F.col("b"), F.col("h")).alias("u")).collect():
        assert row.u == urljoin(row.b, row.h), row


def test_identity_rules(spark):
    import hashlib

    digest = lambda s, n=24: hashlib.sha256(s.encode()).hexdigest()[:n]
    of = lambda rule, **c: one(spark, urls.external_id_by(F.lit(rule), **{k: F.lit(v) for k, v in c.items()}))
    assert of("title_and_url", source_id="s", title="Città  A", url="https://H/x") == digest("s|citta a|https h x")
    assert of("lower_url", source_id="s", url="https://H/X") == digest("s|https://h/x")
    assert of("lower_url", source_id="s", url="https://H/X", title="Ab", listing=True) == digest("s|https://h/x|ab")
    assert of("record", source_id="s", title="A", url="u") == digest("s||a|u")
    assert of("title", title="Avviso n. 3") == digest("avviso n 3")
    assert of("title_and_dates", title="T", section_url="u") == digest("t|||u")
    assert of("trailing_number", url="https://h/a-12?x=-3") == "12"
    assert of("trailing_number", url="https://h/a12/") == digest("https://h/a12/")
    files = urls.external_id_by(F.lit("attachment"), attachment_urls=F.array(F.lit("https://h/?id="), F.lit("https://h/?id=a%20b&id=c")), title=F.lit("T"))
    assert one(spark, files) == "a b"
    assert of("attachment", title="T", deadline_text="1/2") == digest("T|1/2", 16)
    assert of("last_segment", url="https://h/a/b.html.html?c=/d") == "b.html" and of("last_segment", url="https://h/a/") == ""
    assert of("redaction_code", url="https://h/?atto.codiceRedazionale=26A1", text="26B00002") == "26A1"
    assert of("redaction_code", url="https://h/", text="x 26B000021 26C00003.") == "26C00003"
    assert of("redaction_code", url="https://h/") is None and of("other", url="u") is None


def test_manual_hides_survive_upsert(spark):
    schema = "id long, source_id long, external_id string, title string, editorial_status string, editorial_notes string"
    old = spark.createDataFrame([(1, 1, "a", "A", "hidden", "by hand"), (2, 1, "b", "B", "hidden", "Nascosto automaticamente: x"), (3, 1, "c", "C", "approved", None), (4, None, "d", "D", "approved", None)], schema)
    new = spark.createDataFrame([(9, 1, "a", "A2", "approved", None, 1), (8, 1, "b", "B1", "approved", None, 1), (7, 1, "b", "B2", "approved", None, 2), (6, 1, "e", "E", "approved", None, 1)], schema + ", fetched int")
    got = {r.external_id: (r.id, r.title, r.editorial_status, r.editorial_notes, r.outcome) for r in lifecycle.upsert_notices(old, new).collect()}
    assert got == {"a": (1, "A2", "hidden", "by hand", "updated"), "b": (2, "B2", "approved", None, "updated"), "c": (3, "C", "approved", None, "kept"), "d": (4, "D", "approved", None, "kept"), "e": (6, "E", "approved", None, "created")}


def test_lifecycle_stops(spark):
    at = F.lit("2026-06-01 12:00:00").cast("timestamp")
    row = lambda i, title, status, deadline, es, notes, url=None: (i, 1, title, None, url or f"https://a.example/{i}", "https://a.example/", status, deadline and datetime(2026, *deadline, tzinfo=UTC), es, notes)
    rows = [
        row(1, "Graduatoria finale", "review", None, "approved", None),
        row(2, "Avviso", "open", (5, 1), "approved", None),
        row(3, "Avviso", "closed", (12, 1), "hidden", "Nascosto automaticamente: scadenza superata."),
        row(4, "Avviso", "open", (12, 1), "hidden", "by hand"),
        row(5, "Revoca concorso", "open", (5, 1), "approved", "n"),
        row(6, "Avviso uno", "open", (12, 1), "approved", None, "https://A.example/same/"),
        row(7, "Avviso due", "open", (12, 2), "approved", None, "https://a.example/same"),
    ]
    df = spark.createDataFrame(rows, "id long, source_id long, title string, description string, official_url string, source_url string, status string, deadline timestamp, editorial_status string, editorial_notes string")
    got = {r.id: (r.status, r.editorial_status, r.n_changes) for r in lifecycle.refresh_lifecycle(df, at).collect()}
    assert got == {1: ("review", "hidden", 1), 2: ("closed", "hidden", 2), 3: ("open", "approved", 2), 4: ("open", "hidden", 0), 5: ("closed", "hidden", 2), 6: ("open", "hidden", 1), 7: ("open", "approved", 0)}


def test_contextual_facets_keep_selected_zero(spark):
    rows = [(1, "approved", "open", "a", "X", "P", "c", "e", ["k"], False, None), (2, "approved", "open", "a", "Y", "Q", "c", "e", None, True, None), (3, "hidden", "open", "a", "X", "P", "c", "e", [], True, None)]
    df = spark.createDataFrame(rows, "id long, editorial_status string, status string, search_text string, region string, province string, category string, entity_type string, areas array<string>, is_featured boolean, deadline timestamp")
    at = F.lit("2026-06-01").cast("timestamp")
    got = {(r.facet, r.value): r.n for r in search.contextual_facets(df, search.Params(region="X", province="Q"), at).collect()}
    assert got[("region", "X")] == 1 and got[("region", "Y")] == 1 and got[("province", "P")] == 1 and got[("province", "Q")] == 0
    assert search.page(df, "relevance" if "relevance_score" in df.columns else "region", 1).count() == 1


def test_rotation_is_cyclic(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate("ABCDE")], "id int, name string")
    take = lambda slot: "".join(r.name for r in telemetry.rotation_batch(df, 2, F.lit(slot)).orderBy("offset").collect())
    assert [take(s) for s in (0, 1, 2, 3)] == ["AB", "CD", "EA", "BC"]


def test_probable_duplicates(spark):
    when = datetime(2026, 6, 1, tzinfo=UTC)
    rows = [(1, 1, "Avviso pubblico per psicologo", "ASL Roma", when, "approved", "open"), (2, 2, "Avviso pubblico per psicologi", "ASL Roma", when, "approved", "open"), (3, 1, "Avviso pubblico per psicologo", "ASL Roma", when, "approved", "open"), (4, 2, "Altro titolo", "ASL Roma", when, "approved", "open"), (5, 3, "Avviso pubblico per psicologo", "ASL Roma", None, "approved", "open")]
    df = spark.createDataFrame(rows, "id long, source_id long, title string, organization string, deadline timestamp, editorial_status string, status string")
    assert {(r.id, r.duplicate_of) for r in identity.probable_duplicates(df).collect()} == {(2, 1), (3, 2), (5, 1)}


def test_page_reader():
    rows, title, body = pages.read("<html><title>T</title><nav><a href=/n>n</a></nav><article><h2>Head line</h2><p>one<p>two <a href='mailto:x'>m</a><a href='/d' rel=nofollow>detail</a></article><table><tr><td>a<td>b</table>")
    assert title == "Head line" and body.startswith("Head line one two")
    links = {(r["href"], r["text"], r["rel"]) for r in rows if r["kind"] == "link"}
    assert ("/d", "detail", "nofollow") in links
    article = next(r for r in rows if r["tag"] == "article")
    assert article["heading"] == "Head line" and article["href"] == "/d"
    assert next(r for r in rows if r["tag"] == "tr")["cells"] == ["a", "b"]
    assert pages.read(None) == ([], "", "")


def test_payload_readers(spark):
    body = '{"totalPages": 2, "content": [{"id": "%s", "title": "t%s"}]}'
    df = spark.createDataFrame([(1, 0, body % (1, 1)), (1, 1, body % (1, 2)), (1, 2, body % (3, 3)), (2, 0, '{"last": true, "content": [{"id":"9","title":"x"}]}'), (2, 1, body % (8, 8))], "source_id long, page long, body string")
    assert {(r.source_id, r.id, r.title) for r in payloads.read_paged_json(df).collect()} == {(1, "1", "t2"), (2, "9", "x")}
    assert [one(spark, payloads.sniffed_delimiter(F.lit(h))) for h in ("a;b;c,d", "a\tb", "abc", "a|b|c;d")] == [";", "\t", ";", "|"]


def test_robots_agree_with_the_standard_library(spark):
    rng = random.Random(2)
    paths = ["/", "/a", "/a/b", "/a b", "/a%20b", "/à", "*", "/a?x=1", "/b", "", "/a/", "/~u", "/%7Eu", "/a*"]
    bodies = {}
    for k in range(150):
        lines = []
        for _ in range(rng.randint(0, 14)):
            lines.append(rng.choice(["", "", "# note", "  ", "nonsense", "Sitemap: /s", "Crawl-delay: 3"] + ["User-agent: " + rng.choice(["*", "Noticeflow", "notice", "other", "flow/2"])] * 5 + [rng.choice(["Disallow", "allow", "DISALLOW "]) + ": " + rng.choice(paths) + rng.choice(["", "", " # x"])] * 8))
        bodies[f"h{k}.example"] = "\n".join(lines)
    ends = ["", "/", "/a", "/a/b/c", "/a b", "/a%20b?q=1", "/à", "/%C3%A0", "/a?x=1&y=2", "/b#f", "/~u/1", "/c+d", "/a*b"]
    links = [(f"https://{h}{e}",) for h in bodies for e in ends] + [("https://no-rules.example/a",)]
    rules = frontier.robots_rules(spark.createDataFrame(list(bodies.items()), "host string, body string"), "Noticeflow/1.0")
    got = {r.url for r in frontier.robots_filter(spark.createDataFrame(links, "url string"), rules).collect()}
    expected = {links[-1][0]}
    for h, body in bodies.items():
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        expected |= {f"https://{h}{e}" for e in ends if parser.can_fetch("Noticeflow/1.0", f"https://{h}{e}")}
    assert got == expected and 200 < len(expected) < len(links) - 100
