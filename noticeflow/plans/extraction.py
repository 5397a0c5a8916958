"""Queries over landed pages and payloads. Where the given tables have no such payload, Spark writes it from the notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, rules, urls
from ..operators import classify, frontier
from ..operators.identity import kept
from ..operators.snapshot import scratch
from ..sources import pages as html
from ..sources import payloads
from .base import has_sql, norm, query
from .fixtures import fixture
from .notices import N

S = "fx_sources"
#: Records on a made page.
PER_PAGE = 40
#: Start pages of a source: with three links a page, two levels make 3 + 9 + 27 pages, above the bound of 24.
SEEDS = 3


def _pages(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


ANCHORS = r"<a href=\"([^\"]*)\"[^>]*>([^<]*)</a>"


@query("extract_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def extract_links(spark, d):
    return _pages(spark, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query("html_to_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_to_text(spark, d):
    return _pages(spark, d).select("page_id", F.md5(html.html_to_text(F.col("html"))).alias("text_md5"))


@query("html_containers")
def html_containers(spark, d):
    found = html.elements(_pages(spark, d)).where("kind = 'container'")
    return found.where(F.length("text").between(24, 2400)).select("page_id", "idx", "tag", "heading", "href", F.length("text").alias("n_chars"))


def _plain_sql(x: str) -> str:
    """Text of an element without markup and with its character references, also without their semicolon; & comes last."""
    for pattern, to in (("<[^>]*>", " "), ("&#(39|x27);?", "''"), ("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&"), (r"\s+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x})"


@query("html_detail", f"SELECT page_id, {_plain_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title FROM pages")
def html_detail(spark, d):
    """Page titles merged onto the listing: the detail's wins where there is one."""
    listing = _pages(spark, d).select("page_id", F.lit(None).cast("string").alias("listed"))
    detail = html.details(_pages(spark, d)).select("page_id", "title")
    return listing.join(detail.hint("merge"), "page_id", "left").select("page_id", F.coalesce("title", "listed").alias("title"))


@query("context_links")
def context_links(spark, d):
    """Links whose surroundings have a word, whatever their own label."""
    return html.context_links(_pages(spark, d), ["the"])


def _links(spark, d) -> DataFrame:
    p = _pages(spark, d).select("page_id", F.col("url").alias("page_url"), F.posexplode(F.regexp_extract_all("html", F.lit(ANCHORS.replace('\\"', '"')), F.lit(0))).alias("idx", "a"))
    pattern = ANCHORS.replace('\\"', '"')
    # Labels get words of the pack, so that links differ in score.
    label = F.concat(F.regexp_extract("a", pattern, 2), F.when(F.col("idx") % 3 == 0, " bando").when(F.col("idx") % 3 == 1, " bando psicologo").otherwise(""))
    return p.select("page_id", "page_url", "idx", F.regexp_extract("a", pattern, 1).alias("href"), label.alias("text"))


LINKS_SQL = r"""l AS (SELECT page_id, page_url, CAST(i - 1 AS INT) AS idx, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '<a href="[^"]*"[^>]*>([^<]*)</a>', 1) || CASE (i - 1) % 3 WHEN 0 THEN ' bando' WHEN 1 THEN ' bando psicologo' ELSE '' END AS label
 FROM (SELECT page_id, url AS page_url, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*</a>') AS x FROM pages)))"""
SCORE_SQL = f"""CASE WHEN b = '' OR {has_sql("b", rules.SKIP_LINK_TERMS)} THEN 0 ELSE s - CAST({has_sql("b", rules.LOW_SIGNAL_TERMS)} AND s > 0 AS INT) END"""
SCORED_SQL = f"""{LINKS_SQL}, b AS (SELECT *, {norm("concat_ws(' ', label, href)")} AS b FROM l),
 t AS (SELECT *, 4 * CAST({has_sql("b", rules.LINK_TERMS)} AS INT) + 5 * CAST({" OR ".join(f"regexp_matches(lower(href), '{p}')" for p in rules.DETAIL_PATHS)} AS INT) + 5 * CAST({has_sql("b", rules.SEARCH_TERMS)} AS INT) + CAST({has_sql("b", ("dettaglio", "scheda", "visualizza"))} AS INT) AS s FROM b),
 s AS (SELECT page_id, page_url, idx, href, CAST({SCORE_SQL} AS INT) AS score FROM t)"""


@query("link_score", f"WITH {SCORED_SQL} SELECT page_id, idx, score FROM s")
def link_score(spark, d):
    return frontier.scored_links(_links(spark, d)).select("page_id", "idx", "score")


def _holds(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


DEEP_SQL = f"""WITH {LINKS_SQL}, b AS (SELECT *, trim(regexp_replace(lower(label || ' ' || href), '\\s+', ' ', 'g')) AS b FROM l), p AS (SELECT *, CASE WHEN regexp_matches(lower(href), '[?&]({"|".join(rules.PAGE_KEYS)})=[^&]') THEN 5 WHEN {_holds("b", rules.PAGE_TERMS)} THEN 3 ELSE 0 END AS page FROM b)
 SELECT page_id, idx, CAST(CASE WHEN {_holds("b", rules.SKIP_LINK_TERMS)} THEN 0 ELSE page + 10 * CAST({_holds("b", rules.DEEP_PSYCHOLOGY_TERMS)} AS INT) + CASE WHEN page > 0 THEN 0 ELSE 7 * CAST({_holds("b", rules.DEEP_OPPORTUNITY_TERMS)} AS INT) + 6 * CAST({" OR ".join(f"regexp_matches(lower(href), '{p}')" for p in rules.DEEP_DETAIL_PATHS)} AS INT) + 2 * CAST({_holds("b", rules.DEEP_DETAIL_TERMS)} AS INT) END END AS INT) AS score FROM p"""


@query("deep_link_score", DEEP_SQL)
def deep_link_score(spark, d):
    return _links(spark, d).select("page_id", "idx", classify.deep_link_score(F.col("text"), F.col("href"), F.lit("")).alias("score"))


@query("top_links", f"WITH {SCORED_SQL}, u AS (SELECT page_id, idx, regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) || href AS url, score FROM s WHERE score > 0), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY idx) = 1) SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, idx) AS rank FROM f QUALIFY rank <= 3")
def top_links(spark, d):
    return frontier.top_links(_links(spark, d), 3).select("page_id", "url", F.col("rank").cast("long").alias("rank"))


def _edges(spark, d) -> DataFrame:
    """A link graph over the given pages: each page leads to three others, found by its number."""
    p = _pages(spark, d).select("page_id", "url")
    n = p.agg(F.count("*").alias("n"))
    targets = p.crossJoin(F.broadcast(n)).select("url", F.explode(F.array(*[F.pmod(F.col("page_id") * 3 + k, F.col("n")) for k in (1, 2, 3)])).alias("to"))
    return targets.join(p.select(F.col("page_id").alias("to"), F.col("url").alias("target")).hint("merge"), "to").select("url", "target").distinct()


@query("expand_frontier")
def expand_frontier(spark, d):
    """Every page is a start page; neighbours by number share a source, so sources grow with the pages."""
    seeds = _pages(spark, d).select(F.floor(F.col("page_id") / SEEDS).alias("source_id"), "url")
    return frontier.expand_frontier(seeds, _edges(spark, d))


@query("listing_urls", "SELECT id, page, base_url || CASE WHEN contains(base_url, '?') THEN '&' ELSE '?' END || 'page=' || page AS url FROM fx_sources, unnest(range(2, 6)) AS r(page)", S)
def listing_urls(spark, d):
    s = fixture(spark, d, S).select("id", "base_url", F.explode(F.sequence(F.lit(2).cast("long"), F.lit(5).cast("long"))).alias("page"))
    return s.select("id", "page", F.concat("base_url", F.when(F.col("base_url").contains("?"), "&").otherwise("?"), F.lit("page="), F.col("page").cast("string")).alias("url"))


@query("facet_filter_urls", "SELECT id, facet, url FROM (SELECT id, facet, base_url || CASE WHEN contains(base_url, '?') THEN '&' ELSE '?' END || 'stato=' || facet AS url, row_number() OVER (PARTITION BY id ORDER BY facet) AS rn FROM fx_sources, (SELECT DISTINCT stored_status AS facet FROM fx_notices)) WHERE rn <= 40", S, N)
def facet_filter_urls(spark, d):
    """A site's filter options as urls, forty at most for each source."""
    options = fixture(spark, d, N).select(F.col("stored_status").alias("facet")).distinct()
    s = fixture(spark, d, S).select("id", "base_url").crossJoin(F.broadcast(options))
    ranked = s.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("facet"))).where("rn <= 40")
    return ranked.select("id", "facet", F.concat("base_url", F.when(F.col("base_url").contains("?"), "&").otherwise("?"), F.lit("stato="), "facet").alias("url"))


@query("robots_filter", "SELECT id, official_url AS url FROM fx_notices WHERE NOT (source_id % 3 <> 2 AND regexp_matches(official_url, '://[^/]*/bandi/1') AND NOT regexp_matches(official_url, '://[^/]*/bandi/1[05]'))", N)
def robots_filter(spark, d):
    """Each source's host has a robots.txt of one of three kinds; the last one bars other agents only."""
    links = fixture(spark, d, N).select("id", F.col("official_url").alias("url"))
    bodies = ["User-agent: *\nAllow: /bandi/10\nAllow: /bandi/15\nDisallow: /bandi/1\n", "User-agent: *\nDisallow: /\n\nUser-agent: other\nUser-agent: Noticeflow # us\nAllow: /bandi/10\nAllow: /bandi/15\nDisallow: /bandi/1\nCrawl-delay: 5\n", "Sitemap: x\n\nUser-agent: other\nDisallow: /bandi\n\nDisallow: /\n"]
    kind = F.col("id") % 3
    robots = fixture(spark, d, N).select(F.col("source_id").alias("id")).distinct().select(F.concat(F.lit("ente"), F.col("id").cast("string"), F.lit(".example.org")).alias("host"), F.when(kind == 0, bodies[0]).when(kind == 1, bodies[1]).otherwise(bodies[2]).alias("body"))
    return frontier.robots_filter(links, frontier.robots_rules(robots, "Noticeflow/1.0"))


def _batches(spark, d) -> DataFrame:
    """(source_id, page, rows): at most PER_PAGE notices on a page, dealt by id."""
    n = fixture(spark, d, N).select("source_id", F.floor(F.col("id") / (40 * PER_PAGE)).alias("page"), F.struct("id", "title", "deadline_text", "description").alias("r"))
    return n.groupBy("source_id", "page").agg(F.array_sort(F.collect_list("r")).alias("rows"))


@query("html_table_rows", "SELECT id, title, CASE WHEN id % 2 = 0 THEN 'Aperti' ELSE 'Chiusi' END AS section FROM fx_notices", N)
def html_table_rows(spark, d):
    """Tables with section rows, written from the notices; the section goes down to the rows after it."""
    def part(name: str, odd: int):
        rows = F.filter(F.col("rows"), lambda r: r["id"] % 2 == odd)
        body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr><td>"), r["id"].cast("string"), F.lit("<td>"), r["title"], F.lit("</td></tr>"))), "")
        return F.concat(F.lit(f"<tr><th>{name}</th></tr>"), body)

    made = _batches(spark, d).select((F.col("source_id") * 1_000_000 + F.col("page")).alias("page_id"), F.concat(F.lit("<table>"), part("Aperti", 0), part("Chiusi", 1), F.lit("</table>")).alias("html"))
    rows = html.elements(made, "tr")
    w = Window.partitionBy("page_id").orderBy("idx")
    down = rows.withColumn("section", F.last(F.when(F.size("cells") == 1, F.col("cells")[0]), ignorenulls=True).over(w)).where(F.size("cells") == 2)
    return down.select(F.col("cells")[0].cast("long").alias("id"), F.col("cells")[1].alias("title"), "section")


@query("html_cards", "SELECT id, title, '/notice/' || id AS href, " + "strftime(updated_at, '%d/%m/%Y')" + " AS day FROM fx_notices", N)
def html_cards(spark, d):
    """Card markup, written from the notices, to title, link and date."""
    card = F.array_join(F.transform("rows", lambda r: F.concat(F.lit('<article class="card"><h2>'), r["title"], F.lit('</h2><p>'), r["deadline_text"], F.lit('</p><a href="/notice/'), r["id"].cast("string"), F.lit('">Apri</a></article>'))), "")
    made = _batches(spark, d).select((F.col("source_id") * 1_000_000 + F.col("page")).alias("page_id"), card.alias("html"))
    cards = html.elements(made, "article")
    return cards.select(F.regexp_extract("href", r"(\d+)$", 1).cast("long").alias("id"), F.col("heading").alias("title"), "href", F.date_format(dates.labelled_deadline(F.col("text")), "dd/MM/yyyy").alias("day"))


@query("read_paged_json", "SELECT source_id, CAST(id AS VARCHAR) AS id, title || CASE WHEN id % 3 = 0 THEN ' bis' ELSE '' END AS title FROM fx_notices", N)
def read_paged_json(spark, d):
    """Pages that name the next one; a third of the records come again, changed, on a page of their own behind the others."""
    content = lambda rows, mark: F.transform(rows, lambda r: F.struct(r["id"].cast("string").alias("id"), F.concat(r["title"], F.lit(mark)).alias("title"), r["deadline_text"].alias("deadline")))
    again = F.filter("rows", lambda r: r["id"] % 3 == 0)
    made = _batches(spark, d).select("source_id", F.explode(F.array(F.struct(F.col("page").alias("k"), content("rows", "").alias("content")), F.struct((F.col("page") + 1_000_000_000).alias("k"), content(again, " bis").alias("content")))).alias("p")).where("size(p.content) > 0")
    url = lambda k: F.concat(F.lit("/feed/"), k.cast("string"))
    order = Window.partitionBy("source_id").orderBy("p.k")
    body = F.to_json(F.struct(F.col("p.content").alias("content"), F.struct(url(F.lead("p.k").over(order)).alias("next")).alias("batching")))
    feeds = kept(made.select("source_id", url(F.col("p.k")).alias("url"), body.alias("body"), F.row_number().over(order).alias("n")), "feeds")
    starts = feeds.where("n = 1").select("source_id", "url")
    return payloads.read_paged_json(payloads.linked_pages(feeds.drop("n"), starts)).select("source_id", "id", "title")


@query("read_csv_export", "SELECT id, title || CASE id % 3 WHEN 0 THEN chr(10) || 'di \"Forlì\"' WHEN 1 THEN '; | ,' ELSE '' END AS title FROM fx_notices", N)
def read_csv_export(spark, d):
    """Files with line breaks and quotes inside of fields, in the delimiter | and as many splits as their size gives."""
    path = scratch(spark, "csv")
    rows = fixture(spark, d, N).select("id", F.concat("title", F.when(F.col("id") % 3 == 0, '\ndi "Forlì"').when(F.col("id") % 3 == 1, "; | ,").otherwise("")).alias("title"))
    rows.write.csv(path, sep="|", header=True, escape='"')
    return payloads.read_csv_export(spark, path, "id long, title string")


@query("read_xml_acts", "SELECT source_id, title AS oggetto, 'https://x.example/' || id AS web, strftime(updated_at, '%d/%m/%Y') AS pubblicatodal FROM fx_notices", N)
def read_xml_acts(spark, d):
    act = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<atto><oggetto>"), r["title"], F.lit("</oggetto><web>https://x.example/"), r["id"].cast("string"), F.lit("</web><pubblicatodal>"), F.regexp_extract(r["deadline_text"], r"\d.*", 0), F.lit("</pubblicatodal></atto>"))), "\n")
    made = _batches(spark, d).select("source_id", F.concat(F.lit("<atti>"), act, F.lit("</atti>")).alias("xml"))
    return payloads.read_xml_acts(made)


@query("read_embedded_json", "SELECT source_id, id, title FROM fx_notices", N)
def read_embedded_json(spark, d):
    array = F.to_json(F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"))))
    escaped = F.replace(F.replace(array, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    made = _batches(spark, d).select("source_id", F.concat(F.lit('<script>self.push("{\\"bandi\\":'), escaped, F.lit('}"</script>')).alias("html"))
    return payloads.read_embedded_json(made, "bandi", "id:bigint,title:string")


@query("json_text_flatten", "SELECT id, concat_ws(' ', title, deadline_text, organization, region) AS text FROM fx_notices", N)
def json_text_flatten(spark, d):
    """Draft texts four levels deep, beside texts that aren't looked at."""
    block = lambda *texts: F.struct(F.array(*[F.struct(F.concat(F.lit(" "), t).alias("text"), F.array(F.struct(F.lit("mai").alias("text"))).alias("children")) for t in texts]).alias("blocks"))
    inner = F.struct(block(F.col("deadline_text")).alias("zeta"), F.lit("mai").alias("text"), F.array(F.array(block(F.col("organization")))).alias("alfa"))
    body = F.to_json(F.struct(F.array(block(F.col("title"))).alias("z"), inner.alias("m"), F.lit(1).alias("n"), block(F.col("region")).alias("a")))
    return fixture(spark, d, N).select("id", payloads.json_text_flatten(body).alias("text"))
