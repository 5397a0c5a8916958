"""Links of landed pages and breadth-first expansion as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import normalize
from .classify import link_score
from .snapshot import scratch

MOST_DEPTH, MOST_PAGES = 2, 24


def scored_links(links: DataFrame) -> DataFrame:
    """Adds url and score to links (page_id, page_url, idx, href, text); other schemes are dropped."""
    kept = links.where(~F.col("href").rlike("^(mailto|tel|javascript):"))
    worded = kept.withColumns({"url": urls.urljoin(F.col("page_url"), F.col("href")), "__both": normalize(F.concat_ws(" ", "text", "href"))})
    return worded.withColumn("score", link_score(F.col("__both"), F.col("href"))).drop("__both")


def top_links(links: DataFrame, k: int) -> DataFrame:
    """For each page the k best links of its site: positive score, first occurrence of a url, best score first."""
    good = scored_links(links).where((F.col("score") > 0) & urls.same_site(F.col("page_url"), F.col("url")))
    first = good.withColumn("__n", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("idx"))).where("__n = 1")
    w = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "idx")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("__n")


def expand_frontier(seeds: DataFrame, edges: DataFrame, depth: int = MOST_DEPTH, most: int = MOST_PAGES) -> DataFrame:
    """(source_id, url, level): pages reached from seeds (source_id, url) over edges (url, target), at most `most` for each
    source, nearest first and then by url. Every level is written out."""
    spark = seeds.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = scratch(spark, "frontier")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    seen = kept(seeds.distinct().withColumn("level", F.lit(0)))
    for level in range(1, depth + 1):
        near = seen.where(F.col("level") == level - 1).join(edges.hint("merge"), "url").select("source_id", F.col("target").alias("url")).distinct()
        new = near.join(seen.hint("merge"), ["source_id", "url"], "left_anti").withColumn("level", F.lit(level))
        ranked = seen.unionByName(new).withColumn("__n", F.row_number().over(Window.partitionBy("source_id").orderBy("level", "url")))
        seen = kept(ranked.where(F.col("__n") <= most).drop("__n"))
    return seen


def _quoted(text: Column) -> Column:
    """Percent signs taken off, then put on all but letters, digits, _ . - ~ and /."""
    bare = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    put = F.url_encode(bare)
    for old, new in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        put = F.replace(put, F.lit(old), F.lit(new))
    return put


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, path, rule, allow): the rules for an agent in the robots.txt files (host, body), numbered in their order, each path
    once. They are those of the first group that names a part of the agent's name, else of the first one for all agents.

    A group is a run of agent lines with the rules after it, to the next agent line or an empty line; lines with other fields
    and comments don't end it. An empty Disallow allows all. A file is small, so its lines are in one task."""
    name = agent.split("/")[0].lower()
    lines = robots.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("i", "raw"))
    line = F.trim(F.regexp_replace("raw", r"(?s)#.*", ""))
    field = F.lower(F.trim(F.substring_index(line, ":", 1)))
    value = F.trim(F.regexp_replace(line, r"^[^:]*:", ""))
    kind = F.when(F.col("raw") == "", "end").when(~line.contains(":"), None).when(field == "user-agent", "agent").when(field.isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    order = Window.partitionBy("host").orderBy("i")
    marked = lines.select("host", "i", kind.alias("kind"), field.alias("field"), value.alias("value")).where("kind is not null")
    first = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(order), F.lit("end")) != "agent")
    grouped = marked.withColumn("g", F.sum(F.when(first, 1).otherwise(0)).over(order)).where("g > 0")
    open_ = F.sum(F.when(F.col("kind") == "end", 1).otherwise(0)).over(Window.partitionBy("host", "g").orderBy("i")) == 0
    grouped = grouped.withColumn("open", open_).where("open")
    agents = F.collect_list(F.when(F.col("kind") == "agent", F.lower("value")))
    groups = grouped.groupBy("host", "g").agg(agents.alias("agents"), F.bool_or(F.col("kind") == "rule").alias("full")).where("full")
    general = F.array_contains("agents", "*")
    mine = groups.where(general | F.exists("agents", lambda x: F.lit(name).contains(x))).groupBy("host").agg(F.coalesce(F.min(F.when(~general, F.col("g"))), F.min("g")).alias("g"))
    rules = grouped.where(F.col("field").isin("allow", "disallow")).hint("merge").join(mine.hint("merge"), ["host", "g"])
    path = _quoted(F.regexp_replace("value", r"[?#]+$", ""))
    allow = (F.col("field") == "allow") | (F.col("value") == "")
    return rules.select("host", path.alias("path"), F.col("i").alias("rule"), allow.alias("allow")).groupBy("host", "path").agg(F.min("rule").alias("rule"), F.min_by("allow", "rule").alias("allow"))


def robots_filter(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Links (url) without those that the rules (host, path, rule, allow) of their host disallow. Of the rules whose path begins
    the link's, or is *, the first decides; without one a link stays.

    Links meet rules by equal keys: a link's path is taken apart into its beginnings of the lengths that rules have."""
    lengths = sorted(r[0] for r in rules.where("path <> '*'").select(F.length("path")).distinct().collect())  # as many as lengths
    parts = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)(\?[^#]+)?", 1), F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)(\?[^#]+)?", 2)
    path = _quoted(F.concat(*parts))
    path = F.when(path == "", "/").otherwise(path)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = links.withColumns({"__host": host, "__path": path})
    begins = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length("__path")), lambda k: F.substring(F.col("__path"), F.lit(1), k))
    asked = keyed.select("__host", "__path").distinct().select(F.col("__host").alias("host"), "__path", F.explode(F.concat(F.array(F.lit("*")), begins)).alias("path"))
    decided = asked.hint("merge").join(rules.hint("merge"), ["host", "path"]).groupBy("host", "__path").agg(F.min_by("allow", "rule").alias("allow"))
    barred = decided.where("not allow").select(F.col("host").alias("__host"), "__path")
    return keyed.hint("merge").join(barred.hint("merge"), ["__host", "__path"], "left_anti").select(*links.columns)
