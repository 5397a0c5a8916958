"""Readers of landed payloads: paged JSON, CSV of unknown delimiter, XML acts, JSON inside pages."""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.snapshot import scratch

PAGE_SCHEMA = "totalPages int, last boolean, entitiesCount bigint, batching struct<next:string>, content array<struct<id:string,title:string,deadline:string>>"
DELIMITERS = (";", ",", "\t", "|")
HEAD_LINES, BROADCAST_FILES = 20, 50_000
#: Sources in an Arrow batch.
BATCH_ROWS = 256


def read_paged_json(payloads: DataFrame, size: int | None = None) -> DataFrame:
    """(source_id, id, title, deadline) of payloads (source_id, page, body). A record that comes again has what its last page
    says; records without id are left out.

    A source's pages end with the first one that is announced as the last, is the last of totalPages or has fewer than `size`
    records, and before the first one that is empty. Where a source says how many entities there are, they also end before a
    page without a new id and once so many have come."""
    parsed = _kept(payloads.select("source_id", "page", F.from_json("body", PAGE_SCHEMA).alias("p")).select("source_id", "page", "p.*"), "paged")
    rows = parsed.select("source_id", "page", F.explode("content").alias("r")).select("source_id", "page", "r.*").where("id <> ''")
    fresh = rows.groupBy("source_id", "id").agg(F.min("page").alias("page")).groupBy("source_id", "page").agg(F.count("*").alias("fresh"))
    n = F.size(F.coalesce("content", F.array().cast("array<struct<id:string,title:string,deadline:string>>")))
    pages = parsed.select("source_id", "page", "totalPages", "last", "entitiesCount", n.alias("n")).hint("merge").join(fresh.hint("merge"), ["source_id", "page"], "left")
    # A row for each page, not for each record.
    so_far = F.sum(F.coalesce("fresh", F.lit(0))).over(Window.partitionBy("source_id").orderBy("page"))
    counted = pages.withColumn("so_far", so_far)
    known = F.coalesce(F.col("entitiesCount"), F.lit(0)) > 0
    last = F.coalesce(F.col("last"), F.lit(False)) | F.coalesce(F.col("page") + 1 >= F.col("totalPages"), F.lit(False)) | (known & (F.col("so_far") >= F.col("entitiesCount")))
    last = last | (F.col("n") < size) if size else last
    ended = (F.col("n") == 0) | (known & F.col("fresh").isNull())
    stop = counted.groupBy("source_id").agg(F.least(F.min(F.when(last, F.col("page"))), F.min(F.when(ended, F.col("page"))) - 1).alias("stop"))
    kept = rows.hint("merge").join(stop.hint("merge"), "source_id").where("stop is null or page <= stop")
    return kept.groupBy("source_id", "id").agg(F.max_by(F.struct("title", "deadline"), "page").alias("r")).select("source_id", "id", "r.*")


#: The pages of a source that one task walks through at once; a source with more is numbered by doubling.
WALK_PAGES = 4096


def linked_pages(payloads: DataFrame, starts: DataFrame) -> DataFrame:
    """(source_id, page, body): payloads (source_id, url, body), each of which names the next one in batching.next, numbered
    along the way from the source's start (source_id, url). A page that the way comes to again keeps its first number; pages
    off the way are left out. Payloads are read twice.

    Up to WALK_PAGES links of a source are walked in its group; those of larger sources are numbered by doubling, so no group
    grows with the input."""
    links = payloads.select("source_id", "url", F.from_json("body", "batching struct<next:string>")["batching"]["next"].alias("to")).where("to is not null and to <> url")
    links = links.unionByName(starts.select("source_id", F.lit(None).cast("string").alias("url"), F.col("url").alias("to")).distinct())
    links = _kept(links.withColumn("n", F.count("*").over(Window.partitionBy("source_id"))), "links")
    links.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    grouped = links.where(F.col("n") <= WALK_PAGES).groupBy("source_id").agg(F.collect_list(F.struct("url", "to")).alias("links"))
    placed = grouped.select("source_id", F.col("links.url").alias("froms"), F.col("links.to").alias("tos")).mapInArrow(_walked, "source_id long, url string, page long")
    large = links.where(F.col("n") > WALK_PAGES).drop("n")
    if not large.isEmpty():
        placed = placed.unionByName(_doubled(large.where("url is not null"), large.where("url is null").select("source_id", F.col("to").alias("url"))))
    return payloads.hint("merge").join(placed.hint("merge"), ["source_id", "url"]).select("source_id", "page", "body")


def _walked(batches):
    """The pages that a source's links lead to from its starts (links from nowhere), by the number of links."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for source, froms, tos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            after: dict[str | None, list[str]] = {}
            for x, y in zip(froms, tos, strict=True):
                after.setdefault(x, []).append(y)
            number: dict[str, int] = {}
            now, page = after.get(None, []), 0
            while now := [u for u in dict.fromkeys(now) if u not in number]:
                number |= dict.fromkeys(now, page)
                now, page = [v for u in now for v in after.get(u, ())], page + 1
            for column, values in zip(out, ([source] * len(number), number.keys(), number.values()), strict=True):
                column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64()), strict=True)], ["source_id", "url", "page"])


def _doubled(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(source_id, url, page). Numbers double with each round, and each round is written out."""
    jumps = _kept(links, "jumps")
    placed, found, hop = _kept(starts.select("source_id", "url", F.lit(0).cast("long").alias("page")), "placed"), 0, 1
    while (count := placed.count()) > found:
        found = count
        ahead = placed.hint("merge").join(jumps.hint("merge"), ["source_id", "url"]).select("source_id", F.col("to").alias("url"), (F.col("page") + hop).alias("page"))
        placed = _kept(placed.unionByName(ahead).groupBy("source_id", "url").agg(F.min("page").alias("page")), "placed")
        on = jumps.select("source_id", F.col("url").alias("to"), F.col("to").alias("further"))
        jumps, hop = _kept(jumps.hint("merge").join(on.hint("merge"), ["source_id", "to"]).select("source_id", "url", F.col("further").alias("to")).distinct(), "jumps"), 2 * hop
    return placed


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sniffed_delimiter(head: Column) -> Column:
    """The delimiter that the first line has most of, of equals the one that all of the first lines have; ; without any."""
    count = lambda text, d: F.length(text) - F.length(F.replace(text, F.lit(d), F.lit("")))
    counts = [F.struct(count(F.substring_index(head, "\n", 1), d).alias("first"), count(head, d).alias("n"), F.lit(-i).alias("k"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["d"]).otherwise(DELIMITERS[0])


#: Bytes that have no character in windows-1252, and those that have another than in latin-1, with it.
NO_CP1252 = "[\x81\x8d\x8f\x90\x9d]"
_OTHER = bytes(b for b in range(0x80, 0xA0) if not re.match(NO_CP1252, chr(b)))
CP1252 = (_OTHER.decode("latin-1"), _OTHER.decode("cp1252"))


def read_csv_export(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of CSV files with a header record, by position. Each file has its own encoding (UTF-8 with or without mark if all
    of it is, else windows-1252, or latin-1 where a byte has no character there) and the delimiter that its first lines have
    most of. Line breaks inside quotes belong to the record and become \n; empty lines are left out.

    Files are read as lines, in splits, so a file of any size is spread over tasks. A record ends where an even number of
    quotes has come since the file began: quotes are counted for each split, summed over the splits before, and a record that
    goes on in the next split is put together by its first line. Only files with a line of an odd number of quotes, or with
    another line like their header, take that way."""
    raw = spark.read.text(path).select(F.col("value").cast("binary").alias("b"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    latin = F.decode("b", "ISO-8859-1")
    begins = raw.where("at = 0").withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("k"))).where(F.col("n") <= HEAD_LINES)
    heads = begins.groupBy("file").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.struct("n", latin.alias("v"))))["v"]).alias("head"), F.min_by("b", "n").alias("header"))
    flags = raw.groupBy("file").agg(F.bool_and(F.is_valid_utf8(F.col("b").cast("string"))).alias("utf8"), F.bool_and(~latin.rlike(NO_CP1252)).alias("cp1252"), F.bool_or(_quotes(latin) % 2 == 1).alias("broken"))
    heads = _kept(heads.select("file", sniffed_delimiter(F.col("head")).alias("d"), "header").hint("merge").join(flags.hint("merge"), "file"), "csv-heads")
    near = "broadcast" if heads.count() <= BROADCAST_FILES else "merge"
    again = raw.join(heads.select("file", "header").hint(near), "file").where("b = header").groupBy("file").agg((F.count("*") > 1).alias("again"))
    files = _kept(heads.hint("merge").join(again.hint("merge"), "file").withColumn("broken", F.col("broken") | F.col("again")).drop("again"), "csv-files")
    value = F.when(F.col("utf8"), F.col("b").cast("string")).when(F.col("cp1252"), F.translate(latin, *CP1252)).otherwise(F.decode("b", "ISO-8859-1"))
    lines = raw.join(files.hint(near), "file").withColumn("value", value)
    whole = lines.where("not broken and b <> header")
    parts = _records(lines.where("broken"))
    records = whole.select("d", "value").unionByName(parts).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "multiLine": "true", "escape": '"'}
    parsed = [records.where(F.col("d") == d).select(F.from_csv("value", columns, options | {"sep": d}).alias("r")).select("r.*") for d in DELIMITERS]
    return functools.reduce(DataFrame.unionByName, parsed)


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _records(lines: DataFrame) -> DataFrame:
    """(d, value): lines put together to records, without the first of each file. A split's lines are in one task at a time."""
    split = Window.partitionBy("file", "at").orderBy("k")
    inside = lines.select("file", "at", "k", "d", "value").withColumns({"n": F.row_number().over(split), "quotes": F.coalesce(F.sum(_quotes(F.col("value"))).over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "own": _quotes(F.col("value"))})
    inside = _kept(inside.drop("k"), "csv-lines")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = inside.groupBy("file", "at").agg(F.sum("own").alias("all")).withColumn("earlier", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    marked = _kept(inside.hint("merge").join(splits.hint("merge"), ["file", "at"]).withColumn("starts", (F.col("earlier") + F.col("quotes")) % 2 == 0), "csv-marked")
    last = marked.where("starts").groupBy("file", "at").agg(F.max("n").alias("n"))
    carried = splits.select("file", "at").hint("merge").join(last.hint("merge"), ["file", "at"], "left").withColumn("from", F.last(F.when(F.col("n").isNotNull(), F.struct("at", "n")), ignorenulls=True).over(before)).select("file", "at", "from")
    within = F.last(F.when(F.col("starts"), F.struct("at", "n")), ignorenulls=True).over(Window.partitionBy("file", "at").orderBy("n"))
    keyed = marked.withColumn("own_start", within).hint("merge").join(carried.hint("merge"), ["file", "at"]).withColumn("start", F.coalesce("own_start", "from"))
    made = keyed.groupBy("file", "d", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return made.where("start.at > 0 or start.n > 1").select("d", "value")


def read_xml_acts(documents: DataFrame, column: str = "xml") -> DataFrame:
    """One row for each <atto> of documents with several: other columns, oggetto, web, pubblicatodal."""
    acts = F.regexp_extract_all(F.col(column), F.lit(r"(?s)<atto\b.*?</atto>"), F.lit(0))
    parsed = documents.withColumn("act", F.explode(acts)).withColumn("a", F.from_xml("act", "oggetto string, web string, pubblicatodal string"))
    return parsed.select(*[c for c in documents.columns if c != column], "a.oggetto", "a.web", "a.pubblicatodal")


def read_embedded_json(pages: DataFrame, marker: str, schema: str, column: str = "html") -> DataFrame:
    """Rows of the JSON array that follows a marker inside an escaped script. The text between the marker's bracket and the
    end of the script is unescaped; brackets inside strings don't matter as the array ends the script's string."""
    raw = F.regexp_extract(F.col(column), marker + r'\\?":\s*(\[.*?\])\s*\}?\\?"?\s*</script>', 1)
    plain = F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return pages.withColumn("__r", F.explode(F.from_json(plain, f"array<struct<{schema}>>"))).select(*[c for c in pages.columns if c != column], "__r.*")


def draft_text(body: str | None) -> str:
    """The texts of all `blocks` lists in a JSON text, at any depth and in its order, joined by spaces; each text is trimmed,
    lists without text add nothing. What lies inside the blocks themselves isn't looked at. Null and no JSON give ''."""
    try:
        todo = [json.loads(body or "null", parse_constant=_no_number)]
    except (ValueError, RecursionError):
        return ""
    out = []
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            blocks = value.get("blocks")
            if isinstance(blocks, list):
                out.append(" ".join(str(b["text"]).strip() for b in blocks if isinstance(b, dict) and b.get("text")))
                continue
            value = list(value.values())
        if isinstance(value, list):
            todo += [v for v in reversed(value) if isinstance(v, (dict, list))]
    return " ".join(filter(None, out)).encode("utf-8", "replace").decode()


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


@F.pandas_udf(T.StringType())
def json_text_flatten(body: pd.Series) -> pd.Series:
    """draft_text of each body. One pass over a body, whatever its depth."""
    return body.map(draft_text)
