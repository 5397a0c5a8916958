"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

Each benchmark item is a set of five-word shingles. Items are put into size classes (powers of two);
an item of a class up to `hi` shingles is sketched by its floor((1 - t) * hi) + 1 smallest shingle
hashes. A document that holds at least the share t of an item's n shingles misses at most
floor((1 - t) * n) of them, so it holds one of the sketch: the search loses nothing, however long the
document. Candidates are then verified by exact containment on the shingle texts.

Words are maximal runs of letters and digits, in lower case. Null texts count as empty. An item without a
text of five words has no shingle; its whole texts of at least `least_words` words take their place and are
looked up as word sequences. By default there are none, as one to four words are in too many documents to
say anything; items without either are never reported, nor are documents or items whose id is null. Rows that repeat an id count as one document (or item) with the shingles of all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
BROADCAST_CHARS, SALTS = 64 << 20, 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _each_shingle(column: str, width: int, of) -> Column:
    """of(list of the words of one shingle) for each shingle of the word array in `column`."""
    starts = F.sequence(F.lit(0), F.size(column) - width)
    return F.when(F.size(column) >= width, F.transform(starts, lambda i: of([F.get(F.col(column), i + k) for k in range(width)])))


def _small(table: DataFrame, text: str | None = None) -> bool:
    """Whether a table that is written out has few enough rows and characters to be broadcast."""
    rows, chars = table.agg(F.count("*"), F.sum(F.length(text)) if text else F.lit(0)).first()
    return rows <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS


def _joined(left: DataFrame, right: DataFrame, on: list[str], small: bool, how: str = "inner") -> DataFrame:
    """A broadcast of a small right side; else a shuffle with each key dealt into SALTS by the document, as a shingle can be
    in most documents."""
    if small:
        return left.join(right.hint("broadcast"), on, how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)))
    copies = right.withColumn("__salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))
    return salted.join(copies.hint("merge"), [*on, "__salt"], how).drop("__salt")


def _short_items(worded: DataFrame, items: DataFrame, long: DataFrame, least: int, width: int) -> DataFrame:
    """(d, i, n, n_shared) for documents (d, w) that hold texts of least to width - 1 words of items (i, w) that aren't in long (i)."""
    texts = items.where((F.size("w") >= least) & (F.size("w") < width)).join(long.hint("merge"), "i", "left_anti")
    short = saved(texts.select("i", F.concat_ws(" ", "w").alias("s")).distinct(), "decon-short")
    sizes = saved(short.groupBy("i").agg(F.count("*").alias("n")), "decon-short-sizes")
    spelled = [F.coalesce(_each_shingle("w", k, lambda w: F.concat_ws(" ", *w)), F.array().cast("array<string>")) for k in range(least, width)]
    held = worded.select("d", F.explode(F.array_distinct(F.flatten(F.array(*spelled)))).alias("s"))
    shared = _joined(held, short, ["s"], _small(short, "s")).groupBy("d", "i").agg(F.count_distinct("s").alias("n_shared"))
    return _joined(shared, sizes, ["i"], _small(sizes)).select("d", "i", "n", "n_shared")


def contamination(docs: DataFrame, items: DataFrame, doc_id="doc_id", item_id="item_id", text="text", item_text="text", containment=CONTAINMENT, width=SHINGLE_WORDS, least_words: int | None = None) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each document that holds at least the share
    `containment` of an item's distinct shingles."""
    hashed = lambda column: _each_shingle(column, width, lambda w: F.xxhash64(*w))
    spelled = lambda column: _each_shingle(column, width, lambda w: F.concat_ws(" ", *w))
    docs = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null")
    items = items.select(F.col(item_id).alias("i"), words(F.col(item_text)).alias("w")).where("i is not null")

    shingles = saved(items.select("i", F.explode(spelled("w")).alias("s")).distinct().withColumn("h", F.xxhash64(*[F.get(F.split("s", " "), k) for k in range(width)])), "decon-items")
    few_shingles = _small(shingles, "s")
    sizes = shingles.groupBy("i").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("h")).alias("hs"))
    size_class = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))
    keep = F.floor(F.lit(1 - containment) * size_class + 1e-9).cast("int") + 1
    sketches = saved(sizes.select("i", "n", F.explode(F.slice("hs", F.lit(1), keep)).alias("h")), "decon-sketches")
    few_sketches = _small(sketches)

    worded = docs.select("d", words(F.col("t")).alias("w"))
    found = worded.select("d", F.explode(hashed("w")).alias("h"))
    candidates = saved(_joined(found, sketches.select("h", "i", "n"), ["h"], few_sketches).select("d", "i", "n").distinct(), "decon-candidates")
    ids = candidates.select("d").distinct()
    few_candidates = _small(candidates)

    suspects = _joined(docs, ids, ["d"], few_candidates, "left_semi").select("d", words(F.col("t")).alias("w"))
    held = suspects.select("d", F.explode(F.array_distinct(spelled("w"))).alias("s"))
    shared = _joined(held, shingles.select("s", "i"), ["s"], few_shingles)
    shared = _joined(shared, candidates, ["d", "i"], few_candidates)
    pairs = shared.groupBy("d", "i", "n").agg(F.count_distinct("s").alias("n_shared"))
    if least_words is not None and least_words < width:
        pairs = pairs.unionByName(_short_items(worded, items, sizes.select("i"), max(least_words, 1), width))
    return pairs.where(F.col("n_shared") >= F.lit(containment) * F.col("n") - 1e-9).select(
        F.col("d").alias("doc_id"), F.col("i").alias("item_id"), F.col("n_shared").cast("long").alias("n_shared"), F.col("n").cast("long").alias("n_item"), F.round(F.col("n_shared") / F.col("n"), 6).alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """docs without the documents that hold a benchmark item; rows with a null id stay."""
    leaked = contamination(docs, items, doc_id=doc_id, text=text).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(leaked.hint("merge"), F.col(doc_id) == F.col("__leaked"), "left_anti")
