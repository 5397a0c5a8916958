"""Line dedup with sharded cuckoo filters over exact reference-count tables.

State, all in tables: `parts` (shard, hi, lo, doc_id, n_lines), one for each insertion, says which document
holds which line key; `gone` (doc_id, upto) says which documents of the first parts have been deleted;
`refs` (shard, hi, lo, n_docs, owner) counts the documents of a key and names the smallest; `filters`
(shard, blob) holds a cuckoo filter of the keys with at least two documents. An insertion adds a part, a
deletion adds to `gone`; parts are never written again, except by compacted(). Counts are added and taken
for the keys that are touched, and `refs`, a row for each key, is written with them; only a deletion that
takes a key's owner looks for the next one in the parts. Only keys whose count crosses two enter or leave a filter. So deletion is the
exact inverse of insertion. A document that the index holds already is not inserted again, so a batch that
comes twice counts once. To dedup, postings are probed in their shard's filter; what the filter lets
through is checked in the exact table; the lines of a key go from all documents but its owner.

A line's key is the line without ASCII white space at its ends, A-Z in lower case, as a 128-bit hash
(blake2b); keys of fewer than MIN_KEY code points never count. Null or empty texts have one empty line.
Rows that repeat an id count as one document. Rows with a null id are kept whole and count for nothing.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ceil_div, joined_by_key, saved, short_batches
from .cuckoo import CuckooFilter

MIN_KEY = 10
SHARD_KEYS, CHUNK_ROWS, LEAST_SHARDS = 200_000, 500_000, 8
WHITE = " \t\n\r\x0b\x0c"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEY = ["hi", "lo"]


def line_key(line: str) -> tuple[int, int] | None:
    key = line.strip(WHITE)
    if len(key) < MIN_KEY:
        return None
    return struct.unpack("<qq", hashlib.blake2b(key.translate(_LOWER).encode("utf-8", "surrogatepass"), digest_size=16).digest())


def _line_rows(batches):
    for batch in batches:
        ids, his, los, counts = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys: dict[tuple[int, int], int] = {}
            for line in (text or "").split("\n"):
                if (k := line_key(line)) is not None:
                    keys[k] = keys.get(k, 0) + 1
            ids += [doc_id] * len(keys)
            his += [k[0] for k in keys]
            los += [k[1] for k in keys]
            counts += keys.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "hi", "lo", "n_lines"])


@dataclass
class LineIndex:
    shards: int
    parts: tuple[DataFrame, ...]
    gone: DataFrame | None
    refs: DataFrame
    filters: DataFrame

    @property
    def postings(self) -> DataFrame:
        """The postings of all documents that are there."""
        numbered = [p.withColumn("part", F.lit(k)) for k, p in enumerate(self.parts)]
        held = functools.reduce(DataFrame.unionByName, numbered)
        if self.gone is not None:
            held = held.hint("merge").join(self.gone, "doc_id", "left").where("upto is null or part > upto").drop("upto")
        return held.drop("part")

    def insert(self, docs: DataFrame, doc_id="doc_id", text="text") -> LineIndex:
        """The index with those documents of docs whose ids it doesn't hold."""
        added = saved(postings_of(docs, self.shards, doc_id, text), "lines-postings")
        known = self.postings.select("doc_id").distinct()
        added = saved(added.hint("merge").join(known, "doc_id", "left_anti"), "lines-postings")
        change = counted(added)
        refs = self.refs.select("shard", *KEY, "n_docs", "owner")
        old = refs.hint("merge").join(change.select(*KEY), KEY, "left_semi")
        now = old.unionByName(change).groupBy("shard", *KEY).agg(F.sum("n_docs").alias("n_docs"), F.min("owner").alias("owner"))
        return self._changed(old, now, (*self.parts, added), self.gone)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose ids are in the first column of ids."""
        leave = saved(ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).distinct(), "lines-gone")
        lost = saved(self.postings.hint("merge").join(leave, "doc_id", "left_semi"), "lines-lost")
        upto = leave.withColumn("upto", F.lit(len(self.parts) - 1))
        gone = upto if self.gone is None else saved(self.gone.unionByName(upto).groupBy("doc_id").agg(F.max("upto").alias("upto")), "lines-gone")
        change = lost.groupBy(*KEY).agg(F.count("*").alias("less"))
        touched = saved(self.refs.hint("merge").join(change, KEY).withColumn("n_docs", F.col("n_docs") - F.col("less")), "lines-touched")
        old = touched.select("shard", *KEY, (F.col("n_docs") + F.col("less")).alias("n_docs"), "owner")
        stay = touched.where("n_docs > 0").select("shard", *KEY, "n_docs", "owner")
        ownerless = stay.hint("merge").join(lost.select(*KEY, F.col("doc_id").alias("owner")), [*KEY, "owner"], "left_semi")
        later = LineIndex(self.shards, self.parts, gone, self.refs, self.filters)
        heirs = later.postings.hint("merge").join(ownerless.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min("doc_id").alias("heir"))
        now = stay.hint("merge").join(heirs, KEY, "left").select("shard", *KEY, "n_docs", F.coalesce("heir", "owner").alias("owner"))
        return self._changed(old, now, self.parts, gone)

    def _changed(self, old: DataFrame, now: DataFrame, parts: tuple[DataFrame, ...], gone: DataFrame | None) -> LineIndex:
        """The index with the refs `now` of the keys that are in old or now."""
        old, now = saved(old, "lines-old"), saved(now, "lines-now")
        refs = saved(self.refs.hint("merge").join(old.select(*KEY), KEY, "left_anti").unionByName(now), "lines-refs")
        was, will = (x.where("n_docs >= 2").select("shard", *KEY) for x in (old, now))
        enter = will.hint("merge").join(was, KEY, "left_anti").select("shard", "hi", F.lit(True).alias("enters"))
        leave = was.hint("merge").join(will, KEY, "left_anti").select("shard", "hi", F.lit(False).alias("enters"))
        filters = saved(self.filters.groupBy("shard").cogroup(enter.unionByName(leave).groupBy("shard")).applyInPandas(_filter_changes, "shard int, blob binary"), "lines-filters")
        full = filters.where("blob is null").select("shard")
        if full.limit(1).count():
            filters = saved(filters.where("blob is not null").unionByName(built_filters(refs.join(full, "shard", "left_semi"))), "lines-filters")
        return LineIndex(self.shards, parts, gone, refs, filters)

    def compacted(self) -> LineIndex:
        """The same index with one part and nothing marked as gone."""
        return LineIndex(self.shards, (saved(self.postings, "lines-postings"),), None, self.refs, self.filters)

    def drops(self) -> DataFrame:
        """(doc_id, hi, lo): the keys whose lines a document loses. Lines that many documents share are hot keys."""
        postings = self.postings
        n = postings.count()
        chunks = max(1, ceil_div(n, self.shards * CHUNK_ROWS))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")
        probes = postings.select("shard", *KEY, "doc_id").withColumn("salt", salt)
        filters = self.filters.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(chunks)])))
        maybe = saved(probes.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(_probe, "hi long, lo long, doc_id long"), "lines-maybe")
        repeated = self.refs.where("n_docs >= 2").select(F.struct(*KEY).alias("key"), "owner", F.col("n_docs").alias("n"))
        found = joined_by_key(maybe.select(F.struct(*KEY).alias("key"), "doc_id"), repeated, "key", n)
        return found.where("doc_id <> owner").select("doc_id", "key.*")


def postings_of(docs: DataFrame, shards: int, doc_id="doc_id", text="text") -> DataFrame:
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").mapInArrow(_line_rows, "doc_id long, hi long, lo long, n_lines long")
    return rows.groupBy(F.pmod("lo", F.lit(shards)).cast("int").alias("shard"), *KEY, "doc_id").agg(F.sum("n_lines").alias("n_lines"))


def counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("shard", *KEY).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("owner"))


def built_filters(refs: DataFrame) -> DataFrame:
    return refs.where("n_docs >= 2").select("shard", "hi").groupBy("shard").applyInPandas(lambda pdf: pd.DataFrame({"shard": pdf["shard"].iloc[:1], "blob": [CuckooFilter.of(pdf["hi"].to_numpy()).to_bytes()]}), "shard int, blob binary")


def build(docs: DataFrame, doc_id="doc_id", text="text") -> LineIndex:
    """The index of docs, with a shard for each SHARD_KEYS repeated keys."""
    postings = saved(postings_of(docs, 1, doc_id, text), "lines-postings")
    refs = counted(postings)
    refs = saved(refs, "lines-refs")
    shards = max(LEAST_SHARDS, ceil_div(refs.where("n_docs >= 2").count(), SHARD_KEYS))
    number = F.pmod("lo", F.lit(shards)).cast("int")
    postings, refs = postings.withColumn("shard", number), refs.withColumn("shard", number)
    return LineIndex(shards, (postings,), None, refs, saved(built_filters(refs), "lines-filters"))


def _filter_changes(held: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """The filter of one shard after its changes; a null blob says that it must be built with more room."""
    shard = (held if len(held) else changes)["shard"].iloc[0]
    enter, leave = (changes.loc[changes["enters"] == x, "hi"].to_numpy() for x in (True, False))
    if not len(held):
        return pd.DataFrame({"shard": [shard], "blob": [CuckooFilter.of(enter).to_bytes()]})
    f = CuckooFilter.from_bytes(held["blob"].iloc[0])
    f.delete(leave)
    return pd.DataFrame({"shard": [shard], "blob": [f.to_bytes() if f.insert(enter) else None]})


def _probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(filters) or not len(rows):
        return rows.iloc[:0][["hi", "lo", "doc_id"]]
    return rows.loc[CuckooFilter.from_bytes(filters["blob"].iloc[0]).contains(rows["hi"].to_numpy()), ["hi", "lo", "doc_id"]]


def _rewriter(text: str):
    def rows(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for value, drop in zip(batch.column(text).to_pylist(), batch.column(DROP).to_pylist(), strict=True):
                lines = (value or "").split("\n")
                gone = {(d["hi"], d["lo"]) for d in drop or ()}
                kept = [x for x in lines if line_key(x) not in gone] if gone else lines
                texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            at = batch.schema.get_field_index(DROP)
            others = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, *MADE])

    return rows


DROP, MADE = "__drop", ("__kept", "__n_lines", "__n_dropped")


def rewritten(docs: DataFrame, index: LineIndex | None = None, doc_id="doc_id", text="text") -> DataFrame:
    """All columns of docs with __kept, __n_lines and __n_dropped, one row for each row; index must hold docs."""
    index = index or build(docs, doc_id, text)
    by_doc = index.drops().groupBy(F.col("doc_id").alias("__d")).agg(F.collect_list(F.struct(*KEY)).alias(DROP))
    joined = docs.hint("merge").join(by_doc, F.col(doc_id).cast("long") == F.col("__d"), "left").drop("__d")
    schema = T.StructType([*docs.schema.fields, T.StructField("__kept", T.StringType()), *(T.StructField(n, T.LongType()) for n in MADE[1:])])
    short_batches(docs.sparkSession)
    return joined.mapInArrow(_rewriter(text), schema)


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped), one row for each row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rewritten(rows, index).select("doc_id", *(F.col(n).alias(n[2:]) for n in MADE))


def without_repeated_lines(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """docs, all columns, with each text cut to its kept lines."""
    return rewritten(docs, None, doc_id, text).withColumn(text, F.col("__kept")).select(*docs.columns)
