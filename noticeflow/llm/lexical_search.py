"""Ranked lexical search: the documents that score highest for each item of a query set, by the Best Position Algorithm.

One pass over the documents cuts every text into terms and writes, for blocks of documents, the lengths and the postings of
the query set's terms. The numbers over all documents (how many have terms, their lengths, in how many each query term is)
are sums over the blocks. Then each block holds, for each query term, an impact list (its postings by what they add to a
score, the highest first) and direct access by document (binary search over the postings in document order).

For an item the lists of its terms are read from the top in steps. Each document that is met for the first time is looked
up in all lists, which marks its place in each. A list's best position is the end of the places seen without a gap from the
top, by reading or by lookup; no document that has not been met can add more in that list than the place after it. Reading
stops when the sum of these impacts is strictly below the score of the lowest of the TOP documents, as equal scores go to
the smaller id. A task carries its best documents of each item from block to block, so later blocks stop sooner; the best
of all tasks meet in a ranking that keeps TOP rows an item before the shuffle.

Terms are runs of letters, digits and characters outside ASCII, with A-Z in lower case. A term's weight is
w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's m = 50 + 50 n N div L, and its score the sum over the item's terms of
w * (10^9 tf div (1000 tf + 20 m)).

Null texts have no terms; documents and items without id are left out and not counted; items of the same id are one item with
the terms of all; a repeated document is ranked as often as it occurs; other columns aren't read. Items without a term in any
document, and tables without rows, give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_div, saved, short_batches

TOP = 50
#: Documents and postings in a block; places read of each list in the first step; characters of query terms that are handed
#: to tasks at a time (larger query sets are searched in parts).
BLOCK_DOCS, BLOCK_POSTINGS, STEP, QUERY_CHARS = 16_384, 2_000_000, 32, 16_000_000
_TERMS = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of UTF-8 text: A-Z in lower case, all that is in no term a space.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _TERMS else 0x20 for b in range(256))
_BLOCK = "doc_ids binary, lengths binary, with_terms long, length long, terms array<int>, dfs array<long>, docs binary, tfs binary"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _item_terms(batches):
    for batch in batches:
        ids, found = [], []
        for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            some = set(terms(text))
            ids += [i] * len(some)
            found += some
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])


def _block(ids: list[int], lengths: list[int], found: list[Counter]) -> pa.RecordBatch:
    """Documents in id order; postings by term and document."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    sizes = [len(found[k]) for k in order]
    term = np.fromiter(itertools.chain.from_iterable(found[k].keys() for k in order), dtype=np.int64, count=sum(sizes))
    tf = np.fromiter(itertools.chain.from_iterable(found[k].values() for k in order), dtype=np.int64, count=sum(sizes))
    doc = np.repeat(np.arange(len(order)), sizes)
    by_term = np.argsort(term, kind="stable")
    used, df = np.unique(term, return_counts=True)
    n = np.array([lengths[k] for k in order], dtype=np.int64)
    arrays = [pa.array([np.array([ids[k] for k in order], dtype=np.int64).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())]
    arrays += [pa.array([used], pa.list_(pa.int32())), pa.array([df], pa.list_(pa.int64())), pa.array([doc[by_term].astype(np.int32).tobytes()], pa.binary()), pa.array([tf[by_term].astype(np.int32).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, [c.split(" ")[0] for c in _BLOCK.split(", ")])


def _blocks(number: dict[bytes, int]):
    def rows(batches):
        ids: list[int] = []
        lengths: list[int] = []
        found: list[Counter] = []
        size = 0
        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = terms(text)
                if not words:
                    continue
                mine = Counter(map(number.get, words))
                mine.pop(None, None)
                ids.append(i)
                lengths.append(len(words))
                found.append(mine)
                size += len(mine)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield _block(ids, lengths, found)
                    ids, lengths, found, size = [], [], [], 0
        if ids:
            yield _block(ids, lengths, found)

    return rows


class ImpactLists:
    """The lists of one block: postings in document order with their impacts, and the same by falling impact."""

    def __init__(self, row: dict, weight: np.ndarray, n_docs: int, length: int):
        self.doc_ids = np.frombuffer(row["doc_ids"], dtype=np.int64)
        n = np.frombuffer(row["lengths"], dtype=np.int64)
        self.doc = np.frombuffer(row["docs"], dtype=np.int32).astype(np.int64)
        tf = np.frombuffer(row["tfs"], dtype=np.int32).astype(np.int64)
        self.place_of = {t: k for k, t in enumerate(row["terms"])}
        self.start = np.concatenate([[0], np.cumsum(row["dfs"])]).astype(np.int64)
        of = np.repeat(np.arange(len(row["terms"])), np.diff(self.start))
        m = 50 + 50 * n * n_docs // length
        self.impact = weight[np.array(row["terms"], dtype=np.int64)][of] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc]))
        self.key = of * len(self.doc_ids) + self.doc
        self.by_impact = np.lexsort((-self.impact, of))
        self.position = np.empty(len(of), dtype=np.int64)  # of a posting in its list
        self.position[self.by_impact] = np.arange(len(of)) - self.start[of]

    def best(self, item: list[int], top: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The best of `top` (scores, ids: the best documents so far, best first) and of this block."""
        lists = np.array([self.place_of[t] for t in item if t in self.place_of], dtype=np.int64)
        if not len(lists):
            return top
        start, size = self.start[lists], self.start[lists + 1] - self.start[lists]
        first = np.cumsum(size) - size  # of each list in the array of seen places
        seen = np.zeros(int(size.sum()), dtype=bool)
        met = np.zeros(len(self.doc_ids), dtype=bool)
        best = np.zeros(len(lists), dtype=np.int64)
        read, step = 0, STEP
        while True:
            # sorted access: the next places of each list
            count = np.clip(size - read, 0, step)
            places = np.repeat(start + read - (np.cumsum(count) - count), count) + np.arange(count.sum())
            docs = np.unique(self.doc[self.by_impact[places]])
            docs = docs[~met[docs]]
            read += step
            step *= 2
            # direct access: a new document's place in every list
            if len(docs):
                met[docs] = True
                key = (lists[:, None] * len(self.doc_ids) + docs).ravel()
                at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = self.key[at] == key
                score = np.where(hit, self.impact[at], 0).reshape(len(lists), len(docs)).sum(axis=0)
                seen[(first[:, None] + self.position[at].reshape(len(lists), -1))[hit.reshape(len(lists), -1)]] = True
                top = _merged(top, score, self.doc_ids[docs])
            bound = 0
            for k in range(len(lists)):
                if best[k] < size[k]:
                    rest = seen[first[k] + best[k] : first[k] + size[k]]
                    best[k] = size[k] if rest.all() else best[k] + int(rest.argmin())
                if best[k] < size[k]:
                    bound += int(self.impact[self.by_impact[start[k] + best[k]]])
            if bound == 0 or (len(top[0]) == TOP and bound < top[0][-1]):
                return top


def _merged(top: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fit = score >= top[0][-1] if len(top[0]) == TOP else score > 0
    if not fit.any():
        return top
    score, ids = np.concatenate([top[0], score[fit]]), np.concatenate([top[1], ids[fit]])
    order = np.lexsort((ids, -score))[:TOP]
    return score[order], ids[order]


def _search(items: dict[int, list[int]], weight: np.ndarray, n_docs: int, length: int):
    def rows(batches):
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        top = dict.fromkeys(items, none)
        for batch in batches:
            for k in range(batch.num_rows):
                lists = ImpactLists(batch.slice(k, 1).to_pylist()[0], weight, n_docs, length)
                for i, item in items.items():
                    top[i] = lists.best(item, top[i])
        for i, (score, ids) in top.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int64()), pa.array(ids), pa.array(score)], ["item_id", "doc_id", "score"])

    return rows


def _part(docs: DataFrame, rows: list) -> DataFrame | None:
    """The best documents for some items, given as (item_id, term) rows; each task's own best."""
    number = {t: k for k, t in enumerate(sorted({bytes(r.term) for r in rows}))}
    items: dict[int, list[int]] = {}
    for r in rows:
        items.setdefault(r.item_id, []).append(number[bytes(r.term)])
    blocks = saved(docs.mapInArrow(_blocks(number), _BLOCK), "search-blocks")
    n_docs, length = blocks.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not n_docs:
        return None
    df = np.zeros(len(number), dtype=np.int64)
    for term, n in blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs")).collect():  # as many as query terms
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
    items = {i: kept for i, some in items.items() if (kept := [t for t in some if df[t] and weight[t]])}
    return blocks.mapInArrow(_search(items, weight, n_docs, length), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents with a score above 0 for each item, the highest score first, equal
    ones by id."""
    spark = docs.sparkSession
    short_batches(spark)
    asked = saved(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null").mapInArrow(_item_terms, "item_id long, term binary").distinct(), "search-items")
    chars = asked.agg(F.coalesce(F.sum(F.length("term") + 16), F.lit(0))).first()[0]
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    parts = ceil_div(chars, QUERY_CHARS)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for k in range(parts):
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()
        if some and (one := _part(plain, some)) is not None:
            found = found.unionByName(one)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")
