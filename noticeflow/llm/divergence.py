"""How far each source's use of words lies from the other sources of its language, and which words make it so.

Terms are runs of letters, and of all characters outside ASCII, with A-Z in lower case. A language keeps the terms that are
in at least MIN_DOCS of its documents. With N the occurrences of kept terms in a group and V the number of kept terms, a
term's share in parts of 10^9 is p = 1 + floor(10^9 (count + 1) / (N + V)), and the divergence of a group from another is the
sum over kept terms of floor((p - q)^2 / q).

The sum over all terms for all pairs of groups is a sparse matrix product with another inner operation, and is done row by
row (Gustavson): the term-major index lies in term order over tasks; for each group in a piece of it, its terms are
scattered through their postings into one dense accumulator over the peers, so a pair of postings is never a row. What the
product leaves out are terms that one or both of two groups lack, whose p or q is the group's baseline, that of count 0.
They follow from the groups' histograms of counts: a term of one group counts as if all peers lacked it, and the scatter
adds for each shared term the true value less the two baseline values plus the value where both lack it.

A row of documents is a document; null text, lang and source count as ''. Arithmetic is exact: 64-bit integers, long
division where a product would not fit. A group is one (lang, source); repeated rows count as often as they occur; other
columns aren't read. Tables without rows give no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_by_key, saved, short_batches, shuffle_partitions

MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Distinct (group, term) counts that a task holds before it hands them on.
HELD_TERMS = 400_000
#: Postings of a piece of the term-major index, and peers in a block of the baselines.
PIECE, PEERS = 1 << 17, 4096
_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of UTF-8 text: A-Z in lower case, all that is in no term a space.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, df long"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _counts(batches):
    """Occurrences of terms and numbers of documents that have them, by group, added up in the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        for (lang, source), (n, df) in held.items():
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array([0] * k)), pa.array([source]).take(pa.array([0] * k)), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(df.__getitem__, n), pa.int64())], ["lang", "source", "term", "n", "df"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = Counter(terms(text))
            if not found:
                continue
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(found)
            df.update(found.keys())
            size += len(n)
            if size > HELD_TERMS:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def _share(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """p of count among size = N + V, by long division with three digits of base 1000."""
    out, rest = np.zeros(len(count), dtype=np.int64), count + 1
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        out = out * 1000 + digit
    return out + 1


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pairs(lang: list, source: list, item: list, value: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


def _scatter(batches):
    """Rows (lang, term, source, n, size) sorted by lang and term: what shared terms add to the baselines of each pair."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= PIECE:
            table = pa.concat_tables(held).combine_chunks()
            whole = np.flatnonzero(_fresh(table["lang"]) | _fresh(table["term"]))[-1]
            if whole:  # the last term may go on in the next batch
                yield from _piece(table.slice(0, whole))
            held, size = [table.slice(whole)], size - whole
    if size:
        yield from _piece(pa.concat_tables(held).combine_chunks())


def _fresh(column: pa.ChunkedArray) -> np.ndarray:
    """Where a sorted column has another value than in the row before."""
    return np.concatenate([[True], pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()])


def _piece(table: pa.Table):
    """The scatter of a piece of the index that holds whole terms."""
    cuts = [*np.flatnonzero(_fresh(table["lang"])).tolist(), table.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = table.slice(a, b - a)
        lang, sources = part["lang"][0].as_py(), part["source"].combine_chunks().dictionary_encode()
        names, peer = np.array(sources.dictionary.to_pylist(), dtype=object), sources.indices.to_numpy()
        size = part["size"].to_numpy()
        fresh = _fresh(part["term"])
        row = np.cumsum(fresh) - 1
        begin = np.append(np.flatnonzero(fresh), len(fresh))
        share, base = _share(part["n"].to_numpy(), size), 1 + SCALE // size
        by_group = np.argsort(peer, kind="stable")
        groups = np.searchsorted(peer[by_group], np.arange(len(names) + 1))
        for g in range(len(names)):
            mine = by_group[groups[g] : groups[g + 1]]
            first, count = begin[row[mine]], np.diff(begin)[row[mine]]
            other = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            p, p0 = np.repeat(share[mine], count), base[mine[0]]
            q, q0 = share[other], base[other]
            into = np.zeros(len(names), dtype=np.int64)
            np.add.at(into, peer[other], _far(p, q) - _far(p, q0) - _far(p0, q) + _far(p0, q0))
            into[g] = 0
            seen = np.flatnonzero(into)
            yield _pairs([lang] * len(seen), [names[g]] * len(seen), names[seen].tolist(), into[seen].tolist())


def _baselines(batches):
    """Rows of a group with its histogram (counts, how many terms have them) and a block of peers: for each pair the sum of
    the group's terms as if the peer lacked them, of the group's terms as those of a peer to whom it is compared, and the
    value of a term that both lack, so often as both would if they shared none."""
    for batch in batches:
        for lang, source, size, kept, counts, times, peers, sizes, theirs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one = np.array([size], dtype=np.int64)
            mult = np.array(times, dtype=np.int64)
            base, other = 1 + SCALE // one[0] if size else 1, np.array(sizes, dtype=np.int64)
            share = _share(np.array(counts, dtype=np.int64), np.full(len(counts), max(size, 1), dtype=np.int64))
            mine, back = [], []
            for q0 in (1 + SCALE // other).tolist() if size else [1] * len(peers):
                mine.append(int((_far(share, np.int64(q0)) * mult).sum()))
                back.append(int((_far(np.int64(q0), share) * mult).sum()))
            held = int(mult.sum())
            both = [(kept - held - n) * int((base - q0) ** 2 // q0) if size else 0 for n, q0 in zip(theirs, (1 + SCALE // np.maximum(other, 1)).tolist(), strict=True)]
            apart = [k for k, name in enumerate(peers) if name != source]
            yield _pairs([lang] * len(apart), [source] * len(apart), [peers[k] for k in apart], [mine[k] + both[k] for k in apart])
            yield _pairs([lang] * len(apart), [peers[k] for k in apart], [source] * len(apart), [back[k] for k in apart])


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): in part `pair` the divergence from each other source of the language, in part
    `term` the TOP_TERMS kept terms that the source has more often than its language, by what each adds."""
    spark = docs.sparkSession
    short_batches(spark)
    parts = shuffle_partitions(spark)
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = named.mapInArrow(_counts, _COUNTS).repartition(parts, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    kept = saved(
        counted.select("lang", "term", "source", "n", F.sum("df").over(term).alias("df"), F.sum("n").over(term).alias("total"), F.row_number().over(term.orderBy("source")).alias("k")).where(F.col("df") >= MIN_DOCS).drop("df"),
        "divergence-terms",
    )
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("n").alias("held"))
    of_lang = kept.where("k = 1").groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count("k").alias("kept"))
    groups = saved(
        named.select("lang", "source").distinct().join(size.hint("merge"), ["lang", "source"], "left").join(of_lang.hint("merge"), "lang", "left").select("lang", "source", (F.coalesce("size", F.lit(0)) + F.coalesce("kept", F.lit(0))).alias("size"), F.coalesce("held", F.lit(0)).alias("held"), F.coalesce(F.col("lang_size") + F.col("kept"), F.lit(0)).alias("lang_size"), F.coalesce("kept", F.lit(0)).alias("kept")),
        "divergence-groups",
    )
    key = F.struct("lang", "source").alias("group")
    sides = groups.where("held > 0").select(key, "size", "lang_size", F.col("held").alias("n"))
    rows = joined_by_key(kept.select(key, "term", F.col("n").alias("count"), "total"), sides, "group", kept.count())
    postings = rows.select("group.lang", "group.source", "term", F.col("count").alias("n"), "total", "size", "lang_size")

    index = postings.select("lang", "term", "source", "n", "size").repartition(parts, "lang", "term").sortWithinPartitions("lang", "term")
    shared = index.mapInArrow(_scatter, "lang string, source string, item string, value long")
    histogram = kept.groupBy("lang", "source", "n").agg(F.count("term").alias("times")).groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("n", "times"))).alias("h"))
    packed = groups.join(histogram.hint("merge"), ["lang", "source"], "left").select("lang", "source", "size", "kept", F.coalesce("h.n", F.array().cast("array<bigint>")).alias("counts"), F.coalesce("h.times", F.array().cast("array<bigint>")).alias("times"))
    block = F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / PEERS)
    peers = groups.select("lang", block.alias("block"), F.struct("source", "size", "held").alias("peer")).groupBy("lang", "block").agg(F.collect_list("peer").alias("peers"))
    met = packed.join(peers.hint("merge"), "lang").select("lang", "source", "size", "kept", "counts", "times", F.col("peers.source").alias("peers"), F.col("peers.size").alias("sizes"), F.col("peers.held").alias("theirs"))
    lone = met.repartition(parts, "lang", "source", F.col("peers")[0]).mapInArrow(_baselines, "lang string, source string, item string, value long")
    pairs = shared.unionByName(lone).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def share(n, size):
        return F.expr(f"CAST((CAST({SCALE} AS DECIMAL(20,0)) * ({n} + 1)) DIV {size} AS BIGINT) + 1")

    p = postings.select("lang", "source", F.col("term").alias("item"), share("n", "size").alias("p"), share("total", "lang_size").alias("q")).where("p > q")
    found = p.select("lang", "source", "item", F.expr("((p - q) * (p - q)) DIV q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).select(*columns).unionByName(best.withColumn("part", F.lit("term")).select(*columns))
