"""Near copies by word shingles: sets of five-word shingles with Jaccard similarity of 0.8 and more, in components.

Texts meet by SimHash fingerprints of their shingles: those that differ in at most simhash.MAX_DISTANCE bits always meet, by
simhash's blocks. That reaches the nearest copies only (a pair at 0.8 differs in about 10 bits), so texts meet by MinHash
signatures in BANDS bands of ROWS minima as well; a pair at similarity s shares no band with probability (1 - s^ROWS)^BANDS,
which is 1.3e-7 at 0.8 and less above. Texts that meet either way, directly or through others, are a group.
A group's sets go to tasks once, in parts of PART_BYTES, two parts at a time if there are more, and all pairs of a group that
are similar are found there exactly, by their rarest elements (similar_pairs); only links leave a task, fewer than there are
sets. No pair is a row and none is left out. A group of n sets in p parts is sent p times; within a task, sets that share no
rare element are never compared.

Words are split at ASCII white space, A-Z in lower case. Shorter texts have one shingle of all their words; texts without
a word are copies of each other. 64-bit hashes stand for shingles and for sets. Null ids and repeated ids are as in simhash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, saved, short_batches, shuffle_partitions
from .simhash import components, links, majority, named_components

SHINGLE_WORDS, SIMILARITY_FIFTHS, BANDS, ROWS, SEED = 5, 4, 40, 5, 42
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 256
#: Bytes of hashes in a part of a group; a task holds two parts.
PART_BYTES = 16_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The set of the text's shingles as sorted hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64)
    n = len(hashes) - SHINGLE_WORDS + 1
    if not words:
        return hashes
    width = SHINGLE_WORDS if n > 0 else len(hashes)
    made = np.full(max(n, 1), width, dtype=np.uint64)
    for k in range(width):
        made = _mixed(made * _STEP + hashes[k : k + max(n, 1)])
    return np.unique(made)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band, none for an empty set."""
    if not len(hashes):
        return hashes
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[at : at + _CHUNK, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _STEP + column)
    return keys


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _longs(np.concatenate(parts) if parts else []))


def _prints(batches):
    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _longs([_set_id(s) for s in sets]), _longs([majority(s) for s in sets]), _lists([band_keys(s) for s in sets])], ["doc_id", "copy", "set_id", "fp", "keys"])


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([shingles(t) for t in batch.column(2).to_pylist()])], ["set_id", "of", "hashes"])


def _grouped(batches):
    """The rows of a stream that is sorted by its first three columns, a table for each of their values."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and tuple(key[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _linked(batches):
    """Rows (of, i, j, part, set_id, hashes): enough links (x, y) of sets in parts i and j of a group to connect all that are
    similar, each compared on the exact sets."""
    for table in _grouped(batches):
        ids, part, cross = table["set_id"].to_numpy(), table["part"].to_numpy(), table["i"][0].as_py() != table["j"][0].as_py()
        found = [(ids[x], ids[y]) for x, y in similar_pairs([v.values.to_numpy() for v in table["hashes"]], part if cross else None)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["x", "y"])


def similar_pairs(sets: list[np.ndarray], part: np.ndarray | None = None):
    """Pairs of places of sets (without repeats) with a similarity of 0.8 or more, as many as connect all such sets; with
    part, of different parts only.

    Sets are similar just when |x - y| + |y - x| <= (|x| + |y|) / 9. With T the elements that more than half of the sets have,
    and D(x) what x has besides T or lacks of it, that is |D(x)| + |D(y)| - 2 |D(x) & D(y)|. So with e(x) = |D(x)| - |x| / 9 a
    pair must share t = (e(x) + e(y)) / 2 elements of the differences. In the order of e: those with t <= 0 are like the first
    set without a comparison; every other partner of x, with t >= e(x), has one of x's |D(x)| - ceil(e(x)) + 1 rarest
    differences, about a ninth of x. A large group of sets that are less alike than the bound differs from T in more than
    that, so its sets meet few others. A set is compared with all that it meets at once, on the differences alone."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    n = len(sets)
    if n < 2 or not sizes.sum():
        return
    element = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)
    common = np.flatnonzero(2 * np.bincount(element) > n)
    in_common = np.zeros(int(element.max()) + 1, dtype=bool)
    in_common[common] = True
    place = np.cumsum(in_common) - 1
    lacks = np.ones((n, len(common)), dtype=bool)
    lacks[owner[in_common[element]], place[element[in_common[element]]]] = False
    lacker, lacked = np.nonzero(lacks)
    element, owner = np.concatenate([element[~in_common[element]], common[lacked]]), np.concatenate([owner[~in_common[element]], lacker])
    differ = np.bincount(owner, minlength=n)
    excess = 9 * differ - sizes  # 9 e
    order = np.argsort(excess, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    count = np.bincount(element, minlength=len(in_common))
    by = np.lexsort((element, count[element], owner))
    element, owner = element[by], owner[by]  # each set's differences, the rarest first
    start = np.concatenate([[0], np.cumsum(differ)])
    holders = owner[np.argsort(element, kind="stable")]
    first = np.cumsum(count) - count
    group = np.arange(n)
    mine = np.zeros(len(count), dtype=np.int64)
    apart = lambda x, ys: ys if part is None else ys[part[ys] != part[x]]

    def join(x: int, ys: np.ndarray):
        for y in ys.tolist():
            if group[x] != group[y]:
                group[group == group[y]] = group[x]
                yield x, y

    for x in order.tolist():
        if excess[x] > 0:
            break
        yield from join(x, apart(x, order[(excess[order] <= -excess[x]) & (rank[order] > rank[x]) & (group[order] != group[x])]))
    for x in order.tolist():
        probe = element[start[x] : start[x] + differ[x] - max(1, -(-int(excess[x]) // 9)) + 1]
        probe = probe[count[probe] > 1]
        if not len(probe):
            continue
        near = np.unique(np.concatenate([holders[first[e] : first[e] + count[e]] for e in probe.tolist()]))
        near = apart(x, near[(rank[near] > rank[x]) & (group[near] != group[x])])
        if not len(near):
            continue
        own = element[start[x] : start[x + 1]]
        mine[own] = 1
        places = np.repeat(start[near] - (np.cumsum(differ[near]) - differ[near]), differ[near]) + np.arange(differ[near].sum())
        same = np.add.reduceat(mine[element[places]], np.cumsum(differ[near]) - differ[near])
        mine[own] = 0
        yield from join(x, near[18 * same >= excess[near] + excess[x]])


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """Edges (x, y) that connect all sets (set_id, fp) whose fingerprints differ in at most simhash.MAX_DISTANCE bits: those
    between fingerprints, and from each set to its own if that is another's too or near one. Both are hashes of 64 bits; if one
    of each were equal, a group would only be larger."""
    first = saved(sets.groupBy("fp").agg(F.count("*").alias("n")), "near-fingerprints")
    near = saved(links(first.select("fp")), "near-fingerprint-links")
    linked = near.select(F.col("x").alias("fp")).union(near.select("y")).distinct().withColumn("linked", F.lit(True))
    used = first.hint("merge").join(linked.hint("merge"), "fp", "left").where("n > 1 or linked").select("fp", "n")
    own = joined_by_key(sets, saved(used, "near-fingerprints-used"), "fp", sets.count()).select(F.col("set_id").alias("x"), F.col("fp").alias("y"))
    return near.unionByName(own)


def near_copies(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, component_id), one row for each row of docs; component_id is the component's smallest doc_id."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("copy"))
    prints = saved(rows.mapInArrow(_prints, "doc_id long, copy long, set_id long, fp long, keys array<long>"), "near-prints")
    total = prints.count()
    classes = saved(prints.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.min("copy").alias("copy"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"), F.count("*").alias("n")), "near-classes")
    keyed = saved(classes.select("set_id", F.explode("keys").alias("key")), "near-keys")
    sizes = saved(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("set_id").alias("least")).where("n > 1"), "near-sizes")
    # Sets that share buckets or have near fingerprints, directly or through others, are a group.
    meeting = joined_by_key(keyed, sizes, "key", keyed.count()).where("set_id > least").select(F.col("least").alias("x"), F.col("set_id").alias("y")).distinct()
    meeting = meeting.unionByName(by_fingerprint(classes.where(F.size("keys") > 0).select("set_id", "fp")))
    reached = saved(components(meeting).select(F.col("node").alias("set_id"), F.col("root").alias("of")), "near-groups")
    groups = reached.union(reached.select("of", "of")).distinct()  # a root isn't reached
    one = saved(classes.select("set_id", "copy", "n").hint("merge").join(groups.hint("merge"), "set_id"), "near-ends")
    texts = joined_by_key(docs.select(F.xxhash64(text).alias("copy"), F.col(text).alias("text")), one, "copy", total).groupBy("set_id", "of").agg(F.any_value("text").alias("text"))
    sets = saved(texts.select("set_id", "of", "text").mapInArrow(_sets, "set_id long, of long, hashes array<long>"), "near-sets")
    parts = sets.groupBy("of").agg(F.ceil(F.sum(8 * F.size("hashes")) / PART_BYTES).cast("long").alias("parts"), F.count("*").alias("n")).where("n > 1")
    dealt = joined_by_key(sets, saved(parts, "near-parts"), "of", sets.count()).withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")))
    dealt = dealt.select("of", "part", "set_id", "hashes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    met = dealt.select("of", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "set_id", "hashes")
    met = met.repartition(shuffle_partitions(spark), "of", "i", "j").sortWithinPartitions("of", "i", "j")
    links = saved(met.mapInArrow(_linked, "x long, y long"), "near-links")
    roots = components(links)
    member = classes.select("set_id", "first", "n").hint("merge").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    of_set = named_components(saved(member, "near-members"), "set_id")
    return joined_by_key(prints.select("doc_id", "set_id"), of_set, "set_id", total).select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """docs without the near copies of a smaller id; rows with a null id stay, and of rows that repeat an id all stay."""
    gone = near_copies(docs, doc_id, text).where("doc_id > component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), F.col(doc_id) == F.col("__gone"), "left_anti")
