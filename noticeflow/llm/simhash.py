"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact Hamming check, components.

Fingerprints that differ in at most MAX_DISTANCE bits agree in all but MAX_DISTANCE of BLOCKS blocks, so
they share the key made of the blocks that are left for some choice of them. Distinct fingerprints are
joined on those keys. A key with more than HOT_BUCKET fingerprints is split again: its free bits are
cut into nibbles and keyed by all but MAX_DISTANCE of them, which leaves at most 256 fingerprints a key.
Only links between different fingerprints are made; copies meet in their fingerprint's class.

Null texts count as empty; texts without a word have the fingerprint zero. Null ids never become a
component's id: a component made of null ids only has a null id. Rows that repeat an id are kept.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, saved, short_batches

BLOCKS, MAX_DISTANCE, SHINGLE_WORDS, SEED, HOT_BUCKET = 4, 2, 3, 42, 256


def fingerprint(text: str | None) -> int:
    """Words are split at ASCII white space, A-Z in lower case; a bit is set if it is in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:], strict=False)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def _masks(bits: list[list[int]], left_out: int) -> list[int]:
    """Signed masks of all bits but those of `left_out` of the groups."""
    masks = []
    for out in itertools.combinations(range(len(bits)), left_out):
        masks.append(_signed(sum(1 << b for g, group in enumerate(bits) if g not in out for b in group)))
    return masks


def _linked(keyed: DataFrame, keys: list[str]) -> DataFrame:
    a, b = keyed.alias("a"), keyed.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_DISTANCE)
    return a.hint("merge").join(b, [*same, near]).select(F.col("a.fp").alias("x"), F.col("b.fp").alias("y"))


def links(distinct_fps: DataFrame) -> DataFrame:
    """(x, y), x < y: all pairs of distinct fingerprints within MAX_DISTANCE bits."""
    width = 64 // BLOCKS
    blocks = [list(range(i * width, (i + 1) * width)) for i in range(BLOCKS)]
    masks = _masks(blocks, MAX_DISTANCE)
    keyed = distinct_fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks)])).alias("e")).select("fp", "e.m", "e.k")
    sizes = keyed.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1")
    keyed = saved(keyed.hint("merge").join(sizes, ["m", "k"]), "simhash-keys")
    found = _linked(keyed.where(F.col("n") <= HOT_BUCKET).select("m", "k", "fp"), ["m", "k"])
    if keyed.where(F.col("n") > HOT_BUCKET).limit(1).count():
        nibbles = [list(range(i, i + 4)) for i in range(0, 64, 4)]
        finer = []
        for i, out in enumerate(itertools.combinations(range(BLOCKS), MAX_DISTANCE)):
            free = [n for n in nibbles if n[0] // width in out]
            fixed = [n for n in nibbles if n[0] // width not in out]
            for gone in itertools.combinations(range(len(free)), MAX_DISTANCE):
                kept = [*fixed, *(n for j, n in enumerate(free) if j not in gone)]
                finer.append((i, _signed(sum(1 << b for n in kept for b in n))))
        split = F.filter(F.array(*[F.struct(F.lit(i).alias("of"), F.lit(j).alias("m2"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k2")) for j, (i, m) in enumerate(finer)]), lambda e: e["of"] == F.col("m"))
        hot = keyed.where(F.col("n") > HOT_BUCKET).select("fp", F.explode(split).alias("e")).select("fp", "e.m2", "e.k2")
        found = found.unionByName(_linked(hot, ["m2", "k2"]))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (x, y) reaches, by alternating large-star and
    small-star steps; every step is written out, so a lost executor costs one step. The hubs that the steps make are hot
    keys of their joins (see joined_by_key)."""
    edges = saved(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "cc-edges")

    def state(e):
        return e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "cc-least")
        large = joined_by_key(both.where("v > u"), least, "u", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "cc-large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-least")
        small = joined_by_key(large, least, "u", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs."""
    prints = saved(fingerprints(docs, doc_id, text), "simhash-prints")
    first = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-classes")
    pairs = saved(links(first.select("fp")), "simhash-links")
    # Nodes of the graph are fingerprints; each class then takes the least first document of its component.
    roots = components(pairs)
    member = first.hint("merge").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = named_components(saved(member, "simhash-members"), "fp")
    found = joined_by_key(prints, classes, "fp", prints.count())
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def named_components(member: DataFrame, key: str) -> DataFrame:
    """(key, component_id, n) of members (key, root, first, n): the least first document of all with the same root."""
    named = saved(member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "simhash-named")
    return saved(joined_by_key(member.select(key, "root", F.col("n").alias("copies")), named, "root", member.count()).select(key, "component_id", F.col("copies").alias("n")), "simhash-components")


def keep_one(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """docs without the near-duplicates of a smaller id; rows with a null id stay, and of rows that repeat an id all stay."""
    found = near_duplicates(docs, doc_id, text)
    gone = found.where("doc_id > component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), F.col(doc_id) == F.col("__gone"), "left_anti")
