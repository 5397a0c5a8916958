"""Near copies against brute force on exact five-word shingles."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("xxhash")
import numpy as np  # noqa: E402

import corpus_pipeline  # noqa: E402
from noticeflow.llm import near_copies  # noqa: E402


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", "two words", "Two  WORDS", "two words more"]
    for length, copies in ((30, 6), (120, 30), (400, 12)):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(length)]
            for _ in range(copies):
                made = list(base)
                for _ in range(rng.randint(0, max(2, length // 35))):
                    made[rng.randrange(length)] = rng.choice(vocabulary)
                texts.append(" ".join(made))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(order[i], t) for i, t in enumerate(texts)] + [(None, texts[10]), (3, texts[12])]


@pytest.mark.parametrize("part_bytes", [16_000_000, 2_000])
def test_pipeline_stage_removes_near_copies(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(near_copies, "PART_BYTES", part_bytes)
    rows = corpus()
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    gone = {doc for i, (doc, _) in enumerate(rows) if doc is not None and doc > least[find(i)]}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, None)
    assert sorted(map(repr, got.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id not in gone)
    assert len(gone) > 100
    assert corpus_pipeline.simhash_near_dedup(spark, docs.where("false"), None).count() == 0


def connected(n, pairs):
    root = list(range(n))
    for x, y in pairs:
        a, b = root[x], root[y]
        root = [a if r == b else r for r in root]
    return root


def test_similar_pairs_connect_what_brute_force_connects():
    """Sets around the bound of 0.8, in one part and over two."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.choice(5000, 60, replace=False)
        sets = []
        for _ in range(40):
            size = rng.integers(1, 61)
            kept = rng.choice(base, size, replace=False) if rng.random() < 0.3 else rng.choice(base, 60 - rng.integers(0, 9), replace=False)
            sets.append(np.unique(np.concatenate([kept, 6000 + rng.choice(200, rng.integers(0, 6), replace=False)]).astype(np.uint64)))
        near = [(x, y) for x in range(40) for y in range(x) if 5 * len(np.intersect1d(sets[x], sets[y])) >= 4 * len(np.union1d(sets[x], sets[y]))]
        assert connected(40, near_copies.similar_pairs(sets)) and len(list(near_copies.similar_pairs(sets))) < 40
        same = lambda a, b: all((a[x] == a[y]) == (b[x] == b[y]) for x in range(40) for y in range(x))
        assert same(connected(40, near_copies.similar_pairs(sets)), connected(40, near))
        part = rng.integers(0, 2, 40)
        assert same(connected(40, near_copies.similar_pairs(sets, part)), connected(40, [(x, y) for x, y in near if part[x] != part[y]]))
    assert list(near_copies.similar_pairs([])) == [] == list(near_copies.similar_pairs([sets[0]]))


def test_a_large_group_just_below_the_bound_is_not_compared_in_pairs():
    """What is compared grows no faster than the group where no two are similar."""
    import time

    rng = np.random.default_rng(5)
    took = []
    for n in (1000, 4000):
        sets = [np.unique(np.concatenate([np.arange(100), 1000 + rng.choice(10**9, 15, replace=False)]).astype(np.uint64)) for _ in range(n)]
        began = time.time()
        assert list(near_copies.similar_pairs(sets)) == []
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1


def test_sets_meet_by_fingerprints(spark):
    """All within simhash's distance meet without a band, equal fingerprints too, and no others."""
    from noticeflow.llm import simhash

    rng = np.random.default_rng(6)
    prints = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)]
    for p in prints[:60]:
        for _ in range(3):
            prints.append(p ^ sum({1 << int(b) for b in rng.integers(0, 60, rng.integers(0, 4))}))
    rows = [(int(s), p) for s, p in zip(rng.permutation(len(prints)), prints, strict=True)]
    found = near_copies.by_fingerprint(spark.createDataFrame(rows, "set_id long, fp long")).collect()
    nodes = {v: k for k, v in enumerate([*range(len(rows)), *{p for _, p in rows}])}
    got = connected(len(nodes), [(nodes[r.x], nodes[r.y]) for r in found])
    pairs = [(s, t) for s, p in rows for t, q in rows if s < t and (p ^ q).bit_count() <= simhash.MAX_DISTANCE]
    expected = connected(len(rows), pairs)
    assert len(pairs) > 100 and all((got[s] == got[t]) == (expected[s] == expected[t]) for s in range(len(rows)) for t in range(s))
    assert near_copies.by_fingerprint(spark.createDataFrame([], "set_id long, fp long")).count() == 0
    words = [f"w{i}" for i in range(9)]
    hashes = near_copies.shingles(" ".join(words))
    assert simhash.majority(hashes) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
