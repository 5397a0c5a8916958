"""The pipeline, stage by stage and as a whole, against brute force on a small corpus; and its odd rows."""

import hashlib
import random
import re
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]
pytest.importorskip("noticeflow.llm")

import corpus_pipeline  # noqa: E402
from noticeflow.llm.queries import PIECE_MODEL, vocabulary  # noqa: E402
from test_near_copies import near, shingle_set  # noqa: E402
from test_operators import brute_kept, brute_lines, brute_quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, component_id string"
SHARED = "This license line is in many documents of the corpus."


def corpus():
    rng = random.Random(21)
    vocabulary_ = ["".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary_) for _ in range(n))
    changed = lambda t: " ".join(w if k != 40 else "other" for k, w in enumerate(t.split()))
    rows = [(i, text(rng.randint(80, 99)) + ("\n" + SHARED if i % 3 == 0 else ""), "en") for i in range(60)]
    item = text(20)
    rows += [(100, text(30) + " " + item + " " + text(30), "en"), (101, changed(rows[5][1]), "en"), (102, rows[7][1] + " more", "en"), (107, rows[8][1], "en"), (103, " ".join("".join(rng.choice("qxzwk#%") for _ in range(9)) for _ in range(40)), "en")]
    rows += [(104, None, "en"), (105, "", None), (106, "too short", "en")]
    return rows, item


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, item = corpus()
    base = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "c") for i, t, lang in rows], SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "short one")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return rows, item, str(base)


def expected_stages(rows, item):
    """The (doc_id, text) that each stage leaves."""
    kept = brute_kept(rows, brute_quality(rows))
    one = [(i, t) for i, t, _ in rows if kept[i]]
    two = [(i, t) for i, t, _, _ in brute_lines(one)]
    sets, least = {i: shingle_set(t) for i, t in two}, {}
    for i, _ in sorted(two):
        least[i] = next((least[j] for j in least if near(sets[i], sets[j])), i)
    three = [(i, t) for i, t in two if least[i] == i]
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for k in range(len(w) - 4)}
    four = [(i, t) for i, t in three if len(shingles(item) & shingles(t)) < 0.8 * len(shingles(item))]
    return one, two, three, four


def test_stages(spark, made):
    rows, item, base = made
    docs = spark.read.parquet(f"{base}/documents.parquet")
    stages = expected_stages(rows, item)
    for (name, stage), expected in zip(corpus_pipeline.STAGES, stages, strict=False):
        out = stage(spark, docs, base)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert sorted((r.doc_id, r.text) for r in found) == sorted(expected), name
        assert all(r.source == "s" and r.key == 1 and r.component_id == "c" and r.n_chars == len(r.text) for r in found), name
        docs = spark.createDataFrame(found, SCHEMA)
    one, two, three, four = ({i for i, _ in s} for s in stages)
    assert 103 not in one and len(one) > 55 and 107 in two and 101 not in three and 102 not in three and 100 in three - four
    assert sum(SHARED in t for _, t in stages[1]) == 1


def test_run(spark, made):
    import sentencepiece

    rows, item, base = made
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = []
    for i, t in expected_stages(rows, item)[-1]:
        ids = model.encode(t)
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert sorted(map(tuple, corpus_pipeline.run(spark, base).collect())) == sorted(expected)


def test_odd_rows(spark, made):
    """Null ids, repeated ids, null languages and empty tables: no stage fails, and rows with a null id aren't lost to others."""
    rows, item, base = made
    text = rows[3][1]
    odd = [(None, text, None, None, None, None, None), (None, None, None, None, None, None, None), (1, text, "en", "s", 1, 1, "c"), (1, text, "en", "s", 1, 1, "c"), (2, rows[4][1], None, "s", 1, 1, "c")]
    docs, none = spark.createDataFrame(odd, SCHEMA), spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, base)
        assert out.columns == docs.columns and sum(r.doc_id is None for r in out.collect()) == 2, name
        assert sum(r.doc_id == 1 for r in out.collect()) in (0, 2), name
        assert stage(spark, none, base).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, base).count() == 5 and corpus_pipeline.STAGES[-1][1](spark, none, base).count() == 0
