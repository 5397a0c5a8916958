"""Byte-level BPE, lexical search and source divergence against the library and brute force, with nulls, empty and long
texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("noticeflow.llm")

from tokenizers import Tokenizer  # noqa: E402

from noticeflow.llm import byte_bpe, divergence, lexical_search  # noqa: E402
from noticeflow.llm.queries import BYTE_TOKENIZER, vocabulary  # noqa: E402

#: Names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, rank int, value long, size long, score long"
EXTRA = (1, "x", 2, 3, 4, 5)


def corpus():
    rng = random.Random(11)
    some = "alpha Beta gamma delta épsilon Zeta eta naïve Straße 数 x1 r2d2 the the the of a".split()

    def text(n):
        return "".join(rng.choice(some) + rng.choice([" ", "  ", ", ", "\n", "'s ", "-", "\x85"]) for _ in range(n))

    texts = [None, "", " ", "\n\n\t", "!!", "one", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "İSTANBUL ſ K"]
    texts += [text(rng.randint(1, 60)) for _ in range(60)]
    texts += [texts[20], texts[20], text(5000)]
    rows = [(i, t, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "s3", "s3", None]), *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[25], rows[25], (None, texts[30], "en", "s1", *EXTRA), (500, None, "xx", "s9", *EXTRA), (501, "only one", "yy", "s8", *EXTRA), (502, "rare", "yy", "s7", *EXTRA)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary(BYTE_TOKENIZER))


def test_byte_bpe_rows(spark, docs, none, library):
    path = vocabulary(BYTE_TOKENIZER)
    expected, whole = [], []
    for r in corpus():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((r[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        whole.append((r[0], ids, text))
    assert collected(byte_bpe.digests(docs, path)) == sorted(expected, key=repr)
    assert collected(byte_bpe.encoded(docs, path)) == sorted(whole, key=repr)
    assert byte_bpe.digests(none, path).count() == 0


def test_byte_bpe_equals_the_library(library):
    own = byte_bpe.MergeRounds(vocabulary(BYTE_TOKENIZER))
    rng = random.Random(3)
    odd = [" ", "  ", "\n", "a", "the", "'s", "'LL", "é", "1", "!", "<|endoftext|>", "\x1c", "\x85", "你好", "😀", "՘", "꟎", "\x00", "aaaa", "²", "Ⅷ", "​", "　"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(chr(c) for _ in range(10) if not 0xD800 <= (c := rng.randint(0, 0x10FFFF)) <= 0xDFFF) for _ in range(2000)]
    texts += ["a" * k for k in range(200)] + [" " * k + "x" for k in range(100)] + ["".join(rng.choice("abcde") for _ in range(rng.randint(50, 400))) for _ in range(200)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.encode(t) for t in texts] == expected
    assert [own.decode(i) for i in expected] == [library.decode(i, skip_special_tokens=False) for i in expected]
    words = [t.encode() for t in texts if t and "<|" not in t and len(own._words(t)) == 1]
    assert own.rounds(words) == own.by_rank(words) and len(words) > 300


def test_byte_bpe_remembers_a_bounded_number_of_words(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 20)
    own = byte_bpe.MergeRounds(vocabulary(BYTE_TOKENIZER))
    for t in (" ".join(f"w{k}q{j}" for j in range(15)) for k in range(10)):
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert len(own.known) <= 60


def test_byte_bpe_ten_megabytes_without_a_space(library):
    """By rank, a run of one letter and a long random word don't take a round for each merge of the whole word."""
    own = byte_bpe.MergeRounds(vocabulary(BYTE_TOKENIZER))
    text = "a" * 10_000_000
    assert own.decode(own.encode(text)) == text
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def brute_divergence(rows):
    docs = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= 3}
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        count[None] = Counter(t for d in mine for t in d[2] if t in kept)
        p = {s: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        for s in count:
            if s is None:
                continue
            far = {i: sum((p[s][t] - p[i][t]) ** 2 // p[i][t] for t in kept) for i in count if i not in (s, None)}
            best = {t: (p[s][t] - p[None][t]) ** 2 // p[None][t] for t in kept if count[s][t] and p[s][t] > p[None][t]}
            for part, values, most in (("pair", far, None), ("term", best, 200)):
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("peers", [4096, 1])
def test_divergence(spark, docs, none, monkeypatch, peers):
    monkeypatch.setattr(divergence, "PEERS", peers)
    assert collected(divergence.divergence(docs)) == brute_divergence(corpus())
    assert divergence.divergence(none).count() == 0


def test_divergence_scatter_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.choice("ab"), f"t{rng.randint(0, 40)}", f"s{rng.randint(0, 6)}") for _ in range(400))
    rows = sorted(set(rows))
    table = pa.table({"lang": [r[0] for r in rows], "term": [r[1] for r in rows], "source": [r[2] for r in rows], "n": [1 + len(r[1]) for r in rows], "size": [100 + ord(r[2][1]) for r in rows]})

    def added(batches):
        total = Counter()
        for b in divergence._scatter(batches):
            for x in b.to_pylist():
                total[x["lang"], x["source"], x["item"]] += x["value"]
        return +total, -total

    whole = added(table.to_batches())
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert added(table.to_batches(max_chunksize=3)) == whole and whole[1]


def test_divergence_shares_are_exact():
    rng = random.Random(4)
    count = [rng.randint(0, 10**12) for _ in range(1000)] + [0, 10**12 - 1]
    size = [n + rng.randint(1, 10**12) for n in count[:-1]] + [10**12]
    assert divergence._share(np.array(count), np.array(size)).tolist() == [1 + 10**9 * (n + 1) // s for n, s in zip(count, size, strict=True)]


def brute_search(rows, items, top=50):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    docs = [(r[0], Counter(w), len(w)) for r in rows if r[0] is not None and (w := cut(r[1]))]
    n_docs, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(cut(t))
    out = []
    for i, words in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in words}
        scores = [(-sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // length))) for t in words if c[t]), d) for d, c, n in docs]
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:top])]
    return sorted(out, key=repr)


ITEMS = [(0, "Alpha beta, the épsilon of R2D2!"), (1, "the"), (2, None), (3, "nothing like this"), (4, "gamma gamma zeta"), (4, "delta"), (None, "alpha"), (5, "straße 数 x1 eta naïve"), (5, "straße 数 x1 eta naïve")]


@pytest.mark.parametrize("parts", [1, 3])
def test_search(spark, docs, none, monkeypatch, parts):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    if parts > 1:
        monkeypatch.setattr(lexical_search, "QUERY_CHARS", 150)
    assert collected(lexical_search.search(docs.repartition(parts), items)) == brute_search(corpus(), ITEMS)
    assert lexical_search.search(none, items).count() == 0 and lexical_search.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("step,top,block", [(1, 3, 9), (2, 1, 1000), (32, 50, 20)])
def test_search_lists_stop_without_losing_a_document(monkeypatch, step, top, block):
    """The algorithm itself, over blocks, with ties, small steps and short results."""
    import pyarrow as pa

    for name, value in (("STEP", step), ("TOP", top), ("BLOCK_DOCS", block)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    rows = [(rng.randint(0, 150), " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(30)], k=rng.randint(1, 40)))) for _ in range(300)]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 8)))) for i in range(40)]
    number = {t.encode(): k for k, t in enumerate(words)}
    batch = pa.record_batch({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    blocks = list(lexical_search._blocks(number)([batch]))
    made = pa.Table.from_batches(blocks).to_pylist()
    n_docs, length = sum(b["with_terms"] for b in made), sum(b["length"] for b in made)
    df = np.zeros(30, dtype=np.int64)
    for b in made:
        df[b["terms"]] += b["dfs"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df])
    asked = {i: [number[w.encode()] for w in t.split()] for i, t in items}
    found = pa.Table.from_batches(lexical_search._search(asked, weight, n_docs, length)(blocks)).to_pylist()
    expected = sorted((i, -s, d) for i, _, d, s in brute_search(rows, items, top))
    assert sorted((x["item_id"], -x["score"], x["doc_id"]) for x in found) == expected


def test_latin_words_are_learned_by_arrow(monkeypatch):
    """Words of Latin-1 letters, with a mark or without, need no look by Python, and get the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from noticeflow.llm import token_store

    looked, judge = [], token_store._letters
    monkeypatch.setattr(token_store, "_letters", lambda w: looked.append(w) or judge(w))
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), token_store.WordEncoder(path)
    texts = ["Größe, ÉTÉ! perché? naïve ÿ ß; Word. word word, straße. ÀÉÎÕÜ:", "Größe ÉTÉ: , . 12, a1, foo-bar, x\u00d7y, e\u0301t\u00e9. \u0130stanbul, ΣΑΣ! дом. ªº µ, <|endoftext|> A,, ,a"]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert not {"Größe".encode(), "ÉTÉ".encode(), "perché".encode(), "straße".encode(), b"foo"} & set(looked)


def test_punctuation_after_letters_is_encoded_apart(monkeypatch):
    """The library gets letters and the punctuation after them once each, in whatever words they stand; ids are the library's,
    also when the memory overflows."""
    from noticeflow.llm import token_store
    from noticeflow.llm.queries import WORD_TOKENIZER

    path, rng = vocabulary(WORD_TOKENIZER), random.Random(12)
    library, encoder = Tokenizer.from_file(path), token_store.WordEncoder(path)
    asked = []
    monkeypatch.setattr(encoder, "_learn", lambda new, learn=encoder._learn: asked.extend(new) or learn(new))
    ids = lambda text: np.frombuffer(encoder.ids(text), dtype="<u4").tolist()
    expected = lambda text: library.encode(text, add_special_tokens=False).ids
    for text in ("größe$$$ word*** GRÖSSE*** Größe.... word$$$", "word.... größe*** WORD größe grösse$$$ ***"):
        assert ids(text) == expected(text)
    assert sorted(asked) == sorted(w.encode() for w in ("größe", "$$$", "word", "***", "grösse", "...."))
    parts = [*"aZßÉéÿ×÷ªº́İ日9_'\"<|>.,!$`~\\ \n", "'s", "'LL", "don't", "<|endoftext|>", "<|EndOfText|>", "ÀB", "..."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert [ids(t) for t in texts] == [expected(t) for t in texts]
    monkeypatch.setattr(token_store, "CACHE_WORDS", 50)
    encoder = token_store.WordEncoder(path)
    assert [ids(t) for t in texts[:300]] == [expected(t) for t in texts[:300]] and len(encoder.known) < 200


def test_coded_block_of_another_format_is_refused():
    import struct
    import zlib

    from noticeflow.llm import range_coder

    block = range_coder.encode(np.arange(500), 500)
    other = b"CMR1" + block[4:-4]
    with pytest.raises(ValueError):
        range_coder.decode(other + struct.pack("<I", zlib.crc32(other)))


def test_turns_of_a_batch_are_sized_together(monkeypatch):
    """Chat asks for the ids of a batch's turns once, and gets each turn's own number."""
    import pyarrow as pa

    from noticeflow.llm import chat, token_store
    from noticeflow.llm.queries import WORD_TOKENIZER

    encoder, asked = token_store.WordEncoder(vocabulary(WORD_TOKENIZER)), []
    monkeypatch.setattr(encoder, "batch_ids", lambda texts, ids=encoder.batch_ids: asked.append(len(texts)) or ids(texts))
    turns = [(1, "user", "Größe... </s>"), (1, None, None), (2, "assistant", "a b  c\n" * 40)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("conv_id", "role", "text"), t, strict=True)) for t in turns])
    got = list(chat._sized([batch], encoder))
    assert asked == [3] and [(r["conv_id"], r["role"], r["text"]) for r in got] == [(c, r or "", t or "") for c, r, t in turns]
    assert [r["tokens"] for r in got] == [len(encoder.ids("".join(chat.turn_parts(r or "", t or "")))) // 4 for _, r, t in turns]
