"""Byte-level BPE by batched merge rounds in arrays.

A text is cut at special tokens and then into words by the tokenizer's pattern; a word's ids don't depend on its
neighbours, so each distinct word is encoded once for each worker (bounded memory). The bytes of many new words lie in one
flat array of symbols. A round looks the pairs of neighbours up by binary search over the sorted pair keys, finds the lowest
rank of each word, and merges all its places in that word at once; words without a mergeable pair leave the array. That
gives what merging pair by pair gives, the lowest rank first and the leftmost of equals, as long as a merge comes after
those that made its two symbols, which is checked when the tokenizer is loaded.

The rounds of a long word would each cost its whole length. Long words go by rank instead: the places of each pair are kept
by rank, the next rank's places are merged together, and only their neighbours are looked up again, so each place is looked
at as often as a merge touches it.

Null texts count as empty; rows are independent, repeated ids are repeated in the result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import short_batches

#: The tokenizer's pattern; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS, LONG_WORD, LOOKUP = 500_000, 64, 1 << 20
_NEVER = np.iinfo(np.int64).max


@functools.lru_cache(maxsize=1)
def _newer_letters() -> re.Pattern | None:
    """Letters and numbers of the regex module that the standard library doesn't know yet; the tokenizer may not know them
    either, so texts with one are cut by the tokenizer itself."""
    word = regex.compile(r"[\p{L}\p{N}]")
    new = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and word.match(chr(c))]
    runs: list[list[int]] = []
    for c in new:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]") if runs else None


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100, where all letters are long known; a quick test."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeRounds:
    """Encoder and decoder of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
            raise ValueError("not a plain byte-level BPE tokenizer")
        vocab: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.a, self.b, self.made = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        rank_of = np.full(max(vocab.values()) + 1, -1, dtype=np.int64)
        ranks = np.arange(len(merges))
        rank_of[self.made] = ranks
        if (rank_of[self.made] != ranks).any() or (np.maximum(rank_of[self.a], rank_of[self.b]) >= ranks).any():
            raise ValueError("a merge comes before those that make its parts")
        key = (self.a << 32) | self.b
        self.rank = np.argsort(key, kind="stable")
        self.keys = key[self.rank]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that look at their surroundings")
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.pattern = regex.compile(PATTERN)
        #: Ids of words by the words, as little-endian unsigned 32-bit integers.
        self.known: dict[str, bytes] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NEVER where the two don't merge."""
        out = np.empty(len(a), dtype=np.int64)
        for k in range(0, len(a), LOOKUP):
            key = (a[k : k + LOOKUP].astype(np.int64) << 32) | b[k : k + LOOKUP]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[k : k + LOOKUP] = np.where(self.keys[at] == key, self.rank[at], _NEVER)
        return out

    def rounds(self, words: list[bytes]) -> list[bytes]:
        """The ids of non-empty words, by rounds over all of them."""
        n = len(words)
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        of = np.repeat(np.arange(n), [len(w) for w in words])
        done_sym, done_of = [], []
        while len(sym):
            inner = of[1:] == of[:-1]
            rank = np.full(len(sym), _NEVER)
            at = np.flatnonzero(inner)
            rank[at] = self._ranks(sym[at], sym[at + 1])
            starts = np.flatnonzero(np.concatenate([[True], ~inner]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.repeat(best, sizes)
            ended = best == _NEVER
            done_sym.append(sym[ended])
            done_of.append(of[ended])
            live = ~ended
            sym, of, rank, best = sym[live], of[live], rank[live], best[live]
            if not len(sym):
                break
            left = self._apart(np.flatnonzero(rank == best), lambda p: p + 1)
            sym[left] = self.made[best[left]]
            stay = np.ones(len(sym), dtype=bool)
            stay[left + 1] = False
            sym, of = sym[stay], of[stay]
        return self._by_word(np.concatenate(done_sym), np.concatenate(done_of), n)

    @staticmethod
    def _apart(places: np.ndarray, after) -> np.ndarray:
        """Of places that overlap (a pair of equal symbols in a run) every second one, from the left."""
        if len(places) < 2:
            return places
        fresh = np.concatenate([[True], after(places[:-1]) != places[1:]])
        index = np.arange(len(places))
        return places[(index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0]

    @staticmethod
    def _by_word(sym: np.ndarray, of: np.ndarray, n: int) -> list[bytes]:
        ids = sym[np.argsort(of, kind="stable")].astype("<u4").tobytes()
        cuts = (4 * np.cumsum(np.bincount(of, minlength=n))).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def by_rank(self, words: list[bytes]) -> list[bytes]:
        """The same for long words: rank by rank, each with the places it has by then."""
        n = len(words)
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)].astype(np.int32)
        ends = np.cumsum([len(w) for w in words])
        of = np.repeat(np.arange(n), [len(w) for w in words])
        after = np.arange(1, len(sym) + 1, dtype=np.int64)
        after[ends - 1] = -1
        before = np.arange(-1, len(sym) - 1, dtype=np.int64)
        before[np.concatenate([[0], ends[:-1]])] = -1
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(places):
            rank = self._ranks(sym[places], sym[after[places]])
            fit = rank != _NEVER
            places, rank = places[fit], rank[fit]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[cuts].tolist(), np.split(places, cuts[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        look(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[(sym[places] == self.a[r]) & (after[places] >= 0)]
            places = places[sym[after[places]] == self.b[r]]
            places = self._apart(places, lambda p: after[p])
            gone = after[places]
            right = after[gone]
            sym[places], sym[gone] = self.made[r], -1
            after[places] = right
            has = right >= 0
            before[right[has]] = places[has]
            left = before[places]
            look(np.unique(np.concatenate([left[left >= 0], places[has]])))
        stay = sym >= 0
        return self._by_word(sym[stay].astype(np.int64), of[stay], n)

    def _words(self, text: str) -> list[str]:
        newer = _newer_letters()
        if newer is not None and not _latin(text) and newer.search(text):
            return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def _split(self, text: str | None) -> list[str]:
        """Words and special tokens in order; a special token is no word, as the words' memory holds its id."""
        if not text:
            return []
        if self.cut is None or not any(t in text for t in self.special):
            return self._words(text)
        parts = self.cut.split(text)
        return [w for k, p in enumerate(parts) for w in ([(p,)] if k % 2 else self._words(p) if p else [])]

    def _learn(self, new: set) -> dict:
        found = {w: self.special[w[0]].to_bytes(4, "little") for w in new if isinstance(w, tuple)}
        texts = [w for w in new if isinstance(w, str)]
        data = [w.encode("utf-8", "surrogatepass") for w in texts]
        for encode, fit in ((self.rounds, lambda b: len(b) <= LONG_WORD), (self.by_rank, lambda b: len(b) > LONG_WORD)):
            some = [k for k, b in enumerate(data) if fit(b)]
            if some:
                found |= zip((texts[k] for k in some), encode([data[k] for k in some]), strict=True)
        if len(self.known) + len(found) > CACHE_WORDS:
            self.known = {}
        self.known |= ((w, ids) for w, ids in found.items() if len(w) <= LONG_WORD)
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._split(t) for t in texts]
        known = self.known
        if new := set().union(*split).difference(known):
            found = self._learn(new)
            if self.known is not known or not new <= self.known.keys():
                known = known | found
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], dtype="<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def coder(path: str) -> MergeRounds:
    """One for each Python worker, which outlives its tasks."""
    return MergeRounds(path)


def _coder(path: str, keep_texts: bool):
    kinds = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if keep_texts else [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def rows(batches):
        bpe = coder(path)
        for batch in batches:
            columns = [[] for _ in kinds]
            for packed in bpe.encode_all(batch.column(1).to_pylist()):
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                text = bpe.decode(ids)
                made = (ids, text) if keep_texts else (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                for column, value in zip(columns, made, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True))], ["doc_id", *(k for k, _ in kinds)])

    return rows


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encoded(docs: DataFrame, path: str, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, ids, decoded), one row for each row of docs."""
    return _rows(docs, doc_id, text).mapInArrow(_coder(path, True), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row of docs; ids and texts stay in the task."""
    return _rows(docs, doc_id, text).mapInArrow(_coder(path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
