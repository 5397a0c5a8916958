"""Token-ID output: whole texts to ids to compressed blocks in ascending id order, and back.

A file of the store is a partition of documents in ascending doc_id; its rows are blocks, each decodable
alone: how many ids of the same partition come before it, the doc_ids and lengths of its documents, the
coded ids (see range_coder) and checksums. Blocks hold whole documents, BLOCK_IDS ids or one document at
least. Null texts count as empty (the end id alone). Rows that repeat an id stay, in the order of their
texts; rows with a null id come first.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import range_coder
from .common import short_batches, shared_path, shuffle_partitions

BLOCK_IDS, CACHE_WORDS, NULL_ID = 1 << 19, 1_000_000, -(1 << 63)
#: Bytes of texts whose words are told apart together, if they are more than one batch.
GROUP_BYTES = 8_000_000
#: Punctuation that is looked for after words of other letters.
MARKS = frozenset(b"%c" % c for c in b".,;:!?")
_SCHEMA = "part int, ids_before long, n_ids long, docs binary, coded binary, crc long"


class WordEncoder:
    """The tokenizers library's ids, word by word: the tokenizer lower-cases and never joins text across white space, so
    words that came before need not be encoded again. A word of Latin-1 letters with ASCII punctuation after them is its letters
    and its punctuation, which the tokenizer encodes apart. New ones go to the library, many in one call; words of letters go in
    lower case to a copy of the tokenizer without its normalizer and pattern, which do no more to them, and are told apart by
    the tokens that end a word. The memory is bounded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.vocab, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        if not self.ends.any():
            raise ValueError("the tokenizer doesn't mark the ends of words")
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._forget()

    def _forget(self) -> None:
        """known has each word's number; flat has all ids, from place on and size of them a word. The arrays have room for more."""
        self.known: dict[bytes, int] = {b"": 0}  # white space at an end is split from nothing
        self.flat, self.place, self.size, self.used = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int32), 0

    def _add(self, words, ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n, used = len(self.known), len(sizes), self.used
        self.known |= zip(words, range(first, first + n), strict=True)
        self.flat, self.place, self.size = _with_room(self.flat, used + len(ids)), _with_room(self.place, first + n), _with_room(self.size, first + n)
        self.flat[used : used + len(ids)], self.size[first : first + n] = ids, sizes
        self.place[first : first + n] = used + np.cumsum(sizes, dtype=np.int32) - sizes
        self.used += len(ids)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, itertools.repeat(-1)), dtype=np.int32, count=len(words))

    def ids(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        return self.batch_ids(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.binary()).view(pa.string()))[0]

    def batch_ids(self, texts: pa.StringArray) -> list[bytes]:
        """Each text's little-endian 32-bit ids, nulls as empty texts. Arrow splits the texts and numbers the different words of
        all of them, so Python sees each word once a batch, and the library gets the new ones in a few calls."""
        texts = pc.fill_null(texts, "")
        lower = pc.ascii_lower(texts)
        if b"<|" in lower.buffers()[2].to_pybytes():  # special tokens are in lower case already
            lower = pc.if_else(pc.match_substring(texts, "<|"), texts, lower)
        lists = pc.ascii_split_whitespace(lower)
        numbered = lists.flatten().dictionary_encode()
        if not len(numbered):
            return [b""] * len(texts)
        pieces = _pieces(numbered.dictionary).dictionary_encode()
        words = pieces.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = self._numbers(words)
        if len(new := np.flatnonzero(found < 0)):
            if len(self.known) + len(new) > CACHE_WORDS:
                self._forget()
                found = self._numbers(words)
                new = np.flatnonzero(found < 0)
            self._learn(asked := [words[i] for i in new.tolist()])
            found[new] = self._numbers(asked)
        at = found[pieces.indices.to_numpy()]
        flat, size = _laid(self.flat, self.place[at], self.size[at]), self.size[at].reshape(-1, 2).sum(axis=1, dtype=np.int32)
        at = numbered.indices.to_numpy()
        count = size[at]
        data = _laid(flat, (np.cumsum(size, dtype=np.int32) - size)[at], count).tobytes()
        ends, offsets = np.concatenate([[0], np.cumsum(count, dtype=np.int64)]), lists.offsets.to_numpy()
        cuts = (4 * ends[offsets - offsets[0]]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, new: list[bytes]) -> None:
        """New different words. Arrow finds those of Latin-1 letters, which are in lower case already, at once; _letters judges
        the others."""
        latin = pc.match_substring_regex(pa.array(new, pa.binary()).view(pa.string()), _LATIN).to_numpy(zero_copy_only=False)
        #: words of letters as the library is to see them
        spelled: dict[bytes, bytes] = {w: w for w in itertools.compress(new, latin)}
        marked: dict[bytes, tuple[bytes, bytes]] = {}
        others: set[bytes] = set()
        for w in itertools.compress(new, ~latin):
            if (low := _letters(w)) is not None:
                spelled[w] = low
            elif w[-1:] in MARKS and (low := _letters(w[:-1])) is not None:
                marked[w] = base, mark = w[:-1], w[-1:]
                if base not in self.known:
                    spelled[base] = low
                if mark not in self.known:
                    others.add(mark)
            else:
                others.add(w)
        if others:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in others], add_special_tokens=False)]
            self._add(others, np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int32))
        if spelled:
            letters = list(spelled.values())
            lines = [_SHOWN[np.frombuffer(b" ".join(letters[k : k + _LINE]), dtype=np.uint8)].tobytes().decode("utf-32-le") for k in range(0, len(letters), _LINE)]
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)])
            self._add(spelled, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1).astype(np.int32))
        if marked:
            at = self._numbers(list(itertools.chain.from_iterable(marked.values())))
            self._add(marked, _laid(self.flat, self.place[at], self.size[at]), self.size[at].reshape(-1, 2).sum(axis=1, dtype=np.int32))


def _with_room(array: np.ndarray, n: int) -> np.ndarray:
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), dtype=array.dtype)])


def _laid(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of flat, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int32)
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


def _pieces(words: pa.StringArray) -> pa.StringArray:
    """Two pieces of each word: Latin-1 letters, in lower case, and the ASCII punctuation after them, each of which may be
    missing; any other word as it is and nothing."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32, count=n + 1, offset=4 * words.offset)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8, count=offsets[-1])
    kind = _KIND[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    kind[second[(data[second] == 0x97) | (data[second] == 0xB7)]] = _ODD
    bad = kind == _ODD
    again = (kind[1:] == _LETTER) & (kind[:-1] == _TAIL)  # letters after punctuation
    again[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False
    bad[1:] |= again
    upto = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(bad, out=upto[1:])
    simple = upto[offsets[1:]] == upto[offsets[:-1]]
    np.cumsum(kind == _LETTER, out=upto[1:])
    cuts = np.empty(2 * n + 1, dtype=np.int32)
    cuts[0::2] = offsets
    cuts[1::2] = np.where(simple, offsets[:-1] + upto[offsets[1:]] - upto[offsets[:-1]], offsets[1:])
    lower = data.copy()
    own = data[offsets[0] :]
    lower[offsets[0] :] += _UPPER[own] * np.repeat(simple, np.diff(offsets))
    return pa.StringArray.from_buffers(2 * n, pa.py_buffer(cuts), pa.py_buffer(lower))


#: What a byte is in a word: a letter's byte (ASCII, or 0xC3 and the byte after it, which is Latin-1's upper quarter), ASCII
#: punctuation, or else; and what makes the letter a small one.
_ODD, _LETTER, _TAIL = 0, 1, 2
_KIND, _UPPER = np.zeros(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
_KIND[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = _TAIL
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_UPPER[[*range(65, 91), *range(0x80, 0x9F)]] = 32
#: The letter that byte-level tokenizers write for a byte: itself where Latin-1 has a visible sign, else one from 256 on in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[_HIDDEN] = np.arange(256, 256 + len(_HIDDEN))
_SHOWN[32] = 32
#: Words of small letters of ASCII and Latin-1, which are composed.
_LATIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
#: Words of letters that the library gets in one line.
_LINE = 1024


def _letters(word: bytes) -> bytes | None:
    """The word in lower case if the tokenizer's normalizer does no more to it than that: letters of the oldest Unicode
    blocks, composed, without those whose lower case depends on their place or has several characters. None otherwise."""
    if word.isalpha():  # ASCII
        return word.lower()
    s = word.decode("utf-8", "replace")
    if not s.isalpha() or max(s) >= "\u0500" or "Σ" in s or not unicodedata.is_normalized("NFC", s):
        return None
    low = s.lower()
    return low.encode() if len(low) == len(s) else None


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, which outlives its tasks."""
    return WordEncoder(path)


def _block(part: int, before: int, doc_ids: list, pieces: list[bytes], vocab: int) -> pa.RecordBatch:
    lengths = np.array([len(p) // 4 for p in pieces], dtype="<i8")
    docs = struct.pack("<q", len(pieces)) + np.array([NULL_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes() + lengths.tobytes()
    coded = range_coder.encode(np.frombuffer(b"".join(pieces), dtype="<u4"), vocab)
    row = {"part": part, "ids_before": before, "n_ids": int(lengths.sum()), "docs": docs, "coded": coded, "crc": zlib.crc32(docs)}
    return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.binary()), ("coded", pa.binary()), ("crc", pa.int64())]))


def _gathered(batches):
    """Batches put together up to GROUP_BYTES, so that fewer words are seen again."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > GROUP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def _encoder(path: str, end_id: int):
    end = struct.pack("<I", end_id)

    def encode(batches):
        words = word_encoder(path)
        part, before, held, doc_ids, pieces = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in _gathered(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.batch_ids(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                pieces.append(ids + end)
                held += len(pieces[-1]) // 4
                if held >= BLOCK_IDS:
                    yield _block(part, before, doc_ids, pieces, words.vocab)
                    before, held, doc_ids, pieces = before + held, 0, [], []
        if pieces:
            yield _block(part, before, doc_ids, pieces, words.vocab)

    return encode


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, doc_id="doc_id", text="text") -> None:
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_encoder(tokenizer_path, end_id), _SCHEMA).write.option("compression", "none").parquet(path)


def read_blocks(docs: bytes, coded: bytes, crc: int) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a block's documents; a ValueError if the block was damaged."""
    if zlib.crc32(docs) != crc:
        raise ValueError("damaged block")
    (n,) = struct.unpack_from("<q", docs)
    doc_ids, lengths = np.frombuffer(docs, dtype="<i8", count=2 * n, offset=8).reshape(2, n)
    ids = range_coder.decode(coded).astype("<u4")
    if len(ids) != lengths.sum():
        raise ValueError("damaged block")
    ends = np.cumsum(lengths)
    return [(None if d == NULL_ID else int(d), ids[e - k : e]) for d, k, e in zip(doc_ids.tolist(), lengths.tolist(), ends.tolist(), strict=True)]


def _digests(batches):
    for batch in batches:
        for row in batch.to_pylist():
            start = row["start"]
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for doc_id, ids in read_blocks(row["docs"], row["coded"], row["crc"]):
                for column, value in zip(out.values(), (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                    column.append(value)
                start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))


def _all_ids(batches):
    for batch in batches:
        for row in batch.to_pylist():
            found = read_blocks(row["docs"], row["coded"], row["crc"])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i.tolist() for _, i in found], pa.list_(pa.int64()))], ["doc_id", "ids"])


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, ids) of a store."""
    short_batches(spark)
    return spark.read.parquet(path).select("docs", "coded", "crc").mapInArrow(_all_ids, "doc_id long, ids array<long>")


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store: a document's place among all ids and its checksum.

    The sums over partitions are a row for each partition, however many documents there are."""
    from pyspark.sql import Window

    short_batches(spark)
    stored = spark.read.parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("part_start"))
    blocks = stored.join(starts.hint("broadcast"), "part").select((F.col("part_start") + F.col("ids_before")).alias("start"), "docs", "coded", "crc")
    return blocks.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    path = shared_path(docs.sparkSession, "token-store")
    write_store(docs, tokenizer_path, path, end_id)
    return read_digests(docs.sparkSession, path)
