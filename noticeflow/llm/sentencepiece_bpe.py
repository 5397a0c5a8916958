"""SentencePiece BPE by a merge-type prefix table.

Removing the last token of an encoding leaves the encoding of the shorter prefix, so each prefix of a
text has one last token. An Aho-Corasick automaton over the pieces gives the tokens that end at a place;
the last token is the one that is compatible with the last token of the prefix before it, that is, the
pair's text encodes to just that pair. From the table of last tokens the ids are read off backwards.

A pair is compatible if no merge across its border comes before the merges that made its two tokens. The
test takes their last merges back, the later one first, and asks at each step for the piece that the two
tokens at the border would make (PieceTables.fit).

No piece of the model goes from another character to a word mark (checked when it is loaded), so texts
are cut there and the table is made for each segment. The new segments of some texts are done together,
a place of all of them at a time, in array operations; segments that came before are remembered (bounded).
Segments that are long, or hold a run of marks or a seldom character, are done one by one.
Characters that no piece has become byte tokens. Null texts count as empty.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

MARK = "▁"
CACHE_SEGMENTS, CACHE_PAIRS, TOGETHER_CHARS, LONG_SEGMENT, CLASSES, HASH_BITS = 500_000, 500_000, 1 << 18, 64, 255, 18
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NEVER = np.iinfo(np.int64).max


class PieceTables:
    """Automaton and merges as arrays, for segments of the CLASSES most used characters without runs of marks."""

    def __init__(self, id_of: dict[str, int], score: dict[str, float]):
        used = Counter("".join(id_of)).most_common(CLASSES)
        self.class_of = np.zeros(0x110000, dtype=np.uint8)
        for k, (c, _) in enumerate(used):
            self.class_of[ord(c)] = k + 1
        fit = [t for t in id_of if MARK * 2 not in t and all(self.class_of[ord(c)] for c in t)]
        scores = {x: k for k, x in enumerate(sorted({score[t] for t in fit}, reverse=True))}
        top = max(id_of.values()) + 1
        self.size = np.zeros(top, dtype=np.int64)
        self.rank, self.left, self.right = np.full(top, -1, dtype=np.int64), np.zeros(top, dtype=np.int64), np.zeros(top, dtype=np.int64)
        whole = {t for t in fit if len(t) == 1}
        pairs: list[tuple[int, int, int]] = []
        self._learn_pairs(pairs)
        for n, group in itertools.groupby(sorted((t for t in fit if len(t) > 1), key=len), key=len):  # the last merges of the pieces of n characters
            group = list(group)
            split = [(id_of[t[:k]], id_of[t[k:]], id_of[t], scores[score[t]]) for t in group for k in range(1, n) if t[:k] in whole and t[k:] in whole]
            if not split:
                continue
            x, y, made, rank = np.array(split, dtype=np.int64).T
            good = self.fit(x, y, rank)
            x_, y_, made_, rank_ = x[good], y[good], made[good], rank[good]
            if len(np.unique(made_)) != len(made_) or (np.maximum(self.rank[x_], self.rank[y_]) >= rank_).any():
                raise ValueError("the order of the model's merges isn't that of its scores")
            self.rank[made_], self.left[made_], self.right[made_] = rank_, x_, y_
            good = set(made_.tolist())
            whole |= {t for t in group if id_of[t] in good}
            pairs += zip(x.tolist(), y.tolist(), rank.tolist(), strict=True)
            self._learn_pairs(pairs)
        for t in whole:
            self.size[id_of[t]] = len(t)
        self._automaton({t: id_of[t] for t in whole})

    def _learn_pairs(self, pairs: list[tuple[int, int, int]]) -> None:
        table = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        key = (table[:, 0] << 32) | table[:, 1]
        order = np.argsort(self._bucket(key), kind="stable")
        self.pair_key, self.pair_rank = key[order], table[order, 2]
        self.bound = np.concatenate([[0], np.cumsum(np.bincount(self._bucket(key), minlength=1 << HASH_BITS))])

    @staticmethod
    def _bucket(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When a and b merge; _NEVER if their text is no piece."""
        key = (a << 32) | b
        at = self._bucket(key)
        at, end = self.bound[at], self.bound[at + 1]
        out = np.full(len(key), _NEVER)
        todo = np.flatnonzero(at < end)
        while len(todo):
            place = at[todo]
            hit = self.pair_key[place] == key[todo]
            out[todo[hit]] = self.pair_rank[place[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def fit(self, a: np.ndarray, b: np.ndarray, before=None) -> np.ndarray:
        """Whether the pairs a, b of whole pieces stay apart (until the merge `before`)."""
        out, live = np.zeros(len(a), dtype=bool), np.arange(len(a))
        limit = np.full(len(a), _NEVER) if before is None else before
        while len(live):
            apart = self._made(a, b) >= limit
            live, a, b = live[apart], a[apart], b[apart]
            ra, rb = self.rank[a], self.rank[b]
            ended = (ra < 0) & (rb < 0)
            out[live[ended]] = True
            go = ~ended
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb
            limit = np.where(later, ra, rb + 1)  # of equal merges the left one comes first
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def _automaton(self, pieces: dict[str, int]) -> None:
        """step[state, class] is the next state; ending[state] the nearest state on the way of suffixes that ends a piece (0:
        none), after[state] the one after that, piece[state] the piece."""
        prefixes = sorted({t[:k] for t in pieces for k in range(1, len(t) + 1)}, key=lambda t: (len(t), t))
        number = {t: i + 1 for i, t in enumerate(prefixes)}
        n = len(prefixes) + 1
        self.piece, self.ending, self.after = (np.zeros(n, dtype=np.int64) for _ in range(3))
        self.step = np.zeros((n, CLASSES + 1), dtype=np.int32)
        back = np.zeros(n, dtype=np.int64)
        for depth, group in itertools.groupby(prefixes, key=len):
            group = list(group)
            states = np.array([number[t] for t in group])
            parents = np.array([number.get(t[:-1], 0) for t in group])
            classes = self.class_of[[ord(t[-1]) for t in group]]
            if depth > 1:
                back[states] = self.step[parents, classes]
            ends = np.array([t in pieces for t in group])
            self.piece[states[ends]] = [pieces[t] for t in group if t in pieces]
            self.after[states] = self.ending[back[states]]
            self.ending[states] = np.where(ends, states, self.after[states])
            self.step[parents, classes] = states
            nexts = states  # their rows begin as those of the states they fall back to
            self.step[nexts] = self.step[back[nexts]] if depth > 1 else self.step[0]
        self.step = self.step.ravel()

    def suits(self, segments: list[str]) -> np.ndarray:
        codes = self.class_of[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        starts = np.cumsum([0, *map(len, segments)])[:-1]
        fine = np.minimum.reduceat(codes, starts) > 0
        return fine & np.array([len(x) <= LONG_SEGMENT and x[1:2] != MARK for x in segments])

    def encode(self, segments: list[str]) -> list[tuple[int, ...]]:
        """The ids of segments that suit."""
        sizes = np.array([len(x) for x in segments])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        codes = self.class_of[np.frombuffer("".join(segments).encode("utf-32-le"), dtype="<u4")].astype(np.int64)
        starts = (np.cumsum([0, *map(len, segments)])[:-1])[order]
        n, most = len(segments), int(sizes[0])
        last = np.zeros((most + 1, n), dtype=np.int64)
        state = np.zeros(n, dtype=np.int64)
        for t in range(most):
            k = int(np.searchsorted(-sizes, -t))  # segments longer than t
            state = self.step[state[:k] * (CLASSES + 1) + codes[starts[:k] + t]].astype(np.int64)
            at, todo = self.ending[state], np.arange(k)
            while len(todo):
                if not at.all():
                    raise ValueError("no last token for a prefix")
                piece = self.piece[at]
                before = t + 1 - self.size[piece]
                good = before == 0
                inner = np.flatnonzero(~good)
                good[inner] = self.fit(last[before[inner], todo[inner]], piece[inner])
                last[t + 1, todo[good]] = piece[good]
                rest = ~good
                todo, at = todo[rest], self.after[at[rest]]
        place, live, found, of = sizes.copy(), np.arange(n), [], []
        while len(live):
            piece = last[place[live], live]
            found.append(piece)
            of.append(live)
            place[live] -= self.size[piece]
            live = live[place[live] > 0]
        of = np.concatenate(of)
        by = np.lexsort((-np.arange(len(of)), order[of]))
        ids = np.concatenate(found)[by].tolist()
        cuts = np.cumsum(np.bincount(order[of], minlength=n)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]


class PrefixTableEncoder:
    def __init__(self, model_path: str):
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.id_of = {t: i for i, t in self.text.items()}
        self.score = {t: sp.get_score(i) for i, t in self.text.items()}
        if any(MARK in t[1:] and t.strip(MARK) for t in self.text.values()):
            raise ValueError("a piece joins a word mark to the text before it")
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelled = [str(i) for i in range(sp.get_piece_size())]
        self.tables = PieceTables(self.id_of, self.score)
        self.breaks = not any("\n" in t for t in self.id_of)
        self.automaton = ahocorasick.Automaton()
        for i, t in self.text.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        #: Ids of segments by their keys.
        self.known: dict[str, tuple[int, ...]] = {}

    def _merged(self, text: str) -> list[str]:
        """Plain merging, for the texts of a pair: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.score[t], -k) for k in range(len(parts) - 1) if (t := parts[k] + parts[k + 1]) in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _is_whole(self, i: int) -> bool:
        if (found := self.whole.get(i)) is None:
            found = self.whole[i] = self._merged(self.text[i]) == [self.text[i]]
        return found

    def _fit(self, a: int, b: int) -> bool:
        """Whether b follows a in an encoding; negative ids stand for characters without a piece, which never merge."""
        if a < 0 or b < 0:
            return b < 0 or self._is_whole(b)
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            found = self.pairs[a, b] = self._merged(x + y) == [x, y]
        return found

    def _segment(self, seg: str) -> tuple[int, ...]:
        ending: list[list[tuple[int, int]]] = [[] for _ in seg]
        for end, hit in self.automaton.iter(seg):
            ending[end].append(hit)
        last: list[tuple[int, int]] = []
        for end, hits in enumerate(ending):
            for i, size in hits:
                before = end - size
                if self._is_whole(i) if before < 0 else self._fit(last[before][0], i):
                    last.append((i, size))
                    break
            else:
                if seg[end] in self.id_of:
                    raise ValueError(f"no last token for {seg[: end + 1]!r}")
                last.append((-1, 1))
        ids: list[int] = []
        end = len(seg)
        while end:
            i, size = last[end - 1]
            ids += [i] if i >= 0 else [self.byte_id[b] for b in reversed(seg[end - 1].encode())]
            end -= size
        return tuple(reversed(ids))

    def _segments(self, text: str | None) -> list[str]:
        """The keys of a text's segments: what follows their word mark; a line's first one begins with its \n, which no piece
        has; of other segments all."""
        if not text:
            return []
        if MARK not in text and "  " not in text and " \n" not in text and text[0] not in " \n" and text[-1] != " " and self.breaks:
            return text.replace("\n", " \n").split(" ")
        return [x[1:] if x[:1] == MARK and x[1:2] not in (MARK, "", "\n") else x for x in _SEGMENT.findall(MARK + text.replace(" ", MARK))]

    def _learn(self, new: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of new segments; the long ones aren't remembered."""
        heads = {"\n": (self.byte_id[10],), "": ()}
        plain = {k: k[1:] if k[0] == "\n" else MARK + k for k in new if k[0] != MARK and k != "\n"}
        suits = dict(zip(plain, self.tables.suits(list(plain.values())), strict=True)) if plain else {}
        fine = [k for k in plain if suits[k]]
        found = {k: heads[k[:1] if k[0] == "\n" else ""] + ids for k, ids in zip(fine, self.tables.encode([plain[k] for k in fine]), strict=True)} if fine else {}
        found |= {k: self._segment(k if k[0] in (MARK, "\n") else MARK + k) for k in new if k not in found}
        if len(self.known) + len(found) > CACHE_SEGMENTS:
            self.known = {}
        self.known |= ((k, v) for k, v in found.items() if len(k) <= LONG_SEGMENT)
        return found

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        split = [self._segments(t) for t in texts]
        known = self.known
        if new := set().union(*split).difference(known):
            found = self._learn(new)
            if self.known is not known or max(map(len, new)) > LONG_SEGMENT:
                known = known | found
        return [list(itertools.chain.from_iterable(map(known.__getitem__, words))) for words in split]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids) if ids else ""


@functools.lru_cache(maxsize=1)
def encoder(model_path: str) -> PrefixTableEncoder:
    """One for each Python worker, which outlives its tasks."""
    return PrefixTableEncoder(model_path)


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _parts(texts: list[str | None]):
    """Runs of texts of TOGETHER_CHARS characters together, or of one."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > TOGETHER_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def _coder(model_path: str, keep_texts: bool):
    def rows(batches):
        coder = encoder(model_path)
        for batch in batches:
            columns = [[], []] if keep_texts else [[], [], []]
            for part in _parts(batch.column(1).to_pylist()):
                for ids in coder.encode_all(part):
                    made = (ids, coder.decode(ids)) if keep_texts else (len(ids), _hex(",".join(map(coder.spelled.__getitem__, ids))), _hex(coder.decode(ids)))
                    for column, value in zip(columns, made, strict=True):
                        column.append(value)
            types = [pa.list_(pa.int32()), pa.string()] if keep_texts else [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "ids", "decoded"] if keep_texts else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encoded(docs: DataFrame, model_path: str, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, ids, decoded), one row for each row of docs."""
    return _rows(docs, doc_id, text).mapInArrow(_coder(model_path, True), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row of docs; ids and texts stay in the task."""
    return _rows(docs, doc_id, text).mapInArrow(_coder(model_path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
