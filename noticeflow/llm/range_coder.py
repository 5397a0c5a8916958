"""Adaptive context-mixing range coder for token ids, one block at a time.

A block of n ids is cut into L runs of S ids. Step t codes the t-th id of every run at once, each run
with a range coder of its own (56-bit low, 28-bit words, carries resolved at the end), so that a step
is a few numpy operations over L ids. All runs share the block's adaptive models:

- order 2 and order 1: places of one table that hold, for the last two ids (hashed) and the last id, the id
  seen next and a confidence from 0 to 7, which goes up when the prediction is right and down when not;
- order 0: frequencies of the ids of the steps before, taken anew after steps 1, 2, 4, 8 ...

They are mixed in one interval of 2**24: each prediction gets the share that predictions of its
confidence have earned in this block so far; the order-0 frequencies share the rest. A block starts
with empty models, so it can be decoded alone. Its CRC-32 covers header and words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, RUN, SCALE = 4096, 64, 24
NONE = 0xFFFFF  # no id: a vocabulary has fewer
#: Predictions get seven eighths of the interval at most; an id has so much of the order-0 interval at least, which leaves
#: every id at least 1 of the rest.
MOST, LEAST = 7 << (SCALE - 3), 8
_HEAD = struct.Struct("<4sIIIII")
MAGIC = b"CMR2"


#: A place of the table is id * 16 + confidence; EMPTY stands for the confidence where no id was seen. Order 1's places come
#: after order 2's, and its confidences are counted from 16 on.
EMPTY, ORDER_1 = 8, 1 << 18
#: What a place changes by after a miss (first 32) and after a hit; below zero if the id is replaced.
_STEP = np.array([([-(1 << 30)] + [-1] * 7 + [-(1 << 30)] * 8) * 2, ([1] * 7 + [0] * 9) * 2], dtype=np.int32).ravel()
_BUCKET = 8  # the search table has an entry for 2**_BUCKET of the interval


class _Mixer:
    """The models of one block; encoder and decoder make the same calls. Rows of two are orders 2 and 1."""

    def __init__(self, vocab: int, lanes: int):
        self.vocab = vocab
        self.places = np.full(ORDER_1 + (1 << 16), NONE << 4 | EMPTY, dtype=np.int32)
        self.hits, self.tries = np.ones(32, dtype=np.int64), np.full(32, 4, dtype=np.int64)
        self.seen = np.zeros(vocab, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.steps, self.next_fresh = 0, 1
        self.hashed = np.zeros(lanes, dtype=np.uint32)
        self.at = np.empty((2, 0), dtype=np.intp)
        self._weigh()
        self._fresh()

    def _weigh(self) -> None:
        self.share = np.minimum(np.maximum((self.hits << SCALE) // self.tries, 1), MOST)
        self.share[[EMPTY, 16 + EMPTY]] = 0

    def _fresh(self) -> None:
        if self.waiting:
            self.seen += np.bincount(np.concatenate(self.waiting), minlength=self.vocab)
        self.waiting = []
        total = max(1, int(self.seen.sum()))
        freq = LEAST + self.seen * ((1 << SCALE) - LEAST * self.vocab) // total
        self.cum = np.zeros(self.vocab + 1, dtype=np.int64)
        np.cumsum(freq, out=self.cum[1:])
        self.cum[-1] = 1 << SCALE
        self.table = None

    def find(self, points: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold the points, where asked: from a table by a point's high bits, else by search."""
        if self.table is None:
            per = np.bincount((self.cum + (1 << _BUCKET) - 1) >> _BUCKET, minlength=(1 << (SCALE - _BUCKET)) + 2)
            self.table = np.cumsum(per, dtype=np.int32) - 1  # the last bound that is at most the bucket's begin
        at = points >> _BUCKET
        found = self.table.take(at, mode="clip")
        open_ = ((found != self.table[1:].take(at, mode="clip")) & asked).nonzero()[0]  # most buckets lie in one interval
        found[open_] = np.searchsorted(self.cum, points.take(open_), side="right") - 1
        return found.astype(np.int64)

    def predict(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shares of the interval that the predictions of orders 2 and 1 get after these ids."""
        if self.steps == self.next_fresh:
            self.next_fresh *= 2
            self._fresh()
        if len(last) != self.at.shape[1]:
            self.at, self.conf, self.w = (np.empty((2, len(last)), dtype=np.int64) for _ in range(3))
            self.held = np.empty((2, len(last)), dtype=np.int32)
        mixed = last.astype(np.uint32)
        mixed *= np.uint32(2654435769)
        before, self.hashed = self.hashed[: len(last)], mixed
        np.right_shift(mixed + before * np.uint32(2246822519), np.uint32(14), out=self.at[0])
        np.bitwise_and(last, 0xFFFF, out=self.at[1])
        self.at[1] += ORDER_1
        self.places.take(self.at, out=self.held, mode="clip")
        self.ids = self.held >> 4
        np.bitwise_and(self.held, 15, out=self.conf)
        self.conf[1] += 16
        self.share.take(self.conf, out=self.w, mode="clip")
        w2, w1 = self.w
        w1 *= self.ids[0] != self.ids[1]
        np.minimum(w1, MOST - w2, out=w1)
        return w2, w1

    def parts(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the ids' order-0 intervals in what the predictions leave."""
        rest = (1 << SCALE) - before
        lo, size = self.cum.take(ids, mode="clip"), self.cum[1:].take(ids, mode="clip")
        lo *= rest
        lo >>= SCALE
        size *= rest
        size >>= SCALE
        size -= lo
        lo += before
        return lo, size

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """The ids (int32) that came, and which predictions were right."""
        if self.steps & 3 == 0:
            self.tries += np.bincount(self.conf.ravel(), minlength=32)
            self.hits += np.bincount(self.conf.ravel().compress(hit.ravel()), minlength=32)
        self.conf += hit.view(np.uint8) << np.uint8(5)
        changed = _STEP.take(self.conf, mode="clip")
        changed += self.held
        self.places[self.at] = np.where(changed < 0, ids << 4, changed)
        self.waiting.append(ids)
        self.steps += 1
        if self.steps & 3 == 1:
            self._weigh()


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // RUN))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray, vocab: int) -> bytes:
    """A block of all ids, which are below vocab (at most NONE)."""
    if vocab > NONE:
        raise ValueError("the vocabulary is too large")
    ids = np.asarray(ids)
    n = len(ids)
    lanes, steps = _lanes(n)
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    first = np.arange(lanes) * steps
    mix = _Mixer(vocab, lanes)
    low, rng = np.zeros(lanes, dtype=np.int64), np.full(lanes, 1 << 56, dtype=np.int64)
    runs, words = [], []  # words are 28 bits and a carry, which is resolved at the end
    last = np.full(lanes, NONE, dtype=np.int64)
    for t in range(steps):
        k = int(np.searchsorted(first, n - t))  # runs that have an id at this step
        if k == 0:
            break
        s = grid[t, :k].astype(np.int64)
        w2, w1 = mix.predict(last[:k])
        lo, size = mix.parts(s, w2 + w1)
        hit = mix.ids == grid[t, :k]
        one, two = (hit[1] & (w1 > 0)).nonzero()[0], hit[0].nonzero()[0]
        lo[one], size[one] = w2.take(one), w1.take(one)
        lo[two], size[two] = 0, w2.take(two)
        r = rng[:k] >> SCALE
        lo *= r
        low[:k] += lo
        np.multiply(size, r, out=rng[:k])
        small = (rng[:k] < 1 << 28).nonzero()[0]
        if len(small):
            value = low.take(small)
            runs.append(small)
            words.append(value >> 28)
            low[small] = (value & 0xFFFFFFF) << 28
            rng[small] = rng.take(small) << 28
        mix.learn(grid[t, :k], hit)
        last = s
    low += rng - 1
    runs.append(np.arange(lanes))
    words.append(low >> 28)
    runs = np.concatenate(runs).astype(np.uint16)
    flat, ptr = np.concatenate(words)[np.argsort(runs, kind="stable")], np.bincount(runs, minlength=lanes)
    while len(over := (flat >> 28).nonzero()[0]):
        flat[over] &= 0xFFFFFFF
        flat[over - 1] += 1
    if len(flat) & 1:
        flat = np.append(flat, 0)
    packed = ((flat[0::2] << 28) | flat[1::2]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
    body = _HEAD.pack(MAGIC, n, lanes, vocab, int(ptr.sum()), 0) + ptr.astype("<u4").tobytes() + packed
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; a ValueError if it was damaged."""
    if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    magic, n, lanes, vocab, n_words, _ = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("no block of this format")
    ptr = np.frombuffer(block, dtype="<u4", count=lanes, offset=_HEAD.size).astype(np.int64)
    raw = np.frombuffer(block, dtype=np.uint8, offset=_HEAD.size + 4 * lanes, count=7 * ((n_words + 1) // 2)).reshape(-1, 7)
    pairs = np.zeros((len(raw), 8), dtype=np.uint8)
    pairs[:, :7] = raw
    pairs = pairs.view("<u8").ravel().astype(np.int64)
    flat = np.stack([pairs >> 28, pairs & 0xFFFFFFF], axis=1).ravel()[:n_words]
    words = np.zeros((lanes, int(ptr.max(initial=0)) + 3), dtype=np.int64)
    words[np.arange(words.shape[1]) < ptr[:, None]] = flat
    words = words.T.ravel()  # the first word of all runs, then the second ...
    steps = -(-n // lanes)
    first = np.arange(lanes) * steps
    mix = _Mixer(vocab, lanes)
    off, rng, at = (words[:lanes] << 28) | words[lanes : 2 * lanes], np.full(lanes, 1 << 56, dtype=np.int64), np.arange(2 * lanes, 3 * lanes)
    out = np.zeros((steps, lanes), dtype=np.int32)
    last = np.full(lanes, NONE, dtype=np.int64)
    for t in range(steps):
        k = int(np.searchsorted(first, n - t))
        if k == 0:
            break
        w2, w1 = mix.predict(last[:k])
        before = w2 + w1
        r = rng[:k] >> SCALE
        v = np.minimum(off[:k] // r, (1 << SCALE) - 1)
        by_0 = v >= before
        u = np.maximum(v - before, 0)
        s = mix.find(((((u + 1) << SCALE) - 1) / ((1 << SCALE) - before)).astype(np.int64), by_0)  # below 2**53: exact
        lo, size = mix.parts(s, before)
        two = v < w2
        one, two = (~(by_0 | two)).nonzero()[0], two.nonzero()[0]
        s[one], lo[one], size[one] = mix.ids[1].take(one), w2.take(one), w1.take(one)
        s[two], lo[two], size[two] = mix.ids[0].take(two), 0, w2.take(two)
        lo *= r
        off[:k] -= lo
        np.multiply(size, r, out=rng[:k])
        small = (rng[:k] < 1 << 28).nonzero()[0]
        if len(small):
            place = at.take(small)
            off[small] = (off.take(small) << 28) | words.take(place, mode="clip")
            at[small] = place + lanes
            rng[small] = rng.take(small) << 28
        out[t, :k] = s
        mix.learn(out[t, :k], mix.ids == out[t, :k])
        last = s
    return out.T.ravel()[:n]
