"""Regular expressions to transition arrays: subset construction, byte classes, minimisation.

Rules use literals, \\xHH and other escapes of signs, classes, groups, (?i: groups, alternation and ? + * {m,n};
they work on bytes and match ASCII. `scanner(rules)` is one automaton for all rules that looks for each of
them at every place; its state says which rules end here. `anchored(rule)` matches from a given place,
`reversed_rule(rule)` backwards from an end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

_PIECE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([^0-9A-Za-z])|([^\\])", re.S)
_TIMES = re.compile(r"[?+*]|\{(\d+)(,?)(\d*)\}")


class _Reader:
    """A rule as a tree: a set of bytes, ("all", parts), ("any", options) or ("times", part, least, most or None)."""

    def __init__(self, rule: str):
        self.rule, self.at = rule, 0

    def read(self):
        made = self._options(False)
        if self.at < len(self.rule):
            raise ValueError(f"not supported in a rule: {self.rule[self.at :]}")
        return made

    def _next(self, text: str) -> bool:
        there = self.rule.startswith(text, self.at)
        self.at += len(text) * there
        return there

    def _sign(self) -> int:
        m = _PIECE.match(self.rule, self.at)
        if m is None or ord(m[2] or m[3] or "a") > 127:
            raise ValueError(f"not supported in a rule: {self.rule[self.at :]}")
        self.at = m.end()
        return int(m[1], 16) if m[1] else ord(m[2] or m[3])

    def _options(self, any_case: bool):
        options = [self._parts(any_case)]
        while self._next("|"):
            options.append(self._parts(any_case))
        return options[0] if len(options) == 1 else ("any", options)

    def _parts(self, any_case: bool):
        parts = []
        while self.at < len(self.rule) and self.rule[self.at] not in "|)":
            if self._next("("):
                part = self._options(self._next("?i:") or any_case)
                if not self._next(")"):
                    raise ValueError("a group has no end")
            else:
                if self.rule[self.at] in "?+*{}^$.]":
                    raise ValueError(f"not supported in a rule: {self.rule[self.at :]}")
                got = self._class() if self._next("[") else {self._sign()}
                if any_case:
                    got |= {ord(c) for x in got if x < 128 for c in (chr(x).lower(), chr(x).upper())}
                part = frozenset(got)
            while m := _TIMES.match(self.rule, self.at):
                self.at = m.end()
                least, most = {"?": (0, 1), "+": (1, None), "*": (0, None)}.get(m[0]) or (int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
                part = ("times", part, least, most)
            parts.append(part)
        return ("all", parts)

    def _class(self) -> set[int]:
        negated, got = self._next("^"), set()
        while not self._next("]"):
            first = self._sign()
            if self.rule.startswith("-", self.at) and not self.rule.startswith("-]", self.at):
                self.at += 1
                got |= set(range(first, self._sign() + 1))
            else:
                got.add(first)
        return set(range(256)) - got if negated else got


@dataclass
class _Nfa:
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, part, start: int, backwards: bool) -> int:
        """Adds what matches part after start; its end."""
        if isinstance(part, frozenset):
            end = self.state()
            self.moves[start].append((part, end))
        elif part[0] == "all":
            end = start
            for x in reversed(part[1]) if backwards else part[1]:
                end = self.build(x, end, backwards)
        elif part[0] == "any":
            end = self.state()
            for option in part[1]:
                s = self.state()
                self.free[start].append(s)
                self.free[self.build(option, s, backwards)].append(end)
        else:
            _, body, least, most = part
            for _ in range(least):
                start = self.build(body, start, backwards)
            end = self.state()
            self.free[start].append(end)
            if most is None:
                s = self.state()
                self.free[start].append(s)
                self.free[self.build(body, s, backwards)] += [s, end]
            else:
                for _ in range(most - least):
                    start = self.build(body, start, backwards)
                    self.free[start].append(end)
        return end


@dataclass
class Automaton:
    """classes: 256 bytes for bytes.translate; step[state + class] is the next state; states are numbered in steps of
    the number of classes, those below `first_end` end no rule, and ends[state] says which rules the others end. Dead: 0."""

    classes: bytes
    step: list[int]
    start: int
    first_end: int
    ends: dict[int, int]


def _determinised(nfa: _Nfa, starts: list[int], final: dict[int, int], everywhere: bool) -> Automaton:
    letters = list({s for moves in nfa.moves for s, _ in moves})
    groups: dict[tuple[bool, ...], list[int]] = {}
    for b in range(256):
        groups.setdefault(tuple(b in s for s in letters), []).append(b)
    classes, members = bytearray(256), list(groups.values())
    for i, bs in enumerate(members):
        for b in bs:
            classes[b] = i

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in nfa.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    # Sets of states are rows of bits; reach[state, class] is where the class leads, closed.
    lead = [[closed({t for on, t in moves if bs[0] in on}) for bs in members] for moves in nfa.moves]
    reach = np.zeros((len(lead), len(members), len(lead)), dtype=bool)
    for s, row in enumerate(lead):
        for k, to in enumerate(row):
            reach[s, k, list(to)] = True
    reach = np.packbits(reach, axis=2)
    first, none = closed(starts), frozenset()
    again = np.packbits(np.isin(np.arange(len(lead)), list(first)))
    number, order, table = {np.zeros_like(again).tobytes(): 0, again.tobytes(): 1}, [none, first], []
    for states in order:  # grows meanwhile
        to = np.bitwise_or.reduce(reach[list(states)], axis=0) if states else np.zeros(reach.shape[1:], dtype=np.uint8)
        if everywhere and states:
            to = to | again
        row = []
        for bits in to:
            if (key := bits.tobytes()) not in number:
                number[key] = len(order)
                order.append(frozenset(np.flatnonzero(np.unpackbits(bits)).tolist()))
            row.append(number[key])
        table.append(row)
    ends = np.array([sum(1 << k for k in {final[s] for s in states if s in final}) for states in order], dtype=np.int64)
    step = np.array(table, dtype=np.int64)
    # Moore's refinement: states are equal while they end the same rules and lead to equal states.
    part = np.unique(ends, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    n = int(part.max()) + 1
    example = np.zeros(n, dtype=np.int64)
    example[part] = np.arange(len(part))
    dead = part[0]
    by = sorted(range(n), key=lambda p: (ends[example[p]] != 0, p != dead, p))
    place = {p: i for i, p in enumerate(by)}
    k = len(members)
    flat = [place[int(part[x])] * k for p in by for x in step[example[p]]]
    ending = {i * k: int(ends[example[p]]) for i, p in enumerate(by) if ends[example[p]]}
    return Automaton(bytes(classes), flat, place[int(part[1])] * k, min(ending, default=n * k), ending)


def _compiled(rules: list[str], backwards: bool, everywhere: bool) -> Automaton:
    nfa, starts, final = _Nfa(), [], {}
    for i, rule in enumerate(rules):
        s = nfa.state()
        starts.append(s)
        final[nfa.build(_Reader(rule).read(), s, backwards)] = i
    return _determinised(nfa, starts, final, everywhere)


def scanner(rules: list[str]) -> Automaton:
    return _compiled(rules, False, True)


def anchored(rule: str) -> Automaton:
    return _compiled([rule], False, False)


def reversed_rule(rule: str) -> Automaton:
    return _compiled([rule], True, False)


def places(a: Automaton, data: bytes) -> Iterator[tuple[int, int]]:
    """(end, rules) of every place in data where rules end; one pass over the bytes."""
    step, state, bound = a.step, a.start, a.first_end
    for i, k in enumerate(data.translate(a.classes)):
        state = step[state + k]
        if state >= bound:
            yield i + 1, a.ends[state]


def longest(a: Automaton, data: bytes, at: int = 0, to: int | None = None) -> int:
    """The length of the longest match that begins at `at` and ends by `to`, 0 if none; if `to` is before `at`, of the
    longest one backwards that takes the bytes before `at` down to `to`. Only the bytes of the walk are read."""
    step, state, bound, best, classes = a.step, a.start, a.first_end, 0, a.classes
    to = len(data) if to is None else to
    way = range(at, to) if to >= at else range(at - 1, to - 1, -1)
    for n, i in enumerate(way, 1):
        state = step[state + classes[data[i]]]
        if state >= bound:
            best = n
        elif not state:
            break
    return best
