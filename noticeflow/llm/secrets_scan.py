"""Secret scans: all rules in one automaton, one pass over the bytes of a text.

The combined automaton says where each rule first ends. From there the rule's reversed automaton finds
the leftmost start after the rule's last match, and its anchored automaton the longest end, which gives
the leftmost non-overlapping matches of each kind; matches that fail the kind's length are dropped and
not tried again. A minimum that cannot change where other matches start is part of the rule (hex). The
automata are compiled once, on the driver, and broadcast; the walks read the bytes of a match only.

Null texts count as empty. Offsets are code points, ends exclusive. Every row of docs has its row in the
result, also those that repeat an id or have none.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rule_automaton as ra
from .common import short_batches


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("key_block", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
)


def assigned_value(match: bytes) -> bytes:
    """Group 2 of an assignment: what follows the first separator, the spaces and one quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    rest = match[at + 1 :].lstrip(b" ")
    return rest[1:] if rest[:1] in (b'"', b"'") else rest


@functools.lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]):
    return ra.scanner([r.pattern for r in rules]), [(ra.reversed_rule(r.pattern), ra.anchored(r.pattern)) for r in rules]


def _passes(rule: Rule, match: bytes) -> bool:
    return len(assigned_value(match) if rule.kind == "assign" else match) >= rule.least


def spans(text: str | None, rules: tuple[Rule, ...] = RULES, tables=None) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end), sorted."""
    data = (text or "").encode("utf-8", "surrogatepass")
    scan, each = tables or compiled(rules)
    done, found = [0] * len(rules), []
    for end, which in ra.places(scan, data):
        for k, (back, forth) in enumerate(each):
            if which >> k & 1 and end > done[k]:
                size = ra.longest(back, data, end, done[k])
                if not size:
                    continue
                start = end - size
                stop = start + ra.longest(forth, data, start)
                done[k] = stop
                if _passes(rules[k], data[start:stop]):
                    found.append((start, k, stop))
    if found and not data.isascii():
        at = sorted({x for s, _, e in found for x in (s, e)})
        place, chars, last = {}, 0, 0
        for b in at:
            chars += len(data[last:b].decode("utf-8", "surrogatepass"))
            place[b], last = chars, b
        found = [(place[s], k, place[e]) for s, k, e in found]
    return sorted(found)


def _scan(rules: tuple[Rule, ...], tables):
    base = [k for k, r in enumerate(rules) if r.base]

    def rows(batches):
        for batch in batches:
            counts, digests, all_spans = [[] for _ in base], [], []
            for text in batch.column(1).to_pylist():
                found = spans(text, rules, tables.value)
                spelled = [(k, f"{rules[k].kind}:{s}:{e}") for s, k, e in found]
                for column, k in zip(counts, base, strict=True):
                    column.append(sum(k == x for x, _ in spelled))
                digests.append(hashlib.sha256(",".join(t for k, t in spelled if rules[k].base).encode()).hexdigest())
                all_spans.append(",".join(t for _, t in spelled))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], ["doc_id", *(f"n_{rules[k].kind}" for k in base), "base_sha256", "spans"])

    return rows


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_ of each base kind, base_sha256, spans): spans as kind:start:end by start, then kind as in rules."""
    short_batches(docs.sparkSession)
    tables = docs.sparkSession.sparkContext.broadcast(compiled(rules))  # of the rules' size
    schema = "doc_id long, " + "".join(f"n_{r.kind} long, " for r in rules if r.base) + "base_sha256 string, spans string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan(rules, tables), schema)
