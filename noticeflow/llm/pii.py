"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, address schemes and account cues.
From each anchor a parser for its kind expands to the boundaries and validates: e-mail (both ways from
the at-sign), IPv4 (parts up to 255), payment card (16 to 19 digits, Luhn), phone (8 to 15 digits), and,
added to these, `iban` (mod 97, with or without a cue before it) and `address` (a scheme's address that
names a user: mailto:, sip:, or user@ in a URL). Matches of a kind are leftmost and do not overlap; what
fails validation is dropped and not tried again.

Null texts count as empty. Offsets are code points, ends exclusive. Every row of docs has its row in the
result, also those that repeat an id or have none.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "address")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_USER_URL = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "sip:")
CUES = ("IBAN", "Iban", "iban")


@functools.lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "digit") for d in "0123456789"), *((s, "scheme") for s in SCHEMES), *((q, "cue") for q in CUES)]:
        made.add_word(word, kind)
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def small(digits: str) -> bool:
    """Whether a part of an address is at most 255, however many zeros it has before."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(ch, 36)) for ch in code[4:] + code[:4])) % 97 == 1


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    text = text or ""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)

    def take(kind: str, start: int, end: int, valid: bool) -> None:
        done[kind] = end
        if valid:
            found[kind].append((start, end))

    for end, anchor in anchors().iter(text):
        at = end  # anchors of one character; of longer ones, their last
        if anchor == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                take("email", start, m.end(), True)
        elif anchor == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                take("phone", at, m.end(), 8 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif anchor == "digit":
            if at >= done["ip"] and not (at > done["ip"] and text[at - 1] in "0123456789") and (m := _IP.match(text, at)):
                take("ip", at, m.end(), all(small(x) for x in m[0].split(".")))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                take("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
            if at >= 2 and at - 2 >= done["iban"] and text[at - 1].isupper() and (at < 3 or not text[at - 3].isalnum()) and (m := _IBAN.match(text, at - 2)) and iban_valid(m[0]):
                take("iban", at - 2, m.end(), True)
        elif anchor == "scheme":
            if end + 1 >= done["address"] and (m := _USER_URL.match(text, end + 1)):
                take("address", end + 1, m.end(), True)
        elif (m := _IBAN.match(text, min(len(text), end + 1 + len(re.match(r"[\s:.#]*", text[end + 1 : end + 9])[0])))) and m.start() >= done["iban"]:
            take("iban", m.start(), m.end(), iban_valid(m[0]))
    return found


def _scan(batches):
    for batch in batches:
        counts, digests, all_spans = [[] for _ in BASE], [], []
        for text in batch.column(1).to_pylist():
            found = spans(text)
            spelled = {k: [f"{k}:{s}:{e}" for s, e in found[k]] for k in KINDS}
            for column, k in zip(counts, BASE, strict=True):
                column.append(len(found[k]))
            digests.append(hashlib.sha256(",".join(x for k in BASE for x in spelled[k]).encode()).hexdigest())
            all_spans.append(",".join(x for k in KINDS for x in spelled[k]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def personal_data(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_ of each base kind, base_sha256, spans): spans as kind:start:end by kind as in KINDS, then start."""
    short_batches(docs.sparkSession)
    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan, schema)
