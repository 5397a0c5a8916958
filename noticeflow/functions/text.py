"""Text functions on columns."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def plain(text: str | None) -> str:
    """normalize() of a Python string; for terms."""
    kept = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in kept).split())


def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters of the basic plane that lose their marks or form: those that become one ASCII letter or digit and what
    they become, and those that become several characters with a letter or digit among them (ligatures, fractions, units)."""
    source, target, longer = [], [], {}
    for code in range(0x80, 0xFFFF):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if not any(c.isascii() and c.isalnum() for c in bare):
            continue
        if len(bare) == 1:
            source.append(chr(code))
            target.append(bare)
        else:
            longer[chr(code)] = "".join(c if c.isascii() and c.isalnum() else " " for c in bare)
    return "".join(source), "".join(target), longer


_FROM, _TO, _LONGER = _folding()


def normalize(text: Column) -> Column:
    """Compatibility decomposition without marks, lower case, all but a-z and 0-9 to single spaces; null is ''."""
    text = F.coalesce(text, F.lit(""))
    folded = F.translate(F.regexp_replace(text, r"\p{Mn}", ""), _FROM, _TO)
    # Rare, so one by one where there is any.
    pairs = F.map_entries(F.from_json(F.lit(json.dumps(_LONGER)), "map<string,string>"))
    folded = F.when(F.translate(folded, "".join(_LONGER), "") != folded, F.aggregate(pairs, folded, lambda acc, p: F.replace(acc, p["key"], p["value"]))).otherwise(folded)
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, list(conditions), F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, list(conditions), F.lit(True))


#: Longer lists are tested by one loop over an array, as an expression for each term makes methods too large to be compiled.
INLINE_TERMS = 4


def _one_of(text: Column, needles: list[str]) -> Column:
    if len(needles) < INLINE_TERMS:
        return any_of(text.contains(x) for x in needles)
    return F.exists(F.array(*map(F.lit, needles)), lambda x: text.contains(x))


def contains_any(text: Column, terms) -> Column:
    """A normalised text has one of the terms; a single word of at most four characters must be a word of its own."""
    folded = [t for t in map(plain, terms) if t]
    alone = [t for t in folded if " " not in t and len(t) <= 4]
    inside = _one_of(text, [t for t in folded if t not in alone])
    return inside | _one_of(F.concat(F.lit(" "), text, F.lit(" ")), [f" {t} " for t in alone]) if alone else inside


def has_substring(text: Column, terms) -> Column:
    """A normalised text has one of the terms, also inside words."""
    return _one_of(text, list(map(plain, terms)))


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_text(*columns) -> Column:
    """Normalised join of texts and arrays of texts; nulls are skipped."""
    return normalize(F.concat_ws(" ", *columns))


def first_sentence(text: Column, most: int = 500) -> Column:
    return F.substring(F.split(text, r"(?<=[.!?])\s+", 2)[0], 1, most)


def title_pick(heading: Column, text: Column, least: int = 12, most: int = 500) -> Column:
    """The heading if it has `least` characters and isn't a number, else the first sentence."""
    heading = clean_text(heading)
    good = (F.length(heading) >= least) & ~normalize(heading).rlike("^[0-9]+$")
    return F.when(good, F.substring(heading, 1, most)).otherwise(first_sentence(text, most))


def positions(text: Column) -> Column:
    """Number of posts: 'n. 3 posti', '3 posti', else null."""
    found = F.regexp_extract(F.lower(text), r"(?:n\.?\s*)?(\d{1,4})\s*(?:posti|posto|incarichi|incarico|unita|unità|borse|borsa)\b", 1)
    return F.nullif(found, F.lit("")).cast("int")


def file_type(url: Column) -> Column:
    """Extension of a document's url in upper case, null without one."""
    return F.upper(F.nullif(F.regexp_extract(F.lower(url), r"\.(pdf|docx?|odt|xlsx?|ods|zip|p7m|rtf)(?:$|[?#])", 1), F.lit("")))


def csv_array(column) -> Column:
    """Array of a comma-separated text, without empty parts."""
    return F.filter(F.split(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), ","), lambda x: x != "")
