"""URL functions on columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import SEARCH_KEYS
from .text import normalize


def part(url: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def query_value(url: Column, key: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))


def search_url(url: Column, keys=SEARCH_KEYS) -> Column:
    """The query has one of the keys with a value that isn't blank."""
    return F.coalesce(part(url, "QUERY").rlike(r"(^|&)(" + "|".join(keys) + r")=[^&]"), F.lit(False))


def bad_url(url: Column) -> Column:
    return search_url(url) | F.lower(url).rlike("/page/|/category/")


def file_like_url(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(pdf|docx?|odt|xlsx?|zip|p7m)($|[?#])|/download|download=")


def normalized_url(url: Column) -> Column:
    """Host in lower case, path without a slash at its end, query; null is ''."""
    return F.concat(F.lower(part(url, "AUTHORITY")), F.rtrim(part(url, "PATH"), F.lit("/")), part(url, "QUERY"))


def same_url(a: Column, b: Column) -> Column:
    return (part(a, "PROTOCOL") == part(b, "PROTOCOL")) & (normalized_url(a) == normalized_url(b))


def safe_http_url(url: Column) -> Column:
    """The url if it is http or https, has a host and names no user; else null."""
    url = F.trim(url)
    return F.when(F.lower(part(url, "PROTOCOL")).isin("http", "https") & (part(url, "AUTHORITY") != "") & ~part(url, "AUTHORITY").contains("@"), url)


def without_dots(path: Column) -> Column:
    """A path with its segments . and .. resolved; .. at the root is dropped."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, x)),
    )
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)[.][.]?(/|$)"), F.array_join(ended, "/")).otherwise(path)


def urljoin(base: Column, href: Column) -> Column:
    """Absolute url of a link: absolute, //host, /path, ?query, #fragment, or relative to the base's folder; dotted segments of
    paths are resolved."""
    root = F.concat(part(base, "PROTOCOL"), F.lit("://"), part(base, "AUTHORITY"))
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_replace(part(base, "PATH"), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    path, rest = F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 2)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(part(base, "PROTOCOL"), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, without_dots(path), rest))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href == "", base)
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), rest))
    )


#: Official hosts that count as one site, with all below them.
EDUCATION_HOSTS = ("mim.gov.it", "miur.gov.it", "istruzione.gov.it")


def same_site(a: Column, b: Column) -> Column:
    """b has no host or that of a, or both are hosts of the education ministry."""
    of_ministry = lambda h: functools.reduce(lambda x, y: x | y, [h.endswith(e) for e in EDUCATION_HOSTS])
    return (host(b) == "") | (host(a) == host(b)) | (of_ministry(host(a)) & of_ministry(host(b)))


def external_id(source_id: Column, url: Column, title: Column, listing: Column) -> Column:
    """24 hex digits of source and url, and of the title where the page is a listing."""
    raw = F.concat_ws("|", F.coalesce(source_id.cast("string"), F.lit("")), normalize(url), F.when(listing, normalize(title)))
    return F.substring(F.sha2(raw, 256), 1, 24)


#: The code of a published act, and how many hex digits an id has.
REDACTION_CODE, ID_DIGITS, SHORT_ID_DIGITS = r"\b\d{2}[A-Z]\d{5}\b", 24, 16


def _digest(*parts: Column, digits: int = ID_DIGITS) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, digits)


def _day(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def _first_value(urls: Column, key: str) -> Column:
    """The first value that isn't empty of a query key in an array of urls."""
    values = F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.try_url_decode(query_value(u, key)))
    return F.get(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), 0)


#: The identity rules: each is a function of a record's columns by name.
ID_RULES = {
    "listing": lambda c: external_id(c["source_id"], c["url"], c["title"], c["listing"]),
    "title_and_url": lambda c: _digest(c["source_id"], normalize(c["title"]), normalize(c["url"])),
    "lower_url": lambda c: F.when(c["listing"], _digest(c["source_id"], F.lower(c["url"]), F.lower(c["title"]))).otherwise(_digest(c["source_id"], F.lower(c["url"]))),
    "record": lambda c: _digest(c["source_id"], c["record_id"], normalize(c["title"]), normalize(c["url"])),
    "title": lambda c: _digest(normalize(c["title"])),
    "title_and_dates": lambda c: _digest(normalize(c["title"]), _day(c["published_at"]), _day(c["deadline_at"]), c["section_url"]),
    "trailing_number": lambda c: F.coalesce(F.nullif(F.regexp_extract(part(c["url"], "PATH"), r"-(\d+)$", 1), F.lit("")), _digest(c["url"])),
    "attachment": lambda c: F.coalesce(_first_value(c["attachment_urls"], "id"), _digest(c["title"], c["deadline_text"], digits=SHORT_ID_DIGITS)),
    "last_segment": lambda c: F.regexp_replace(F.element_at(F.split(part(c["url"], "PATH"), "/"), -1), "[.]html$", ""),
    "redaction_code": lambda c: F.coalesce(_first_value(F.array(c["url"]), "atto.codiceRedazionale"), F.nullif(F.regexp_extract(F.coalesce(c["text"], F.lit("")), REDACTION_CODE, 0), F.lit(""))),
}


def external_id_by(rule: Column, **columns: Column) -> Column:
    """The external id by the rule that a row's source has (a key of ID_RULES); null for another rule, and where an act has no
    redaction code. columns: source_id, url, title, listing, record_id, published_at, deadline_at, section_url,
    attachment_urls, deadline_text, text; one that isn't given is null (listing: false)."""
    given = {k: F.lit(None).cast(t) for k, t in {"source_id": "string", "url": "string", "title": "string", "record_id": "string", "published_at": "timestamp", "deadline_at": "timestamp", "section_url": "string", "attachment_urls": "array<string>", "deadline_text": "string", "text": "string"}.items()} | columns
    given["listing"] = F.coalesce(columns.get("listing", F.lit(False)), F.lit(False))
    return functools.reduce(lambda made, name: made.when(rule == name, ID_RULES[name](given)), ID_RULES, F.when(F.lit(False), F.lit("")))


def external_key(source: Column, external_id: Column, url: Column) -> Column:
    """Hash of a record's three names; missing ones keep their place."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (source, external_id, url)]), 256)


def fingerprint(title: Column, organization: Column, deadline: Column) -> Column:
    """Hash of the normalised title, organisation and deadline text."""
    return F.sha2(F.concat_ws("|", *map(normalize, (title, organization, deadline))), 256)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)
