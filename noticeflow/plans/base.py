"""Registration of queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from .fixtures import AS_OF, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
#: DuckDB's form of the text normalisation.
NORM = "trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def query(name: str, sql: str | None = None, *views: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql, *views)
        return f

    return put


def norm(x: str) -> str:
    return NORM.format(x)


def any_sql(text: str, terms) -> str:
    """contains_any() of already normalised terms."""
    from ..functions.text import plain

    parts = []
    for t in map(plain, terms):
        parts.append(f"contains(' ' || {text} || ' ', ' {t} ')" if " " not in t and len(t) <= 4 else f"contains({text}, '{t}')")
    return "(" + " OR ".join(parts) + ")"


def has_sql(text: str, terms) -> str:
    from ..functions.text import plain

    return "(" + " OR ".join(f"contains({text}, '{plain(t)}')" for t in terms) + ")"
