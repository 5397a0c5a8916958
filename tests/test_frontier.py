"""The registered frontier query against a breadth-first walk in Python."""

from collections import defaultdict

import duckdb

from noticeflow.plans import registry

SF = "/root/testdata/sf0.001"


def test_expand_frontier_query(spark):
    pages = duckdb.sql(f"SELECT page_id, url FROM read_parquet('{SF}/pages.parquet')").fetchall()
    url = dict(pages)
    sources, edges = defaultdict(set), defaultdict(set)
    for page, u in pages:
        sources[page // 3].add(u)
        edges[u] |= {url[t] for k in (1, 2, 3) if (t := (page * 3 + k) % len(pages)) in url}
    expected = set()
    for source, seeds in sources.items():
        seen, near = dict.fromkeys(sorted(seeds)[:24], 0), seeds
        for level in (1, 2):
            near = {t for u in seen if seen[u] == level - 1 for t in edges[u]} - set(seen)
            seen |= dict.fromkeys(sorted(near)[: 24 - len(seen)], level)
        expected |= {(source, u, level) for u, level in seen.items()}
    got = [tuple(r) for r in registry.QUERIES["expand_frontier"](spark, SF).select("source_id", "url", "level").collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert len(sources) > len(pages) // 4 and {level for _, _, level in got} == {0, 1, 2}
