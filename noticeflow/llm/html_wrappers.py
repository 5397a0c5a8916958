"""Main text of pages by wrappers: union-free regular expressions inferred for each host.

A page's stream of block tags and text slots is first folded: neighbours that repeat become a repeated
group. Pages of a host are then aligned one after the other with the host's wrapper; where they differ,
what only one of them has becomes optional, and a repetition on either side makes a repeated group.
Each task makes one wrapper for each of its hosts; equal ones are merged by a grouping, the rest are
aligned in rounds, so a host of any size is spread over tasks and no task holds its pages. A wrapper that
would grow beyond WRAPPER_NODES elements is made again for each class of pages with the same outline, and
a class that is still too large for each shape; a page that is larger by itself has a wrapper of its own.

Repetitions of long lists are found from hashes of their parts, and long lists are aligned by the longest
increasing sequence of equal occurrences, so a page of n blocks takes about n log n steps.

Each page is then matched with its host's wrapper, which gives every block of its text a slot, and the
slots get the statistics of their texts over the host: a slot is fixed if its text is the same on
different pages, and linked if most of its characters are in links. A page's text is taken from its articles,
from main with the articles in it if main has more text besides them, and from all where there is neither. What certainly isn't main text (menus, footers,
forms, adverts and the like by their elements and names) goes; where a name only hints at it, fixed and
linked slots go, and of slots seen on one page alone those whose whole name is the hint. On pages without
article and main, fixed and linked slots go too; if nothing were left, they stay.

Null html is empty; its text is the empty string. Null or odd urls share the host ''. Rows that repeat an
id are kept; equal pages count as one page. A plain slot inside the article or main that is taken is never
dropped. Alignment takes pages in the order in which they come, so where the pages of a host have no common
form, which of their slots are one slot can depend on how the pages are dealt to tasks.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import json
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, short_batches
from .html_tree import ARTICLE, CERTAIN, MAIN, MAIN_ARTICLE, NAME, OUTSIDE, PLAIN, Block, Node, parsed

#: Elements of all wrappers that a task holds, of a wrapper of several pages; shapes that a task remembers; salts of the rounds
#: of merging; bytes of wrappers that are broadcast; parts that a host's pages are dealt into beyond that.
HELD_NODES, WRAPPER_NODES, SHAPES_SEEN, MERGE_SALTS, BROADCAST_BYTES, HOST_PARTS = 400_000, 5_000, 200_000, (256, 16, 1), 64 << 20, 32
#: Lists that are compared width by width; pairs of elements that are aligned by longest blocks; levels of a page's outline.
SHORT_LIST, SHORT_PAIRS, OUTLINE_DEPTH = 256, 4096, 4
_PRIME, _BASE = (1 << 31) - 1, 1_000_003


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def merged(a: Node, b: Node) -> Node:
    return Node(a.label, aligned(a.kids, b.kids), a.many or b.many, a.maybe or b.maybe, a.slot or b.slot)


def optional(nodes: list[Node]) -> list[Node]:
    return [Node(n.label, n.kids, n.many, True, n.slot) for n in nodes]


def matches(la: list[str], lb: list[str]) -> list[tuple[int, int, int]]:
    """Blocks (place in la, place in lb, length) of equal labels in order: the longest ones of short lists; of long lists the
    longest increasing sequence of pairs of the same occurrence of a label."""
    if len(la) * len(lb) <= SHORT_PAIRS:
        return [tuple(m) for m in difflib.SequenceMatcher(None, la, lb, autojunk=False).get_matching_blocks()]
    head, most = 0, min(len(la), len(lb))
    while head < most and la[head] == lb[head]:
        head += 1
    tail = 0
    while tail < most - head and la[-1 - tail] == lb[-1 - tail]:
        tail += 1
    count: dict[str, int] = {}
    place: dict[tuple[str, int], int] = {}
    for j in range(head, len(lb) - tail):
        nth = count[lb[j]] = count.get(lb[j], 0) + 1
        place[lb[j], nth] = j
    count.clear()
    ends: list[int] = []  # the least last place in lb of an increasing sequence of each length, its pair, the pairs before
    last: list[int] = []
    pairs: list[tuple[int, int, int]] = []
    for i in range(head, len(la) - tail):
        nth = count[la[i]] = count.get(la[i], 0) + 1
        j = place.get((la[i], nth))
        if j is not None:
            k = bisect.bisect_left(ends, j)
            pairs.append((i, j, last[k - 1] if k else -1))
            ends[k : k + 1] = [j]
            last[k : k + 1] = [len(pairs) - 1]
    at = last[-1] if last else -1
    found = []
    while at >= 0:
        i, j, at = pairs[at]
        found.append((i, j, 1))
    return [(0, 0, head), *reversed(found), (len(la) - tail, len(lb) - tail, tail), (len(la), len(lb), 0)]


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """One sequence that matches both: equal labels are merged, the rest is optional or joins a group."""
    la, lb = [n.label for n in a], [n.label for n in b]
    if la == lb:
        return folded([merged(x, y) for x, y in zip(a, b, strict=True)])
    out: list[Node] = []
    i = k = 0
    for j, m, size in matches(la, lb):
        left, right = a[i:j], b[k:m]
        if len(left) == 1 and left[0].kids and group_label(right) == left[0].label:
            out.append(Node(left[0].label, aligned(left[0].kids, right), True, left[0].maybe))
        elif len(right) == 1 and right[0].kids and group_label(left) == right[0].label:
            out.append(Node(right[0].label, aligned(left, right[0].kids), True, right[0].maybe))
        else:
            out += optional(left) + optional(right)
        out += [merged(x, y) for x, y in zip(a[j : j + size], b[m : m + size], strict=True)]
        i, k = j + size, m + size
    return folded(out)


def group_label(nodes: list[Node]) -> str:
    return "(" + " ".join(n.label for n in nodes) + ")"


def folded(nodes: list[Node]) -> list[Node]:
    """nodes with repetitions of neighbours, one or several wide, as repeated groups; the narrowest first."""
    width = 1
    while 2 * width <= len(nodes):
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(n.label, len(number)) for n in nodes])
        if len(number) == len(nodes):
            break
        width = repeat_width(ids, width)
        if not width:
            break
        nodes = _folded_by(nodes, ids, width)
        width += 1
    return nodes


def _runs(equal: np.ndarray) -> np.ndarray:
    """For each place how many in a row are true from there."""
    places = np.arange(len(equal))
    return np.minimum.accumulate(np.where(equal, len(equal), places)[::-1])[::-1] - places


def repeat_width(ids: np.ndarray, least: int) -> int:
    """The smallest width, at least least, at which two neighbours are equal; 0 if there is none. In a long list the places
    that are multiples of a width are compared with those one width on, and how far both sides agree is searched by hashes:
    every repetition covers such a place. Equal hashes of different parts could name a width at which nothing is folded."""
    n = len(ids)
    if n <= SHORT_LIST:
        for width in range(least, n // 2 + 1):
            equal = ids[:-width] == ids[width:]
            if np.count_nonzero(equal) >= width and _runs(equal).max() >= width:
                return width
        return 0
    power = np.ones(1, np.int64)
    while len(power) <= n:
        power = np.concatenate([power, power * (int(power[-1]) * _BASE % _PRIME) % _PRIME])
    prefix = np.concatenate([[0], np.cumsum((ids + 1) * power[:n] % _PRIME)]) % _PRIME

    def agree(at: np.ndarray, width: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        low, high = np.zeros_like(at), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            begin, end = (at - mid, at) if back else (at, at + mid)
            same = (prefix[end] - prefix[begin]) % _PRIME * power[width] % _PRIME == (prefix[end + width] - prefix[begin + width]) % _PRIME
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    while 2 * least <= n:
        widths = np.arange(least, min(2 * least, n // 2 + 1))
        counts = (n - 1) // widths
        width = np.repeat(widths, counts)
        at = (np.arange(len(width)) - np.repeat(np.cumsum(counts) - counts, counts)) * width
        near = ids[at] == ids[at + width]
        at, width = at[near], width[near]
        long = agree(at, width, np.minimum(width, n - at - width), False) + agree(at, width, np.minimum(width, at), True) >= width
        if long.any():
            return int(width[long].min())
        least *= 2
    return 0


def _folded_by(nodes: list[Node], ids: np.ndarray, width: int) -> list[Node]:
    out: list[Node] = []
    runs = _runs(ids[:-width] == ids[width:])
    starts = np.flatnonzero(runs >= width)
    at = 0
    while (k := np.searchsorted(starts, at)) < len(starts):
        begin = int(starts[k])
        end = begin + width
        unit = nodes[begin:end]
        for _ in range(int(runs[begin]) // width):
            unit = [merged(x, y) for x, y in zip(unit, nodes[end : end + width], strict=True)]
            end += width
        out += nodes[at:begin]
        out.append(Node(unit[0].label, unit[0].kids, True, unit[0].maybe, unit[0].slot) if width == 1 else Node(group_label(unit), unit, True))
        at = end
    return out + nodes[at:]


def folded_tree(node: Node) -> Node:
    return Node(node.label, folded([folded_tree(k) for k in node.kids]), node.many, node.maybe, node.slot)


def size_of(node: Node) -> int:
    return 1 + sum(map(size_of, node.kids))


def to_list(node: Node) -> list:
    return [node.label, node.many * 4 + node.maybe * 2 + node.slot, [to_list(k) for k in node.kids]]


def to_node(x: list) -> Node:
    return Node(x[0], [to_node(k) for k in x[2]], bool(x[1] & 4), bool(x[1] & 2), bool(x[1] & 1))


def spelled(node: Node) -> str:
    return json.dumps(to_list(node), separators=(",", ":"))


def expression(node: Node) -> str:
    """The wrapper as a regular expression: # is a text slot."""
    inner = " ".join([*(["#"] if node.slot else []), *(expression(k) for k in node.kids)])
    made = f"({inner})" if node.label.startswith("(") else f"<{node.label}>{inner}</>" if node.label else inner
    return f"({made})" + ("*" if node.many and node.maybe else "+" if node.many else "?") if node.many or node.maybe else made


class Wrapper:
    """A wrapper with its elements numbered, to match pages with."""

    def __init__(self, text: str):
        self.root = to_node(json.loads(text))
        self.items: dict[int, list[tuple[Node, int, int]]] = {}
        self.places: dict[int, dict[str, list[int]]] = {}
        self.number: dict[int, int] = {}
        todo = [self.root]
        while todo:
            node = todo.pop()
            self.number[id(node)] = len(self.number)
            self.items[id(node)] = flat = []
            self._flatten(node.kids, flat)
            self.places[id(node)] = places = {}
            for k, (x, _, _) in enumerate(flat):
                places.setdefault(x.label, []).append(k)
            todo += [x for x, _, _ in flat]

    def _flatten(self, nodes: list[Node], flat: list[tuple[Node, int, int]]) -> None:
        """The elements below a node in order, each with the places where its repeated group begins and ends (-1: in none)."""
        for n in nodes:
            if n.label.startswith("("):
                begin = len(flat)
                self._flatten(n.kids, flat)
                if n.many:
                    flat[begin:] = [(x, b, e) if e >= 0 else (x, begin, len(flat)) for x, b, e in flat[begin:]]
            else:
                flat.append((n, -1, -1))

    def slots(self, tree: Node) -> dict[int, int]:
        """The number of the wrapper's element for each element of a page's tree (by identity) that it has a place for."""
        found = {id(tree): 0}
        todo = [(tree, self.root)]
        while todo:
            page, wrapper = todo.pop()
            items, places = self.items[id(wrapper)], self.places[id(wrapper)]
            at, begin, end = 0, -1, -1
            for kid in page.kids:
                of = places.get(kid.label, ())
                # what follows in the group, else the group again, else what follows it
                ahead = bisect.bisect_left(of, at)
                again = bisect.bisect_left(of, begin) if begin >= 0 else len(of)
                if again < ahead and not (ahead < len(of) and of[ahead] < end):
                    ahead = again
                if ahead < len(of):
                    k = of[ahead]
                    element, begin, end = items[k]
                    found[id(kid)] = self.number[id(element)]
                    todo.append((kid, element))
                    at = k if element.many else k + 1
        return found


@functools.lru_cache(maxsize=512)
def wrapper_of(text: str) -> Wrapper:
    return Wrapper(text)


def outlined(tree: Node, depth: int = OUTLINE_DEPTH) -> list:
    """The labels of the upper elements, each once, without regard to order."""
    inner = {json.dumps(outlined(k, depth - 1)) for k in tree.kids} if depth else ()
    return [tree.label, sorted(inner)]


def class_of(made: object, kind: str) -> str:
    return f"{kind}{xxhash.xxh64_hexdigest(json.dumps(made, separators=(',', ':')))}"


def classes_of(tree: Node, nodes: int) -> tuple[str, str, bool]:
    """(class by outline, class by shape, whether it is too large for a wrapper of several pages) of a folded page."""
    return class_of(outlined(tree), "o"), class_of(to_list(tree), "s"), size_of(tree) > nodes


def _partial(by_outline: bool, nodes: int, batches):
    """One wrapper for each host, or each outline of a host, in a partition, more if they take much room; null where it would
    be too large. Pages that are too large by themselves have their own."""
    wrappers: dict[tuple[str, str], Node | None] = {}
    sizes: dict[tuple[str, str], int] = {}
    seen: set[tuple[str, str]] = set()

    def flush():
        hosts, kinds = [h for h, _ in wrappers], [k for _, k in wrappers]
        made = pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.string()), pa.array([spelled(w) if w is not None else None for w in wrappers.values()], pa.string())], ["host", "kind", "wrapper"])
        wrappers.clear()
        sizes.clear()
        return made

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host = host_of(url)
            tree = folded_tree(parsed(page)[0])
            shape = class_of(to_list(tree), "s")
            if (host, shape) in seen:
                continue
            if len(seen) >= SHAPES_SEEN:
                seen.clear()
            seen.add((host, shape))
            large = size_of(tree) > nodes
            key = (host, shape if large else class_of(outlined(tree), "o") if by_outline else "")
            if large:
                wrappers[key] = tree
            elif key not in wrappers or wrappers[key] is not None:
                wrappers[key] = joined([wrappers[key], tree] if key in wrappers else [tree], nodes)
            sizes[key] = size_of(wrappers[key]) if wrappers[key] is not None else 1
            if sum(sizes.values()) > HELD_NODES:
                yield flush()
    yield flush()


def joined(trees: list[Node], nodes: int = WRAPPER_NODES) -> Node | None:
    """One wrapper for all, None if it would have more than `nodes` elements; a single tree is its own at any size."""
    made = trees[0]
    for t in trees[1:]:
        made = merged(made, t)
        if size_of(made) > nodes:
            return None
    return made


def _merge_group(nodes: int, pdf: pd.DataFrame) -> pd.DataFrame:
    texts = pdf["wrapper"]
    tree = None if texts.isna().any() else joined([to_node(json.loads(w)) for w in sorted(texts)], nodes)
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "kind": pdf["kind"].iloc[:1], "wrapper": [spelled(tree) if tree is not None else None]})


_WRAPPER = "host string, kind string, wrapper string"


def _wrappers(pages: DataFrame, by_outline: bool, nodes: int) -> DataFrame:
    """(host, kind, wrapper) of pages (url, html); wrapper is null where it would be too large."""
    trees = saved(pages.mapInArrow(functools.partial(_partial, by_outline, nodes), _WRAPPER), "wrappers-partial").distinct()
    for salts in MERGE_SALTS:
        trees = trees.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "kind", "salt").applyInPandas(lambda pdf: _merge_group(nodes, pdf), _WRAPPER).distinct()
    return saved(trees, "wrappers")


def _shapes(batches):
    """Each shape of page with its outline."""
    for batch in batches:
        rows = set()
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tree = folded_tree(parsed(page)[0])
            outline, shape, _ = classes_of(tree, 0)
            rows.add((host_of(url), outline, shape, spelled(tree)))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "outline", "kind", "wrapper"])


def _of_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """The pages (url, html) of some hosts."""
    return _with_side(pages.withColumn("host", _host("url")), hosts.select("host").distinct().withColumn("asked", F.lit("1")), ["host"], "asked").filter("asked is not null").select("url", "html")


def infer_wrappers(pages: DataFrame, url="url", html="html", nodes: int = WRAPPER_NODES) -> DataFrame:
    """(host, kind, wrapper): kind is '' for the wrapper of a host, else that of an outline or a shape of its pages."""
    short_batches(pages.sparkSession)
    pages = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    made = _wrappers(pages, False, nodes)
    large = made.filter("wrapper is null")
    if large.isEmpty():
        return made
    # the hosts whose wrapper is too large: by outlines, then by shapes
    again = _of_hosts(pages, large)
    outlines = _wrappers(again, True, nodes)
    every = made.filter("wrapper is not null").unionByName(outlines.filter("wrapper is not null"))
    large = outlines.filter("wrapper is null").select("host", F.col("kind").alias("outline"))
    if not large.isEmpty():
        shapes = saved(_of_hosts(pages, large).mapInArrow(_shapes, "host string, outline string, kind string, wrapper string"), "wrappers-shapes")
        every = every.unionByName(shapes.join(large.hint("merge"), ["host", "outline"], "left_semi").select("host", "kind", "wrapper"))
    return saved(every.dropDuplicates(["host", "kind"]), "wrappers-classes")


#: What extract needs of a block: its slot (-1: none), text, mark, kind, linked characters.
_BLOCKS = "array<struct<slot: int, text: string, mark: int, kind: int, linked: int>>"
_BLOCK_TYPE = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("mark", pa.int32()), ("kind", pa.int32()), ("linked", pa.int32())]))
_SEEN_TYPE = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())]))


def placed(page: str | None, wrapper: Wrapper | None) -> list[tuple[int, Block]]:
    """The page's blocks with their slots."""
    tree, blocks = parsed(page)
    slots = wrapper.slots(tree) if wrapper is not None else {}
    return [(slots.get(id(b.node), -1), b) for b in blocks]


def _match(batches):
    for batch in batches:
        rows, digests, seen = [], [], []
        for page, text in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            found = placed(page, wrapper_of(text) if text else None)
            rows.append([{"slot": s, "text": b.text, "mark": b.mark, "kind": b.kind, "linked": b.linked} for s, b in found])
            by: dict[int, list[int]] = {}
            digest = 0
            for s, b in found:
                crc = xxhash.xxh64_intdigest(b.text.encode("utf-8", "surrogatepass")) >> 1
                digest = (digest * 31 + crc) & 0x7FFFFFFFFFFFFFFF
                if s >= 0:
                    at = by.setdefault(s, [0, 0, 0])
                    at[:] = (at[0] * 31 + crc) & 0x7FFFFFFFFFFFFFFF, at[1] + len(b.text), at[2] + b.linked
            digests.append(digest)
            seen.append([{"slot": s, "text": t, "chars": n, "linked": k} for s, (t, n, k) in by.items()])
        kept = ("page_id", "url", "host", "kind")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, _BLOCK_TYPE), pa.array(digests, pa.int64()), pa.array(seen, _SEEN_TYPE)], [*kept, "blocks", "digest", "seen"])


def slot_statistics(matched: DataFrame) -> DataFrame:
    """(host, kind, slot, lone, fixed, linked): whether a slot is seen on one page alone (or on its copies), has the same text on
    different pages, and is mostly links."""
    seen = matched.select("host", "kind", "digest", F.explode("seen").alias("s")).select("host", "kind", "digest", "s.*")
    by = seen.groupBy("host", "kind", "slot").agg(F.min("text").alias("t0"), F.max("text").alias("t1"), F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    lone = F.col("d0") == F.col("d1")
    return by.select("host", "kind", "slot", lone.alias("lone"), (~lone & (F.col("t0") == F.col("t1"))).alias("fixed"), (2 * F.col("linked") > F.col("chars")).alias("linked"))


LONE, FIXED, LINKED = 1, 2, 4


def main_text(blocks: list[tuple[int, str, int, int, int]], known: dict[int, int]) -> str:
    """The main text of a page's blocks (slot, text, mark, kind, linked); known: what is known of its host's slots."""

    def bits(slot: int, text: str, linked: int) -> int:
        return known[slot] if slot in known else LONE | LINKED * (2 * linked > len(text))

    fine = []
    for slot, text, mark, kind, linked in blocks:
        at = bits(slot, text, linked)
        if mark == CERTAIN or (mark != PLAIN and at & (FIXED | LINKED)) or (mark == NAME and at & LONE):
            continue
        fine.append((text, kind, mark == PLAIN and kind > OUTSIDE or not at & (FIXED | LINKED)))
    article, main = (sum(len(t) for t, k, _ in fine if k in kinds) for kinds in ((ARTICLE, MAIN_ARTICLE), (MAIN,)))
    best = (MAIN, MAIN_ARTICLE) if main > article else (ARTICLE, MAIN_ARTICLE) if article else (OUTSIDE,)
    of = [(t, good) for t, k, good in fine if k in best]
    return "\n".join(t for t, good in of if good) or "\n".join(t for t, _ in of)


def _extract(batches):
    @functools.lru_cache(maxsize=512)
    def known_of(text: str) -> dict[int, int]:
        return {int(s): b for s, b in json.loads(text).items()}

    for batch in batches:
        texts = []
        for blocks, slots in zip(batch.column("blocks").to_pylist(), batch.column("slots").to_pylist(), strict=True):
            texts.append(main_text([(b["slot"], b["text"], b["mark"], b["kind"], b["linked"]) for b in blocks], known_of(slots or "{}")))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _host(url: str):
    return F.pandas_udf(lambda s: s.map(host_of), "string")(F.col(url))


def _with_side(rows: DataFrame, side: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with the side's column by keys: a broadcast if the side is small, else a join with keys dealt into parts."""
    if (side.agg(F.sum(F.length(column) + 100)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(side.hint("broadcast"), keys, "left")
    part = F.pmod(F.xxhash64("url", "html" if "html" in rows.columns else "page_id"), F.lit(HOST_PARTS)).cast("int")
    parts = side.withColumn("part", F.explode(F.array(*map(F.lit, range(HOST_PARTS)))))
    return rows.withColumn("part", part).join(parts.hint("merge"), [*keys, "part"], "left").drop("part")


def _classify(nodes: int, batches):
    """Pages of hosts that have several wrappers with their classes; large: they can only have their own."""
    for batch in batches:
        found = [classes_of(folded_tree(parsed(p)[0]), nodes) if many else ("", "", False) for p, many in zip(batch.column("html").to_pylist(), batch.column("many").to_pylist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 3
        kept = ("page_id", "url", "html", "host", "many", "whole")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], [*kept, "outline", "shape", "large"])


def with_kind(rows: DataFrame, wrappers: DataFrame, nodes: int) -> DataFrame:
    """rows (page_id, url, html, host) with the kind of wrapper that is theirs."""
    classes = wrappers.filter("kind != ''")
    if classes.isEmpty():
        return rows.withColumn("kind", F.lit(""))
    hosts = wrappers.groupBy("host").agg(F.max(F.when(F.col("kind") != "", "1")).alias("many"), F.max(F.when(F.col("kind") == "", "1")).alias("whole"))
    told = _with_side(rows, hosts.filter("many is not null"), ["host"], "many")
    told = told.mapInArrow(functools.partial(_classify, nodes), "page_id long, url string, html string, host string, many string, whole string, outline string, shape string, large boolean")
    outlines = classes.filter("kind like 'o%'").select("host", F.col("kind").alias("outline"), F.lit("1").alias("known")).distinct()
    told = _with_side(told, outlines, ["host", "outline"], "known")
    kind = F.when(F.col("many").isNull() | (~F.col("large") & F.col("whole").isNotNull()), "").when(~F.col("large") & F.col("known").isNotNull(), F.col("outline")).otherwise(F.col("shape"))
    return told.select("page_id", "url", "html", "host", kind.alias("kind"))


def extract(pages: DataFrame, wrappers: DataFrame | None = None, page_id="page_id", url="url", html="html", nodes: int = WRAPPER_NODES) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages."""
    wrappers = infer_wrappers(pages, url, html, nodes) if wrappers is None else wrappers
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    short_batches(pages.sparkSession)
    rows = with_kind(rows.withColumn("host", _host("url")), wrappers, nodes)
    schema = f"page_id long, url string, host string, kind string, blocks {_BLOCKS}, digest long, seen array<struct<slot: int, text: long, chars: long, linked: long>>"
    matched = saved(_with_side(rows, wrappers.select("host", "kind", "wrapper"), ["host", "kind"], "wrapper").mapInArrow(_match, schema), "wrappers-matched")
    bits = F.col("lone").cast("int") * LONE + F.col("fixed").cast("int") * FIXED + F.col("linked").cast("int") * LINKED
    slots = slot_statistics(matched).groupBy("host", "kind").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("slot").cast("string"), bits))))).alias("slots"))
    return _with_side(matched.select("page_id", "url", "host", "kind", "blocks"), saved(slots, "wrappers-slots"), ["host", "kind"], "slots").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
