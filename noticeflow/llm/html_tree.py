"""A page as a tree of block elements and its blocks of text with their marks; helper of html_wrappers."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

_RAW = "script|style|noscript|template|iframe|textarea|title"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form fieldset legend details summary address hr center button dialog menu label".split())
#: Elements whose text is never seen; those of FOREIGN may close themselves.
UNSEEN, FOREIGN = frozenset("svg math select datalist object".split()), frozenset(("svg", "math"))
#: What an opening tag closes, and where the search for it stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
_SCOPE = frozenset("html body article main section div td th li blockquote aside nav header footer form figure dd select".split())
#: Elements, roles and words of class or id that mark what isn't main text. The first words mark by
#: themselves wherever they come in a name; the others are a hint that the wrapper confirms.
BOILERPLATE_TAGS = frozenset("head nav footer aside form button dialog".split())
#: In an article or main these are a hint.
FORM_TAGS = frozenset("menu fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog".split())
SURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsored sidebar navbar navigation nav breadcrumb breadcrumbs cookie cookies consent gdpr newsletter comments disqus footer masthead pagination pager".split())
HINT_WORDS = frozenset("banner sponsor promo promotion menu notice alert popup modal overlay subscribe signup login share sharing social related recommended comment reply replies header toolbar widget skip".split())
#: Words that say where or what kind of box something is: in an article or main a name marks by itself only if it has none but
#: these and the words above, as `ad-hoc` or `comments-policy` can be of the text.
BOX_WORDS = frozenset("area bar block body bottom box center col column container content element global holder inner item items js left list main nav outer page panel placeholder primary rail right row secondary section site slot small space sticky thread top unit wide wrap wrapper zone".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: The words that count on article and main, whose classes often tell of their surroundings.
ARTICLE_WORDS = frozenset("ad ads advert advertisement sponsored promo related comment comments reply".split())
#: Marks of a block: nothing; a hint as part of a name; a hint as a whole name; certain.
PLAIN, PART, NAME, CERTAIN = range(4)
#: Where a block is: in neither, in main, in an article, in an article in main.
OUTSIDE, MAIN, ARTICLE, MAIN_ARTICLE = range(1, 5)
DEPTH = 64  # the text of deeper elements counts for the element there; marks hold at any depth


@dataclass(slots=True)
class Node:
    """An element of a page or of a wrapper. many: repeated; maybe: optional; slot: has text of its own."""

    label: str
    kids: list[Node] = field(default_factory=list)
    many: bool = False
    maybe: bool = False
    slot: bool = False


@dataclass(slots=True)
class Block:
    """A piece of text: its element in the tree, how it is marked, whether it is in an article, in main or not, and how many of its characters are in links."""

    node: Node
    text: str
    mark: int
    kind: int
    linked: int


def _looked_at(tag: str, attrs: str, inside: bool) -> tuple[int, str, bool]:
    """(mark, label, role main) of an element."""
    mark = CERTAIN if tag in BOILERPLATE_TAGS or tag in UNSEEN or (tag == "header" and not inside) else PLAIN
    if tag in FORM_TAGS:
        mark = PART if inside else CERTAIN
    label, is_main = tag, False
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in BOILERPLATE_ROLES):
            mark = CERTAIN
        elif name == "role":
            is_main |= value == "main"
        elif name in ("class", "id") and tag not in ("html", "body"):
            names = value.split()
            if name == "class" and names:
                label = f"{tag}.{re.sub('[^a-z]+', '-', names[0])}"
            for one in names:
                words = re.split(r"[^a-z]+", one)
                if tag in CONTENT_TAGS:
                    found = CERTAIN if not ARTICLE_WORDS.isdisjoint(words) else PLAIN
                elif not SURE_WORDS.isdisjoint(words):
                    found = CERTAIN if not inside or all(w in SURE_WORDS or w in HINT_WORDS or w in BOX_WORDS or not w for w in words) else PART
                else:
                    found = NAME if one in HINT_WORDS or HINT_WORDS.issuperset(words) else PART if not HINT_WORDS.isdisjoint(words) else PLAIN
                mark = max(mark, found)
    return mark, label, is_main


def parsed(page: str | None) -> tuple[Node, list[Block]]:
    """The page's tree of block elements and its blocks in page order, without those that are certainly no main text."""
    root, blocks = Node(""), []
    # tag, node, mark, kind, in a link
    stack: list[tuple[str, Node, int, int, bool]] = [("", root, PLAIN, 1, False)]
    opened: dict[str, int] = defaultdict(int)  # how many elements of a tag are open
    depth = [0]
    words: list[str] = []
    linked = [0]
    page = page or ""
    place = 0

    def close_block() -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                _, node, mark, kind, _ = owner[0]
                node.slot = True
                blocks.append(Block(node, text, mark, kind, linked[0]))
        linked[0] = 0

    owner = [stack[0]]

    def say(text: str) -> None:
        at = stack[-1]
        if text and at[2] != CERTAIN:
            if not words:
                if text.isspace():
                    return
                owner[0] = at
            elif at[1:4] != owner[0][1:4] and not text.isspace():
                close_block()
                owner[0] = at
            words.append(html.unescape(text))
            if at[4]:
                linked[0] += len(words[-1])

    def pop(to: int) -> None:
        if any(x[0] in BLOCK for x in stack[to:]):
            close_block()
        for x in stack[to:]:
            depth[0] -= x[0] in BLOCK
            opened[x[0]] -= 1
        del stack[to:]

    for m in _TOKEN.finditer(page):
        say(page[place : m.start()])
        place = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    pop(k)
                    break
                if stack[k][0] in ("td", "th", "table") and tag not in BLOCK:
                    break
            continue
        if tag in VOID:
            if tag in BLOCK:
                close_block()
            elif tag == "br" and words:
                words.append(" ")
            continue
        attrs = m["attrs"]
        if attrs.endswith("/") and tag in FOREIGN:
            continue
        if tag in BLOCK:
            close_block()
            if opened["head"] or opened["select"]:
                pop(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in ("head", "select")))
            for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in _SCOPE:
                    break
            if tag in _CLOSES:
                closed, stop = _CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closed:
                        pop(k)
                        break
                    if stack[k][0] in stop:
                        break
        if tag in ("html", "body") and opened[tag]:
            continue
        opened[tag] += 1
        _, node, above, kind, link = stack[-1]
        mark, label, is_main = _looked_at(tag, attrs, kind > 1)
        if mark != CERTAIN and (tag in CONTENT_TAGS or is_main):
            kind = (ARTICLE if kind in (OUTSIDE, ARTICLE) else MAIN_ARTICLE) if tag == "article" else MAIN if kind == OUTSIDE else kind
            above = CERTAIN if above == CERTAIN else PLAIN  # a hint around the content says nothing about it
        if tag in BLOCK:
            depth[0] += 1
            if depth[0] <= DEPTH:
                node.kids.append(Node(label))
                node = node.kids[-1]
            stack.append((tag, node, max(above, mark), kind, link))
        else:
            stack.append((tag, node, max(above, mark), kind, link or tag == "a"))
    say(page[place:])
    close_block()
    return root, blocks
