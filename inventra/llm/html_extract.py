"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf path of tags. For every path of the page the text
length and the punctuation of its blocks are summed and divided by the number of blocks; both ratios are smoothed over
page order, fused, and lowered by the share of link text. Blocks of paths above a threshold are content; the content node is the deepest
element that holds nearly all of their weight (an article or main element, if it holds most of it), widened to the article around it and to
parents that add text of such paths or headings. Every block inside the node, short ones, links and headings included, is main text.

Elements that cannot be main text by their tag or role (menus, footers, forms, hidden ones) are no candidates. Class and id names choose
no node: they only keep subtrees that are named as adverts, notices, comments and the like out of the ratios and of the node's text.

Parsing takes time in proportion to the page, however deep it nests: each open element carries what a later tag needs to know of those around it.

Defined cases: null or empty html, and pages without text, give an empty text and 0; unclosed or crossed tags, unclosed
comments and stray '<' are read as browsers do, roughly; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, of raw text, that break a line, and whose end tag may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "xmp", "noembed", "noframes")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q rb ruby rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
#: Subtrees that never are main text, by tag or role.
ASIDE_TAGS = frozenset("head title nav footer aside form button select dialog menu input label fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Class and id names of subtrees inside or beside an article that are no part of it.
_NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist reply replies respond "
    "disqus share sharing social related newsletter subscribe signup login disclaimer"
).split()
_ASIDE_NAME = re.compile(r"(?:^|[\s_-])(?:" + "|".join(_NAMES) + r")(?:$|[\s_-]|\d+(?:$|[\s_-]))", re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:" + "|".join(RAW) + r")(?=[\s/>])(?P<raw>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>",
    re.S | re.I,
)
_RAW_NAME = re.compile(r"<([a-zA-Z]+)")
_PUNCT = re.compile(r"[.,;:!?。，…]")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_LEAVES = _HEADINGS | {"p", "li", "pre", "blockquote", "td", "dd"}
#: Of the largest fused ratio a block must have; of the selected weight the content node must hold, and an article or main element.
THRESHOLD = 0.2
SHARE = 0.9
ARTICLE_SHARE = 0.5
#: Places in an open element's scope: the open p, li, dt or dd, tr, td or th, option, and table section that a later tag may close, and the table fence.
_P, _LI, _D, _ROW, _CELL, _OPT, _SECT, _FENCE = range(8)
_ROOT = (-1,) * 8


class Block(NamedTuple):
    text: str
    path: int
    node: int
    aside: bool
    named: bool
    links: int


class Page(NamedTuple):
    """blocks in order; of every block-level element, numbered in page order, its parent, tag and last descendant."""

    blocks: list[Block]
    parent: list[int]
    tag: list[str]
    last: list[int]


class _Open(NamedTuple):
    tag: str
    node: int
    path: int
    aside: bool
    named: bool
    linked: bool
    article: bool
    scope: tuple[int, ...]


def _judge(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """(no main text by tag or role, named as something beside it)."""
    aside = tag in ASIDE_TAGS or tag == "header" and not in_article
    named = False
    if attrs and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                named = named or tag not in ("article", "main") and bool(_ASIDE_NAME.search(value))
            elif name == "role":
                aside = aside or value.lower() in ASIDE_ROLES
            elif name == "style":
                aside = aside or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            else:
                aside = aside or name == "hidden" or value.lower() == "true"
    return aside, named


def _closed_by(tag: str, scope: tuple[int, ...]) -> int:
    """Place of the outermost open element that the start of this tag ends, or -1."""
    ends = []
    if tag in P_CLOSERS:
        ends.append(scope[_P])
    if tag == "li":
        ends.append(scope[_LI])
    elif tag in ("dt", "dd"):
        ends.append(scope[_D])
    elif tag in ("td", "th"):
        ends.append(scope[_CELL])
    elif tag == "tr":
        ends += scope[_ROW : _CELL + 1]
    elif tag in ("thead", "tbody", "tfoot"):
        ends += [scope[_ROW], scope[_CELL], scope[_SECT]]
    elif tag in ("option", "optgroup"):
        ends.append(scope[_OPT])
    return min((x for x in ends if x >= 0), default=-1)


def _scope(tag: str, at: int, around: tuple[int, ...]) -> tuple[int, ...]:
    """The scope inside an element of this tag that is opened at this place of the stack."""
    if tag in INLINE or tag == "div" or tag == "address":
        return around
    own = list(around)
    if tag == "table":
        own = list(_ROOT)
        own[_FENCE] = at
    elif tag in ("td", "th"):
        own[_P] = own[_LI] = own[_D] = -1
        own[_CELL] = own[_FENCE] = at
    elif tag == "tr":
        own[_ROW], own[_CELL] = at, -1
    elif tag in ("thead", "tbody", "tfoot"):
        own[_SECT], own[_ROW], own[_CELL] = at, -1, -1
    elif tag == "p":
        own[_P] = at
    elif tag == "option":
        own[_OPT] = at
    else:
        own[_LI] = at if tag == "li" else -1
        own[_D] = at if tag in ("dt", "dd") else -1
        if tag in ("button", "object", "select"):
            own[_P] = -1
    return tuple(own)


def parse(page: str) -> Page:
    out = Page([], [-1], [""], [0])
    paths: dict[tuple[int, str], int] = {}
    stack: list[_Open] = []
    base = _Open("", 0, 0, False, False, False, False, _ROOT)
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
    text: list[str] = []
    links = at = 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                top = stack[-1] if stack else base
                out.blocks.append(Block(joined, top.path, top.node, top.aside, top.named, min(links, len(joined))))
            text.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if stack and stack[-1].linked:
                links += len(piece.strip())

    def pop_to(n: int) -> None:
        if any(x.tag not in INLINE for x in stack[n:]):
            flush()
        for x in reversed(stack[n:]):
            places[x.tag].pop()
            if x.tag not in INLINE:
                out.last[x.node] = len(out.parent) - 1
        del stack[n:]

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m["raw"] is not None:
            name = _RAW_NAME.match(page, m.start())[1]
            if not m["raw"].endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else size
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            own = places.get(tag)
            if not own:
                if tag not in INLINE:
                    flush()
            elif tag not in INLINE or own[-1] > stack[-1].scope[_FENCE]:
                pop_to(own[-1])
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in INLINE:
            flush()
            n = _closed_by(tag, stack[-1].scope if stack else _ROOT)
            if n >= 0:
                pop_to(n)
        top = stack[-1] if stack else base
        aside, named = _judge(tag, m["attrs"], top.article)
        node, path = top.node, top.path
        if tag not in INLINE:
            path = paths.setdefault((path, tag), len(paths) + 1)
            node = len(out.parent)
            out.parent.append(top.node)
            out.tag.append(tag)
            out.last.append(node)
        places[tag].append(len(stack))
        stack.append(_Open(tag, node, path, aside or top.aside, named or top.named, tag == "a" or top.linked, tag in ("article", "main") or top.article, _scope(tag, len(stack), top.scope)))
    flush()
    pop_to(0)
    out.last[0] = len(out.parent) - 1
    return out


def _smooth(values: list[float]) -> list[float]:
    n = len(values)
    return [(values[max(0, i - 1)] + 2 * v + values[min(n - 1, i + 1)]) / 4 for i, v in enumerate(values)]


def path_scores(found: list[Block]) -> list[float]:
    """Of each block the fused text and punctuation ratio of its path, smoothed over page order."""
    length: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    linked: dict[int, int] = defaultdict(int)
    nodes: dict[int, int] = defaultdict(int)
    for b in found:
        length[b.path] += len(b.text)
        marks[b.path] += len(_PUNCT.findall(b.text))
        linked[b.path] += b.links
        nodes[b.path] += 1
    by_text = _smooth([length[b.path] / nodes[b.path] for b in found])
    by_marks = _smooth([marks[b.path] / nodes[b.path] for b in found])
    return [t * (1.0 + p) * (1.0 - linked[b.path] / max(1, length[b.path])) ** 2 for b, t, p in zip(found, by_text, by_marks, strict=True)]


def content_node(page: Page, found: list[Block]) -> int:
    """The element that holds the main text, by the scores of the paths; 0 is the whole page."""
    fused = path_scores(found)
    least = THRESHOLD * max(fused)
    n = len(page.parent)
    weight, loose = [0.0] * n, [0.0] * n  # of content, and of text of paths below the threshold that is no heading
    for b, score in zip(found, fused, strict=True):
        if score >= least:
            weight[b.node] += len(b.text) - b.links
        elif page.tag[b.node] not in _HEADINGS:
            loose[b.node] += len(b.text)
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[page.parent[i]] + 1
    for i in range(n - 1, 0, -1):
        weight[page.parent[i]] += weight[i]
        loose[page.parent[i]] += loose[i]
    total = weight[0]
    if not total:
        return 0
    chosen = max((i for i in range(n) if weight[i] >= SHARE * total), key=lambda i: (depth[i], -i))
    articles = [i for i in range(1, n) if page.tag[i] in ("article", "main") and weight[i] >= ARTICLE_SHARE * total]
    if articles:
        deepest = max(articles, key=lambda i: (depth[i], -i))
        if deepest < chosen <= page.last[deepest] or chosen <= deepest <= page.last[chosen]:
            chosen = deepest
    if page.tag[chosen] in _LEAVES:  # a leaf is not a container: its siblings belong to the text
        chosen = page.parent[chosen]
    around = chosen
    while around:
        if page.tag[around] in ("article", "main"):
            chosen = around
        around = page.parent[around]
    while page.tag[chosen] not in ("article", "main", "body", "html", "") and page.tag[page.parent[chosen]] not in ("body", "html", ""):
        up = page.parent[chosen]
        if loose[up] > loose[chosen]:  # the parent adds more than content and headings
            break
        chosen = up
    return chosen


def main_text(page: str | None, names: bool = True) -> str:
    """The main text; without `names`, class and id names are not looked at."""
    if not page:
        return ""
    parsed = parse(page)
    found = [b for b in parsed.blocks if not b.aside and not (names and b.named)]
    if not found:
        return ""
    node = content_node(parsed, found)
    return "\n".join(b.text for b in found if node <= b.node <= parsed.last[node])


def extract(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keys..., text, n_chars) of every page."""
    fields = [f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("_html").to_pylist()]
            cols = [*(b.column(k) for k in keys), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "text", "n_chars"])

    rows = pages.select(*[F.col(k) for k in keys], F.col(html_col).cast("string").alias("_html"))
    return rows.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
