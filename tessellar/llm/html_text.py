"""Main text of HTML pages by tag-path ratios.

A page is read as a sequence of text nodes, each with its root-to-leaf tag path.
For every path the text length and the punctuation of its nodes are summed and
divided by their number; both ratios are smoothed over the page's order with
a Gaussian window, fused by multiplication, and a share of the mean and deviation of
the fused ratio is the threshold above which paths are content.  The content's
container is the deepest element that holds all content paths;
the blocks under it are the main text, in page order.  If that is the whole page, its
sections without a content path are left out.  An article or main element is judged like any other.

Elements that are never main text are left out before the ratios: navigation,
headers, footers, sidebars, forms, scripts, styles, and those whose role, class or id says
advert, notice, menu, share, comment or the like.  A class says so by its head noun (``main-sidebar``, ``comment-list``,
not ``has-sidebar`` or ``header-fixed``), and a name alone takes nothing away that holds more than half of the
page's text and its first headline, article or main element: such a wrapper is judged by the ratios like any other.

A page is read in time linear in its length: paths are nodes with their parents, and what an end tag closes is looked up.

Pages are independent, so the work is a ``mapInArrow`` without a shuffle; one page at
a time is in a worker's memory.

Edge cases: null or empty html gives an empty text; broken markup (unclosed or stray tags)
is read with HTML's usual implied ends; a page of a single short block returns it; repeated
rows are each read; extra columns are left out.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import sliced

SCHEMA = "page_id long, url string, text string, n_chars long"

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_ATTRS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
_RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
#: Never main text, with all below.
_OUT = frozenset("head script style noscript iframe nav header footer aside form button select option textarea input template svg canvas object menu dialog title".split())
_BLOCK = frozenset("html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks of text, never the region of a page, and the elements that divide a page.
_LEAF = frozenset("p li td th blockquote pre h1 h2 h3 h4 h5 h6 dd dt".split())
_SECTION = frozenset("article section div main center".split())
#: What a start tag ends when it is open: HTML's implied ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: What the class or id of a menu, header, footer, sidebar, notice, advert, form or reader's comment says; nothing else is left out by name.
_WORDS = frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs pager pagination header masthead footer sidebar sidenav related recommended share sharing social "
    "notice notices notification alert consent cookie cookies gdpr popup modal hidden ad ads adv advert adverts advertisement advertising banner banners promo promoted "
    "sponsor sponsored sponsors newsletter signup subscribe subscription comment comments commentlist disqus reply replies respond".split()
)
#: Words after such a noun that leave it the head, and words before it that deny it.
_PLAIN = frozenset("area bar block body box button buttons container content form group inner item items label left link links list message outer panel right section slot text thread title top bottom unit widget widgets wrap wrapper".split())
_OTHERS = frozenset("article articles news posts stories".split())
_DENIED = frozenset("has have is no non not with without hide show under below above after before toggle".split())
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar note".split())
#: Elements whose first one a name cannot take away, with the wrapper that holds most of the page.
_TITLE = frozenset("h1 article main".split())
_MARKS = re.compile(r"[.,;:!?…。、，！？；：¿¡]")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _says_junk(names: str) -> bool:
    """Whether a class or an id of the list has a junk word as its head noun."""
    for name in _CAMEL.sub("-", names).lower().split():
        parts = [w.rstrip("0123456789") for w in re.split(r"[-_]+", name)]
        parts = [w for w in parts if w]
        if not parts or _DENIED.intersection(parts[:-1]):
            continue
        while len(parts) > 1 and (parts[-1] in _PLAIN or (parts[-1] in _OTHERS and parts[-2] in ("related", "recommended"))):
            parts.pop()
        if parts[-1] in _WORDS:
            return True
    return False


def _junk(tag: str, attrs: str) -> str:
    """``out`` of what is never main text, ``named`` of what a name only says is none, else nothing."""
    if tag in _OUT:
        return "out"
    if not attrs or tag in ("html", "body", "article", "main"):
        return ""
    found = ""
    for m in _ATTRS.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "out"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "out"
        if (name == "role" and value.lower() in _JUNK_ROLES) or (name in ("class", "id") and _says_junk(value)):
            found = "named"
    return found


@dataclass
class Page:
    """Blocks (node of the tag path, named element around it or -1, text) in page order; nodes of tag paths and named elements by their parents."""

    blocks: list[tuple[int, int, str]] = field(default_factory=list)
    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    named: list[int] = field(default_factory=list)
    #: The named element around the page's first headline, article or main element, and whether there is one.
    title: int = -1
    titled: bool = False


class _Open(NamedTuple):
    """An open element: its tag, whether it is left out, its named element, the node of its tag path, and the places of the last block and of the last paragraph that a block ends."""

    tag: str
    out: bool
    named: int
    node: int
    block: int
    p: int


_BARRIER = frozenset("table td th button object".split())
_LISTS = ("ul", "ol", "dl", "table", "select")


def blocks_of(page: str) -> Page:
    """The blocks of text with their tag paths, without what is never main text."""
    out = Page()
    stack = [_Open("", False, -1, 0, 0, 0)]
    places: dict[str, list[int]] = {}
    nodes: dict[tuple[int, str], int] = {}
    parts: list[str] = []
    at = (0, -1)
    pos, end = 0, len(page)

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()

    def flush() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.blocks.append((*at, text))
            parts.clear()

    def text(piece: str) -> None:
        nonlocal at
        if piece and not stack[-1].out:
            if not parts:
                # The root-to-leaf path down to the block; inline elements do not make other paths.
                at = (stack[-1].node, stack[-1].named)
            parts.append(piece)

    while pos < end:
        m = _TAG.search(page, pos)
        if m is None:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = last(tag)
            if not depth or (tag not in _BLOCK and stack[-1].block > depth):
                if tag in _BLOCK:
                    flush()
                continue
            if tag in _BLOCK or stack[-1].block >= depth:
                flush()
            close(depth)
            continue
        if tag in _BLOCK:
            flush()
        if tag in _CLOSES_P and stack[-1].p:
            close(stack[-1].p)
        if tag in _ENDS:
            ended = max(map(last, _ENDS[tag]))
            if ended > max(map(last, _LISTS)):
                close(ended)
        if tag in _VOID:
            text(" " if tag in ("br", "img", "hr") else "")
            continue
        up = stack[-1]
        junk = _junk(tag, m[3])
        if tag in _RAW:
            closing = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = closing.end() if closing else end
            continue
        if (up.out or junk) and parts and tag not in _BLOCK:
            parts.append(" ")
        named = up.named
        if junk == "named" and not up.out:
            named = len(out.named)
            out.named.append(up.named)
        node, place = up.node, len(stack)
        if tag in _BLOCK:
            node = nodes.setdefault((up.node, tag), len(out.tag))
            if node == len(out.tag):
                out.tag.append(tag)
                out.parent.append(up.node)
        if tag in _TITLE and not out.titled and not (up.out or junk == "out"):
            out.titled, out.title = True, named
        places.setdefault(tag, []).append(place)
        stack.append(_Open(tag, up.out or junk == "out", named, node, place if tag in _BLOCK else up.block, place if tag == "p" else 0 if tag in _BARRIER else up.p))
    flush()
    return out


def _kept(page: Page) -> list[tuple[int, str]]:
    """(node, text) of the blocks that no name takes away."""
    own = [0] * len(page.named)
    for _, named, text in page.blocks:
        if named >= 0:
            own[named] += len(text)
    total = sum(len(text) for *_, text in page.blocks)
    outside = total - sum(own)
    for i in range(len(own) - 1, -1, -1):
        if page.named[i] >= 0:
            own[page.named[i]] += own[i]
    around = set()
    i = page.title
    while i >= 0:
        around.add(i)
        i = page.named[i]
    gone = []
    for i, up in enumerate(page.named):
        # Without a title, what is left outside must be little.
        holds = 2 * own[i] > total and (i in around if page.titled else 4 * outside < own[i])
        gone.append((up >= 0 and gone[up]) or not holds)
    return [(node, text) for node, named, text in page.blocks if named < 0 or not gone[named]]


def _smooth(values: list[float], reach: int = 1) -> list[float]:
    kernel = [math.exp(-(d * d) / 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def main_blocks(page: Page, share: float = 0.5) -> list[str]:
    """The main text's blocks: those under the deepest element that holds all content paths."""
    blocks = _kept(page)
    if not blocks:
        return []
    length: dict[int, list[float]] = {}
    for path, text in blocks:
        x = length.setdefault(path, [0.0, 0.0, 0.0])
        x[0] += 1
        x[1] += len(text)
        x[2] += len(_MARKS.findall(text))
    by_length = _smooth([length[p][1] / length[p][0] for p, _ in blocks])
    by_marks = _smooth([length[p][2] / length[p][0] for p, _ in blocks])
    # One is added to the punctuation, so that text without any is not nothing.
    fused = [a * (b + 1) for a, b in zip(by_length, by_marks)]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    bound = share * min(mean, max(mean - spread, 0.25 * mean) + spread)
    score: dict[int, list[float]] = {}
    for (path, _), f in zip(blocks, fused):
        score.setdefault(path, []).append(f)
    content = {p for p, fs in score.items() if sum(fs) / len(fs) >= bound}
    # The deepest element that holds all content; a node comes after its parent.
    tag, parent = page.tag, page.parent
    held = [0] * len(tag)
    for p in content:
        held[p] = 1
    for n in range(len(tag) - 1, 0, -1):
        held[parent[n]] += held[n]
    region = max(n for n in range(len(tag)) if held[n] == len(content))
    while region and tag[region] in _LEAF:
        region = parent[region]
    # The child of the region that each node is or lies in; none outside.
    child = [-1] * len(tag)
    child[region] = region
    for n in range(1, len(tag)):
        if n != region and child[parent[n]] >= 0:
            child[n] = n if parent[n] == region else child[parent[n]]
    # Sections of a whole page that hold no content are beside it; short blocks within an element are part of it.
    whole = tag[region] in ("", "html", "body")
    beside = lambda c: whole and c != region and tag[c] in _SECTION and not held[c]
    return [t for p, t in blocks if child[p] >= 0 and not beside(child[p])]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in sliced(batches):
            texts = ["\n".join(main_blocks(blocks_of(h))) if h else "" for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, SCHEMA)
