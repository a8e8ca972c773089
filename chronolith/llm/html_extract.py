"""Main text of HTML pages by two-pass block rules.

The page is cut into blocks at block-level tags. Text in scripts, styles, forms, menus, headers, footers, sidebars and
the like, or in an element whose class, id or role names such a part, is boilerplate by structure; within a line, such an
element leaves the block around it as it is. First pass: link
density, length and stop-word density class each other block as good, bad, near-good or short. Second pass: near-good and
short blocks take the class of their nearest decided neighbours (good if both sides are good, else near-good blocks need
one good side and short ones the nearer side). Both passes run on every page. An article or main element is one feature:
blocks inside it are classed one step better where their links are few, bear more links, and are decided first, with the
element's edges as good neighbours; structural boilerplate inside it says nothing about its text. Blocks outside are
classed as on any page.

Defined results: a null or empty page has an empty text; character references are decoded, also without a semicolon;
white space in a block becomes one space; blocks are joined in page order by one space; a tag that the page's end cuts
off is markup; of neighbours at equal distance a short block takes the earlier one. Very long pages are read whole. Repeated rows get equal results, an empty table an empty one; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, table, tidied
from .quality import STOP_WORDS

# Elements by role.
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object canvas audio video select".split())
_DROPPED = frozenset("head nav header footer aside form button menu dialog label fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_NAMES = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side|widget|header|masthead|footer|foot|copyright|comments?|commentlist|respond|replies|reply|disqus|"
    r"share|sharing|social|related|recommended|tags|toc|search|toolbar|skip)"
)
_BESIDE = r"(?:site|top|bottom|left|right|main|primary|secondary|global|wrapper|container|list|items?|box|bar|links?|icons?|buttons?|area|slot)"
#: A class token or id: a name, also with words of place or form beside it (main-nav, ad_slot), but not with others (no-sidebar).
_NAMED = re.compile(rf"(?:{_BESIDE}[_-]+)*{_NAMES}(?:[_-]+(?:{_NAMES}|{_BESIDE}))*", re.IGNORECASE)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_STOP = frozenset(STOP_WORDS.split())

#: Production thresholds: characters, stop words per word, linked share of the characters.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS, LINKS_IN_ARTICLE = 70, 200, 0.12, 0.2, 0.3, 0.8

GOOD, NEAR, BRIEF, BAD = "good", "near-good", "short", "bad"
# A tag of these closes an open p; p itself does too.
_P_SCOPE = ("table", "td", "th", "caption", "button", "html")  # none outside of these
_CLOSES_P = _BLOCK - {"br", "body", "html", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}


@dataclass
class Block:
    text: str
    linked: int
    boiler: bool
    article: bool


@dataclass
class _Open:
    tag: str
    boiler: bool
    article: bool
    muted: bool = False  # inside a part of a line that is boilerplate: its text is none of the block's


@dataclass
class _Reader:
    """Cuts a page into blocks."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)  # of the open elements in the stack, by tag
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1] if self.stack else _Open("", False, False)
            self.blocks.append(Block(text, self.linked, top.boiler, top.article))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1].muted):
            decoded = html.unescape(raw)
            self.parts.append(decoded)
            if self.links:
                self.linked += len(decoded.strip())

    def open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self.flush()
        if tag in _CLOSES_P and self._last("p") > max(map(self._last, _P_SCOPE)):
            self.close("p", True)
        if tag == "a":
            self.links = 1
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            return
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.stack and self.stack[-1].tag == tag:
            self.cut(len(self.stack) - 1)
        top = self.stack[-1] if self.stack else _Open("", False, False)
        named = tag not in ("html", "body") and bool(attributes) and _named(attributes, tag not in ("article", "main"))
        boiler = top.boiler or named or tag in _DROPPED
        if tag in _BLOCK or tag in _DROPPED or named:
            muted = top.muted or named and tag not in _BLOCK and tag not in _DROPPED
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append(_Open(tag, top.boiler if muted else boiler, top.article or not muted and tag in ("article", "main"), muted))

    def cut(self, k: int) -> None:
        for o in self.stack[k:]:
            self.places[o.tag].pop()
        del self.stack[k:]

    def close(self, tag: str, implied: bool = False) -> None:
        if tag in _BLOCK:
            self.flush()
        if tag == "a":
            self.links = 0
        k = self._last(tag)
        if k < 0 or tag not in ("article", "main", "body", "html") and k < max(self._last("article"), self._last("main")):
            return  # a stray end tag does not end the article
        self.flush()
        self.cut(k)

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def page(self, source: str) -> list[Block]:
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self.text(source[at:])
                break
            m = _TOKEN.match(source, lt)
            if not m:  # a bare "<"; "<" at the very end or before a name that never ends is handled by the pattern
                self.text(source[at : lt + 1])
                at = lt + 1
                continue
            self.text(source[at:lt])
            at = m.end()
            slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[5], m[6], m[7])
            if not name:
                continue
            tag = name.lower()
            if slash:
                self.close(tag)
            elif tag in _RAW:
                if not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                    at = end.end() if end else n
            else:
                self.open(tag, attributes or "")
        self.flush()
        return self.blocks


def _named(attributes: str, by_name: bool) -> bool:
    """Whether the attributes hide an element, or name a part that is no main text."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if by_name and (name == "role" and value.lower() in _ROLES or name in ("class", "id") and any(_NAMED.fullmatch(x) for x in value.split())):
            return True
    return False


def first_pass(block: Block) -> str:
    """The context-free class of a block."""
    chars, words = len(block.text), block.text.lower().split()
    if block.boiler or block.linked > (LINKS_IN_ARTICLE if block.article else LINKS) * chars:
        return BAD
    raised = block.article and block.linked <= LINKS * chars
    if chars < SHORT:
        if block.linked:
            return BRIEF if raised else BAD
        return NEAR if raised else BRIEF
    density = sum(w.strip(".,;:!?\"'()") in _STOP for w in words) / len(words)
    if density >= STOP_HIGH:
        return GOOD if chars > LONG or raised else NEAR
    if density >= STOP_LOW:
        return GOOD if raised else NEAR
    if raised:  # the stop words are of a few languages
        return NEAR if chars > LONG else BRIEF
    return BAD


def second_pass(classes: list[str]) -> list[bool]:
    """Whether each block is kept, once ambiguous blocks have looked at their nearest decided neighbours."""
    n = len(classes)
    before: list[tuple[str, int]] = []
    last = (BAD, n)
    for k, c in enumerate(classes):
        before.append((last[0], k - last[1] if last[1] < n else n))
        if c in (GOOD, BAD):
            last = (c, k)
    kept, last = [False] * n, (BAD, 2 * n)
    for k in range(n - 1, -1, -1):
        c, (left, near), (right, far) = classes[k], before[k], (last[0], last[1] - k)
        if c in (GOOD, BAD):
            kept[k], last = c == GOOD, (c, k)
        elif left == right:
            kept[k] = left == GOOD
        elif c == NEAR:
            kept[k] = True
        else:
            kept[k] = (left if near <= far else right) == GOOD
    return kept


def main_text(source: str | None) -> str:
    if not source:
        return ""
    blocks = _Reader().page(source)
    classes = [first_pass(b) for b in blocks]
    for inside, run in groupby(range(len(blocks)), lambda k: blocks[k].article):
        if inside:
            own = [k for k in run if not blocks[k].boiler]
            for k, keep in zip(own, second_pass([GOOD, *(classes[k] for k in own), GOOD])[1:-1], strict=True):
                classes[k] = GOOD if keep else BAD
    return " ".join(b.text for b, keep in zip(blocks, second_pass(classes), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(tidied(_extract), f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
