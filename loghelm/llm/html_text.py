"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block tags. The first pass decides a block from what it stands in (navigation, footers,
adverts, comments and the like are out), its length, the density of function words and the share of link text. Where no
list of function words fits - another script, or a page whose long blocks hold few of them - length and punctuation
decide instead. Short blocks, and those between the limits, stay open; in the second pass they take the label of the
nearest decided block on either side, and the better one where the sides disagree and the block is promising.

Reading is linear in the page: no expression reads on from a tag that isn't closed, and open elements are counted by name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import by_bytes
from loghelm.llm.words import FUNCTION_WORDS

#: Lengths in characters under which a block is short, and from which it can be good by itself.
SHORT, LONG = 70, 200
#: Shares of function words from which a block is promising, and good.
FEW_FUNCTION_WORDS, MANY_FUNCTION_WORDS = 0.12, 0.22
#: Share of characters in links above which a block is out.
LINKED = 0.33

#: Attributes up to a tag's end. An open < outside quotes ends the search.
_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
#: Left out before tags are read. Only comments, CDATA, scripts and styles go to the end of the page where their end is
#: missing; titles and text fields, whose tags are text, go where their end tag comes before another one begins.
_DROPPED = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*+>|\Z)"
    rf"|<(title|textarea|iframe)(?=[\s/>]){_ATTRIBUTES}(?<!/)>(?:(?!<\2[\s/>]).)*?</\2\s*+>",
    re.S | re.I,
)
#: Left out where their own end tag closes them; without it only the tag is. A head ends at the first thing that can't
#: stand in it.
_DROPPED_TAGS = frozenset("noscript template svg math head title select textarea button iframe object canvas audio video".split())
_HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/<>]*+)({_ATTRIBUTES})>|<[!?/][^<>]*+>")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr input label".split()
)
#: In a class or id, the words from here to the next space say what the element has or lacks, not what it is.
_HAS = re.compile(r"(?<![a-z])(?:has|have|no|with|without|hide|show)[-_]\S*")
_OUT_TAGS = frozenset("nav footer aside form menu dialog header".split())
_MAIN_TAGS = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY_BLOCK = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu"
    " menubar breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead topbar cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social"
    " related recommended comment comments disqus replies reply respond reaction reactions complementary contentinfo"
    " toolbar pagination pager tags copyright legal".split()
)
#: Of these, what a reader wrote, what sells or asks, and what points elsewhere is never the article, however long.
_NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe"
    " subscription related recommended comment comments disqus replies reply respond reaction reactions".split()
)
_MAIN_NAMES = frozenset("article main content post entry story maincontent articlebody".split())
#: Last words of a name that say how an element is laid out, or how many there are; the word before them names it.
_LAYOUT = frozenset(
    "area wrapper wrap container list section box block left right top bottom inner outer links items item posts articles"
    " stories bar row col column panel group buttons icons widgets text body region holder".split()
)
_FUNCTION_WORDS = frozenset().union(*map(frozenset, FUNCTION_WORDS.values()))
#: Share of function words in the long blocks of a page from which one of the lists fits it.
FITS = 0.06
_PUNCTUATION = ".,;:!?\"'()[]"
#: Marks that sentences have in any script.
_SENTENCE = re.compile("[.,;:!?\u0589\u05c3\u060c\u061b\u061f\u06d4\u0964\u0965\u104a\u104b\u1362\u17d4\u2026\u3001\u3002\uff01\uff0c\uff0e\uff1f\uff61]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Scripts that set no blanks between words; a character counts as three.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def role(value: str) -> tuple[bool, bool, bool]:
    """Of a value of class, id or role (one name, in lower case): whether it names the article, a part that is none, and
    one that never is. The whole name counts, or its last word once words of layout are taken off."""
    if value in _MAIN_NAMES or value in _OUT_NAMES:
        return value in _MAIN_NAMES, value in _OUT_NAMES, value in _NEVER
    words = [word for word in re.split(r"[^a-z]+", value) if word]
    while len(words) > 1 and words[-1] in _LAYOUT:
        words.pop()
    if not words:
        return False, False, False
    if words[-1] in _MAIN_NAMES:  # but what a comment or a sidebar holds is no article
        others = _OUT_NAMES.intersection(words)
        return not others, bool(others), bool(others & _NEVER)
    return False, words[-1] in _OUT_NAMES, words[-1] in _NEVER


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    out: bool  # stands in a part of the page that isn't the article
    main: bool  # stands in the article
    heading: bool = False
    wrap: int = 0  # the innermost part that is out only by its class or id
    inner: bool = False  # stands in an article or main element inside that part
    good: bool | None = None
    promising: bool = False

    def size(self) -> int:
        """Length in characters, as a script with blanks would have it."""
        return len(self.text) + 2 * sum(map(len, _DENSE.findall(self.text)))


class Place(NamedTuple):
    """An open element: what blocks in it get, and for an element to leave out what to go back to."""

    name: str = ""
    out: bool = False
    main: bool = False
    wrap: int = 0
    inner: bool = False
    saved: tuple | None = None


class Reader:
    """Reads a page tag by tag. ``found``: its blocks in page order, those without text left out."""

    def __init__(self, page: str):
        self.found: list[Block] = []
        self.stack, self.open = [Place()], Counter()
        self.outer, self.never = [0], [False]  # of each part that is out by a name: the one around it, and whether it stays out
        self.pieces: list[str] = []
        self.linked, self.in_link, self.heading = 0, False, False
        page = _CUT_TAG.sub("", _DROPPED.sub(" ", page))
        at = 0
        for tag in _TAG.finditer(page):
            self.text(page[at : tag.start()])
            at = tag.end()
            if tag[2] is not None:
                self.tag(tag[2].lower(), bool(tag[1]), tag[3])
        self.text(page[at:])
        self.close()
        unwrap(self.found, self.outer, self.never)

    def text(self, piece: str) -> None:
        if piece:
            if self.stack[-1].name == "head" and not piece.isspace():
                self.leave_out("head")
            self.pieces.append(piece)
            self.linked += len(piece) if self.in_link else 0

    def close(self) -> None:
        """End the block."""
        text = " ".join(html.unescape("".join(self.pieces)).split())
        if text:
            top = self.stack[-1]
            self.found.append(Block(text, self.linked, top.out, top.main, self.heading, top.wrap, top.inner))
        self.pieces, self.linked = [], 0

    def push(self, place: Place) -> None:
        self.stack.append(place)
        self.open[place.name] += 1

    def pop_to(self, name: str) -> Place | None:
        """End the innermost element of this name and all in it."""
        if not self.open[name]:
            return None
        while True:
            place = self.stack.pop()
            self.open[place.name] -= 1
            if place.name == name:
                return place

    def leave_out(self, name: str) -> None:
        """End the innermost element of this name, and forget what was found in it."""
        if place := self.pop_to(name):
            blocks_before, self.pieces, pieces_before, self.linked, self.in_link, self.heading = place.saved
            del self.found[blocks_before:], self.pieces[pieces_before:]
            self.pieces.append(" ")

    def tag(self, name: str, end: bool, attributes: str) -> None:
        if not end and (name == "body" or self.stack[-1].name == "head" and name not in _HEAD_TAGS):
            self.leave_out("head")
        if name in _DROPPED_TAGS:
            if end:
                self.leave_out(name)
            elif not attributes.endswith("/"):
                saved = len(self.found), self.pieces, len(self.pieces), self.linked, self.in_link, self.heading
                self.push(self.stack[-1]._replace(name=name, saved=saved))
        elif name in _INLINE:
            self.in_link = name == "a" and not end or self.in_link and name != "a"
            if name in ("br", "img"):
                self.pieces.append(" ")
        else:
            self.close()
            self.in_link = False
            if end:
                self.pop_to(name)
                self.heading = False
            else:
                self.heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
                if name not in _VOID and not attributes.endswith("/"):
                    self.begin(name, attributes)

    def begin(self, name: str, attributes: str) -> None:
        """A block element opens."""
        if self.stack[-1].name in _CLOSED_BY_BLOCK and self.stack[-1].name not in ("td", "th", "li", "dd"):
            self.pop_to(self.stack[-1].name)
        _, out, main, wrap, inner, _ = self.stack[-1]
        values = (_HAS.sub("", (m[1] or m[2] or m[3] or "").lower()) for m in _NAMED.finditer(attributes))
        roles = [role(word) for value in values for word in value.split()]
        named_main, named_out, never = (any(flags) for flags in zip(*roles)) if roles else (False, False, False)
        if name in _MAIN_TAGS or named_main:
            main = not out
            inner = inner or wrap > 0 and name in _MAIN_TAGS and (named_main or not named_out)
        elif name in _OUT_TAGS and not (name == "header" and (main or inner)):
            out, main, wrap, inner = True, False, 0, False
        elif named_out and name not in ("body", "html"):
            if not out or wrap:
                self.outer.append(wrap)
                self.never.append(never or self.never[wrap])
                wrap = len(self.outer) - 1
            out, main, inner = True, False, False
        self.push(Place(name, out, main, wrap, inner))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order, those without text left out."""
    return Reader(page).found


def unwrap(found: list[Block], outer: list[int], never: list[bool]) -> None:
    """Parts that are out only by a class or id are wrappers, and not out, where they hold article or main elements with
    more text than all that is left of the page without them, as a column with related articles does not. Of parts in
    each other only those around the outermost such elements are. On a page without such elements the part that holds
    over two thirds of the text is a wrapper, unless its name rules that out."""
    depth = [0] * len(outer)
    for wrap in range(1, len(outer)):
        depth[wrap] = depth[outer[wrap]] + 1
    plain = [b for b in found if b.linked <= LINKED * len(b.text)]
    marked = any(b.main for b in found)
    left = sum(len(b.text) for b in plain if (b.main if marked else not b.out))
    least = min((depth[b.wrap] for b in found if b.inner), default=0)
    held = [b for b in found if b.inner and depth[b.wrap] == least]
    wrappers = set()
    if sum(len(b.text) for b in held) > left:
        wrappers = {b.wrap for b in held}
    elif not marked and not held:
        holds = Counter()
        for b in plain:
            if b.wrap and not never[b.wrap]:
                holds[b.wrap] += len(b.text)
        if holds:
            most = max(holds, key=lambda wrap: (holds[wrap], -wrap))
            wrappers = {most} if holds[most] > 2 * (left + sum(holds.values()) - holds[most]) else set()
    around = set()
    for wrap in wrappers:
        while wrap and wrap not in around:
            around.add(wrap)
            wrap = outer[wrap]
    for b in found:
        if b.wrap in around:
            b.out, b.main = False, b.inner


def _words(text: str) -> list[str]:
    return [w.strip(_PUNCTUATION) for w in text.lower().split()]


def _latin(text: str) -> bool:
    """Whether most letters are Latin ones. The lists of function words are of such languages."""
    letters = sum(map(len, _LETTERS.findall(text)))
    return 2 * sum(map(len, _LATIN.findall(text))) >= letters


def _list_fits(found: list[Block]) -> bool:
    """Whether a list of function words fits the longer plain blocks of a page."""
    words = hits = 0
    for b in found:
        if not b.out and b.linked <= LINKED * len(b.text) and len(b.text) >= SHORT and _latin(b.text):
            own = _words(b.text)
            words += len(own)
            hits += sum(w in _FUNCTION_WORDS for w in own)
    return hits >= FITS * words


def first_pass(found: list[Block]) -> None:
    """Set ``good`` where the block itself decides, and ``promising`` where it leaves it open but leans to good."""
    whole = any(b.main for b in found)
    fits = not whole and _list_fits(found)
    for b in found:
        length, links = b.size(), b.linked / len(b.text)
        if b.out or links > LINKED and (not b.main or links > 0.9 and length < LONG):
            b.good = False
        elif b.main:
            # Inside a marked article only what looks like a list of links is left out.
            b.good, b.promising = (True if length >= SHORT or b.heading else None), True
        elif whole:
            b.good = False
        elif length < SHORT:
            b.promising = b.heading
        elif fits and _latin(b.text):
            words = _words(b.text)
            density = sum(w in _FUNCTION_WORDS for w in words) / len(words)
            if density >= MANY_FUNCTION_WORDS or length >= LONG and density >= FEW_FUNCTION_WORDS:
                b.good = True
            elif density < FEW_FUNCTION_WORDS and length < LONG:
                b.good = False
            else:
                b.promising = True
        else:
            marks = len(_SENTENCE.findall(b.text))
            if length >= LONG and marks:
                b.good = True
            elif not marks and length < LONG:
                b.good = False
            else:
                b.promising = True


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearest decided block. Where both sides are as near and disagree, or a side is
    missing, a promising block is good if either is; on a page without good blocks promising ones are good."""
    decided = [b.good for b in found]
    before: list[int | None] = []
    last = None
    for i, good in enumerate(decided):
        last = i if good is not None else last
        before.append(last)
    after: list[int | None] = [None] * len(found)
    last = None
    for i in range(len(found) - 1, -1, -1):
        last = i if decided[i] is not None else last
        after[i] = last
    for i, b in enumerate(found):
        if b.good is None:
            near = [j for j in (before[i], after[i]) if j is not None]
            if b.promising:
                b.good = not near or b.main or any(decided[j] for j in near) or b.size() >= SHORT and not any(decided)
            else:
                least = min((abs(j - i) for j in near), default=0)
                b.good = bool(near) and all(decided[j] for j in near if abs(j - i) == least)


def main_text(page: str) -> str:
    found = blocks(page)
    first_pass(found)
    second_pass(found)
    return " ".join(b.text for b in found if b.good)


def extract_main_text(pages: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each page, "" where it has none.

    A null page counts as empty. Pages are judged one by one, so repeated rows get equal texts; pages of any length are
    read whole. A column called ``name`` is replaced.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [part["html"].fillna("").map(main_text) for part in by_bytes([batch.to_frame("html")], "html")]
            yield pd.concat(parts) if parts else batch

    return pages.withColumn(name, texts(F.col(html_column)))


def op7_html_text(pages: DataFrame) -> DataFrame:
    out = extract_main_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
