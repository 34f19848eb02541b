"""Main text of web pages by two passes over blocks.

A page is cut into blocks at block-level tags. In the first pass each block is decided on its own: link density, length and
stop-word density make it good or bad, or leave it open ("short", "neargood"). In the second pass open blocks inherit the
label of the nearest decided neighbours. Marks in the page shift this. Menus, headers, footers, sidebars, forms, notices, adverts and comment threads
(elements, or names of a class, id or role that say nothing else) are bad. Within an article element the thresholds are lower, and where the
articles hold at least as much good text as the rest of the page, the rest is bad, the article's blocks have no neighbours outside it or in boilerplate, and an open one needs
two bad neighbours to be bad; where they hold less (teasers, comment cards), the articles count for nothing. Where most of the long text outside links
reaches no stop-word density, the lists are not for the page's language, and link density and length decide alone.

Defined results: a null page has empty text; tags that never close end with the element around them, a link that never closes with its block, and an
unclosed script, style or comment runs to the end of the page; a tag with a stray quote ends at the next ">"; a head ends at the first element or text that can't stand in one; a button, picture or other
element whose text is skipped ends with its parent, and where it never closes, at the next block; an unclosed title, frame or text area holds nothing; character references are decoded once; two line breaks in a row divide blocks, a single one is
white space; equal densities on both sides count for the article; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored; nothing is dropped or cut for its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with would you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "aber als am auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind so und von war was wie wir zu zum zur "
    "al como con del el ella en entre es esta este fue ha la las lo los más me mi muy no o para pero por que se si sin sobre su sus también un una y ya".split()
)
# Elements that divide blocks, that hold no text of their own, and that hold boilerplate.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = "script|style|iframe|textarea|title"  # no elements inside
SKIPPED = frozenset("noscript template svg math object canvas select button".split())
HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of a class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disclaimer disqus footer form gdpr header legal login menu masthead "
    "modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget complementary contentinfo".split()
)
# Words that say nothing beside such a mark, and those that name the article itself beside "header".
GENERIC = frozenset(
    "a about all area bar bars block blocks body bottom box btn button buttons center col column columns content container count desktop element external fixed float footer for form global group has head hidden icon icons inner "
    "inline is item items js layout left link links list lists main middle mobile module more my of on outer panel page pages policy post posts article articles entry entries story stories primary right row second secondary section side site "
    "slot small source span spot sticky tertiary text the third title top unit us user users view website wide widgets wrap wrapper".split()
)
OWN = frozenset("article entry post story".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][a-z0-9:-]*)(?=[\s/>])([^<>]*)>|<[!?][^>]*>|</[^>]*>",
    re.S | re.I,
)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in [*RAW.split("|"), *SKIPPED]}
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)

LINKS_MOST, SHORT, LONG, STOPS_SOME, STOPS_LOW, STOPS_HIGH, REACH = 0.33, 70, 200, 0.15, 0.30, 0.32, 200


@dataclass(slots=True)
class Block:
    text: str
    linked: int  #: characters in links
    article: bool
    boilerplate: bool
    heading: bool
    label: str = ""
    stops: float = -1.0  #: share of stop words, once counted


def _marked(attributes: str) -> bool:
    """Whether a class, id or role is the name of boilerplate: a mark beside words that say nothing."""
    for m in _MARKED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            said = [w.lower() for w in _SPLIT.split(name) if w]
            marks = MARKS.intersection(said)
            if marks and all(w in MARKS or w in GENERIC or not w.isalpha() for w in said) and not (marks <= {"header"} and OWN.intersection(said)):
                return True
    return False


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []  # element, boilerplate from here on, article from here on
    parts: list[str] = []
    links: list[str] = []
    breaks = 0
    in_link = spans = False  # in a link; in one that closes, which may hold blocks
    in_head = False
    path: list[str] = []  # all elements that are open, and how often each
    depth: Counter[str] = Counter()
    skip: list[str] = []  # the skipped element that is open and what is open in it
    open_head = False
    ends: dict[str, int] = {}

    def close_at(name: str, at: int) -> re.Match | None:
        """The next closing tag of ``name``; that there is none is remembered."""
        if ends.get(name) == -1:
            return None
        found = _CLOSE[name].search(html, at)
        if found is None:
            ends[name] = -1
        return found

    def end() -> None:
        nonlocal in_head
        text = " ".join(unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(unescape("".join(links)).split()))
            out.append(Block(text, linked, bool(open_) and open_[-1][2], bool(open_) and open_[-1][1], in_head))
        parts.clear()
        links.clear()

    def say(text: str) -> None:
        nonlocal breaks, open_head
        if open_head and not skip and text and not text.isspace():
            open_head = False
        if text and not skip:
            parts.append(text)
            if in_link:
                links.append(text)
            if not text.isspace():
                breaks = 0

    last = 0
    while m := _TOKEN.search(html, last):
        say(html[last : m.start()])
        last = m.end()
        if m[1]:  # what it holds is skipped
            raw = m[1].lower()
            if open_head and raw not in HEAD:
                open_head = False
            done = close_at(raw, last)
            if done:
                last = done.end()
            elif raw in ("script", "style"):
                last = len(html)
            elif raw == "title":  # without an end: its text, to the next tag
                last = at if (at := html.find("<", last)) >= 0 else len(html)
            if not open_head:
                say(" ")
                if raw == "title" and not skip:
                    end()
            continue
        name, closes, attributes = (m[3], bool(m[2]), m[4]) if m[3] else (m[6], bool(m[5]), m[7])
        if not name:
            if m[0][:9] == "<![CDATA[" and not skip:
                say(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if skip:
            if closes:
                if name in skip:
                    del skip[len(skip) - 1 - skip[::-1].index(name) :]
                    continue
                if not depth[name]:
                    continue
                skip.clear()  # its parent ends
            elif (name in BLOCKS or name == "body") and "foreignobject" not in skip and (skip[0] in ("svg", "math") or (name not in ("option", "optgroup") and not close_at(skip[0], last))):
                skip.clear()
            else:
                if name not in VOID and not attributes.endswith("/"):
                    skip.append(name)
                continue
        if name == "head" or (open_head and (name not in HEAD or closes)):
            open_head = name == "head" and not closes
        if not closes and name in SKIPPED:
            if not open_head:
                say(" ")
            if not (name in ("svg", "math") and attributes.endswith("/")):
                skip.append(name)
            continue
        if closes:
            while depth[name]:
                depth[path[-1]] -= 1
                if path.pop() == name:
                    break
        elif name not in VOID:
            path.append(name)
            depth[name] += 1
        if name == "br":
            breaks += 1
            say(" ")
            if breaks > 1:
                end()
            continue
        block = name in BLOCKS
        if block:
            end()
            breaks = 0
            in_link = in_link and spans
        if name in HEADINGS:
            in_head = not closes
        if name == "a":
            in_link = not closes
            if in_link:
                then = _ANCHOR.search(html, last)
                spans = bool(then and then[1])
        if closes:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if at is not None:
                del open_[at:]
        elif name not in VOID and (block or (attributes and _marked(attributes))):
            bad, article = open_[-1][1:] if open_ else (False, False)
            starts = name in ("article", "main")
            if name == "p" and open_ and open_[-1][0] == "p":  # a paragraph ends the one before it
                open_.pop()
                bad, article = open_[-1][1:] if open_ else (False, False)
            # an article's own header holds its title
            open_.append((name, bad or (name in BOILERPLATE and not (name == "header" and article)) or (name not in ("body", "html", "article", "main") and bool(attributes) and _marked(attributes)), article or starts))
    say(html[last:])
    end()
    return out


def _size(b: Block) -> int:
    """Characters, those of scripts without spaces between words threefold."""
    return len(b.text) + (0 if b.text.isascii() else 2 * len(_DENSE.findall(b.text)))


def _stops(b: Block) -> float:
    if b.stops < 0:
        words = _WORD.findall(b.text.lower())
        b.stops = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
    return b.stops


def _listed(found: list[Block]) -> bool:
    """Whether the stop words are of the page's language: half of its long text outside links and marks has their density."""
    size = known = 0
    for b in found:
        if not b.boilerplate and not b.heading and b.linked <= LINKS_MOST * len(b.text) and _size(b) >= SHORT:
            size += len(b.text)
            known += len(b.text) if _stops(b) >= STOPS_LOW else 0
    return 2 * known >= size


def _alone(b: Block, listed: bool) -> str:
    ease = 0.5 if b.article else 1.0  # an article's blocks pass with half of each density and length
    if b.boilerplate or b.linked > LINKS_MOST / ease * len(b.text):
        return "bad"
    n = _size(b)
    if b.heading:
        return "short"
    if n < SHORT * ease:
        return "bad" if b.linked and not b.article else "short"
    stops = _stops(b) if listed else 1.0
    if stops >= STOPS_HIGH * ease:
        return "good" if n > LONG * ease else "neargood"
    if stops >= STOPS_LOW * ease:
        return "neargood"
    return "short" if stops >= STOPS_SOME * ease or b.article else "bad"  # dense prose counts as its neighbours do


def _nearest(labels: list[str]) -> tuple[list, list]:
    """The nearest decided label before and after each; those of "out" don't count."""
    sides = []
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        at, seen = [None] * len(labels), None
        for i in order:
            at[i] = seen
            seen = labels[i] if labels[i] in ("good", "bad") else seen
        sides.append(at)
    return sides[0], sides[1]


def classify(found: list[Block]) -> list[Block]:
    """Both passes; every label ends as good or bad."""
    listed = _listed(found)
    first = [_alone(b, listed) for b in found]
    mass = [0, 0]
    for b, x in zip(found, first, strict=True):
        mass[b.article] += len(b.text) * (x in ("good", "neargood"))
    trusted = any(b.article and x != "bad" for b, x in zip(found, first, strict=True)) and mass[1] >= mass[0]
    if trusted:
        first = [x if b.article and not b.boilerplate else "out" for b, x in zip(found, first, strict=True)]
    elif any(b.article for b in found):
        for b in found:
            b.article = False
        first = [_alone(b, listed) for b in found]
    for b, x, p, q in zip(found, first, *_nearest(first), strict=True):
        if x == "out":
            b.label = "bad"
        elif x == "neargood" or (x == "short" and trusted):  # both sides must speak against it
            b.label = "bad" if p == q == "bad" else "good"
        elif x == "short":  # both sides must speak for it; at the edge of a page one
            b.label = "good" if {p, q} - {None} == {"good"} or (b.heading and q == "good") else "bad"
        else:
            b.label = x
    if not any(b.label == "good" for b in found):  # nothing was decided for: what is left open stands
        for b, x in zip(found, first, strict=True):
            if x in ("short", "neargood"):
                b.label = "good"
    return found


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks(html or "")) if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                text = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long")
