"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; the contiguous
region with the largest sum, found in one linear scan, holds the article. All scores are log odds
learned from labelled pages: those with exactly one outermost article (or else main) element,
where what is inside it and not left out is content and the rest is not.

A word is known by the name of the block around it, whether most words of that block are links,
and where the markup places it: inside the largest article or main element of the page, outside
of it, or on a page without one. Tags have the same features; the borders of the element are
tags of their own. Labelled pages are counted twice, with their markup and as if they had no such
element, so that pages without it have weights too. Rare features lean on their group. There are
fewer than 1,500 features, which bounds what reaches the driver.

Elements that never hold article text (menus, asides, forms, footers, scripts, ...) are left out:
by name, role, or a class or id made only of words for such parts ("site-footer", "related-posts").
A name that also holds another word ("related-work") counts only with structure: most of the
element's words are links, or it holds form controls. Headings are never left out by class or id.
What is left out scores nothing and is dropped inside the region. The header of an article keeps
its headings only.

Defined results: a null or empty page, and one without words, gives an empty text; a page that
breaks off is read as far as it goes; repeated rows give equal texts; an empty table gives no
rows; with no labelled page the weights are START_WORD, START_TAG and, for blocks of links, LINK;
other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factweave.llm.common import bound_batches, steps

# fixed values: names and words of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PHRASING = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br "
    "math semantics mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced mtable mtr mtd".split())
RAW = set("script style textarea title xmp".split())
DROPPED = set("head script style template noscript nav aside footer form iframe svg canvas annotation annotation-xml object audio video select button textarea title dialog menu datalist fieldset legend xmp".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KNOWN = VOID | PHRASING | RAW | DROPPED | HEADINGS | set(
    "html body main article section div header p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption address details summary center hgroup search".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist note".split())
WORDS_OF_CLASSES = set("""ad ads adv advert adverts advertisement advertising adsense adsbox sponsor sponsored sponsors promo promos promotion banner
 sidebar aside rail nav navbar navigation menu breadcrumb breadcrumbs crumbs footer foot cookie cookies consent gdpr privacy notice notices notification
 alert popup modal overlay lightbox newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion
 reactions feedback share sharing social related recommended recommendations pagination pager toolbar widget widgets masthead skip hidden paywall toc""".split())
HEADER_CLASSES = set("header topbar masthead".split())
# words that may stand beside those of WORDS_OF_CLASSES without naming a subject
PLAIN_WORDS = set("""a and area articles at bar block body bottom box btn button buttons by card center col column container content count desktop div for from
 google group head header holder icon icons id in inline inner item items js label large left line link links list main media message mobile module more
 of on or outer page panel policy post posts primary region right row section secondary site slot small static story stories sub text the thread title to
 top unit user users view warning wrap wrapper you""".split())
CONTROLS = set("form input button select textarea iframe".split())
NOT_A_PART = {"has", "with", "no", "is", "not", "without", "js"}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

START_WORD, START_TAG, LINK, LEAST, MOST = 1.0, -1.0, -1.0, 0.05, 6.0
#: sightings that a group's odds count for against a feature's own
LEAN = 10.0


def _noisy(value: str, words: set[str]) -> int:
    """Whether a class or id names something beside the article by its first or last word: 2 if
    it holds nothing but such words, 1 if other words are there too, else 0."""
    most = 0
    for name in value.split():
        parts = [p for p in re.split(r"[^a-z0-9]+", CAMEL.sub("-", name).lower()) if p]
        if parts and parts[0] not in NOT_A_PART and (parts[0] in words or parts[-1] in words):
            if all(p in WORDS_OF_CLASSES or p in HEADER_CLASSES or p in PLAIN_WORDS or p.isdigit() for p in parts):
                return 2
            most = 1
    return most


@dataclass
class Event:
    """A tag (name, closing) or a text (with its words, and those that count); `region` is the
    outermost article or main around it (0: none), `border` whether the tag is that element's own."""

    name: str
    text: str = ""
    closing: bool = False
    dropped: bool = False
    region: int = 0
    n_words: int = 0
    all_words: int = 0
    linked: bool = False
    border: bool = False


@dataclass
class _Open:
    name: str
    state: int  # 0 kept, 1 dropped, 2 only headings kept
    region: int
    block: str
    doubtful: tuple[int, int, int, int] | None = None  # events, words, linked words and controls before it, if its structure decides


@dataclass
class _Reader:
    by_class: bool
    region_name: str
    stack: list[_Open] = field(default_factory=lambda: [_Open("", 0, 0, "body")])
    counts: Counter = field(default_factory=Counter)
    events: list[Event] = field(default_factory=list)
    regions: int = 0
    words: int = 0
    linked: int = 0
    controls: int = 0
    cuts: list[tuple[int, int]] = field(default_factory=list)

    def text(self, raw: str) -> None:
        top, words = self.stack[-1], unescape(raw) if "&" in raw else raw
        dropped, n = top.state > 0, 0 if top.name in RAW else len(words.split())
        self.words += n
        self.linked += n if self.counts["a"] else 0
        self.events.append(Event(top.block, words, dropped=dropped, region=top.region, n_words=0 if dropped else n, all_words=n, linked=self.counts["a"] > 0))

    def _state(self, name: str, attributes: str, parent: _Open) -> int:
        """The state of a new element; -1: kept unless its structure speaks against it."""
        if parent.state == 1 or name in DROPPED:
            return 1
        if parent.state == 2:
            return 0 if name in HEADINGS else 2
        state = 0
        if name == "header":
            state = 2 if parent.region else 1
        if attributes and name not in ("html", "body", "main"):
            given = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
            if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or HIDDEN.search(given.get("style", "")):
                return 1
            if given.get("role", "").lower() in ROLES:
                return 1
            if self.by_class and name not in HEADINGS:
                for key in ("class", "id"):
                    value = given.get(key, "")
                    noisy = 0 if name == "article" and len(value.split()) > 1 else _noisy(value, WORDS_OF_CLASSES)
                    if not parent.region:
                        noisy = max(noisy, _noisy(value, HEADER_CLASSES))
                    if noisy == 2:
                        return 1
                    state = -1 if noisy and not state else state
        return state

    def open(self, name: str, attributes: str, alone: bool) -> None:
        if name not in PHRASING:
            k = len(self.stack) - 1
            while self.stack[k].name in PHRASING:
                k -= 1
            if self.stack[k].name == "p" and name not in VOID:
                self._pop(k)
        parent = self.stack[-1]
        state, region = self._state(name, attributes, parent), parent.region
        doubtful = (len(self.events), self.words, self.linked, self.controls) if state < 0 else None
        state, border = max(state, 0), False
        if name == self.region_name and not region and not state:
            self.regions += 1
            region, border = self.regions, True
        self.controls += name in CONTROLS
        self.events.append(Event(name if name in KNOWN else "other", dropped=state > 0, region=region, border=border))
        if name not in VOID and not alone:
            self.stack.append(_Open(name, state, region, parent.block if name in PHRASING else name if name in KNOWN else "other", doubtful))
            self.counts[name] += 1

    def close(self, name: str) -> None:
        if self.counts[name]:
            k = len(self.stack) - 1
            while self.stack[k].name != name:
                k -= 1
            gone = self.stack[k]
            self._pop(k)
            self.events.append(Event(name if name in KNOWN else "other", closing=True, dropped=gone.state > 0, region=gone.region,
                                     border=gone.region != self.stack[-1].region))
        else:
            self.events.append(Event(name if name in KNOWN else "other", closing=True, dropped=self.stack[-1].state > 0, region=self.stack[-1].region))

    def _pop(self, k: int) -> None:
        for gone in self.stack[k:]:
            self.counts[gone.name] -= 1
            if gone.doubtful:
                first, words, linked, controls = gone.doubtful
                if self.controls > controls or 2 * (self.linked - linked) > self.words - words:
                    self.cuts.append((first, len(self.events)))
        del self.stack[k:]

    def finish(self) -> None:
        """Closes what is open and leaves out the elements whose structure spoke against them."""
        self._pop(1)
        done = 0
        for first, end in sorted(self.cuts):
            for e in self.events[max(first, done) : end]:
                e.dropped, e.n_words = True, 0
            done = max(done, end)


def read_page(html: str, by_class: bool = True) -> tuple[list[Event], int]:
    """The events of a page and the number of its outermost article (or else main) elements."""
    low = html.lower()
    reader = _Reader(by_class, "article" if "<article" in low else "main")
    at, end = 0, len(html)
    while at < end:
        tag = html.find("<", at)
        if tag < 0:
            reader.text(html[at:])
            break
        if tag > at:
            reader.text(html[at:tag])
        if html.startswith("<!--", tag):
            close = html.find("-->", tag + 4)
            at = end if close < 0 else close + 3
            continue
        found = TAG.match(html, tag) or LOOSE_TAG.match(html, tag)
        if not found:
            if html[tag + 1 : tag + 2] in ("!", "?", "/"):
                close = html.find(">", tag)
                at = end if close < 0 else close + 1
            else:
                reader.text("<")
                at = tag + 1
            continue
        at, name = found.end(), found[2].lower()
        if found[1]:
            reader.close(name)
            continue
        reader.open(name, found[3], found[3].endswith("/"))
        if name in RAW:
            close = low.find(f"</{name}", at) if len(low) == end else html.find(f"</{name}", at)
            at = end if close < 0 else close
    reader.finish()
    return reader.events, reader.regions


def link_blocks(events: list[Event]) -> list[bool]:
    """Whether an event belongs to a block whose words are mostly links; a tag that opens a block
    belongs to what follows, one that closes a block to what comes before. Headings are none."""
    flags, start, words, linked = [False] * len(events), 0, 0, 0
    for i in range(len(events) + 1):
        e = events[i] if i < len(events) else None
        if e is not None and (e.text or e.name in PHRASING):
            words += e.all_words
            linked += e.all_words if e.linked and e.name not in HEADINGS else 0
            continue
        if 2 * linked > words:
            flags[start:i] = [True] * (i - start)
            if start and not events[start - 1].closing:
                flags[start - 1] = True
            if e is not None and e.closing:
                flags[i] = True
        start, words, linked = i + 1, 0, 0
    return flags


def largest_region(events: list[Event]) -> int:
    """The outermost article or main with the most words (the first of equals); 0: none has any."""
    words: Counter = Counter()
    for e in events:
        if e.region and e.n_words:
            words[e.region] += e.n_words
    return min(words, key=lambda r: (-words[r], r), default=0)


def features(events: list[Event], marked: bool = True) -> list[str]:
    """The feature of each event: name, "/link" in a block of links, "@in" or "@out" for its place
    on a page with an article or main (not if `marked` is off), "/border" for that element's tags."""
    largest = largest_region(events) if marked else 0
    found = []
    for e, link in zip(events, link_blocks(events)):
        if e.border and marked:
            found.append(e.name + "/border")
        else:
            place = "" if not largest else "@in" if e.region == largest else "@out"
            found.append(e.name + ("/link" if link else "") + place)
    return found


def count_features(html: str) -> Counter:
    """(kind, feature, inside) -> count for a labelled page, else nothing."""
    events, regions = read_page(html)
    counts: Counter = Counter()
    if regions == 1 and largest_region(events):
        for marked in (True, False):
            for e, name in zip(events, features(events, marked)):
                if e.text:
                    counts["word", name, e.region > 0 and not e.dropped] += e.all_words
                elif marked or not e.border:
                    counts["tag", name, e.region > 0 and not e.dropped and not e.border] += 1
    return counts


@dataclass
class Weights:
    """Scores by feature; "*" and a group's ending hold the scores of features never seen."""

    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)


def _group(feature: str) -> str:
    """The ending of a feature: what is left without its name."""
    cut = min((at for at in (feature.find("/"), feature.find("@")) if at >= 0), default=len(feature))
    return feature[cut:]


def _odds(own: dict[tuple[str, bool], int], low: float, high: float) -> dict[str, float]:
    """Log odds of being inside, for each feature and each group, between two bounds."""
    sums: Counter = Counter()
    for (feature, inside), n in own.items():
        sums[_group(feature), inside] += n
        if "/link@" in feature:
            sums["/links", inside] += n

    def share(group: str, prior: float) -> float:
        a, b = sums[group, True], sums[group, False]
        return (a + LEAN * prior) / (a + b + LEAN)

    shares = {g: share(g, 0.5) for g in ("", "@in", "@out", "/border", "/links")}
    for g in ("/link", "/link@in", "/link@out"):
        shares[g] = share(g, shares["/links"])

    def score(inside: float, outside: float, group: str) -> float:
        p = min(max(shares[group], 1e-6), 1 - 1e-6)
        return min(high, max(low, log((inside + LEAN * p) / (outside + LEAN * (1 - p)))))

    found = {"*" + g: score(0, 0, g) for g in shares}
    for feature in {f for f, _ in own}:
        found[feature] = score(own.get((feature, True), 0), own.get((feature, False), 0), _group(feature))
    return found


def learn(pages: DataFrame, html: Column) -> Weights:
    """Log odds of words and tags, counted over all labelled pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for _, texts in steps(batches):
            for text in texts:
                total.update(count_features(text))
        rows = [(kind, name, inside, n) for (kind, name, inside), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))],
                                         names=["kind", "name", "inside", "n"])

    counted = pages.select(html.alias("html")).mapInArrow(run, "kind string, name string, inside boolean, n bigint")
    rows = counted.groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect()  # names of KNOWN by seven endings at most
    if not rows:
        return Weights()
    word, tag = ({(r["name"], r["inside"]): r["n"] for r in rows if r["kind"] == kind} for kind in ("word", "tag"))
    return Weights(_odds(word, LEAST, MOST), _odds(tag, -MOST, -LEAST))


def scores(events: list[Event], weights: Weights) -> list[float]:
    """The score of each event: its words by their weight, or a tag's weight; nothing for what is left out."""
    found = []
    for e, feature in zip(events, features(events)):
        if e.dropped:
            found.append(0.0)
            continue
        table = weights.word if e.text else weights.tag
        weight = table.get(feature)
        if weight is None:
            group = _group(feature)
            weight = table.get("*" + group, START_WORD if e.text else LINK if group.startswith("/link") else START_TAG)
        found.append(e.n_words * weight if e.text else weight)
    return found


def best_region(events: list[Event], weights: Weights) -> tuple[int, int]:
    """The half-open range of events with the largest sum of scores (the first of equals)."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores(events, weights)):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return span


def _blocks(events: list[Event]) -> list[str]:
    found, now = [], []
    for e in events:
        if e.text:
            if not e.dropped:
                now.append(e.text)
        elif e.name == "br":
            now.append(" ")
        elif e.name not in PHRASING and now:
            found.append(" ".join("".join(now).split()))
            now = []
    found.append(" ".join("".join(now).split()))
    return [b for b in found if b]


def main_text(html: str, weights: Weights) -> str:
    """The article's blocks, joined by line feeds."""
    for by_class in (True, False):  # a page whose class names drop everything is read without them
        events, _ = read_page(html, by_class)
        start, end = best_region(events, weights)
        blocks = _blocks(events[start:end])
        if blocks:
            return "\n".join(blocks)
    return ""


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text) for rows with page_id, url and html."""
    bound_batches(pages.sparkSession)
    weights = weights or learn(pages, F.col("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, htmls in steps(batches, 2):
            texts = [main_text(h, weights) for h in htmls]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id bigint, url string, text string")
