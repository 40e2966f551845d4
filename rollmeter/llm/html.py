"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and texts.  Each text belongs to the path
of open elements from the root.  For every path the lengths, punctuation,
link texts and elements are summed to a text-to-tag and a punctuation-to-tag
ratio.  Ratios are smoothed with those of the paths beside them: the other
texts of the nearest container that has some, the less the further up it is.
The two are fused by their geometric mean, and paths below SHARE of the fused
value that the page's typical character has are no content.  Of the others,
those in the article are kept: in <article> or <main> if one has content,
else in the deepest container with most of it.  Elements that are no article text by
name (navigation, forms, scripts, ...) or by class, id or role are never
content, nor are paths of mostly links.

Paths are numbered, a path by its parent's number and its step, and open
elements are found by name, so time and memory grow with the page's length
even for pages of unclosed tags.

Defined results: null, empty and tag-free html give their text or nothing;
repeated rows give equal texts; a tag or comment cut off by the end of the
page is dropped; a quote delimits an attribute's value only behind its equals
sign; svg and math that end in "/>" are empty; of svg, math, template and
noscript without an end tag only the tag is dropped; character references are
decoded once; white space within a block becomes one space; blocks follow each
other in page order; paths exactly at the threshold are kept; an empty table
gives an empty one; columns named text or n_chars are replaced.  Html is never
cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_pass
from .textcore import chunks, clean

SHARE = 0.1  # of the fused value of the page's typical character
LINKS = 0.6  # share of link text from which a path is a menu
SMOOTH, DECAY = 0.3, 0.7  # share of the neighbours' ratios, and what is left of it one container further up
MOST = 0.7  # share of the content that the article's container holds

# Element names of the HTML standard, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math noembed noframes xmp".split())
MARKUP = frozenset("svg math template noscript".split())  # of RAW: no raw text in HTML, so that an end tag may be missing
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
NOT_ARTICLE = frozenset("nav header footer aside form button select option input menu dialog fieldset label head object canvas audio video search".split()) | RAW
CLOSES = {  # a start tag ends an open element of these names, up to one of the stops
    **{t: (frozenset({"p"}), frozenset({"table", "button"})) for t in BLOCK - {"html", "body", "head", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend", "figcaption", "summary"}},
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|side-?bar\w*|menus?|nav\w*|navbar|breadcrumbs?|footer|header|masthead|comments?|disqus\w*|repl(?:y|ies)|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|overlay|newsletter|subscri\w*|signup|login|shar(?:e|ing)|social|related|recommend\w*|trending|popular|widgets?|tags|toolbar|pagination|pager|copyright|skip-?link|toc)(?=$|[\s_-])"
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*+(?:>|$)|</[^A-Za-z][^>]*+(?:>|$)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")


@dataclass(slots=True)
class Path:
    parent: int  # number of the path above; of the root's -1
    tag: str
    dead: bool
    length: int = 0
    points: int = 0
    links: int = 0
    tags: int = 0


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def _label(tag: str, source: str) -> tuple[str, bool]:
    """(name of a path step, whether it is no article text)."""
    if not source.strip(" /"):
        return tag, tag in NOT_ARTICLE
    at = _attributes(source)
    marks = f"{at.get('class', '')} {at.get('id', '')}".strip().lower()
    hidden = "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "")
    dead = tag in NOT_ARTICLE or hidden or at.get("role", "").lower() in ROLES or tag not in ("html", "body", "main", "article") and bool(HINTS.search(marks))
    return f"{tag}.{marks}" if marks else tag, dead


class Page:
    """The paths of a page, parents first, and its blocks of text in page order, each with its path's number."""

    def __init__(self, html: str):
        self.paths, self.blocks = [Path(-1, "", False)], []
        self._number: dict[tuple[int, str], int] = {}
        self._open: list[tuple[str, int]] = []  # open elements with their paths
        self._places: dict[str, list[int]] = defaultdict(list)  # where in _open the elements of a name are
        self._block_places: list[int] = []
        self._pieces: list[str] = []
        self._links, self._linked = 0, 0  # open links; link characters of the open block
        self._read(html)

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            self._pieces.clear()
            if text:
                number = self._open[self._block_places[-1]][1] if self._block_places else 0
                at = self.paths[number]
                at.length += len(text)
                at.points += len(PUNCTUATION.findall(text))
                at.links += min(self._linked, len(text))
                self.blocks.append((number, text))
        self._linked = 0

    def _add(self, text: str) -> None:
        if text:
            text = unescape(text)
            self._pieces.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _enter(self, tag: str, source: str) -> None:
        step, dead = _label(tag, source)
        parent = self._open[-1][1] if self._open else 0
        number = self._number.setdefault((parent, step), len(self.paths))
        if number == len(self.paths):
            self.paths.append(Path(parent, tag, dead or self.paths[parent].dead))
        self.paths[number].tags += 1
        self._places[tag].append(len(self._open))
        if tag in BLOCK:
            self._block_places.append(len(self._open))
        self._open.append((tag, number))
        self._links += tag == "a"

    def _close(self, depth: int) -> None:
        """Ends the open elements from this depth on."""
        if self._block_places and self._block_places[-1] >= depth:
            self._flush()
        while len(self._open) > depth:
            tag, _ = self._open.pop()
            self._places[tag].pop()
            if tag in BLOCK:
                self._block_places.pop()
            self._links -= tag == "a"

    def _implied_end(self, tag: str) -> None:
        """A start tag ends open elements that may not hold it."""
        ends, stops = CLOSES.get(tag, ((), ()))
        if any(self._places[t] for t in ends):
            stop = max((self._places[t][-1] for t in stops if self._places[t]), default=-1)
            found = [at[k] for t in ends if (k := bisect_right(at := self._places[t], stop)) < len(at)]
            if found:
                self._close(min(found))

    def _read(self, html: str) -> None:
        at, n, no_end = 0, len(html), set()
        while at < n:
            m = TOKEN.search(html, at)
            if m is None:
                self._add(html[at:])
                break
            self._add(html[at : m.start()])
            at = m.end()
            if m[2] is None or not m[4]:  # a comment or declaration; a tag cut off
                continue
            tag = m[2].lower()
            if m[1]:
                if self._places[tag]:
                    self._close(self._places[tag][-1])
                elif tag in BLOCK:
                    self._flush()
                continue
            self._implied_end(tag)
            if tag == "br":
                self._pieces.append(" ")
                continue
            if tag in BLOCK:
                self._flush()
            if tag in VOID:
                continue
            if tag not in RAW:
                self._enter(tag, m[3])
            elif not (tag in ("svg", "math") and m[3].endswith("/")):
                end = None if tag in no_end else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                if end is not None:
                    at = html.find(">", end.end() - 1) + 1 or n
                elif tag in MARKUP:
                    no_end.add(tag)  # there is none further on either
                else:
                    break
        self._flush()

    def texts(self) -> list[int]:
        """The living paths with text, but for those of mostly links."""
        return [i for i, p in enumerate(self.paths) if p.length and not p.dead and p.links < LINKS * p.length]

    def fused(self) -> dict[int, float]:
        """The geometric mean of the smoothed text-to-tag and punctuation-to-tag ratios of each path of texts()."""
        own, around = self.texts(), [[0, 0, 0] for _ in self.paths]  # length, points and elements of the texts in a container

        def add(to, i, sign=1):
            p = self.paths[i]
            for k, v in enumerate((p.length, p.points, max(1, p.tags))):
                to[k] += sign * v

        for i in own:
            add(around[i], i)
            if i:
                add(around[self.paths[i].parent], i)
        near = []  # of each path the nearest container with texts, from itself upwards, and how far up it is
        for i, p in enumerate(self.paths):
            near.append((i, 0) if around[i][2] else (near[p.parent][0], near[p.parent][1] + 1) if i else (-1, 0))
        out = {}
        for i in own:
            p = self.paths[i]
            ratio, beside, weight = (p.length / max(1, p.tags), p.points / max(1, p.tags)), [0, 0, 0], SMOOTH
            if i:
                beside = list(around[p.parent])
                add(beside, i, -1)
                above = self.paths[p.parent].parent
                if not beside[2] and above >= 0 and near[above][0] >= 0:
                    beside, weight = around[near[above][0]], SMOOTH * DECAY ** (near[above][1] + 1)
            if beside[2]:
                ratio = [(1 - weight) * x + weight * y / beside[2] for x, y in zip(ratio, beside)]
            out[i] = (ratio[0] * (ratio[1] + 0.25)) ** 0.5
        return out

    def content(self) -> set[int]:
        """The paths that are content: at the threshold or above, and in the article."""
        score = self.fused()
        if not score:
            return set()
        typical, left = 0.0, sum(self.paths[i].length for i in score) / 2  # the value that half of the text is below
        for i in sorted(score, key=score.get):
            typical, left = score[i], left - self.paths[i].length
            if left <= 0:
                break
        good = {i for i, v in score.items() if v >= SHARE * typical}
        held = [0.0] * len(self.paths)  # content in and below a path
        for i in good:
            held[i] += score[i] * self.paths[i].length
        below = [False] * len(self.paths)  # whether there is content below a path
        for i in range(len(self.paths) - 1, 0, -1):
            held[self.paths[i].parent] += held[i]
            below[self.paths[i].parent] |= held[i] > 0
        level = [0] * len(self.paths)
        for i in range(1, len(self.paths)):
            level[i] = level[self.paths[i].parent] + 1
        named = [i for i, p in enumerate(self.paths) if p.tag in ("article", "main") and not p.dead and held[i] > 0]
        if named:
            top = max(held[i] for i in named)
            home = max((i for i in named if held[i] >= 0.8 * top), key=lambda i: (level[i], -i))
        else:
            home = max((i for i in range(len(self.paths)) if held[i] >= MOST * held[0] and (below[i] or not i)), key=lambda i: (level[i], held[i], -i))
            beside = {self.paths[i].parent for i in good if self.paths[i].tag in ("h1", "h2", "h3", "p")}
            while home and self.paths[home].parent in beside:  # headlines and paragraphs next to the container belong to it
                home = self.paths[home].parent
        inside = [False] * len(self.paths)
        for i, p in enumerate(self.paths):
            inside[i] = i == home or i > 0 and inside[p.parent]
        return {i for i in good if inside[i]}


def main_text(html: str | None) -> str:
    """Blocks of the article, joined by line breaks."""
    page = Page(html or "")
    kept = page.content()
    return "\n".join(text for i, text in page.blocks if i in kept)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars in place of the html column; columns of these names are replaced."""
    names = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    schema = pages.select(*names).schema.add("text", "string").add("n_chars", "long")

    def make():
        def step(batch):
            pages_ = clean(batch.column(column).to_pylist())
            for a, b in chunks(map(len, pages_), 2_000_000):
                texts = [main_text(x) for x in pages_[a:b]]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

        return step

    return arrow_pass(pages.select(*names, F.col(column)), make, schema)
