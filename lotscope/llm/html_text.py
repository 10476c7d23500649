"""Main text of web pages by the best-scoring run of blocks.

A page is read as blocks of text between tags. Elements that HTML itself sets apart (navigation, scripts, asides, hidden
ones and so on) give no blocks. Every word scores one; every tag costs as much as labelled pages say: the logarithm of
how much oftener it stands outside of the article than inside. One linear scan finds the run of blocks with the greatest
sum, which is the article; blocks are never cut.

Names by which authors mark other parts (class, id, role) and forms are doubts, not cuts. Blocks with doubts are left out
first; then doubts are dropped if the run with their blocks gains more words than the run without has, times the
exponential of the cost of the doubt, which labelled pages give like that of a tag. An article or main element has no
doubts by its own names, nor has what lies around the first one.

Labelled pages are those that mark their article with ``<article>`` or ``<main>``.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.words import as_text, slices

# The meaning of HTML elements, and words by which authors name parts of a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
                   "search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("head nav footer aside button select datalist dialog menu search svg object audio video canvas map".split()) | RAW
DOUBTFUL = frozenset(("form", "fieldset"))
DOUBTFUL_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
DOUBTFUL_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense alert announcement banner breadcrumb breadcrumbs byline "
    "comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr legal login masthead menu menus modal "
    "nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion recommended "
    "related replies reply respond responses search share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "tags teaser toolbar widget widgets".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
KNOWN = BLOCKS | VOID | INLINE
#: Elements out of which tags do not reach, and those that the start of an element ends, with the walls.
CELLS = ("table", "td", "th", "caption")
TABLE = frozenset(CELLS) | {"tr", "tbody", "thead", "tfoot"}
LISTS = ("ul", "ol", "menu", "dir", "section", "article", "aside", "main", "nav", "form", "blockquote") + CELLS
_ROWS = ("td", "th", "tr", "caption")
_GROUPS = ((_ROWS + ("tbody", "thead", "tfoot"), ("table",)),)
IMPLIED = {"li": ((("li",), LISTS),), "dt": ((("dt", "dd"), ("dl",) + CELLS),), "dd": ((("dt", "dd"), ("dl",) + CELLS),),
           "option": ((("option",), ("select", "datalist")),), "optgroup": ((("option", "optgroup"), ("select", "datalist")),),
           "tr": ((_ROWS, ("table",)),), "td": ((("td", "th", "caption"), ("table",)),), "th": ((("td", "th", "caption"), ("table",)),),
           "tbody": _GROUPS, "thead": _GROUPS, "tfoot": _GROUPS, "p": ((("p",), CELLS + ("button",)),)}
#: Least and greatest cost of a tag, and that of the borders of an article.
LEAST_COST, MOST_COST, BORDER_COST = 0.01, 6.0, 60.0
#: Cost of a doubt of which labelled pages have fewer than SEEN words, and greatest cost of one.
DOUBT_COST, MOST_DOUBT_COST = 1.5, 2.0
#: Costs of tags that stand in fewer than SEEN places of labelled pages.
SEEN, PRIOR = 20, {"a": 1.0, "li": 0.2, "div": 0.2, "section": 0.2, "html": 6.0, "body": 6.0}

_TAG_NAME = re.compile(r"[^\s/>]*")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NONE: frozenset[str] = frozenset()
_NAME = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _meaning(name: str, attributes: str, in_article: bool) -> tuple[bool, frozenset[str]]:
    """Whether an element is no article text by its meaning, and the doubts that its names cast on it."""
    if name in SKIPPED or name == "header" and not in_article:
        return True, NONE
    doubts = {"form"} if name in DOUBTFUL else set()
    if not attributes or name in ("html", "body"):
        return False, frozenset(doubts)
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True, NONE
        if key == "role":
            doubts |= DOUBTFUL_ROLES.intersection(value.lower().split())
        if key in ("class", "id"):
            doubts |= DOUBTFUL_NAMES.intersection(_NAME.findall(_CAMEL.sub(" ", value).lower()))
    return False, NONE if name in ("article", "main") else frozenset(doubts)


class Block(NamedTuple):
    """Raw text (references not decoded yet), tags passed since the block before, the doubts on it, and whether a border
    of a block stands before it. A doubt is a list that holds its name, or nothing once it is dropped."""
    text: str
    tags: list[str]
    doubts: tuple[list[str], ...]
    begins: bool


class Tag(NamedTuple):
    """A tag, comment or declaration from ``start`` to ``end``: the names of a start tag and of an end tag, else empty."""
    start: int
    end: int
    name: str
    attributes: str
    closed: str
    comment: bool


class _Tags:
    """Tags of a page, in time that grows with its length, however it is broken.

    A start tag ends at the first > outside of quotes, or at the first one at all if there is none. What no > follows is
    text. Places from which no > outside of quotes is reached are remembered, as later tags run into them.
    """

    def __init__(self, page: str):
        self.page, self.close, self.hopeless = page, -1, set()

    def _outside(self, at: int) -> int:
        """The first > outside of quotes, or -1."""
        passed = []
        while at not in self.hopeless:
            passed.append(at)
            found = _QUOTE_OR_END.search(self.page, at)
            if not found:
                break
            if found.group() == ">":
                return found.start()
            at = self.page.find(found.group(), found.end()) + 1
            if not at:
                break
        self.hopeless.update(passed)
        return -1

    def next(self, at: int) -> Tag | None:
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                return Tag(start, start + 4, "", "", "", True)
            if self.close < start:
                self.close = page.find(">", start)
                if self.close < 0:
                    rest = page.find("<!--", start)
                    return Tag(rest, rest + 4, "", "", "", True) if rest >= 0 else None
            first = page[start + 1:start + 2]
            if first.isascii() and first.isalpha():
                name = _TAG_NAME.match(page, start + 1)
                end = self._outside(name.end())
                end = self.close if end < 0 else end
                return Tag(start, end + 1, name.group(), page[name.end():end], "", False)
            if first == "/" and (second := page[start + 2:start + 3]).isascii() and second.isalpha():
                return Tag(start, self.close + 1, "", "", _TAG_NAME.match(page, start + 2).group(), False)
            if first and first in "!?/":
                return Tag(start, self.close + 1, "", "", "", False)
            at = start + 1
        return None


class _Open:
    """Open elements of a page, and the place from which text is skipped (none: -1).

    An element ends with its own end tag, with that of an element around it, or where the start of another implies its
    end. Tags do not reach out of walls: lists, tables and cells hold what is in them.
    """

    def __init__(self):
        self.names: list[str] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.skip, self.articles = -1, 0
        self.doubts: list[tuple[int, list[str]]] = []
        self.seen: set[str] = set()

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def start(self, name: str) -> None:
        place = len(self.names)
        self.names.append(name)
        self.places[name].append(place)
        if name in BLOCKS:
            self.blocks.append(place)
        if name in ("article", "main") and self.skip < 0:
            self.articles += 1
            if name not in self.seen:  # what lies around the first one is no mere part of the page
                self.seen.add(name)
                for _, doubt in self.doubts:
                    doubt.clear()

    def cut(self, place: int) -> None:
        """End the element at ``place`` and all in it."""
        while self.doubts and self.doubts[-1][0] >= place:
            self.doubts.pop()
        while len(self.names) > place:
            name, at = self.names.pop(), len(self.names)
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            if name in ("article", "main") and (self.skip < 0 or at < self.skip):
                self.articles -= 1
            if at == self.skip:
                self.skip = -1

    def imply(self, name: str) -> None:
        """End what the start of ``name`` ends."""
        for ends, walls in (*IMPLIED.get(name, ()), *(IMPLIED["p"] if name in BLOCKS and name != "p" else ())):
            while (place := self.last(ends)) > self.last(walls):
                self.cut(place)

    def end(self, name: str) -> int:
        """End the innermost element of a name that the end tag reaches; its place or -1."""
        if name in INLINE:
            wall = self.blocks[-1] if self.blocks else -1
        else:
            wall = -1 if name in ("table", "html", "body") else self.last(("table",) if name in TABLE else LISTS if name == "li" else CELLS)
        place = self.last((name,))
        if place <= wall:
            return -1
        self.cut(place)
        return place


def read_blocks(page: str, count: Counter | None = None) -> Iterator[Block]:
    """Blocks of a page in order. Where doubts begin or end, a block ends without a border, and may hold tags only.

    Text of skipped elements is left out, and so are tags in them. An unclosed comment or raw element ends with the page;
    any other ends as HTML lets it. ``count`` gets (tag, inside an article), tags with doubts left out, and the words of
    every doubt as (#name, inside an article).
    """
    text, tags, at, end, begins = [], [], 0, len(page), True
    opened, doubts, articles, tags_of = _Open(), (), 0, _Tags(page)

    def block() -> Block:
        nonlocal text, tags, begins
        out = Block("".join(text), tags, doubts, begins)
        if count is not None:
            for name in {n for d in doubts for n in d}:
                count["#" + name, articles > 0] += len(out.text.split())
        text, tags, begins = [], [], False
        return out

    while True:
        found = tags_of.next(at)
        start = found.start if found else end
        if start > at and opened.skip < 0:
            text.append(page[at:start])
        if not found:
            break
        at = found.end
        if found.comment:
            stop = page.find("-->", at)
            at = stop + 3 if stop >= 0 else end
            continue
        name, attributes, closed = found.name.lower(), found.attributes, found.closed.lower()
        if not name and not closed:
            continue
        if name in RAW and not attributes.endswith("/"):
            stop = re.compile(f"</{re.escape(name)}\\b", re.I).search(page, at)
            at = stop.start() if stop else end
        holds = name and name not in VOID and not (attributes.endswith("/") and name not in BLOCKS)
        skip, n_doubts, articles = opened.skip, len(opened.doubts), opened.articles
        if name:
            opened.imply(name)
        own = not name and opened.end(closed) == skip >= 0
        border = opened.skip < 0 and not own and (name in BLOCKS or closed in BLOCKS)
        skipped, cast = (opened.skip >= 0 or own, NONE) if opened.skip >= 0 or not name else _meaning(name, attributes, opened.articles > 0)
        cast = cast.difference(*(d for _, d in opened.doubts))  # names that hold already say no more
        left = len(opened.doubts) < n_doubts
        if left and closed:
            tags.append("/" + closed)
        if left or cast:
            if any(map(str.strip, text)) or tags:
                yield block()
            doubts = tuple(d for _, d in opened.doubts)
        if skipped:
            if holds:
                if opened.skip < 0:
                    opened.skip = len(opened.names)
                opened.start(name)
            if skip < 0 and name not in INLINE:
                if any(map(str.strip, text)):
                    yield block()
                begins = True
            continue
        if border:
            if any(map(str.strip, text)):
                yield block()
            text, begins = [], True
        elif name == "br":
            text.append(" ")
        if cast and holds:
            opened.doubts.append((len(opened.names), sorted(cast)))
            doubts = tuple(d for _, d in opened.doubts)
        if holds:
            opened.start(name)
        articles = opened.articles
        if count is not None and not any(doubts):
            count[(name or closed) if (name or closed) in KNOWN else "other", articles > 0] += 1
        if not (left and closed):
            tags.append(name or "/" + closed)
    if any(map(str.strip, text)):
        yield block()


def cost(tag: str, costs: dict[str, float]) -> float:
    name = tag.lstrip("/")
    if name in ("article", "main"):
        return BORDER_COST
    name = name if name in KNOWN else "other"
    return costs.get(name, PRIOR.get(name, LEAST_COST))


def _best_run(blocks: list[Block], dropped: frozenset[str], costs: dict[str, float]) -> tuple[float, list[str]]:
    """Score and texts of the best run of blocks that have no other doubts than ``dropped``."""
    best, best_sum, total, first = (0, 0), 0.0, 0.0, 0
    texts: list[str] = []
    raw, tags, begins = "", [], True

    def add() -> None:
        nonlocal best, best_sum, total, first, raw, tags
        text = " ".join(html_lib.unescape(raw).split())
        if not text:
            return
        inside = sum(cost(t, costs) for t in tags if t.lstrip("/") not in BLOCKS)
        between = sum(cost(t, costs) for t in tags if t.lstrip("/") in BLOCKS)
        if total - between <= 0:  # nothing before this block is worth the tags in between
            total, first = 0.0, len(texts)
        else:
            total -= between
        texts.append(text)
        total += len(text.split(" ")) - inside
        if total > best_sum:
            best, best_sum = (first, len(texts)), total
        raw, tags = "", []

    parts: list[str] = []
    for b in blocks:
        begins |= b.begins
        if all(dropped.issuperset(d) for d in b.doubts):
            if begins:
                raw = "".join(parts)
                add()
                parts = []
            parts.append(b.text)
            tags += b.tags
            begins = False
    raw = "".join(parts)
    add()
    return best_sum, texts[best[0]:best[1]]


def main_text(page: str, costs: dict[str, float]) -> str:
    """Text of the best run of blocks, one line each."""
    blocks = list(read_blocks(page))
    dropped = NONE
    score, texts = _best_run(blocks, dropped, costs)
    words: Counter[frozenset[str]] = Counter()
    for b in blocks:
        if any(b.doubts):
            words[frozenset(n for d in b.doubts for n in d)] += len(b.text.split())
    while True:  # each round more than doubles the score
        better = None
        for names in sorted((s for s in words if not s <= dropped), key=sorted):
            weight = math.exp(-sum(costs.get("#" + n, DOUBT_COST) for n in names - dropped))
            if sum(words[s] for s in words if s <= dropped | names and not s <= dropped) * weight <= score:
                continue
            gained, run = _best_run(blocks, dropped | names, costs)
            if (gain := (gained - score) * weight) > max(score, better[0] if better else 0.0):
                better = gain, gained, run, dropped | names
        if better is None:
            return "\n".join(texts)
        _, score, texts, dropped = better


def tag_costs(labelled: DataFrame, html: str = "html") -> dict[str, float]:
    """Cost of every known tag from pages that mark their article, counted over all of them."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, html):
            total: Counter = Counter()
            for page in as_text(batch.column(html)).to_pylist():
                if "<article" in page or "<main" in page:
                    for _ in read_blocks(page, total):
                        pass
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([total[k] * k[1] for k in keys], pa.int64()),
                 pa.array([total[k] * (not k[1]) for k in keys], pa.int64())], ["tag", "inside", "outside"])

    counts = (labelled.select(html).mapInArrow(run, "tag string, inside bigint, outside bigint").groupBy("tag")
              .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")))
    # one row per known tag name at most
    return {r.tag: min(MOST_DOUBT_COST if r.tag.startswith("#") else MOST_COST, max(LEAST_COST, math.log((r.outside + 1) / (r.inside + 1))))
            for r in counts.collect() if r.outside + r.inside >= SEEN}


def extract(pages: DataFrame, costs: dict[str, float], html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text (empty if there is none), and ``n_chars``, its code points.

    A null page is empty. White space inside a block becomes one space, blocks are joined by one line feed, character
    references are decoded. Columns with the new names are replaced; rows, repeated ones too, and other columns stay.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string, n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, html):
            texts = [main_text(page, costs) for page in as_text(batch.column(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
