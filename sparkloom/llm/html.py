"""Main text of web pages by two-pass block rules.

The page is cut at block elements into blocks. Elements by name (nav, footer, aside ...), hidden ones, and a page's header hold no
text of the article and are left out; of a header inside an article the headings stay.

A form, and the words of a block element's class, id or role (menu, sidebar, cookie, comments, ad ...), are hints that it is none of
the article. Names that deny the word or tell of what the element has (no-sidebar, with-comments, ad-free) give none. A hint is plain,
if it is a form's, a name made of such words only (sidebar, cookie-notice), or one that names comments or a footer, alone, as what it
ends in (user-comments, site-footer) or with words for what holds them (comments-area, disqus_thread); or else part of a compound
(layout-sidebar). Hints are believed by what the blocks say (below): the good blocks (in an article open ones too) with the fewest plain hints around them are
free, and the plain hints around those are not believed, but all others are; a compound is, unless its element holds more than half of the text of the free good blocks. main takes no hint, article none of compounds, neither
their own nor those around them. Where comments and footers hold all the good blocks, open blocks of prose outside them, if there are
any, take the good ones' place here: a short post with a long thread. Blocks in elements whose hints are believed, and inline elements with a hint, are left out.

First pass: each block is classed by itself:

* bad: more than MOST_LINKED of its characters stand in links;
* good: long enough with the stop-word density of prose (in an article SHORT characters and LEAST_STOP will do);
* bad: long enough, with too few stop words and outside an article (open, if the page has no good block at all);
* short or in between: open.

Where the good blocks in articles (article, main) have at least a third of the good blocks' text, what lies outside articles is left
out; else articles (of teasers, say) count as any element.

Second pass: an open block takes the label of the nearest decided block (in an article lists of links decide nothing); of two
as near, good wins; without any it is good.

Character references are decoded within each run of text, white space inside a block becomes one blank, the ends are trimmed, empty
blocks vanish, and the good blocks are joined in page order by \\n. br counts as white space. Null or empty html gives the empty
text. Markup that isn't closed lasts to the end of what holds it; an svg or math element, or another that holds no text of the page, ends where
its own kind are all closed, at once if it closes itself, or else where a block begins. The time is in proportion to the page's length, whatever its markup.
Every row is treated by itself, repeated ones too; other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

MOST_LINKED, SHORT, LONG, LEAST_STOP, PROSE_STOP = 0.5, 60, 100, 0.15, 0.28
# The most frequent function words of four languages.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his if in into is it its not of on or our she that the their there they this to was we were which who will with you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "al como con de del el ella en entre es esta este fue ha la las le lo los más me no o para pero por que se si sin sobre su sus también un una y ya "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Their content is no text of the page. It is text up to the end tag, or (below) markup.
RAW = frozenset("script style noscript template textarea title svg math iframe object audio video canvas select xmp noembed noframes".split())
NESTING = frozenset("svg math object audio video canvas select template".split())
#: They close themselves where they say so.
FOREIGN = frozenset("svg math".split())
OUT = frozenset("nav footer aside menu dialog search head button".split())
NOT_ARTICLE_WORDS = frozenset(
    "ad ads adsbygoogle adv alert advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus dialog footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion rail recommended related replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: What a name of comments or a footer ends in, and what may stand after them: words for what holds them.
NAMED = frozenset("comment comments commentlist disqus footer replies respond".split())
HOLDERS = frozenset("area block body bottom box container content element entry feed form holder inner item list meta module outer panel region root row section shell thread threads title top wrap wrapper".split())
#: A name with one of these says that the element has no such thing, or has it besides what it is.
RELATIONAL = frozenset("no not non none without hide hides hidden has have having with free enabled disabled".split())
HEADER_WORDS = frozenset("banner header masthead topbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_BLOCK_TAG = re.compile(r"</?(?:p|div|article|main|section|h[1-6]|ul|ol|table|footer)(?![a-z0-9-])", re.I)
_HINTS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=]|$)|display\s*:\s*none""", re.I)
_PART = re.compile(r"[a-z]+")
_NAME = re.compile(r"([a-z])([A-Z])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(eq=False)
class Hint:
    """A hinted element and the hinted ones around it."""

    number: int  # of the element
    plain: bool
    up: Hint | None
    bare: Hint | None = None  # the same without compounds
    depth: int = 0  # plain ones
    named: bool = False  # comments, a footer, or inside them

    def __post_init__(self):
        self.depth = self.plain + (self.up.depth if self.up else 0)
        self.named = self.named or self.up is not None and self.up.named


@dataclass
class Block:
    text: str
    linked: int
    article: int  # 0: outside
    heading: bool
    hint: Hint | None = None


@dataclass
class _Open:
    name: str
    marked: bool
    article: int
    header: bool
    heading: bool
    link: bool
    hint: Hint | None = None


class _Stack:
    """The open elements; ends are found in constant time for each element that they close."""

    def __init__(self):
        self.items = [_Open("", False, 0, False, False, False)]
        self.open: Counter[str] = Counter()  # block elements by name
        self.inline: list[Counter[str]] = [Counter()]  # inline ones, since each block element

    def push(self, x: _Open) -> None:
        self.items.append(x)
        if x.name in BLOCK:
            self.open[x.name] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][x.name] += 1

    def pop(self) -> str:
        name = self.items.pop().name
        if name in BLOCK:
            self.open[name] -= 1
            self.inline.pop()
        else:
            self.inline[-1][name] -= 1
        return name

    def close(self, name: str) -> None:
        if (self.open if name in BLOCK else self.inline[-1])[name]:
            while self.pop() != name:
                pass


def _names(parts: list[str]) -> bool:
    """Whether a name in parts is one of comments or a footer."""
    if parts[-1] in NAMED:
        return True
    return parts[0] in NAMED and all(x in HOLDERS or x in NOT_ARTICLE_WORDS for x in parts[1:])


def hint(attributes: str, words: frozenset[str]) -> tuple[bool | None, bool]:
    """True: a name in class, id or role is made of these words, or names comments or a footer; False: one has some of them; None: none has, but for relational ones. And whether it names comments or a footer."""
    found, named = None, False
    for value in _HINTS.findall(attributes):
        for name in _NAME.sub(r"\1-\2", "".join(value)).lower().split():
            parts = _PART.findall(name)
            own = {*parts}
            if own & (words | NAMED) and not own & RELATIONAL:
                names = _names(parts)
                found, named = found or own <= words or names, named or names
    return found, named


def _closed(page: str, name: str) -> dict[int, int]:
    """By the place after an element's start tag, the place after the end tag that closes it, for all elements of a name that are closed."""
    out, open_ = {}, []
    for m in re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?){name}(?![a-z0-9-])[^>]*>", re.I | re.S).finditer(page):
        if m[1]:
            if open_:
                out[open_.pop()] = m.end()
        elif m[1] == "" and not (name in FOREIGN and m[0].endswith("/>")):
            open_.append(m.end())
    return out


def _raw_end(page: str, name: str, at: int, closed: dict[str, dict[int, int]]) -> int:
    """Where an element ends whose start tag ends at `at` and whose content is passed by. closed: what is known of the page, by name."""
    if name not in NESTING:
        end = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(page, at)
        return end.end() if end else len(page)
    if name not in closed:
        closed[name] = _closed(page, name)
    if at in closed[name]:
        return closed[name][at]
    block = _BLOCK_TAG.search(page, at)
    return block.start() if block else len(page)


def blocks(page: str, hints: list[Hint] | None = None) -> Iterator[Block]:
    """The blocks with text, in page order; hints: to take all hinted elements, each after those around it."""
    stack, told = _Stack(), [] if hints is None else hints
    parts: list[tuple[str, bool]] = []
    at, articles, numbers = 0, 0, 0
    closed: dict[str, dict[int, int]] = {}

    def flush() -> Iterator[Block]:
        top = stack.items[-1]
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = len(" ".join("".join(t for t, a in parts if a).split()))
            yield Block(text, linked, top.article, top.heading, top.hint)
        parts.clear()

    def add(text: str) -> None:
        top = stack.items[-1]
        if not top.marked and (top.heading or not top.header):
            parts.append((html.unescape(text), top.link))

    def hinted(plain: bool, up: Hint | None, named: bool = False) -> Hint:
        bare = up.bare if up else None
        if plain and bare is not up:
            bare = Hint(numbers, True, bare, named=named)
            bare.bare = bare
            told.append(bare)
        x = Hint(numbers, plain, up, named=named)
        x.bare = x if plain and bare is up else bare
        told.append(x)
        return x

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCK:
                yield from flush()
            stack.close(name)
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW:
            at = at if name in FOREIGN and attributes.rstrip().endswith("/") else _raw_end(page, name, at, closed)
            if name in BLOCK:
                yield from flush()
            else:
                add(" ")
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCK:
            yield from flush()
            while len(stack.items) > 1 and stack.items[-1].name not in BLOCK:  # a block ends what inline markup was left open
                stack.pop()
            if stack.items[-1].name == "p" or stack.items[-1].name in _CLOSES.get(name, ()):
                stack.pop()
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        top = stack.items[-1]
        article, up = top.article, top.hint
        if name in ("article", "main") and not article:
            articles += 1
            article = articles
        open_ = name not in ("html", "body")
        marked = top.marked or open_ and (name in OUT or bool(_HIDDEN.search(attributes)))
        header = top.header or name == "header"
        found, named = hint(attributes, NOT_ARTICLE_WORDS if article else NOT_ARTICLE_WORDS | HEADER_WORDS) if open_ else (None, False)
        if name == "form":
            found = True
        if name not in BLOCK:
            marked = marked or found is not None
        elif name == "main":
            up = None
        elif name == "article":
            up = hinted(True, up.bare if up else None, named) if found else up.bare if up else None
        elif found is not None:
            up = hinted(found, up, named)
        numbers += 1
        stack.push(_Open(name, marked or header and not article, article, header, top.heading or name in HEADINGS, top.link or name == "a", up))
    add(page[at:])
    yield from flush()


def first_pass(b: Block) -> bool | None:
    """True: good, False: bad, None: open."""
    if b.linked > MOST_LINKED * len(b.text):
        return False
    stop = _stop_share(b.text)
    if len(b.text) < SHORT or b.heading:
        return None
    if stop >= (LEAST_STOP if b.article else PROSE_STOP) and len(b.text) >= (SHORT if b.article else LONG):
        return True
    return None if stop >= LEAST_STOP or b.article else False


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _short_prose(b: Block) -> bool:
    return not b.heading and len(b.text) >= SHORT // 3 and b.linked <= MOST_LINKED * len(b.text) and _stop_share(b.text) >= LEAST_STOP


def left_out(found: list[Block], labels: list[bool | None], hints: list[Hint]) -> set[Hint]:
    """The hinted elements that are believed to be none of the article, and all inside them."""
    depth = lambda b: b.hint.depth if b.hint else 0
    good = [b for b, label in zip(found, labels, strict=True) if label or b.article and label is None]
    if all(b.hint and b.hint.named for b in good):
        good = [b for b, label in zip(found, labels, strict=True) if label is None and not (b.hint and b.hint.named) and _short_prose(b)] or good
    least = min(map(depth, good), default=0)
    free = [b for b in good if depth(b) == least]
    held: dict[int, int] = {}
    for b in free:
        held[id(b.hint)] = held.get(id(b.hint), 0) + len(b.text)
    inside: Counter[int] = Counter()  # text of the free good blocks, by element
    for x in reversed(hints):
        n = held.get(id(x), 0)
        if n and x.up:
            held[id(x.up)] = held.get(id(x.up), 0) + n
        inside[x.number] += n
    whole, out = sum(len(b.text) for b in free), set()
    for x in hints:
        n = inside[x.number]
        if x.up in out or (not n if x.plain else 2 * n <= whole):
            out.add(x)
    return out


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """The open blocks take the label of the nearest decided one of their container."""
    n = len(found)
    before: list[tuple[int, bool] | None] = [None] * n
    after = before.copy()
    for out, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            if labels[i] or labels[i] is False and not found[i].article:
                last[found[i].article] = (i, labels[i])
            out[i] = last.get(found[i].article)
    done = []
    for i, (b, label) in enumerate(zip(found, labels, strict=True)):
        if label is None:
            near = [(abs(x[0] - i), not x[1]) for x in (before[i], after[i]) if x]
            label = not min(near)[1] if near else True
        done.append(label)
    return done


def main_text(page: str | None) -> str:
    hints: list[Hint] = []
    found = [*blocks(page or "", hints)]
    labels = [first_pass(b) for b in found]
    out = left_out(found, labels, hints)
    kept = [(b, x) for b, x in zip(found, labels, strict=True) if b.hint not in out]
    size = lambda inside: sum(len(b.text) for b, x in kept if x and bool(b.article) == inside)
    if 2 * size(True) < size(False):
        for b, _ in kept:
            b.article = 0
        kept = [(b, first_pass(b)) for b, _ in kept]
    kept = [x for x in kept if x[0].article] or kept
    found, labels = [b for b, _ in kept], [x for _, x in kept]
    if True not in labels:  # no prose in the languages of the stop words: their lack says nothing
        labels = [None if x is False and b.linked <= MOST_LINKED * len(b.text) else x for x, b in zip(labels, found, strict=True)]
    labels = second_pass(found, labels)
    return "\n".join(b.text for b, good in zip(found, labels, strict=True) if good)


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """df with text, the main text of the html; the html goes."""
    kept = [c for c in df.columns if c not in (column, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], names=[*kept, "text"])

    return map_arrow(df.select(*kept, column), run, df.select(*kept).schema.add("text", "string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
