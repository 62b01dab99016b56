"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  Pass one decides what it can: blocks
inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments
(by element, role, class or id) and blocks made of links are boilerplate; long blocks
with enough stop words are text; the rest is ambiguous, above all short blocks.  Pass
two gives each ambiguous block the label of its nearest decided neighbour on either
side; where these disagree the nearer one counts, and a tie goes to text for blocks with
stop words.

Inside an ``article`` or ``main`` element neighbours are looked for there alone.  Long blocks
not made of links are text in any language, and an ambiguous block is rejected only where
the decided neighbours on both sides are near and made of links, so that lists, tables and
short or unknown texts inside an article stay.  Where such elements hold at least half of
the text that pass one decided on, only blocks inside count.

An ``article`` or ``main`` inside a wrapper that only its class or id judges starts afresh
(an ``article`` not if the words are those of comments, adverts or related pages); words
after has, with, without or no in a class do not count.  Attributes count by exact names.

Quoted attribute values have any length and may hold >.  A tag whose quotes leave it without
an end is that tag up to the first >.

Character references are decoded once, white space inside a block (also no-break spaces)
becomes one space, blocks are trimmed and joined in page order by one line feed.

Defined results: null or empty html, and pages without text, give the empty text.
Unclosed elements end with their parent; an unclosed comment, script, style or textarea
runs to the end.  Of the other elements whose text is dropped, such as button or select, one
without an end tag before the next of its name also ends where an article or main begins.
Repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import field, map_arrow

# fixed values: the commonest function words of four languages
STOP_WORDS = frozenset("""
a about after all an and are as at be been but by can for from had has have he her his if in into is it its more
not of on one or our out she so than that the their there they this to up was we were what when which who will
with would you your
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour
que qui sa se ses son sur un une vous
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat
ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wir zu zum zur
al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no
nos o para pero por porque que se ser si sin sobre su sus también un una y ya
""".split())

# elements whose text is not the page's: plain text up to the end tag or the page's end, and elements that
# end with their parent, of these UNNESTED not inside themselves
TO_END = frozenset(["script", "style", "textarea"])
UNNESTED = frozenset("noscript select iframe button title".split())
DROPPED = TO_END | UNNESTED | frozenset("template svg math object canvas audio video".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # quotes hold a value of any length after =; where that leaves no >, the tag ends at the first one
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>"'<]*+)"""
    r"""(?P<attr>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+(?=>)|[^>]*+)>"""
    r"|<[!?][^>]*>",
    re.I | re.S)
NEXT = {t: re.compile(rf"<(/{'' if t in TO_END else '?'}){t}(?=[\s/>])[^>]*>", re.I) for t in DROPPED}
BLOCK_TAGS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary
table tbody td tfoot th thead tr ul""".split())
VOID = frozenset(["hr"])
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog search fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
BOILER_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs
byline comment comments commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu
modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion
recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe
subscription taboola toolbar widget widgets""".split())
ARTICLE_BOILER = frozenset("""ad ads advert adverts advertisement comment comments promo promoted recommended related
reply sponsored teaser""".split())
# what follows in a class says what the page has or lacks, as in has-sidebar or page-with-menu
STATES = frozenset("has have with without no non not".split())
LIFTED = frozenset(["nav", "header", "form", "class"])    # reasons that an article inside may end
CONTAINERS = frozenset("article aside footer form header main nav ol section table ul".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

# one attribute after another, so that names inside values or longer names do not count
_ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    short: int = 70            # characters; shorter blocks are ambiguous
    long: int = 200            # from here on enough stop words make a block text
    stop_low: float = 0.12     # share of stop words
    stop_high: float = 0.25
    link_share: float = 0.4    # more of the characters inside links: boilerplate
    near: int = 2              # blocks; inside an article farther neighbours reject none


class Block:
    __slots__ = ("parts", "linked", "boiler", "article", "heading", "text", "label", "stops")

    def __init__(self, boiler: bool, article: int, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.boiler, self.article, self.heading = boiler, article, heading
        self.text, self.label, self.stops = "", "", 0.0


@dataclass
class _Open:
    tag: str
    boiler: str = ""     # why what is inside is boilerplate
    article: int = 0     # number of the article around


def _class_words(value: str) -> Iterator[str]:
    for name in value.split():
        for w in _NAME.findall(name):
            if w.lower() in STATES:
                break
            yield w.lower()


def _own_boiler(tag: str, attr: str, article: int) -> str:
    if tag in ("html", "body"):     # the page itself, hidden only until a script shows it
        return ""
    values: dict[str, str] = {}
    for key, a, b, c in _ATTR.findall(attr) if attr else ():
        values.setdefault(key.lower(), a or b or c)
    # an open dialog sets aria-hidden on main, whose text is still shown
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" and tag != "main":
        return "hidden"
    if tag == "main":
        return ""
    words = {*_class_words(values.get("class", "")), *_class_words(values.get("id", ""))}
    if tag == "article":
        return "promo" if words & ARTICLE_BOILER else ""
    if tag == "header" or (article and "header" in words and not words & ARTICLE_BOILER):
        return "header"
    if tag in BOILER_TAGS:
        return tag
    if values.get("role", "").lower() in BOILER_ROLES:
        return "role"
    return "promo" if words & ARTICLE_BOILER & BOILER_WORDS else "class" if words & BOILER_WORDS else ""


def page_blocks(page: str) -> list[Block]:
    """Blocks of the page in order, with their text, link share and place."""
    blocks: list[Block] = []
    stack: list[_Open] = [_Open("")]
    articles = 0
    links = breaks = 0
    block: Block | None = None
    at = 0
    heading = False
    dropped: list[str] = []     # the open dropped element and what is open inside
    ahead: dict[str, re.Match | None] = {}

    def ends(name: str) -> re.Match | None:
        """The next tag of a dropped element's name, if that is an end tag."""
        m = ahead.get(name)
        if name not in ahead or m and m.start() < at:
            m = ahead[name] = NEXT[name].search(page, at)
        return m if m and m[1] else None

    def say(raw: str) -> None:
        nonlocal block, breaks
        if not raw or dropped:
            return
        if block is None:
            if raw.isspace():
                return
            top = stack[-1]
            # a heading in an article's own header is the article's title
            title = top.boiler == "header" and top.article and heading
            block = Block(bool(top.boiler) and not title, top.article, heading)
            blocks.append(block)
        text = html.unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if not text.isspace():
            breaks = 0
        if links:
            block.linked += len(text)

    while m := TOKEN.search(page, at):
        say(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        closed = m["end"] or m["attr"].endswith("/")
        if tag in TO_END and not closed and dropped[-1:] != ["title"]:
            end = ends(tag)
            at = end.end() if end else len(page)
            continue
        if dropped:
            if m["end"]:
                if tag in dropped:
                    del dropped[len(dropped) - 1 - dropped[::-1].index(tag):]
                    continue
                # the end of a parent is also that of an element left open
                if (ends(dropped[0]) and tag != "head" and not (tag == "a" and links)
                        and all(o.tag != tag for o in stack)):
                    continue
            elif tag != "body" and (tag not in ("article", "main") or ends(dropped[0])):
                if tag in UNNESTED and tag in dropped:
                    del dropped[dropped.index(tag):]
                if not closed and tag not in EMPTY and dropped[-1:] != ["title"]:
                    dropped.append(tag)
                continue
            dropped.clear()
        if tag in DROPPED:
            if not closed:
                dropped.append(tag)
        elif tag == "a":
            links = max(0, links - 1) if m["end"] else 1
        elif tag == "br":
            breaks += 1
            if breaks >= 2:
                block = None
            elif block is not None:
                block.parts.append(" ")
        elif tag in BLOCK_TAGS:
            block, breaks = None, 0
            if m["end"]:
                if tag in HEADINGS:
                    heading = False
                elif tag in CONTAINERS:      # ends a link left open inside
                    links = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                continue
            if stack[-1].tag == "p":     # a block ends an open paragraph
                stack.pop()
            heading = tag in HEADINGS
            top = stack[-1]
            own = _own_boiler(tag, m["attr"], top.article)
            boiler, article = top.boiler, top.article
            if boiler == "class" and own not in LIFTED:
                boiler = own or boiler
            if tag in ("article", "main") and not own:
                # left open, or wrapped around the page; an article in an article stays in its wrapper
                if (boiler in LIFTED and not (boiler == "class" and any(o.tag == "article" for o in stack))
                        or boiler == "promo" and tag == "main"):
                    boiler = ""
                    links = 0
                if not boiler and not article:
                    articles += 1
                    article = articles
            if tag not in VOID:
                stack.append(_Open(tag, boiler or own, article))
    say(page[at:])
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in blocks if b.text]


def first_pass(blocks: list[Block], rules: Rules) -> None:
    for b in blocks:
        words = _WORD.findall(b.text.lower())
        b.stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        size = len(b.text)
        if b.boiler or b.linked > rules.link_share * size:
            b.label = "bad"
        elif size >= rules.long and b.stops >= rules.stop_low or size >= rules.short and b.stops >= rules.stop_high:
            b.label = "good"
        elif size >= rules.long:
            b.label = "good" if b.article else "bad"
        else:
            b.label = ""


def second_pass(blocks: list[Block], rules: Rules) -> None:
    """Ambiguous blocks take over the label of the nearest block that pass one decided;
    inside an article, of those in the same article that are no boilerplate by place, and
    "bad" only from two near ones."""
    for number in {b.article for b in blocks}:
        run = [b for b in blocks if b.article == number and not (number and b.boiler)]
        before: list[tuple[int, str]] = []
        last: tuple[int, str] = (0, "")
        for i, b in enumerate(run):
            if b.label:
                last = (i, b.label)
            before.append(last)
        last = (0, "")
        new: list[str] = []
        for i in range(len(run) - 1, -1, -1):
            b = run[i]
            if b.label:
                last = (i, b.label)
                new.append(b.label)
                continue
            (left, a), (right, c) = before[i], last
            lean = "good" if b.stops >= rules.stop_high else "bad"
            if number:
                new.append("bad" if a == c == "bad" and max(i - left, right - i) <= rules.near else "good")
            elif a and c and a != c:
                new.append(a if i - left < right - i else c if right - i < i - left else lean)
            else:
                new.append(a or c or lean)
        for b, label in zip(reversed(run), new, strict=True):
            b.label = label


def main_blocks(page: str, rules: Rules = Rules()) -> list[str]:
    blocks = page_blocks(page)
    first_pass(blocks, rules)
    if any(b.article and not b.boiler for b in blocks):
        good = [(bool(b.article), len(b.text)) for b in blocks if b.label == "good"]
        if 2 * sum(n for inside, n in good if inside) >= sum(n for _, n in good):
            blocks = [b for b in blocks if b.article]
    second_pass(blocks, rules)
    return [b.text for b in blocks if b.label == "good"]


def main_text(page: str, rules: Rules = Rules()) -> str:
    return "\n".join(main_blocks(page, rules))


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 rules: Rules = Rules()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(v.as_py() or "", rules) for v in part.column(2)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)

    narrow = pages.select(field(id_col).cast("bigint").alias("page_id"), field(url_col).cast("string").alias("url"),
                          field(html_col).alias("html"))
    return map_arrow(narrow, run, "page_id bigint, url string, text string, n_chars bigint")
