"""Main text of web pages by two-pass block rules.

Pass one cuts the page into blocks and decides those it can by length, stop-word density and link density; the
container is one more input: what stands in a menu, footer, advert ... can't be text, what stands in an article
needs no stop words, and text outside an article that holds the page's text isn't it.  Pass two gives each block
that is undecided (mostly short ones) the label of its nearest decided neighbours.

Container names count as whole class or id tokens only (and a few compounds that end in one), and never cut an
ancestor of the page's main text.  Tags and attributes are read as browsers read them; the stack of open
elements is indexed, so the time is linear in the page however tags are nested.

Edge cases, each with a defined result: null or empty html, or html without text, gives an empty text; unclosed
tags, comments and attributes end as browsers end them; text without any tag is one block; very long pages are
read whole, a page at a time; repeated rows get equal results, one each; a tie between neighbours goes to the
later one for headings and to the earlier one for other blocks; an empty table gives an empty result; extra
columns, however named, are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent function words of four languages.
STOP = frozenset(
    """
a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more
no not of on one or our she so than that the their there they this to up was we were what when which who will with you
au aux avec ce cette ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour
que qui sa se ses son sur un une vous
als am auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nach
nicht noch nur oder sein sich sie sind so über um und von vor war wie wir wird zu zum zur
al como con del el ella en entre era es esta este ha la las lo los más me mi muy no nos o para pero por que se si sin
sobre su sus también un una y ya
""".split()
)
# Elements whose text never belongs to an article; those read as raw text; those that end a block.
OUT = frozenset("head title script style noscript template nav footer aside menu select option button textarea iframe object svg canvas dialog audio video label legend".split())
RAW = frozenset("script style textarea title iframe".split())
BLOCK = frozenset(
    """
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section
select summary table tbody td tfoot th thead title tr ul
""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Open elements that a block's start ends.
PARAGRAPH = frozenset(["p"])
CLOSES = {
    "li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "option": frozenset(["option"]),
    "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "tr": frozenset(["p", "td", "th", "tr"]),
}
#: An inline end tag doesn't reach across these.
SCOPES = frozenset("article main table".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Class and id tokens (without - and _) of containers that hold no article text.
NAMED_OUT = frozenset(
    """
ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments
commentlist commentform commentsection commentarea commentsarea consent cookie cookies cookienotice cookieconsent cookiebanner
cookiebar copyright disclaimer disqus footer gdpr legal login loginform masthead menu modal nav navbar navigation newsletter
notice notices overlay pager pagination popup promo promotion promoted recommended recommendedposts related relatedarticles
relatedlinks relatednews relatedposts replies reply respond search searchbar searchbox searchform share sharebar sharebuttons
sharelinks sharing sidebar signup signupform social socialbar socialicons sociallinks socialmedia socialshare sponsor sponsored
subscribe subscription toolbar widget widgets
""".split()
)
# Last words of compounds that mean the same; words that make a compound mean something else.
LAST_WORDS = frozenset("ad ads advert banner breadcrumb breadcrumbs comment comments consent footer menu modal nav navbar navigation newsletter notice overlay pagination popup sidebar toolbar widget widgets".split())
MODIFIERS = frozenset("has no non not with without is as show hide hidden in on after before tag category type format topic".split())
# Such tokens count inside an article when they are an id, and on an article element itself.
READERS = frozenset("ad ads advert advertisement comment comments commentlist commentsection disqus newsletter promo promoted related sidebar sponsored".split())
# Tokens that count outside an article only; tokens that name the article; roles.
OUTSIDE = frozenset("header siteheader pageheader topbar".split())
ARTICLE = frozenset("article articlebody articlecontent articletext blogpost entry entrybody entrycontent hentry main maincontent post postbody postcontent story storybody".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
ROLES_ARTICLE = frozenset("main article".split())

TEXT = re.compile(r"[^<]+")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?>"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>""")
ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
HUMP = re.compile(r"([a-z])([A-Z])")
WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

LINK_DENSITY, SHORT, STOP_DENSITY = 0.5, 70, 0.2
#: So many blocks of links in a row are a menu even in an article.
MENU = 3
#: Text outside an article stays text if it is in so many blocks and so many times as long.
ELSEWHERE, TIMES = 3, 4
GOOD, BAD, OPEN = 1, -1, 0


@dataclass(slots=True)
class Block:
    """One block: its text, the share of it in links, and where it stands."""

    text: str
    density: float
    out: bool  # in an element that holds no article text
    article: int  # number of the article around it, 0 outside
    cut: int  # number of the container around it that is out by its name, 0 for none
    heading: bool


@dataclass(slots=True)
class Page:
    """Blocks; the container around each named container; and the named containers that hold an article or h1."""

    blocks: list[Block]
    around: list[int]
    landmarks: set[int]
    forms: set[int]


def _attributes(raw: str) -> dict[str, str]:
    """Attributes by lower-case name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html_lib.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _plain(token: str) -> str:
    return token.replace("-", "").replace("_", "").lower()


def _says_out(token: str, whole: bool = False) -> bool:
    """Whether a class or id token names a container without article text."""
    if _plain(token) in NAMED_OUT:
        return True
    if whole:
        return False
    words = WORD.findall(HUMP.sub(r"\1 \2", token).lower())
    return len(words) > 1 and words[-1] in LAST_WORDS and MODIFIERS.isdisjoint(words)


def _evidence(name: str, attrs: dict[str, str], article: int) -> tuple[bool, bool, bool]:
    """(out for sure, out by name, an article) of an element."""
    role = attrs.get("role", "").strip().lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(INVISIBLE.search(attrs.get("style", "")))
    if hidden or role in ROLES_OUT and not (article and role == "banner"):
        return True, False, False
    classes, ids = attrs.get("class", "").split(), attrs.get("id", "").split()
    is_article = name in ("article", "main") or role in ROLES_ARTICLE or attrs.get("itemprop", "").lower() == "articlebody" or any(_plain(t) in ARTICLE for t in (*classes, *ids))
    if name in HEADINGS or name in ("a", "html", "body", "main"):  # ids of headings are anchors
        return False, False, is_article
    if name == "article":
        by_name = any(_plain(t) in READERS for t in (*classes, *ids))
    else:
        by_name = any(_says_out(t, is_article) for t in classes) or any((_plain(t) in READERS if article else _says_out(t, is_article)) for t in ids)
        by_name = by_name or not article and any(_plain(t) in OUTSIDE for t in (*classes, *ids))
    return False, by_name, is_article and not by_name


class _Reader:
    """Cuts a page into blocks.  The stack of open elements is indexed by name and by kind."""

    def __init__(self) -> None:
        self.page = Page([], [0], set(), set())
        self.stack: list[tuple[str, bool, int, int]] = []  # name and what to go back to
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.open_blocks: list[int] = []
        self.scopes: list[int] = []
        self.out, self.article, self.cut, self.articles = False, 0, 0, 0
        self.parts: list[str] = []
        self.linked = 0

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join(html_lib.unescape("".join(self.parts)).split())
        if text:
            heading = bool(self.open_blocks) and self.stack[self.open_blocks[-1]][0] in HEADINGS
            self.page.blocks.append(Block(text, min(1.0, self.linked / len(text)), self.out, self.article, self.cut, heading))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        if self.places["a"]:
            self.linked += len(raw.strip())

    def close_to(self, place: int) -> None:
        """Close the element at ``place`` and all in it."""
        while len(self.stack) > place:
            name, self.out, self.article, self.cut = self.stack.pop()
            self.places[name].pop()
            if name in BLOCK:
                self.open_blocks.pop()
            if name in SCOPES:
                self.scopes.pop()

    def end(self, name: str) -> None:
        places = self.places[name]
        if places and (name in BLOCK or not self.scopes or places[-1] > self.scopes[-1]):
            self.close_to(places[-1])

    def start(self, name: str, raw: str) -> None:
        if name in BLOCK:  # ends what it can't stand in
            ended = CLOSES.get(name, PARAGRAPH)
            while self.open_blocks and self.stack[self.open_blocks[-1]][0] in ended:
                self.close_to(self.open_blocks[-1])
        elif name == "a":
            self.end("a")
        if name in VOID or raw.endswith("/") and name in ("svg", "path", "use", "g", "rect", "circle"):
            return
        self.places[name].append(len(self.stack))
        if name in BLOCK:
            self.open_blocks.append(len(self.stack))
        if name in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((name, self.out, self.article, self.cut))
        attrs = _attributes(raw) if raw else {}
        sure, by_name, is_article = _evidence(name, attrs, self.article) if attrs or name in ("article", "main") else (False, False, False)
        if sure or name in OUT or name == "header" and not self.article:
            self.out = True
        elif by_name or name == "form":
            self.page.around.append(self.cut)
            self.cut = len(self.page.around) - 1
            if name == "form" and not by_name:
                self.page.forms.add(self.cut)
        elif is_article and not self.article:
            self.articles += 1
            self.article = self.articles
            self.page.landmarks.add(self.cut)
        elif name == "h1":
            self.page.landmarks.add(self.cut)


def read_page(page: str) -> Page:
    """The page's blocks in order."""
    reader, at, size = _Reader(), 0, len(page)
    while at < size:
        if m := TEXT.match(page, at):
            reader.text(m[0])
            at = m.end()
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = size if end < 0 else end + 3
            continue
        m = TAG.match(page, at)
        if m is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):  # a declaration or what browsers read as a comment
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            elif page[at + 1 : at + 2].isalpha() and page[at + 1].isascii():  # a tag that never ends
                break
            else:
                reader.text("<")
                at += 1
            continue
        at = m.end()
        name = m[2].lower()
        if name == "br":
            reader.parts.append(" ")
            continue
        if name in BLOCK:
            reader.end_block()
        if m[1]:
            reader.end(name)
        elif name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else size
        else:
            reader.start(name, m[3])
    reader.end_block()
    return reader.page


def _by_itself(b: Block) -> int:
    """Pass one for a block that stands in no article and nothing that is out."""
    if b.density > LINK_DENSITY:
        return BAD
    if len(b.text) < SHORT:
        return OPEN
    words = WORD.findall(b.text.lower())
    stops = sum(w in STOP for w in words) / max(1, len(words))
    if stops >= STOP_DENSITY and b.density < LINK_DENSITY / 2:
        return GOOD
    return OPEN if stops >= STOP_DENSITY / 2 else BAD


def _kept_names(page: Page, first: list[int]) -> set[int]:
    """Named containers around the page's main text: those around the one with an article or h1 that holds
    more text than stands outside of all of them.  A form needs no article, if it holds several good blocks."""
    inside, several = defaultdict(int), defaultdict(int)
    for b, label in zip(page.blocks, first, strict=True):
        if not b.out and (label == GOOD or b.article and b.density <= LINK_DENSITY):
            inside[b.cut] += len(b.text)
            several[b.cut] += 1
    able = {c for c in inside if c and (c in page.landmarks or c in page.forms and several[c] > 1)}
    best = max(able, key=lambda c: (inside[c], -c), default=0)
    kept: set[int] = set()
    if inside[best] > inside[0] or best and not inside[0]:
        while best:
            kept.add(best)
            best = page.around[best]
    return kept


def labels_of(page: Page) -> list[int]:
    """GOOD or BAD for each block, by both passes."""
    blocks = page.blocks
    first = [BAD if b.out else _by_itself(b) for b in blocks]
    kept = _kept_names(page, first)
    gone = [b.out or not _within(page, b.cut, kept) for b in blocks]
    links = 0
    for i, b in enumerate(blocks):
        if gone[i]:
            first[i] = BAD
        elif b.article:  # no stop words needed; links alone don't make a menu
            first[i] = GOOD if len(b.text) >= SHORT and b.density <= LINK_DENSITY else OPEN
        links = links + 1 if not gone[i] and b.density > LINK_DENSITY else 0
        if links >= MENU:
            first[i - links + 1 : i + 1] = [BAD] * links
    article = sum(len(b.text) for b, x in zip(blocks, first, strict=True) if b.article and x != BAD)
    free = [len(b.text) for b, x in zip(blocks, first, strict=True) if not b.article and x == GOOD]
    if article and not (len(free) >= ELSEWHERE and sum(free) > TIMES * article):
        first = [x if b.article or b.heading else BAD for b, x in zip(blocks, first, strict=True)]
    return _inherit([bool(b.article) and not x for b, x in zip(blocks, gone, strict=True)], [b.heading for b in blocks], first)


def _within(page: Page, cut: int, kept: set[int]) -> bool:
    """Whether all named containers around a block are kept; their numbers fall from inside to outside."""
    while cut:
        if cut not in kept:
            return False
        cut = page.around[cut]
    return True


def _inherit(inside: list[bool], heading: list[bool], first: list[int]) -> list[int]:
    """Pass two.  Open blocks take the label of the nearest decided block; in an article, only of one that is
    part of an article too.  On a tie a heading takes the later one's, another block the earlier one's.  With no
    such block a block is text.
    """
    n, out = len(first), list(first)
    for region in (True, False):
        decided = [bool(x) and (inside[i] or not region) for i, x in enumerate(first)]
        before, last = [None] * n, None
        for i in range(n):
            before[i] = last
            last = i if decided[i] else last
        after = None
        for i in range(n - 1, -1, -1):
            if not first[i] and inside[i] == region:
                near = [j for j in ((after, before[i]) if heading[i] else (before[i], after)) if j is not None]
                out[i] = first[min(near, key=lambda j: abs(i - j))] if near else GOOD
            after = i if decided[i] else after
    return out


def main_text(page: str | None) -> str:
    """The kept blocks in page order, joined by one space."""
    if not page:
        return ""
    found = read_page(page)
    return " ".join(b.text for b, x in zip(found.blocks, labels_of(found), strict=True) if x == GOOD)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, main text and its length in code points, page by page, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, url, "text", "n_chars"],
                )

    kinds = dict(pages.dtypes)
    return pages.select(id_col, url, html).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url}` {kinds[url]}, text string, n_chars long")
