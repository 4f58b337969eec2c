"""Main text of web pages, with site templates found by counting subtrees per host.

Pass 1 parses every page and hashes each element's subtree (tag, class, text, children) that
lies outside an article or is a box inside one; Spark counts, per host, on how many pages of different content each
hash occurs. Subtrees on a large share of these pages are its template. Pass 2 parses again, deletes template subtrees and
everything that is no article text by its tag, role or class, and writes the blocks left.

One rule holds for hosts of every size: the lower end of the confidence interval of the share
is SHARE or more. So four pages that all have a subtree suffice, and on a large host a fifth
of the pages. Pages are told apart by the least hash of their runs of five words, which near
copies mostly have in common: a group of near copies counts as few pages.

Where a page marks its article (`article`, `main`, role main, or a usual content class), only
that is text. Inside an article only boxes (div, section, lists) that recur word for word are
templates: a passage in p, blockquote, pre or table that many articles quote stays, and so does
a box that holds a passage of PASSAGE_WORDS words or more outside links. Recurring boxes that together
carry more than half of an article are its text and stay. Without
such a mark the body is the root, and templates go. The structure of link lists and of
elements whose class hints at no article is counted as well, without its text and with its
place, so that menus whose words vary recur too.

Template hashes are few per host (at most pages' elements / SHARE); they are broadcast while
their number is under `MOST_BROADCAST`, else joined on the host.

Defined cases: NULL and empty pages have an empty text. Pages with a NULL or hostless url
share the host "". Broken markup never fails: unclosed elements end with their container,
stray end tags are ignored. Repeated rows get equal results; copies of a page on a host count once.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches, written
from .url_filter import host_of
from .words import grams, word_hashes

SHARE = 0.2         # of the host's pages of different content
DEVIATIONS = 4.0    # of the share, to the lower end of its interval
PASSAGE_WORDS = 25  # words outside links that make a recurring box article text
SKETCH_WORDS = 5
MOST_BROADCAST = 100_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form header html "
    "main menu nav ol section table td th ul".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
          "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}

# What is no article text.
DROPPED_TAGS = frozenset(
    "aside button canvas dialog datalist footer form head iframe input menu nav noscript object "
    "script select style svg template textarea title".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
    "toolbar".split())
DROPPED_CLASSES = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login social share "
    "sharing related recommended breadcrumb breadcrumbs pagination pager comment comments disqus "
    "respond replies search toolbar widget masthead copyright".split())
COMMENT_CLASSES = frozenset("comment comments disqus respond replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements of an article that may be boxes of the site; passages stand in others.
BOX = frozenset("center details div dl fieldset menu ol section ul".split())
CONTENT_CLASSES = frozenset("content article post entry story main maincontent".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
                   r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
                   r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
TELLING = re.compile(r"(?i)\b(?:class|id|role|hidden|aria-hidden|style)\b")
KNOWN: dict[tuple[str, str, bool], tuple[str, bool, bool, str]] = {}       # kinds of tags seen; bounded
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


DEMOTED = 0.9       # rank of an article that lies in a named element


class _Element:
    __slots__ = ("tag", "kind", "hint", "talk", "blocks", "hashed", "parts", "heading", "title",
                 "before", "inside", "classed", "linked", "total", "path", "forms", "passage")

    def __init__(self, tag, kind, blocks, hashed, parts):
        self.tag, self.kind, self.blocks = tag, kind, blocks
        self.hashed, self.parts, self.heading, self.title = hashed, parts, False, False
        self.passage = False
        self.path, self.forms = 0, []       # for hashes of the structure without text
        self.before = None          # text of the block around a dropped inline element


def _code(source: str) -> int:
    """Code of a text."""
    return int.from_bytes(hashlib.blake2b(source.encode("utf-8", "replace"),
                                          digest_size=8).digest(), "big", signed=True)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "")
            for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def _kind(tag: str, own: dict[str, str], inside: bool) -> tuple[str, bool, bool]:
    """dropped, named, content, header (inside an article), class, or plain; hint; comments.

    An element is named by a whole class or id; a word inside a longer one is only a hint.
    """
    classes = own.get("class", "").lower()
    name = "" if tag == "section" else own.get("id", "").lower()
    tokens = {*classes.split(), *name.split()} if own else set()
    words = set(re.split(r"[^a-z0-9]+", f"{classes} {name}")) if own else set()
    role = own.get("role", "").lower()
    talk = bool(tokens & COMMENT_CLASSES)
    if tag in ("body", "html"):
        return "plain", False, False
    if tag in ("article", "main") or role == "main":
        own_comment = talk or any(t.startswith("comment-") for t in tokens)
        return "dropped" if own_comment else "content", False, talk
    if tag == "header":
        return "header" if inside else "dropped", False, talk
    hidden = "hidden" in own or own.get("aria-hidden") == "true" \
        or "display:none" in own.get("style", "").replace(" ", "").lower()
    if tag in DROPPED_TAGS or role in DROPPED_ROLES or hidden:
        return "dropped", False, talk
    if tag in HEADINGS:
        return "plain", False, talk
    if tokens & DROPPED_CLASSES:
        kind = "named" if tag in BLOCK else "plain" if "-" in tag else "dropped"
        return kind, False, talk
    hint = bool(words & DROPPED_CLASSES)
    if tag in ("div", "section") and (tokens & CONTENT_CLASSES or not hint and words & CONTENT_CLASSES):
        return "class", False, talk
    return "plain", hint, talk


class Page:
    """One pass over a page.

    `template` holds the hashes of subtrees to delete. With `only_hashes` subtrees are hashed
    and the text of articles is passed over.
    """

    def __init__(self, source: str, template: frozenset[int] = frozenset(),
                 only_hashes: bool = False):
        self.template, self.only = template, only_hashes
        self.hashing = only_hashes or bool(template)
        self.blocks: list[tuple[int, str]] = []     # (rank of the root it lies in, text)
        self.text: list[str] = []
        self.stack: list[_Element] = []
        self.dropped = self.content = self.classed = self.inline = 0
        self.linked = self.total = 0                # characters in links, and all
        self.link = -1                              # open elements at the start of a link
        self.hashes: set[int] = set()
        self.plain: list[str] = []                  # with `only_hashes`: all text that is not dropped
        self.recurring: list[tuple[int, int]] = []  # blocks of recurring boxes of the open article
        self._walk(source)

    # 2 inside a marked article, 1 inside an element with a content class, 0 elsewhere
    def _rank(self) -> int:
        return 2 if self.content else 1 if self.classed else 0

    def _flush(self) -> None:
        if self.text:
            if self.only and not self.dropped:
                self.plain.extend(self.text)
                self.plain.append(" ")
            if self.content and self.only and not self.stack[-1].hashed:
                self.text = []          # of an article only boxes are hashed
                return
            line = "".join(self.text)
            line = " ".join((html.unescape(line) if "&" in line else line).split())
            if line:
                if self.stack and self.stack[-1].hashed:
                    self.stack[-1].parts.append(line)
                if not self.dropped:
                    self.blocks.append((self._rank(), line))
                    if self.template and self.content:
                        self._mark_passage(line)
            self.text = []

    def _mark_passage(self, line: str) -> None:
        """A long block outside links makes the open boxes of the article hold article text."""
        e = self.stack[-1]
        if 2 * (self.linked - e.linked) <= self.total - e.total and line.count(" ") + 1 >= PASSAGE_WORDS:
            for e in self.stack:
                e.passage |= e.inside

    def _cut(self, start: int) -> None:
        """Delete the blocks from `start` on."""
        del self.blocks[start:]
        self.recurring = [r for r in self.recurring if r[0] < start]

    def _settle(self, start: int) -> None:
        """At the end of an article: its recurring boxes go unless they are most of its text."""
        chosen = {k for a, b in self.recurring for k in range(a, b)}
        self.recurring = []
        size = sum(len(self.blocks[k][1]) for k in chosen)
        if 2 * size <= sum(len(t) for _, t in self.blocks[start:]):
            self.blocks[start:] = [b for k, b in enumerate(self.blocks[start:], start) if k not in chosen]

    def _open(self, tag: str, source: str) -> None:
        key = (tag, source, self.content > 0)
        known = KNOWN.get(key)
        if known is None:
            own = _attributes(source)
            known = (*_kind(tag, own, self.content > 0), own.get("class", ""))
            if len(KNOWN) < 10_000:
                KNOWN[key] = known
        kind, hint, talk, classes = known
        apart = tag not in BLOCK and kind == "dropped"
        if not apart and (tag in BLOCK or kind != "plain"):
            self._flush()
        # hashed: what lies outside an article, and boxes inside it with all they hold
        above = self.stack[-1] if self.stack else None
        hashed = self.hashing and kind != "content" and tag in BLOCK and (
            not self.content or tag in BOX or above.hashed)
        e = _Element(tag, kind, len(self.blocks), hashed, [tag, classes] if hashed else [])
        e.hint, e.talk, e.inside, e.classed = hint, talk, self.content > 0, self.classed > 0
        e.linked, e.total = self.linked, self.total
        if self.hashing:
            e.path = zlib.crc32(f"{tag} {classes}/".encode("utf-8", "replace"), above.path if above else 0)
        self.stack.append(e)
        if apart:
            self.stack[-1].before, self.text = self.text, []
        self.dropped += kind == "dropped"
        self.content += kind == "content"
        self.classed += kind == "class"
        self.inline += tag not in BLOCK
        if tag in HEADINGS:
            for e in self.stack:
                e.heading = True
                e.title |= tag == "h1"

    def _close(self) -> None:
        e = self.stack[-1]
        if e.before is not None:
            self.text = e.before
        elif e.tag in BLOCK or e.kind != "plain":
            self._flush()
        self.stack.pop()
        self.dropped -= e.kind == "dropped"
        self.content -= e.kind == "content"
        self.classed -= e.kind == "class"
        self.inline -= e.tag not in BLOCK
        if len(self.stack) < self.link:
            self.link = -1
        if e.kind == "header" and not e.heading:
            self._cut(e.blocks)
        if e.kind == "content" and not self.content and self.recurring:
            self._settle(e.blocks)
        same = alike = False
        linked = 2 * (self.linked - e.linked) > self.total - e.total
        if e.hashed:
            text = "\x1f".join(e.parts)
            code = _code(text)
            if len(e.parts) > 2 and (not e.inside or e.tag in BOX):
                self.hashes.add(code)
                same = code in self.template
            form = zlib.crc32(",".join([*e.parts[:2], *map(str, e.forms)]).encode("utf-8", "replace"))
            if e.hint or e.kind == "named" and e.inside or linked and not e.inside and not self.dropped:
                code_ = _code(f"form {e.path} {form}")
                self.hashes.add(code_)
                alike = code_ in self.template
            if self.stack and self.stack[-1].hashed:
                self.stack[-1].parts.append(str(code))
                if self.stack[-1].forms[-1:] != [form]:         # rows of equal ones count as one
                    self.stack[-1].forms.append(form)
        if e.tag in BLOCK and len(self.blocks) > e.blocks:
            self._judge(e, same, alike, linked)

    def _judge(self, e: _Element, same: bool, alike: bool, linked: bool) -> None:
        """Delete the blocks of an element that is a template or a named part of the site.

        Outside an article: what recurs word for word or is named goes; a hint asks for links or
        a recurring structure, links for a recurring structure. An article in a named element
        gets a lower rank. Inside an article: boxes of links that recur word for word, hints as
        before, and named elements, which ask for a second sign if they hold a heading; other
        boxes that recur and hold no passage wait for the end of the article.
        """
        own = self.blocks[e.blocks:]
        weak = e.hint and (linked or alike)
        if e.inside:
            if e.kind == "named":
                goes = not e.heading or e.talk or linked or same or alike
            else:
                goes = e.tag in BOX and (weak or same and linked)
            if goes:
                self._cut(e.blocks)
            elif same and e.kind != "named" and e.tag in BOX and not e.passage:
                self.recurring.append((e.blocks, len(self.blocks)))
        elif e.kind == "named":
            self.blocks[e.blocks:] = [(DEMOTED, t) for r, t in own if r in (2, DEMOTED)]
        elif same:
            self.blocks[e.blocks:] = [b for b in own if b[0] in (2, DEMOTED)]
        elif (weak or alike and linked) and not e.title:
            self.blocks[e.blocks:] = [b for b in own if b[0] > e.classed]

    def _end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._close()
                return
            if tag not in CONTAINER and self.stack[k].tag in CONTAINER:
                return

    def _start(self, tag: str, source: str) -> None:
        closes = CLOSES.get(tag, frozenset())
        closes = closes | {"p"} if tag in BLOCK else closes
        if closes:
            stop = {"ul", "ol", "menu"} if tag == "li" else {"table"} if tag[0] == "t" else {"dl"}
            stop = stop if tag in CLOSES else CONTAINER
            for k in range(len(self.stack) - 1, -1, -1):
                here = self.stack[k].tag
                if here in closes:
                    while len(self.stack) > k:
                        self._close()
                elif here in stop or here in CONTAINER and here not in ("td", "th"):
                    break
        self._open(tag, source)

    def _walk(self, source: str) -> None:
        at, lower = 0, None
        while True:
            m = TOKEN.search(source, at)
            if not m:
                break
            if m.start() > at:
                piece = source[at:m.start()]
                self.text.append(piece)
                if not self.dropped and not piece.isspace():
                    self.total += len(piece)
                    self.linked += len(piece) if self.link >= 0 else 0
            at = m.end()
            close, tag, own = m.group(1, 2, 3)
            if tag is None:             # a comment, or a tag with an open quote
                close, tag, own = m.group(4, 5, 6)
                if tag is None:
                    continue
            tag = tag.lower()
            inline = tag not in BLOCK and tag not in VOID and tag not in RAW
            if tag == "a" and (close or "href" in own):
                self.link = -1 if close else len(self.stack)
            # plain inline elements leave no trace, unless they may end an inline one that does
            if inline and not self.inline and (close or tag not in DROPPED_TAGS
                                               and not TELLING.search(own)):
                continue
            if close:
                if tag in BLOCK:
                    self._flush()
                self._end(tag)
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self.text.append(" ")
            elif tag in RAW:
                lower = lower or source.lower()
                end = lower.find(f"</{tag}", at)
                at = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
            elif own.endswith("/") and any(e.tag == "svg" for e in self.stack):
                continue
            else:
                self._start(tag, own)
        self.text.append(source[at:])
        while self.stack:
            self._close()
        self._flush()

    def main_text(self) -> str:
        best = max((r for r, _ in self.blocks), default=0)
        size = lambda rank: sum(len(t) for r, t in self.blocks if r == rank)
        if best == DEMOTED and size(best) < size(0):
            best = 0
        return "\n".join(t for r, t in self.blocks if r == best)


def _sketches(texts: list[str]) -> list[int]:
    """The least hash of a text's runs of five words; 0 without words."""
    hashes, bounds = word_hashes(pa.array(texts, pa.string()))
    runs, first = grams(hashes, bounds, SKETCH_WORDS)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.minimum.reduceat(runs, first[some])
    return out.view(np.int64).tolist()


def _subtrees(batches):
    """host, code, page: the codes of a page's subtrees, and one row with a NULL code a page."""
    for batch in batches:
        pages = [Page(h or "", only_hashes=True) for h in batch.column("html").to_pylist()]
        sketches = _sketches(["".join(p.plain).encode("utf-8", "replace").decode() for p in pages])
        rows = list({(host, code, sketch)
                     for host, page, sketch in zip(batch.column("host").to_pylist(), pages, sketches)
                     for code in (None, *page.hashes)})
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()),
                               pa.array([r[1] for r in rows], pa.int64()),
                               pa.array([r[2] for r in rows], pa.int64())],
                              ["host", "code", "page"])


def _lower_end(found: Column, tried: Column) -> Column:
    """Lower end of the score interval of found / tried."""
    share, z = found / tried, DEVIATIONS
    spread = F.sqrt(share * (1 - share) / tried + z * z / (4 * tried * tried))
    return (share + z * z / (2 * tried) - z * spread) / (1 + z * z / tried)


def templates(pages: DataFrame, url: str = "url", source: str = "html", share: float = SHARE) -> DataFrame:
    """host, codes: hashes of subtrees on that share of the host's pages of different content."""
    rows = modest_batches(pages).select(host_of(F.col(url)).alias("host"), F.col(source).alias("html"))
    found = (rows.mapInArrow(_subtrees, "host string, code bigint, page bigint")
             .groupBy("host", "code").agg(F.countDistinct("page").alias("pages"))
             .where((F.col("pages") > 1) | F.col("code").isNull()))
    found = written(found, "subtrees")
    sizes = found.where(F.col("code").isNull()).select("host", F.col("pages").alias("all"))
    return (found.where(F.col("code").isNotNull()).join(sizes, "host")
            .where(_lower_end(F.col("pages"), F.col("all")) >= share)
            .groupBy("host").agg(F.sort_array(F.collect_set("code")).alias("codes")))


def _texts(batches):
    for batch in batches:
        out = []
        for source, codes in zip(batch.column("html").to_pylist(),
                                 batch.column("codes").to_pylist()):
            out.append(Page(source or "", frozenset(codes or ())).main_text())
        yield pa.record_batch([batch.column("page_id"), batch.column("url"),
                               pa.array(out, pa.string()),
                               pa.array(map(len, out), pa.int64())],
                              ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url",
               source: str = "html", share: float = SHARE,
               most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text and its number of characters, for every page."""
    found = written(templates(pages, url, source, share), "templates")
    size = found.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        F.col(source).alias("html"), host_of(F.col(url)).alias("host"))
    rows = rows.join(F.broadcast(found) if size <= most_broadcast else found, "host", "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "codes").mapInArrow(
        _texts, f"page_id {kind}, url string, text string, n_chars bigint")
