"""HTML extraction (1): page structure and, for each host, suffix arrays over its pages' token streams.

A page is cut into blocks. Blocks in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by
their elements and names. What is left of a host's pages is two long streams of tokens, that in marked articles and that outside of
them. A suffix array puts a stream's suffixes in order by their first LONG tokens: neighbours whose common prefix is so long are one
group. A token is in a substring of LONG tokens or more that is on so many pages if, and only if, it is in such a substring of just
LONG tokens, so no deeper order is needed. Tokens in groups on enough distinct pages are boilerplate: they go and unique runs stay.

Structure is the prior: outside an article three pages of the host are enough; in one, half of the host's pages and ten at least, and
a page of whose article that is the larger part is a copy and keeps it whole. Beside a marked article that is a small share of the
page, long unique runs of the rest stay too.

A large host is dealt to shards by bytes, with arrays each; the hashes of what each array's groups start with meet in key ranges of
the host, which add up their pages and answer each shard.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.llm.common import checkpointed, shuffle_partitions, slices, small, tidy
from contactsheet.llm.packing import cuts, deflated, inflated, tally
from contactsheet.llm.url_filter import split_url
from contactsheet.llm.words import hashes, mix

#: Tokens that a repeated substring has at least, and the distinct pages of the host that it is on at least.
LONG, PAGES = 8, 3
#: The same pages for text in marked articles, and the share of the host's pages; the share of an article's tokens up to which such
#: text goes (above, the page is a copy); the share of its pages from which a shard reports such text.
MARKED_PAGES, MARKED_HOST, COPY_SHARE, REPORTED = 10, 0.5, 0.5, 0.25
#: Below this share of a page's tokens a marked article isn't all of its text; unmarked unique runs of so many tokens are kept then.
MARKED_SHARE, LONG_PLAIN = 0.25, 20
#: HTML of a host's pages that is a shard with suffix arrays of its own; HTML of a task that is parsed and packed at once.
SHARD_BYTES, PACK_BYTES = 8 << 20, 32 << 20
#: Key ranges of a host with shards, at least, and one more for so many shards.
LEAST_BUCKETS, BUCKET_SHARDS = 16, 8
#: Bits of a hash that are left out.
CUT = np.uint64(16)
#: Hosts of at most so many are broadcast with their counts; more are joined.
BROADCAST_HOSTS = 100_000

#: Elements by what they mean for the text, and names that mark what isn't the article.
RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "xmp"}
DROPPED = {
    "nav", "footer", "aside", "menu", "dialog", "button", "head", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "select",
}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "tfoot", "thead", "tr", "ul",
} | HEADINGS
SPACED = {"br", "td", "th", "img", "wbr", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
COMMENT_NAMES = {"comment", "comments", "disqus", "reply", "replies", "respond"}
CHROME_NAMES = COMMENT_NAMES | {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "cookie", "cookies", "consent",
    "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "widget", "pagination", "pager", "skip", "toolbar",
}
#: Of these also as the first word of a class (ad-slot, comment-list), not as the last or only one alone.
FIRST_NAMES = COMMENT_NAMES | {
    "ad", "ads", "advert", "advertisement", "sponsored", "cookie", "cookies", "gdpr", "consent", "newsletter", "nav", "navbar", "menu", "breadcrumb",
    "breadcrumbs", "sidebar", "footer", "related", "share", "sharing", "pagination", "popup", "modal", "widget",
}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

#: Names that articles also give to parts of their own: in one they count only as the whole of a class.
OWN_NAMES = {
    "share", "sharing", "social", "widget", "login", "signup", "menu", "header", "masthead", "notice", "banner", "overlay", "modal", "popup", "skip", "toolbar",
    "subscription", "promotion", "navigation", "pager", "consent", "adv",
}
_CAPITALS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_COMMENTS = re.compile(r"(comment|reply|disqus)s?(list|thread|section|area|form|box|wrapper|container|block)")
_HIDDEN = re.compile(r"(?i)\b(display\s*:\s*none|visibility\s*:\s*hidden)\b")
#: What ends a tag, and the quoted values in which that means nothing; an attribute with its value.
_END = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')|>")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_WORDS = re.compile(r"[^\W_]+")
CHROME, MARKED, PLAIN = 0, 1, 2
#: What an element closes by its start, as in HTML, and the elements around it that this doesn't reach across.
_ROW, _TABLE = ("td", "th"), ("table",)
_LIST = tuple(BLOCKS - {"address", "div", "p", "li", "dd", "dt", "hr"}) + _ROW
CLOSES = {
    "li": (("li",), (*_LIST, "dd", "dt")), "dd": (("dd", "dt"), (*_LIST, "li")), "dt": (("dd", "dt"), (*_LIST, "li")), "td": (_ROW, ("tr", *_TABLE)),
    "th": (_ROW, ("tr", *_TABLE)), "tr": (("tr", *_ROW), _TABLE), "option": (("option",), tuple(BLOCKS)),
}
CLOSES |= {x: (("tbody", "thead", "tfoot", "tr", *_ROW), _TABLE) for x in ("tbody", "thead", "tfoot")}
#: What the closing tags of such elements don't reach across.
WITHIN = {"li": ("ul", "ol", "menu", "dir", *_TABLE), "dd": ("dl", *_TABLE), "dt": ("dl", *_TABLE)} | dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot"), _TABLE)


class Open:
    """The open elements: of each its name, and whether what is around it is in chrome and in an article. Where the last one of a name
    stands is known at once, at any depth."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, chrome: bool, article: bool) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, chrome, article))

    def last(self, names: tuple[str, ...]) -> int:
        """The place of the last one of some names, -1 without."""
        return max((places[-1] for x in names if (places := self.at.get(x))), default=-1)

    def first_after(self, names: tuple[str, ...], place: int) -> int:
        """The place of the first one of some names that comes after a place, -1 without."""
        found = [places[i] for x in names if (places := self.at.get(x)) and (i := bisect_right(places, place)) < len(places)]
        return min(found, default=-1)

    def closed_by(self, name: str) -> int:
        """Which one a closing tag closes: inline tags don't reach across blocks, those of lists and tables not across these; -1: none."""
        i = self.last((name,))
        over = self.last(WITHIN[name]) if name in WITHIN else self.blocks[-1] if self.blocks and name not in BLOCKS and name not in _ROW else -1
        return i if i > over else -1

    def cut(self, place: int) -> tuple[bool, bool]:
        """Closes the element at a place and all in it; what is around it."""
        for name, _, _ in self.stack[place:]:
            self.at[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
        _, chrome, article = self.stack[place]
        del self.stack[place:]
        return chrome, article


@dataclass
class Page:
    """Blocks of a page in order, as texts, and what each is: CHROME, MARKED (in an article) or PLAIN."""

    texts: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)


#: What an element does to the text in it: nothing; it isn't text; only its headings are; it isn't, but for an article in it.
NOTHING, OUT, HEADS, FORM = range(4)


def _parts(name: str) -> list[str]:
    """The words of a name, cut at signs and before capitals, in lower case."""
    return [w.lower() for part in _WORDS.findall(name) for w in (_CAPITALS.findall(part) if part.isascii() else [part])]


def _named(value: str, by_class: bool, in_article: bool, block: bool, comments_only: bool) -> int:
    """What the names of a class or an id do to an element.

    Comments are known by a name's first word too, in ids as in classes. Else outside of articles a name counts as a whole, by its last
    word, and by its first one of FIRST_NAMES, an id only as a whole. In an article names are asked of blocks and cells alone, words that articles
    use for their own parts count only as the whole of a class, and what is named a header keeps its headings.
    """
    for name in value.split():
        low, words = name.lower(), _parts(name)
        if not words or in_article and not block:
            continue
        if low in COMMENT_NAMES or words[0] in COMMENT_NAMES or by_class and words[-1] in COMMENT_NAMES or _COMMENTS.fullmatch(low):
            return OUT
        if comments_only:
            continue
        whole, last, first = low in CHROME_NAMES, by_class and words[-1] in CHROME_NAMES, by_class and words[0] in FIRST_NAMES
        if not in_article:
            if whole or last or first:
                return OUT
        elif by_class and words[-1] == "header":
            return HEADS
        elif whole and (by_class or low not in OWN_NAMES) or last and words[-1] not in OWN_NAMES or first and words[0] not in OWN_NAMES:
            return OUT
    return NOTHING


def _effect(name: str, attributes: str, in_article: bool) -> int:
    if name in DROPPED:
        return OUT
    if name == "header":
        return HEADS if in_article else OUT
    found = FORM if name == "form" else NOTHING
    if attributes and name not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "style" and _HIDDEN.search(value) or key == "hidden" and name not in HEADINGS:
                return OUT
            if name in HEADINGS:
                continue
            if key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in CHROME_ROLES:
                return OUT
            if key in ("class", "id") and (effect := _named(value, key == "class", in_article, name in BLOCKS or name in _ROW, name in ARTICLE)) != NOTHING:
                if effect == OUT:
                    return OUT
                found = effect
    return found


class Tags:
    """The tags of a page from left to right, each with the text before it; no part is read more often than a few times."""

    def __init__(self, html: str):
        self.html, self.at, self.quotes, self.unclosed = html, 0, True, set()

    def _end(self, at: int) -> int:
        """Where a tag's > is; quoted values are stepped over, unless one was left open in this page. -1: nowhere."""
        while self.quotes:
            m = _END.search(self.html, at)
            if not m:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                at = m.end()
        return self.html.find(">", at)

    def next(self) -> tuple[str, str, bool, str] | None:
        """Text, name (empty: a comment or the like), whether it closes, attributes; None after the last."""
        html, at = self.html, self.at
        if at >= len(html):
            return None
        m = _OPEN.search(html, at)
        if not m:
            self.at = len(html)
            return html[at:], "", False, ""
        text, start = html[at : m.start()], m.start()
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            self.at = end + 3 if end >= 0 else len(html)
            return text, "", False, ""
        closing = html.startswith("</", start)
        name = _NAME.match(html, start + 1 + closing)
        if not name:  # a declaration; </ without a name
            end = html.find(">", start)
            self.at = end + 1 if end >= 0 else len(html)
            return text, "", False, ""
        end = self._end(name.end())
        if end < 0 and (start := html.find(">", name.end())) >= 0:
            end = start
        self.at = end + 1 if end >= 0 else len(html)
        return text, name[0].lower() if end >= 0 else "", closing, html[name.end() : end] if end >= 0 else ""

    def skip(self, name: str) -> None:
        """Steps over the rest of an element whose content isn't markup; one that isn't closed ends with the page."""
        if name not in self.unclosed:
            m = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(self.html, self.at)
            if m:
                self.at = m.end()
                return
            self.unclosed.add(name)
        if name in ("script", "style"):
            self.at = len(self.html)


def parse(html: str | None) -> Page:
    """The blocks of a page. An element that isn't closed reaches to the end of the one around it, or to one that closes it by its start
    (list items, cells, rows); a closing tag without an opening one means nothing, nor does a slash at an opening tag's end."""
    page, tags, opened = Page(), Tags(html or ""), Open()
    parts: list[str] = []
    effect, article, loose = NOTHING, False, False  # loose: a paragraph that isn't text, until the next block

    def close() -> None:
        nonlocal parts
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                page.texts.append(text)
                page.kinds.append(CHROME if effect or loose else MARKED if article else PLAIN)
            parts = []

    while (tag := tags.next()) is not None:
        text, name, closing, attributes = tag
        if text:
            parts.append(text)
        if not name:
            continue
        if name in RAW:
            if not closing:
                tags.skip(name)
            continue
        if name in BLOCKS:
            close()
            loose = False
        elif name in SPACED:
            parts.append(" ")
        if name == "p" and not closing:
            loose = _effect(name, attributes, article) == OUT
        if name in VOID or name == "p":
            continue
        place = opened.closed_by(name) if closing else opened.first_after(CLOSES[name][0], opened.last(CLOSES[name][1])) if name in CLOSES else -1
        if place >= 0:
            if opened.stack[place][1] != effect:
                close()
            effect, article = opened.cut(place)
        if not closing:
            own = _effect(name, attributes, article)
            here = own if effect == NOTHING or effect == FORM and (own == OUT or name in ARTICLE) else effect
            here = NOTHING if effect == HEADS and name in HEADINGS else here
            if here != effect:
                close()
            opened.push(name, effect, article)
            effect, article = here, article or name in ARTICLE
    close()
    return page


def suffix_groups(tokens: np.ndarray, pages: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where substrings of so many tokens start, in the suffix array's order; the group of equal ones that each is in; the distinct pages of each group.

    The suffixes are put in order by their first long tokens, by doubling; suffixes with equal starts then stand together.
    """
    n, none = len(tokens), np.zeros(0, np.int64)
    if n < long:
        return none, none, none
    rank, span = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while span < long:
        step = min(span, long - span)
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[0], np.diff(key[order]) > 0]), dtype=np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = new
        span += step
    inside = np.zeros(n, bool)
    inside[: n - long + 1] = pages[: n - long + 1] == pages[long - 1 :]
    order = order[inside[order]]
    if not len(order):
        return none, none, none
    groups, at = rank[order], pages[order]
    by = np.lexsort((at, groups))
    groups, at, order = groups[by], at[by], order[by]
    new_group = np.concatenate([[True], groups[1:] != groups[:-1]])
    distinct = np.add.reduceat((new_group | np.concatenate([[True], at[1:] != at[:-1]])).astype(np.int64), np.flatnonzero(new_group))
    return order, np.cumsum(new_group) - 1, distinct


def cover(n: int, starts: np.ndarray, long: int = LONG) -> np.ndarray:
    """Which of n tokens are in a substring of so many tokens that starts at one of the starts."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + long, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated(tokens: np.ndarray, pages: np.ndarray, long: int = LONG, least: int = PAGES) -> np.ndarray:
    """Which tokens are in a substring of so many tokens or more that is on so many distinct pages."""
    starts, group, distinct = suffix_groups(tokens, pages, long)
    return cover(len(tokens), starts[distinct[group] >= least], long)


class Stream:
    """Tokens of a shard's pages, each token with its page, and the groups that the suffix array finds."""

    def __init__(self, tokens: np.ndarray, pages: np.ndarray):
        self.tokens = tokens
        self.starts, self.group, self.distinct = suffix_groups(tokens, pages)

    def keys(self) -> np.ndarray:
        """The hash of what each group starts with."""
        first = self.starts[np.flatnonzero(np.diff(self.group, prepend=-1))]
        out = np.zeros(len(first), np.uint64)
        for k in range(LONG):
            out = mix(out + self.tokens[first + k])
        return out >> CUT

    def covered(self, distinct: np.ndarray, least: int) -> np.ndarray:
        """The tokens in what is on so many pages, with the pages of each group."""
        return cover(len(self.tokens), self.starts[distinct[self.group] >= least])


class Shard:
    """Pages of a host. ids: of each page; rows that share one are one page, those without one are each their own."""

    def __init__(self, ids: list, pages: list[Page]):
        data = " ".join(x for page in pages for x in page.texts).encode()
        size = np.array([x.count(" ") + 1 for page in pages for x in page.texts], np.int64)
        data = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(data == 32)
        self.tokens = hashes(data, np.append(0, space + 1), np.append(space, len(data))) if len(data) else np.zeros(0, np.uint64)
        self.blocks = np.array([len(page.texts) for page in pages], np.int64)
        number: dict = {}
        own = [number.setdefault(("row", n) if i is None else i, n) for n, i in enumerate(ids)]
        self.marked = np.repeat(np.array([k == MARKED for page in pages for k in page.kinds], bool), size)
        owner = np.repeat(np.repeat(np.array(own, np.int64), self.blocks), size)
        self.pages = len(number)
        self.plain, self.inside = (Stream(self.tokens[x], owner[x]) for x in (~self.marked, self.marked))

    def reported(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each stream: the hashes of the groups that other shards have to know, and their pages. Of articles that is text on many pages."""
        often = self.inside.distinct >= REPORTED * self.pages
        return [(self.plain.keys(), self.plain.distinct), (self.inside.keys()[often], self.inside.distinct[often])]

    def covered(self, plain: np.ndarray, inside: np.ndarray, host_pages: int) -> np.ndarray:
        """The tokens that are boilerplate. plain, inside: of each group of the streams, the distinct pages of the host that have it."""
        out = np.zeros(len(self.tokens), bool)
        out[~self.marked] = self.plain.covered(plain, PAGES)
        out[self.marked] = self.inside.covered(inside, max(MARKED_PAGES, math.ceil(MARKED_HOST * host_pages)))
        return out


def main_texts(pages: list[Page], marked: np.ndarray, covered: np.ndarray) -> list[tuple[str, int]]:
    """Of each page: its main text, and how many of its tokens are boilerplate. marked, covered: of the tokens of all pages."""
    out, at = [], 0
    for page in pages:
        blocks = [(text.split(" "), kind == MARKED) for text, kind in zip(page.texts, page.kinds, strict=True)]
        n = sum(len(w) for w, _ in blocks)
        marks, common = marked[at : at + n], covered[at : at + n]
        at += n
        copy = (common & marks).sum() > COPY_SHARE * marks.sum()
        gone = common & ~marks if copy else common
        least = 1 if not marks.any() else LONG_PLAIN if (marks & ~gone).sum() < MARKED_SHARE * n else n + 1
        texts, of = [], 0
        for words, mark in blocks:
            lost = gone[of : of + len(words)]
            of += len(words)
            if not mark and least > 1:
                lost = lost | _short_runs(lost, least)
            if not lost.all():
                texts.append(" ".join(w for w, x in zip(words, lost, strict=True) if not x) if lost.any() else " ".join(words))
        out.append(("\n\n".join(texts), int(gone.sum())))
    return out


def _short_runs(lost: np.ndarray, least: int) -> np.ndarray:
    """Which tokens are in a run of fewer than so many that aren't lost."""
    edges = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=1, append=1))
    out = np.zeros(len(lost), bool)
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out[a:b] = b - a < least
    return out


@tidy
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns host_of, host_pages, shards, shard_of, page_id, url, html: a row for each shard with its pages parsed and compressed, without what isn't text."""
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
    for batch in batches:
        for part in slices(batch, 6, PACK_BYTES):
            rows: dict[tuple, list] = {}
            for *shard, page_id, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                page = parse(html)
                kept = [(t, k) for t, k in zip(page.texts, page.kinds, strict=True) if k != CHROME]
                rows.setdefault(tuple(shard), []).append((page_id, url, [t for t, _ in kept], bytes(k for _, k in kept)))
            if rows:
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                packed = pa.array([zstandard.compress(pickle.dumps(x), 6) for x in rows.values()], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, packed], names=["host_of", "host_pages", "shards", "shard_of", "pages"])


def _unpack(pdf: pd.DataFrame) -> tuple[list, list, list[Page]]:
    """page_id, url and blocks of a shard's pages, in an order that is the same each time."""
    rows = [x for data in pdf["pages"] for x in pickle.loads(zstandard.decompress(data))]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", x[2], x[3]))
    return [x[0] for x in rows], [x[1] for x in rows], [Page(x[2], list(x[3])) for x in rows]


def _ask(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: the hashes of its groups and their pages by stream, dealt to the host's key ranges; no rows for ranges without any."""
    shards, rows, names = int(pdf["shards"].iloc[0]), [], ["host_of", "shard_of", "stream", "bucket", "keys", "n"]
    if shards == 1:  # nothing to ask
        return pd.DataFrame(rows, columns=names, dtype=object)
    ids, _, pages = _unpack(pdf)
    buckets = max(LEAST_BUCKETS, math.ceil(shards / BUCKET_SHARDS))
    for stream, found in enumerate(Shard(ids, pages).reported()):
        keys, n = tally(*found)
        ends = cuts(keys << CUT, buckets)
        for bucket, (k, x) in enumerate(zip(np.split(keys, ends), np.split(n, ends), strict=True)):
            if len(k):
                rows.append((pdf["host_of"].iloc[0], pdf["shard_of"].iloc[0], stream, bucket, deflated(np.diff(k, prepend=np.uint64(0))), deflated(x)))
    return pd.DataFrame(rows, columns=names, dtype=object)


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one key range of a stream of a host: each shard gets the distinct pages of the host for its hashes. A page is in one shard."""
    keys = [np.cumsum(inflated(x), dtype=np.uint64) for x in pdf["keys"]]
    own, total = tally(np.concatenate(keys), np.concatenate([inflated(x) for x in pdf["n"]]))
    return pdf[["host_of", "shard_of", "stream", "bucket"]].astype(object).assign(n=[deflated(total[np.searchsorted(own, k)]) for k in keys])


def _extract(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    ids, urls, pages = _unpack(pdf)
    shard = Shard(ids, pages)
    distinct = []
    for number, (stream, (keys, _)) in enumerate(zip((shard.plain, shard.inside), shard.reported(), strict=True)):
        total, mine = stream.distinct, answers[answers["stream"] == number].sort_values("bucket")
        if len(mine):
            asked, n = np.unique(keys), np.concatenate([inflated(x) for x in mine["n"]]).astype(np.int64)
            every = stream.keys()
            at = np.minimum(np.searchsorted(asked, every), len(asked) - 1)
            total = np.where(asked[at] == every, n[at], total)
        distinct.append(total)
    found = main_texts(pages, shard.marked, shard.covered(*distinct, int(pdf["host_pages"].iloc[0])))
    texts = [t for t, _ in found]
    strings = {"url": pd.Series(urls, dtype=object), "text": pd.Series(texts, dtype=object)}
    return pd.DataFrame({"page_id": pd.array(ids, "Int64"), **strings, "n_chars": [len(t) for t in texts], "n_repeated": [n for _, n in found]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text), n_chars (its code points) and n_repeated (tokens that went as boilerplate) of each page.

    Null and empty pages have an empty text. URLs without a host share one. Rows stay as they are, repeated ones too: rows that share a
    page_id count as one page, those without one each as their own. A host of more than SHARD_BYTES is dealt to shards by a hash of the
    page_id, so that no task has it whole; what is boilerplate is decided on the pages of the whole host, whose repeats are told apart
    by 48-bit hashes where it has shards. An empty table gives an empty table. Other columns of pages are left out.
    """
    host = F.coalesce(split_url(F.col("url"))[0], F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host_of", host)
    size = F.coalesce(F.sum(F.octet_length("html")), F.lit(0))
    counts = checkpointed(rows.groupBy("host_of").agg(F.count(F.lit(1)).alias("host_pages"), F.greatest(F.lit(1), F.ceil(size / SHARD_BYTES)).cast("int").alias("shards")))
    counts = F.broadcast(counts) if small(counts, BROADCAST_HOSTS) else counts
    rows = rows.join(counts, "host_of")
    page = F.coalesce(F.xxhash64("page_id"), F.xxhash64("url", "html"))
    page = F.when(F.col("page_id").isNull(), F.xxhash64("url", "html")).otherwise(page)
    rows = rows.withColumn("shard_of", F.pmod(page, F.col("shards")).cast("int"))
    rows = rows.select("host_of", "host_pages", "shards", "shard_of", "page_id", "url", "html")
    n, by = shuffle_partitions(pages.sparkSession), ("host_of", "shard_of")
    dealt = rows.mapInArrow(_pack, "host_of string, host_pages long, shards int, shard_of int, pages binary").repartition(n, *by)
    ask = "host_of string, shard_of int, stream int, bucket int"
    asked = dealt.groupBy(*by).applyInPandas(_ask, f"{ask}, keys binary, n binary")
    answers = asked.groupBy("host_of", "stream", "bucket").applyInPandas(_answer, f"{ask}, n binary").repartition(n, *by)
    schema = "page_id long, url string, text string, n_chars long, n_repeated long"
    return dealt.groupBy(*by).cogroup(answers.groupBy(*by)).applyInPandas(_extract, schema)
