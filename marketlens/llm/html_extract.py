"""Main-text extraction with removal of site templates.

Every element subtree gets a hash of its markup and text. Spark counts, per host, on
how many differing articles each subtree recurs; subtrees on at least ``MIN_PAGES``
of them, whatever the size of the host, are the site's template
and are deleted with everything inside. Copies of one article count once, and prose
inside <article> or <main> (headings, paragraphs, lists, quotes, tables ...) is never
counted as template, so articles copied or quoted across a site stay whole. Elements
that are furniture by tag (menus, footers, sidebars, forms, scripts, styles) or role are
deleted without counting, as are those of which a class or the id consists of furniture words
("comments", "cookie-notice", "site-footer", not "article-header", "no-sidebar" or "related-work"):
reader comments and adverts differ from page to page and never recur. Such a name never deletes
a heading, nor an element that turns out to hold <article> or <main>.

Every page is parsed once, by a scanner that only moves forward. Pages whose text does not depend on
the counts are finished then; only undecided blocks travel, to meet their host's template hashes.

Null html gives an empty text. Without <article>, <main> is the article, else the
body. Broken markup closes at the end of the page; a script or style that never
closes swallows the rest. Repeated rows are extracted alike; other columns are ignored;
a null url counts as an empty host.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_PAGES = 10
SALTS = 16

FURNITURE = frozenset("nav header footer aside form script style noscript template iframe svg button select "
                      "textarea dialog menu head title object canvas audio video".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption "
                  "figure figcaption article main br hr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# An opening tag of the key closes an open element of the value that has no closing tag of its own.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices gdpr popup "
    "modal newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer header "
    "masthead comment comments disqus respond share sharing social toolbar pagination".split())
FILLER_WORDS = frozenset("site page global top bottom left right list box wrap wrapper container section block area inner outer bar slot unit "
                         "user reader form links items group".split())
_FURNITURE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TAG = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/><\"']*))")
_ATTRS = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def _furniture_name(value: str, in_article: bool) -> bool:
    """Whether a class or id has a token made of furniture words (and fillers) only."""
    for token in value.lower().split():
        words = set(re.split(r"[-_]+", token)) - {""}
        named = words & FURNITURE_WORDS
        if named and words <= FURNITURE_WORDS | FILLER_WORDS and not (in_article and named == {"header"}):
            return True
    return False


def _furniture(tag: str, attrs: str, in_article: bool) -> int:
    """2: furniture by tag, role or being hidden; 1: by a class or id; 0: none."""
    if tag in FURNITURE:
        return 0 if tag == "header" and in_article else 2
    found = 0
    if attrs and tag not in ("html", "body", "article", "main"):
        for name, a, b, c in _ATTR.findall(attrs):
            value, name = (a or b or c), name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return 2
            if name == "role" and value.lower() in _FURNITURE_ROLE:
                return 2
            if name in ("class", "id") and tag not in HEADINGS and _furniture_name(value, in_article):
                found = 1
    return found


class Scanner:
    """Tags of a page in order, never looking at a character more than a few times.

    A quote that never closes would hide the rest of the page in one attribute; from there on a tag ends at its first
    ``>``. A ``<`` without a ``>`` after it is text, an unclosed comment swallows the rest.
    """

    def __init__(self, src: str):
        self.src = src
        self.quotes = True
        self.last = src.rfind(">")

    def next(self, pos: int) -> tuple[int, int, str, str | None, str] | None:
        """(start, end, slash, tag or None for a comment, attributes) of the next tag from ``pos``."""
        src = self.src
        while True:
            m = _TAG.search(src, pos)
            if m is None:
                return None
            if m.group(2) is None:
                opening = m.group()
                close = "-->" if opening == "<!--" else "]]>" if opening == "<![CDATA[" else ">"
                end = src.find(close, m.end())
                return m.start(), len(src) if end < 0 else end + len(close), "", None, ""
            if m.start() > self.last:
                return None
            if self.quotes:
                end = _ATTRS.match(src, m.end()).end()
                self.quotes = end < len(src) and src[end] == ">"
            if not self.quotes:
                end = src.find(">", m.end())
            return m.start(), end + 1, m.group(1), m.group(2).lower(), src[m.end():end]


class Page:
    """Blocks of one page: (text, area, innermost candidate subtree or -1), and per subtree its hash and the one around it.

    ``area`` is 2 inside <article>, 1 inside <main>, 0 elsewhere. Furniture leaves no block.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.hashes: list[int] = []
        self.parents: list[int] = []
        self._parse(source)

    def _parse(self, src: str) -> None:
        stack: list[list] = []  # [tag, furniture, candidate number or -1]
        hashers: list = []  # of the open candidates; a closed one counts in the one around it by its hash
        named: list[int] = []  # places in the stack of elements that are furniture by class or id only
        solid: list[int] = []  # places of the elements that are not inline
        opened: Counter[str] = Counter()
        scan = Scanner(src)
        text: list[str] = []
        dropped = article = main = 0
        open_candidates: list[int] = []
        pos, n = 0, len(src)
        header_inside = 0
        heading = 0

        def flush() -> None:
            if not text:
                return
            joined = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if joined:
                self.blocks.append((joined, 2 if article else 1 if main else 0, open_candidates[-1] if open_candidates else -1))

        def feed(piece: str) -> None:
            if hashers:
                hashers[-1].update(" ".join(piece.split()).encode("utf-8", "surrogatepass") + b"\0")

        def close(k: int) -> None:
            nonlocal dropped, article, main, header_inside, heading
            while len(stack) > k:
                tag, furniture, cand = stack.pop()
                opened[tag] -= 1
                if tag not in INLINE:
                    solid.pop()
                    flush()
                if cand >= 0:
                    self.hashes[cand] = hashers.pop().intdigest()
                    open_candidates.pop()
                    feed(str(self.hashes[cand]))
                dropped -= furniture > 0
                if furniture == 1:
                    named.pop()
                article -= tag == "article"
                main -= tag == "main"
                header_inside -= tag == "header" and not furniture
                heading -= tag in HEADINGS

        while pos < n:
            found = scan.next(pos)
            start = found[0] if found else n
            if start > pos:
                feed(src[pos:start])
                if not dropped and (not header_inside or heading):
                    text.append(src[pos:start])
            if not found:
                break
            _, pos, slash, tag, attrs = found
            if tag is None:
                continue
            if slash:
                if opened[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    close(k)
                elif tag not in INLINE:
                    flush()
                continue
            if tag not in INLINE:
                flush()
            if tag in VOID or attrs.endswith("/") and tag not in RAW:
                feed(src[start:pos])
                continue
            if tag in IMPLIED_END and stack and stack[-1][0] in IMPLIED_END[tag]:
                close(len(stack) - 1)
            if tag == "p" and solid and not dropped and stack[solid[-1]][0] == "p":
                close(solid[-1])
            if tag in RAW:
                end = _RAW_END[tag].search(src, pos)
                feed(src[start:end.end() if end else n])
                pos = end.end() if end else n
                continue
            if tag in ("article", "main") and named:
                # What holds the article is no furniture, whatever its name.
                dropped -= len(named)
                for k in named:
                    stack[k][1] = 0
                named.clear()
            inside = article > 0 or main > 0
            furniture = _furniture(tag, attrs, inside)
            cand = -1
            if not furniture and not dropped and tag not in ("html", "body", "article", "main") and tag not in INLINE \
                    and not (inside and tag in PROSE):
                cand = len(self.hashes)
                self.hashes.append(0)
                self.parents.append(open_candidates[-1] if open_candidates else -1)
                open_candidates.append(cand)
                hashers.append(xxhash.xxh64(seed=7))
            feed(src[start:pos])
            opened[tag] += 1
            if tag not in INLINE:
                solid.append(len(stack))
            if furniture == 1:
                named.append(len(stack))
            stack.append([tag, furniture, cand])
            dropped += furniture > 0
            article += tag == "article"
            main += tag == "main"
            header_inside += tag == "header" and not furniture
            heading += tag in HEADINGS
        close(0)
        flush()

    def article(self) -> list[tuple[str, int]]:
        """Blocks of the article: of <article> if there is text in one, else of <main>, else of the body."""
        best = max((b[1] for b in self.blocks), default=0)
        return [(t, c) for t, area, c in self.blocks if area >= best]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_PARSED = pa.struct([("text", pa.string()), ("body", pa.int64()), ("subtrees", pa.list_(pa.int64())),
                     ("pending", pa.struct([("t", pa.list_(pa.string())), ("c", pa.list_(pa.int32())), ("h", pa.list_(pa.int64())),
                                            ("up", pa.list_(pa.int32()))]))])


def _parse_batch(source: pa.Array) -> pa.Array:
    """Per page: text if settled, else its blocks (innermost subtree, all subtrees' hashes and parents); hash of the article; all hashes."""
    out = []
    for value in source:
        page = Page(value.as_py() or "")
        blocks = page.article()
        hashes = [_signed(h) for h in page.hashes]
        body = _signed(xxhash.xxh64_intdigest(" ".join(t for t, _ in blocks).encode("utf-8", "surrogatepass"), 11))
        settled = all(c < 0 for _, c in blocks)
        out.append({"text": " ".join(t for t, _ in blocks) if settled else None, "body": body, "subtrees": sorted(set(hashes)),
                    "pending": None if settled else {"t": [t for t, _ in blocks], "c": [c for _, c in blocks], "h": hashes, "up": page.parents}})
    return pa.array(out, _PARSED)


def kept_text(pending: dict, drop: list[int] | None) -> str:
    """The blocks of a page that lie in none of the subtrees with a hash in ``drop``."""
    known = set(drop or ())
    gone: list[bool] = []
    for h, up in zip(pending["h"], pending["up"], strict=True):  # a subtree comes after the one around it
        gone.append(h in known or up >= 0 and gone[up])
    return " ".join(t for t, c in zip(pending["t"], pending["c"], strict=True) if c < 0 or not gone[c])


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    @F.arrow_udf("struct<text: string, body: long, subtrees: array<long>, "
                 "pending: struct<t: array<string>, c: array<int>, h: array<long>, up: array<int>>>")
    def parse(source: pa.Array) -> pa.Array:
        return _parse_batch(source)

    parse = parse.asNondeterministic()  # evaluate once per pass: not repeated in a pushed filter
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"),
                        parse(F.col(html_col)).alias("p"))


def templates(hashed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash) of the subtrees that recur on many differing articles of their host."""
    pairs = hashed.select("host", "body", F.explode("subtrees").alias("hash")).distinct()
    return pairs.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "hash")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    # Written once: the text of settled pages, hashes of every page, and blocks of undecided ones. Rows are told
    # apart by a number given here, so repeated pages stay apart.
    hashed = materialize(parsed(pages, id_col, url_col, html_col)
                         .select("page_id", "url", "host", F.col("p.text").alias("text"), F.col("p.body").alias("body"),
                                 F.col("p.subtrees").alias("subtrees"), F.col("p.pending").alias("pending"),
                                 F.expr("uuid()").alias("row")), "html-parsed")
    done = hashed.where("pending is null").select("page_id", "url", "text")
    known = templates(hashed, min_pages) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = hashed.where("pending is not null")
    present = open_.select("row", "host", F.explode("subtrees").alias("hash")) \
        .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")) \
        .join(known, ["host", "hash", "salt"]).groupBy("row").agg(F.collect_set("hash").alias("drop"))
    @F.arrow_udf("string")
    def finish(pending: pa.Array, drop: pa.Array) -> pa.Array:
        return pa.array([kept_text(p.as_py(), d.as_py()) for p, d in zip(pending, drop, strict=True)], pa.string())

    late = open_.join(present, "row", "left").select("page_id", "url", finish(F.col("pending"), F.col("drop")).alias("text"))
    return done.unionByName(late).select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text",
                                         F.length("text").cast("long").alias("n_chars"))
