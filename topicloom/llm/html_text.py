"""Main text of web pages by consensus of a host's pages on the path of the container that holds it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import slices

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("head nav footer aside form button select option template svg math object canvas audio video dialog menu input".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th address summary".split())
_SCOPES = frozenset("article main section div td th table ul ol body html nav aside header footer form blockquote dl figure".split())
_ROWS = frozenset("li dt dd tr td th option".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Where a comment or CDATA section begins, and where an element of raw text ends.
_OPEN = re.compile(r"<!--|<!\[CDATA\[")
_CLOSE = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in _RAW}
#: Words that name what surrounds an article.
_ROUND = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related recommended recommendations promo promos promotion"
    " ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login social share sharing comment comments commentlist respond reply replies disqus form search pagination pager toolbar skip hidden".split()
)
_FIRST = _ROUND - {"header", "search", "form", "reply", "share", "hidden", "notice", "alert"}
#: Of names like entry-header: what they may begin with to be an article's own heading.
_HEADED = frozenset("article content entry page post section story title".split())
_GOOD = frozenset("article content main post entry story body text".split())


_HIDING = re.compile(r"display\s*:\s*none")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def _about(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """(generalised name, whether it surrounds the article, whether it says that it is the article, whether it is a
    header, which surrounds the article unless it is inside)."""
    if not attrs.strip():
        return tag, tag in _DROPPED, tag in ("article", "main"), tag == "header"
    header = tag == "header"
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = f"{got.get('class', '')} {got.get('id', '')}".split()
    away, good = tag in _DROPPED, tag in ("article", "main") or got.get("role", "").lower() in ("main", "article")
    away |= "hidden" in got or got.get("aria-hidden", "").lower() == "true" or _HIDING.search(got.get("style", "")) is not None
    away |= got.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert")
    for name in names:
        parts = [w.lower() for w in _PARTS.findall(name)]
        if not parts or parts[0] in ("has", "with", "no", "is", "without"):
            continue
        if parts[-1] == "header" and parts[0] in _HEADED:
            header = True
            continue
        away |= parts[-1] in _ROUND or parts[0] in _FIRST
        good |= parts[-1] in _GOOD
    general = sorted({_DIGITS.sub("", c.lower()) for c in got.get("class", "").split()} - {""})
    return ".".join([tag, *general]), away and tag not in ("html", "body", "article", "main"), good, header


class Page:
    """Blocks of text (text, link characters, heading, container) in page order, and containers.

    A container has a parent, whether it says that it is the article, and a path: the number of a path in a tree of names,
    so that deep pages do not hold long paths. Work and memory are in proportion to the page.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.parents, self.paths, self.good = [-1], [0], [False]
        # of each path: the one above, its own name, its depth and length; path 0 is the page
        self.above, self.names, self.depths, self.sizes = [-1], [""], [0], [0]
        self.numbers: dict[tuple[int, str], int] = {}
        self._read(source)

    def _path(self, above: int, name: str) -> int:
        if (got := self.numbers.setdefault((above, name), len(self.names))) == len(self.names):
            self.above.append(above)
            self.names.append(name)
            self.depths.append(self.depths[above] + 1)
            self.sizes.append(self.sizes[above] + len(name) + (above > 0))
        return got

    def name(self, path: int) -> str:
        """The names from the page down to the path, parted by >."""
        out = []
        while path > 0:
            out.append(self.names[path])
            path = self.above[path]
        return ">".join(reversed(out))

    def _read(self, s: str) -> None:
        # open elements: (tag, container, dropped, inside an article); how many are open of each tag
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        count: dict[str, int] = {}
        text: list[str] = []
        link, in_link = 0, False
        hidden: list | None = None  # an inline element that is left out: its tag, open ones of it, and the stack below it

        def flush() -> None:
            nonlocal link
            if text:
                joined = " ".join(html.unescape("".join(text)).split())
                if joined and not stack[-1][2]:
                    self.blocks.append((joined, min(link, len(joined)), stack[-1][0] in _HEADINGS, stack[-1][1]))
                text.clear()
            link = 0

        def close_to(k: int) -> None:
            nonlocal hidden
            flush()
            for tag, *_ in stack[k:]:
                count[tag] -= 1
            del stack[k:]
            if hidden and len(stack) < hidden[2]:
                hidden = None

        at, end = 0, s.rfind(">") + 1  # no tag ends behind the last >
        while True:
            m = _TAG.search(s, at, end) if at < end else None
            piece = s[at : m.start()] if m else _OPEN.split(s[at:], maxsplit=1)[0]
            if piece and not stack[-1][2] and not hidden:
                text.append(piece)
                if in_link:
                    link += len(piece.strip())
            if not m:
                break
            at = m.end()
            if at == end and _OPEN.match(m[0]) and not m[0].endswith(("-->", "]]>")):
                break  # a comment without an end
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing = bool(m[1] or m[4])
            attrs = m[3] or m[6] or ""
            if tag in ("br", "wbr", "img"):
                if tag != "wbr":
                    text.append(" ")
                continue
            if hidden and tag == hidden[0]:
                hidden[1] += -1 if closing else 1
                if not hidden[1]:
                    hidden = None
                continue
            if tag in _INLINE:
                if not closing and not hidden and attrs and _about(tag, attrs)[1]:  # a hidden or advertising span, a link to share
                    hidden = [tag, 1, len(stack)]
                elif tag == "a":
                    in_link = not closing
                continue
            if tag in _RAW and not closing:
                close = _CLOSE[tag].search(s, at)
                at = close.start() if close else len(s)
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1) if count.get(tag) else ():
                    if stack[k][0] == tag:
                        close_to(k)
                        break
                    if tag in _LEAVES and tag not in ("td", "th", "blockquote") and stack[k][0] in _SCOPES:
                        break
                else:
                    flush()
                continue
            flush()
            in_link = False
            if tag in _VOID:
                continue
            # an open paragraph or heading ends where another block starts; a list item where the next one does
            ends = tag in _ROWS and count.get(tag) or any(map(count.get, ("p", *_HEADINGS)))
            for k in range(len(stack) - 1, 0, -1) if ends else ():
                top = stack[k][0]
                if top == "p" or top == tag and tag in _ROWS or top in _HEADINGS and tag in _LEAVES:
                    close_to(k)
                    break
                if top in _SCOPES:
                    break
            name, away, good, header = _about(tag, attrs)
            _, container, dropped, inside = stack[-1]
            dropped |= away or header and not inside or hidden is not None
            inside |= tag in ("article", "main")
            count[tag] = count.get(tag, 0) + 1
            if tag in _LEAVES and tag != "blockquote":
                stack.append((tag, container, dropped, inside))
            else:
                self.parents.append(container)
                self.paths.append(self._path(self.paths[container], name))
                self.good.append(good)
                stack.append((tag, len(self.parents) - 1, dropped, inside))
        flush()

    def scores(self) -> list[int]:
        """Of each container: what its blocks are worth, prose by its length, short or linked pieces less than nothing."""
        own = [0] * len(self.parents)
        for text, link, heading, c in self.blocks:
            plain = len(text) - 2 * link
            own[c] += plain if plain > 0 and (heading or len(text) >= 25 or text[-1] in ".!?…。") else -10
        for k in range(len(own) - 1, 0, -1):
            own[self.parents[k]] += own[k]
        return [x * 12 // 10 if g and x > 0 else x for x, g in zip(own, self.good)]

    def best(self, n: int = 3) -> list[tuple[str, int]]:
        """The n containers of the highest scores, deeper ones first among equals: (path, share of the best in 1000)."""
        scores = self.scores()
        order = sorted((k for k in range(1, len(scores)) if scores[k] > 0), key=lambda k: (-scores[k], -self.depths[self.paths[k]], k))[:n]
        return [(self.name(self.paths[k]), 1000 * scores[k] // max(1, scores[order[0]])) for k in order]

    def text(self, path: str) -> str | None:
        """The blocks in containers of the path, None if the page has none such."""
        inside = [False] * len(self.parents)
        is_it = [k > 0 and self.sizes[k] == len(path) and self.name(k) == path for k in range(len(self.names))]
        for k in range(1, len(inside)):
            inside[k] = is_it[self.paths[k]] or inside[self.parents[k]]
        return "\n".join(t for t, _, _, c in self.blocks if inside[c]) if any(inside) else None


def read(source: str | None, path: str | None = None) -> tuple[str, str]:
    """(text, path used): of the winning path if the page has it with text, else of the page's own best container, else all blocks."""
    if not source:
        return "", ""
    page = Page(source)
    own = page.best(1)
    for p in ([path] if path else []) + [p for p, _ in own]:
        if got := page.text(p):
            return got, p
    return "\n".join(t for t, _, _, _ in page.blocks), ""


#: Hosts whose winners are sent to every task; beyond, winners are joined in a shuffle with each host dealt over SALT keys.
HOSTS = 100_000
SALT = 64


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path for each row.

    Each page gives its best containers' scores to their paths; a host's path with the greatest sum wins (ties: the
    smaller path). A page without that path, or without text there, uses its own best container; a page without any
    container, its whole text outside menus and the like. Null or empty html, or html of markup alone, gives an empty
    text. Null urls share one host. Repeated rows get equal texts. An empty table gives no rows.
    """
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))
    lean = pages.select("page_id", "url", "html", host.alias("host"))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1 << 22, "html"):
                sums: dict[tuple[str, str], list[int]] = {}
                for h, source in zip(b.column("host"), b.column("html")):
                    for path, score in Page(source.as_py() or "").best():
                        got = sums.setdefault((h.as_py(), path), [0, 0])
                        got[0] += score
                        got[1] += 1
                cols = [[h for h, _ in sums], [p for _, p in sums], [v[0] for v in sums.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["host", "path", "score"])

    polled = lean.select("host", "html").mapInArrow(votes, "host string, path string, score long")
    summed = polled.groupBy("host", "path").agg(F.sum("score").alias("score"))
    won = common.table(summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), "path")).alias("won")), "host-paths")
    if won.limit(HOSTS + 1).count() <= HOSTS:
        joined = lean.join(F.broadcast(won), "host", "left")
    else:
        salted = won.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
        joined = lean.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1 << 22, "html"):
                got = [read(h.as_py(), w.as_py()) for h, w in zip(b.column("html"), b.column("won"))]
                cols = [b.column("page_id"), b.column("url"), pa.array([t for t, _ in got]), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([p for _, p in got])]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars", "path"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "won").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long, path string")
