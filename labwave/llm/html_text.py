"""Main text of web pages by consensus host paths.

Each page is read once into blocks of text, every block at a node of the tree of its
containers' paths: tag and classes, with digits generalised (``div.post-17`` is
``div.post-#``). A page scores its containers by the text below them that is not
links, and votes for the smallest one that holds most of it, or the article around
that. Without an article tag the vote climbs to the container that holds the rest of
the article: while the parent adds text beside it, but to a parent with menus,
sidebars, headers or footers of the page, and to the body, only for a heading before it.
Lists and tables get no votes. The votes are summed for each host and path, and so is how
often a path lies beside the choice of a page, less how often inside it; both are joined to
the paths that each page has. A path that other pages of the host leave out at least twice more than
they take it is dismissed. A page takes the path with the most votes of other pages
that loses at most ``LOST`` of the text of the page's own choice, dismissed paths not
counted; a page without such a path, or without a host, keeps its own choice.

Whatever stands in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, by tag or by class or id name, is left out. A
name is judged by its head: ``user-comments``, ``comments-wrapper`` and ``sidebar`` are
such names, ``related-work`` and ``ad-story`` are not. Evidence may keep what a name or tag would drop:

* a form, a header or a container with such a name that holds ``MOST`` of the page's text that is not
  links (not so cookie notices and reader comments), or articles with at least as much of that text as
  the articles outside it;
* a menu, footer, aside, select or button that is never closed, by the same rule; closed,
  where its articles hold ``MOST`` of the page's text;
* inside an article, a container with a name that articles use too (``banner``, ``side``,
  ``post-form``) that is mostly sentences outside links. Its blocks that recur on ``AGAIN`` pages of the host go.

All work is linear in the size of a page, however deep its containers are nested.

Defined cases: a null html is empty and has no text; a null or odd url
has no host; a page without any container is read as a whole; a head without an end ends
where the page's text starts; broken markup is read as far as it goes; repeated rows vote and are
extracted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship_package, staged

#: A voted path may lose this part of a page's own choice.
LOST = 0.1
#: A container that holds this part of a page's text is large enough.
MOST = 0.7
#: A path that this many more pages leave out than take is dismissed.
DISMISSED = 2
#: A doubtful block on this many pages of a host is no part of an article.
AGAIN = 3

# Elements by their part in a page.
_CONTAINERS = frozenset("html body main article section div nav header footer aside form table tbody ul ol dl center".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption hr address summary details figure".split())
_SILENT = frozenset("script style noscript template iframe svg canvas object head title textarea audio video map".split())
_JUDGED = frozenset("select button nav footer aside menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_IN_HEAD = frozenset("script style noscript template title object".split())
_READERS = frozenset("cookie cookies consent gdpr comment comments commentlist reply replies respond disqus".split())
#: Names of what is never part of an article.
_STRONG = _READERS | frozenset("ad ads adsbygoogle adv advert adverts advertisement advertising sponsor sponsored promo popup modal overlay "
                               "newsletter subscribe subscription sidebar menu menus nav navbar navigation breadcrumb breadcrumbs "
                               "footer pagination pager copyright".split())
#: Names that parts of articles have too.
_WEAK = frozenset("banner banners promotion notice notices alert side aside share sharing social related recommended "
                  "recommendations form search login signup widget widgets toolbar".split())
_NAMES = _STRONG | _WEAK
_HEADERS = frozenset("header masthead topbar".split())
#: Words that leave a name what it is: "related-posts", "site-footer", "comments-wrapper".
_PLAIN = frozenset("site page main post posts article articles entry story stories list box block area bar buttons links slot thread top bottom "
                   "wrap wrapper container inner outer section left right icons tools".split())
#: Heads of names of what an article may hold: "ad-story", but not "related-story".
_STORY = frozenset("post article entry story".split())
_OTHER = frozenset("related recommended sponsored sponsor".split())
#: Names that make a header one part of an article; "with-sidebar" names a layout.
_OWN = frozenset("article entry post story content".split())
_ARTICLE = re.compile(r"\b(?:article|main|entry|post|story)\b")
_LAYOUT = re.compile(r"(?:^|[-_])(?:with|has|no|without)[-_]", re.I)
#: Parts of a page, unless they stand in a post.
_FRAME = frozenset("nav navbar navigation menu menus sidebar side aside footer breadcrumb breadcrumbs".split())
_POST = re.compile(r"\b(?:article|entry|post|story)\b")
#: The end of a sentence of some words, or one without spaces.
_SENTENCE = re.compile(r"(?:\S+\s+){4}\S.*?[.!?…](?:\W|$)|[。！？]", re.S)
_LISTS = frozenset("ul ol dl table tbody".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_WHOLE = frozenset("html body article main".split())


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name) if len(w) > 1]


def _heads(words: list[str]) -> list[str]:
    """The words that say what a name names."""
    if len(words) > 1 and words[-1] in _STORY and words[0] not in _OTHER:
        return []
    if len(words) > 1 and words[-1] == "content":
        words = words[:-1]
    return [w for w in words if w not in _PLAIN]


def _named(marks: list[list[str]], names: frozenset[str]) -> bool:
    """Whether a name consists of ``names`` and plain words."""
    return any(heads and all(w in names for w in heads) for heads in map(_heads, marks))


def _strong(marks: list[list[str]]) -> bool:
    """Whether a name is that of what is never part of an article: "user-comments", but not "content-sidebar"."""
    return any(heads and (heads[-1] in _STRONG and "content" not in heads or all(w in _NAMES for w in heads) and not _STRONG.isdisjoint(heads))
               for heads in map(_heads, marks))


class Open(NamedTuple):
    """An open container."""
    tag: str
    node: int
    silent: bool
    head: bool  # a header whose headings count
    doubt: int  # the innermost doubtful container
    rest: int  # the same for all but headings
    article: int  # the innermost doubtful container around its article, -2 without one
    start: int  # blocks before it
    judged: int  # its own doubt, of a judged element
    articles: int  # articles before it


_PAGE = Open("", 0, False, False, -1, -1, -2, 0, -1, 0)


@dataclass
class Doubt:
    """A doubtful container."""
    around: int  # the one around it
    amount: bool  # whether its amount of text may keep it
    prose: bool = False  # whether sentences may keep it
    closed: bool = False  # a judged element with an end


@dataclass
class Block:
    node: int
    text: str
    linked: int  # characters of links
    heading: bool
    at: int  # the innermost doubtful container around it
    article: int  # the same around its article

    @property
    def score(self) -> int:
        return max(0, len(self.text) - 2 * self.linked)


class PageReader(HTMLParser):
    """Collects a page's blocks and the tree of the paths of its containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        # Of each path: the path around it, its last step, key, depth, whether in a post, whether in one or in the main part.
        self.up, self.steps, self.keys, self.depth, self.post, self.inside = [-1], [""], [_key(0, "")], [0], [False], [False]
        self.known: dict[tuple[int, str], int] = {}
        self.frame: set[int] = set()  # the page's menus, sidebars, headers and footers
        self.open: list[Open] = []
        self.opened: Counter = Counter()
        self.articles = 0
        self.words: list[str] = []
        self.linked, self.links, self.heading = 0, 0, False
        self.doubt: list[Doubt] = []

    def _top(self) -> Open:
        return self.open[-1] if self.open else _PAGE

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            top = self._top()
            self.blocks.append(Block(top.node, text, self.linked, self.heading, top.doubt if self.heading else top.rest, top.article))
        self.words, self.linked = [], 0

    def _doubtful(self, *doubt) -> int:
        self.doubt.append(Doubt(*doubt))
        return len(self.doubt) - 1

    def _node(self, up: int, tag: str, classes: list[str]) -> int:
        step = ".".join([tag, *(re.sub(r"\d+", "#", c) for c in sorted(classes))])
        node = self.known.get((up, step))
        if node is None:
            node = self.known[up, step] = len(self.up)
            self.up.append(up)
            self.steps.append(step)
            self.keys.append(_key(self.keys[up], step))
            self.depth.append(self.depth[up] + 1)
            whole = tag in ("html", "body")
            self.post.append(self.post[up] or not whole and bool(_POST.search(step)))
            self.inside.append(self.inside[up] or bool(_ARTICLE.search(step)))
        return node

    def _pop(self) -> Open:
        top = self.open.pop()
        self.opened[top.tag] -= 1
        return top

    def handle_starttag(self, tag, attrs):
        if self.open and self.open[-1].tag == "head" and tag not in _IN_HEAD and tag not in _VOID:
            self._flush()
            self._pop()
        if tag in _VOID and tag != "hr":
            if tag == "br":
                self.words.append(" ")
            return
        if tag == "a":
            self.links += 1
        if tag in _CONTAINERS or tag in _SILENT or tag in _JUDGED:
            self._flush()
            values = dict(attrs)
            classes = re.findall(r"[^\s.]+", values.get("class") or "")
            marks = [_words(x) for x in [*classes, values.get("id") or ""] if not _LAYOUT.search(x)]
            top = self._top()
            node = self._node(top.node, tag, classes)
            silent, doubt, rest, judged = top.silent or tag in _SILENT, top.doubt, top.rest, -1
            named = tag not in _WHOLE and not silent
            strong = named and _strong(marks)
            out = named and (tag == "form" or tag in _JUDGED or strong or _named(marks, _NAMES))
            amount = not any(w in _READERS for m in marks for w in m)
            inside = top.head or any(w in _OWN for m in marks for w in m) or self.inside[top.node]
            head = top.head or named and not out and (tag == "header" or _named(marks, _HEADERS))
            if out or head and not top.head and not inside:
                doubt = self._doubtful(doubt, amount, out and not strong and tag not in _JUDGED and tag != "form" and self.post[top.node])
                rest = doubt if rest == top.doubt else self._doubtful(rest, amount)
                judged = doubt if tag in _JUDGED else -1
            elif head and not top.head:
                rest = self._doubtful(rest, True)
            article = top.article
            if tag in ("article", "main") and not any(m and m[0] in _READERS for m in marks):
                article = doubt
                self.articles += 1
            if not silent and (tag in _FRAME or head and not inside or named and _named(marks, _FRAME)) and not self.post[top.node]:
                self.frame.add(node)
            self.open.append(Open(tag, node, silent, head, doubt, rest, article, len(self.blocks), judged, self.articles))
            self.opened[tag] += 1
        elif tag in _BLOCKS:
            self._flush()
            self.heading = tag[0] == "h" and tag[1:].isdigit()

    def handle_startendtag(self, tag, attrs):
        if tag in _CONTAINERS or tag in _SILENT or tag in _JUDGED:
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in _CONTAINERS or tag in _SILENT or tag in _JUDGED:
            if self.opened[tag]:
                self._flush()
                top = self._pop()
                while top.tag != tag:
                    top = self._pop()
                self.links = 0
                if top.judged >= 0:
                    self.doubt[top.judged].closed = True
                    if self.articles == top.articles:  # only a menu or the like
                        del self.blocks[top.start:]
        elif tag in _BLOCKS:
            self._flush()
            self.links, self.heading = 0, False

    def handle_data(self, data):
        if self.open and self.open[-1].silent:
            return
        self.words.append(data)
        if self.links:
            self.linked += len(data)

    def _kept(self) -> list[bool]:
        """Whether each doubtful container, and all around it, stays."""
        n = len(self.doubt)
        text, article, own, total, sure = [0] * n, [0] * n, [0] * n, 0, 0
        whole, prose = [0] * n, [0] * n
        for b in self.blocks:
            total += b.score
            if b.at >= 0:
                text[b.at] += b.score
                whole[b.at] += len(b.text)
                if 2 * b.linked < len(b.text) and _SENTENCE.search(b.text):
                    prose[b.at] += len(b.text)
            if b.article >= 0:
                article[b.article] += b.score
            if b.article >= -1 and b.at >= 0:
                own[b.at] += b.score
            elif b.article >= -1:
                sure += b.score
        most: dict[int, int] = {}
        for i in range(n - 1, -1, -1):
            around = self.doubt[i].around
            if around >= 0:
                for sums in (text, article, whole, prose):
                    sums[around] += sums[i]
            most[around] = max(most.get(around, 0), article[i])
        kept = [False] * n
        for i, d in enumerate(self.doubt):
            if d.around >= 0 and not kept[d.around]:
                continue
            if d.closed:
                kept[i] = 0 < MOST * total <= article[i]
            else:
                # Side by side with another, a teaser's article doesn't count.
                kept[i] = (d.amount and 0 < MOST * total <= text[i] or article[i] > 0 and article[i] >= sure and 2 * article[i] >= most[d.around]
                           or d.prose and 2 * prose[i] > whole[i])
            if kept[i]:
                sure += own[i]
        return kept

    def read(self, html: str | None) -> list[Block]:
        html = html or ""
        # Marks that nothing ends are text; a parser would look for their ends from each of them.
        ended = html.rfind("-->") + 3 if "-->" in html else 0
        html = html[:ended] + html[ended:].replace("<!--", " ")
        ended = html.rfind(">") + 1
        self.feed(html[:ended])
        self.close()
        if ended < len(html):
            self.handle_data(unescape(html[ended:]))
        self._flush()
        kept = self._kept()
        self.blocks = [b for b in self.blocks if b.at < 0 or kept[b.at]]
        return self.blocks

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.steps[node])
            node = self.up[node]
        return "".join("/" + x for x in reversed(steps))

    def tag(self, node: int) -> str:
        return self.steps[node].partition(".")[0]

    def best(self, below: list[int]) -> int:
        """The path that the page votes for, by the text below each."""
        large = [i for i, n in enumerate(below) if 0 <= n >= MOST * below[0] and self.tag(i) not in _LISTS]
        node = max(large, key=lambda i: (self.depth[i], below[i], self.keys[i]), default=0)
        article, at = 0, node
        while at > 0:
            if self.tag(at) in ("article", "main"):
                article = at
            at = self.up[at]
        return article or self._climbed(node, below)

    def _climbed(self, node: int, below: list[int]) -> int:
        frames = [0] * len(self.up)
        under = [False] * len(self.up)  # below the node
        for i in range(1, len(self.up)):
            under[i] = i == node or under[self.up[i]]
        for i in range(len(self.up) - 1, 0, -1):
            frames[i] += i in self.frame
            frames[self.up[i]] += frames[i]
        headings = set()  # paths with a heading directly in them, before the first block of the node
        for b in self.blocks:
            if under[b.node]:
                break
            if b.heading:
                headings.add(b.node)
        at, heading = node, False
        while at > 0:
            at = self.up[at]
            heading = heading or at in headings
            if self.tag(at) in _LISTS or below[at] == below[node]:
                continue
            if (self.tag(at) in ("", "html", "body") or self.tag(at) in _JUDGED or frames[at] > frames[node]) and not heading:
                break
            node, heading = at, False
        return node


def blocks_of(html: str | None) -> list[tuple[str, str, int, bool]]:
    """(path, text, characters of links, whether a heading) of a page's blocks."""
    reader = PageReader()
    return [(reader.path(b.node), b.text, b.linked, b.heading) for b in reader.read(html)]


def _key(around: int, step: str) -> int:
    """The key of a path from that of the path around it."""
    data = around.to_bytes(8, "big", signed=True) + step.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def parsed(html: str | None) -> tuple:
    """Keys of a page's paths that hold text, those around others first, whether each lies beside (1), inside (-1)
    or around (0) the best one, the number of that, keys of the doubtful blocks, and the blocks, packed for ``extract``."""
    reader = PageReader()
    blocks = reader.read(html)
    own, held = [0] * len(reader.up), [False] * len(reader.up)
    for b in blocks:
        own[b.node] += b.score
        held[b.node] = True
    below = list(own)
    for i in range(len(own) - 1, 0, -1):
        below[reader.up[i]] += below[i]
        held[reader.up[i]] |= held[i]
    best = reader.best([n if h else -1 for n, h in zip(below, held)]) if blocks else -1
    nodes = [i for i, h in enumerate(held) if h]
    number = {node: i for i, node in enumerate(nodes)}
    around, at = set(), best
    while at > 0:
        at = reader.up[at]
        around.add(at)
    side: dict[int, int] = {}
    for i in nodes:
        side[i] = -1 if i == best or i and side[reader.up[i]] == -1 else 0 if i in around else 1
    doubts = [_key(0, b.text) for b in blocks if b.at >= 0 and reader.doubt[b.at].prose]
    numbers = [len(nodes), len(blocks), *(number.get(reader.up[i], -1) for i in nodes), *(own[i] for i in nodes), *(number[b.node] for b in blocks),
               *(b.at >= 0 and reader.doubt[b.at].prose for b in blocks)]
    body = zlib.compress(np.array(numbers, "<i4").tobytes() + "\n".join(b.text for b in blocks).encode("utf-8", "replace"))
    return (np.array([reader.keys[i] for i in nodes], "int64"), np.array([side[i] for i in nodes], "int32"), number.get(best, -1),
            np.array(doubts, "int64"), body)


_PARSED = "keys array<bigint>, sides array<int>, best int, doubts array<bigint>, body binary"


def chosen(up: list[int], own: list[int], best: int, paths) -> int:
    """The voted path that loses nothing of the page's choice, or that choice.

    ``paths``: (number, votes of other pages, pages that leave the path out less those that take it)."""
    n = len(up)
    dismissed = {p["number"] for p in paths if p["left"] >= DISMISSED}
    dead, live = [False] * n, list(own)
    for i, u in enumerate(up):
        dead[i] = i in dismissed or u >= 0 and dead[u]
        live[i] = 0 if dead[i] else own[i]
    below = list(own)
    for i in range(n - 1, 0, -1):
        live[up[i]] += live[i]
        below[up[i]] += below[i]
    inside = [False] * n
    for i, u in enumerate(up):
        inside[i] = i == best or u >= 0 and inside[u]
    around, at = {best}, best
    while at >= 0:
        around.add(at)
        at = up[at]
    for p in sorted((p for p in paths if p["votes"] > 0), key=lambda p: (-p["votes"], -below[p["number"]], p["number"])):
        i = p["number"]
        if live[best] - (live[best] if i in around else live[i] if inside[i] else 0) <= LOST * below[best]:
            return i
    return best


def extract(body: bytes, best: int, paths, drop) -> str:
    """The text below the path that wins, without the doubtful blocks with the numbers in ``drop``."""
    if best < 0:
        return ""
    body = zlib.decompress(body)
    n, blocks = np.frombuffer(body, "<i4", 2).tolist()
    numbers = np.frombuffer(body, "<i4", 2 * n + 2 * blocks, 8).tolist()
    up, own, at, doubts = numbers[:n], numbers[n:2 * n], numbers[2 * n:2 * n + blocks], numbers[2 * n + blocks:]
    number, drop = chosen(up, own, best, [] if paths is None else paths), set([] if drop is None else drop)
    inside: list[bool] = []
    for i, u in enumerate(up):
        inside.append(i == number or u >= 0 and inside[u])
    lines, order = [], -1
    for text, node, doubt in zip(body[8 + 8 * (n + blocks):].decode().split("\n"), at, doubts):
        order += doubt
        if inside[node] and not (doubt and order in drop):
            lines.append(text)
    return "\n".join(lines)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_evidence(pages: DataFrame, uid: str, host: str, page: str) -> DataFrame:
    """uid -> what other pages of the host say: ``paths`` of the page (number, votes, left) and the doubtful blocks that ``drop``."""
    named = pages.filter(F.col(host) != "").select(F.col(uid).alias("uid"), F.col(host).alias("host"), F.col(f"{page}.keys").alias("keys"),
                                                   F.col(f"{page}.sides").alias("sides"), F.col(f"{page}.best").alias("best"),
                                                   F.col(f"{page}.doubts").alias("doubts"))
    named = named.filter(F.col("best") >= 0)
    # Paths are in order from the whole page, which gets no votes: it holds all a page has.
    has = named.select("uid", "host", "best", F.posexplode(F.arrays_zip("keys", "sides")).alias("number", "p")).filter(F.col("number") > 0)
    has = has.select("uid", "host", "number", F.col("p.keys").alias("key"), F.col("p.sides").alias("side"),
                     (F.col("number") == F.col("best")).cast("int").alias("vote"))
    told = has.groupBy("host", "key").agg(F.sum("vote").alias("votes"), F.sum("side").alias("left"))
    told = staged(told.filter((F.col("votes") > 1) | (F.col("left") >= DISMISSED)), "html-votes")  # a page's own vote doesn't count for it
    paths = has.join(told, ["host", "key"]).select(
        "uid", F.struct("number", (F.col("votes") - F.col("vote")).alias("votes"), (F.col("left") - F.col("side")).alias("left")).alias("path"),
        F.lit(None).cast("int").alias("again"))
    often = named.select("host", F.explode(F.array_distinct("doubts")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    often = staged(often.filter(F.col("n") >= AGAIN).select("host", "key"), "html-again")
    again = named.select("uid", "host", F.posexplode("doubts").alias("again", "key")).join(often, ["host", "key"])
    told = paths.unionByName(again.select("uid", F.lit(None).cast(paths.schema["path"].dataType).alias("path"), "again"))
    return told.groupBy("uid").agg(F.collect_list("path").alias("paths"), F.collect_list("again").alias("drop"))


def main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text in ``text_col`` (replaced if there)."""
    host, uid, page, best, body, paths, drop = (fresh(x) for x in ("host", "uid", "page", "best", "body", "paths", "drop"))
    ship_package(pages.sparkSession)

    @F.pandas_udf(_PARSED)
    def parse(htmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(h) for h in htmls], columns=["keys", "sides", "best", "doubts", "body"])

    @F.pandas_udf("string")
    def text(bodies: pd.Series, bests: pd.Series, found: pd.Series, drops: pd.Series) -> pd.Series:
        return pd.Series([extract(*x) for x in zip(bodies, bests, found, drops)], dtype=object)

    read = pages.withColumn(host, host_of(F.col(f"`{url_col}`"))).withColumn(page, parse(F.col(f"`{html_col}`")))
    read = staged(read.withColumn(uid, F.monotonically_increasing_id()).drop(html_col), "html-pages")
    told = staged(host_evidence(read, uid, host, page), "html-paths")
    told = told.select(F.col("uid").alias(uid), F.col("paths").alias(paths), F.col("drop").alias(drop))
    # Only the packed blocks travel to the join.
    read = read.withColumn(body, F.col(f"{page}.body")).withColumn(best, F.col(f"{page}.best")).drop(page, host)
    out = read.join(told, uid, "left").withColumn(text_col, text(F.col(body), F.col(best), F.col(paths), F.col(drop)))
    return out.drop(uid, best, body, paths, drop)
