"""Main text of web pages by consensus on host paths.

Every page scores its containers: a block of text counts for the container that holds it and, less by a factor for each level, for those
around it; text in links and in what is plainly no article counts nothing. The best container's path of tags and classes, with
digits and hash-like names generalised, is the page's vote. Votes are counted for each host in Spark, and in a second pass each
page takes all containers on the first of its host's winning paths that holds what its own best container holds, else those on its own best's path.
What stands beside them, such as a title or a lead, is kept in page order too, unless it is mostly links.

What is no article is known by its tag, its role and its names. Outside of ``main`` and ``article`` one telling word in a class or an id is enough;
inside them the name as a whole must tell, and inside ``article`` only advertisements, comments, forms and the like go.

Paths are chains of hashes, each of the path around it and a name, so a page needs memory and time in proportion to its length, however deep its tags are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm._common import hinted_small, in_arrow, read, salted_join, slices

#: The share of its host's votes that a winning path has at least (so a host has 32 at most), and hosts whose paths are broadcast at most.
SHARE, BROADCAST_HOSTS = 1 / 32, 100_000
#: What a level takes from a block's weight, what an article's own tags add, and the share of unlinked text that what stands beside an article must have.
LEVEL, ARTICLE, UNLINKED = 0.9, 1.3, 0.5

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
#: Tags of a page whose quotes don't match: they end at the next angle bracket.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_BEGINS = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HASHED = re.compile(r"(?=.*\d)[0-9a-zA-Z]{8,}")

CONTAINERS = frozenset("body main article section div td".split())
BLOCKS = CONTAINERS | frozenset("html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre hr br figure figcaption address details summary header footer nav aside form fieldset legend".split())
#: Tags inside which an open paragraph or item may still be ended by a block.
INLINE = frozenset("a b i em strong span u font small".split())
ITEMS = frozenset("li td th tr dt dd".split())
DROPPED = frozenset("head nav header footer aside form button select option textarea input label iframe object embed svg canvas menu dialog noscript template fieldset audio video map".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names that mark what is no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo widget widgets "
    "notice notices cookie cookies consent gdpr alert popup modal overlay dialog newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies respond related recommended recommendations "
    "teaser teasers pagination pager toolbar search form copyright legal disclaimer skip tags toc trending outbrain taboola hidden".split()
)
#: Names that mark what is no article even inside one.
INSIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup share sharing comment comments commentlist disqus pagination outbrain taboola hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: What a mark may be followed by in a name that tells as a whole.
_AFTER = r"(?:[-_]?(?:box|slot|unit|area|list|section|container|wrapper|wrap|block|bar|buttons?|links?|icons?|posts?|form|thread|banner|panel|inner|top|bottom|left|right|\d+))+"
_WHOLE = {1: re.compile(rf"(?:(?:site|page|main|left|right|post)[-_]?)?(?:{'|'.join(sorted(MARKS))})(?:{_AFTER})?"), 2: re.compile(rf"(?:{'|'.join(sorted(INSIDE))})(?:{_AFTER})?")}
#: Those that mark an article.
GOOD = frozenset("article content main post entry story body text prose".split())
#: The share of a page's unlinked text that makes it the main part, which no mark and no form drops.
MAIN = 0.5


class Container(NamedTuple):
    path: int
    top: bool  # it is the page's body
    depth: int
    first: int
    around: int  # index of the container around it, or -1
    article: bool


class Dropper(NamedTuple):
    around: int  # index of the dropping element around it, or -1
    marked: bool  # it drops by its marks or as a form only
    loose: bool  # a telling word stands among others in its names, no more
    inner: list[int]  # characters outside links for which it is the innermost one, and whether an article's container is in or at it


class Open(NamedTuple):
    tag: str
    dropping: bool
    around: int  # container
    within: int  # dropping element
    level: int  # 2 inside of article, 1 inside of main, else 0
    barrier: int  # place in the stack of the nearest element that is not inline, itself included


class Page(NamedTuple):
    blocks: list[tuple[str, int, int]]  # text, characters outside links, innermost container
    containers: list[Container]
    ends: list[int]
    droppers: list[Dropper]


def _name(tag: str, classes: str) -> str:
    kept = sorted({re.sub(r"\d+", "#", c) for c in classes.split() if not _HASHED.fullmatch(c)})[:3]
    return ".".join([tag, *kept])


def path_hash(path: str) -> int:
    """The hash of a path written as ``>body>div.entry``."""
    out = 0
    for name in path.split(">")[1:]:
        out = _step(out, name)
    return out


def _step(around: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{around}>{name}") >> 1


def parse(html: str) -> Page:
    """The blocks of a page outside what is no article, and its containers. Marks and forms around the main part of its text drop nothing, nor do any if else nothing is left."""
    page = _parse(html)
    if kept := _spared(page):
        page = _parse(html, kept)
    if not page.blocks and (marked := frozenset(k for k, d in enumerate(page.droppers) if d.marked)):
        page = _parse(html, marked)
    return page


def _spared(page: Page) -> frozenset[int]:
    """The marked elements that hold the main part of the unlinked text, less what others in them drop. One without an article's container, such as a long advertisement, does not count if one with text is outside, unless it is marked loosely."""
    held, good = [d.inner[0] for d in page.droppers], [bool(d.inner[1]) for d in page.droppers]
    total = sum(b[1] for b in page.blocks) + sum(d.inner[0] for d in page.droppers if d.marked)
    outside: bool | None = None
    spared = set()
    for k in range(len(page.droppers) - 1, -1, -1):  # inner ones come after those around them
        d = page.droppers[k]
        if not d.marked or held[k] <= MAIN * total:
            continue
        if outside is None:
            outside = _has_article(page)
        if good[k] or d.loose or not outside:
            spared.add(k)
            if d.around >= 0:
                held[d.around] += held[k]
                good[d.around] |= good[k]
    return frozenset(spared)


def _has_article(page: Page) -> bool:
    """Is unlinked text inside an article's container, the page's body aside?"""
    inside = [False] * len(page.containers)
    for i, c in enumerate(page.containers):
        inside[i] = (c.around >= 0 and inside[c.around]) or (c.article and not c.top)
    return any(plain and inside[i] for _, plain, i in page.blocks)


def _marked(level: int, names: list[str], words: set[str], roles: list[str]) -> bool:
    if not ROLES.isdisjoint(roles):
        return True
    if level:
        return any(map(_WHOLE[level].fullmatch, names))
    return not MARKS.isdisjoint(words)


def _parse(html: str, spared: frozenset[int] = frozenset()) -> Page:
    """One pass, in which the dropping elements with the numbers ``spared`` drop nothing. Unclosed and stray tags are borne."""
    blocks: list[tuple[str, int, int]] = []
    containers, ends = [Container(0, False, 0, 0, -1, False)], [0]
    droppers: list[Dropper] = []
    stack: list[Open] = []
    many: dict[str, int] = {}  # open elements of each tag
    text: list[str] = []
    inside, within, drop, links, plain, level, at, n = 0, -1, 0, 0, 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal plain
        if text:
            if words := " ".join("".join(text).split()):
                blocks.append((words, plain, inside))
            text.clear()
            plain = 0

    def take(upto: int) -> None:
        nonlocal plain
        if upto > at and drop:
            if not links and not html[at:upto].isspace():
                droppers[within].inner[0] += upto - at
        elif upto > at:
            piece = html[at:upto]
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if not links:
                plain += len(piece) if not piece.isspace() else 0

    def close(depth: int) -> None:
        nonlocal inside, within, drop, links, level
        while len(stack) > depth:
            tag, dropping, around, within, level, _ = stack.pop()
            many[tag] -= 1
            drop -= dropping
            links -= tag == "a"
            if tag in CONTAINERS:
                ends[inside] = len(blocks)
                inside = around

    tags, scan, last = _TAG, 0, html.rfind(">")
    while True:
        start = html.find("<", scan)
        if start < 0 or (start > last and not html.startswith("<!--", start)):
            take(n)
            break
        found = tags.match(html, start)
        if not found:
            if tags is _TAG and _BEGINS.match(html, start):
                tags = _LOOSE  # its quotes run to the end of the page
            else:
                scan = start + 1
            continue
        take(start)
        at = scan = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if found[1]:
            if many.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = scan = end.end() if end else n
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and tag not in ("html", "body") and stack:  # an open paragraph ends here, and an open item of the same kind
            k = stack[-1].barrier
            if k >= 0 and (stack[k].tag == "p" or (stack[k].tag == tag and tag in ITEMS)):
                close(k)
        classes, names, words, roles, hidden, body = "", [], set(), [], False, False
        if found[3]:
            for a in _ATTRIBUTE.finditer(found[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "hidden":
                    hidden = True
                    continue
                classes = value if key == "class" else classes
                body |= key == "itemprop" and value == "articleBody"
                words |= {x.lower() for x in _NAMES.findall(value)}
                if key == "role":
                    roles += value.lower().split()
                elif key != "itemprop":
                    names += value.lower().split()
        whole = tag in ("html", "body", "main", "article") or body
        dropping = tag in DROPPED or hidden or (not whole and _marked(level, names, words, roles))
        stack.append(Open(tag, dropping and len(droppers) not in spared, inside, within, level, (stack[-1].barrier if stack else -1) if tag in INLINE else len(stack)))
        many[tag] = many.get(tag, 0) + 1
        if dropping:
            loose = not hidden and tag not in DROPPED and ROLES.isdisjoint(roles) and not any(map(_WHOLE[1].fullmatch, names))
            droppers.append(Dropper(within, not hidden and (tag == "form" or tag not in DROPPED), loose, [0, 0]))
            within = len(droppers) - 1
            dropping = within not in spared
        level = max(level, 2 if tag == "article" or body else 1 if tag == "main" or "main" in roles else 0)
        drop += dropping
        links += tag == "a"
        if tag in CONTAINERS:
            article = tag in ("article", "main") or not GOOD.isdisjoint(words)
            if article and within >= 0:
                droppers[within].inner[1] = 1
            containers.append(Container(_step(containers[inside].path, _name(tag, classes)), tag == "body" and inside == 0, containers[inside].depth + 1, len(blocks), inside, article))
            ends.append(0)
            inside = len(containers) - 1
    flush()
    close(0)
    ends[0] = len(blocks)
    return Page(blocks, containers, ends, droppers)


def scores(page: Page) -> list[float]:
    """The score of each container; the first one is the page."""
    out = [0.0] * len(page.containers)
    for _, plain, inside in page.blocks:
        out[inside] += plain
    for i in range(len(out) - 1, 0, -1):  # inner ones come after those around them
        out[page.containers[i].around] += LEVEL * out[i]
    return [s * ARTICLE if c.article else s for s, c in zip(out, page.containers)]


def best(page: Page, score: list[float]) -> int:
    return max(range(len(score)), key=lambda i: (score[i], page.containers[i].depth, -i))


def text_of(page: Page, chosen: list[int]) -> str:
    """The text of the chosen containers and of what stands beside them, but for what is mostly links there."""
    within = [False] * len(page.blocks)
    above = {0}
    for i in chosen:
        within[page.containers[i].first : page.ends[i]] = [True] * (page.ends[i] - page.containers[i].first)
        while i not in above:
            above.add(i)
            i = page.containers[i].around
    widest = [-1] * len(page.containers)  # the widest container around each that has no chosen one in it
    for i, c in enumerate(page.containers):
        if i not in above:
            widest[i] = i if c.around in above else widest[c.around]
    beside: dict[tuple[int, int], list[int]] = {}
    for k, (_, _, inside) in enumerate(page.blocks):
        if not within[k]:
            beside.setdefault((inside, k) if inside in above else (widest[inside], -1), []).append(k)
    for group in beside.values():
        if sum(page.blocks[k][1] for k in group) >= UNLINKED * sum(len(page.blocks[k][0]) for k in group):
            for k in group:
                within[k] = True
    return " ".join(b[0] for b, kept in zip(page.blocks, within) if kept)


def _covers(page: Page, here: list[int], first: int, end: int) -> bool:
    """Do containers that follow each other hold all blocks from ``first`` to ``end``?"""
    for i in here:
        if page.containers[i].first <= first < page.ends[i]:
            first = page.ends[i]
    return first >= end


def extract(html: str, paths: list[int]) -> str:
    """The text under the first winning path that holds all that the page's own best container holds, else under the path of that one."""
    page = parse(html)
    if not page.blocks:
        return ""
    if not any(plain for _, plain, _ in page.blocks):  # all of it is links
        page = page._replace(blocks=[(t, len(t), inside) for t, _, inside in page.blocks])
    score = scores(page)
    own = best(page, score)
    on: dict[int, list[int]] = {}
    for i, c in enumerate(page.containers):
        if score[i] > 0:
            on.setdefault(c.path, []).append(i)
    for path in [*paths, page.containers[own].path]:
        if path in on and _covers(page, on[path], page.containers[own].first, page.ends[own]):
            return text_of(page, on[path])
    return text_of(page, [own])


def host(url_col: str) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def host_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``host`` and the ``paths`` with at least ``share`` of its votes, by votes, then score, then path, from ``host`` and ``html`` of all pages."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            votes = []
            for h, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                page = parse(html)
                score = scores(page)
                top = best(page, score)
                if score[top] > 0:
                    votes.append((h, page.containers[top].path, score[top]))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in votes], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64()))], ["host", "path", "score"])

    counts = in_arrow(pages.select("host", "html"), vote, "host string, path long, score double").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score")).alias("score"))
    all_votes = counts.groupBy("host").agg(F.sum("votes").alias("all"))
    won = salted_join(counts, all_votes, "host", "inner").filter(F.col("votes") >= share * F.col("all"))
    return won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path"))), lambda x: x["path"]).alias("paths"))  # 1 / share entries at most


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Extract every page's main text: ``id_col``, ``url_col``, ``text`` and ``n_chars``.

    Null or empty html gives an empty text; pages without a host, a null url included, vote together. Character references are decoded, white space in a
    block becomes one space, blocks are joined by one. Broken, unclosed and very deep markup is read in time and memory in proportion to its length. Rows are kept one for one; other columns are not read.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), host(url_col).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    winners = host_paths(slim)
    hosts = slim.agg(F.approx_count_distinct("host")).first()[0]
    joined = slim.join(hinted_small(winners, hosts, BROADCAST_HOSTS), "host", "left").select("id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [extract(html, paths or []) for html, paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    out = in_arrow(joined, run, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
