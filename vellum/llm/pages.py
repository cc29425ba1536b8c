"""Main text of web pages by composite text density.

Sun, Song and Liao, "DOM Based Content Extraction via Text Density" (2011). A page is read into block
nodes. With C characters, T tags, LC characters in links and LT link tags below a node (each at least
1 as a divisor) and the same for the body, a node's composite density is
C / T * log_b(C / LC * T / LT) with b = ln(C / (C - LC) * LC + LC_body / C_body * C + e); a node's density sum adds
its children's densities. The subtree of greatest sum is content. The threshold is the least density on its path to
the body, the body itself left out, as it is dense wherever the page is little else. What branches off that path is content if it is as dense
as the threshold, if it is an article or in one, or if it is a heading of what follows; so unnamed menus, footers and notices
fall to their density. In what is left, unless in an article, blocks of mostly links, two at least, are menus.

Before that, parts that are no content by their tag, or by a class, id or role made of nothing but words for such
parts, are left out with all below them: menus, headers outside articles, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments. `comments-open` or `share-price` name no such part. In an article only unambiguous words count, and
no id of a section, heading or paragraph, which is an anchor. Formatting tags, formulas and drawings are neither nodes nor counted.

Text: character references are decoded, white space in a block becomes one space, empty blocks are
left out, blocks are joined by a line feed in page order. Nothing else is dropped.

Edge cases: null, empty or text-less html gives an empty text; html without tags is one block; tags
that are never closed end with their parent; repeated rows get equal results; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import chunks, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+|[^>]*+)>", re.S)
NAMES = re.compile(r"(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")

# Tags by what they do to the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title".split())
LEFT_OUT = frozenset("head nav footer aside form button select dialog menu fieldset canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math semantics annotation mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose mmultiscripts"
    " object svg g defs use path text tspan rect circle ellipse line polyline polygon".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A tag ends an open one of these, not above the boundary.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
# Words in a class, id or role that mark what is no content.
BOILERPLATE = frozenset(
    [
        "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary", "contentinfo", "consent", "cookie", "cookies",
        "disqus", "dropdown", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pagination", "paywall", "popup", "promo",
        "related", "search", "share", "sharing", "sidebar", "signup", "social", "sponsored", "subscribe", "toolbar", "widget",
    ]
)
# Words that may stand beside those.
NEUTRAL = frozenset(
    [
        "and", "area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "form", "global", "group", "header", "inner", "item", "items", "js", "left",
        "link", "links", "list", "main", "nested", "outer", "page", "panel", "posts", "primary", "reader", "right", "secondary", "section", "site", "slot", "thread", "top", "user", "wrap", "wrapper",
    ]
)
# Those of the first that are ambiguous in an article, and tags whose id is an anchor there.
AMBIGUOUS = frozenset(["dropdown", "menu", "modal", "nav", "overlay", "related", "search", "share", "sharing", "social", "toolbar", "widget"])
ANCHORED = frozenset("section h1 h2 h3 h4 h5 h6 p".split())
#: The same as the first, but for an article's own header.
HEADERS = frozenset(["header", "banner"])


class _Page:
    """A page's block nodes in page order, and its pieces of text."""

    def __init__(self) -> None:
        self.parent, self.tag, self.end = [-1], ["body"], [1]
        self.chars, self.linked, self.tags, self.links = [0], [0], [0], [0]
        self.article = [False]
        self.pieces: list[tuple[int, int, str]] = []


def _is_left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    for m in NAMES.finditer(attributes):
        if in_article and m[1].lower() == "id" and tag in ANCHORED:
            continue
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(WORD.findall(name))
            marks = words & (BOILERPLATE - AMBIGUOUS if in_article else BOILERPLATE | HEADERS)
            if tag in ("body", "html", "article", "main"):
                marks &= {"comment", "comments"}
            if marks and words <= BOILERPLATE | HEADERS | NEUTRAL:
                return True
    return False


def parse(page: str) -> _Page:
    """Reads a page in one pass over its tags."""
    out = _Page()
    #: Open elements: tag, node (or the parent's for formatting), whether left out.
    stack: list[tuple[str, int, bool]] = [("body", 0, False)]
    block, at, link, articles, last = 0, 0, 0, 0, page.rfind(">")
    #: How many elements of a tag are open: no stack is searched for one that is not.
    opened: Counter[str] = Counter()

    def close(depth: int) -> None:
        nonlocal link, articles
        while len(stack) > depth:
            tag, _, _ = stack.pop()
            opened[tag] -= 1
            if tag == "a":
                link -= 1
            elif tag in ("article", "main"):
                articles -= 1

    def text(piece: str) -> None:
        tag, node, hidden = stack[-1]
        if hidden or not piece:
            return
        piece = html.unescape(piece)
        out.pieces.append((node, block, piece))
        size = len("".join(piece.split()))
        out.chars[node] += size
        if link > 0:
            out.linked[node] += size

    while at < len(page):
        m = TOKEN.search(page, at) if at <= last else None
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[depth][0] == tag:
                    close(depth)
                    break
            if tag not in INLINE:
                block += 1
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            ended = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = ended.end() if ended else len(page)
            continue
        if tag not in INLINE:
            block += 1
            ends, bounds = ({"p"}, {"td", "th", "button"}) if tag in CLOSES_P else (set(), set())
            if tag in ENDS:
                ends, bounds = ends | ENDS[tag][0], bounds | ENDS[tag][1]
            for depth in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in ends) else ():
                if stack[depth][0] in bounds:
                    break
                if stack[depth][0] in ends:
                    close(depth)
                    break
        _, node, hidden = stack[-1]
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        if tag in INLINE:
            hidden = hidden or (bool(m[3]) and _is_left_out(tag, m[3], articles > 0))
            if tag == "a":
                link += 1
                if not hidden:
                    out.tags[node] += 1
                    out.links[node] += 1
            stack.append((tag, node, hidden))
            opened[tag] += 1
            continue
        hidden = hidden or _is_left_out(tag, m[3], articles > 0)
        if tag in ("article", "main"):
            articles += 1
        if not hidden:
            out.parent.append(node)
            out.tag.append(tag)
            out.article.append(articles > 0)
            for counts in (out.chars, out.linked, out.tags, out.links):
                counts.append(0)
            node = len(out.tag) - 1
        stack.append((tag, node, hidden))
        opened[tag] += 1
    out.end = _ends(out.parent)
    return out


def _ends(parent: list[int]) -> list[int]:
    """One past the last node below each node; nodes are in page order."""
    ends = [i + 1 for i in range(len(parent))]
    for i in range(len(parent) - 1, 0, -1):
        ends[parent[i]] = max(ends[parent[i]], ends[i])
    return ends


def _totals(page: _Page) -> tuple[list[int], list[int], list[int], list[int]]:
    """Characters, those in links, tags and link tags of every node with all below it."""
    chars, linked, tags, links = list(page.chars), list(page.linked), list(page.tags), list(page.links)
    for i in range(len(page.parent) - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        tags[p] += tags[i] + 1
        links[p] += links[i]
    return chars, linked, tags, links


def composite(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """The composite density of a node; share is the body's part of characters in links."""
    if not c:
        return 0.0
    t = max(t, 1)
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(max(base, 1 + 1e-9)) if base > 1 else math.log(c * t), 0.0)


def densities(page: _Page) -> tuple[list[float], list[float]]:
    """Composite density and density sum of every node."""
    chars, linked, tags, links = _totals(page)
    share = linked[0] / max(chars[0], 1)
    density = [composite(*node, share) for node in zip(chars, tags, linked, links, strict=True)]
    sums = [0.0] * len(density)
    for i in range(1, len(density)):
        sums[page.parent[i]] += density[i]
    return density, sums


def content_nodes(page: _Page) -> list[bool]:
    """Whether each node's own text is content."""
    n = len(page.parent)
    if n == 1:
        return [True]
    density, sums = densities(page)
    chars, linked, _, links = _totals(page)
    share = linked[0] / max(chars[0], 1)
    best = max(range(n), key=lambda i: (sums[i], -i))
    path = [best]
    while page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    threshold = min((density[i] for i in path if i), default=0.0)
    kept = [False] * n

    def keep(i: int) -> None:
        kept[i : page.end[i]] = [True] * (page.end[i] - i)

    keep(best)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[page.parent[i]].append(i)
    for below, node in itertools.pairwise(path):
        kept[node] = page.article[node] or composite(page.chars[node], 1, page.linked[node], page.links[node], share) >= threshold > 0
        follows = False
        for i in reversed(children[node]):
            follows = i == below or page.article[i] or density[i] >= threshold > 0 or (follows and page.tag[i] in HEADINGS)
            if follows and i != below:
                keep(i)
    on_path = set(path)
    i = 0
    while i < n:
        if kept[i] and not page.article[i] and i not in on_path and links[i] > 1 and 2 * linked[i] > chars[i]:
            kept[i : page.end[i]] = [False] * (page.end[i] - i)
            i = page.end[i]
        else:
            i += 1
    return kept


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    parsed = parse(page)
    kept = content_nodes(parsed)
    blocks: dict[int, list[str]] = {}
    for node, block, piece in parsed.pieces:
        if kept[node]:
            blocks.setdefault(block, []).append(piece)
    lines = (" ".join("".join(pieces).split()) for _, pieces in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "html"):
        texts = [extract(x) for x in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html": op4_html}
