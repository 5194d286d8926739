"""HTML extraction by composite text density.

Each page is read into a flat list of nodes in page order. Menus, forms, scripts and the like are cut away by
what their tags and names say, but no name cuts what holds the page. Every remaining node has a density: its characters
per tag, adjusted by the share of characters and tags in links. The densest node's path to the body sets a threshold, and
among nodes at or above it the one whose children's densities have the largest sum is the main text, with what stands
beside it at or above the threshold.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.rows import map_batches

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PART = re.compile(r"[a-z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead tr".split()) | {"dd", "dt", "li"}
#: A start tag ends an open element of its group, unless one of the named elements lies between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
DROPPED_TAGS = frozenset("nav footer aside button select input dialog menu fieldset search head".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: A class or id counts as one of these only as a whole, or if all its other parts are plain ones: "site-footer", not "has-sidebar".
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer masthead topbar comment comments commentlist reply replies respond disqus discussion cookie "
    "cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended widget widgets toolbar pagination pager copyright disclaimer".split()
)
PLAIN_NAMES = frozenset(
    "site page main global top bottom left right upper lower primary secondary box block list item items link links bar section area "
    "container wrapper wrap inner outer holder row col button buttons icon icons form body text author meta thread posts post user users "
    "zone slot unit header title group panel div module".split()
)
MOSTLY_LINKS = 0.66
LISTS = frozenset("ul ol div section table dl".split())
#: A named block or form with this many times the text of all the rest is no addition to a page, but the page.
BULK = 20
HARD, SOFT = 1, 2


class _Page:
    """Nodes of a page in order: tag, parent, last descendant, why cut away (0: not); and its text and breaks."""

    def __init__(self) -> None:
        self.tag, self.parent, self.end, self.cut = ["#root"], [0], [0], [0]
        self.events: list[tuple[int, str | None]] = []

    def add(self, tag: str, parent: int, cut: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.end.append(0)
        self.cut.append(cut)
        return len(self.tag) - 1


def _is_named(value: str, in_article: bool) -> bool:
    """Does a class or id say that its element is no part of the text?"""
    for token in value.split():
        parts = set(NAME_PART.findall(token))
        names = parts & DROPPED_NAMES or (parts & {"header"} if not in_article else set())
        if names and all(p in DROPPED_NAMES or p in PLAIN_NAMES or p.isdigit() for p in parts):
            return True
    return False


def _why_cut(tag: str, attributes: str, in_article: bool) -> int:
    """``HARD``: what the tag, its role or style settle. ``SOFT``: names and forms, which do not hold if they hold the page."""
    if tag in DROPPED_TAGS or (tag == "header" and not in_article):
        return HARD
    why = SOFT if tag == "form" else 0
    if not attributes.strip() or tag in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return why
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            why = SOFT if _is_named(value, in_article) else why
        elif name == "role" and value.strip() in DROPPED_ROLES:
            return HARD
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HARD
        elif name == "aria-hidden" and value == "true":
            return HARD
    return HARD if re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)) else why


def _read(source: str) -> _Page:
    page, place, size = _Page(), 0, len(source)
    stack: list[tuple[str, int]] = [("#root", 0)]

    def close(count: int) -> None:
        while len(stack) > count:
            tag, node = stack.pop()
            if page.tag[node] == tag:
                page.end[node] = len(page.tag)
                if tag in BLOCKS:
                    page.events.append((page.parent[node], None))

    while place < size:
        found = MARKUP.search(source, place)
        start = found.start() if found else size
        if start > place:
            page.events.append((stack[-1][1], source[place:start]))
        if not found:
            break
        place = found.end()
        slash, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            for level in range(len(stack) - 1, 0, -1):
                if stack[level][0] == tag:
                    close(level)
                    break
                if tag not in BLOCKS and stack[level][0] in BLOCKS or stack[level][0] == "table" and tag in ("p", "div", "li"):
                    break
            continue
        if tag in ("html", "body") and any(t == tag for t, _ in stack):
            continue
        if tag in CLOSES_P:
            for level in range(len(stack) - 1, 0, -1):
                if stack[level][0] == "p":
                    close(level)
                    break
                if stack[level][0] in BLOCKS:
                    break
        if tag in SIBLINGS:
            ends, walls = SIBLINGS[tag]
            for level in range(len(stack) - 1, 0, -1):
                if stack[level][0] in walls:
                    break
                if stack[level][0] in ends:
                    close(level)
                    if not (tag == "tr" and any(t in ends for t, _ in stack)):
                        break
        if tag == "body" and stack[-1][0] == "head":
            close(len(stack) - 1)
        inside = stack[-1][1]
        if tag == "br":
            page.events.append((inside, " "))
        if tag in VOID:
            if tag in BLOCKS:
                page.events.append((inside, None))
            continue
        in_article = any(t in ("article", "main") for t, _ in stack)
        cut = _why_cut(tag, attributes, in_article)
        node = inside
        if tag in BLOCKS or tag == "a" or cut:
            node = page.add(tag, inside, cut)
            if tag in BLOCKS:
                page.events.append((inside, None))
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, place)
            place = stop.start() if stop else size
            page.end[node] = len(page.tag)
            after = source.find(">", place)
            place = size if after < 0 else after + 1
            continue
        if not attributes.rstrip().endswith("/") or tag in BLOCKS or tag == "a":
            stack.append((tag, node))
    close(1)
    page.end[0] = len(page.tag)
    return page


def _own_chars(page: _Page) -> list[int]:
    own = [0] * len(page.tag)
    for node, text in page.events:
        if text:
            own[node] += len("".join(text.split()))
    return own


def _settle_cuts(page: _Page, own: list[int]) -> None:
    """Lift soft cuts that hold the page's articles or nearly all its text, then pass cuts on to what lies below."""
    count = len(page.tag)
    holds_article = [False] * count
    for node in range(count - 1, 0, -1):
        if page.tag[node] in ("article", "main"):
            holds_article[node] = not page.cut[node]
        holds_article[page.parent[node]] |= holds_article[node] and page.cut[page.parent[node]] != HARD
    for node in range(1, count):
        if page.cut[node] == SOFT and holds_article[node]:
            page.cut[node] = 0
    while True:
        under, kept = [0] * count, [0] * count  # the outermost soft cut above a node; text below a soft cut that no other cut takes
        rest = own[0]
        for node in range(1, count):
            above = page.parent[node]
            if page.cut[node] == HARD or under[above] < 0 or (page.cut[node] and under[above]):
                under[node] = -1
            else:
                under[node] = node if page.cut[node] else under[above]
            if under[node] > 0:
                kept[under[node]] += own[node]
            elif not under[node]:
                rest += own[node]
        largest = max(range(count), key=lambda n: (kept[n], -n))
        if not kept[largest] or kept[largest] <= BULK * rest:
            break
        page.cut[largest] = 0
    for node in range(1, count):
        page.cut[node] = page.cut[node] or page.cut[page.parent[node]]


class _Densities:
    """Composite text density of every node that is not cut, and the sum over its children."""

    def __init__(self, page: _Page, own: list[int]) -> None:
        count = len(page.tag)
        chars = [0 if page.cut[n] else own[n] for n in range(count)]
        links = [chars[n] if page.tag[n] == "a" else 0 for n in range(count)]
        tags, link_tags = [0] * count, [0] * count
        for node in range(count - 1, 0, -1):
            up = page.parent[node]
            if not page.cut[node]:
                if page.tag[node] == "a":
                    links[node], link_tags[node] = chars[node], tags[node] + 1
                chars[up] += chars[node]
                links[up] += links[node]
                tags[up] += tags[node] + 1
                link_tags[up] += link_tags[node]
        self.chars, self.links = chars, links
        page_links, page_chars = links[0], max(chars[0], 1)
        self.density = density = [0.0] * count
        for node in range(count):
            c, lc, t, lt = chars[node], links[node], max(tags[node], 1), max(link_tags[node], 1)
            if c and not page.cut[node]:
                base = math.log(c / max(c - lc, 1) * lc + page_links / page_chars * c + math.e)
                density[node] = c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0) + 1) / max(base, 1.0)
        self.total = total = [0.0] * count
        for node in range(1, count):
            total[page.parent[node]] += density[node]
        for node in range(count):
            total[node] += 0.0 if total[node] else density[node] * 0.5  # a node without children stands below one that holds it


def _chosen(page: _Page) -> list[int]:
    """The subtrees that are the main text, in page order.

    The subtree with the largest sum of densities among nodes at or above the threshold, the least density on the densest node's path
    to the body. It grows to the article or main element it stands in and is joined by other articles at or above the threshold. Where there
    are none it is joined by its siblings at or above it, and grows to its parent where these are most of that.
    """
    count, own = len(page.tag), _own_chars(page)
    _settle_cuts(page, own)
    cut = list(page.cut)
    found = _Densities(page, own)
    in_article = [False] * count
    for node in range(1, count):
        in_article[node] = page.tag[node] in ("article", "main") or in_article[page.parent[node]]
        lists = page.tag[node] in LISTS and not in_article[node] and found.chars[node] and found.links[node] >= MOSTLY_LINKS * found.chars[node]
        page.cut[node] = page.cut[node] or (HARD if lists else 0) or page.cut[page.parent[node]]
    if found.chars[0] and not any(own[n] for n in range(count) if not page.cut[n]):
        page.cut = cut  # a page of nothing but links
    found = _Densities(page, own)
    density, total = found.density, found.total
    densest = max(range(count), key=lambda n: (density[n] if page.tag[n] != "a" else 0.0, -n))
    threshold, node = density[densest], densest
    while node:
        node = page.parent[node]
        if page.tag[node] not in ("#root", "html"):
            threshold = min(threshold, density[node])
    best = max((n for n in range(count) if density[n] >= threshold and page.tag[n] != "a"), key=lambda n: (total[n], -n), default=0)
    outer = node = best
    while node:
        outer = node if page.tag[node] in ("article", "main") else outer
        node = page.parent[node]
    if page.tag[outer] in ("article", "main"):
        top = [n for n in range(1, count) if page.tag[n] in ("article", "main") and not in_article[page.parent[n]]]
        return [n for n in top if n == outer or (not page.cut[n] and density[n] >= threshold)]
    chars = found.chars
    while True:
        up = page.parent[outer]
        # A short section among sections is below the density of the whole body, which has more text to a tag.
        least = {"section": threshold / 2} if page.tag[outer] == "section" else {}
        beside = [
            n for n in range(1, count)
            if page.parent[n] == up and page.tag[n] in BLOCKS and not page.cut[n] and density[n] >= least.get(page.tag[n], threshold)
        ]
        if not outer or page.tag[up] in ("#root", "html", "body") or 2 * sum(chars[n] for n in {outer, *beside}) < chars[up]:
            break
        outer = up  # its block is mostly main text: so is the rest of the block
    if len(beside) < 2 or not outer:
        return [outer]
    first, last = min(outer, *beside), max(outer, *beside)  # with what lies between, such as headings
    return [n for n in range(first, last + 1) if page.parent[n] == up]


def main_text(source: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by two line feeds; empty if there is none.

    Character references are decoded and white space within a block becomes one space. A null or empty page
    gives an empty text. Open elements end with the page, so cut-off pages keep what they have.
    """
    if not source:
        return ""
    page = _read(source)
    chosen = _chosen(page)
    inside = [False] * len(page.tag)
    for node in chosen:
        inside[node : page.end[node]] = [True] * (page.end[node] - node)
    found, block = [], []
    for node, text in [*page.events, (0, None)]:
        if text is None:
            if block:
                words = html.unescape("".join(block)).split()
                if words:
                    found.append(" ".join(words))
                block = []
        elif inside[node] and not page.cut[node]:
            block.append(text)
    return "\n\n".join(found)


def extract(pages: DataFrame, source: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: id, url, main text and its length in code points; repeated rows stay repeated."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    read = pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"), F.col(f"`{source}`").cast("string").alias("_html"))
    done = map_batches(read, work, "text string, n_chars long", ["_key", "_url"])
    return done.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars")
