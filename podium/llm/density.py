"""Main text of web pages by composite text density.

A page becomes a tree of its elements, as arrays in page order. Elements that are never the article
(menus, headers, footers, adverts, forms, scripts and the like, by tag, role or name) keep no text.
For every other node the density is the number of characters per tag, adjusted by how much of it is
links, and the sum is that of its children's densities. The node with the largest sum is the article;
what lies beside the path from it to the body belongs to it too if it is at least as dense as the
thinnest node of that path. Where a page marks articles, the largest sum is sought within them.
"""

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import types as T

from podium.llm.common import mapped

# Element names of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp "
    "rt ruby s samp small span strike strong sub sup time tt u var wbr img svg math button input "
    "select textarea script style noscript template iframe object embed audio video canvas map area "
    "link meta base param source track".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(
    "head title script style noscript template iframe noembed noframes object embed svg canvas audio "
    "video map select option optgroup datalist button input textarea nav header footer aside form "
    "menu dialog xmp rp".split()
)
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "status tablist toolbar tooltip".split()
)
# Words of class names and ids that name what is not the article.
DROPPED_NAMES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising adv sponsor "
    "sponsored sponsors promo promos promoted promotion banner banners cookie cookies consent gdpr "
    "notice notices notification notifications alert alerts popup popups modal overlay newsletter "
    "subscribe subscription signup signin login menu menus nav navbar navigation navi breadcrumb "
    "breadcrumbs sidebar sidebars aside widget widgets related recommended recommendations share "
    "sharing social comment comments commentlist replies reply respond disqus discussion footer "
    "header masthead topbar form forms search searchbox searchform pagination pager toolbar copyright "
    "disclaimer skip skiplink hidden".split()
)
# What follows the first of these in a name, or all of a name that ends with the second, tells of the
# page around or of a state, not of what the element is.
MODIFIERS = frozenset("has have with without no not is js".split())
STATES = frozenset("open opened closed enabled disabled active".split())
HEAD = frozenset("title meta link script style base noscript template head html body".split())
CLOSED_BY_SAME = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "thead": ("thead tbody tfoot", ("table",)),
    "tbody": ("thead tbody tfoot", ("table",)),
    "tfoot": ("thead tbody tfoot", ("table",)),
    "option": ("option", ("select", "datalist")),
}
SCOPES = frozenset("table td th caption button object template html".split())

_MARKUP = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))"  # a comment
    r"|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)"
    r"(?P<rest>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)"
    r"|[!?/][^>]*(?:>|\Z))",
    re.S,
)
_PLAIN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(\s*/?)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _attributes(rest):
    """Attributes of a tag, lower-cased names, decoded values; the first of a name counts."""
    found = {}
    for name, value in _ATTRIBUTE.findall(rest):
        value = value[1:-1] if value[:1] in ("'", '"') else value
        found.setdefault(name.lower(), unescape(value))
    return found


def _is_named(attributes):
    """Whether class or id say that an element is not part of an article."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[-1] in STATES:
            continue
        told = next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))
        if not DROPPED_NAMES.isdisjoint(words[:told]):
            return True
    return False


def _is_hidden(attributes):
    style = attributes.get("style", "").replace(" ", "").lower()
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
        or "visibility:hidden" in style
    )


class Page:
    """The elements of a page in page order: tag, parent, whether dropped or named; and its texts."""

    def __init__(self, html):
        self.tags, self.parents, self.dropped, self.named = ["#root"], [-1], [False], [False]
        self.texts = []  # (node, text), or (node, None) where a block begins or ends
        self._open = [0]  # the nodes that are open
        self._at = {}  # the places of open nodes by tag, and of all blocks and scopes
        self._read(html)

    def _push(self, tag, attributes):
        node = len(self.tags)
        block = tag not in INLINE
        if block:
            self.texts.append((node, None))
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        drop = tag in DROPPED
        named = False
        if attributes:
            drop = drop or _is_hidden(attributes)
            named = tag not in ("html", "body", "main", "article") and (
                attributes.get("role", "").lower() in DROPPED_ROLES or _is_named(attributes)
            )
            named = named or (tag == "article" and _is_named({"class": attributes.get("class", "")}))
        self.dropped.append(drop)
        self.named.append(named)
        if tag not in VOID:
            place = len(self._open)
            self._open.append(node)
            for key in self._keys(tag, block):
                self._at.setdefault(key, []).append(place)

    @staticmethod
    def _keys(tag, block):
        return (tag, *(("#block",) if block else ()), *(("#scope",) if tag in SCOPES else ()))

    def _last(self, key):
        places = self._at.get(key)
        return places[-1] if places else 0

    def _close_to(self, place):
        """Close the open nodes from ``place`` on."""
        while len(self._open) > place:
            node = self._open.pop()
            tag = self.tags[node]
            block = tag not in INLINE
            if block:
                self.texts.append((node, None))
            for key in self._keys(tag, block):
                self._at[key].pop()

    def _start(self, tag, attributes):
        if tag in ("html", "body") and self._last(tag):
            return
        if self._last("head") and (tag == "body" or tag not in HEAD):
            self._close_to(self._last("head"))
        if tag in CLOSED_BY_SAME:
            same, inside = CLOSED_BY_SAME[tag]
            place = max(self._last(t) for t in same.split())
            if place > max(self._last(t) for t in inside):
                self._close_to(place)
        elif tag not in INLINE and tag != "br":
            place = self._last("p")
            if place > self._last("#scope"):
                self._close_to(place)
        self._push(tag, attributes)

    def _end(self, tag):
        place = self._last(tag)
        if not place or tag in ("html", "body"):
            return
        if tag in INLINE and self._last("#block") > place:
            return  # it crosses a block, which stays
        self._close_to(place)

    def _read(self, html):
        at, size = 0, len(html)
        plain, markup = _PLAIN.match, _MARKUP.match
        while at < size:
            here = html.find("<", at)
            if here < 0:
                self._text(html[at:])
                break
            found = plain(html, here)
            if found:
                end, tag, rest = found[1], found[2], ""
            else:
                found = markup(html, here)
                if not found:  # a lone sign
                    self._text(html[at : here + 1])
                    at = here + 1
                    continue
                end, tag, rest = found["end"], found["name"], found["rest"]
            if here > at:
                self._text(html[at:here])
            at = found.end()
            if not tag:
                continue
            tag = tag.lower()
            if end:
                self._end(tag)
                continue
            self._start(tag, _attributes(rest) if rest else None)
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = stop.start() if stop else size
                self._end(tag)

    def _text(self, text):
        if "&" in text:
            text = unescape(text)
        self.texts.append((self._open[-1], text))


def _unless_all_inside(page, within):
    """Names do not drop an element that holds every article of the page."""
    marked = [i for i, t in enumerate(page.tags) if t in ("article", "main") and not page.named[i]]
    if not marked:
        return
    holds = [0] * len(page.tags)
    for node in marked:
        holds[node] += 1
    for node in range(len(page.tags) - 1, 0, -1):
        holds[page.parents[node]] += holds[node]
    for node, named in enumerate(page.named):
        if named and holds[node] == len(marked):
            within[node] = False


def densities(page):
    """(kept, density, sum of the children's densities, characters) of every node."""
    n = len(page.tags)
    named = list(page.named)
    _unless_all_inside(page, named)
    struck = [d or m for d, m in zip(page.dropped, named, strict=True)]
    kept, linked = [True] * n, [False] * n
    for node in range(1, n):
        kept[node] = kept[page.parents[node]] and not struck[node]
        linked[node] = page.tags[node] == "a" or linked[page.parents[node]]
    own, own_links = [0] * n, [0] * n
    for node, text in page.texts:
        if text is not None and kept[node]:
            size = len(text.strip())
            own[node] += size
            if linked[node]:
                own_links[node] += size
    chars, links = own[:], own_links[:]
    tags, link_tags, children = [0] * n, [0] * n, [0] * n
    for node in range(n - 1, 0, -1):
        up = page.parents[node]
        if kept[node]:
            chars[up] += chars[node]
            links[up] += links[node]
            tags[up] += tags[node] + 1
            link_tags[up] += link_tags[node] + (page.tags[node] == "a")
            children[up] += 1
    whole = links[0] / chars[0] if chars[0] else 0.0

    def density(node):
        c, t = chars[node], tags[node] or 1
        if not c:
            return 0.0
        lc, lt = links[node], link_tags[node]
        base = log(log(c / ((c - lc) or 1) * lc + whole * c + e))
        if base <= 0:  # a page without links
            return c / t
        return c / t * max(0.0, log(max(1.0, c / (lc or 1) * t / (lt or 1)))) / max(base, 0.1)

    dense = [density(node) if kept[node] else 0.0 for node in range(n)]
    sums = [0.0] * n
    for node in range(n - 1, 0, -1):
        if kept[node]:
            # Text of its own counts like one more child.
            sums[node] += own[node] / (1 + children[node]) if children[node] else dense[node]
            sums[page.parents[node]] += dense[node]
    sums[0] += own[0] / (1 + children[0])
    return kept, dense, sums, chars


def main_text(html):
    """The article of a page as text: blocks in page order, one space for all white space."""
    page = Page(html)
    kept, dense, sums, chars = densities(page)
    n = len(page.tags)
    marked = [False] * n
    for tag in ("article", "main"):
        for node in range(1, n):
            marked[node] = kept[node] and (marked[page.parents[node]] or page.tags[node] == tag)
        if any(marked[i] and chars[i] for i in range(n)):
            break
    else:
        marked = kept
    best = max((i for i in range(n) if marked[i]), key=lambda i: (sums[i], -i), default=0)
    body = next((i for i in range(n) if page.tags[i] == "body"), 0)
    path = [best]
    while path[-1] > body:
        path.append(page.parents[path[-1]])
    unit = next((i for i in reversed(path) if page.tags[i] in ("article", "main") and marked[i]), None)
    chosen = set()
    if unit is not None:
        chosen.add(unit)
    else:
        limit = min(dense[i] for i in path)
        if best not in (0, body):
            chosen.add(best)
        above = set(path if best in (0, body) else path[1:])
        for node in range(1, n):
            if page.parents[node] in above and node not in above and kept[node]:
                heads = page.tags[node] in HEADINGS and node < best
                if chars[node] and (heads or dense[node] >= limit):
                    chosen.add(node)
        if best in (0, body):
            chosen.add(-1)  # its own text
    inside = [False] * n
    for node in range(n):
        up = page.parents[node]
        inside[node] = kept[node] and (node in chosen or (up >= 0 and inside[up]))
    own = {0, body} if -1 in chosen else ()
    pieces = [
        " " if text is None else text
        for node, text in page.texts
        if text is None or inside[node] or (node in own and kept[node])
    ]
    return " ".join("".join(pieces).split())


def extracted(pages):
    """page_id, url, text and n_chars of the main text of each row of ``pages`` (page_id, url, html).

    White space inside a block becomes one space; blocks are joined by one. A null or empty page, and
    one without an article, has an empty text. Null ids and urls stay null; repeated rows are each
    answered; other columns are not read; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", "html")
    schema = T.StructType(
        [
            *rows.schema.fields[:2],
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def extract(batches):
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return mapped(rows, extract, schema)
