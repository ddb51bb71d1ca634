"""Main text of web pages by tag-path ratios.

A page is cut into blocks, and each block has the path of block-level tags from
the root to it. Per path, text length and punctuation are aggregated and divided
by the number of blocks (text-to-path and punctuation-to-path ratios); the two
series are smoothed over the blocks in page order, fused with the share of text
outside links, and paths below a share of the best fused score are dropped. An article or main
element is held against the same share by the sum of its paths, and all blocks of a chosen one are kept. On
a page without one, so are the blocks beside and below those of the best path, but for those that are only links.
Containers whose tag or class says that they are furniture (menus, footers, adverts, forms, reader
comments) have no part in the scores. A class says so by a part of one of its words ("site-footer", "ad_top"), but not
if "no", "has" and the like stand before it ("no-sidebar"). What a class says isn't held against html, body, main and
article, nor against what holds the page's content: of all article and main elements those inside of the fewest
containers that are marked by class lift the marks of these; on a page without one, elements whose class is
a content word do. Reader comments stay out whatever holds them, also as articles of their own. A heading is kept with
the content of its container.

The work is a projection of each row, so it moves no data. Defined results: a
null or empty html, and a page without content, give an empty text. A tag that is
never closed ends with its container; a "<" that no ">" follows is text; the time is linear in the page, however bad
its markup; columns other than html, text and n_chars stay, whatever their names; a comment, script or style that is never
closed runs to the end of the page. Repeated rows are treated one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brainstate.llm.common import numbered, slices

#: A path is content if its fused score is at least this share of the page's best.
MIN_SHARE = 0.1
#: Blocks on each side that a smoothed ratio looks at, and the weight of the block itself.
RADIUS = 1
OWN_WEIGHT = 0.6

#: Elements by their role in HTML.
RAW = frozenset("script style noscript template iframe svg math canvas object textarea title select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var img wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("head nav footer aside button dialog menu label fieldset figcaption address".split())
#: Furniture, unless it holds the page's content.
MARKED = frozenset(["form"])
CONTENT = frozenset("article main".split())
#: Furniture outside of content, text inside of it.
TEXT_IN_CONTENT = frozenset("figcaption address label".split())
#: An element that ends where one of these starts in the same container.
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Elements whose class isn't asked.
UNASKED = frozenset("html body main article".split())
#: Words in a class or id that mark furniture, reader comments, and an article that is a comment.
FURNITURE_WORDS = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|sidebar|footer|cookies?|consent|notice|alert|share|sharing|social|"
    r"related|breadcrumbs?|subscribe|newsletter|login|signup|popup|modal|widget"
)
COMMENT_WORDS = r"comments?|commentlist|replies|respond|disqus"
COMMENT_ARTICLE = re.compile(r"\s(?:comment|reply)(?:[\s_-]|$)", re.I)
#: Words before a mark that turn it around, and after a comment's that tell a state.
_NOT = "".join(rf"(?<![\s_-]{word}[_-])" for word in ("no", "not", "has", "with", "without", "hide", "show"))
_STATE = r"(?![_-](?:open|closed|on|off|enabled|disabled)(?:\s|$))"
FURNITURE_CLASS = re.compile(rf"[\s_-]{_NOT}(?:{FURNITURE_WORDS})(?=[\s_-]|$)", re.I)
COMMENT_CLASS = re.compile(rf"[\s_-]{_NOT}(?:{COMMENT_WORDS})(?=[\s_-]|$){_STATE}", re.I)
#: Whole words in a class or id of what holds a page's content.
CONTENT_CLASS = re.compile(
    r"\s(?:content|main|main-content|page-content|article|article-body|article-content|post|post-body|post-content|entry|entry-content|story|"
    r"story-body)(?=\s|$)",
    re.I,
)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: A header by its class, and one that belongs to an article.
HEADER_CLASS = re.compile(rf"[\s_-]{_NOT}header(?=[\s_-]|$)", re.I)
OWN_HEADER_CLASS = re.compile(r"[\s_-](?:article|entry|post|story|content)[_-]+header(?=[\s_-]|$)", re.I)

_OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: What a tag has up to its end; quotes count only where a value begins. Nothing is tried twice.
_INSIDE = re.compile(r"(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+>")
_ATTRIBUTE = re.compile(r"([^\s=>/\"']+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))")
_MARKS = frozenset("class id role".split())


class _Open:
    """An open element: its tag, the number of its block path, whether it is furniture, the number of the path of the
    outermost content element, and the number of the innermost container around it that is marked by class."""

    __slots__ = ("content", "dropped", "mark", "path", "tag")

    def __init__(self, tag: str, path: int, dropped: bool, content: int, mark: int):
        self.tag, self.path, self.dropped, self.content, self.mark = tag, path, dropped, content, mark


class _Page:
    """The parts of a page. Number 0 is the root's path, and no content element or mark.

    blocks: (path, text, length of linked text, whether it is a heading, path of the content element, mark) outside
    furniture. parents: the path around each path. Paths and marks come after what is around them.
    """

    def __init__(self):
        self.blocks: list[tuple[int, str, int, bool, int, int]] = []
        self.parents, self.tags, self._numbers = [0], [""], {}
        self._around, self._depths = [0], [0]  # of marks
        self._holders: tuple[list[int], list[int]] = [], []  # marks around articles, and around content classes

    def path(self, parent: int, tag: str, name: str) -> int:
        number = self._numbers.setdefault((parent, tag, name), len(self.parents))
        if number == len(self.parents):
            self.parents.append(parent)
            self.tags.append(tag)
        return number

    def entered(self, top: _Open, tag: str, attributes: str) -> _Open:
        if tag in INLINE:
            return _Open(tag, top.path, top.dropped, top.content, top.mark)
        names = [a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes) if k.lower() in _MARKS] if attributes else []
        dropped = top.dropped or tag in FURNITURE and not (top.content and tag in TEXT_IN_CONTENT) or tag == "header" and not top.content
        marked, mark, content = tag in MARKED, top.mark, tag in CONTENT
        for name in (f" {x}" for x in names):
            if tag in UNASKED:
                dropped = dropped or tag == "article" and COMMENT_ARTICLE.search(name) is not None
            else:
                dropped = dropped or COMMENT_CLASS.search(name) is not None
                marked = marked or FURNITURE_CLASS.search(name) is not None
                marked = marked or not top.content and HEADER_CLASS.search(name) is not None and not OWN_HEADER_CLASS.search(name)
        if marked and not dropped:
            mark = len(self._around)
            self._around.append(top.mark)
            self._depths.append(self._depths[top.mark] + 1)
        if not dropped:
            if content:
                self._holders[0].append(mark)
            elif tag != "body" and any(CONTENT_CLASS.search(f" {x}") for x in names):
                self._holders[1].append(mark)
        path = self.path(top.path, tag, names[0] if names else "")
        return _Open(tag, path, dropped, top.content or (path if content else 0), mark)

    def furniture(self) -> list[bool]:
        """Whether each mark holds."""
        holders = self._holders[0] or self._holders[1]
        out = [False] + [True] * (len(self._around) - 1)
        least = min((self._depths[m] for m in holders), default=0)
        for mark in holders:
            while self._depths[mark] <= least and out[mark]:
                out[mark] = False
                mark = self._around[mark]
        for mark in range(1, len(out)):
            out[mark] = out[mark] or out[self._around[mark]]
        return out


def read(html: str) -> _Page:
    """The blocks of a page and their paths."""
    page = _Page()
    stack = [_Open("", 0, False, 0, 0)]
    outer = [0]  # places on the stack of elements that aren't inline
    opened: dict[str, int] = {}  # those by tag
    inline: list[dict[str, int]] = [{}]  # inline elements by tag, in each of these
    parts: list[str] = []
    linked = links = at = 0

    def closed(depth: int) -> None:
        """The elements from a place on are closed."""
        while len(stack) > depth:
            tag = stack.pop().tag
            if tag in INLINE:
                inline[-1][tag] -= 1
            else:
                opened[tag] -= 1
                outer.pop()
                inline.pop()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not stack[-1].dropped:
                heading = any(x.tag in HEADINGS for x in stack[-3:])
                top = stack[-1]
                page.blocks.append((top.path, text, min(linked, len(text)), heading, top.content, top.mark))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    end, last, quoted = len(html), html.rfind(">"), True
    while at < end:
        token = _OPENING.search(html, at)
        # Without an end further on, nothing that begins here is a tag.
        if token is None or token.start() > last and token[0] != "<!--":
            add(html[at:])
            break
        add(html[at : token.start()])
        at = token.end()
        tag = token[2]
        if tag is None:
            close = html.find("-->" if token[0] == "<!--" else ">", at)
            at = end if close < 0 else close + (3 if token[0] == "<!--" else 1)
            continue
        inside = _INSIDE.match(html, at) if quoted else None
        if inside is None:  # a quote that is never closed: from here on all tags end at the next end
            quoted = False
            attributes, at = html[at : html.find(">", at)], html.find(">", at) + 1
        else:
            attributes, at = inside[0][:-1], inside.end()
        tag = tag.lower()
        if token[1]:
            if tag in INLINE:
                links -= tag == "a" and links > 0
            elif tag == "br":
                parts.append(" ")
                continue
            else:
                flush()
            if (inline[-1] if tag in INLINE else opened).get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                closed(depth)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = html.find(">", close.end()) + 1 if close else 0
            at = at or end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        if tag in INLINE:
            links += tag == "a"
        else:
            flush()
            links = 0
            around = stack[outer[-1]].tag
            if around == "p" or tag in CLOSED_BY.get(around, ()):
                closed(outer[-1])
        if not attributes.endswith("/"):
            stack.append(page.entered(stack[-1], tag, attributes))
            if tag in INLINE:
                inline[-1][tag] = inline[-1].get(tag, 0) + 1
            else:
                opened[tag] = opened.get(tag, 0) + 1
                outer.append(len(stack) - 1)
                inline.append({})
    flush()
    return page


def _smoothed(values: list[float]) -> list[float]:
    rest = (1 - OWN_WEIGHT) / (2 * RADIUS)
    out = []
    for i, own in enumerate(values):
        near = [values[j] if 0 <= j < len(values) else own for k in range(1, RADIUS + 1) for j in (i - k, i + k)]
        out.append(OWN_WEIGHT * own + rest * sum(near))
    return out


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by line feeds."""
    page = read(html or "")
    furniture = page.furniture()
    found = [x[:5] for x in page.blocks if not furniture[x[5]]]
    sums: dict[int, list[float]] = {}
    roots: dict[int, int] = {}
    for path, text, linked, heading, root in found:
        roots[path] = root
        if not heading:
            s = sums.setdefault(path, [0, 0, 0, 0])
            s[0] += len(text)
            s[1] += len(PUNCTUATION.findall(text))
            s[2] += linked
            s[3] += 1
    if not sums:
        return "\n".join(text for _, text, *_ in found)
    body = [x[0] for x in found if not x[3]]
    text_ratio = _smoothed([sums[p][0] / sums[p][3] for p in body])
    mark_ratio = _smoothed([sums[p][1] / sums[p][3] for p in body])
    fused: dict[int, float] = {}
    for path, t, m in zip(body, text_ratio, mark_ratio, strict=True):
        own = t * (1 + m) * (1 - sums[path][2] / sums[path][0])
        fused[path] = fused.get(path, 0.0) + own / sums[path][3]
    least = MIN_SHARE * max(fused.values())
    kept = {p for p, v in fused.items() if v >= least and v > 0}
    sum_of: dict[int, float] = {}
    for p, v in fused.items():
        sum_of[roots[p]] = sum_of.get(roots[p], 0.0) + v
    chosen = {root for root, v in sum_of.items() if root and v >= least and v > 0}
    home = page.parents[max(fused, key=fused.__getitem__)]
    whole = not chosen and kept and page.tags[home] not in ("", "html", "body")
    below = [False] * len(page.parents)  # whether a path is below the best one's container
    for p in range(1, len(below)):
        below[p] = below[page.parents[p]] or page.parents[p] == home
    around = set()  # paths around those that are kept, and these
    for p in kept:
        while p not in around:
            around.add(p)
            p = page.parents[p]
    return "\n".join(
        text
        for path, text, linked, heading, root in found
        if path in kept
        or root in chosen
        or whole and below[path] and linked < len(text)
        or heading and page.parents[path] in around
    )


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with html replaced by its main text and n_chars, the text's code points."""
    keep = [c for c in pages.columns if c not in (html, text, "n_chars")]
    named = lambda names: pages.select(*[F.col(f"`{c}`") for c in names])
    rows, schema = named([html, *keep]), named(keep).schema.add(text, "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            texts = [main_text(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*keep, text, "n_chars"],
            )

    return numbered(rows).mapInArrow(run, schema)
