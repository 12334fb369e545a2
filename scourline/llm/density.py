"""Main-text extraction by composite text density.

Every node of the page gets its characters per tag, adjusted for the share of them that stands in links (of the node and
of the whole body). A node's density sum is the sum of its children's densities, to which its own text adds its share of
the node's density, or as a child of each line where ``br`` ends lines; the subtree with the largest sum, or the one around it where that is a
paragraph, is the core of the article. The least density on
the way from there to the body is the threshold: on every level of that way, neighbours that reach it belong to the text,
and headings do. In an ``article`` or ``main`` around the core neighbours need not reach it, unless they are lists of links
in front of the core. Within the core nothing is dropped but what is something else.

Something else are menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles: by their tag;
by a class, id or role all of whose words say so, and forms, but only if the text of the page is not in them; by a word
that may mean either (discussion, related, share) only below the threshold.

Blocks are joined by one newline; white space within a block is one space; character references are decoded; ``br`` ends
a block. A null or empty page has the empty text. Unclosed elements, stray end tags and a page cut off within a tag are
read as far as they go, in time that grows with the page. Repeated rows keep a row each; other columns are ignored.
"""

from __future__ import annotations

import gc
import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No branch passes a second tag's beginning, but for comments and quoted values, and these are read once.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^<>]*>?|<([a-zA-Z][^\s/><]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+[^<>]*+)>?""",
    re.S,
)
HINT = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
words = str.split

VOID = frozenset(words("area base br col embed hr img input link meta param source track wbr"))
RAW = frozenset(words("script style textarea title noscript iframe xmp noembed noframes"))
BLOCK = frozenset(words(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul"
))
#: Elements that hold no article text.
OTHER = frozenset(words("head script style title noscript template iframe object embed svg canvas audio video nav footer aside button select option textarea input label menu dialog map xmp noembed noframes"))
#: Words of a class, id or role that say the element is something else.
SAYS = frozenset(words(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar complementary footer contentinfo masthead cookie cookies consent gdpr notice notices alert popup modal overlay dialog comment comments "
    "commentlist respond reply replies disqus newsletter subscribe subscription signup login pagination pager toolbar hidden"
))
#: Words that may say so or name a part of the article.
MAY_SAY = frozenset(words("discussion related recommended recommendations share sharing social search tags skip widget"))
#: Words that may stand beside these in one token; any other word (has-sidebar, no-comments, share-price) makes it say nothing.
BESIDE = frozenset(words(
    "box container wrapper wrap area block section list item items link links bar slot unit inner outer top bottom left right main site page post article form "
    "panel group column col row header head title body content text icon icons button buttons count new latest primary secondary global local mobile desktop "
    "sticky fixed full wide large small js user reader readers thread feed module zone region"
))
#: A start tag closes these open elements, up to the nearest of the fences.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES |= {t: ({"p"}, {"td", "th", "table", "button", "caption", "object"}) for t in BLOCK - {"br", "li", "dt", "dd", "tr", "td", "th", "option", "optgroup", "body", "html", "caption", "tbody", "thead", "tfoot", "button", "select"}}
HEADINGS = frozenset(words("h1 h2 h3 h4 h5 h6"))
PARAGRAPH = HEADINGS | frozenset(words("p li dt dd td th tr tbody caption pre blockquote address"))


class Node:
    __slots__ = ("tag", "parent", "parts", "other", "named", "unsure", "semantic", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, other: bool) -> None:
        self.tag, self.parent, self.other, self.named, self.unsure = tag, parent, other, False, False
        self.semantic = tag in ("article", "main") or parent is not None and parent.semantic
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _names(value: str) -> tuple[bool, bool]:
    """Whether a class, id or role says that the element is something else, and whether it may say so."""
    sure = unsure = False
    for token in value.split():
        own = {w.lower() for w in WORD.findall(token)}
        rest = {w for w in own if len(w) > 1 and not w.isdigit()} - SAYS - MAY_SAY - BESIDE
        if not rest:
            sure = sure or not SAYS.isdisjoint(own)
            unsure = unsure or not MAY_SAY.isdisjoint(own)
    return sure, unsure


def _says_other(tag: str, attributes: str, parent: Node) -> bool:
    """Whether the element is something else for certain: by its tag, or hidden."""
    if tag in OTHER or tag == "header" and not parent.semantic:  # an article's own header holds its title
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in HINT.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named_other(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether the element's names say that it is something else, and whether they may."""
    sure = unsure = False
    if attributes and tag not in ("html", "body", "main"):
        for m in HINT.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name not in ("class", "id", "role"):
                continue
            a, b = _names(value)
            sure, unsure = sure or a, unsure or b
            if name == "role" and value.lower() == "banner" or name != "role" and re.search(r"(?:^|\s)(?:site|page|top|global)[-_]?header|(?:^|\s)header(?:\s|$)", value, re.I):
                sure = True
    return sure or tag == "form", unsure


def parse(page: str) -> list[Node]:
    """The nodes in page order; the first is the root."""
    root = Node("#root", None, False)
    nodes, here, at = [root], root, 0
    open_: Counter[str] = Counter()  # tags from the root to ``here``

    def leave(upto: Node) -> Node:
        """Closes ``upto`` and all within."""
        nonlocal here
        while here is not upto:
            open_[here.tag] -= 1
            here = here.parent
        open_[upto.tag] -= 1
        here = upto.parent
        return here

    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            here.parts.append(text)
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if open_[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                leave(up)
            elif tag == "br":
                here.parts.append(Node("br", here, False))
            continue
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3].strip()
        if tag in ("html", "body") and any(n.tag == tag for n in nodes[:4]):
            continue
        closes = CLOSES.get(tag)
        if closes and any(open_[t] for t in closes[0]):
            up = here
            while up.parent is not None and up.tag not in closes[1] and up.tag not in closes[0]:
                if up.tag in BLOCK and closes[0] == {"p"}:
                    break
                up = up.parent
            if up.tag in closes[0]:
                leave(up)
        if tag in HEADINGS and here.tag in HEADINGS:
            leave(here)
        if tag == "body":
            while here.tag not in ("#root", "html"):
                leave(here)
        node = Node(tag, here, here.other or _says_other(tag, attributes, here))
        if not node.other:
            node.named, node.unsure = _named_other(tag, attributes)
        here.parts.append(node)
        nodes.append(node)
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}\b[^<>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            here = node
            open_[tag] += 1
    return nodes


def _settle(nodes: list[Node]) -> None:
    """Named elements and all in them become other, but for those that hold the text: next to nothing of the page is
    outside of what is named, or an ``article`` or ``main`` inside is larger than all that."""
    if not any(n.named for n in nodes):
        return
    own, inner, largest = {}, {}, {}
    for n in reversed(nodes):  # characters out of links, then of the largest article inside
        if n.other or n.tag == "a":
            continue
        own[n] = own.get(n, 0) + sum(len("".join(x.split())) for x in n.parts if isinstance(x, str))
        inner[n] = own[n] + inner.get(n, 0)
        best = max(largest.get(n, 0), inner[n] if n.tag in ("article", "main") else 0)
        if n.parent is not None:
            inner[n.parent] = inner.get(n.parent, 0) + inner[n]
            largest[n.parent] = max(largest.get(n.parent, 0), best)
    inside: dict[Node, bool] = {}
    outside = 0
    for n in nodes:
        inside[n] = n.named or n.parent is not None and inside[n.parent]
        if not inside[n]:
            outside += own.get(n, 0)
    for n in nodes:  # parents before their children
        if n.parent is not None and n.parent.other:
            n.other = True
        elif n.named:
            if n.tag not in ("article", "main") and (20 * outside < inner.get(n, 0) or largest.get(n, 0) > outside):
                stack = [n]
                while stack:  # what it holds by itself now is outside
                    at = stack.pop()
                    outside += own.get(at, 0)
                    stack += [x for x in at.parts if isinstance(x, Node) and not x.named]
            else:
                n.other = True


def _composite(c: int, t: int, lc: int, lt: int, share: float, links: bool) -> float:
    """Characters per tag, less the more of them stand in links; ``share`` is that of the whole body."""
    density = c / max(1, t)
    if not links:
        return density
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    density *= math.log(max(1.0, c / max(1, lc) * (max(1, t) / max(1, lt))) + 1e-9) / max(math.log(base), 0.05)
    return max(density, 0.0)


def weigh(nodes: list[Node]) -> Node:
    """Fills in all densities and sums; gives the body, or the root of a page without one."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    for n in reversed(nodes):  # children before their parents
        if n.other:
            continue
        n.chars += sum(len("".join(x.split())) for x in n.parts if isinstance(x, str))
        if n.tag == "a":
            n.link_chars = n.chars
        up = n.parent
        if up is not None:
            up.chars += n.chars
            up.tags += n.tags + 1
            up.link_chars += n.link_chars
            up.link_tags += n.link_tags + (n.tag == "a")
    share, links = body.link_chars / max(1, body.chars), body.link_chars > 0
    for n in nodes:
        if n.other or not n.chars:
            continue
        n.density = _composite(n.chars, n.tags, n.link_chars, n.link_tags, share, links)
        runs = [c for x in n.parts if isinstance(x, str) and (c := len("".join(x.split())))]
        if n.tag not in ("p", "a") and any(isinstance(x, Node) and x.tag == "br" for x in n.parts):
            n.total += sum(_composite(c, 1, 0, 0, share, links) for c in runs)  # lines are paragraphs
        else:
            n.total += n.density * sum(runs) / n.chars
        if n.parent is not None:
            n.parent.total += n.density
    return body


def _listed(n: Node) -> bool:
    """A block of links: a menu without a name."""
    return n.tag in BLOCK and n.tag not in HEADINGS and n.tag != "p" and n.link_tags > 1 and n.link_chars > 0.7 * n.chars


def article(nodes: list[Node]) -> list[Node | str]:
    """The subtrees and runs of text that make up the main text, in page order."""
    _settle(nodes)
    body = weigh(nodes)
    inside = [n for n in nodes[nodes.index(body) :] if not n.other and n.chars]
    if not inside:
        return []
    best = max(inside, key=lambda n: n.total)
    while (best.tag in PARAGRAPH or best.tag not in BLOCK) and best is not body and best.parent is not body and best.parent is not None:
        best = best.parent  # one long paragraph is no article
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold, on_path = min(n.density for n in path), set(path)
    for n in inside:
        if n.unsure and n.density < threshold and n not in on_path:
            n.other = True
    found: deque[Node | str] = deque([best])
    for at, up in zip(path, path[1:]):  # level by level, what stands before and behind on it
        sides: tuple[list, list] = ([], [])
        behind = False
        for x in up.parts:
            if x is at:
                behind = True
            elif isinstance(x, str):
                if up.semantic and x.strip():
                    sides[behind].append(x)
            elif not x.other and x.chars:
                if up.semantic and (behind or not _listed(x)) or not _listed(x) and (x.density >= threshold or x.tag in HEADINGS):
                    sides[behind].append(x)
        found.extendleft(reversed(sides[0]))
        found.extend(sides[1])
    return list(found)


def blocks(top: list[Node | str]) -> list[str]:
    """The text of each block under ``top``, in page order."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                out.append(text)
            line.clear()

    for n in top:
        if isinstance(n, str):
            line.append(n)
            continue
        stack: list[tuple[Node, int]] = [(n, 0)]
        while stack:
            node, i = stack.pop()
            if i == 0 and node.tag in BLOCK:
                close()
            while i < len(node.parts):
                part = node.parts[i]
                i += 1
                if isinstance(part, str):
                    line.append(part)
                elif not part.other:
                    stack += [(node, i), (part, 0)]
                    break
                elif part.tag in BLOCK:
                    close()
            else:
                if node.tag in BLOCK:
                    close()
    close()
    return out


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    nodes = parse(page)
    text = "\n".join(blocks(article(nodes)))
    for n in nodes:  # no cycles are left to collect
        n.parent = None
        n.parts.clear()
    return text


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``id_col``, ``url_col``, text, n_chars) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # trees of large pages would be walked again and again
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    few = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return few.mapInArrow(run, "id bigint, url string, text string, n_chars bigint").toDF(id_col, url_col, "text", "n_chars")
