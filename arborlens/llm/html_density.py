"""Main text of web pages by composite text density.

A page becomes a tree of elements. For every node the characters of its text, the characters inside links,
its tags and its link tags give a density: characters per tag, adjusted by the share of links, so that menus
come out near zero. The densities of a node's children are summed; the node with the largest sum holds the
main text. On the path from it to the body the least density is the threshold: a branch beside the path
joins the main text if it reaches that threshold, which brings in headings and leaves out short notices.

Elements that never are main text (scripts, styles, menus, headers and footers of the page, sidebars, forms)
go before densities are computed, and so do those with a whole word of class or id that says so (adverts,
notices, comments, ...), unless they are an article or main element or hold more than half of the page's text
while no article or main element beside them has any: of those the density decides.
"""

from __future__ import annotations

import bisect
import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
DROPPED = frozenset("head script style noscript iframe template svg math nav header footer aside form button select option textarea input label dialog menu object embed canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset(["body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"])
#: An opening tag closes an open one of these, unless a border lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}
BORDERS = frozenset("ul ol dl table article section div main body html select".split())
#: Words of class and id that mark what is not main text.
NOISE = re.compile(r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|footer|site-header|masthead|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|comment-\w+|replies|disqus|respond|login|signup|search|pagination|pager|toolbar|copyright|legal|disclaimer)[-_]?\d*", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?|\"[^\"]*\"|'[^']*'")
_SPACE = re.compile(r"\s+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Node:
    __slots__ = ("chars", "density", "dropped", "items", "link_chars", "link_tags", "noisy", "sum", "tag", "tags", "up")

    def __init__(self, tag, up, dropped=False, noisy=False):
        self.tag, self.up, self.dropped, self.noisy, self.items = tag, up, dropped, noisy, []


class _Open:
    """The open elements from the root to the current one, with the depths of every name, so an end is found without a walk."""

    def __init__(self):
        self.path, self.depths, self.skip = [Node("html", None)], {}, 0

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)
        self.skip += node.dropped

    def cut(self, depth: int) -> None:
        """Close the element at ``depth`` and those in it."""
        while len(self.path) > depth:
            node = self.path.pop()
            self.depths[node.tag].pop()
            self.skip -= node.dropped

    def last(self, tags) -> int:
        """Depth of the innermost open element of these names, 0 for none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def end(self, tag: str) -> None:
        """An end tag. That of an inline element closes no block, that of a paragraph nothing beyond a border."""
        at = self.last((tag,))
        if at and not (tag not in BLOCK and self.last(BLOCK) > at) and not (tag == "p" and self.last(BORDERS) > at):
            self.cut(at)

    def implied(self, tag: str) -> None:
        """Close what an opening tag ends: paragraphs and items up to the next border."""
        wanted = (("p",) if tag in ENDS_P else ()) + CLOSES.get(tag, ())
        if not any(self.depths.get(t) for t in wanted):
            return
        border = self.last(t for t in _BARRIERS if t not in wanted)
        inner = [d[k] for t in wanted if (d := self.depths.get(t)) and (k := bisect.bisect_right(d, border)) < len(d)]
        if inner:
            self.cut(min(inner))


#: Elements beyond which an opening tag closes nothing.
_BARRIERS = (BLOCK | BORDERS) - {"p"}


def parse(page: str) -> Node:
    """A tree of nodes and strings; ends of elements that pages leave out are added where HTML says so. Linear in the page."""
    held = _Open()
    root = held.path[0]
    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else size]
        here = held.path[-1]
        if text and not held.skip:
            here.items.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA[") and not held.skip:
                here.items.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            held.end(tag)
            continue
        inner = m[3] or ""
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in ("html", "body"):
            continue
        held.implied(tag)
        here, skip = held.path[-1], held.skip
        drop = bool(skip) or tag in DROPPED or bool(inner) and _unseen(inner)
        if tag == "header" and not skip and held.depths.get("article"):
            drop = bool(inner) and _unseen(inner)  # an article's own header holds its heading
        node = Node(tag, here, drop, noisy=not drop and bool(inner) and tag not in ("article", "main") and _noise(inner))
        if not drop:
            here.items.append(node)
        elif tag in BLOCK and not skip:
            here.items.append(Node("hr", here))  # what stands on either side is not one block
        if tag not in VOID:
            held.push(node)
    return root


def _attributes(inner: str):
    for name, value in _ATTR.findall(inner):
        yield name.lower(), html.unescape(value.strip("\"'"))


def _unseen(inner: str) -> bool:
    """Whether attributes hide an element or give it a role beside the main text."""
    for name, value in _attributes(inner):
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu"):
            return True
    return False


def _noise(inner: str) -> bool:
    return any(NOISE.fullmatch(word) for name, value in _attributes(inner) if name in ("class", "id") for word in value.split())


def _prune(root: Node) -> None:
    """Take out the elements that class or id marks, but for those with more than half of the page's text.

    Beside an article or main element with text, such an element goes whatever it holds.
    """
    order, stack, chars, framed, inside = [], [root], {}, {}, {id(root): False}
    while stack:
        n = stack.pop()
        order.append(n)
        for x in n.items:
            if isinstance(x, Node):
                inside[id(x)] = inside[id(n)] or n.tag in ("article", "main")
                stack.append(x)
    if not any(n.noisy for n in order):
        return
    for n in reversed(order):
        chars[id(n)] = sum(chars[id(x)] if isinstance(x, Node) else len(_SPACE.sub(" ", x).strip()) for x in n.items)
        framed[id(n)] = chars[id(n)] if n.tag in ("article", "main") else sum(framed[id(x)] for x in n.items if isinstance(x, Node))
    half = chars[id(root)] / 2
    for n in order:
        if any(isinstance(x, Node) and x.noisy for x in n.items):
            kept = []
            for x in n.items:
                if not (isinstance(x, Node) and x.noisy) or chars[id(x)] > half and (inside[id(x)] or framed[id(x)] == framed[id(root)]):
                    kept.append(x)
                elif x.tag in BLOCK:
                    kept.append(Node("hr", n))  # what stands on either side is not one block
            n.items = kept


def _measure(root: Node) -> None:
    """Characters, tags and densities of all nodes, bottom up, without recursion (pages may nest deeply)."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [x for x in n.items if isinstance(x, Node)]
    for n in reversed(order):
        chars = link_chars = tags = link_tags = 0
        for x in n.items:
            if isinstance(x, Node):
                chars += x.chars
                link_chars += x.link_chars
                tags += x.tags + 1
                link_tags += x.link_tags + (x.tag == "a")
            else:
                chars += len(_SPACE.sub(" ", x).strip())
        if n.tag == "a":
            link_chars = chars
        n.chars, n.link_chars, n.tags, n.link_tags = chars, link_chars, tags, link_tags
    body_chars, body_links = max(root.chars, 1), root.link_chars
    for n in order:
        c, lc, t, lt = n.chars, n.link_chars, max(n.tags, 1), n.link_tags
        if not c:
            n.density = 0.0
            continue
        base = math.log(c / max(c - lc, 1) * lc + body_links / body_chars * c + math.e)
        n.density = c / t * max(0.0, math.log(max(c / max(lc, 1) * t / max(lt, 1), 1e-9)) / math.log(max(base, math.e)))
    for n in order:
        n.sum = sum(x.density for x in n.items if isinstance(x, Node) and x.tag in BLOCK)  # marks inside a line aren't parts of a page


def _best(root: Node) -> Node:
    """The node of the largest density sum; of equal ones the first in page order, the outer before the inner."""
    best, best_score, stack = root, -1.0, [root]
    while stack:
        n = stack.pop()
        score = n.sum
        if any(isinstance(x, Node) and x.tag in BLOCK for x in n.items):
            score += sum(len(x.strip()) for x in n.items if isinstance(x, str))  # text between blocks is a block without tags
        if score > best_score:
            best, best_score = n, score
        stack += [x for x in reversed(n.items) if isinstance(x, Node)]
    return best


def _selected(root: Node) -> tuple[set[int], set[int]]:
    """Ids of the nodes that are left out, and of those whose own text is, given the best node's path to the body."""
    best = _best(root)
    path, n = [best], best
    while n.up is not None:
        n = n.up
        path.append(n)
    # The main element of the path bounds what can join: nothing outside an article joins it.
    frame = next((k for k in range(len(path) - 1, -1, -1) if path[k].tag == "article"), None)
    if frame is None:
        frame = next((k for k in range(len(path) - 1, -1, -1) if path[k].tag == "main"), len(path) - 1)
    threshold = min((x.density for x in path[: frame + 1] if x.chars), default=0.0)
    left_out = set()
    mute = {id(x) for x in path[frame + 1 :]}
    on_path = {id(x) for x in path}
    for k, x in enumerate(path[1:], 1):
        for y in x.items:
            if isinstance(y, Node) and id(y) not in on_path and y.tag in BLOCK:
                heading = k <= frame and re.fullmatch("h[1-6]", y.tag)
                if k > frame or not heading and y.density < threshold:
                    left_out.add(id(y))
            elif isinstance(y, Node) and id(y) not in on_path and k > frame:
                left_out.add(id(y))
    return left_out, mute


def extract(page: str | None) -> str:
    """The main text of a page: blocks joined by two newlines, white space inside a block as one space."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    _measure(root)
    left_out, mute = _selected(root)
    blocks, now = [], []

    def end():
        text = _SPACE.sub(" ", "".join(now)).strip()
        if text:
            blocks.append(text)
        now.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif id(x) in left_out:
            end()
        elif x.tag == "br":
            now.append(" ")
        else:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack += [y for y in reversed(x.items) if id(x) not in mute or isinstance(y, Node)]
    end()
    return "\n\n".join(blocks)


def extract_pages(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``df``; whole pages, in Arrow batches, without a shuffle.

    Null and empty pages give the empty text, as pages without text do. Broken markup is read as far as it goes:
    an unclosed comment ends the page. Repeated rows give equal texts. Other columns are not read.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [extract(x.as_py()) for x in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.large_string()).cast(pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = dict(src.dtypes)["id"]
    return src.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
