"""Main text of web pages by composite text density."""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelink.llm.common import lean, with_fields

# Elements of the HTML standard, by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select xmp noframes noembed".split())
#: Raw elements that reach to the page's end where their end tag is missing; of the others such a start tag counts for nothing.
OPEN_RAW = frozenset("script style textarea title iframe xmp noframes noembed".split())
#: Elements that are no part of an article; one that holds the article after all (an end tag is missing) stays.
APART = frozenset("nav footer aside button dialog menu canvas audio video map datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
#: An opening tag of the key ends an open element of these, looked for up to the nearest element of the last group.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
# Words in names (class, id, role), as hints only: what surrounds an article; words that say so unless the name also has a word of
# content; reader comments; words of content; and words that make a name speak of a layout instead of the element itself.
SURROUND = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail footer masthead topbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended recommendations pagination pager toolbar skip complementary contentinfo".split()
)
#: Of these, words that an article's own parts are named by, too.
WEAK = frozenset("recommend recommended recommendations related share sharing".split())
VAGUE = frozenset("alert banner copyright disclaimer foot legal notice notices promo promos promotion promotions search widget widgets".split())
HEADER = frozenset({"header"})
COMMENTS = frozenset("comment comments commentlist commentbox disqus replies reply respond".split())
CONTENT = frozenset("article body content entry main post section story text title".split())
LAYOUT = frozenset("has is no not with without".split())
#: A comment, a declaration, or the start of a tag.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)", re.S)
STOP = re.compile("[>\"']")
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")

#: Elements that running text is made of: beside the main subtree they are content, whatever their density, unless links fill them.
FLOW = frozenset("article blockquote details dl figure h1 h2 h3 h4 h5 h6 hgroup main ol p pre section table ul".split())
#: How an element is hinted to stand apart: by its tag, by a plain name for what surrounds or for comments, by a longer name or an attribute, or, inside
#: an article, by a name that its own parts may have as well.
BY_TAG, BY_PLAIN_NAME, BY_NAME, BY_WEAK_NAME = 1, 2, 3, 4


class Node:
    __slots__ = ("chars", "content", "density", "depth", "flow", "hint", "inside", "link_chars", "link_tags", "parent", "parts", "summed", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, hint: int = 0):
        self.tag, self.parent, self.parts, self.hint = tag, parent, [], hint
        self.depth = parent.depth + 1 if parent is not None else 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.summed = 0.0
        self.content = self.inside = self.flow = False

    @property
    def unlinked(self) -> bool:
        return 3 * self.link_chars < self.chars


def _name_hint(value: str, in_article: bool, tag: str) -> int:
    """What the names in a class, id or role attribute say about their element."""
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        every = {*words, *(a + b for a, b in zip(words, words[1:], strict=False))}
        if every & LAYOUT:
            continue
        plain = len(words) == 1
        if every & COMMENTS or (plain and every & SURROUND and not (in_article and tag == "section")):
            return BY_PLAIN_NAME
        if every & (SURROUND if plain and tag != "section" else SURROUND - WEAK) and not (plain and tag == "section"):
            return BY_NAME
        if every & SURROUND or (not every & CONTENT and every & (VAGUE if in_article else VAGUE | HEADER)):
            return BY_WEAK_NAME if in_article else BY_NAME
    return 0


def _hint(tag: str, rest: str, in_article: bool) -> int:
    """Whether an element seems to stand apart from the article, by its tag or by its attributes."""
    if tag in APART:
        return BY_TAG
    if tag == "form" or (tag == "header" and not in_article):
        return BY_NAME
    if "=" not in rest and "hidden" not in rest.lower() or tag in ("html", "body", "main"):
        return 0
    found = 0
    for name, a, b, c in NAMED.findall(rest):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            found = found or BY_NAME
        elif name in ("class", "id", "role"):
            found = found or _name_hint(value, in_article, tag)
    return found if tag != "article" or found == BY_PLAIN_NAME else 0


class Tags:
    """Reads a page's tags from left to right, each character a bounded number of times whatever the quotes in it."""

    def __init__(self, page: str):
        self.page, self.failed, self.absent = page, set(), set()
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def end(self, at: int) -> int:
        """Where the tag ends whose name stops at ``at``: the first > outside quotes, else (torn quotes) the first >; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        seen, pos = [], at
        while pos <= self.last[">"]:
            i = STOP.search(self.page, pos).start()
            if self.page[i] == ">":
                return i
            seen.append(i)
            if i in self.failed or i >= self.last[self.page[i]]:
                break
            pos = self.page.find(self.page[i], i + 1) + 1
        self.failed.update(seen)  # a later tag that comes to one of these quotes finds no end either
        return self.page.find(">", at)

    def raw_end(self, at: int, tag: str) -> int:
        """Where the text after a raw element goes on."""
        m = None if tag in self.absent else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if m is None:
            self.absent.add(tag)
            return len(self.page) if tag in OPEN_RAW else at
        return m.end()


def parse(page: str) -> Node:
    """The page's elements as a tree, without raw elements. Ends that are left out or wrong are mended. Takes linear time.

    The open elements are kept by tag as well, so that whatever a tag ends is found without climbing the tree.
    """
    root = Node("html", None)
    tags, now, at, end = Tags(page), root, 0, len(page)
    by_tag: dict[str, list[Node]] = {"html": [root]}
    blocks = [root]

    def close(last: Node) -> Node:
        node = now
        while True:
            by_tag[node.tag].pop()
            if blocks[-1] is node:
                blocks.pop()
            if node is last:
                return node.parent
            node = node.parent

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            now.parts.append(page[at:stop])
        if m is None:
            break
        at = m.end()
        tag, ends = m["tag"], m["end"]
        if tag is None:
            continue
        tag = tag.lower()
        to = tags.end(at)
        if to < 0:  # no tag ends any more: the rest is text
            now.parts.append(page[stop:])
            break
        rest, at = page[at:to], to + 1
        if ends:
            found = by_tag.get(tag)
            if found and found[-1] is not root and (tag in BLOCKS or found[-1].depth > blocks[-1].depth):
                now = close(found[-1])
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and blocks[-1].tag == "p":
            now = close(blocks[-1])
        if tag in IMPLIED_END:
            ended, within = IMPLIED_END[tag]
            floor = max((by_tag[t][-1].depth for t in within if by_tag.get(t)), default=0)
            inner = [x[bisect.bisect_right(x, floor, key=lambda n: n.depth) :] for x in (by_tag.get(t, []) for t in ended)]
            first = min((x[0] for x in inner if x), key=lambda n: n.depth, default=None)
            if first is not None:
                now = close(first)
        if tag in VOID:
            now.parts.append(None if tag in ("br", "hr") else "")
            now.tags += 1
        elif tag in RAW:
            now.parts.append(None)
            at = tags.raw_end(at, tag) if not rest.endswith("/") or tag in OPEN_RAW else at
        elif tag != "head":
            child = Node(tag, now, _hint(tag, rest, bool(by_tag.get("article") or by_tag.get("main"))))
            now.parts.append(child)
            now = child
            by_tag.setdefault(tag, []).append(child)
            if tag in BLOCKS:
                blocks.append(child)
    return root


def drop_surroundings(root: Node) -> list[Node]:
    """Takes out what stands apart, unless it holds what the page is about; returns the nodes that are left, parents before children.

    Hints only say what may go. An element hinted by a name stays if it holds more than half of the unlinked characters
    that are left, one hinted by its tag if it also holds an article, one of a plain name (ad, comments) only if it holds
    the one article or nearly all characters. A part of an article whose name is hardly a hint stays if it has no form, few links and at least half as many
    characters for each tag as the article.
    """
    nodes = _in_order(root)
    for kinds in ((BY_PLAIN_NAME,), (BY_TAG, BY_NAME, BY_WEAK_NAME)):
        if not any(node.hint in kinds for node in nodes):
            continue
        within: dict[Node, Node] = {}
        free, linked, tags, forms, articles = ({} for _ in range(5))
        for node in nodes:
            up = node.parent
            node.inside = node.tag == "a" or (up is not None and up.inside)
            within[node] = node if node.tag in ("article", "main") or up is None else within[up]
            own = sum(len(SPACE.sub(" ", p).strip()) for p in node.parts if isinstance(p, str))
            free[node], linked[node] = (0, own) if node.inside else (own, 0)
            tags[node], forms[node], articles[node] = 1, int(node.tag in ("form", "button")), int(node.tag in ("article", "main") and not node.hint)
        for node in reversed(nodes):
            if node.parent is not None:
                for sums in (free, linked, tags, forms, articles):
                    sums[node.parent] += sums[node]
        total, gone = free[root], set()
        for node in nodes:
            if node.parent in gone:
                gone.add(node)
            elif node.hint in kinds:
                most, article, whole = 2 * free[node] > total, articles[node] > 0, within[node]
                if node.hint == BY_WEAK_NAME:
                    stays = most or (not forms[node] and 3 * linked[node] < free[node] and 2 * free[node] * tags[whole] >= free[whole] * tags[node])
                else:
                    stays = most and {BY_NAME: True, BY_TAG: article, BY_PLAIN_NAME: (article and articles[node] == articles[root]) or 50 * free[node] > 49 * total}[node.hint]
                if not stays:
                    gone.add(node)
        if gone:
            nodes = [node for node in nodes if node not in gone]
            for node in nodes:
                node.parts = [None if isinstance(p, Node) and p in gone else p for p in node.parts]
    return nodes


def _in_order(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    return out


def densities(nodes: list[Node]) -> None:
    """Sets every node's composite text density and the sum of its children's; parents come before children.

    With C characters, T tags, LC and LT those of links, and the body's ratio of link to all characters:
    C/T * log(C/LC * T/LT) to the base ln(C/notLC * LC + ratio * C + e), zero counts taken as one.
    """
    root = nodes[0]
    for node in nodes:
        node.inside = node.tag == "a" or (node.parent is not None and node.parent.inside)
        own = sum(len(SPACE.sub(" ", p).strip()) for p in node.parts if isinstance(p, str))
        node.chars += own
        node.link_chars += own * node.inside
    for node in reversed(nodes):
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
            up.flow |= node.flow or (node.tag in FLOW and node.chars > 0)
    ratio = root.link_chars / max(root.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + math.e)
            node.density = c / t * max(0.0, math.log(max(c / lc * t / lt, 1.0)) / base) if base > 1 + 1e-12 else c / t * max(0.0, math.log(max(c / lc * t / lt, 1.0)))
    for node in nodes:
        if node.parent is not None:
            node.parent.summed += node.density


def mark_content(nodes: list[Node]) -> None:
    """Marks the subtree of greatest density sum, and what else on its path to the body is content.

    The threshold is the least number of characters for each tag on that path. Of what hangs beside the path, what running text is made of counts unless
    links fill it; any other element, and text of no element, counts if links don't fill it and it has half the threshold. Straight in the
    body an element has to hold running text as well: a lone line there is not an article's.
    """
    root = nodes[0]
    best = max(nodes, key=lambda n: n.summed)
    if best.summed <= 0:
        best.content = best.chars > 0
        return
    best.content = True
    if best is root:  # a page without a main subtree: all but lists of links
        for part in root.parts:
            if isinstance(part, Node) and part.tag in BLOCKS and 2 * part.link_chars > part.chars:
                part.parts = []
        return
    least, up = math.inf, best
    while up is not None:
        least = min(least, up.chars / max(up.tags, 1))
        up = up.parent
    up = best
    while up.parent is not None:
        above = up.parent
        if above.tag in ("article", "main"):
            above.content = True
        if len(above.parts) == 1 or above.hint == BY_TAG:  # nothing beside; or a frame that is left open by mistake, as of a menu
            up = above
            continue
        parts: list[Node | str | None] = []
        run = Node("span", above)

        def text_ends(parts: list = parts, above: Node = above) -> None:
            nonlocal run
            if not run.parts:
                return
            inner = [p for p in run.parts if isinstance(p, Node)]
            run.chars = sum(len(SPACE.sub(" ", p).strip()) for p in run.parts if isinstance(p, str)) + sum(p.chars for p in inner)
            run.link_chars = sum(p.link_chars for p in inner)
            run.content = run.unlinked and (above is not root or 2 * run.chars >= least)
            parts.append(run)
            run = Node("span", above)

        for part in above.parts:
            if not isinstance(part, Node) or (part is not up and part.tag not in BLOCKS):
                run.parts.append(part)
                continue
            text_ends()
            parts.append(part)
            if part is not up and part.unlinked:
                part.content = part.tag in FLOW or (2 * part.chars >= least * max(part.tags, 1) and (above is not root or part.flow))
        text_ends()
        above.parts = parts
        up = above


def text_of(root: Node) -> str:
    """The marked subtrees' text: a line for each block, white space in it made one blank."""
    lines: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if not piece:
            return
        line = SPACE.sub(" ", html.unescape("".join(piece))).strip()
        piece.clear()
        if line:
            lines.append(line)

    stack: list[tuple[object, bool]] = [(root, False)]
    while stack:
        part, on = stack.pop()
        if isinstance(part, str):
            if on:
                piece.append(part)
        elif part is None:
            piece.append(" ")
        elif part == ("end",):
            flush()
        else:
            on = on or part.content
            block = part.tag in BLOCKS
            if block:
                flush()
                stack.append((("end",), on))
            stack.extend((p, on) for p in reversed(part.parts))
    flush()
    return "\n".join(lines)


def main_text(page: str | None) -> str:
    """The article of a page; empty for a null page or one without text."""
    if not page:
        return ""
    root = parse(page)
    nodes = drop_surroundings(root)
    densities(nodes)
    mark_content(nodes)
    return text_of(root)


@lean
def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = [main_text(page) for page in batch.column(names.index("_html")).to_pylist()]
        kept = [n for n in names if n != "_html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), pa.array(texts, pa.string())], [*kept, "text"])


def extract_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` without its html column and with ``text``, the main text of each page.

    Any page gives a text: null, empty and textless pages an empty one; broken markup is read as far as it goes, in linear
    time. Names of classes only hint at what surrounds an article; how the text lies on the page decides. Pages
    that repeat give the same text each. Columns already named text or _html are replaced or left out. Rows stay where they are: there is no shuffle.
    """
    rest = [c for c in pages.columns if c not in (source, "text", "_html")]
    plain = pages.select(*(F.col(f"`{c}`") for c in rest), F.col(source).alias("_html"))
    return plain.mapInArrow(_extracted, with_fields(plain, "text string", ("_html",)))


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("bigint"))
