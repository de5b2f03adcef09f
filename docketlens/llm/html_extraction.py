"""Main text of web pages by composite text density.

For a node with C characters, T tags, L characters in links and K link tags below it, the composite density is
C / T scaled by a logarithm that falls as links take more of the characters. The densities of a node's children add up to its density
sum; the node with the largest sum roots the main content. The smallest density on the path from that node to the
body is the page's threshold: a subtree outside the root counts as content too where it reaches the threshold and
is no boilerplate. An article or main element is favoured in both by a factor, and a root inside an article is the
whole article. Parts that are boilerplate by element or by class name are cut off before densities are taken; where a
class name of an article or of other content would cut off nearly all of the page's text, the densities decide alone.

A page is read in time proportional to its length, also where tags, comments or quotes are left open: as in a browser, an
open one takes the rest of the page with it, so that nothing is scanned twice.
"""

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docketlens.llm.common import ship

#: Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg canvas head title nav footer aside button select textarea dialog menu audio video".split())
#: What a head may hold; anything else in it starts the body, as </head> and <body> may be left out.
IN_HEAD = frozenset("title base link meta script style noscript template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption legend summary figcaption li dd dt".split())
SELF_NESTED = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ROOTS = frozenset(("article", "main"))
#: How much the density and the density sum of an article or main element count.
FAVOUR = 1.5
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side-bar footer header masthead topbar comment comments commentlist discussion disqus reply replies respond cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup popup modal overlay share sharing social related recommended pagination pager skip-link toolbar widget copyright legal disclaimer".split()
)
#: Names that tell boilerplate as the first or the last of a name's hyphenated parts.
STARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion promotions comment comments cookie cookies "
    "sidebar sidebars footer footers nav navbar menu notice notices newsletter newsletters social share breadcrumb breadcrumbs related".split()
)
ENDS = frozenset("ad ads nav menu sidebar footer comments comment banner notice promo widget".split())
#: Names of what readers write, which stays cut however long it is.
READERS = frozenset("comment comments commentlist discussion disqus reply replies respond".split())
#: Names of content: an article or main element, or a part with such a name beside one of boilerplate, stays if what is
#: left on the page without it is less than LEAST_REST of it.
CONTENT = frozenset("article post story entry content text".split())
LEAST_REST = 0.1

#: Elements whose content is no markup.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
SELF_CLOSED = frozenset("svg path script style title textarea iframe".split())
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*+("[^"]*"|'[^']*'|(?!["'])[^\s>]*))?""")
OPEN_VALUE = re.compile(r"""\s*=\s*["']""")
SPACE = re.compile(r"[\s/]*")
#: Numeric character references longer than any code point's, beside zeros in front.
LONG_REFERENCE = re.compile(r"&#(?:[xX][0-9A-Fa-f]{9,}|[0-9]{9,});?")
ZEROS = re.compile(r"&#([xX]?)0{3,}")


def unescaped(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:
        text = LONG_REFERENCE.sub("\ufffd", ZEROS.sub(r"&#\g<1>0", text))
    return entities.unescape(text)


def tokens(page: str) -> Iterator[tuple[str, str, list[tuple[str, str | None]], bool]]:
    """(kind, name or text, attributes, self-closed) for the page's texts, start tags and end tags, in one pass."""
    at, text_from, size = 0, 0, len(page)
    endless: set[str] = set()
    while (lt := page.find("<", at)) >= 0:
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        named = NAME.match(page, lt + 2 if closing else lt + 1) if after else None
        if not named and after not in ("!", "?", "/"):
            at = lt + 1
            continue
        if text_from < lt:
            yield "text", page[text_from:lt], [], False
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = text_from = end + 3 if end >= 0 else size
        elif not named:
            end = page.find(">", lt + 2)
            at = text_from = end + 1 if end >= 0 else size
        else:
            attrs, at = [], named.end()
            while (at := SPACE.match(page, at).end()) < size and page[at] != ">":
                found = ATTRIBUTE.match(page, at)
                if found[2] is None and OPEN_VALUE.match(page, found.end()):
                    at = size
                    break
                value = found[2]
                attrs.append((found[1].lower(), value and unescaped(value[1:-1] if value[0] in "'\"" else value)))
                at = found.end()
            if at >= size:
                return
            self_closed, at = page[at - 1] == "/", at + 1
            name, text_from = named[0].lower(), at
            yield ("end" if closing else "start"), name, attrs, self_closed
            if name in RAW and not closing and not self_closed and name not in endless:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
                if end:
                    text_from = at = end.start()
                elif name in ("script", "style"):
                    return
                else:
                    endless.add(name)
    if text_from < size:
        yield "text", page[text_from:], [], False


class Node:
    __slots__ = ("depth", "named", "tag", "cut", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", cut: bool, named: bool = False):
        self.tag, self.parent, self.cut, self.named, self.parts = tag, parent, cut, named, []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def is_boilerplate(tag: str, attrs: list[tuple[str, str | None]], in_root: bool) -> tuple[bool, bool]:
    """Whether an element is cut off, and whether its name tells boilerplate and content at once."""
    if tag in DROPPED or tag == "header" and not in_root:
        return True, False
    named, content = False, tag in ROOTS
    for name, value in attrs:
        if name in ("hidden",) or name == "aria-hidden" and value == "true":
            return True, False
        if name == "role" and value and value.lower() in ROLES:
            return True, False
        if name in ("class", "id") and value and tag not in ("body", "html"):
            for word in value.lower().replace("_", "-").split():
                if word == "header" and in_root:
                    continue
                parts = word.strip("-").split("-")
                if READERS.intersection((word, parts[0], parts[-1])) and (word in NAMES or parts[0] in STARTS or parts[-1] in ENDS):
                    return True, False
                named = named or word in NAMES or parts[0] in STARTS or parts[-1] in ENDS
                content = content or not CONTENT.isdisjoint(parts)
        if name == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
            return True, False
    return named and not content, named and content


class Tree:
    """A lenient tree: end tags close what they name, block starts close an open paragraph."""

    def __init__(self):
        self.top = self.at = Node("html", None, False)
        self.open: dict[str, list[Node]] = {}

    def feed(self, page: str) -> None:
        for kind, value, attrs, self_closed in tokens(page):
            if kind == "text":
                self.handle_data(value)
            elif kind == "end":
                self.handle_endtag(value)
            else:
                self.handle_starttag(value, attrs)
                if self_closed and value in SELF_CLOSED:
                    self.handle_endtag(value)

    def close_to(self, node: Node) -> None:
        while self.at is not node.parent and self.at.parent is not None:
            self.open[self.at.tag].pop()
            self.at = self.at.parent

    def nearest(self, tag: str, bounds: tuple[str, ...] = ()) -> Node | None:
        """The innermost open element of this tag, unless one of the bounds is open inside it."""
        found = self.open.get(tag)
        if not found or any(self.open.get(b) and self.open[b][-1].depth > found[-1].depth for b in bounds):
            return None
        return found[-1]

    def handle_starttag(self, tag, attrs):
        if (tag == "body" or tag not in IN_HEAD and self.at.tag == "head") and (head := self.nearest("head")):
            self.close_to(head)
        if tag in ("html", "body"):
            return
        if tag in VOID:
            self.at.parts.append(("block" if tag == "hr" else "gap", None))
            self.at.tags += 1
            return
        if tag in CLOSES_P and (p := self.nearest("p", ("td", "th", "table", "button", "object"))):
            self.close_to(p)
        if tag in SELF_NESTED:
            for old in ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,):
                if node := self.nearest(old, SELF_NESTED[tag]):
                    self.close_to(node)
        in_root = bool(self.open.get("article") or self.open.get("main"))
        cut, named = is_boilerplate(tag, attrs, in_root)
        node = Node(tag, self.at, self.at.cut or cut, named)
        self.at.parts.append(("node", node))
        self.at = node
        self.open.setdefault(tag, []).append(node)

    def handle_endtag(self, tag):
        if tag == "p" and not self.open.get("p"):
            self.at.parts.append(("block", None))
        elif tag not in ("html", "body") and (node := self.nearest(tag)):
            self.close_to(node)

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip():
            self.close_to(self.at)
        if not self.at.cut:
            self.at.parts.append(("text", unescaped(data)))


def in_order(top: Node) -> list[Node]:
    """Nodes that are not cut, parents first."""
    found, stack = [], [top]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [p for kind, p in reversed(node.parts) if kind == "node" and not p.cut]
    return found


def settle(top: Node) -> None:
    """Cuts forms and parts whose names tell boilerplate and content, except those that hold the page's text.

    A form with most of the text is a container around it. A part with both kinds of names goes unless less than
    LEAST_REST of its text were left on the page.
    """
    nodes = in_order(top)
    if not any(n.tag == "form" or n.named for n in nodes):
        return
    chars: dict[int, int] = {}
    for node in reversed(nodes):
        chars[id(node)] = sum(len("".join(part.split())) if kind == "text" else chars[id(part)] if kind == "node" and not part.cut else 0 for kind, part in node.parts)
    for node in nodes:
        if node.tag == "form":
            node.cut = 2 * chars[id(node)] <= chars[id(top)]
    unnamed: dict[int, int] = {}
    for node in reversed(nodes):
        unnamed[id(node)] = 0 if node.named or node.cut else sum(len("".join(part.split())) if kind == "text" else unnamed[id(part)] if kind == "node" and not part.cut else 0 for kind, part in node.parts)
    for node in nodes:
        if node.named and not node.cut:
            node.cut = unnamed[id(top)] >= LEAST_REST * chars[id(node)]


def measure(top: Node) -> list[Node]:
    """Counts from the leaves up, then densities, which need the body's counts."""
    nodes = in_order(top)
    for node in reversed(nodes):
        for kind, part in node.parts:
            if kind == "text":
                node.chars += len(part) - part.count(" ") - part.count("\n")
            elif kind == "node" and not part.cut:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = top.link_chars / max(top.chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(c / lc * t / lt, 1.0) + 1.0) / math.log(base + 1.0)
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def choose(top: Node) -> list[Node]:
    """Roots of the content, in page order: the subtree with the largest sum and what reaches the threshold."""
    nodes = [n for n in measure(top) if n.chars]
    if not nodes:
        return []
    best = max(nodes, key=lambda n: n.total * (FAVOUR if n.tag in ROOTS else 1))
    best = best if best.total > 0 else max(nodes, key=lambda n: n.density)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    articles = [i for i, n in enumerate(path) if n.tag == "article"]
    path = path[articles[-1] :] if articles else path
    best = path[0]
    limit, on_path = min(n.density for n in path), {id(n) for n in path}

    def is_content(n: Node) -> bool:
        return n.density * (FAVOUR if n.tag in ROOTS else 1) >= limit and 2 * n.link_chars <= n.chars

    # Beside the path: subtrees as dense as the threshold, and headings, which are short but belong to the text.
    roots = []
    for above in reversed(path):
        if above is best:
            continue
        roots += [n for kind, n in above.parts if kind == "node" and not n.cut and n.chars and id(n) not in on_path and (is_content(n) or n.tag in ("h1", "h2", "h3"))]
    order = {id(n): i for i, n in enumerate(nodes)}
    return sorted([*roots, best], key=lambda n: order[id(n)])


def blocks_of(roots: list[Node]) -> list[str]:
    found: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            found.append(text)
        line.clear()

    for root in roots:
        flush()
        stack = [("node", root)]
        while stack:
            kind, part = stack.pop()
            if kind == "text":
                line.append(part)
            elif kind == "gap":
                line.append(" ")
            elif kind == "block":
                flush()
            elif not part.cut:
                block = part.tag in BLOCKS
                if block:
                    flush()
                    stack.append(("block", None))
                stack += reversed(part.parts)
    flush()
    return found


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    settle(tree.top)
    return "\n".join(blocks_of(choose(tree.top)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text: the main text of each page, its blocks joined by a line feed.

    A null or empty page, or one that is all boilerplate, has an empty text. Every page keeps its row, also where
    page_id or url is null or repeated; other columns are not read. Whole pages are parsed, whatever their length.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                text = pa.array([main_text(h) for h in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
