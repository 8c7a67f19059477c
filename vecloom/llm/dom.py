"""Pages as trees, trees aligned with trees, and the blocks of text that a tree holds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
from xxhash import xxh64_intdigest

# Fixed values of the HTML standard: elements without content, elements that end a paragraph, elements that may stand in a head.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
NO_PARAGRAPH = BLOCK - {"p"}
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: A start tag ends these elements, if they are open, without passing those behind them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "caption"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
}
CELLS = frozenset("td th caption table".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
#: Elements below this depth become siblings, as in browsers.
DEPTH = 150

# Never part of an article: by element, by role, by a word of class or id, and outside an article only.
NO_TEXT = frozenset("script style noscript template title head svg iframe object canvas audio video select textarea button datalist".split())
APART = frozenset("nav footer aside form menu dialog search".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars "
    "footer cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe signup login comment comments disqus replies respond related recommended recommendations "
    "share sharing social pagination pager widget widgets".split()
)
HEADS = frozenset("header masthead topbar".split())
MAIN = frozenset("article main".split())
#: Words that say what a page has, not what an element is (``with-sidebar``).
ABOUT = frozenset("has with without no not is".split())


class Node:
    """An element, or a text ("#") with its length and its token, a hash that stands for it in alignments."""

    __slots__ = ("tag", "names", "role", "children", "said", "text", "token", "chars", "index", "end", "shape", "key", "full", "apart")

    def __init__(self, tag: str, text: str = "", names: str = "", role: str = "", token: int = 0, chars: int = 0):
        self.tag, self.text, self.names, self.role, self.token, self.chars = tag, text, names, role, token, chars
        self.children: list[Node] = []
        self.index = self.end = 0


class _Builder:
    def __init__(self):
        self.root = Node("#root")
        self.open = [self.root]

    def _end(self, tags: tuple[str, ...], until: frozenset | tuple) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                del self.open[i:]
                return
            if tag in until:
                return

    def start(self, tag: str, attributes: str) -> None:
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.open.pop()
        if tag in BLOCK:
            self._end(("p",), NO_PARAGRAPH)
            if tag in ENDS:
                self._end(*ENDS[tag])
            if tag in ("html", "body") and any(n.tag == tag for n in self.open):
                return
        node = Node(tag)
        if "=" in attributes:
            a = {}
            for m in ATTRIBUTE.finditer(attributes):
                a.setdefault(m[1].lower(), unescape(m[2].strip("\"'")).lower())
            if a:
                node.names = " ".join([*a.get("class", "").split(), *a.get("id", "").split()])
                node.role = " ".join(a.get("role", "").split())
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start(tag, "")
        elif tag in BLOCK:
            self._end((tag,), () if tag in TABLE_PARTS else CELLS)
        else:
            self._end((tag,), BLOCK)

    def data(self, text: str) -> None:
        if self.open[-1].tag == "head" and not text.isspace():
            self.open.pop()
        last = self.open[-1].children
        if last and last[-1].tag == "#":
            last[-1].text += text
        else:
            last.append(Node("#", text))


#: A comment; a start or end tag with its attributes; anything else that no browser shows.
MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: What stands in these elements is no markup, and never text of an article.
RAW = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes")}
CUT_TAG = re.compile("<[a-zA-Z/!]")


def parse(html: str) -> Node:
    """The tree of a page of any kind; numbered, with what the alignment needs of each subtree. Markup that the page's end cuts off is no text."""
    builder, at, raw = _Builder(), 0, True
    while raw:
        raw = None
        for m in MARKUP.finditer(html, at):
            if m.start() > at:
                text = html[at : m.start()]
                builder.data(unescape(text) if "&" in text else text)
            at = m.end()
            slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if tag:
                tag = tag.lower()
                if slash:
                    builder.end(tag)
                else:
                    builder.start(tag, attributes)
                    if tag in RAW:
                        raw = tag
                        break
        if raw:
            ending = RAW[raw].search(html, at)
            at = ending.start() if ending else len(html)
    rest = html[at:]
    cut = CUT_TAG.search(rest, rest.rfind(">") + 1)
    rest = rest[: cut.start()] if cut else rest
    if rest:
        builder.data(unescape(rest))
    _finish(builder.root, 0)
    return builder.root


def _finish(node: Node, at: int) -> int:
    """Numbers in document order, and what the alignment needs; text of white space alone is a blank, other text is squeezed."""
    node.index = at
    at += 1
    if node.tag == "#":
        node.shape, node.full, node.key, node.apart = 0, 2, node.token, ""
    else:
        kept, said = [], []
        for child in node.children:
            if child.tag == "#" and not child.chars:
                text = child.text
                squeezed = " ".join(text.split())
                if squeezed:
                    child.token, child.chars = xxh64_intdigest(squeezed), len(squeezed)
                    child.text = f"{' ' if text[0].isspace() else ''}{squeezed}{' ' if text[-1].isspace() else ''}"
                elif kept:
                    child.text = " "
                else:
                    continue
            kept.append(child)
            if child.tag != "#" or child.chars:
                said.append(child)
            at = _finish(child, at)
        node.children, node.said = kept, said
        node.shape = hash((node.tag, node.names, *[c.shape for c in said]))
        node.key = hash((node.shape, *[c.key for c in said]))
        node.full = 2 + sum([c.full for c in said])
        node.apart = is_apart(node)
    node.end = at
    return at


def skeleton(root: Node) -> dict:
    """A tree without its texts: of each node what it is, where its subtree ends, the token and length of its text."""
    out: dict[str, list] = {"labels": [], "ends": [], "tokens": [], "chars": []}
    todo = [root]
    while todo:
        n = todo.pop()
        out["labels"].append(n.tag if not n.names and not n.role else f"{n.tag}\n{n.names}\n{n.role}")
        out["ends"].append(n.end)
        out["tokens"].append(n.token - (1 << 63))
        out["chars"].append(n.chars)
        todo += n.children[::-1]
    return out


def from_skeleton(held: dict) -> Node:
    """The tree that a skeleton was made of; its texts are empty."""
    above: list[tuple[int, Node]] = []
    root = None
    for at, (label, end, token, chars) in enumerate(zip(held["labels"], held["ends"], held["tokens"], held["chars"])):
        tag, _, rest = label.partition("\n")
        names, _, role = rest.partition("\n")
        node = Node(tag, " " if tag == "#" else "", names, role, token + (1 << 63), chars)
        while above and above[-1][0] <= at:
            above.pop()
        if root is None:
            root = node
        else:
            above[-1][1].children.append(node)
        above.append((end, node))
    _finish(root, 0)
    return root


def blank(node: Node) -> bool:
    return node.tag == "#" and not node.chars


def is_main(node: Node) -> bool:
    return node.tag in MAIN or node.role == "main"


def is_apart(node: Node) -> str:
    """Whether a node is apart from any article ("all"), apart if it stands outside of one ("outside"), or neither ("")."""
    if node.tag in NO_TEXT:
        return "all"
    if node.tag == "#" or node.tag in ("html", "body", "main") or (is_main(node) and not _named(node, APART_NAMES)):
        return ""
    if node.tag in APART or node.role in APART_ROLES or _named(node, APART_NAMES):
        return "" if any(is_main(n) and not n.apart for n in walk(node)) else "all"
    if node.tag in HEADS or _named(node, HEADS):
        return "" if any(is_main(n) and not n.apart for n in walk(node)) else "outside"
    return ""


def _named(node: Node, words: frozenset) -> bool:
    for name in node.names.split():
        if name in words:
            return True
        parts = name.replace("_", "-").split("-")
        if len(parts) > 1 and parts[0] not in ABOUT and (parts[0] in words or parts[-1] in words):
            return True
    return False


def walk(node: Node) -> Iterator[Node]:
    """The elements below a node."""
    for child in node.children:
        if child.tag != "#":
            yield child
            yield from walk(child)


#: Cells of an alignment table that are kept at once; larger ones are halved first.
CELLS_HELD = 1 << 22


def weight(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: how much of two subtrees stands in the same order under the same elements.

    A pair of elements of one kind counts 1, and 1 more if their classes are equal; texts count 1, equal ones 2.
    """
    if a.tag != b.tag:
        return 0
    if a.key == b.key:
        return a.full
    if a.tag == "#":
        return 1
    left, right = a.said, b.said
    own = 1 + (a.names == b.names)
    if len(left) == 1 and len(right) == 1:
        return own + weight(left[0], right[0], memo)
    found = memo.get((a.index, b.index))
    if found is None:
        found = memo[a.index, b.index] = own + sum([weight(x, y, memo) for x, y in aligned_children(left, right, memo)])
    return found


def aligned_children(left: list[Node], right: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """The pairs of greatest weight that keep the order of both lists."""
    if len(left) == len(right) > 1:
        tags = [c.tag for c in left]
        # different elements in the same order: all pairs weigh something, and no others do
        if len(set(tags)) == len(tags) and tags == [c.tag for c in right]:
            return list(zip(left, right))
    ends: list[tuple[Node, Node]] = []
    first = 0
    # equal subtrees at either end are in some best alignment: nothing weighs more for either of them
    while first < min(len(left), len(right)) and left[first].key == right[first].key:
        ends.append((left[first], right[first]))
        first += 1
    left, right = left[first:], right[first:]
    last: list[tuple[Node, Node]] = []
    while left and right and left[-1].key == right[-1].key:
        last.append((left[-1], right[-1]))
        left, right = left[:-1], right[:-1]
    if not left or not right:
        return ends + last[::-1]
    if len(left) * len(right) > CELLS_HELD and len(left) > 1:
        half = len(left) // 2
        before, after = _scores(left[:half], right, memo)[-1], _scores(left[:half - 1:-1], right[::-1], memo)[-1][::-1]
        cut = int((before + after).argmax())
        middle = aligned_children(left[:half], right[:cut], memo) + aligned_children(left[half:], right[cut:], memo)
    else:
        middle = _traced(left, right, memo)
    return ends + middle + last[::-1]


def _weights(a: Node, right: list[Node], memo: dict) -> list[int]:
    """The weights of a node against a list; most pairs are paragraphs of one text each."""
    tag, key, shape, full = a.tag, a.key, a.shape, a.full
    plain = full - 1 if tag != "#" and len(a.said) == 1 and a.said[0].tag == "#" else 0
    return [0 if b.tag != tag else full if b.key == key else plain if plain and b.shape == shape else weight(a, b, memo) for b in right]


def _scores(left: list[Node], right: list[Node], memo: dict) -> list[np.ndarray]:
    """The last row of the table, in a list."""
    row = np.zeros(len(right) + 1, np.int64)
    for a in left:
        best = row.copy()
        np.maximum(best[1:], row[:-1] + np.array(_weights(a, right, memo), np.int64), out=best[1:])
        row = np.maximum.accumulate(best)
    return [row]


def _traced(left: list[Node], right: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    n, m = len(left), len(right)
    weights = [_weights(a, right, memo) for a in left]
    if n == 1 or m == 1:
        best = max((w, -i, -j) for i, row in enumerate(weights) for j, w in enumerate(row))
        return [(left[-best[1]], right[-best[2]])] if best[0] else []
    if n * m > 4096:
        rows = np.zeros((n + 1, m + 1), np.int32)
        for i in range(n):
            best = rows[i].copy()
            np.maximum(best[1:], rows[i, :-1] + np.array(weights[i], np.int32), out=best[1:])
            rows[i + 1] = np.maximum.accumulate(best)
    else:
        rows = [[0] * (m + 1)]
        for i in range(n):
            up, w, new, held = rows[i], weights[i], [0], 0
            for j in range(m):
                held = max(held, up[j + 1], up[j] + w[j])
                new.append(held)
            rows.append(new)
    out, i, j = [], n, m
    while i and j:
        w = weights[i - 1][j - 1]
        if w and rows[i][j] == rows[i - 1][j - 1] + w:
            out.append((left[i - 1], right[j - 1]))
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(page: Node, other: Node) -> dict[int, Node]:
    """The nodes of ``page``, by number, that stand against one of ``other``."""
    out: dict[int, Node] = {}
    memo: dict = {}
    todo = [(page, other)]
    while todo:
        a, b = todo.pop()
        out[a.index] = b
        if a.tag != "#":
            left, right = a.said, b.said
            if len(left) == 1 and len(right) == 1:
                todo += [(left[0], right[0])] if left[0].tag == right[0].tag else []
            else:
                todo += aligned_children(left, right, memo)
    return out


def counterpart(page: Node, path: list[Node]) -> Node | None:
    """The node of a page that stands against the last of a path from another tree's root; only lists along the path are aligned."""
    memo: dict = {}
    for above, below in zip(path, path[1:]):
        left, right = page.said, above.said
        pairs = [(left[0], right[0])] if len(left) == len(right) == 1 and left[0].tag == right[0].tag else aligned_children(left, right, memo)
        page = next((a for a, b in pairs if b is below), None)
        if page is None:
            return None
    return page


class Block:
    """A block of text: its text nodes, the innermost element of another page's that it stands in, whether it is in the page's own article."""

    __slots__ = ("pieces", "nodes", "main", "above")

    def __init__(self, main: bool, above: list[int]):
        self.pieces: list[str] = []
        self.nodes: list[Node] = []
        self.main, self.above = main, above

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def blocks(root: Node) -> list[Block]:
    """The blocks of text in page order, without what is never part of an article. Menus made of links alone go as well, outside articles.

    A line break is white space, a block element ends a block.
    """
    has_main = any(is_main(n) and not n.apart for n in walk(root))
    out: list[Block] = []
    now: list[Block | None] = [None]

    def visit(node: Node, inside: bool, above: list[int]) -> None:
        if node.apart == "all" or (node.apart == "outside" and not inside) or (not inside and is_menu(node)):
            now[0] = None if node.tag in BLOCK else now[0]
            return
        if node.tag == "#":
            if now[0] is None:
                now[0] = Block(inside or not has_main, above)
                out.append(now[0])
            now[0].pieces.append(node.text)
            if node.chars:
                now[0].nodes.append(node)
            return
        if node.tag == "br":
            if now[0] is not None:
                now[0].pieces.append(" ")
            return
        if node.tag in BLOCK:
            now[0] = None
        inside, above = inside or is_main(node), [*above, node.index]
        for child in node.children:
            visit(child, inside, above)
        if node.tag in BLOCK:
            now[0] = None

    visit(root, False, [])
    return [b for b in out if b.nodes]


def is_menu(node: Node) -> bool:
    """A list whose text is all in links, two or more of them."""
    if node.tag not in ("ul", "ol", "menu", "dir"):
        return False
    links = sum(n.tag == "a" for n in walk(node))
    return links >= 2 and not _outside_links(node)


def _outside_links(node: Node) -> bool:
    return any(not blank(c) if c.tag == "#" else c.tag != "a" and _outside_links(c) for c in node.children)
