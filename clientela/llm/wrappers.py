"""Wrappers of web pages: a union-free expression for each host, inferred from all its pages.

A page is a stream of tags and texts. Streams of a host are aligned one after the other: what
agrees stays, a text that differs becomes a slot, a stretch that only one side has becomes
optional, and a stretch that recurs in place becomes a repeated group. Streams are aligned level by
level along their tags, as opening and closing tags must stay paired. Aligning wrappers with each
other works the same way, so that parts of a host can be aligned apart and brought together.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

# Elements by kind, as the HTML standard has them.
RAW = "script style noscript template iframe svg math canvas object textarea".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
    "ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
# What is around the article: elements, and words in class, id or role.
AROUND = set(
    "nav header footer aside form menu dialog button select input fieldset head title".split()
)
AROUND_WORDS = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banners?|promos?|sponsored|sidebars?|menus?|"
    r"nav|navbar|navigation|breadcrumbs?|footers?|headers?|masthead|cookies?|notices?|consent|"
    r"comments?|replies|share|social|related|popups?|modals?|newsletter|subscribe|widgets?|"
    r"complementary|contentinfo|search)(?:$|[\s_-])"
)
MAIN = ("article", "main")
STATES = ("has-", "no-", "not-", "is-", "with-", "without-")  # such classes say what something has

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?/][^>]*>?"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(
    r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I
)
TEXT = "#"
DEEPEST = 150  # blocks nested further are taken as one block after the other
CELLS = 250_000  # of the table for a gap without common landmarks; larger ones are walked along


@dataclass
class Node:
    """An element, a group of elements in a row, or a text, with how often it occurs in place.

    ``text`` is what all occurrences say (None: they differ, a slot). ``size`` adds up characters
    of text, ``pages`` counts aligned pages that have it.
    """

    label: str
    children: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    text: str | None = None
    size: int = 0
    pages: int = 1

    @property
    def name(self) -> str:
        return self.label.split(" ", 1)[0]

    def around(self) -> bool:
        """Whether it stands around the article rather than in it."""
        if self.name in AROUND:
            return True
        words = self.label.split(" ")[1:]
        said = " ".join(w for w in words if not w.lower().startswith(STATES))
        return AROUND_WORDS.search(said) is not None

    def expression(self) -> str:
        """The wrapper as a regular expression over :func:`stream`: slots are any text, groups have
        ? or + or both (*)."""
        if self.label == TEXT:
            inner = "[^<>]+" if self.text is None else re.escape(_plain(self.text))
            inner += ";"
        else:
            body = "".join(c.expression() for c in self.children)
            tag = re.escape(_plain(self.label))
            inner = body if self.label.startswith("(") else f"<{tag}>{body}</>"
        mark = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[self.optional, self.repeated]
        return f"(?:{inner}){mark}" if mark else inner


def _plain(text: str) -> str:
    return re.sub(r"[<>]", "|", text)


def stream(page: Node) -> str:
    """The tokens of a page, as expressions match them."""
    if page.label == TEXT:
        return f"{_plain(page.text or '')};"
    return f"<{_plain(page.label)}>{''.join(map(stream, page.children))}</>"


def matches(wrapper: Node, page: str | None) -> bool:
    """Whether the wrapper's expression matches a whole page."""
    return re.fullmatch(wrapper.expression(), stream(tree(page)), re.S) is not None


def label_of(name: str, rest: str) -> str:
    if "=" not in rest:
        return name
    marks = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
    said = " ".join([name, *(marks[k] for k in ("class", "id", "role") if marks.get(k))])
    return re.sub(r"\d+", "0", said)  # numbered classes are one class


def tree(page: str | None) -> Node:
    """The page as nested blocks; inline tags are left out, comments and raw elements too."""
    root = Node("root")
    stack, names, words = [root], ["(root)"], []

    def end_text() -> None:
        if words:
            said = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if said:
                stack[-1].children.append(Node(TEXT, text=said, size=len(said)))

    for token in TOKEN.finditer(page or ""):
        if token["text"] is not None:
            words.append(token["text"])
            continue
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in INLINE:
            continue
        end_text()
        if name in VOID:
            continue
        if token["close"]:
            if name in names:
                while names.pop() != name:
                    stack.pop()
                stack.pop()
            continue
        closed = CLOSED_BY.get(name, ())
        while names[-1] == "p" or names[-1] in closed:
            stack.pop()
            names.pop()
        node = Node(label_of(name, token["rest"] or ""))
        stack[-1].children.append(node)
        if not (token["rest"] or "").endswith("/"):
            # All names are kept, so that closing tags match; what stands around the article, too.
            own = len(stack) < DEEPEST or (node.around() and not stack[-1].around())
            stack.append(node if own else stack[-1])
            names.append(name)
    end_text()
    return root


def group_label(nodes: list[Node]) -> str:
    return "(" + ",".join(n.label for n in nodes)


def group_of(nodes: list[Node]) -> Node:
    return Node(group_label(nodes), list(nodes), size=sum(n.size for n in nodes))


def fold(children: list[Node]) -> list[Node]:
    """Neighbours that recur become one repeated group; stretches of up to four are tried."""
    for period in range(1, 5):
        if len(children) < 2 * period:
            break
        out: list[Node] = []
        for node in children:
            out.append(node)
            before, last = out[-2 * period : -period], out[-period:]
            same = len(before) == period and all(
                a.label == b.label and a.label != TEXT for a, b in zip(before, last)
            )
            if period == 1 and same:
                out[-2:] = [repeat(before[0], last[0])]
            elif same:
                out[-2 * period :] = [repeat(group_of(before), group_of(last))]
            elif (
                period > 1
                and len(out) > period
                and out[-period - 1].label.startswith("(")
                and out[-period - 1].label == group_label(last)
            ):
                out[-period - 1 :] = [repeat(out[-period - 1], group_of(last))]
        children = out
    return children


def repeat(left: Node, right: Node) -> Node:
    joined = align(left, right)
    joined.repeated, joined.optional, joined.pages = True, left.optional, left.pages
    return joined


def folded(node: Node) -> Node:
    """The page's own wrapper: every level with its repeated groups found."""
    node.children = fold([folded(c) for c in node.children])
    node.size += sum(c.size for c in node.children)
    return node


def align(left: Node, right: Node) -> Node:
    """The wrapper of both, which have the same label."""
    out = Node(
        left.label,
        optional=left.optional or right.optional,
        repeated=left.repeated or right.repeated,
        text=left.text if left.text == right.text else None,
        size=left.size + right.size,
        pages=left.pages + right.pages,
    )
    a, b = left.children, right.children
    if [n.label for n in a] == [n.label for n in b]:
        out.children = [align(x, y) for x, y in zip(a, b)]
        return out
    i = j = 0
    for x, y in [*common_labels([n.label for n in a], [n.label for n in b]), (len(a), len(b))]:
        for node in [*a[i:x], *b[j:y]]:
            node.optional = True
            out.children.append(node)
        if x < len(a):
            out.children.append(align(a[x], b[y]))
        i, j = x + 1, y + 1
    out.children = fold(out.children)
    return out


def common_labels(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal labels, ascending in both lists.

    Equal starts and ends go first. Labels that occur once on either side are landmarks: the
    longest ascending run of them cuts the lists into gaps, and each gap is done likewise. A gap
    without landmarks is aligned by a table if it is small, and else by the next equal label, so
    that space stays in proportion to the lists.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, high, first, last = todo.pop()
        while low < high and first < last and a[low] == b[first]:
            found.append((low, first))
            low, first = low + 1, first + 1
        while low < high and first < last and a[high - 1] == b[last - 1]:
            high, last = high - 1, last - 1
            found.append((high, last))
        if low == high or first == last:
            continue
        landmarks = _landmarks(a, b, low, high, first, last)
        if landmarks:
            found += landmarks
            for x, y in [*landmarks, (high, last)]:
                todo.append((low, x, first, y))
                low, first = x + 1, y + 1
        elif (high - low) * (last - first) <= CELLS:
            found += _by_table(a, b, low, high, first, last)
        else:
            found += _by_next(a, b, low, high, first, last)
    return sorted(found)


def _landmarks(a, b, low, high, first, last) -> list[tuple[int, int]]:
    here, there = Counter(a[low:high]), Counter(b[first:last])
    place = {b[j]: j for j in range(first, last) if there[b[j]] == 1}
    pairs = [(i, place[a[i]]) for i in range(low, high) if here[a[i]] == 1 and a[i] in place]
    # The longest ascending run: ends[n] is the least end of a run of n + 1 pairs.
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        ends[k : k + 1] = [j]
        back.append(at[k - 1] if k else -1)
        at[k : k + 1] = [n]
    run, n = [], at[-1] if at else -1
    while n >= 0:
        run.append(pairs[n])
        n = back[n]
    return run[::-1]


def _by_table(a, b, low, high, first, last) -> list[tuple[int, int]]:
    best = [[0] * (last - first + 1) for _ in range(high - low + 1)]
    for i in range(high - 1, low - 1, -1):
        row, below = best[i - low], best[i - low + 1]
        for j in range(last - 1, first - 1, -1):
            row[j - first] = (
                below[j - first + 1] + 1 if a[i] == b[j] else max(below[j - first], row[j - first + 1])
            )
    found, i, j = [], low, first
    while i < high and j < last:
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i - low + 1][j - first] >= best[i - low][j - first + 1]:
            i += 1
        else:
            j += 1
    return found


def _by_next(a, b, low, high, first, last) -> list[tuple[int, int]]:
    places = defaultdict(list)
    for j in range(first, last):
        places[b[j]].append(j)
    found, after = [], first - 1
    for i in range(low, high):
        ahead = places.get(a[i], [])
        k = bisect_right(ahead, after)
        if k < len(ahead):
            after = ahead[k]
            found.append((i, after))
    return found


Path = tuple[str, ...]


def regions(wrapper: Node) -> set[Path]:
    """Where the article is: paths of labels from the root, boilerplate left aside.

    Articles, or else main elements, that hold text. Otherwise the wrapper is followed down while
    one child holds most of the text.
    """
    for wanted in MAIN:
        plain = dict(_named(wrapper, (), wanted, False))
        # An element of this name whose class has one of the words counts if it holds the most.
        every = dict(_named(wrapper, (), wanted, True))
        marked = {p: n for p, n in every.items() if p not in plain}
        if sum(marked.values()) > sum(plain.values()):
            largest = max(marked, key=lambda p: marked[p])
            return {largest, *(p for p in plain if p[: len(largest)] != largest)}
        if plain:
            return set(plain)
    path, node = (wrapper.label,), wrapper
    while True:
        inner = [c for c in _elements(node) if not c.around()]
        total = sum(_inside(c) for c in inner) + sum(
            c.size for c in node.children if c.label == TEXT
        )
        widest = max(inner, key=_inside, default=None)
        holds = widest is not None and any(not c.around() for c in _elements(widest))
        if not holds or 10 * _inside(widest) < 6 * total:
            return {path}
        path, node = (*path, widest.label), widest


def _elements(node: Node) -> Iterator[Node]:
    """Child elements, those within groups included."""
    for child in node.children:
        if child.label.startswith("("):
            yield from _elements(child)
        elif child.label != TEXT:
            yield child


def _inside(node: Node) -> int:
    return node.size - sum(c.size for c in _elements(node) if c.around())


def _named(node: Node, path: Path, wanted: str, marked: bool) -> Iterator[tuple[Path, int]]:
    """Elements of a name that hold text, with how much; with ``marked``, whatever their class."""
    if node.around() and not (marked and node.name == wanted):
        return
    path = (*path, node.label)
    if node.name == wanted and node.size:
        yield path, node.size
        return
    for child in _elements(node):
        yield from _named(child, path, wanted, marked)


def blocks(page: Node, wanted: set[Path]) -> list[str]:
    """Texts of the article in page order."""
    out: list[str] = []

    def walk(node: Node, path: Path, inside: bool) -> None:
        path = (*path, node.label)
        inside = inside or path in wanted
        for child in node.children:
            if child.label == TEXT:
                if inside:
                    out.append(child.text)
            elif not child.around() or (not inside and (*path, child.label) in wanted):
                walk(child, path, inside)

    walk(page, (), False)
    return out


def main_text(page: str | None, found: set[Path] | None) -> str:
    """The article's blocks, two line feeds between them; by the page's own wrapper if the host's
    does not fit."""
    node = tree(page)
    said = blocks(node, found) if found else []
    if not said:
        said = blocks(node, regions(folded(tree(page))))
    return "\n\n".join(said)
