"""Main text of web pages by wrappers that are inferred for each host.

A page is a stream of tokens: opening and closing block tags (with class, id and role)
and text slots. The wrapper of a host is a union-free regular expression over such tokens:
sequences of elements, where an element may be optional or repeated, and text slots. It
is inferred step by step: inside a page, neighbouring runs of equal elements fold into a
repeated group; two pages, or two wrappers, are aligned element by element along their
longest common subsequence (found between labels that each side has once, where the
sequences are long), and what only one side has becomes optional. A level that would get
more than MAX_ITEMS elements, as class names are made up for each page, is generalised: its
elements then are told apart by tag alone. Slots gather
how much text they hold, how much of it in links, and whether it ever differs. On the
finished wrapper the elements that hold the main text are chosen, on levels from articles
down to the heaviest element; each page then is matched against the wrapper and its text is
read from the elements of the first level that it has, as a host may have pages of several layouts.

Inference is associative, so it runs as partial wrappers in each task, then over salted
groups, then over hosts; a host of very many pages is spread like any other.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import common

SALTS = 16
MAX_GROUP = 4  # elements of a repeated group
MAX_ITEMS = 400  # elements of a level of a wrapper, before they are generalised
MAX_CELLS = 100_000  # of the table of a longest common subsequence
DEPTH = 200  # elements nested deeper lie side by side at this depth, as they do in browsers (at 512)
ANY = ".*"  # ends the label of a generalised element
LEVELS = 4  # of main elements
SPARED = "!"  # mark of an element that holds a whole page

_opening = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag. A quote only opens a value behind an equals sign; nothing is tried twice.
_rest = re.compile(r"((?>[^>=\"']+|=\s*+(?>\"[^\"]*\"|'[^']*')|=|[\"'])*+)>")
_attributes = re.compile(r"(?<![^\s\"'/>])([^\s\"'>/=]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++))")
# Elements whose inside is no text; those of the first kind run to the end if they aren't closed.
UNREAD = frozenset("script style noscript textarea iframe title".split())
SKIPPED = UNREAD | frozenset("template svg select object".split())
_ends = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in SKIPPED}
_bare_hidden = re.compile(r"(?<![^\s\"'/>])hidden(?![^\s/>])", re.I)
_unseen = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_digits = re.compile(r"\d+")
_space = re.compile(r"\s+")

# Elements of HTML by kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - {"html", "head", "body"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
P_HOLDERS = frozenset("table td th div article section li".split())
LIST_HOLDERS = frozenset("ul ol dl table".split())
CONTAINERS = frozenset("html body div section center table tbody tr td details figure".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements, roles and name parts that are not main text.
DROPPED = frozenset("head nav footer aside form menu dialog button fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu hidden".split())
DROPPED_NAMES = re.compile(
    r"ads?|advert\w*|adslot|adbox|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|foot|header|masthead|topbar"
    r"|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|comments?|commentlist"
    r"|replies|reply|disqus|respond|pagination|pager|skip|toolbar|widget|copyright|legal|disclaimer|tags|meta|byline",
    re.I,
)
# What a name of such parts may hold besides.
BESIDES = frozenset("site page main post posts entry article story content top bottom left right primary secondary global wrapper wrap container inner outer area box bar block section list links buttons form link to by".split())
# Parts of names that say so wherever they stand in a name, articles' names too for those of the second kind.
ANYWHERE = re.compile(r"ads?|advert\w*|adslot|sponsor\w*|banner|nav|navbar|navigation|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|gdpr|popup|newsletter|subscribe|pagination|pager", re.I)
LESSER = re.compile(r"comments?|commentlist|cmts?|disqus|repl(?:y|ies)|teasers?|related|recommend\w*|promo\w*|sponsored", re.I)
MODIFIERS = frozenset("has with no without is not show hide hides".split())  # such a name tells of what is inside
WHOLE = frozenset("html body main article".split())  # elements that no name drops, but for the names of lesser articles
ENCLOSING = frozenset("form fieldset".split())  # elements that may hold a whole page
# What the name of a main element may hold besides, and headings inside it.
MAIN_BESIDES = frozenset("body text page inner wrap wrapper container area section block box single full title headline header head heading lead intro summary blog news".split())
MAIN_NAMES = re.compile(r"(?:^|[-_\s])(?:article|post|entry|story|content|main|maincontent|body-text|prose|text)(?:$|[-_\s])", re.I)


class Node:
    """An element of a page or of a wrapper. Label '#' is a text slot, '()' a repeated group."""

    __slots__ = ("chars", "items", "label", "links", "optional", "pages", "repeated", "text")

    def __init__(self, label: str, items: list[Node] | None = None, text: str | None = None, chars: int = 0, links: int = 0) -> None:
        self.label, self.items, self.text, self.chars, self.links = label, items if items is not None else [], text, chars, links
        self.optional = self.repeated = False
        self.pages = 1

    def dump(self) -> list:
        return [self.label, int(self.optional), int(self.repeated), self.pages, self.chars, self.links, self.text, [i.dump() for i in self.items]]

    @classmethod
    def load(cls, data: list) -> Node:
        node = cls(data[0], [cls.load(i) for i in data[7]], data[6], data[4], data[5])
        node.optional, node.repeated, node.pages = bool(data[1]), bool(data[2]), data[3]
        return node

    def shape(self) -> str:
        inner = "" if self.label == "#" else "(" + " ".join(i.shape() for i in self.items) + ")"
        return self.label + inner + "+" * self.repeated + "?" * self.optional

    def full(self) -> int:
        return self.chars + sum(i.full() for i in self.items)

    def linked(self) -> int:
        return self.links + sum(i.linked() for i in self.items)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """The tokens of a page, in one pass: ("text", "", text), ("open", name, attributes), ("close", name, "") and ("skip", name, "")."""
    at, last, broken, unclosed = 0, page.rfind(">"), False, set()
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or (lt > last and not page.startswith("<!--", lt)):
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            if end < 0:
                return
            at = end + 3
            continue
        m = _opening.match(page, lt)
        if m is None:
            if page[lt + 1] in "!?/":
                at = page.index(">", lt) + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        rest = None if broken else _rest.match(page, m.end())
        if rest is None:  # the page ends inside a value: from here on, tags end at the next mark
            broken, end = True, page.index(">", m.end())
            attributes, at = page[m.end() : end], end + 1
        else:
            attributes, at = rest[1], rest.end()
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
        elif name in SKIPPED and name not in unclosed:
            if end := _ends[name].search(page, at):
                at = page.find(">", end.end()) + 1 or len(page)
                yield "skip", name, ""
            elif name in UNREAD:
                return
            else:
                unclosed.add(name)
        else:
            yield "open", name, attributes


def is_hidden(attributes: str) -> bool:
    """If browsers don't show the element: hidden, aria-hidden="true" or such a style."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    found = {key.lower(): "".join(values) for key, *values in _attributes.findall(attributes)}
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_unseen.search(found.get("style", ""))) or bool(_bare_hidden.search(_attributes.sub(" ", attributes)))


def label_of(name: str, attributes: str) -> str:
    """A tag with its class, id and role; numbers in class names don't matter. Hidden elements have the role 'hidden'."""
    marks = ["@hidden"] if is_hidden(attributes) and name not in ("html", "body") else []
    for key, *values in _attributes.findall(attributes):
        if (key := key.lower()) in ("class", "id", "role"):
            value = entities.unescape("".join(values)).lower()
            marks.append(f"@{value}" if key == "role" else _digits.sub("0", " ".join(value.split())))
    return f"{name}.{'.'.join(marks)}" if marks else name


def parse(page: str | None) -> Node:
    """The element tree of a page: block elements, and text slots with their whole text."""
    root = Node("root")
    stack, places, parts, links, in_link = [("", root)], defaultdict(list), [], 0, 0
    muted, depth = "", 0  # the inline element that hides what is read, and how many of its name are open

    def flush() -> None:
        nonlocal links
        if parts:
            text = _space.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                stack[-1][1].items.append(Node("#", text=text, chars=len(text), links=min(links, len(text))))
            links = 0

    def close(names: Iterable[str], until: Iterable[str] = ()) -> None:
        """Close the last open element of the names, unless one of ``until`` is open inside it."""
        inner = max((places[n][-1] for n in names if places[n]), default=0)
        if inner and inner > max((places[n][-1] for n in until if places[n]), default=0):
            flush()
            for name, _ in stack[inner:]:
                places[name].pop()
            del stack[inner:]

    for kind, name, more in tokens(page or ""):
        if muted and name not in BLOCKS:
            depth += {"open": 1, "close": -1}.get(kind, 0) if name == muted else 0
            muted = muted if depth else ""
        elif kind == "open" and name not in BLOCKS and name not in VOID and is_hidden(more):
            muted, depth = name, 1
        elif kind == "text":
            parts.append(more)
            links += len(more.strip()) if in_link else 0
        elif kind == "skip":
            parts.append(" ")
        elif name == "a":
            in_link = int(kind == "open")
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            muted = ""  # no block is inside an inline element that hides text
            if kind == "close":
                close((name,))
                continue
            flush()
            if name in ENDS_P:
                close(("p",), P_HOLDERS)
            if name in CLOSED_BY:
                close(CLOSED_BY[name], LIST_HOLDERS)
            if name in ("body", "html") and places[name]:
                continue
            node = stack[-1][1]
            if len(stack) <= DEPTH:
                node = Node(label_of(name, more))
                stack[-1][1].items.append(node)
            if name not in VOID:
                places[name].append(len(stack))
                stack.append((name, node))
    flush()
    _spare(root)
    return root


def absorb(a: Node, b: Node) -> Node:
    """Two elements of one label as one: the slots' statistics are added, the insides aligned."""
    node = Node(a.label, align(a.items, b.items), a.text if a.text == b.text else None, a.chars + b.chars, a.links + b.links)
    node.optional, node.repeated = a.optional or b.optional, a.repeated or b.repeated
    node.pages = a.pages + b.pages
    return node


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Two sequences as one, along a common subsequence of labels; the rest becomes optional."""
    if any(i.label.endswith(ANY) for i in (*a, *b)):
        return generalised([*a, *b])
    out: list[Node] = []
    i = j = 0
    for p, q in (*matches([n.label for n in a], [n.label for n in b]), (len(a), len(b))):
        for node in (*a[i:p], *b[j:q]):
            node.optional = True
            out.append(node)
        if p < len(a):
            out.append(absorb(a[p], b[q]))
        i, j = p + 1, q + 1
    out = fold(out)
    return out if len(out) <= MAX_ITEMS else generalised(out)


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a common subsequence: the longest one where the table for it is small; else labels that are
    once on either side are matched first, in their longest common order, and the parts between them after that."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= MAX_CELLS:
            found += _longest(a, i, n, b, j, m)
            continue
        once_a, once_b = Counter(a[i:n]), Counter(b[j:m])
        place = {b[k]: k for k in range(j, m) if once_b[b[k]] == 1}
        anchors = _rising([(k, place[a[k]]) for k in range(i, n) if once_a[a[k]] == 1 and a[k] in place])
        if not anchors:  # each label meets its next one on the other side
            nexts: dict[str, list[int]] = defaultdict(list)
            for k in range(m - 1, j - 1, -1):
                nexts[b[k]].append(k)
            at = j - 1
            for k in range(i, n):
                rest = nexts[a[k]]
                while rest and rest[-1] <= at:
                    rest.pop()
                if rest:
                    at = rest.pop()
                    found.append((k, at))
            continue
        edges = [(i - 1, j - 1), *anchors, (n, m)]
        found += anchors
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(found)


def _longest(a: list[str], i: int, n: int, b: list[str], j: int, m: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a[i:n] and b[j:m], by places."""
    x, y = a[i:n], b[j:m]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for k in range(len(x) - 1, -1, -1):
        for h in range(len(y) - 1, -1, -1):
            best[k][h] = best[k + 1][h + 1] + 1 if x[k] == y[h] else max(best[k + 1][h], best[k][h + 1])
    out, k, h = [], 0, 0
    while k < len(x) and h < len(y):
        if x[k] == y[h]:
            out.append((i + k, j + h))
            k, h = k + 1, h + 1
        elif best[k + 1][h] >= best[k][h + 1]:
            k += 1
        else:
            h += 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of pairs, ascending in the first place, that is ascending in the second one too."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, q) in enumerate(pairs):
        at = bisect_left(tails, q)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [q], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def generalised(items: list[Node]) -> list[Node]:
    """A level whose elements are told apart by tag alone, each optional and repeated."""
    found: dict[str, Node] = {}
    for node in (n for i in items for n in (i.items if i.label == "()" else (i,))):
        if node.label != "#":
            node.label = node.label.partition(".")[0] + ANY
        found[node.label] = absorb(found[node.label], node) if node.label in found else node
    for node in found.values():
        node.optional = node.repeated = True
    return list(found.values())


def fold(items: list[Node]) -> list[Node]:
    """Neighbouring runs of equal labels folded into repeated elements, or groups of up to MAX_GROUP elements."""
    out: list[Node] = []
    for node in items:
        if node.label == "()":
            out.append(node)
        elif out and out[-1].label == node.label:
            out[-1] = absorb(out[-1], node)
            out[-1].repeated = True
        elif out and out[-1].label == "()" and (one := _inside(out[-1], node)):
            out[-1] = one
        else:
            out.append(node)
        for size in range(2, MAX_GROUP + 1):
            tail, before = out[-size:], out[-2 * size : -size]
            if len(before) == size and all(p.label == q.label and p.label != "()" for p, q in zip(before, tail)):
                group = Node("()", [absorb(p, q) for p, q in zip(before, tail)])
                group.repeated = True
                out[-2 * size :] = [group]
                break
    return out


def _inside(group: Node, node: Node) -> Node | None:
    """The group with an element that continues its run, if it has one of that label."""
    for k, item in enumerate(group.items):
        if item.label == node.label:
            group.items[k] = absorb(item, node)
            return group
    return None


def wrapper_of(page: Node) -> Node:
    """The wrapper of a single page: its tree with runs folded."""
    node = Node(page.label, fold([wrapper_of(i) for i in page.items]), page.text, page.chars, page.links)
    return node


@lru_cache(100_000)
def _named_dropped(token: str) -> bool:
    """If a class or id says that it isn't main text: some part always does, or all parts do or may stand beside one that does."""
    parts = [p for p in re.split(r"[-_\d]+", token) if p]
    if parts and parts[0] in MODIFIERS:
        return False
    return any(ANYWHERE.fullmatch(p) or LESSER.fullmatch(p) for p in parts) or any(DROPPED_NAMES.fullmatch(p) for p in parts) and all(p in BESIDES or DROPPED_NAMES.fullmatch(p) for p in parts)


@lru_cache(100_000)
def _dropped(label: str) -> bool:
    name, _, marks = label.partition(".")
    parts = marks.split(".") if marks else []
    if any(p[1:] in DROPPED_ROLES for p in parts if p.startswith("@")):
        return True
    if parts and parts[-1] == SPARED:
        return False
    names = [t for p in parts if not p.startswith("@") for t in p.split()]
    if name == "article":
        return any(LESSER.fullmatch(p[-1]) for t in names if (p := [p for p in re.split(r"[-_\d]+", t) if p]))
    return name in DROPPED or (name not in WHOLE and any(map(_named_dropped, names)))


@lru_cache(100_000)
def _main_named(marks: str) -> int:
    """2 if a class or id is made of names of main elements and what may stand beside them, 1 if it holds one among other words, else 0."""
    best = 0
    for token in marks.replace(".", " ").split():
        if MAIN_NAMES.search(token):
            parts = [p for p in re.split(r"[-_\d]+", token) if p]
            best = max(best, 2 if all(p in MAIN_BESIDES or MAIN_NAMES.search(p) for p in parts) else 1)
    return best


def _spare(root: Node) -> None:
    """Mark elements that hold nearly all of a page's text outside links, so that neither a name nor an enclosing form drops them."""

    def kept(node: Node) -> int:
        if node.label == "#":
            return node.chars - node.links
        return 0 if _dropped(node.label) else sum(map(kept, node.items))

    node, outside, half = root, 0, (root.full() - root.linked()) / 2
    while True:
        item = next((i for i in node.items if i.label != "#" and i.full() - i.linked() > half), None)
        if item is None:
            return
        outside += sum(kept(i) for i in node.items if i is not item)
        if _dropped(item.label):
            name = item.label.partition(".")[0]
            if (name in DROPPED and name not in ENCLOSING) or 10 * outside >= item.full() - item.linked():
                return
            item.label += f".{SPARED}"
            if _dropped(item.label):  # by a role
                return
        node = item


def choose(wrapper: Node) -> None:
    """Mark the slots and elements of main text: ``pages`` becomes the sum of their levels' bits, 0 for others.

    Level by level, a page's main element is an article inside a main element (if such hold
    at least half of its text outside links), an article or main element, or one named like it,
    outside everything that is dropped; without any, the smallest element that holds most of
    the text outside links that isn't the same on all pages. The first level has the lowest
    bit. Of elements named like one, those with other words in their names only count if the
    others hold less than half of all. A slot that is the same on nearly all pages of a
    host of at least three is part of the template, unless most of what was chosen is.
    """

    def find(node: Node, strong: bool) -> list[Node]:
        found: list[Node] = []
        for item in node.items:
            if item.label == "#" or _dropped(item.label):
                continue
            name, _, marks = item.label.partition(".")
            named = name in ("article", "main") or "@main" in marks.split(".") or "@article" in marks.split(".")
            if named if strong else _main_named(marks):
                found.append(item)
            else:
                found += find(item, strong)
        return found

    def weight(node: Node) -> float:
        if node.label == "#":
            return 0.0 if node.text is not None and node.pages >= 3 else node.chars - 2.0 * node.links
        return 0.0 if id(node) in taken or _dropped(node.label) or node.label.startswith("header") else sum(weight(i) for i in node.items)

    def likely(regions: list[Node]) -> list[Node]:
        sure = [r for r in regions if _main_named(r.label.partition(".")[2]) == 2]
        return sure if 2 * sum(map(weight, sure)) >= sum(map(weight, regions)) else regions

    def inner(region: Node) -> list[Node]:
        articles = _articles(region)
        return articles if 2 * sum(map(weight, articles)) >= weight(region) else []

    pages = wrapper.pages

    def common_slot(item: Node) -> bool:
        return item.label == "#" and item.text is not None and pages >= 3 and 10 * item.pages >= 9 * pages

    def sizes(node: Node, total: list[int]) -> list[int]:
        """The characters of slots by whether they are common."""
        for item in node.items:
            if item.label == "#":
                total[common_slot(item)] += item.chars
            elif not _dropped(item.label):
                sizes(item, total)
        return total

    def mark(node: Node, bit: int, headed: bool) -> None:
        for item in node.items:
            if id(item) in template:
                continue
            header = item.label.partition(".")[0] == "header"
            if headed if header else item.label == "#" or not _dropped(item.label):
                item.pages |= bit
                mark(item, bit, headed)

    def clear(node: Node) -> None:
        node.pages = 0
        for item in node.items:
            clear(item)

    taken: set[int] = set()
    strong = find(wrapper, True)
    if not any(weight(r) > 0 for r in strong):
        strong = []
    levels = [[i for r in strong for i in inner(r)], strong, likely(find(wrapper, False))]
    taken |= {id(r) for regions in levels for r in regions}  # pages of the last level have none of these
    node = wrapper
    while True:
        best = max((i for i in node.items if i.label.partition(".")[0] in CONTAINERS), key=weight, default=None)
        if best is None or weight(best) < 0.6 * max(weight(node), 1.0):
            break
        node = best
    levels.append([node])
    template: set[int] = set()
    for regions in levels:
        for region in regions:
            differing, same = sizes(region, [0, 0])
            template |= {id(slot) for slot in _slots(region) if same <= differing and common_slot(slot)}
    clear(wrapper)
    for level, regions in enumerate(levels):
        for region in regions:
            region.pages |= 1 << level
            mark(region, 1 << level, region.label.partition(".")[0] in ("article", "main"))  # their headers hold the title


def _articles(node: Node) -> list[Node]:
    """The article elements inside a main element, if it holds any outside what is dropped."""
    if node.label.partition(".")[0] == "article":
        return [node]
    return [a for i in node.items if i.label != "#" and not _dropped(i.label) for a in _articles(i)]


def read(page: Node, wrapper: Node) -> list[str]:
    """The blocks of a page's main text: its elements are matched in order against a wrapper that ``choose`` marked.

    Of the levels whose elements the page has, the first one counts; the last one every page has.
    """
    out: list[tuple[int, str]] = []
    met = 1 << LEVELS - 1

    def walk(items: list[Node], against: list[Node]) -> None:
        nonlocal met
        flat = [g for w in against for g in (w.items if w.label == "()" else [w])]
        by_label: dict[str, list[int]] = {}
        for k, node in enumerate(flat):
            by_label.setdefault(node.label, []).append(k)
        at = 0
        for item in items:
            places = by_label.get(item.label)
            if places is None and item.label != "#" and not _dropped(item.label):
                places = by_label.get(item.label.partition(".")[0] + ANY)
            if places is None:
                continue
            k = places[bisect_left(places, at) % len(places)]  # a run goes round again
            at = k
            if item.label == "#":
                if flat[k].pages:
                    out.append((flat[k].pages, item.text))
            else:
                met |= flat[k].pages
                walk(item.items, flat[k].items)

    walk(page.items, wrapper.items)
    return [text for pages, text in out if pages & met & -met]


def _packed(node: Node) -> str:
    return json.dumps(node.dump(), ensure_ascii=False, separators=(",", ":"))


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each host: host, wrapper (serialised, with the main text chosen), pattern (readable), stored.

    All pages take part, also those without a host, as one host ''.
    """
    source = pages.select(_host(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Node] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                one = wrapper_of(parse(page.as_py()))
                for slot in _slots(one):  # texts only tell if they differ
                    slot.text = str(hash_of(slot.text)) if slot.text is not None else None
                found[host] = absorb(found[host], one) if host in found else one
        hosts = list(found)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([_packed(found[h]) for h in hosts], pa.string())], ["host", "wrapper"])

    def merged(table: pa.Table) -> pa.Table:
        nodes = [Node.load(json.loads(w)) for w in sorted(table.column("wrapper").to_pylist())]
        while len(nodes) > 1:
            nodes = [absorb(nodes[k], nodes[k + 1]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "wrapper": pa.array([_packed(nodes[0])], pa.string())})

    def finished(table: pa.Table) -> pa.Table:
        one = merged(table)
        node = Node.load(json.loads(one.column("wrapper")[0].as_py()))
        pattern = node.shape()
        choose(node)
        return pa.table({"host": one.column("host"), "wrapper": pa.array([_packed(node)], pa.string()), "pattern": pa.array([pattern], pa.string())})

    parts = source.mapInArrow(partial, "host string, wrapper string")
    for salts in (SALTS * SALTS, SALTS):  # a host's partial wrappers meet in steps
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "salt")
        parts = salted.applyInArrow(merged, "host string, wrapper string")
    return common.stored(parts.groupBy("host").applyInArrow(finished, "host string, wrapper string, pattern string"), "wrappers")


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))


def _slots(node: Node) -> Iterator[Node]:
    if node.label == "#":
        yield node
    for item in node.items:
        yield from _slots(item)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, url, text (blocks of main text, joined by a line feed; empty if none), n_chars.

    Null and empty pages give an empty text; pages without a host share one wrapper;
    repeated rows and null ids keep a row each; an empty table gives an empty result;
    other columns are left out. Broken pages lose no text: a tag that never ends, ends at
    the next mark; only an unclosed comment, script or the like takes what follows. Pages meet their host's wrapper by a join that Spark
    may broadcast, when the wrappers' size allows it, or else splits at hosts of many pages.
    """
    wrappers = infer_wrappers(pages, url_col, html_col).select("host", "wrapper")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    both = source.withColumn("host", _host(F.col("url"))).join(wrappers, "host").select("id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column("html"), batch.column("wrapper").to_pylist()):
                if wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = Node.load(json.loads(wrapper))
                texts.append("\n".join(read(parse(page.as_py()), known[wrapper])))
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), sizes], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return both.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
