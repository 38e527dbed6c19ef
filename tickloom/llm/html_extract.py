"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of balanced groups.  Aligning two streams of one host level by level, groups that match are merged,
what only one has becomes optional, and neighbours of one kind become one repeated group; texts are slots.  Tasks
fold their pages into one wrapper per host, then wrappers are aligned with one another in groups of bounded size, so
all pages of a host count however many it has.  The wrapper's slots carry how much text and how much of it is links
they hold, and whether it is the same on all pages; they show which group of the template is the article where no tag
says so, and what in it is template or menu.  Pages are then read through the wrapper of their host.

A text is template if at least DISTINCT different pages, and half of the host's pages, have it in the same group (or
as the first or last of a repeated group) and no page has another there.  Where all pages of a host are alike, as for a
host of one page or of copies, nothing is.
"""

from __future__ import annotations

import collections
import functools
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import written
from tickloom.llm.url_filter import host_of

_RAW = frozenset("script style template noscript iframe svg math object canvas textarea select title".split())
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_SPECIAL = re.compile(r"[>\"']")
_DIGITS = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Opening one of these ends an open element of the second kind.
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_ENDS_OWN = {
    k: frozenset(v.split())
    for k, v in {"li": "ul ol", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}.items()
}
_STOPS_P = frozenset("table td th li div article section body".split())
_CELLS = ("td", "th")
_NOT_TEXT = frozenset("nav header footer aside form button dialog menu input figure-ad head".split())
#: Words of class, id and role that name what is no article.
_NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets
    menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead footer bottom comment comments commentlist reply
    replies respond disqus discussion share sharing social related recommended recommendations pagination pager toolbar search
    skip complementary contentinfo""".split()
)
#: Of these, what also an article element can be; its other classes (with-sidebar, post) say nothing about it.
_NOISE_ARTICLES = frozenset("comment comments commentlist reply replies respond related recommended ad ads advert promo sponsored".split())
#: A class that begins so tells what goes with the element, not what it is.
_ABOUT_OTHERS = frozenset("has with no without is not hide show".split())
_OF_ARTICLE = frozenset("article post entry story".split())
_CONTENT = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element: its kind (name, then class and id words), children, and direct text runs as strings."""

    __slots__ = ("children", "kind", "name", "noise")

    def __init__(self, name: str, kind: str, noise: bool):
        self.name, self.kind, self.noise, self.children = name, kind, noise, []


@functools.lru_cache(maxsize=50_000)
def _opened(name: str, attributes: str) -> tuple[str, bool]:
    words, hidden = [], False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            hidden = True
        elif key in ("class", "id", "role"):
            words += value.lower().split()
    kind = ".".join([name, *words[:3]])
    found = set()
    for w in words:
        parts = [p for p in re.split(r"[^a-z]+", w) if p]
        if parts and parts[0] not in _ABOUT_OTHERS:
            found |= _NOISE.intersection(parts) - ({"header"} if _OF_ARTICLE.intersection(parts) else set())
    if name in ("html", "body", "main"):
        found.clear()
    elif name == "article":
        found &= _NOISE_ARTICLES
    noise = hidden or name in _NOT_TEXT or bool(found)
    if "main" in words and "main" not in kind:
        kind += ".main"
    return kind, noise


class _Scanner:
    """Tags and texts of a page in linear time, however broken it is: what is not found once is not sought again."""

    def __init__(self, page: str):
        self.page, self.missing, self.special, self.dead = page, {}, (0, -1), set()

    def find(self, needle: str, at: int) -> int:
        if at >= self.missing.get(needle, len(self.page) + 1):
            return -1
        found = self.page.find(needle, at)
        if found < 0:
            self.missing[needle] = at
        return found

    def next_special(self, at: int) -> int:
        """The next ``>`` or quote, -1 if there is none."""
        since, found = self.special
        if not (since <= at <= found or (found == len(self.page) and since <= at)):
            match = _SPECIAL.search(self.page, at)
            found = match.start() if match else len(self.page)
            self.special = (at, found)
        return found if found < len(self.page) else -1

    def tag_end(self, at: int) -> int:
        """The ``>`` outside quotes that ends a tag, -1 if there is none."""
        passed = []
        while True:
            at = self.next_special(at)
            if at < 0 or at in self.dead:
                break
            if self.page[at] == ">":
                return at
            passed.append(at)
            close = self.find(self.page[at], at + 1)
            if close < 0:
                break
            at = close + 1
        self.dead.update(passed)
        return -1

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """("text", text, ""), ("open", name, attributes) and ("close", name, "")."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            if page[at] != "<":
                end = self.find("<", at)
                end = n if end < 0 else end
                yield "text", page[at:end], ""
                at = end
                continue
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            if page[at + 1 : at + 2] in ("!", "?"):
                end = self.find(">", at)
            else:
                closing = page[at + 1 : at + 2] == "/"
                name = _NAME.match(page, at + 1 + closing)
                end = -1
                if name:
                    word = name[0].lower()
                    if word in _RAW and not closing:
                        end = self.find(">", name.end())
                        if end >= 0 and page[end - 1] != "/":
                            close = re.compile(rf"</{word}\s*>", re.I).search(page, end)
                            end = close.end() - 1 if close else n
                    else:
                        end = self.tag_end(name.end())
                        if end >= 0:
                            yield ("close" if closing else "open"), word, page[name.end() : end]
            if end < 0:
                yield "text", "<", ""
                end = at
            at = end + 1


def parse(page: str | None) -> Node:
    """The page as balanced groups; unclosed and stray tags are tolerated.  Any nesting depth is fine."""
    root = Node("#root", "#root", False)
    stack, open_ = [root], collections.Counter()

    def cut(k: int) -> None:
        for node in stack[k:]:
            open_[node.name] -= 1
        del stack[k:]

    for what, name, attributes in _Scanner(page or "").tokens():
        if what == "text":
            stack[-1].children.append(name)
            continue
        if what == "close":
            if open_[name] > 0:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if name in _ENDS_P or name in _ENDS_OWN:
            closes, stop = (("p",), _STOPS_P) if name in _ENDS_P else (_CELLS if name in _CELLS else (name,), _ENDS_OWN[name])
            if any(open_[c] > 0 for c in closes):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in closes:
                        cut(k)
                        break
                    if stack[k].name in stop:
                        break
        kind, noise = _opened(name, attributes)
        node = Node(name, kind, noise)
        stack[-1].children.append(node)
        if name not in _VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            open_[name] += 1
    return root


# --- wrappers: lists of the fields below; texts are kept as hashes ------------------------------------------------

#: WHOLE, FIRST, LAST: hash of all text of the group, and of the first and last one of a repeated group; None once two
#: pages differ.  PAGES: pages that have the group.  SEEN: up to DISTINCT hashes of such pages' whole texts.
KIND, OPTIONAL, REPEATED, CHARS, LINKS, NOISE, CHILDREN, PAGES, WHOLE, FIRST, LAST, SEEN = range(12)
#: Levels below which groups are not told apart, save articles and main groups, and children that a group keeps apart.
#: Bounds a wrapper's size; texts are counted, and pages read, to any depth and length.
DEEPEST, WIDEST = 24, 64
#: Text that so many different pages, and at least half of a host's, have in the same place is template.
DISTINCT = 5


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest(" ".join(map(str, parts))) >> 11


def _group(kind: str, noise: bool) -> list:
    return [kind, False, False, 0, 0, noise, [], 1, 0, 0, 0, []]


def page_wrapper(root: Node) -> list:
    """The wrapper of one page."""
    out = wrapper_of(root)
    stack, seen = [out], [out[WHOLE]]
    while stack:
        group = stack.pop()
        group[SEEN] = seen
        stack += group[CHILDREN]
    return out


def wrapper_of(node: Node, link: bool = False, depth: int = 0) -> list:
    """The wrapper of one page's group: neighbours of one kind folded into a repeated one."""
    if depth == DEEPEST:
        return _wrapper_at_limit(node, link)
    link = link or node.name == "a"
    out = _group(node.kind, node.noise)
    children, texts = [], []
    for child in node.children:
        if isinstance(child, str):
            text = child.strip()
            if text:
                out[CHARS] += len(text)
                out[LINKS] += len(text) if link else 0
                texts.append(_hash(text))
        else:
            children.append(wrapper_of(child, link, depth + 1))
            texts.append(children[-1][WHOLE])
    texts = [t for t in texts if t]
    out[WHOLE] = out[FIRST] = out[LAST] = _hash(*texts) if texts else 0
    out[CHILDREN] = _folded(children, page=True)
    return out


def _named(kind: str) -> str | None:
    parts = kind.split(".")
    return parts[0] if parts[0] in _CONTENT else "main" if "main" in parts[1:] else None


def _wrapper_at_limit(node: Node, link: bool) -> list:
    """All text below counts as the group's own; the first article and main groups on a way down are its children."""
    out, texts = _group(node.kind, node.noise), []
    groups, stack = [out], [(node, link, out, frozenset([_named(node.kind)]))]
    while stack:
        n, link, group, within = stack.pop()
        name = _named(n.kind)
        if name and name not in within:
            group[CHILDREN].append(_group(n.kind, False))
            group, within = group[CHILDREN][-1], within | {name}
            group[WHOLE] = group[FIRST] = group[LAST] = None
            groups.append(group)
        link = link or n.name == "a"
        for child in n.children:
            if isinstance(child, str) and child.strip():
                group[CHARS] += len(child.strip())
                group[LINKS] += len(child.strip()) if link else 0
                texts.append(_hash(child.strip()))
        stack += [(c, link, group, within) for c in reversed(n.children) if isinstance(c, Node) and not c.noise]
    out[WHOLE] = out[FIRST] = out[LAST] = _hash(*texts) if texts else 0
    for group in reversed(groups):
        group[CHILDREN] = _folded(group[CHILDREN], page=True)
    return out


def plain(kind: str) -> str:
    """The kind with numbers as one sign: post-17 and post-18 are of one plain kind."""
    return _DIGITS.sub("#", kind)


def _folded(children: list[list], page: bool = False) -> list[list]:
    """Neighbours of one kind as one repeated group; beyond WIDEST groups, those of one plain kind, then plain others.

    Groups that are or hold an article or main group always stay apart.
    """
    out = []
    for c in children:
        if out and out[-1][KIND] == c[KIND]:
            out[-1] = _repeated(out[-1], c, page)
        else:
            out.append(c)
    # a repeated group of two kinds, as <dt> <dd> <dt> <dd>
    kept = []
    for c in out:
        kept.append(c)
        if len(kept) >= 4 and kept[-4][KIND] == kept[-2][KIND] and kept[-3][KIND] == kept[-1][KIND]:
            second, first = kept.pop(), kept.pop()
            kept[-2], kept[-1] = _repeated(kept[-2], first, page), _repeated(kept[-1], second, page)
    if len(kept) <= WIDEST:
        return kept
    by_kind: dict[str, list] = {}
    for c in kept:
        kind = c[KIND] if _holds_named(c) else plain(c[KIND])
        if kind not in by_kind and len(by_kind) >= WIDEST and not _holds_named(c):
            kind = "*"
        by_kind[kind] = _repeated(by_kind[kind], c, page) if kind in by_kind else [kind, *c[OPTIONAL:]]
        by_kind[kind][KIND] = kind
    return list(by_kind.values())


def _holds_named(group: list) -> bool:
    return not group[NOISE] and (_named(group[KIND]) is not None or any(map(_holds_named, group[CHILDREN])))


def _repeated(a: list, b: list, page: bool) -> list:
    """Two neighbours as one repeated group of the same pages."""
    out = merged(a, b)
    out[REPEATED], out[PAGES], out[SEEN] = True, max(a[PAGES], b[PAGES]), max(a[SEEN], b[SEEN], key=len)
    out[WHOLE] = _hash(a[WHOLE], b[WHOLE]) if page and None not in (a[WHOLE], b[WHOLE]) else None
    out[FIRST], out[LAST] = a[FIRST], b[LAST]
    return out


def merged(a: list, b: list) -> list:
    """Groups of two sets of pages aligned: children in common order are merged, the others become optional."""
    same = lambda f: a[f] if a[f] == b[f] else None
    seen = a[SEEN] if len(a[SEEN]) >= DISTINCT else sorted({*a[SEEN], *b[SEEN]})[:DISTINCT]
    return [
        a[KIND], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS],
        a[NOISE] or b[NOISE], _aligned(a[CHILDREN], b[CHILDREN]), a[PAGES] + b[PAGES], same(WHOLE), same(FIRST), same(LAST), seen,
    ]


def _optional(group: list) -> list:
    return [group[KIND], True, *group[REPEATED:]]


def _aligned(a: list[list], b: list[list]) -> list[list]:
    if [x[KIND] for x in a] == [x[KIND] for x in b]:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][KIND] == b[j][KIND] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    left, right = [], []

    def mismatch() -> None:
        """What stands between two matches: groups whose kinds differ in numbers alone are one, others are optional."""
        for x in left:
            k = next((k for k, y in enumerate(right) if plain(y[KIND]) == plain(x[KIND]) != x[KIND]), None)
            if k is None:
                out.append(_optional(x))
                continue
            out.extend(map(_optional, right[:k]))
            both = merged(x, right[k])
            both[KIND] = plain(x[KIND])
            out.append(both)
            del right[: k + 1]
        out.extend(map(_optional, right))
        left.clear()
        right.clear()

    while i < n or j < m:
        if i < n and j < m and a[i][KIND] == b[j][KIND]:
            mismatch()
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            left.append(a[i])
            i += 1
        else:
            right.append(b[j])
            j += 1
    mismatch()
    return _folded(out)


def is_template(group: list, pages: int) -> bool:
    """The same text on many different pages of the host."""
    return bool(group[WHOLE]) and len(group[SEEN]) >= DISTINCT and 2 * group[PAGES] >= pages


def is_menu(group: list) -> bool:
    """A block of repeated links and nothing else to speak of."""
    if group[KIND].split(".")[0] in _INLINE:
        return False
    chars, links, repeated, stack = 0, 0, group[REPEATED], [group]
    while stack:
        g = stack.pop()
        chars, links, repeated = chars + g[CHARS], links + g[LINKS], repeated or g[REPEATED]
        stack += g[CHILDREN]
    return repeated and chars > 0 and links >= 0.95 * chars


def as_pattern(wrapper: list) -> str:
    """The wrapper as a regular expression in words: groups, ``?`` optional, ``+`` repeated, ``#`` a text slot."""
    inner = " ".join(([] if not wrapper[CHARS] else ["#"]) + [as_pattern(c) for c in wrapper[CHILDREN]])
    mark = ("+" if wrapper[REPEATED] else "") + ("?" if wrapper[OPTIONAL] else "")
    return f"<{wrapper[KIND]}>({inner}){mark}"


def main_group(wrapper: list) -> tuple[str, ...]:
    """Kinds on the way to the group that holds the article: a group named so with most text, else the one whose own
    paragraphs hold most text outside links.  Text that is template does not count."""
    named, dense, pages = [], [], wrapper[PAGES]
    varies = wrapper[WHOLE] is None

    def skipped(w: list) -> bool:
        return w[NOISE] or (varies and is_template(w, pages))

    def total(w: list) -> int:
        return 0 if skipped(w) else w[CHARS] - w[LINKS] + sum(total(c) for c in w[CHILDREN])

    def visit(w: list, way: tuple[str, ...]) -> None:
        if skipped(w):
            return
        if (name := _named(w[KIND])) and total(w):
            named.append((name == "article", total(w), way))
        own = w[CHARS] - w[LINKS]
        for c in w[CHILDREN]:
            name = c[KIND].split(".")[0]
            if name in _INLINE or name in _HEADINGS or name in ("p", "br", "pre", "blockquote", "ul", "ol", "table"):
                own += total(c)
            visit(c, (*way, c[KIND]))
        dense.append((own, -len(way), way))

    visit(wrapper, ())
    if named:
        return max(named)[2]
    return max(dense)[2] if dense else ()


#: Marks in the tree of what is left out below the article's group.
GONE, GONE_FIRST, GONE_LAST = 1, 2, 4


def reading_of(wrapper: list) -> dict:
    """What a page is read by: the way to the article's group, and the template groups and menus inside it.

    Slots tell template from article only where pages of a host differ at all.  Where a tag or class names the group as
    an article, all of it belongs to it.
    """
    way = main_group(wrapper)
    groups, named = [wrapper], False
    for kind in way:
        groups = [c for g in groups for c in g[CHILDREN] if c[KIND] == kind]
        named = named or _named(kind) is not None or bool(_OF_ARTICLE.intersection(kind.split(".")[1:]))
    if named:
        return {"way": list(way), "gone": {}}
    pages, varies = wrapper[PAGES], wrapper[WHOLE] is None

    def left_out(g: list, inside: bool) -> dict:
        out = {}
        if inside:
            mark = GONE if (varies and is_template(g, pages)) or is_menu(g) else 0
            if not mark and varies and g[REPEATED] and len(g[SEEN]) >= DISTINCT and 2 * g[PAGES] >= pages:
                mark = (GONE_FIRST if g[FIRST] else 0) | (GONE_LAST if g[LAST] else 0)
            if mark:
                out["-"] = mark
            if mark == GONE:
                return out
        for c in g[CHILDREN]:
            if c[KIND].split(".")[0] in _INLINE:
                continue  # part of a sentence
            if below := left_out(c, True):
                out.setdefault(c[KIND], {}).update(below)
        return out

    gone = {}
    for g in groups:
        gone.update(left_out(g, False))
    return {"way": list(way), "gone": gone}


# --- extraction -------------------------------------------------------------------------------------------------


def _is(node, kind: str) -> bool:
    return isinstance(node, Node) and (node.kind == kind or ("#" in kind and plain(node.kind) == kind))


def _groups_at(node: Node, way: tuple[str, ...]) -> list[Node]:
    level = [node]
    for kind in way[:DEEPEST]:
        level = [c for n in level for c in n.children if _is(c, kind)]
    for kind in way[DEEPEST:]:  # below the limit a wrapper names articles and main groups only
        level = [c for n in level for c in _groups_below(n, kind)]
    return level


def _groups_below(node: Node, kind: str) -> list[Node]:
    """The outermost groups of the kind at any depth."""
    stack, found = [node], []
    while stack:
        n = stack.pop()
        if n is not node and _is(n, kind):
            found.append(n)
            continue
        stack += [c for c in reversed(n.children) if isinstance(c, Node) and not c.noise]
    return found


def _own_main(root: Node) -> list[Node]:
    """Where the wrapper's way does not exist in a page: its article or main elements, else the page."""
    stack, found = [root], []
    while stack:
        n = stack.pop()
        if n.name in _CONTENT:
            found.append(n)
            continue
        stack += [c for c in reversed(n.children) if isinstance(c, Node) and not n.noise]
    return found or [root]


def _left_out(node: Node, gone: dict | None) -> tuple[set[int], dict[int, dict]]:
    """Places of the children that the reading leaves out, and what it says below the others."""
    out, below = set(), {}
    if not gone or gone.keys() <= {"-"}:
        return out, below
    before, run = None, []

    def end() -> None:
        mark = below[run[0]].get("-", 0) if run and run[0] in below else 0
        if mark & GONE:
            out.update(run)
        elif len(run) > 1:  # the only one of its kind is not told from the ones that vary
            if mark & GONE_FIRST:
                out.add(run[0])
            if mark & GONE_LAST:
                out.add(run[-1])
        run.clear()

    for k, child in enumerate(node.children):
        if isinstance(child, str):
            continue
        if child.kind != before:
            end()
        before = child.kind
        run.append(k)
        inner = gone.get(child.kind) or gone.get(plain(child.kind))
        if inner:
            below[k] = inner
    end()
    return out, below


def blocks_of(nodes: list[Node], gone: dict | None = None) -> list[str]:
    """Texts of the blocks inside, in page order, with references decoded and white space joined.

    ``gone``: what ``reading_of`` leaves out below these groups.
    """
    out, run = [], []

    def end() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    for top in nodes:
        # (node, position, headings only, left out, below): an explicit stack, as pages may nest deeper than calls
        stack = [(top, 0, False, *_left_out(top, gone))]
        while stack:
            node, at, headings_only, skip, below = stack.pop()
            if at == 0 and node.name not in _INLINE:
                end()
            children = node.children
            while at < len(children):
                child = children[at]
                at += 1
                if isinstance(child, str):
                    if not headings_only or node.name in _HEADINGS:
                        run.append(child)
                elif at - 1 in skip:
                    end()
                elif child.name == "header" and child.kind.split(".")[0] == "header" and not headings_only:
                    stack += [(node, at, headings_only, skip, below), (child, 0, True, *_left_out(child, below.get(at - 1)))]
                    break
                elif not child.noise:
                    only = headings_only and child.name not in _HEADINGS
                    stack += [(node, at, headings_only, skip, below), (child, 0, only, *_left_out(child, below.get(at - 1)))]
                    break
            else:
                if node.name not in _INLINE:
                    end()
    return out


@functools.lru_cache(maxsize=4096)
def _reading(text: str) -> tuple[tuple[str, ...], dict]:
    reading = json.loads(text)
    return tuple(reading["way"]), reading["gone"]


def main_text(page: str | None, reading: str | None) -> str:
    """Blocks of the page's article joined by line feeds; ``reading``: ``reading_of`` its host's wrapper as JSON."""
    root = parse(page)
    way, gone = _reading(reading) if reading else ((), {})
    nodes = _groups_at(root, way) if reading else []
    return "\n".join(blocks_of(nodes, gone) if nodes else blocks_of(_own_main(root)))


# --- Spark ------------------------------------------------------------------------------------------------------

#: Hosts a task folds before it sends its wrappers on, and wrappers aligned in one group.
HELD_HOSTS, GROUP = 2_000, 256


def _folded_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, part, wrapper) of the pages of a task."""
    part, held = TaskContext.get().partitionId(), {}

    def sent() -> pa.RecordBatch:
        rows = sorted(held.items())
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in rows]), pa.array([part] * len(rows), pa.int64()), pa.array([json.dumps(w) for _, w in rows])],
            names=["host", "part", "wrapper"],
        )

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            new = page_wrapper(parse(page.as_py()))
            held[host] = merged(held[host], new) if host in held else new
            if len(held) >= HELD_HOSTS:
                yield sent()
                held.clear()
    if held:
        yield sent()


def _merged_rows(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["part", "wrapper"])
    wrapper = functools.reduce(merged, map(json.loads, rows["wrapper"]))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [int(rows["part"].iloc[0])], "wrapper": [json.dumps(wrapper)]})


def host_wrappers(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(host, wrapper) from all pages.  Groups hold at most GROUP tasks' wrappers of a host."""
    kinds = "host string, part long, wrapper string"
    out = pages.select(host.alias("host"), html.alias("html")).mapInArrow(_folded_pages, kinds)
    for width in (GROUP, GROUP * GROUP):  # two rounds serve 65,536 tasks in groups of GROUP rows, a third the rest
        out = out.withColumn("group", F.floor(F.col("part") / width)).groupBy("host", "group").applyInPandas(_merged_rows, kinds)
    return out.groupBy("host").applyInPandas(_merged_rows, kinds).select("host", "wrapper")


def _readings(wrapper: Column) -> Column:
    @F.pandas_udf("string")
    def look(wrappers: pd.Series) -> pd.Series:
        return wrappers.map(lambda w: json.dumps(reading_of(json.loads(w))))

    return look(wrapper)


def _extract(page: Column, reading: Column) -> Column:
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, readings in batches:
            yield pd.Series([main_text(h, r) for h, r in zip(html, readings, strict=True)])

    return F.pandas_udf(look, "string")(page, reading)


def extract_main_text(
    pages: DataFrame, url_column: str = "url", html_column: str = "html", id_column: str = "page_id"
) -> DataFrame:
    """(id, url, text) of every row; text is empty where nothing is left.

    Null html counts as empty; null and malformed urls share the empty host.  Repeated rows give repeated results and
    an empty table an empty one; other columns are not read.
    """
    url, html = pages[url_column].cast("string"), pages[html_column].cast("string")
    # As a table its size is known when the join is planned: a small one is broadcast and a large host stays spread.
    # A wrapper is read once per host; pages meet what it says, which is a few words.
    wrappers = host_wrappers(pages, host_of(url), html)
    readings = written(wrappers.select("host", _readings(F.col("wrapper")).alias("reading")), "readings")
    base = pages.select(pages[id_column], url.alias(url_column), html.alias("page"), host_of(url).alias("page_host"))
    joined = base.join(readings, base["page_host"] == readings["host"], "left")
    return joined.select(id_column, url_column, _extract(F.col("page"), F.col("reading")).alias("text"))
