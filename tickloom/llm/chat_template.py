"""A small sandboxed template language for conversations, compiled to Python closures.

    text      {{ expression }}      {# comment #}
    {% for message in messages %} ... {% endfor %}      once, at the top level
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% set name = expression %}      inside the loop up to the end of the turn
    {% generation %} ... {% endgeneration %}      marks what a model should learn to write

Expressions have strings, whole numbers, true, false, ``message.role``, ``message.text``, ``message.turn``,
``loop.index``, ``loop.index0``, ``loop.first``, ``loop.last``, ``previous.role`` (null in the first turn), names that
``set`` made, ``~`` (joins), ``==``, ``!=``, ``not``, ``and``, ``or``, brackets and ``| trim | upper | lower | escape |
escape_line``.  There are no calls, subscripts, attributes of objects or other loops, so a template can reach nothing
but these values, and its work is bounded by template and turn.  Whatever is unknown is refused when it is compiled.

A template is parsed to a tree of tuples, constant parts are evaluated once (``if`` on a constant keeps one branch,
neighbouring text becomes one piece), and every node of what remains becomes a closure that appends to a list.  The
loop is split from what stands before and after it, so a conversation of any length is rendered turn by turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


class TemplateError(ValueError):
    """The template is not in the language."""


_FIELDS = {"message": {"role", "text", "turn"}, "loop": {"index", "index0", "first", "last"}, "previous": {"role"}}
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~|().=]))", re.DOTALL)
_ESCAPED = {"n": "\n", "t": "\t"}
_WORDS = {"and", "or", "not", "true", "false", "if", "elif", "else", "endif", "for", "in", "endfor", "set", "generation", "endgeneration"}


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


# --- parsing ---------------------------------------------------------------------------------------------------


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str, filters: dict[str, Callable[[str], str]], names: set[str]):
        self.tokens, at = [], 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:].strip()[:20]!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.at, self.filters, self.names = 0, filters, names

    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return kind in ("op", "name") and value in values

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        found = self.tokens[self.at]
        if (kind and found[0] != kind) or (value and found[1] != value):
            raise TemplateError(f"unexpected {found[1]!r}")
        self.at += 1
        return found[1]

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        left = self.both()
        while self.peek("or"):
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.peek("and"):
            self.take()
            left = ("and", left, self.negated())
        return left

    def negated(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        left = self.joined()
        if self.peek("==", "!="):
            kind = self.take()
            return (kind, left, self.joined())
        return left

    def joined(self):
        left = self.filtered()
        while self.peek("~"):
            self.take()
            left = ("~", left, self.filtered())
        return left

    def filtered(self):
        tree = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take("name")
            if name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        if self.peek("("):
            self.take()
            tree = self.either()
            self.take("op", ")")
            return tree
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else None
        value = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPED.get(m.group(1), m.group(1)), value[1:-1], flags=re.DOTALL))
        if kind == "int":
            return ("const", int(value))
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name" and value in _FIELDS and self.peek("."):
            self.take()
            part = self.take("name")
            if part not in _FIELDS[value]:
                raise TemplateError(f"unknown field {value}.{part}")
            return ("field", f"{value}.{part}")
        if kind == "name" and value in self.names:
            return ("name", value)
        raise TemplateError(f"unknown name {value!r}")


class _Parser:
    def __init__(self, source: str, filters: dict[str, Callable[[str], str]]):
        self.filters, self.names, self.loops = filters, set(), 0
        self.parts, at = [], 0
        for tag in _TAG.finditer(source):
            self.parts.append(("text", source[at : tag.start()]))
            if tag.group(1) is not None:
                self.parts.append(("out", tag.group(1)))
            elif tag.group(2) is not None:
                self.parts.append(("tag", tag.group(2).strip()))
            at = tag.end()
        self.parts.append(("text", source[at:]))
        for kind, value in self.parts:
            if kind == "text" and re.search(r"\{[{%#]", value):
                raise TemplateError("a tag is not closed")
        self.at = 0

    def expression(self, source: str):
        return _Expression(source, self.filters, self.names).whole()

    def block(self, ends: tuple[str, ...], top: bool = False, marked: bool = False) -> tuple[list, str]:
        """Nodes up to one of the tags ``ends``, and that tag."""
        nodes = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(("const", value))
                continue
            if kind == "out":
                nodes.append(("out", self.expression(value)))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return nodes, value
            if word == "if":
                nodes.append(self.branches(rest, marked))
            elif word == "set":
                name, _, source = rest.partition("=")
                name = name.strip()
                if not re.fullmatch(r"[A-Za-z_]\w*", name) or name in _FIELDS or name in _WORDS:
                    raise TemplateError(f"cannot set {name!r}")
                nodes.append(("set", name, self.expression(source)))
                self.names.add(name)
            elif word == "generation" and not marked:
                nodes.append(("mark", self.block(("endgeneration",), marked=True)[0]))
            elif word == "for" and top and not self.loops and rest.split() == ["message", "in", "messages"]:
                self.loops += 1
                nodes.append(("loop", self.block(("endfor",))[0]))
            else:
                raise TemplateError(f"tag {value!r} cannot stand here")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    def branches(self, condition: str, marked: bool):
        out, test = [], self.expression(condition)
        while True:
            nodes, tag = self.block(("elif", "else", "endif"), marked=marked)
            out.append((test, nodes))
            word, _, rest = tag.partition(" ")
            if word == "endif":
                return ("if", out)
            if test is True:
                raise TemplateError(f"{word} after else")
            test = True if word == "else" else self.expression(rest)


def parse(source: str, filters: dict[str, Callable[[str], str]]) -> list:
    """The tree of a template."""
    return _Parser(source, filters).block((), top=True)[0]


# --- folding ---------------------------------------------------------------------------------------------------


def _apply(kind: str, a, b):
    return {"==": lambda: a == b, "!=": lambda: a != b, "~": lambda: _text(a) + _text(b)}[kind]()


def fold_expression(tree, filters):
    kind = tree[0]
    if kind in ("==", "!=", "~"):
        a, b = fold_expression(tree[1], filters), fold_expression(tree[2], filters)
        return ("const", _apply(kind, a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind in ("and", "or"):
        a, b = fold_expression(tree[1], filters), fold_expression(tree[2], filters)
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "not":
        a = fold_expression(tree[1], filters)
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold_expression(tree[2], filters)
        return ("const", filters[tree[1]](_text(a[1]))) if a[0] == "const" else ("filter", tree[1], a)
    return tree


def fold(nodes: list, filters) -> list:
    """The same template with constant parts evaluated."""
    out = []

    def add(node):
        if node[0] == "const":
            if not node[1]:
                return
            if out and out[-1][0] == "const":
                out[-1] = ("const", out[-1][1] + node[1])
                return
        out.append(node)

    for node in nodes:
        if node[0] == "out":
            tree = fold_expression(node[1], filters)
            add(("const", _text(tree[1])) if tree[0] == "const" else ("out", tree))
        elif node[0] == "set":
            add(("set", node[1], fold_expression(node[2], filters)))
        elif node[0] in ("mark", "loop"):
            inner = fold(node[1], filters)
            if inner or node[0] == "loop":
                add((node[0], inner))
        elif node[0] == "if":
            kept = []
            for test, inner in node[1]:
                test = ("const", True) if test is True else fold_expression(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                kept.append((test, fold(inner, filters)))
                if test[0] == "const":
                    break
            if kept and kept[0][0][0] == "const":
                for inner in kept[0][1]:
                    add(inner)
            elif kept:
                add(("if", kept))
        else:
            add(node)
    return out


# --- closures --------------------------------------------------------------------------------------------------


@dataclass
class Page:
    """Where closures write: pieces of text, code points so far, and the spans under generation marks."""

    pieces: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _value(tree, filters) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda scope, v=tree[1]: v
    if kind in ("field", "name"):
        return lambda scope, n=tree[1]: scope.get(n)
    if kind == "filter":
        inner, change = _value(tree[2], filters), filters[tree[1]]
        return lambda scope: change(_text(inner(scope)))
    if kind == "not":
        inner = _value(tree[1], filters)
        return lambda scope: not inner(scope)
    a, b = _value(tree[1], filters), _value(tree[2], filters)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "~":
        return lambda scope: _text(a(scope)) + _text(b(scope))
    if kind == "==":
        return lambda scope: a(scope) == b(scope)
    return lambda scope: a(scope) != b(scope)


def _writer(nodes: list, filters) -> Callable[[dict, Page], None]:
    steps = [_step(n, filters) for n in nodes]

    def run(scope: dict, page: Page) -> None:
        for step in steps:
            step(scope, page)

    return steps[0] if len(steps) == 1 else run


def _step(node, filters) -> Callable[[dict, Page], None]:
    kind = node[0]
    if kind == "const":
        return lambda scope, page, text=node[1]: page.write(text)
    if kind == "out":
        inner = _value(node[1], filters)
        return lambda scope, page: page.write(_text(inner(scope)))
    if kind == "set":
        name, inner = node[1], _value(node[2], filters)
        return lambda scope, page: scope.__setitem__(name, inner(scope))
    if kind == "mark":
        inner = _writer(node[1], filters)

        def mark(scope: dict, page: Page) -> None:
            start = page.size
            inner(scope, page)
            page.spans.append((start, page.size))

        return mark
    tests = [(_value(t, filters), _writer(inner, filters)) for t, inner in node[1]]

    def choose(scope: dict, page: Page) -> None:
        for test, inner in tests:
            if test(scope):
                inner(scope, page)
                return

    return choose


@dataclass(frozen=True)
class Compiled:
    """Closures for what stands before the loop, for one turn, and for what stands after it."""

    head: Callable[[dict, Page], None]
    turn: Callable[[dict, Page], None]
    tail: Callable[[dict, Page], None]


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Compiled:
    """Parse, fold and compile.  A template without a loop renders the same for every conversation."""
    filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower, **filters}
    nodes = fold(parse(source, filters), filters)
    at = next((i for i, n in enumerate(nodes) if n[0] == "loop"), len(nodes))
    body = nodes[at][1] if at < len(nodes) else []
    for outside in (nodes[:at], nodes[at + 1 :]):
        if "field" in _kinds(outside):
            raise TemplateError("message, loop and previous stand in the loop only")
    return Compiled(_writer(nodes[:at], filters), _writer(body, filters), _writer(nodes[at + 1 :], filters))


def _kinds(tree) -> set[str]:
    """Kinds of all nodes of a tree."""
    found, rest = set(), [tree]
    while rest:
        node = rest.pop()
        if isinstance(node, (list, tuple)):
            if isinstance(node, tuple) and node and isinstance(node[0], str):
                found.add(node[0])
                if node[0] in ("const", "name", "field"):
                    continue
            rest.extend(x for x in node if isinstance(x, (list, tuple)))
    return found
