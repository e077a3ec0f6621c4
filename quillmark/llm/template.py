"""A small sandboxed template language, compiled to Python closures.

Texts stand as they are. `{{ expression }}` writes a value, `{% set x = e %}` names one, `{% if e %} {% elif e %} {% else %}
{% endif %}` and `{% for x in e %} {% endfor %}` do what they say, and `{% generation %} {% endgeneration %}` marks what a
model is trained on. A dash inside a brace (`{%-`, `-%}`) takes away the white space on that side.
Expressions: 'strings', whole numbers, true, false, none, names, x.key, x['key'], ==, !=, and, or, not, + and ~ (joining as
text), brackets, and filters: value | name. Keys look into dictionaries only, and nothing can be called, so a template
reaches no Python object but what it is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

Chunk = tuple[str, bool]
TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", re.S)
LEXEME = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.~+()\[\]]))")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template is not of this language, or looks for something that isn't there."""


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: as_text(v).strip(),
    "upper": lambda v: as_text(v).upper(),
    "lower": lambda v: as_text(v).lower(),
    "length": lambda v: len(v or ""),
    "string": as_text,
}


class Parser:
    """Source to a tree of tuples: (kind, parts...)."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.pieces = filters, []
        strip = False
        parts = TAG.split(source)
        for n, part in enumerate(parts):
            if n % 2 == 0:
                part = part.lstrip() if strip else part
                if n + 1 < len(parts) and parts[n + 1][2] == "-":
                    part = part.rstrip()
                if part:
                    self.pieces.append(("text", part))
                continue
            strip = part[-3] == "-"
            self.pieces.append(("write" if part[1] == "{" else "tag", part[2:-2].strip("-").strip()))
        self.at = 0

    def block(self, *until: str) -> tuple[list, str]:
        out = []
        while self.at < len(self.pieces):
            kind, body = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                out.append(("text", body))
            elif kind == "write":
                out.append(("write", self.expression(body)))
            else:
                word, _, rest = body.partition(" ")
                if word in until:
                    return out, body
                out.append(self.statement(word, rest.strip()))
        if until:
            raise TemplateError(f"no {' or '.join(until)}")
        return out, ""

    def statement(self, word: str, rest: str):
        if word == "if":
            return self.condition(rest)
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            return ("for", m[1], self.expression(m[2]), self.block("endfor")[0])
        if word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)):
            return ("set", m[1], self.expression(m[2]))
        if word == "generation":
            return ("generation", self.block("endgeneration")[0])
        raise TemplateError(f"unknown tag: {word} {rest}")

    def condition(self, test: str):
        then, end = self.block("elif", "else", "endif")
        other = []
        if end.startswith("elif"):
            other = [self.condition(end[4:])]
        elif end == "else":
            other = self.block("endif")[0]
        return ("if", self.expression(test), then, other)

    def expression(self, source: str):
        self.lexemes, at = [], 0
        source = source.strip()
        while at < len(source):
            m = LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            at = m.end()
            quoted, number, name, sign = m.groups()
            if quoted is not None:
                self.lexemes.append(("value", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), quoted[1:-1], flags=re.S)))
            elif number is not None:
                self.lexemes.append(("value", int(number)))
            else:
                self.lexemes.append(("name", name) if name else ("sign", sign))
        tree = self.either()
        if self.lexemes:
            raise TemplateError(f"too much in {source!r}")
        return tree

    def took(self, *wanted) -> bool:
        if self.lexemes and self.lexemes[0] in wanted:
            self.took_last = self.lexemes.pop(0)
            return True
        return False

    def either(self):
        left = self.both()
        while self.took(("name", "or")):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.took(("name", "and")):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        if self.took(("name", "not")):
            return ("not", self.negated())
        left = self.joined()
        while self.took(("sign", "=="), ("sign", "!=")):
            left = (self.took_last[1], left, self.joined())
        return left

    def joined(self):
        left = self.filtered()
        while self.took(("sign", "~"), ("sign", "+")):
            left = ("join", left, self.filtered())
        return left

    def filtered(self):
        value = self.primary()
        while True:
            if self.took(("sign", "|")):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name}")
                value = ("filter", name, value)
            elif self.took(("sign", ".")):
                value = ("key", value, ("value", self.name()))
            elif self.took(("sign", "[")):
                value = ("key", value, self.either())
                self.need("]")
            else:
                return value

    def primary(self):
        if not self.lexemes:
            raise TemplateError("an expression ends too early")
        kind, x = self.lexemes.pop(0)
        if kind == "value":
            return ("value", x)
        if kind == "name":
            return ("value", CONSTANTS[x]) if x in CONSTANTS else ("name", x)
        if x == "(":
            inner = self.either()
            self.need(")")
            return inner
        raise TemplateError(f"unexpected {x}")

    def name(self) -> str:
        if not self.lexemes or self.lexemes[0][0] != "name":
            raise TemplateError("a name is missing")
        return self.lexemes.pop(0)[1]

    def need(self, sign: str) -> None:
        if not self.took(("sign", sign)):
            raise TemplateError(f"{sign} is missing")


def folded(tree, filters):
    """An expression with everything constant worked out."""
    if tree[0] in ("value", "name"):
        return tree
    parts = [tree[0], *(folded(t, filters) if isinstance(t, tuple) else t for t in tree[1:])]
    if all(t[0] == "value" for t in parts[1:] if isinstance(t, tuple)):
        return ("value", evaluator(tuple(parts), filters)({}))
    return tuple(parts)


def fold(block: list, filters) -> list:
    """A block with constants worked out, settled conditions gone and neighbouring texts made one."""
    out: list = []
    for node in block:
        if node[0] == "write":
            value = folded(node[1], filters)
            node = ("text", as_text(value[1])) if value[0] == "value" else ("write", value)
        elif node[0] == "set":
            node = ("set", node[1], folded(node[2], filters))
        elif node[0] == "for":
            node = ("for", node[1], folded(node[2], filters), fold(node[3], filters))
        elif node[0] == "generation":
            node = ("generation", fold(node[1], filters))
        elif node[0] == "if":
            test, then, other = folded(node[1], filters), fold(node[2], filters), fold(node[3], filters)
            if test[0] == "value":
                for inner in then if test[1] else other:
                    add(out, inner)
                continue
            node = ("if", test, then, other)
        add(out, node)
    return out


def add(block: list, node) -> None:
    if node == ("text", ""):
        return
    if node[0] == "text" and block and block[-1][0] == "text":
        block[-1] = ("text", block[-1][1] + node[1])
    else:
        block.append(node)


def evaluator(tree, filters) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "value":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, name=tree[1]: env.get(name)
    if kind == "filter":
        f, inner = filters[tree[1]], evaluator(tree[2], filters)
        return lambda env: f(inner(env))
    if kind == "not":
        inner = evaluator(tree[1], filters)
        return lambda env: not inner(env)
    a, b = evaluator(tree[1], filters), evaluator(tree[2], filters)
    if kind == "key":
        return lambda env: held.get(b(env)) if isinstance(held := a(env), dict) else None
    if kind == "join":
        return lambda env: as_text(a(env)) + as_text(b(env))
    if kind == "==":
        return lambda env: a(env) == b(env)
    if kind == "!=":
        return lambda env: a(env) != b(env)
    return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))


def writer(block: list, filters, trained: bool) -> Callable[[dict], Iterator[Chunk]]:
    """The closure of a block: environment to chunks of text, each with whether a model is trained on it."""
    steps = [step(node, filters, trained) for node in block]
    if len(steps) == 1:
        return steps[0]

    def run(env):
        for s in steps:
            yield from s(env)

    return run


def step(node, filters, trained: bool) -> Callable[[dict], Iterable[Chunk]]:
    kind = node[0]
    if kind == "text":
        return lambda env, out=((node[1], trained),): out
    if kind == "write":
        value = evaluator(node[1], filters)
        return lambda env: ((as_text(value(env)), trained),)
    if kind == "set":
        value = evaluator(node[2], filters)
        return lambda env: env.__setitem__(node[1], value(env)) or ()
    if kind == "generation":
        return writer(node[1], filters, True)
    if kind == "if":
        test, then, other = evaluator(node[1], filters), writer(node[2], filters, trained), writer(node[3], filters, trained)
        return lambda env: (then if test(env) else other)(env)
    value, body = evaluator(node[2], filters), writer(node[3], filters, trained)

    def each(env):
        outer = {k: env[k] for k in (node[1], "loop") if k in env}
        items = iter(value(env) or ())
        nothing = object()
        item, n = next(items, nothing), 0
        while item is not nothing:  # one item ahead, so that an endless conversation is never held whole
            following = next(items, nothing)
            env[node[1]], env["loop"] = item, {"index": n + 1, "index0": n, "first": n == 0, "last": following is nothing}
            yield from body(env)
            item, n = following, n + 1
        env.pop(node[1], None)
        env.pop("loop", None)
        env.update(outer)

    return each


def compiled(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], Iterator[Chunk]]:
    """A function that renders an environment as chunks (text, trained), bit by bit."""
    known = FILTERS | (filters or {})
    parser = Parser(source, known)
    tree, _ = parser.block()
    return writer(fold(tree, known), known, False)
