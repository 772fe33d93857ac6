"""Chat formatting: a small sandboxed template language, compiled to Python closures.

A template is text with ``{{ value }}`` and ``{% tag %}``.  Tags: ``for x in messages`` .. ``endfor`` (one, not
nested), ``if cond`` .. ``elif`` .. ``else`` .. ``endif``, ``generation`` .. ``endgeneration``.  Values: strings,
numbers, ``x.role``, ``x.text``, ``loop.first``, ``loop.index``, ``==``, ``!=``, ``and``, ``or``, ``not``, ``+``,
parentheses, and filters ``|escape``, ``|trim``, ``|upper``, ``|lower``.  Nothing else can be reached: no calls, no
attributes of Python objects, no loops over anything but the messages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

# Strings that steer a model and so must not come from a text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

#: A user turn stands in [INST], an assistant turn is bare and generated, other turns name their role.
TEMPLATE = (
    "{% for m in messages %}<s>"
    "{% if m.role == 'user' %}[INST] {{ m.text|escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}[ROLE] {{ m.role|escape }} [/ROLE]{{ m.text|escape }}{% endif %}"
    "</s>{{ '\\n' }}{% endfor %}"
)


def escape(text: str) -> str:
    """Doubles backslashes and puts one inside every control string; ``unescape`` undoes it."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
}

_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.()+]))")


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    """``message.role``, ``message.text``, ``loop.first`` or ``loop.index``."""

    owner: str
    name: str


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, nodes)


@dataclass(frozen=True)
class For:
    var: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def _lex(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        kind = ("string", "number", "name", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    def __init__(self, source: str, var: str | None):
        self.tokens, self.i, self.var = _lex(source), 0, var

    def take(self, value: str) -> bool:
        if self.i < len(self.tokens) and self.tokens[self.i][1] == value and self.tokens[self.i][0] != "string":
            self.i += 1
            return True
        return False

    def whole(self):
        tree = self.either()
        if self.i != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.i][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = Apply("or", (tree, self.both()))
        return tree

    def both(self):
        tree = self.negation()
        while self.take("and"):
            tree = Apply("and", (tree, self.negation()))
        return tree

    def negation(self):
        return Apply("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        tree = self.total()
        for sign in ("==", "!="):
            if self.take(sign):
                return Apply(sign, (tree, self.total()))
        return tree

    def total(self):
        tree = self.filtered()
        while self.take("+"):
            tree = Apply("+", (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.primary()
        while self.take("|"):
            kind, name = self.next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = Apply("|" + name, (tree,))
        return tree

    def next(self):
        if self.i >= len(self.tokens):
            raise TemplateError("the expression ends too early")
        self.i += 1
        return self.tokens[self.i - 1]

    def primary(self):
        kind, text = self.next()
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "number":
            return Const(int(text))
        if text == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        allowed = {self.var: ("role", "text"), "loop": ("first", "index")} if self.var else {}
        if kind == "name" and text in allowed and self.take("."):
            name = self.next()[1]
            if name in allowed[text]:
                return Field("loop" if text == "loop" else "message", name)
            raise TemplateError(f"{text} has no {name!r}")
        raise TemplateError(f"unknown name {text!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _PIECE.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        pieces.append(("value", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))

    position = 0

    def block(ends: tuple[str, ...], var: str | None, depth: int) -> tuple[tuple, str]:
        nonlocal position
        nodes = []
        while position < len(pieces):
            kind, body = pieces[position]
            position += 1
            word, _, rest = body.partition(" ") if kind == "tag" else ("", "", "")
            if kind == "text":
                nodes.append(Emit(Const(body)))
            elif kind == "value":
                nodes.append(Emit(_Expression(body, var).whole()))
            elif word in ends:
                return tuple(nodes), body
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                if not m or var or m[1] == "loop":
                    raise TemplateError("only one loop, over messages, is possible")
                inner, _ = block(("endfor",), m[1], depth + 1)
                nodes.append(For(m[1], inner))
            elif word == "if":
                branches, condition = [], _Expression(rest, var).whole()
                while True:
                    inner, end = block(("elif", "else", "endif"), var, depth + 1)
                    branches.append((condition, inner))
                    if end.startswith("elif"):
                        condition = _Expression(end[4:], var).whole()
                    elif end == "else":
                        inner, _ = block(("endif",), var, depth + 1)
                        branches.append((Const(True), inner))
                        break
                    else:
                        break
                nodes.append(If(tuple(branches)))
            elif word == "generation":
                inner, _ = block(("endgeneration",), var, depth + 1)
                nodes.append(Generation(inner))
            else:
                raise TemplateError(f"unknown tag {body!r}")
        if depth:
            raise TemplateError(f"missing {ends[0]}")
        return tuple(nodes), ""

    return block((), None, 0)[0]


def _value(op: str, args: list):
    if op == "or":
        return args[0] or args[1]
    if op == "and":
        return args[0] and args[1]
    if op == "not":
        return not args[0]
    if op == "==":
        return args[0] == args[1]
    if op == "!=":
        return args[0] != args[1]
    if op == "+":
        both_text = all(isinstance(a, str) for a in args)
        return args[0] + args[1] if both_text or not any(isinstance(a, str) for a in args) else f"{args[0]}{args[1]}"
    return FILTERS[op[1:]](str(args[0]))


def fold(tree):
    """The tree with constant parts computed, dead branches gone and neighbouring texts joined."""
    if isinstance(tree, Apply):
        args = tuple(fold(a) for a in tree.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_value(tree.op, [a.value for a in args]))
        if tree.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (tree.op == "and") else args[0]
        return Apply(tree.op, args)
    if not isinstance(tree, tuple):
        return tree
    nodes: list = []

    def add(node):
        if isinstance(node, Emit) and isinstance(node.value, Const):
            text = str(node.value.value)
            if not text:
                return
            if nodes and isinstance(nodes[-1], Emit) and isinstance(nodes[-1].value, Const):
                nodes[-1] = Emit(Const(nodes[-1].value.value + text))
                return
            node = Emit(Const(text))
        nodes.append(node)

    for node in tree:
        if isinstance(node, Emit):
            add(Emit(fold(node.value)))
        elif isinstance(node, For):
            nodes.append(For(node.var, fold(node.body)))
        elif isinstance(node, Generation):
            nodes.append(Generation(fold(node.body)))
        else:
            branches = []
            for condition, body in node.branches:
                condition, body = fold(condition), fold(body)
                if isinstance(condition, Const) and not condition.value:
                    continue
                branches.append((condition, body))
                if isinstance(condition, Const):
                    break
            if branches and isinstance(branches[0][0], Const):
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                nodes.append(If(tuple(branches)))
    return tuple(nodes)


@dataclass
class _Scope:
    role: str = ""
    text: str = ""
    first: bool = True
    index: int = 0


Piece = tuple[str, bool]  # a text and whether the model generates it


def _evaluator(tree) -> Callable[[_Scope], object]:
    if isinstance(tree, Const):
        value = tree.value
        return lambda scope: value
    if isinstance(tree, Field):
        name = tree.name
        return lambda scope: getattr(scope, name)
    parts = [_evaluator(a) for a in tree.args]
    op = tree.op
    if op == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if op == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    if op.startswith("|"):
        use, only = FILTERS[op[1:]], parts[0]
        return lambda scope: use(str(only(scope)))
    return lambda scope: _value(op, [p(scope) for p in parts])


def _writer(nodes: tuple, generated: bool) -> Callable[[_Scope, Iterable], Iterator[Piece]]:
    """A closure that yields the pieces of the nodes; only a loop draws messages from the iterable."""
    steps = []
    for node in nodes:
        if isinstance(node, Emit):
            steps.append(_emit(_evaluator(node.value), generated))
        elif isinstance(node, Generation):
            steps.append(_writer(node.body, True))
        elif isinstance(node, If):
            steps.append(_choose([(_evaluator(c), _writer(b, generated)) for c, b in node.branches]))
        else:
            steps.append(_repeat(_writer(node.body, generated)))

    def write(scope, messages):
        for step in steps:
            yield from step(scope, messages)

    return write


def _emit(value, generated):
    def step(scope, messages):
        yield str(value(scope)), generated

    return step


def _choose(branches):
    def step(scope, messages):
        for condition, write in branches:
            if condition(scope):
                yield from write(scope, messages)
                return

    return step


def _repeat(write):
    def step(scope, messages):
        for index, (role, text) in enumerate(messages):
            yield from write(_Scope(role, text, index == 0, index + 1), ())

    return step


def compile_template(source: str = TEMPLATE) -> Callable[[Iterable[tuple[str, str]]], Iterator[Piece]]:
    """A renderer: messages as (role, text) go in one by one, pieces come out as they are made."""
    write = _writer(fold(parse(source)), False)
    return lambda messages: write(_Scope(), messages)


_TURN = re.compile(r"<s>(?:\[INST\] (.*?) \[/INST\]|\[ROLE\] (.*?) \[/ROLE\](.*?)|(.*?))</s>\n", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of text made by ``TEMPLATE``; raises if anything else stands there."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m[1] is not None:
            turns.append(("user", unescape(m[1])))
        elif m[2] is not None:
            turns.append((unescape(m[2]), unescape(m[3])))
        else:
            turns.append(("assistant", unescape(m[4])))
        at = m.end()
    return turns
