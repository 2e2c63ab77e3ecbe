"""The factor expressions: ``add(ts_sma_8(c), 0.5)`` as a tree, its text and its drawing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.registry import lookup


@dataclass(frozen=True)
class Feature:
    name: str


@dataclass(frozen=True)
class Const:
    value: float


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple["Node", ...]


Node = Feature | Const | Call

_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([(),]))")


class ExpressionError(ValueError):
    """An expression that can't be read or evaluated."""


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at, text = 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"can't read {text!r} from character {at}")
        at = m.end()
        yield ("name", m[1]) if m[1] else ("number", m[2]) if m[2] else (m[3], m[3])
    yield "end", ""


def parse(text: str) -> Node:
    """Reads an expression; names of operators, their arity and brackets are checked."""
    tokens = list(_tokens(text))
    at = 0

    def take(kind: str) -> str:
        nonlocal at
        if tokens[at][0] != kind:
            raise ExpressionError(f"expected {kind} but found {tokens[at][1] or 'the end'!r} in {text!r}")
        at += 1
        return tokens[at - 1][1]

    def node() -> Node:
        if tokens[at][0] == "number":
            return Const(float(take("number")))
        name = take("name")
        if tokens[at][0] != "(":
            return Feature(name)
        take("(")
        args = [node()]
        while tokens[at][0] == ",":
            take(",")
            args.append(node())
        take(")")
        try:
            arity = lookup(name).arity
        except KeyError as missing:
            raise ExpressionError(str(missing.args[0])) from missing
        if arity != len(args):
            raise ExpressionError(f"{name} takes {arity} arguments, not {len(args)}")
        return Call(name, tuple(args))

    tree = node()
    take("end")
    return tree


def to_text(node: Node) -> str:
    """The text that ``parse`` reads back into the same tree; constants in full precision."""
    match node:
        case Feature(name):
            return name
        case Const(value):
            return repr(float(value))
        case Call(name, args):
            return f"{name}({', '.join(map(to_text, args))})"


def walk(node: Node) -> Iterator[Node]:
    """All nodes, each before its arguments."""
    yield node
    if isinstance(node, Call):
        for a in node.args:
            yield from walk(a)


def length(node: Node) -> int:
    return sum(1 for _ in walk(node))


def depth(node: Node) -> int:
    return 1 + max(map(depth, node.args)) if isinstance(node, Call) else 0


def features_of(node: Node) -> set[str]:
    return {x.name for x in walk(node) if isinstance(x, Feature)}


def to_dot(node: Node, faded: set[int] = frozenset()) -> str:
    """Graphviz text; the nodes whose places (in the order of ``walk``) are in ``faded`` are drawn grey."""
    lines, at = ["digraph factor {", "node [style=filled]"], 0

    def draw(x: Node) -> int:
        nonlocal at
        me, at = at, at + 1
        label = x.name if isinstance(x, (Call, Feature)) else f"{x.value:.3f}"
        colour = "#cecece" if me in faded else "#136ed4" if isinstance(x, Call) else "#60a6f6"
        lines.append(f'{me} [label="{label}", fillcolor="{colour}"];')
        if isinstance(x, Call):
            for a in x.args:
                lines.append(f"{me} -> {draw(a)};")
        return me

    draw(node)
    return "\n".join([*lines, "}"])
