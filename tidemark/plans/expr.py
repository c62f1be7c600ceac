"""The metric expression language: text -> immutable syntax tree.

Numbers, names, positional calls, + - * / **, unary signs, one comparison, parentheses and # comments.
** binds tighter than a sign on its left and is right-associative.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MAX_SOURCE, MAX_DEPTH, MAX_NODES = 1 << 20, 128, 65_536


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Call:
    function: str
    args: tuple[Node, ...]


Node = Number | Name | Call

_TOKEN = re.compile(r"\s+|#[^\n]*|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|<=|>=|==|!=|[-+*/()<>,])")
_COMPARE = {"==": "equal", "!=": "not_equal", "<": "less_than", "<=": "less_equal", ">": "greater_than", ">=": "greater_equal"}
_RESERVED = {"True", "False", "None", "and", "or", "not", "if", "else", "lambda"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected {source[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, source: str) -> None:
        if len(source) > MAX_SOURCE:
            raise ExpressionError("the source is too long")
        self.tokens, self.at, self.depth, self.count = _tokens(source), 0, 0, 0

    def peek(self) -> str:
        return self.tokens[self.at][1]

    def take(self, *wanted: str) -> str | None:
        kind, text = self.tokens[self.at]
        if kind == "op" and text in wanted:
            self.at += 1
            return text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ExpressionError(f"expected {text!r}, found {self.peek()!r}")

    def made(self, node: Node) -> Node:
        self.count += 1
        if self.count > MAX_NODES:
            raise ExpressionError("too many nodes")
        return node

    def expression(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ExpressionError("nested too deeply")
        left = self.sum()
        if op := self.take(*_COMPARE):
            left = self.made(Call(_COMPARE[op], (left, self.sum())))
            if self.peek() in _COMPARE:
                raise ExpressionError("comparisons can't be chained")
        self.depth -= 1
        return left

    def sum(self) -> Node:
        left = self.term()
        while op := self.take("+", "-"):
            left = self.made(Call("add" if op == "+" else "subtract", (left, self.term())))
        return left

    def term(self) -> Node:
        left = self.sign()
        while op := self.take("*", "/"):
            left = self.made(Call("multiply" if op == "*" else "divide", (left, self.sign())))
        return left

    def sign(self) -> Node:
        negative = False
        while op := self.take("+", "-"):
            negative ^= op == "-"
        node = self.power()
        if negative:
            return self.made(Number(-node.value) if isinstance(node, Number) else Call("negate", (node,)))
        return node

    def power(self) -> Node:
        base = self.atom()
        if self.take("**"):
            return self.made(Call("power", (base, self.sign())))
        return base

    def atom(self) -> Node:
        kind, text = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return self.made(Number(float(text)))
        if kind == "name":
            if text in _RESERVED:
                raise ExpressionError(f"{text} isn't part of the language")
            self.at += 1
            if not self.take("("):
                return self.made(Name(text))
            args: list[Node] = []
            if not self.take(")"):
                args.append(self.expression())
                while self.take(","):
                    args.append(self.expression())
                self.need(")")
            return self.made(Call(text, tuple(args)))
        self.need("(")
        node = self.expression()
        self.need(")")
        return node


def parse(source: str) -> Node:
    p = _Parser(source)
    node = p.expression()
    if p.tokens[p.at][0] != "end":
        raise ExpressionError(f"unexpected {p.peek()!r}")
    return node


def names(node: Node) -> set[str]:
    """The free names of a tree."""
    if isinstance(node, Name):
        return {node.name}
    return set().union(*map(names, node.args)) if isinstance(node, Call) else set()
