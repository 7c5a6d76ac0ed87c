"""The rule representation that all front-ends produce.

A rule is a boolean tree over leaves; each leaf compares one field with literals.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

_PLAIN_NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


class RuleError(ValueError):
    """A rule that can't be parsed, compiled or found."""


def plain_number(x: float) -> str:
    """Shortest decimal text of a number, never in scientific notation; integral numbers have no point."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    text = format(Decimal(repr(x)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


@dataclass(frozen=True)
class Value:
    """A literal as it was written: `text`, and whether it is a string or a number."""

    text: str
    is_string: bool = False

    @staticmethod
    def of(x: object) -> Value:
        """The literal of a Python (or decoded JSON) scalar; booleans are the strings true and false."""
        if isinstance(x, bool):
            return Value("true" if x else "false", True)
        if isinstance(x, str):
            return Value(x, True)
        if isinstance(x, (int, float)):
            return Value(plain_number(float(x)))
        raise RuleError(f"unsupported literal of type {type(x).__name__}")

    @property
    def number(self) -> float:
        if self.is_string or not _PLAIN_NUMBER.fullmatch(self.text):
            raise RuleError(f"not a number: {self.text!r}")
        return float(self.text)

    @property
    def as_text(self) -> str:
        """What a text comparison sees."""
        return self.text if self.is_string else plain_number(self.number)


@dataclass(frozen=True)
class Logic:
    op: str  # AND or OR
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Not:
    arg: Node


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Value


@dataclass(frozen=True)
class Between:
    field: str
    low: Value
    high: Value


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[Value, ...]
    negate: bool = False


@dataclass(frozen=True)
class Like:
    field: str
    pattern: str
    negate: bool = False

    @property
    def kind(self) -> str:
        return {(True, True): "contains", (False, True): "prefix", (True, False): "suffix"}.get((self.pattern.startswith("%"), self.pattern.endswith("%")), "equals")

    @property
    def core(self) -> str:
        return self.pattern.strip("%")


@dataclass(frozen=True)
class IsNull:
    field: str
    negate: bool = False


Node = Logic | Not | Compare | Between | In | Like | IsNull
COMPARISONS = ("=", "==", "!=", ">", ">=", "<", "<=")


def leaves(node: Node) -> Iterator[Node]:
    match node:
        case Logic(_, args):
            for a in args:
                yield from leaves(a)
        case Not(arg):
            yield from leaves(arg)
        case _:
            yield node


def fields(*nodes: Node) -> list[str]:
    """The fields that rules read, in order of appearance."""
    return list(dict.fromkeys(leaf.field for n in nodes for leaf in leaves(n)))


def optimize(node: Node) -> Node:
    """Joins nested AND in AND and OR in OR, drops repeated operands and unwraps single ones; NOT stays where it is."""
    match node:
        case Not(arg):
            return Not(optimize(arg))
        case Logic(op, args):
            flat: list[Node] = []
            for a in map(optimize, args):
                flat += a.args if isinstance(a, Logic) and a.op == op else (a,)
            unique = tuple(dict.fromkeys(flat))
            return unique[0] if len(unique) == 1 else Logic(op, unique)
    return node


def check(node: Node) -> Node:
    """The node, if its literals fit its operators; else RuleError. Ranges are numeric, numbers well formed."""
    for leaf in leaves(node):
        match leaf:
            case Compare(_, op, value):
                if op not in COMPARISONS:
                    raise RuleError(f"unknown operator {op!r}")
                if not value.is_string:
                    value.number  # noqa: B018
            case Between(_, low, high):
                low.number, high.number  # noqa: B018
    return node


def positive(leaf: Node) -> tuple[Node, bool]:
    """(leaf without its own negation, whether it had one); `IS NOT NULL` is the negation of `IS NULL`."""
    if isinstance(leaf, (In, Like, IsNull)) and leaf.negate:
        return replace(leaf, negate=False), True
    return leaf, False
