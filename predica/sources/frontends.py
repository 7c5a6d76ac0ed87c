"""Front-ends: SQL-like text, JSON, CEL and Expr to the rule representation, and their registry."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Protocol

from ..plans.ir import Between, Compare, In, IsNull, Like, Logic, Node, Not, RuleError, Value, plain_number


class Frontend(Protocol):
    """What a registered front-end is: rule text to rule."""

    def __call__(self, text: str) -> Node: ...


_ESCAPED = re.compile(r"\\(.)", re.S)


class _Tokens:
    """Tokens of a text by a pattern with named groups; `skip` is left out, nothing else may be between them."""

    def __init__(self, text: str, pattern: re.Pattern[str]):
        self.list: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if not m or m.end() == at:
                raise RuleError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup != "skip":
                self.list.append((m.lastgroup or "", m[0]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.list[self.at + ahead] if self.at + ahead < len(self.list) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def accept(self, *texts: str) -> str | None:
        kind, text = self.peek()
        if kind in ("op", "word") and text in texts:
            self.at += 1
            return text
        return None

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise RuleError(f"expected {text!r}, got {self.peek()[1]!r}")

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise RuleError(f"unexpected {self.peek()[1]!r} after the rule")


def _joined(op: str, first: Node, more: Callable[[], Node | None]) -> Node:
    args = [first]
    while (n := more()) is not None:
        args.append(n)
    return args[0] if len(args) == 1 else Logic(op, tuple(args))


# --- SQL-like text -----------------------------------------------------------

_SQL = re.compile(r"""(?P<skip>\s+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d[\d.]*)|(?P<word>[^\W\d]\w*)|(?P<op>==|!=|<>|>=|<=|[=><(),])""", re.S)
_KEYWORDS = {"AND", "OR", "NOT", "BETWEEN", "IN", "LIKE", "IS", "NULL"}
_SIGNED = re.compile(_SQL.pattern.replace(r"\d[\d.]*", r"[+-]?\d[\d.]*"), re.S)


class _Sql:
    def __init__(self, text: str, allow_signed: bool, bare_words: bool = False):
        self.t, self.bare_words = _Tokens(text, _SIGNED if allow_signed else _SQL), bare_words
        # Keywords are told from fields in any case of ASCII letters.
        self.t.list = [("op", w.upper()) if k == "word" and w.isascii() and w.upper() in _KEYWORDS else (k, w) for k, w in self.t.list]

    def rule(self) -> Node:
        n = self.either()
        self.t.end()
        return n

    def either(self) -> Node:
        return _joined("OR", self.both(), lambda: self.both() if self.t.accept("OR") else None)

    def both(self) -> Node:
        return _joined("AND", self.unary(), lambda: self.unary() if self.t.accept("AND") else None)

    def unary(self) -> Node:
        if self.t.accept("NOT"):
            return Not(self.unary())
        if self.t.accept("("):
            n = self.either()
            self.t.expect(")")
            return n
        return self.predicate()

    def predicate(self) -> Node:
        kind, field = self.t.take()
        if kind != "word":
            raise RuleError(f"expected a field, got {field!r}")
        if self.t.accept("IS"):
            negate = bool(self.t.accept("NOT"))
            self.t.expect("NULL")
            return IsNull(field, negate)
        negate = bool(self.t.accept("NOT"))
        if self.t.accept("IN"):
            self.t.expect("(")
            values = [self.value()]
            while self.t.accept(","):
                values.append(self.value())
            self.t.expect(")")
            return In(field, tuple(values), negate)
        if self.t.accept("LIKE"):
            v = self.value()
            if not v.is_string:
                raise RuleError("LIKE needs a string")
            return Like(field, v.text, negate)
        if negate:
            raise RuleError("only IN or LIKE may follow NOT")
        if self.t.accept("BETWEEN"):
            low = self.value()
            self.t.expect("AND")
            return Between(field, low, self.value())
        op = self.t.accept("=", "==", "!=", "<>", ">", ">=", "<", "<=")
        if not op:
            raise RuleError(f"expected an operator after {field!r}")
        return Compare(field, "!=" if op == "<>" else op, self.value())

    def value(self) -> Value:
        kind, text = self.t.take()
        if kind == "number":
            return Value(text)
        if kind == "string":
            return Value(_ESCAPED.sub(r"\1", text[1:-1]), True)
        if kind == "word" and self.bare_words:
            return Value(text, True)
        raise RuleError(f"expected a value, got {text!r}")


def parse_sql(text: str, allow_signed: bool = False) -> Node:
    """SQL-like text; numbers have no sign unless allow_signed."""
    return _Sql(text, allow_signed).rule()


# --- JSON --------------------------------------------------------------------

_JSON_OPS = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", ">": ">", ">=": ">=", "<": "<", "<=": "<="}


def condition(field: str, op: str, value: object = None, values: list | None = None) -> Node:
    """The leaf of a JSON condition."""
    values = values or []
    if op in _JSON_OPS:
        return Compare(field, _JSON_OPS[op], Value.of(value))
    if op == "between":
        if len(values) != 2:
            raise RuleError("between needs two values")
        return Between(field, *map(Value.of, values))
    if op in ("in", "not_in", "notin"):
        return In(field, tuple(map(Value.of, values)), op != "in")
    if op in ("like", "not_like", "notlike"):
        if not isinstance(value, str):
            raise RuleError("like needs a string")
        return Like(field, value, op != "like")
    if op in ("isnull", "isnotnull"):
        return IsNull(field, op == "isnotnull")
    raise RuleError(f"unsupported operator {op!r}")


def from_json(node: object) -> Node:
    """The rule of a decoded JSON document; of several keys, and goes before or, not and field."""
    if not isinstance(node, dict):
        raise RuleError("a rule is a JSON object")
    for key in ("and", "or"):
        if node.get(key):
            args = tuple(map(from_json, node[key]))
            return args[0] if len(args) == 1 else Logic(key.upper(), args)
    if node.get("not") is not None:
        return Not(from_json(node["not"]))
    if node.get("field"):
        return condition(node["field"], node.get("op", ""), node.get("value"), node.get("values"))
    raise RuleError("an object without and, or, not or field")


def parse_json(text: str) -> Node:
    try:
        decoded = json.loads(text)
    except ValueError as e:
        raise RuleError(f"not JSON: {e}") from None
    return from_json(decoded)


# --- CEL and Expr ------------------------------------------------------------

_CODE = re.compile(r"""(?P<skip>\s+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d]\w*)|(?P<op>&&|\|\||==|!=|>=|<=|[><!()\[\],.-])""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a"}
_SHAPES = {"prefix": "{}%", "suffix": "%{}", "contains": "%{}%"}


class _Code:
    """Boolean expressions over `field op literal`; subclasses say how the dialect writes the rest."""

    ors, ands, nots = ("||",), ("&&",), ("!",)
    n_ary = True

    def __init__(self, text: str):
        self.t = _Tokens(text, _CODE)

    def rule(self) -> Node:
        n = self.either()
        self.t.end()
        return n

    def either(self) -> Node:
        return self.chain("OR", self.ors, lambda: self.chain("AND", self.ands, self.unary))

    def chain(self, op: str, signs: tuple[str, ...], part: Callable[[], Node]) -> Node:
        n = part()
        while self.t.accept(*signs):
            n = Logic(op, (n, part()))
        return n

    def unary(self) -> Node:
        if self.t.accept(*self.nots):
            return Not(self.unary())
        if self.t.accept("("):
            n = self.either()
            self.t.expect(")")
            return n
        return self.predicate()

    def comparison(self, field: str) -> Node:
        if op := self.t.accept("==", "!=", ">=", "<=", ">", "<"):
            return Compare(field, "=" if op == "==" else op, self.literal())
        if self.t.accept("in"):
            return In(field, self.items())
        raise RuleError(f"unsupported expression at {self.t.peek()[1]!r}")

    def items(self) -> tuple[Value, ...]:
        self.t.expect("[")
        out: list[Value] = []
        while not self.t.accept("]"):
            if out:
                self.t.expect(",")
            out.append(self.literal())
        return tuple(out)

    def field(self) -> str:
        kind, text = self.t.take()
        if kind != "word":
            raise RuleError(f"expected a field, got {text!r}")
        return text

    def literal(self) -> Value:
        sign = "-" if self.signed and self.t.accept("-") else ""
        kind, text = self.t.take()
        if kind == "number":
            whole = text.isdigit()
            return Value(sign + (str(int(text)) if whole else plain_number(float(text))))
        if kind == "string" and not sign:
            return Value(_ESCAPED.sub(lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1]), True)
        if kind == "word" and text in ("true", "false") and not sign:
            return Value(text, True)
        raise RuleError(f"expected a literal, got {text!r}")

    def shaped(self, field: str, shape: str, value: Value) -> Node:
        return Like(field, _SHAPES[shape].format(value.text if value.is_string else ""))

    signed = False

    def predicate(self) -> Node:
        raise NotImplementedError


class _Cel(_Code):
    signed = True
    methods = {"startsWith": "prefix", "endsWith": "suffix", "contains": "contains"}

    def predicate(self) -> Node:
        field = self.field()
        if self.t.accept("."):
            method = self.field()
            if method not in self.methods:
                raise RuleError(f"unsupported method {method!r}")
            self.t.expect("(")
            value = self.literal()
            self.t.expect(")")
            return self.shaped(field, self.methods[method], value)
        if self.t.peek() == ("op", "("):
            raise RuleError(f"unsupported function {field!r}")
        return self.comparison(field)


class _Expr(_Code):
    ors, ands, nots = ("||", "or"), ("&&", "and"), ("!", "not")
    calls = {"hasPrefix": "prefix", "startsWith": "prefix", "hasSuffix": "suffix", "endsWith": "suffix", "contains": "contains"}

    def predicate(self) -> Node:
        name = self.field()
        if self.t.accept("("):
            if name not in self.calls:
                raise RuleError(f"unsupported call {name!r}")
            field = self.field()
            self.t.expect(",")
            value = self.literal()
            self.t.expect(")")
            return self.shaped(field, self.calls[name], value)
        for infix in ("contains", "startsWith", "endsWith"):
            if self.t.accept(infix):
                return self.shaped(name, self.calls[infix], self.literal())
        for sign in ("==", "!="):
            if self.t.peek() == ("op", sign) and self.t.peek(1) == ("word", "nil"):
                self.t.take(), self.t.take()
                return IsNull(name, sign == "!=")
        if self.t.peek() == ("word", "not") and self.t.peek(1) == ("word", "in"):
            self.t.take(), self.t.take()
            return In(name, self.items(), True)
        return self.comparison(name)


def parse_cel(text: str) -> Node:
    """CEL: && || ! comparisons, in, startsWith, endsWith, contains; the field is on the left."""
    return _Cel(text).rule()


def parse_expr(text: str) -> Node:
    """Expr: the same with words, calls and infix string tests, and nil; literals have no sign."""
    return _Expr(text).rule()


# --- Registry ----------------------------------------------------------------

_FRONTENDS: dict[str, Frontend] = {}


def register(name: str, frontend: Frontend) -> None:
    _FRONTENDS[name] = frontend


def names() -> list[str]:
    return sorted(_FRONTENDS)


def parse(text: str, frontend: str = "native") -> Node:
    if frontend not in _FRONTENDS:
        raise RuleError(f"unknown front-end {frontend!r}")
    return _FRONTENDS[frontend](text)


def _without_negation(text: str) -> Node:
    """SQL-like text without the forms of NOT; a bare word in place of a value is a string."""
    parser = _Sql(text, False, bare_words=True)
    if {("op", "NOT"), ("op", "IS")} & set(parser.t.list):
        raise RuleError("this front-end has no NOT and no IS")
    return parser.rule()


def _unavailable(text: str) -> Node:
    raise RuleError("this front-end isn't available")


for _name, _frontend in {"native": parse_sql, "json": parse_json, "cel": parse_cel, "expr": parse_expr, "qlbridge": _without_negation, "vitess": _unavailable}.items():
    register(_name, _frontend)
