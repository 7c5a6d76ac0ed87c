"""Rules as text in SQL, CEL, Expr and Aviator."""

from __future__ import annotations

from dataclasses import dataclass

from .ir import Between, Compare, In, IsNull, Like, Logic, Node, Not, Value


@dataclass(frozen=True)
class Dialect:
    """Fixed values of a code dialect: how it writes strings, lists, string tests and null tests."""

    quote: str
    list_test: str | None
    prefix: str
    suffix: str
    contains: str
    null: str
    not_null: str

    def value(self, v: Value) -> str:
        return self.text(v.text) if v.is_string else v.text

    def text(self, s: str) -> str:
        return self.quote + s.replace(self.quote, "\\" + self.quote) + self.quote

    def write(self, node: Node) -> str:
        match node:
            case Logic(op, args):
                return {"AND": " && ", "OR": " || "}[op].join(f"({self.write(a)})" if isinstance(a, Logic) else self.write(a) for a in args)
            case Not(arg):
                return f"!({self.write(arg)})"
            case Compare(field, op, v):
                return f"{field} {'==' if op == '=' else op} {self.value(v)}"
            case Between(field, low, high):
                return f"({field} >= {self.value(low)} && {field} <= {self.value(high)})"
            case In(field, values, negate):
                if self.list_test:
                    said = self.list_test.format(field=field, values=", ".join(map(self.value, values)))
                else:
                    said = "(" + " || ".join(f"{field} == {self.value(v)}" for v in values) + ")"
                return f"!({said})" if negate else said
            case Like(field, _, negate):
                form = {"prefix": self.prefix, "suffix": self.suffix, "contains": self.contains, "equals": "{field} == {text}"}[node.kind]
                said = form.format(field=field, text=self.text(node.core))
                return f"!({said})" if negate else said
            case IsNull(field, negate):
                return (self.not_null if negate else self.null).format(field=field)
        raise TypeError(node)


DIALECTS = {
    "cel": Dialect("'", "{field} in [{values}]", "{field}.startsWith({text})", "{field}.endsWith({text})", "{field}.contains({text})", "!has({field})", "has({field})"),
    "expr": Dialect('"', "{field} in [{values}]", "hasPrefix({field}, {text})", "hasSuffix({field}, {text})", "{field} contains {text}", "{field} == nil", "{field} != nil"),
    "aviator": Dialect("'", None, "string.startsWith({field}, {text})", "string.endsWith({field}, {text})", "string.contains({field}, {text})", "{field} == nil", "{field} != nil"),
}
DSLS = ("sql", "aviator", "cel", "expr")


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_value(v: Value) -> str:
    return _sql_text(v.text) if v.is_string else v.text


def _sql(node: Node) -> str:
    match node:
        case Logic(op, args):
            return f" {op} ".join(f"({_sql(a)})" if isinstance(a, Logic) else _sql(a) for a in args)
        case Not(arg):
            return f"NOT ({_sql(arg)})"
        case Compare(field, op, v):
            return f"{field} {op} {_sql_value(v)}"
        case Between(field, low, high):
            return f"{field} BETWEEN {_sql_value(low)} AND {_sql_value(high)}"
        case In(field, values, negate):
            return f"{field}{' NOT' * negate} IN ({', '.join(map(_sql_value, values))})"
        case Like(field, pattern, negate):
            return f"{field}{' NOT' * negate} LIKE {_sql_text(pattern)}"
        case IsNull(field, negate):
            return f"{field} IS{' NOT' * negate} NULL"
    raise TypeError(node)


def emit(node: Node, dsl: str = "sql") -> str:
    """The rule in a dialect: sql, aviator, cel or expr. SQL text escapes quotes, so it parses back to the same rule."""
    return _sql(node) if dsl == "sql" else DIALECTS[dsl].write(node)
