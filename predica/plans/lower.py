"""Lowering of rules to Spark columns.

Truth is two-valued: a leaf over a missing value is false, except IS NULL, and NOT turns it over. Numbers are compared
as numbers only with numbers; any other pair is compared as text. So a leaf is lowered by its column's type:

* numeric columns: comparisons with numbers as doubles (whole-number columns stay as they are where that can't differ, so
  filters reach the Parquet scan), with strings as text;
* text and boolean columns, dates and timestamps (as `yyyy-MM-dd HH:mm:ss`): as text;
* nested and absent columns: missing.

predicate() gives a projected boolean, never null. condition() is for filters: equal to it in where(), but without
coalesce(), and with NOT moved to the leaves, so that the scan gets the pushed filters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import number_text
from .ir import Between, Compare, In, IsNull, Like, Logic, Node, Not, RuleError, Value, check, plain_number, positive

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_EXACT = 2**53
_CANONICAL = re.compile(r"-?(0|[1-9]\d*)(\.\d*[1-9])?")


@dataclass(frozen=True)
class Operand:
    """A field: its value as a number (null if it isn't one) and as text, and its type's kind."""

    kind: str  # whole, double, text or dynamic
    raw: Column
    number: Column | None
    text_of: Callable[[], Column]
    nullable: bool = True
    #: Of a dynamic field: its text where it isn't a number.
    plain: Column | None = None

    @cached_property
    def text(self) -> Column:
        """Made when a leaf needs it: the text of a double is a long expression."""
        return self.text_of()

    @property
    def missing(self) -> Column:
        return self.raw.isNull()


def operand(name: str, field: T.StructField) -> Operand | None:
    """The operand of a column, or None if its type counts as missing."""
    c, kind = F.col(f"`{name.replace('`', '``')}`"), field.dataType
    if isinstance(kind, T.LongType):
        return Operand("whole", c, c.cast("double"), lambda: F.when(F.abs(c.cast("double")) <= _EXACT, c.cast("string")).otherwise(number_text(c.cast("double"))), field.nullable)
    if isinstance(kind, _WHOLE):
        return Operand("whole", c, c.cast("double"), lambda: c.cast("string"), field.nullable)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Operand("double", c, c.cast("double"), lambda: number_text(c), field.nullable)
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return Operand("text", c, None, lambda: c, field.nullable)
    if isinstance(kind, T.BooleanType):
        return Operand("text", c, None, lambda: c.cast("string"), field.nullable)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Operand("text", c, None, lambda: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), field.nullable)
    return None


def dynamic_operand(column: str, name: str) -> Operand:
    """A field of a variant column: its type is that of each value; nested values are missing."""
    value = F.variant_get(F.col(column), "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")
    kind = F.schema_of_variant(value)
    numeric, plain = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), kind.isin("STRING", "BOOLEAN")
    number, said = F.when(numeric, F.try_variant_get(value, "$", "double")), F.when(plain, F.try_variant_get(value, "$", "string"))
    # The text of a number is a long expression, which only comparisons with strings, IN and LIKE need.
    return Operand("dynamic", F.when(numeric | plain, F.lit(True)), number, lambda: F.coalesce(said, number_text(number)), True, said)


class Lowering:
    """Columns for rules over the rows of a DataFrame. Field names match column names exactly, case included."""

    def __init__(self, df: DataFrame | None = None, variant: str | None = None, hidden: Iterable[str] = ()):
        self.variant, hidden = variant, set(hidden)
        self.columns = {} if df is None or variant else {f.name: f for f in df.schema.fields if f.name not in hidden}
        self.operands: dict[str, Operand | None] = {}

    def operand(self, name: str) -> Operand | None:
        if name not in self.operands:
            self.operands[name] = dynamic_operand(self.variant, name) if self.variant else operand(name, self.columns[name]) if name in self.columns else None
        return self.operands[name]

    def predicate(self, node: Node) -> Column:
        """True or false for each row."""
        match node:
            case Logic(op, args):
                return reduce((lambda a, b: a & b) if op == "AND" else (lambda a, b: a | b), map(self.predicate, args))
            case Not(arg):
                return ~self.predicate(arg)
        check(node)
        leaf, negated = positive(node)
        o = self.operand(leaf.field)
        said = F.lit(isinstance(leaf, IsNull)) if o is None else self._leaf(leaf, o)
        if o is not None and not isinstance(leaf, IsNull) and (o.nullable or o.kind == "dynamic"):
            said = F.coalesce(said, F.lit(False))
        return ~said if negated else said

    def condition(self, node: Node, negated: bool = False) -> Column:
        """A filter that keeps the rows for which the rule holds, or doesn't hold if negated."""
        match node:
            case Logic(op, args):
                both = (op == "AND") != negated
                return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), [self.condition(a, negated) for a in args])
            case Not(arg):
                return self.condition(arg, not negated)
        check(node)
        leaf, inner = positive(node)
        negated ^= inner
        o = self.operand(leaf.field)
        if o is None:
            return F.lit(isinstance(leaf, IsNull) != negated)
        if isinstance(leaf, IsNull):
            return o.raw.isNotNull() if negated else o.raw.isNull()
        said = self._leaf(leaf, o)
        return o.raw.isNull() | ~said if negated else said

    def _leaf(self, leaf: Node, o: Operand) -> Column:
        """The positive leaf; null only where the field is."""
        match leaf:
            case IsNull():
                return o.missing
            case Compare(_, op, value):
                return self._compare(o, "=" if op == "==" else op, value)
            case Between(_, low, high):
                if o.number is None:
                    return F.when(o.raw.isNotNull(), F.lit(False))
                return self._order(o, ">=", low) & self._order(o, "<=", high)
            case In(_, values):
                return self._in(o, values)
            case Like():
                test = {"prefix": o.text.startswith, "suffix": o.text.endswith, "contains": o.text.contains, "equals": o.text.__eq__}
                return test[leaf.kind](leaf.core)
        raise TypeError(leaf)

    def _compare(self, o: Operand, op: str, value: Value) -> Column:
        if o.number is None or value.is_string:
            return _apply(op, o.text, F.lit(value.as_text))
        numeric = self._order(o, op, value)
        if o.kind == "dynamic":
            return F.when(o.number.isNotNull(), numeric).otherwise(_apply(op, o.plain, F.lit(value.as_text)))
        return numeric

    def _order(self, o: Operand, op: str, value: Value) -> Column:
        x = value.number
        if o.kind == "whole" and x.is_integer() and abs(x) < _EXACT:
            return _apply(op, o.raw, F.lit(int(x)))
        said = _apply(op, o.number, F.lit(x))
        # NaN is greater than any number here, but not for a rule.
        return said & ~F.isnan(o.number) if o.kind != "whole" and op in (">", ">=") else said

    def _in(self, o: Operand, values: tuple[Value, ...]) -> Column:
        texts = [v.text for v in values]
        if o.kind in ("whole", "double"):
            if all(_CANONICAL.fullmatch(t) is None or plain_number(float(t)) == t for t in texts) and not {"NaN", "+Inf", "-Inf", "-0"} & set(texts):
                own = [t for t in texts if _CANONICAL.fullmatch(t)]
                if o.kind == "whole":
                    whole = [int(t) for t in own if "." not in t and abs(int(t)) < _EXACT]
                    if len(whole) == sum("." not in t for t in own):
                        return o.raw.isin(whole) if whole else F.when(o.raw.isNotNull(), F.lit(False))
                elif "0" not in own:  # a double may be -0, whose text is another
                    return o.number.isin([float(t) for t in own]) if own else F.when(o.raw.isNotNull(), F.lit(False))
        return o.text.isin(texts) if texts else F.when(o.raw.isNotNull(), F.lit(False))


def _apply(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def filter_rows(df: DataFrame, node: Node) -> DataFrame:
    """The rows for which the rule holds."""
    return df.where(Lowering(df).condition(node))


class WalkerLowering(Lowering):
    """The other reading of rules, for callers that depend on it: explanations only, never matching.

    A missing value is empty text in comparisons, IN and LIKE; a number literal that meets text is compared as it is
    written; ranges may have bounds in quotes; `==` never holds; a nested value isn't null.
    """

    def predicate(self, node: Node) -> Column:
        if isinstance(node, (Logic, Not)):
            return super().predicate(node)
        leaf, negated = positive(node)
        o = self.operand(leaf.field)
        said = F.coalesce(self._walk(leaf, o), F.lit(False))
        return ~said if negated else said

    def _walk(self, leaf: Node, o: Operand | None) -> Column:
        text = F.coalesce(o.text, F.lit("")) if o else F.lit("")
        number = o.number if o and o.number is not None else F.lit(None).cast("double")
        match leaf:
            case IsNull(field):
                if o is None:
                    return F.col(f"`{field}`").isNull() if field in self.columns else F.lit(True)
                return o.missing
            case Compare(_, "==", _):
                return F.lit(False)
            case Compare(_, op, value):
                as_text = _apply(op, text, F.lit(value.text))
                if value.is_string:
                    return as_text
                numeric = _apply(op, number, F.lit(value.number))
                return F.when(number.isNotNull(), numeric & ~F.isnan(number) if op in (">", ">=") else numeric).otherwise(as_text)
            case Between(_, low, high):
                try:
                    bounds = [Value(v.text).number for v in (low, high)]
                except RuleError:
                    return F.lit(False)
                return number.between(*bounds) & ~F.isnan(number)
            case In(_, values):
                return text.isin([v.text for v in values]) if values else F.lit(False)
            case Like():
                core = F.lit(leaf.core if leaf.kind != "equals" else leaf.pattern)
                return {"prefix": F.startswith, "suffix": F.endswith, "contains": F.contains, "equals": lambda a, b: a == b}[leaf.kind](text, core)
        raise TypeError(leaf)
