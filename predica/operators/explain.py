"""Why rows fail rules, and gates that all rules must pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.emit import emit
from ..plans.ir import Between, Compare, In, IsNull, Like, Logic, Node, Not, Value
from ..plans.lower import Lowering, WalkerLowering
from . import bitmaps
from .match import COLUMN_RULES
from .rules import RuleSet

REASONS = "array<struct<expr:string,detail:string>>"
FAILED = f"array<struct<rule_id:bigint,name:string,rule:string,reasons:{REASONS}>>"
#: Words of reasons.
MISSING, NO_ALTERNATIVE, NEGATED = "<null>", "no OR alternative held — ", "the negated condition was satisfied"


def _literal(v: Value) -> str:
    return f"'{v.text}'" if v.is_string else v.text


def said(leaf: Node) -> tuple[str | None, str]:
    """What is said of a leaf that doesn't hold, before and after the value; nothing before if the value isn't named."""
    match leaf:
        case Compare(_, op, value):
            tail = f" does not satisfy {op} {_literal(value)}"
        case Between(_, low, high):
            tail = f" is outside [{_literal(low)}, {_literal(high)}]"
        case In(_, _, negate):
            tail = " is in the excluded set" if negate else " is not in the allowed set"
        case Like(_, pattern, negate):
            tail = f" matches the excluded pattern '{pattern}'" if negate else f" does not match pattern '{pattern}'"
        case IsNull(field, True):
            return None, f"{field} is missing or null (IS NOT NULL required)"
        case _:
            tail = " is present but IS NULL required"
    return f"{leaf.field}=", tail


class Explainer:
    """Reasons as columns; `passed` is the same truth that matching uses, unless compat is `ast` (see WalkerLowering)."""

    def __init__(self, df: DataFrame, variant: str | None = None, compat: str = "vm"):
        self.lowering = {"vm": Lowering, "ast": WalkerLowering}[compat](df, variant)

    def passed(self, node: Node) -> Column:
        return self.lowering.predicate(node)

    def reasons(self, node: Node) -> Column:
        """array<struct<expr, detail>>, empty where the rule holds. AND lists all of its failed parts, OR gives one reason."""
        none = F.array().cast(REASONS)
        match node:
            case Logic("AND", args):
                return F.concat(*map(self.reasons, args))
            case Logic(_, args):
                details = F.array_join(F.transform(F.concat(*map(self.reasons, args)), lambda r: r["detail"]), "; ")
                detail = F.concat(F.lit(NO_ALTERNATIVE), details)
            case Not():
                detail = F.lit(NEGATED)
            case _:
                detail = self._detail(node)
        return F.when(self.passed(node), none).otherwise(F.array(F.struct(F.lit(emit(node)).alias("expr"), detail.alias("detail"))))

    def _detail(self, leaf: Node) -> Column:
        o = self.lowering.operand(leaf.field)
        head, tail = said(leaf)
        return F.lit(tail) if head is None else F.concat(F.lit(head), F.coalesce(o.text, F.lit(MISSING)) if o else F.lit(MISSING), F.lit(tail))


def explain(df: DataFrame, node: Node, keys: list[str], variant: str | None = None, compat: str = "vm") -> DataFrame:
    """(keys, passed, reasons) of each row."""
    e = Explainer(df, variant, compat)
    return df.select(*keys, e.passed(node).alias("passed"), e.reasons(node).alias("reasons"))


def gate(df: DataFrame, rules: RuleSet, keys: list[str], with_reasons: bool = True, variant: str | None = None, compat: str = "vm") -> DataFrame:
    """(keys, total_rules, passed_count, failed_count, passed, passed_rule_ids, failed_rule_ids, failed) of each row.

    A row passes if there is a rule and every rule holds; failed has (rule_id, name, rule, reasons). More than COLUMN_RULES
    rules are evaluated over Arrow batches.
    """
    if len(rules) > COLUMN_RULES and compat == "vm":
        return _summed(_gate_of_batches(df, rules, keys, with_reasons, variant), rules, keys, with_reasons)
    e = Explainer(df, variant, compat)
    ids = lambda want: F.array_compact(F.array(*(F.when(e.passed(p.node) if want else ~e.passed(p.node), F.lit(p.id).cast("long")) for p in rules))) if len(rules) else F.array().cast("array<bigint>")
    out = df.select(*keys, F.lit(len(rules)).alias("total_rules"), ids(True).alias("passed_rule_ids"), ids(False).alias("failed_rule_ids"), *([_failed(e, rules).alias("failed")] if with_reasons else []))
    return _summed(out, rules, keys, with_reasons)


def _summed(out: DataFrame, rules: RuleSet, keys: list[str], with_reasons: bool) -> DataFrame:
    passed, failed = F.size("passed_rule_ids"), F.size("failed_rule_ids")
    columns = [*keys, "total_rules", passed.alias("passed_count"), failed.alias("failed_count"), ((failed == 0) & F.lit(len(rules) > 0)).alias("passed"), "passed_rule_ids", "failed_rule_ids"]
    return out.select(*columns, *(["failed"] if with_reasons else []))


def _failed(e: Explainer, rules: RuleSet) -> Column:
    if not len(rules):
        return F.array().cast(FAILED)
    each = [F.when(~e.passed(p.node), F.struct(F.lit(p.id).cast("long").alias("rule_id"), F.lit(p.rule.name).alias("name"), F.lit(p.rule.expr or emit(p.node)).alias("rule"), e.reasons(p.node).alias("reasons"))) for p in rules]
    return F.array_compact(F.array(*each))


class _BatchReasons:
    """Reasons for the rows of an Arrow batch, by the bitmaps that matching uses."""

    def __init__(self, evaluate: bitmaps.Evaluator, columns: dict[str, bitmaps._Field], n: int):
        self.evaluate, self.columns, self.n = evaluate, columns, n
        self.table, self.full = evaluate.leaf_bits(columns, n)
        self.truths: dict[Node, np.ndarray] = {}

    def holds(self, node: Node, i: int) -> bool:
        if node not in self.truths:
            bits = np.ascontiguousarray(self.evaluate.combine(node, self.table, self.full))
            self.truths[node] = np.unpackbits(bits.view(np.uint8), bitorder="little")[: self.n].astype(bool)
        return bool(self.truths[node][i])

    def of(self, node: Node, i: int) -> list[dict]:
        if isinstance(node, Logic) and node.op == "AND":
            return [r for a in node.args for r in self.of(a, i)]
        if self.holds(node, i):
            return []
        match node:
            case Logic(_, args):
                detail = NO_ALTERNATIVE + "; ".join(r["detail"] for a in args for r in self.of(a, i))
            case Not():
                detail = NEGATED
            case _:
                head, tail = said(node)
                value = self.columns[node.field].shown(i) if node.field in self.columns else None
                detail = tail if head is None else f"{head}{MISSING if value is None else value}{tail}"
        return [{"expr": emit(node), "detail": detail}]


def _gate_of_batches(df: DataFrame, rules: RuleSet, keys: list[str], with_reasons: bool, variant: str | None) -> DataFrame:
    chosen, key_names, names = bitmaps.prepared(df, rules, keys, variant)
    evaluate, programs = bitmaps.evaluator(rules), list(rules)
    columns = [*(f"c{i}" for i in range(len(keys))), "total_rules", "passed_rule_ids", "failed_rule_ids", *(["failed"] if with_reasons else [])]
    reason = pa.list_(pa.struct([("expr", pa.string()), ("detail", pa.string())]))
    kind = pa.list_(pa.struct([("rule_id", pa.int64()), ("name", pa.string()), ("rule", pa.string()), ("reasons", reason)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, inputs in bitmaps.blocks(batches):
            n = batch.num_rows
            reasons = _BatchReasons(evaluate, {name: bitmaps.field_of(inputs, name) for name in names}, n)
            bits = evaluate.combined(reasons.table, reasons.full)
            missed = (bits.view(np.uint64) ^ reasons.full).view(np.uint8)
            out = [*bitmaps.listed(bits, n, evaluate.ids), *bitmaps.listed(missed, n, evaluate.ids)]
            if with_reasons:
                failed = np.unpackbits(missed, axis=1, bitorder="little")[:, :n].T
                out.append(pa.array([[{"rule_id": programs[k].id, "name": programs[k].rule.name, "rule": programs[k].rule.expr or emit(programs[k].node), "reasons": reasons.of(programs[k].node, i)} for k in np.flatnonzero(row).tolist()] for i, row in enumerate(failed)], kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key_names), pa.array(np.full(n, len(programs), np.int32)), *out], names=columns)

    kinds = [*(df.schema[k].dataType.simpleString() for k in keys), "int", "array<bigint>", "array<bigint>", FAILED]
    return chosen.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(columns, kinds))).toDF(*keys, *columns[len(keys) :])
