"""Evaluation of many rules over Arrow batches by bitmaps; the semantics are those of plans.lower."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ir import Between, Compare, In, IsNull, Like, Logic, Node, Not, fields, leaves, plain_number, positive
from ..plans.lower import dynamic_operand, operand
from .rules import RuleSet

#: Rows that are evaluated together; rules times rows / 8 bytes of bitmaps are held.
ROWS = 1 << 14
#: Words of 64 bits that are gathered together.
CELLS = 1 << 19
_TESTS = {"=": np.equal, "!=": np.not_equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}
_TEXT = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


class _Field:
    """A column of a batch: numbers if it has any, and its distinct texts, which are made when a leaf needs them."""

    def __init__(self, array: pa.Array):
        self.there = self.is_number = pc.is_valid(array).to_numpy(zero_copy_only=False)
        self.mixed = False
        self.array = array
        self.numeric = pa.types.is_integer(array.type) or pa.types.is_floating(array.type)
        self.numbers = pc.fill_null(array.cast(pa.float64(), safe=False), 0).to_numpy(zero_copy_only=False) if self.numeric else None
        self._texts: tuple[np.ndarray, list[str]] | None = None

    @property
    def texts(self) -> tuple[np.ndarray, list[str]]:
        """(code of each row, texts by code)."""
        if self._texts is None:
            if self.numeric:
                values, codes = np.unique(self.numbers, return_inverse=True)
                zero = np.flatnonzero(values == 0)
                texts = [plain_number(float(v)) for v in values]
                if len(zero) and np.signbit(self.numbers[self.numbers == 0]).any():  # -0 has a text of its own
                    minus = (self.numbers == 0) & np.signbit(self.numbers)
                    codes, texts = np.where(minus, len(texts), codes), [*texts, "-0"]
                    texts[int(zero[0])] = "0"
                self._texts = codes, texts
            else:
                table = pc.dictionary_encode(self.array)
                self._texts = pc.fill_null(table.indices, 0).to_numpy(zero_copy_only=False), table.dictionary.to_pylist() or [""]
        return self._texts

    def by_text(self, test) -> np.ndarray:
        codes, texts = self.texts
        return np.fromiter(map(test, texts), bool, len(texts))[codes] & self.there

    def shown(self, i: int) -> str | None:
        """The text of a row's value."""
        codes, texts = self.texts
        return texts[codes[i]] if self.there[i] else None


class _Mixed(_Field):
    """A field of a variant column: numbers where values are numbers, texts where they are text."""

    def __init__(self, numbers: pa.Array, texts: pa.Array):
        self.parts = _Field(numbers), _Field(texts)
        self.numeric, self.mixed, self.numbers, self.is_number = True, True, self.parts[0].numbers, self.parts[0].there
        self.there = self.is_number | self.parts[1].there
        self._texts = None

    @property
    def texts(self) -> tuple[np.ndarray, list[str]]:
        if self._texts is None:
            (a, own), (b, others) = (p.texts for p in self.parts)
            self._texts = np.where(self.is_number, a, b + len(own)), [*own, *others]
        return self._texts


def field_of(batch: pa.RecordBatch, name: str) -> _Field:
    """A field's column, or the columns n: and t: of its numbers and texts."""
    return _Mixed(batch.column(f"n:{name}"), batch.column(f"t:{name}")) if f"t:{name}" in batch.schema.names else _Field(batch.column(name))


def _bits(leaf: Node, f: _Field | None, n: int) -> np.ndarray:
    """The positive leaf for each row."""
    if f is None:
        return np.full(n, isinstance(leaf, IsNull))
    match leaf:
        case IsNull():
            return ~f.there
        case Compare(_, op, value):
            op = "=" if op == "==" else op
            if f.numeric and not value.is_string:
                with np.errstate(invalid="ignore"):
                    said = _TESTS[op](f.numbers, value.number) & f.is_number
                if not f.mixed or f.is_number.all():
                    return said
            text = value.as_text.encode()
            as_text = f.by_text(lambda t: _TEXT[op](t.encode(), text))
            return said | as_text & ~f.is_number if f.numeric and not value.is_string else as_text
        case Between(_, low, high):
            if not f.numeric:
                return np.zeros(n, bool)
            with np.errstate(invalid="ignore"):
                return (f.numbers >= low.number) & (f.numbers <= high.number) & f.is_number
        case In(_, values):
            allowed = {v.text for v in values}
            return f.by_text(allowed.__contains__)
        case Like():
            core = leaf.core
            return f.by_text({"prefix": lambda t: t.startswith(core), "suffix": lambda t: t.endswith(core), "contains": lambda t: core in t, "equals": lambda t: t == core}[leaf.kind])
    raise TypeError(leaf)


class Evaluator:
    """Bitmaps of all rules of a set for a batch.

    Most rules are conjunctions of leaves and negated leaves; these are rows of numbers of leaf bitmaps (even: the leaf, odd:
    its complement), combined by a few array operations for all of them. The others are combined node by node.
    """

    def __init__(self, rules: RuleSet):
        nodes = [p.node for p in rules]
        self.ids = np.array([p.id for p in rules], np.int64)
        self.fields = fields(*nodes)
        self.atoms: dict[Node, int] = {}
        plain, self.others, flat, starts = [], [], [], []
        for i, node in enumerate(nodes):
            parts = [self._literal(a) for a in (node.args if isinstance(node, Logic) and node.op == "AND" else (node,))]
            if None in parts:
                for leaf in leaves(node):
                    self._literal(leaf)
                self.others.append((i, node))
            else:
                plain.append(i)
                starts.append(len(flat))
                flat += parts
        self.plain, self.flat, self.starts = np.array(plain, np.int64), np.array(flat, np.int64), np.array(starts, np.int64)

    def _literal(self, node: Node) -> int | None:
        """Twice the number of a leaf, plus one if it is negated; None for anything else."""
        turned = False
        while isinstance(node, Not):
            node, turned = node.arg, not turned
        if isinstance(node, Logic):
            return None
        leaf, negated = positive(node)
        return 2 * self.atoms.setdefault(leaf, len(self.atoms)) + (turned != negated)

    def __call__(self, batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        """(rules, bytes): row i of the batch is bit i; bits past the last row are 0."""
        return self.combined(*self.leaf_bits({name: field_of(batch, name) for name in names}, batch.num_rows))

    def leaf_bits(self, columns: dict[str, _Field], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(bitmaps of the leaves and their complements, that of all rows)."""
        words = -(-n // 64)
        table = np.zeros((2 * len(self.atoms), words * 8), np.uint8)
        for atom, i in self.atoms.items():
            packed = np.packbits(_bits(atom, columns.get(atom.field), n), bitorder="little")
            table[2 * i, : len(packed)] = packed
        table = table.view(np.uint64)
        full = np.zeros(words * 8, np.uint8)
        every = np.packbits(np.ones(n, bool), bitorder="little")
        full[: len(every)] = every
        full = full.view(np.uint64)
        table[1::2] = table[::2] ^ full
        return table, full

    def combined(self, table: np.ndarray, full: np.ndarray) -> np.ndarray:
        words = len(full)
        out = np.empty((len(self.ids), words), np.uint64)
        step = max(1, CELLS // max(1, 4 * words))
        for a in range(0, len(self.plain), step):
            own, begin = self.plain[a : a + step], self.starts[a]
            end = self.starts[a + step] if a + step < len(self.starts) else len(self.flat)
            out[own] = np.bitwise_and.reduceat(table[self.flat[begin:end]], self.starts[a : a + step] - begin, axis=0)
        for i, node in self.others:
            out[i] = self.combine(node, table, full)
        return out.view(np.uint8)

    def combine(self, node: Node, table: np.ndarray, full: np.ndarray) -> np.ndarray:
        if (literal := self._literal(node)) is not None:
            return table[literal]
        match node:
            case Logic("AND", args):
                return np.bitwise_and.reduce([self.combine(a, table, full) for a in args])
            case Logic(_, args):
                return np.bitwise_or.reduce([self.combine(a, table, full) for a in args])
            case Not(arg):
                return full ^ self.combine(arg, table, full)
        raise TypeError(node)


def evaluator(rules: RuleSet) -> Evaluator:
    """The evaluator of a set, made once: a set doesn't change."""
    found = getattr(rules, "_evaluator", None)
    if found is None:
        found = rules._evaluator = Evaluator(rules)
    return found


def prepared(df: DataFrame, rules: RuleSet, keys: list[str], variant: str | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """(keys and inputs under names that don't clash, key names, field names); dates become text, decimals doubles, and a
    field of a variant column two inputs, its numbers and its texts."""
    columns, names = [], []
    for name in evaluator(rules).fields:
        if variant:
            o = dynamic_operand(variant, name)
            columns += [o.number.alias(f"f:n:{name}"), o.plain.alias(f"f:t:{name}")]
            names.append(name)
        elif name in df.columns and (o := operand(name, df.schema[name])):
            # Booleans, dates and timestamps are text to a rule; a float is widened to a double first.
            columns.append((o.number if o.kind == "double" else o.raw if o.kind == "whole" else o.text).alias(f"f:{name}"))
            names.append(name)
    keyed = [F.col(f"`{k}`").alias(f"k:{k}") for k in keys]
    # Without a field to read, rows still count.
    return df.select(*keyed, *(columns or [F.lit(0).alias("f:")])), [f"k:{k}" for k in keys], names


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """(rows, their inputs) of ROWS rows at most."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            inputs = [n for n in batch.schema.names if n.startswith("f:")]
            yield batch, pa.RecordBatch.from_arrays([batch.column(n) for n in inputs], names=[n[2:] for n in inputs])


def listed(bits: np.ndarray, rows: int, *values: np.ndarray) -> list[pa.ListArray]:
    """For each row, the values of the rules whose bit is set."""
    out, offsets = [[] for _ in values], [np.zeros(1, np.int64)]
    for low in range(0, bits.shape[1], 64):  # blocks of 512 rows
        part = np.unpackbits(bits[:, low : low + 64], axis=1, bitorder="little")[:, : max(0, rows - 8 * low)]
        row, rule = np.nonzero(np.ascontiguousarray(part.T))
        offsets.append(np.bincount(row, minlength=part.shape[1]))
        for own, value in zip(out, values):
            own.append(value[rule])
    ends = pa.array(np.cumsum(np.concatenate(offsets)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own) if own else value[:0], pa.int64() if value.dtype == np.int64 else pa.string())) for own, value in zip(out, values)]


def match_wide(df: DataFrame, rules: RuleSet, keys: list[str], variant: str | None = None, with_names: bool = False) -> DataFrame:
    """(keys, rule_ids) and, if asked for, rule_names."""
    chosen, key_names, names = prepared(df, rules, keys, variant)
    evaluate = evaluator(rules)
    called = rules.names
    values = [evaluate.ids] + ([np.array([called[i] for i in evaluate.ids.tolist()], object)] if with_names else [])
    columns = [*(f"c{i}" for i in range(len(keys))), "rule_ids", "rule_names"][: len(keys) + len(values)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, inputs in blocks(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key_names), *listed(evaluate(inputs, names), batch.num_rows, *values)], names=columns)

    kinds = [df.schema[k].dataType.simpleString() for k in keys] + ["array<bigint>", "array<string>"]
    return chosen.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(columns, kinds))).toDF(*keys, *columns[len(keys) :])


def hits_by_rule(df: DataFrame, rules: RuleSet, variant: str | None = None) -> DataFrame:
    """(rule_id, n_rows, hits) partial sums of each task: bits are counted, hits aren't listed. Rows count under the id -1."""
    chosen, _, names = prepared(df, rules, [], variant)
    evaluate = evaluator(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, rows = np.zeros(len(evaluate.ids), np.int64), 0
        for batch, inputs in blocks(batches):
            hits += np.bitwise_count(evaluate(inputs, names).view(np.uint64)).sum(axis=1, dtype=np.int64)
            rows += batch.num_rows
        own = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(evaluate.ids[own], -1)), pa.array(np.append(hits[own] * 0, rows)), pa.array(np.append(hits[own], 0))], names=["rule_id", "n_rows", "hits"])

    return chosen.mapInArrow(run, "rule_id long, n_rows long, hits long")
