"""Decision tables: a rule for each row, the conjunction of its cells."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..operators.rules import Rule
from ..plans.emit import emit
from ..plans.ir import Logic, RuleError
from .frontends import condition

OPERATORS = {"=", "==", "!=", ">", ">=", "<", "<=", "between", "in", "like", "isnull", "isnotnull"}


@dataclass(frozen=True)
class DecisionTable:
    name: str
    id_base: int
    rows: tuple[dict, ...]

    @staticmethod
    def of(x: dict) -> DecisionTable:
        return DecisionTable(x.get("name") or "", int(x.get("id_base") or 0), tuple(x.get("rows") or ()))

    def rules(self) -> list[Rule]:
        """A rule for each row, disabled ones too; ids count all rows. A row without cells is an error."""
        out = []
        for i, row in enumerate(self.rows):
            cells = row.get("when") or []
            if not cells:
                raise RuleError(f"row {i} ({row.get('name', '')}): no cells")
            for c in cells:
                if c.get("op") not in OPERATORS:
                    raise RuleError(f"row {i} ({row.get('name', '')}): unsupported operator {c.get('op')!r}")
            nodes = tuple(condition(c.get("field") or "", c["op"], c.get("value"), c.get("values")) for c in cells)
            node = nodes[0] if len(nodes) == 1 else Logic("AND", nodes)
            out.append(Rule(self.id_base + i, row.get("name") or "", emit(node), int(row.get("priority") or 0), 0, row.get("enabled") is not False, node))
        return out


def load(spark: SparkSession, path: str) -> DecisionTable:
    """A decision table from a JSON file, on any file system that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()
    try:
        found = json.loads(rows[0].value) if len(rows) == 1 else None
    except ValueError as e:
        raise RuleError(f"{path}: {e}") from None
    if not isinstance(found, dict):
        raise RuleError(f"{path}: not one decision table")
    return DecisionTable.of(found)
