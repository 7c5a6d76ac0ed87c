"""Translation of rules between dialects."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..plans.emit import DSLS, emit
from ..plans.ir import RuleError
from ..sources import frontends
from .rules import Rule


def convert(text: str, dsl: str, frontend: str = "native") -> str:
    """Rule text in another dialect."""
    if dsl not in DSLS:
        raise RuleError(f"unknown dialect {dsl!r}")
    return emit(frontends.parse(text, frontend), dsl)


def export_text(rules: Iterable[Rule], dsl: str, source: str = "", frontend: str = "native") -> str:
    """A report of rules and their text in a dialect; a rule that doesn't parse has its error there."""
    if dsl not in DSLS:
        raise RuleError(f"unknown dialect {dsl!r}")
    rules = list(rules)
    out = f"# converting {len(rules)} rules from {source} to {dsl}\n\n"
    for rule in rules:
        try:
            text = convert(rule.expr, dsl, frontend)
        except RuleError as e:
            text = f"<error: {e}>"
        out += f"# rule {rule.id} {rule.name}\nSQL : {rule.expr}\n{dsl:<4}: {text}\n\n"
    return out


def export(spark: SparkSession, rules: Iterable[Rule], dsls: Iterable[str] = DSLS, frontend: str = "native") -> DataFrame:
    """(rule_id, name, source, dsl, text, error); a rule that doesn't parse has an error in place of its text."""
    rows = []
    for rule in rules:
        for dsl in dsls:
            try:
                rows.append((rule.id, rule.name, rule.expr, dsl, convert(rule.expr, dsl, frontend), None))
            except RuleError as e:
                rows.append((rule.id, rule.name, rule.expr, dsl, None, str(e)))
    return spark.createDataFrame(rows, "rule_id bigint, name string, source string, dsl string, text string, error string")
