"""Matching: which rules hold for which rows.

Two backends give the same result. `columns` lowers each rule to a boolean column: everything stays in generated code, for
up to COLUMN_RULES rules (above, generated code grows out of what is compiled). `bitmaps` is for many rules: an Arrow batch's
columns are read once, each distinct leaf of all rules is evaluated once over the batch (text leaves once for each distinct
value), and rules combine the leaves' bitmaps, 64 rows a word. Only the fields that rules read are scanned; neither plan
shuffles. Others can be registered by name.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ir import RuleError, fields
from ..plans.lower import Lowering
from . import bitmaps
from .rules import RuleSet

COLUMN_RULES = 8


class Backend(Protocol):
    """What evaluates a rule set: (keys, rule_ids) of each row, in order of priority, and rule_names if asked for."""

    def __call__(self, df: DataFrame, rules: RuleSet, keys: list[str], variant: str | None = None, with_names: bool = False) -> DataFrame: ...


def matched_ids(df: DataFrame, rules: RuleSet, variant: str | None = None) -> Column:
    """Ids of the rules that hold, in order of priority, as an array column of df."""
    lowering = Lowering(df, variant)
    hits = [F.when(lowering.predicate(p.node), F.lit(p.id).cast("long")) for p in rules]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<bigint>")


def _columns(df: DataFrame, rules: RuleSet, keys: list[str], variant: str | None = None, with_names: bool = False) -> DataFrame:
    wide = df.select(*keys, matched_ids(df, rules, variant).alias("rule_ids"))
    if not with_names:
        return wide
    pairs = [x for i, n in rules.names.items() for x in (F.lit(i).cast("long"), F.lit(n))]
    looked_up = F.transform("rule_ids", lambda i: F.element_at(F.create_map(*pairs), i)) if pairs else F.array().cast("array<string>")
    return wide.withColumn("rule_names", looked_up)


_BACKENDS: dict[str, Backend] = {"columns": _columns, "bitmaps": bitmaps.match_wide}


def register_backend(name: str, backend: Backend) -> None:
    _BACKENDS[name] = backend


def backends() -> list[str]:
    return sorted(_BACKENDS)


def match_wide(df: DataFrame, rules: RuleSet, keys: list[str], mode: str | None = None, variant: str | None = None, with_names: bool = False) -> DataFrame:
    """(keys, rule_ids) of each row, in order of priority; mode: a backend's name, else chosen by the number of rules."""
    mode = mode or ("columns" if len(rules) <= COLUMN_RULES else "bitmaps")
    if mode not in _BACKENDS:
        raise RuleError(f"unknown backend {mode!r}")
    return _BACKENDS[mode](df, rules, keys, variant, with_names)


def match_long(df: DataFrame, rules: RuleSet, keys: list[str], mode: str | None = None, variant: str | None = None) -> DataFrame:
    """(keys, place, rule_id, rule_name): a row for each hit; place 0 is the hit of the highest priority."""
    hits = match_wide(df, rules, keys, mode, variant, True).select(*keys, F.posexplode(F.arrays_zip("rule_ids", "rule_names")).alias("place", "hit"))
    return hits.select(*keys, "place", F.col("hit.rule_ids").alias("rule_id"), F.col("hit.rule_names").alias("rule_name"))


def numbered(df: DataFrame, key: str, position: str) -> DataFrame:
    """df with a key of 0 or null replaced by the row's position + 1."""
    return df.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit(0)), F.col(position) + 1))


def response(df: DataFrame, rules: RuleSet, key: str = "uid", variant: str | None = None) -> DataFrame:
    """(key, hits, rule_ids, rule_names) of each row."""
    return match_wide(df, rules, [key], None, variant, True).select(key, F.size("rule_ids").alias("hits"), "rule_ids", "rule_names")


def needed(rules: RuleSet, df: DataFrame) -> list[str]:
    """The columns of df that the rules read."""
    return [f for f in fields(*(p.node for p in rules)) if f in df.columns]
