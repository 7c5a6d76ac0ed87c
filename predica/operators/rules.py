"""Rules, immutable rule sets and their management: upsert, test, publish, roll back."""

from __future__ import annotations

import dataclasses
import datetime
import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..plans.ir import Node, RuleError, check, optimize
from ..sources import frontends


@dataclass(frozen=True)
class Rule:
    id: int
    name: str = ""
    expr: str = ""
    priority: int = 0
    version: int = 0
    enabled: bool = True
    #: The parsed rule, where it doesn't come from text.
    node: Node | None = field(default=None, compare=False, repr=False)

    @staticmethod
    def of(x: dict) -> Rule:
        """The rule of a decoded JSON object: `rule` goes before `expr`, a missing `enabled` is true, other keys are ignored."""
        return Rule(int(x.get("id") or 0), x.get("name") or "", x.get("rule") or x.get("expr") or "", int(x.get("priority") or 0), int(x.get("version") or 0), x.get("enabled") is not False)

    def to_dict(self) -> dict:
        return {k: getattr(self, k) for k in ("id", "name", "expr", "priority", "version", "enabled")}


@dataclass(frozen=True)
class Program:
    """A compiled rule."""

    rule: Rule
    node: Node

    @property
    def id(self) -> int:
        return self.rule.id


def compile_rule(rule: Rule, frontend: str = "native") -> Program:
    return Program(rule, optimize(check(rule.node if rule.node is not None else frontends.parse(rule.expr, frontend))))


class RuleSet:
    """An immutable set of compiled rules, in order of priority (highest first), then id."""

    def __init__(self, programs: Iterable[Program] = (), frontend: str = "native"):
        self._by_id = {p.id: p for p in programs}
        self.programs = tuple(sorted(self._by_id.values(), key=lambda p: (-p.rule.priority, p.id)))
        self.frontend = frontend

    def __len__(self) -> int:
        return len(self.programs)

    def __iter__(self):
        return iter(self.programs)

    def get(self, rule_id: int) -> Program | None:
        return self._by_id.get(rule_id)

    @property
    def names(self) -> dict[int, str]:
        return {p.id: p.rule.name for p in self.programs}

    def merged(self, rules: Iterable[Rule]) -> tuple[RuleSet, int, int]:
        """(set with the enabled rules, loaded, failed); rules that don't compile are counted and left out, and a
        disabled rule leaves an older one of its id in place."""
        new, failed = [], 0
        for rule in rules:
            if rule.enabled:
                try:
                    new.append(compile_rule(rule, self.frontend))
                except RuleError:
                    failed += 1
        return RuleSet([*self._by_id.values(), *new], self.frontend), len(new), failed

    @staticmethod
    def load(rules: Iterable[Rule], frontend: str = "native") -> tuple[RuleSet, int, int]:
        return RuleSet(frontend=frontend).merged(rules)

    def with_rule(self, rule: Rule) -> RuleSet:
        if not rule.enabled:
            raise RuleError(f"rule {rule.id} is disabled")
        return RuleSet([*self._by_id.values(), compile_rule(rule, self.frontend)], self.frontend)

    def without(self, rule_id: int) -> RuleSet:
        return RuleSet([p for i, p in self._by_id.items() if i != rule_id], self.frontend)


@dataclass(frozen=True)
class Version:
    version: int
    time: datetime.datetime
    note: str
    rules: tuple[Rule, ...]

    @property
    def count(self) -> int:
        return len(self.rules)


class Manager:
    """The one store of an editable rule list, the live set made of it, and published versions."""

    def __init__(self, rules: Iterable[Rule] = (), frontend: str = "native"):
        self.frontend = frontend
        self.versions: list[Version] = []
        self.replace(rules)

    def replace(self, rules: Iterable[Rule]) -> tuple[int, int]:
        """Swaps the whole set; (loaded, failed)."""
        self._rules = {r.id: r for r in rules}
        self.live, loaded, failed = RuleSet.load(self._rules.values(), self.frontend)
        return loaded, failed

    def load(self, rules: Iterable[Rule]) -> tuple[int, int]:
        """Adds rules to the set; (loaded, failed)."""
        rules = list(rules)
        self.live, loaded, failed = self.live.merged(rules)
        self._rules |= {r.id: r for r in rules}
        return loaded, failed

    def list(self) -> list[Rule]:
        return sorted(self._rules.values(), key=lambda r: r.id)

    def upsert(self, rule: Rule) -> Rule:
        """Adds or replaces a rule. Its version is one more than before, unless it brings a higher one."""
        if not rule.id:
            raise RuleError("a rule needs an id")
        before = self._rules.get(rule.id)
        rule = dataclasses.replace(rule, version=max(rule.version, before.version + 1 if before else 1))
        self.live = self.live.with_rule(rule) if rule.enabled else self.live.without(rule.id)
        self._rules[rule.id] = rule
        return rule

    def remove(self, rule_id: int) -> None:
        self.live = self.live.without(rule_id)
        self._rules.pop(rule_id, None)

    def publish(self, note: str = "") -> Version:
        version = Version(len(self.versions) + 1, datetime.datetime.now(datetime.timezone.utc), note, tuple(self.list()))
        self.versions.append(version)
        return version

    def rollback(self, version: int) -> None:
        found = next((v for v in self.versions if v.version == version), None)
        if found is None:
            raise RuleError(f"no version {version}")
        self.replace(found.rules)


RULE_SCHEMA = "id bigint, name string, expr string, priority int, version int, enabled boolean"


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as a table."""
    return spark.createDataFrame([tuple(r.to_dict().values()) for r in rules], RULE_SCHEMA)


def rules_of(df: DataFrame) -> list[Rule]:
    """Rules of a table; a rule table is small by nature, as each rule becomes part of a plan."""
    return [Rule.of(r.asDict()) for r in df.collect()]


def versions_frame(spark: SparkSession, manager: Manager) -> DataFrame:
    rows = [(v.version, v.time, v.note, v.count, json.dumps([r.to_dict() for r in v.rules], ensure_ascii=False)) for v in manager.versions]
    return spark.createDataFrame(rows, "version int, time timestamp, note string, count int, rules string")
