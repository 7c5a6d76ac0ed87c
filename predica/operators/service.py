"""A facade over a rule store: single rows and batches, explanations, self-test, metrics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.emit import emit
from ..plans.ir import RuleError
from ..sources import frontends, io
from . import explain as _explain
from . import match as _match
from .rules import Manager, Rule, compile_rule
from .stats import Stats, run_batch

#: The built-in rule that uses every operator, and a row that satisfies it.
FLAGSHIP = (
    "age BETWEEN 25 AND 40 AND province IN ('广东','江苏','浙江') AND income_level NOT IN ('<5k','5k-10k') AND favorite_category LIKE '数%' "
    "AND occupation NOT LIKE '%学生%' AND active_score >= 85 AND credit_score BETWEEN 700 AND 850 AND total_amount > 5000 AND avg_order_amount <= 1000 "
    "AND last_login_time IS NOT NULL AND (vip_level >= 3 OR order_count >= 30) AND NOT (risk_level = '高') AND register_days >= 180 AND marital_status <> '未知'"
)
SAMPLE = {
    "age": 32,
    "province": "江苏",
    "income_level": "20k-30k",
    "favorite_category": "数码",
    "occupation": "工程师",
    "active_score": 90.5,
    "credit_score": 760,
    "total_amount": 22000.0,
    "avg_order_amount": 366.67,
    "last_login_time": "2026-06-26 21:15:00",
    "vip_level": 4,
    "order_count": 60,
    "risk_level": "低",
    "register_days": 400,
    "marital_status": "已婚",
}
SELF_TEST_ID = 990001
#: Requests a second and rows at once that callers of the service may count on; Spark's scheduler bounds the work itself.
MAX_CONCURRENCY = 200


@dataclass(frozen=True)
class SelfTest:
    rule: str
    sample: dict
    rule_id: int
    steps: tuple[tuple[str, int, tuple[int, ...]], ...]
    added: bool
    removed: bool


class RuleService:
    """Matching and explaining with the live rules of one Manager."""

    def __init__(self, spark: SparkSession, manager: Manager | None = None):
        self.spark, self.manager = spark, manager or Manager()

    def load(self, path: str) -> tuple[int, int]:
        return self.manager.load(io.read_rules(self.spark, path))

    def reload(self, path: str) -> tuple[int, int]:
        return self.manager.replace(io.read_rules(self.spark, path))

    @property
    def rule_count(self) -> int:
        return len(self.manager.live)

    def rule_name(self, rule_id: int) -> str | None:
        p = self.manager.live.get(rule_id)
        return p.rule.name if p else None

    def _row(self, row: Mapping) -> DataFrame:
        return io.users_of_records(self.spark, [dict(row) | {"_": 0}])

    def match(self, row: Mapping) -> list[int]:
        """Ids of the live rules that hold for one row; an empty list if none does."""
        return _match.match_wide(self._row(row), self.manager.live, ["_"]).first()["rule_ids"]

    def match_batch(self, users: DataFrame, key: str = "uid") -> DataFrame:
        return _match.response(users, self.manager.live, key)

    def run_batch(self, users: DataFrame) -> Stats:
        return run_batch(users, self.manager.live)

    def test(self, text: str, row: Mapping) -> bool:
        """Whether a draft holds for a row; live rules stay as they are."""
        program = compile_rule(Rule(0, expr=text), self.manager.frontend)
        df = self._row(row)
        return df.select(_explain.Explainer(df).passed(program.node)).first()[0]

    def evaluate(self, row: Mapping | None, rule: str = "", rule_id: int = 0) -> dict:
        """Of a rule's text, else a live rule, else the built-in rule: whether it holds for a row, and why not."""
        if not rule and rule_id:
            found = self.manager.live.get(rule_id)
            if found is None:
                raise RuleError(f"no rule {rule_id}")
            # As its own front-end reads it, before operands are joined: each failed part has a reason.
            node = found.rule.node if found.rule.node is not None else frontends.parse(found.rule.expr, self.manager.frontend)
            rule = found.rule.expr or emit(node)
        else:
            rule = rule or FLAGSHIP
            node = frontends.parse(rule)
        out = _explain.explain(self._row(row or {}), node, ["_"]).first()
        return {"passed": out.passed, "reasons": [r.asDict() for r in out.reasons], "rule": rule}

    def evaluate_all(self, uid: int, row: Mapping) -> dict:
        """The gate of all live rules for one row."""
        if not row:
            raise RuleError("a row is needed")
        out = _explain.gate(self._row(row), self.manager.live, ["_"]).first().asDict(True)
        return {"uid": uid} | {k: v for k, v in out.items() if k != "_"}

    def self_test(self, rule: str = "", row: Mapping | None = None) -> SelfTest:
        """Adds a rule and takes it out again, matching a row before, between and after."""
        rule, row = rule or FLAGSHIP, dict(row or SAMPLE)
        frontends.parse(rule)
        trace = [("before", self.rule_count, tuple(self.match(row)))]
        self.manager.upsert(Rule(SELF_TEST_ID, "selftest-complex", rule))
        trace.append(("after_add", self.rule_count, tuple(self.match(row))))
        self.manager.remove(SELF_TEST_ID)
        trace.append(("after_remove", self.rule_count, tuple(self.match(row))))
        return SelfTest(rule, row, SELF_TEST_ID, tuple(trace), SELF_TEST_ID in trace[1][2], SELF_TEST_ID not in trace[2][2])

    def metrics(self, latencies: DataFrame | None = None, column: str = "ms") -> str:
        """Figures in Prometheus text form; latencies: milliseconds of recent matches."""
        from .stats import latency_percentiles

        p = latency_percentiles(latencies, column).first() if latencies is not None else None
        gauges = [("rule_engine_rules", "Number of active compiled rules.", self.rule_count), ("rule_engine_versions", "Number of published rule-set versions.", len(self.manager.versions)), ("rule_engine_max_concurrency", "Max concurrent users.", MAX_CONCURRENCY)]
        text = "".join(f"# HELP {n} {h}\n# TYPE {n} gauge\n{n} {v}\n" for n, h, v in gauges)
        name = "rule_engine_match_latency_ms"
        text += f"# HELP {name} Match latency percentiles (recent window).\n# TYPE {name} gauge\n"
        for q, v in (("0.5", p and p.p50), ("0.9", p and p.p90), ("0.99", p and p.p99)):
            text += f'{name}{{quantile="{q}"}} {v or 0:.3f}\n'
        return text + f"rule_engine_match_latency_samples {p.samples if p else 0}\n"
