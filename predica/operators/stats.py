"""Statistics of matching, as aggregates and as a text report."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lower import Lowering
from . import bitmaps
from .match import COLUMN_RULES, match_wide, matched_ids
from .rules import RuleSet

#: Up to so many rules, a report lists all of them.
LISTED_RULES = 50
#: Ranges of values whose running sums are made in parallel.
RANGES = 128


def rule_hits(df: DataFrame, rules: RuleSet, mode: str | None = None) -> DataFrame:
    """(rule_id, hits) of the rules with a hit. Tasks count first; a row for each rule and task is shuffled."""
    if (mode or ("columns" if len(rules) <= COLUMN_RULES else "bitmaps")) == "columns":
        return df.select(F.explode(matched_ids(df, rules)).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("hits"))
    counted = bitmaps.hits_by_rule(df, rules)
    return counted.where("rule_id != -1").groupBy("rule_id").agg(F.sum("hits").alias("hits"))


def top_rules(hits: DataFrame, n: int = 0) -> DataFrame:
    """The n rules with most hits (all if n isn't positive), then by id."""
    ordered = hits.orderBy(F.col("hits").desc(), "rule_id")
    return ordered.limit(n) if n > 0 else ordered


def totals(df: DataFrame, rules: RuleSet) -> DataFrame:
    """One row: users, rules, evaluations, hits, hit_rate (0 without evaluations). Hits are counted, not listed."""
    if len(rules) <= COLUMN_RULES:
        lowering = Lowering(df)
        each = sum((lowering.predicate(p.node).cast("int") for p in rules), F.lit(0))
        counted = df.select(each.alias("n")).agg(F.count("*").alias("users"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("hits"))
    else:  # rows count under the id -1
        part = bitmaps.hits_by_rule(df, rules)
        counted = part.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("n_rows", "users"), ("hits", "hits"))))
    evaluations = (F.col("users") * len(rules)).cast("long")
    return counted.select("users", F.lit(len(rules)).cast("long").alias("rules"), evaluations.alias("evaluations"), "hits", F.coalesce(F.try_divide(F.col("hits").cast("double"), evaluations), F.lit(0.0)).alias("hit_rate"))


def hit_counts(df: DataFrame, rules: RuleSet, key: str) -> DataFrame:
    """(key, hits) of each row."""
    return match_wide(df, rules, [key]).select(key, F.size("rule_ids").cast("long").alias("hits"))


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile of an array by nearest rank: element int(p * (n - 1) + 0.5) of the sorted values; null if it is empty."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.get(ordered, F.floor(p * (F.size(ordered) - 1) + 0.5).cast("int"))


def latency_percentiles(df: DataFrame, column: str, window: int = 4096, order: str | None = None) -> DataFrame:
    """One row: samples, p50, p90, p99 of the last `window` values by `order`, or of all values without an order."""
    rows = df.orderBy(F.col(order).desc()).limit(window) if order else df
    ranked = rows.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    if order:
        held = ranked.agg(F.collect_list("x").alias("xs"))
        return held.select(F.size("xs").cast("long").alias("samples"), *(nearest_rank(F.col("xs"), p / 100).alias(f"p{p}") for p in (50, 90, 99)))
    # Exact over any number of values: counts by value, whose running sums say which value has a rank. The sums run in
    # parallel, within ranges of values between approximate quantiles; only a row for each range is summed in one task.
    found = ranked.agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 100 * RANGES)).first()[0] or []
    cuts = F.array(*(F.lit(x) for x in sorted(set(found)))).cast("array<double>")
    counts = ranked.groupBy("x").count().withColumn("part", F.size(F.filter(cuts, lambda c: c <= F.col("x"))))
    parts = counts.groupBy("part").agg(F.sum("count").alias("own")).selectExpr("part", "sum(own) OVER (ORDER BY part) - own AS before", "sum(own) OVER () AS n")
    sums = counts.join(F.broadcast(parts), "part").selectExpr("x", "before + sum(count) OVER (PARTITION BY part ORDER BY x) AS upto", "n")
    rank = lambda p: F.floor(F.lit(p / 100) * (F.col("n") - 1) + 0.5) + 1
    return sums.agg(F.coalesce(F.max("n"), F.lit(0)).alias("samples"), *(F.min(F.when(F.col("upto") >= rank(p), F.col("x"))).alias(f"p{p}") for p in (50, 90, 99)))


@dataclass
class Stats:
    """Figures of a batch; rates are 0 where nothing was timed or evaluated."""

    users: int
    rules: int
    hits: int
    elapsed: float
    workers: int = 0
    per_rule: dict[int, int] = field(default_factory=dict)

    @property
    def evaluations(self) -> int:
        return self.users * self.rules

    @property
    def tps(self) -> float:
        return self.evaluations / self.elapsed if self.elapsed > 0 else 0.0

    @property
    def qps(self) -> float:
        return self.users / self.elapsed if self.elapsed > 0 else 0.0

    @property
    def hit_rate(self) -> float:
        return self.hits / self.evaluations if self.evaluations else 0.0

    @property
    def latency_ms(self) -> float:
        return self.elapsed * 1000 / self.users if self.users else 0.0

    def top_rules(self, n: int = 0) -> list[tuple[int, int]]:
        ranked = sorted(self.per_rule.items(), key=lambda x: (-x[1], x[0]))
        return ranked[:n] if n > 0 else ranked

    def report(self) -> str:
        lines = {
            "Worker": f"{self.workers}",
            "Total User": f"{self.users:,}",
            "Rule": f"{self.rules:,}",
            "Hit": f"{self.hits:,}",
            "Eval": f"{self.evaluations:,}",
            "Elapsed": _duration(self.elapsed),
            "TPS": f"{int(self.tps):,}",
            "QPS": f"{int(self.qps):,}",
            "Latency": f"{self.latency_ms:.3f}ms",
            "HitRate": f"{self.hit_rate * 100:.4f}%",
        }
        return "".join(f"{k}={v}\n" for k, v in lines.items())

    def rule_report(self, names: dict[int, str] | None = None) -> str:
        """A line for each rule with hits, by id."""
        out = ""
        for rule_id, n in sorted(self.per_rule.items()):
            name = (names or {}).get(rule_id)
            out += f"Rule{rule_id:<8} Hit {f'{n:,}':<8} {name}\n" if name else f"Rule{rule_id:<8} Hit {n:,}\n"
        return out


    def listing(self, names: dict[int, str] | None = None, top: int = 10) -> str:
        """Every rule's hits where there are few rules, else the `top` rules with most hits."""
        if self.rules <= LISTED_RULES:
            return self.rule_report(names)
        if top <= 0 or not self.per_rule:
            return ""
        lines = [f"  #{i} {(names or {}).get(i, ''):<12} hits={n:,}\n" for i, n in self.top_rules(top)]
        return f"Top {top} rules by hits:\n" + "".join(lines)


def _duration(seconds: float) -> str:
    """Whole milliseconds as text: 420ms, 4.2s, 1m3.5s."""
    ms = round(seconds * 1000)
    if ms < 1000:
        return f"{ms}ms" if ms else "0s"
    minutes, rest = divmod(ms, 60_000)
    hours, minutes = divmod(minutes, 60)
    text = f"{rest / 1000:.3f}".rstrip("0").rstrip(".") + "s"
    return f"{hours}h" * bool(hours) + f"{minutes}m" * bool(hours or minutes) + text


def run_batch(df: DataFrame, rules: RuleSet) -> Stats:
    """Matches all rows and returns the figures; only counts come back."""
    began = time.perf_counter()
    counted = bitmaps.hits_by_rule(df, rules).groupBy("rule_id").agg(F.sum("n_rows").alias("n"), F.sum("hits").alias("hits")).collect()
    per_rule = {r.rule_id: r.hits for r in counted if r.rule_id != -1}
    users = sum(r.n for r in counted if r.rule_id == -1)
    return Stats(users, len(rules), sum(per_rule.values()), time.perf_counter() - began, df.sparkSession.sparkContext.defaultParallelism, per_rule)
