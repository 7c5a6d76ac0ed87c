"""Headline queries on one machine; prints one line of JSON.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Each query runs once to warm up and is then timed. The
reference workload is 10,000 generated rules over 10,000 users, rules compiled and users in memory before the clock starts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from predica import queries
from predica.operators import match, stats
from predica.operators.rules import Rule, RuleSet
from predica.sources import generator

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("match_long", "match_wide_joined", "rule_hits", "stats_totals", "gate_all_rules", "explain_reasons", "like_contains", "time_usage_daily", "dynamic_json_fields", "stream_match")


def line_rules(n: int) -> RuleSet:
    """Rules over lineitem's columns."""
    flags, modes = "ANR", "FO"
    made = [f"l_quantity BETWEEN {i % 40} AND {i % 40 + 5 + i % 7} AND l_returnflag IN ('{flags[i % 3]}', '{flags[(i + 1) % 3]}') AND (l_discount >= 0.0{i % 9} OR NOT (l_linestatus = '{modes[i % 2]}')) AND l_extendedprice > {(i * 37) % 90000}" for i in range(n)]
    return RuleSet.load(Rule(i + 1, f"r{i}", text, i % 20) for i, text in enumerate(made))[0]


def timed(run) -> float:
    run()
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def drained(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}
    began = time.perf_counter()
    rules = RuleSet.load(generator.rules(10_000))[0]
    compiled = time.perf_counter() - began
    users = generator.users(spark, 10_000).repartition(int(CPUS)).cache()
    users.count()
    found["stats_10k_rules_10k_users"] = timed(lambda: stats.run_batch(users, rules))
    found["match_10k_rules_10k_users"] = timed(lambda: drained(match.match_wide(users, rules, ["uid"])))
    many = line_rules(2000)
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").repartition(int(CPUS))
    found["stats_2k_rules_lineitem"] = timed(lambda: stats.run_batch(lines, many))
    few = line_rules(50)
    found["match_50_rules_lineitem"] = timed(lambda: drained(match.match_wide(lines, few, ["l_orderkey", "l_linenumber"])))
    for name in HEADLINE:
        found[name] = timed(lambda: drained(queries.QUERIES[name](spark, SF_DIR)))
    rounded = {k: round(v, 4) for k, v in found.items()}
    evaluations = 10_000 * 10_000
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(found.values()), 4), "unit": "sec", "queries": rounded, "sf": os.path.basename(SF_DIR.rstrip("/")), "evaluations_per_sec_10k_x_10k": int(evaluations / found["match_10k_rules_10k_users"]), "counting_evaluations_per_sec_10k_x_10k": int(evaluations / found["stats_10k_rules_10k_users"]), "compile_10k_rules_sec": round(compiled, 4)}))


if __name__ == "__main__":
    main()
