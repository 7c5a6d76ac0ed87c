"""The queries of the driver contract for the rule engine, and DuckDB SQL of each."""

from __future__ import annotations

import dataclasses
import datetime
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import helpers
from .functions.text import number_text
from .operators import explain as ex
from .operators import match as mt
from .operators import stats as st
from .operators.rules import Manager, Rule, RuleSet, compile_rule, rules_frame, versions_frame
from .operators.service import FLAGSHIP, SAMPLE, RuleService
from .operators.translate import export, export_text
from .plans.ir import RuleError, fields
from .plans.lower import Lowering, filter_rows
from .sources import frontends, generator, io
from .sources.decision_table import DecisionTable
from .sources.decision_table import load as load_table
from .streaming import match as sm
from .streaming import usage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Predicates: a rule over a table, with a missing value for one segment -----------------------------------

#: Tables as rules see them, in Spark and in DuckDB. Some values are made null, so missing fields occur.
_VIEWS = {
    "customer": (lambda df: df.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))).withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))), "c_custkey", "(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 != 0 THEN c_acctbal END AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"),
    "part": (lambda df: df.withColumn("p_brand", F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand"))), "p_partkey", "(SELECT p_partkey, p_name, CASE WHEN p_partkey % 11 != 0 THEN p_brand END AS p_brand, p_type, p_size, p_retailprice FROM part)"),
    # Some types have an underscore where others have a letter.
    "underscored": (lambda df: df.withColumn("p_type", F.when(F.col("p_partkey") % 2 == 0, F.translate("p_type", "E", "_")).otherwise(F.col("p_type"))), "p_partkey", "(SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_type, 'E', '_') ELSE p_type END AS p_type FROM part)"),
    "events": (lambda df: df, "event_id", "events"),
    "orders": (lambda df: df, "o_orderkey", "orders"),
}


def _filter(name: str, view: str, rule: str, where: str, frontend: str = "native") -> None:
    """A query that keeps the rows for which a rule holds; `where` is its two-valued SQL."""
    change, key, source = _VIEWS[view]
    name_of = {"underscored": "part"}.get(view, view)
    _add(name, lambda spark, d: filter_rows(change(table(spark, d, name_of)), frontends.parse(rule, frontend)).select(key), f"SELECT {key} FROM {source} WHERE coalesce({where}, false)")


for _op, _sign in {"eq": "=", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items():
    _filter(f"cmp_{_op}_number", "customer", f"c_nationkey {_sign} 12", f"c_nationkey {_sign} 12")
    _filter(f"cmp_{_op}_double", "part", f"p_retailprice {_sign} 901.5", f"p_retailprice {_sign} 901.5")
    _filter(f"cmp_{_op}_text", "customer", f"c_mktsegment {_sign} 'FURNITURE'", f"c_mktsegment {_sign} 'FURNITURE'")
_filter("cmp_double_equals", "customer", "c_nationkey == 3", "c_nationkey = 3")
_filter("cmp_angle_ne", "customer", "c_nationkey <> 3", "c_nationkey <> 3")
_filter("between_numeric", "part", "p_size BETWEEN 10 AND 20", "p_size BETWEEN 10 AND 20")
_filter("between_double", "customer", "c_acctbal BETWEEN 0 AND 99.5", "c_acctbal BETWEEN 0 AND 99.5")
_filter("between_on_text_is_false", "customer", "c_name BETWEEN 1 AND 5", "false")
_filter("in_text", "customer", "c_mktsegment IN ('MACHINERY', 'FURNITURE')", "c_mktsegment IN ('MACHINERY', 'FURNITURE')")
_filter("in_number_raw_text", "part", "p_size IN (1, 2.0, '3', 04)", "p_size IN (1, 3)")
_filter("not_in_null", "customer", "c_mktsegment NOT IN ('MACHINERY')", "NOT coalesce(c_mktsegment IN ('MACHINERY'), false)")
_filter("like_prefix", "part", "p_brand LIKE 'Brand#1%'", "starts_with(p_brand, 'Brand#1')")
_filter("like_suffix", "part", "p_brand LIKE '%3'", "ends_with(p_brand, '3')")
_filter("like_contains", "part", "p_name LIKE '%l w%'", "contains(p_name, 'l w')")
_filter("like_exact", "part", "p_brand LIKE 'Brand#13'", "p_brand = 'Brand#13'")
_filter("like_underscore_literal", "underscored", "p_type LIKE 'M_D%'", "starts_with(p_type, 'M_D')")
_filter("like_number_text", "part", "p_retailprice LIKE '%.5'", "ends_with(CAST(p_retailprice AS VARCHAR), '.5')")
_filter("not_like_null", "part", "p_brand NOT LIKE 'Brand#1%'", "NOT coalesce(starts_with(p_brand, 'Brand#1'), false)")
_filter("is_null", "customer", "c_mktsegment IS NULL", "c_mktsegment IS NULL")
_filter("is_not_null", "customer", "c_mktsegment IS NOT NULL", "c_mktsegment IS NOT NULL")
_filter("absent_column", "customer", "phone IS NULL AND NOT (phone = 'x') AND c_nationkey < 5", "c_nationkey < 5")
_filter("and_or_precedence", "events", "event_type = 'click' OR event_type = 'view' AND value > 50", "event_type = 'click' OR event_type = 'view' AND value > 50")
_filter("not_group", "events", "NOT (event_type = 'click' OR value <= 50)", "NOT (event_type = 'click' OR value <= 50)")
_filter("not_binds_tighter", "events", "NOT event_type = 'click' AND value > 20", "(NOT event_type = 'click') AND value > 20")
_filter("two_valued_not", "customer", "NOT (c_mktsegment = 'MACHINERY' AND c_acctbal > 0)", "NOT (coalesce(c_mktsegment = 'MACHINERY', false) AND coalesce(c_acctbal > 0, false))")
_filter("text_fallback_order", "part", "p_brand > 5", "p_brand > '5'")
_filter("text_fallback_number_column", "part", "p_size >= '5'", "CAST(p_size AS VARCHAR) >= '5'")
_filter("timestamp_as_text", "orders", "o_orderdate >= '1995-06-17' AND o_orderdate < '1996'", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') >= '1995-06-17' AND strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') < '1996'")
_filter("json_frontend", "customer", json.dumps({"and": [{"field": "c_nationkey", "op": "between", "values": [3, 20]}, {"or": [{"field": "c_mktsegment", "op": "notlike", "value": "%U%"}, {"not": {"field": "c_acctbal", "op": ">", "value": 500}}]}]}), "c_nationkey BETWEEN 3 AND 20 AND (NOT coalesce(contains(c_mktsegment, 'U'), false) OR NOT coalesce(c_acctbal > 500, false))", "json")
_filter("cel_frontend", "customer", "c_nationkey in [1, 2, 3, 4] && !c_mktsegment.startsWith('M') || c_acctbal < -500.0", "c_nationkey IN (1, 2, 3, 4) AND NOT coalesce(starts_with(c_mktsegment, 'M'), false) OR coalesce(c_acctbal < -500, false)", "cel")
_filter("expr_frontend", "customer", 'c_nationkey not in [1, 2] and (hasSuffix(c_mktsegment, "E") or c_acctbal >= 9000)', "c_nationkey NOT IN (1, 2) AND (coalesce(ends_with(c_mktsegment, 'E'), false) OR coalesce(c_acctbal >= 9000, false))", "expr")
_filter("qlbridge_frontend", "customer", "c_mktsegment = MACHINERY OR c_nationkey BETWEEN 1 AND 3", "coalesce(c_mktsegment = 'MACHINERY', false) OR c_nationkey BETWEEN 1 AND 3", "qlbridge")


# --- Matching, statistics, gates ------------------------------------------------------------------------------

RULES = [
    Rule(1, "rich", "c_acctbal >= 5000", 10),
    Rule(2, "machinery", "c_mktsegment = 'MACHINERY'", 5),
    Rule(3, "far", "c_nationkey IN (20, 21, 22, 23, 24)", 5),
    Rule(4, "not auto", "NOT (c_mktsegment = 'AUTOMOBILE')", 1),
    Rule(5, "in debt", "c_acctbal < 0 AND c_mktsegment IS NOT NULL", 20),
    Rule(6, "unlabelled", "c_mktsegment IS NULL OR c_name LIKE '%7'", 10),
    Rule(7, "off", "c_nationkey >= 0", 99, enabled=False),
    Rule(8, "broken", "c_nationkey BETWEEN 'a' AND 'b'"),
]
_SQL = {1: "c_acctbal >= 5000", 2: "c_mktsegment = 'MACHINERY'", 3: "c_nationkey IN (20, 21, 22, 23, 24)", 4: "NOT coalesce(c_mktsegment = 'AUTOMOBILE', false)", 5: "c_acctbal < 0 AND c_mktsegment IS NOT NULL", 6: "c_mktsegment IS NULL OR ends_with(c_name, '7')"}
_ORDER = (5, 1, 6, 2, 3, 4)
_CUSTOMER = _VIEWS["customer"][2]
_LONG = " UNION ALL ".join(f"SELECT c_custkey, {i} AS rule_id, {_ORDER.index(i)} AS sorted FROM {_CUSTOMER} c{i} WHERE coalesce({w}, false)" for i, w in _SQL.items())
_NAMES = "(VALUES " + ", ".join(f"({r.id}, '{r.name}')" for r in RULES) + ") AS names(id, name)"


def rule_set() -> RuleSet:
    return RuleSet.load(RULES)[0]


def customers(spark: SparkSession, d: str) -> DataFrame:
    return _VIEWS["customer"][0](table(spark, d, "customer"))


def _long(mode: str) -> Query:
    return lambda spark, d: mt.match_long(customers(spark, d), rule_set(), ["c_custkey"], mode)


_LONG_SQL = f"SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY sorted) - 1 AS INTEGER) AS place, CAST(rule_id AS BIGINT) AS rule_id, name AS rule_name FROM ({_LONG}) h JOIN {_NAMES} ON names.id = h.rule_id"
_add("match_long", _long("columns"), _LONG_SQL)
_add("match_long_bitmaps", _long("bitmaps"), _LONG_SQL)
_WIDE_SQL = f"SELECT c.c_custkey, coalesce(ids, '') AS ids FROM customer c LEFT JOIN (SELECT c_custkey, string_agg(rule_id, ',' ORDER BY sorted) AS ids FROM ({_LONG}) h GROUP BY c_custkey) x ON x.c_custkey = c.c_custkey"
_add("match_wide_joined", lambda spark, d: mt.match_wide(customers(spark, d), rule_set(), ["c_custkey"], "columns").select("c_custkey", F.array_join("rule_ids", ",").alias("ids")), _WIDE_SQL)
_add("match_wide_bitmaps", lambda spark, d: mt.match_wide(customers(spark, d), rule_set(), ["c_custkey"], "bitmaps").select("c_custkey", F.array_join("rule_ids", ",").alias("ids")), _WIDE_SQL)
_add("match_response", lambda spark, d: mt.response(customers(spark, d), rule_set(), "c_custkey").select("c_custkey", "hits", F.array_join("rule_names", "|").alias("names")), f"SELECT c.c_custkey, CAST(coalesce(hits, 0) AS INTEGER) AS hits, coalesce(said, '') AS names FROM customer c LEFT JOIN (SELECT c_custkey, count(*) AS hits, string_agg(name, '|' ORDER BY sorted) AS said FROM ({_LONG}) h JOIN {_NAMES} ON names.id = h.rule_id GROUP BY c_custkey) x ON x.c_custkey = c.c_custkey")
_add("match_zero_key", lambda spark, d: mt.numbered(customers(spark, d).withColumn("uid", F.col("c_custkey") % 5).withColumn("position", F.col("c_custkey") - 1), "uid", "position").groupBy("uid").agg(F.count("*").alias("n")), "SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey % 5 END AS uid, count(*) AS n FROM customer GROUP BY 1")
_HITS = f"SELECT CAST(rule_id AS BIGINT) AS rule_id, count(*) AS hits FROM ({_LONG}) h GROUP BY rule_id"
_add("rule_hits", lambda spark, d: st.rule_hits(customers(spark, d), rule_set(), "columns"), _HITS)
_add("rule_hits_bitmaps", lambda spark, d: st.rule_hits(customers(spark, d), rule_set(), "bitmaps"), _HITS)
_add("top_rules", lambda spark, d: st.top_rules(st.rule_hits(customers(spark, d), rule_set()), 3), f"{_HITS} ORDER BY hits DESC, rule_id LIMIT 3")
_add("stats_totals", lambda spark, d: st.totals(customers(spark, d), rule_set()), f"SELECT users, CAST(6 AS BIGINT) AS rules, users * 6 AS evaluations, hits, hits / (users * 6.0)::DOUBLE AS hit_rate FROM (SELECT (SELECT count(*) FROM customer) AS users, count(*) AS hits FROM ({_LONG}) h)")
_add("hit_rate", lambda spark, d: st.totals(customers(spark, d), rule_set()).select(F.round("hit_rate", 9).alias("hit_rate")), f"SELECT round(count(*) / (6.0 * (SELECT count(*) FROM customer))::DOUBLE, 9) AS hit_rate FROM ({_LONG}) h")
_add("per_user_hits", lambda spark, d: st.hit_counts(customers(spark, d), rule_set(), "c_custkey"), f"SELECT c.c_custkey, count(rule_id) AS hits FROM customer c LEFT JOIN ({_LONG}) h ON h.c_custkey = c.c_custkey GROUP BY c.c_custkey")
_add("latency_percentiles", lambda spark, d: st.latency_percentiles(table(spark, d, "events"), "value"), "SELECT count(*) AS samples, list_sort(list(value))[CAST(floor(0.5 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p90, list_sort(list(value))[CAST(floor(0.99 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p99 FROM events")
_add("latency_window", lambda spark, d: st.latency_percentiles(table(spark, d, "events"), "value", 512, "event_id"), "WITH w AS (SELECT value FROM events ORDER BY event_id DESC LIMIT 512) SELECT count(*) AS samples, list_sort(list(value))[CAST(floor(0.5 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p90, list_sort(list(value))[CAST(floor(0.99 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p99 FROM w")

GATE = [Rule(31, "a", "c_nationkey >= 5", 2), Rule(32, "b", "c_mktsegment IS NOT NULL", 1), Rule(33, "c", "c_acctbal > 1000 OR c_nationkey IN (6, 7)")]
_GATE_SQL = "SELECT c_custkey, c_nationkey >= 5 AS a, c_mktsegment IS NOT NULL AS b, coalesce(c_acctbal > 1000, false) OR c_nationkey IN (6, 7) AS c FROM " + _CUSTOMER
_add("gate_all_rules", lambda spark, d: ex.gate(customers(spark, d), RuleSet.load(GATE)[0], ["c_custkey"], False).select("c_custkey", "total_rules", "passed_count", "failed_count", "passed", F.array_join("failed_rule_ids", ",").alias("failed")), f"SELECT c_custkey, 3 AS total_rules, CAST(a::INT + b::INT + c::INT AS INTEGER) AS passed_count, CAST(3 - (a::INT + b::INT + c::INT) AS INTEGER) AS failed_count, a AND b AND c AS passed, concat_ws(',', CASE WHEN NOT a THEN '31' END, CASE WHEN NOT b THEN '32' END, CASE WHEN NOT c THEN '33' END) AS failed FROM ({_GATE_SQL})")
_add("gate_without_rules", lambda spark, d: ex.gate(customers(spark, d), RuleSet(), ["c_custkey"], False).select("c_custkey", "passed"), "SELECT c_custkey, false AS passed FROM customer")
_EXPLAINED = "c_nationkey >= 5 AND c_mktsegment IN ('MACHINERY', 'FURNITURE') AND NOT (c_nationkey = 7) AND (c_nationkey BETWEEN 1 AND 9 OR c_mktsegment LIKE 'F%')"
_add(
    "explain_reasons",
    lambda spark, d: ex.explain(customers(spark, d), frontends.parse(_EXPLAINED), ["c_custkey"]).select("c_custkey", "passed", F.array_join(F.transform("reasons", lambda r: F.concat(r["expr"], F.lit(" => "), r["detail"])), " | ").alias("why")),
    f"""WITH r AS (SELECT c_custkey, coalesce(c_mktsegment, '<null>') AS seg, c_nationkey AS n,
      CASE WHEN NOT c_nationkey >= 5 THEN concat('c_nationkey >= 5 => c_nationkey=', c_nationkey, ' does not satisfy >= 5') END AS w1,
      CASE WHEN NOT coalesce(c_mktsegment IN ('MACHINERY', 'FURNITURE'), false) THEN concat('c_mktsegment IN (''MACHINERY'', ''FURNITURE'') => c_mktsegment=', seg, ' is not in the allowed set') END AS w2,
      CASE WHEN c_nationkey = 7 THEN 'NOT (c_nationkey = 7) => the negated condition was satisfied' END AS w3,
      CASE WHEN NOT (c_nationkey BETWEEN 1 AND 9 OR coalesce(starts_with(c_mktsegment, 'F'), false)) THEN concat('c_nationkey BETWEEN 1 AND 9 OR c_mktsegment LIKE ''F%'' => no OR alternative held — c_nationkey=', c_nationkey, ' is outside [1, 9]; c_mktsegment=', seg, ' does not match pattern ''F%''') END AS w4
      FROM {_CUSTOMER})
    SELECT c_custkey, w1 IS NULL AND w2 IS NULL AND w3 IS NULL AND w4 IS NULL AS passed, concat_ws(' | ', w1, w2, w3, w4) AS why FROM r""",
)
_add("explain_walker", lambda spark, d: ex.explain(customers(spark, d), frontends.parse("c_acctbal < 30 AND c_mktsegment != 'FURNITURE' AND NOT (c_nationkey == 3)"), ["c_custkey"], compat="ast").select("c_custkey", "passed"), f"SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN '' < '30' ELSE c_acctbal < 30 END AND coalesce(c_mktsegment, '') <> 'FURNITURE' AS passed FROM {_CUSTOMER}")
_TABLE = {"name": "t", "id_base": 7000, "rows": [{"name": "r0", "priority": 1, "when": [{"field": "c_nationkey", "op": "between", "values": [1, 8]}, {"field": "c_acctbal", "op": ">=", "value": -100}]}, {"name": "off", "enabled": False, "when": [{"field": "c_nationkey", "op": "=", "value": 1}]}, {"name": "r2", "priority": 5, "when": [{"field": "c_mktsegment", "op": "in", "values": ["MACHINERY", "AUTOMOBILE"]}]}]}
_add("decision_table", lambda spark, d: mt.match_long(customers(spark, d), RuleSet.load(DecisionTable.of(_TABLE).rules())[0], ["c_custkey"]).select("c_custkey", "rule_id", "rule_name"), f"SELECT c_custkey, CAST(7000 AS BIGINT) AS rule_id, 'r0' AS rule_name FROM {_CUSTOMER} a WHERE c_nationkey BETWEEN 1 AND 8 AND c_acctbal >= -100 UNION ALL SELECT c_custkey, 7002, 'r2' FROM {_CUSTOMER} b WHERE c_mktsegment IN ('MACHINERY', 'AUTOMOBILE')")


# --- Rule management, translation -----------------------------------------------------------------------------

def _versions(spark: SparkSession, d: str) -> DataFrame:
    manager = Manager()
    for rule in RULES[:3]:
        manager.upsert(rule)
    manager.publish("three")
    manager.upsert(Rule(1, "rich", "c_acctbal >= 9000", 10))
    manager.remove(2)
    manager.publish("two")
    manager.rollback(1)
    manager.publish("three again")
    return versions_frame(spark, manager).select("version", "note", "count")


def _rolled_back(spark: SparkSession, d: str) -> DataFrame:
    manager = Manager(RULES[:2])
    manager.publish("first")
    manager.upsert(Rule(1, "rich", "c_acctbal >= 0"))
    manager.remove(2)
    manager.rollback(1)
    return st.rule_hits(customers(spark, d), manager.live)


_add("rule_versions", _versions, "SELECT * FROM (VALUES (1, 'three', 3), (2, 'two', 2), (3, 'three again', 3)) AS v(version, note, count)")
_add("rule_rollback", _rolled_back, f"SELECT * FROM ({_HITS}) WHERE rule_id IN (1, 2)")
_add("rule_list", lambda spark, d: rules_frame(spark, Manager(RULES).list()).select("id", "name", "priority", "enabled"), "SELECT * FROM (VALUES " + ", ".join(f"(CAST({r.id} AS BIGINT), '{r.name}', {r.priority}, {str(r.enabled).lower()})" for r in RULES) + ") AS v(id, name, priority, enabled)")
_add("dsl_export", lambda spark, d: export(spark, [*RULES[:6], Rule(9, "bad", "c_name >")]).select("rule_id", "dsl", "text"), "SELECT CAST(rule_id AS BIGINT) AS rule_id, dsl, text FROM (VALUES " + ", ".join("({}, '{}', {})".format(i, dsl, "NULL" if t is None else "'" + t.replace("'", "''") + "'") for i, dsl, t in [
    (1, "sql", "c_acctbal >= 5000"), (1, "aviator", "c_acctbal >= 5000"), (1, "cel", "c_acctbal >= 5000"), (1, "expr", "c_acctbal >= 5000"),
    (2, "sql", "c_mktsegment = 'MACHINERY'"), (2, "aviator", "c_mktsegment == 'MACHINERY'"), (2, "cel", "c_mktsegment == 'MACHINERY'"), (2, "expr", 'c_mktsegment == "MACHINERY"'),
    (3, "sql", "c_nationkey IN (20, 21, 22, 23, 24)"), (3, "aviator", "(c_nationkey == 20 || c_nationkey == 21 || c_nationkey == 22 || c_nationkey == 23 || c_nationkey == 24)"), (3, "cel", "c_nationkey in [20, 21, 22, 23, 24]"), (3, "expr", "c_nationkey in [20, 21, 22, 23, 24]"),
    (4, "sql", "NOT (c_mktsegment = 'AUTOMOBILE')"), (4, "aviator", "!(c_mktsegment == 'AUTOMOBILE')"), (4, "cel", "!(c_mktsegment == 'AUTOMOBILE')"), (4, "expr", '!(c_mktsegment == "AUTOMOBILE")'),
    (5, "sql", "c_acctbal < 0 AND c_mktsegment IS NOT NULL"), (5, "aviator", "c_acctbal < 0 && c_mktsegment != nil"), (5, "cel", "c_acctbal < 0 && has(c_mktsegment)"), (5, "expr", "c_acctbal < 0 && c_mktsegment != nil"),
    (6, "sql", "c_mktsegment IS NULL OR c_name LIKE '%7'"), (6, "aviator", "c_mktsegment == nil || string.endsWith(c_name, '7')"), (6, "cel", "!has(c_mktsegment) || c_name.endsWith('7')"), (6, "expr", 'c_mktsegment == nil || hasSuffix(c_name, "7")'),
    (9, "sql", None), (9, "aviator", None), (9, "cel", None), (9, "expr", None)]) + ") AS v(rule_id, dsl, text)")


# --- Dynamic rows, sources and sinks --------------------------------------------------------------------------

def _dynamic(spark: SparkSession, d: str) -> DataFrame:
    rows = io.users_of_json(table(spark, d, "events"), "props")
    return rows.where(Lowering(rows, "fields").condition(frontends.parse("k >= 50 AND NOT (missing = 1)"))).select("event_id")


_add("dynamic_json_fields", _dynamic, "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rules through a JSON file."""
    folder = io.shared_folder(spark, "rules")
    io.write_rules(spark, RULES, folder)
    loaded = io.read_rules(spark, folder)
    return st.rule_hits(customers(spark, d), RuleSet.load(loaded)[0])


_add("rules_file_round_trip", _round_trip, _HITS)


def _generated(spark: SparkSession, d: str) -> DataFrame:
    rules, loaded, failed = RuleSet.load(generator.rules(60, 1))
    users = generator.users(spark, 2000, 1)
    a = st.rule_hits(users, rules, "bitmaps")
    b = st.rule_hits(users, rules, "columns").toDF("rule_id", "same")
    out = a.join(b, "rule_id", "full").agg(F.sum(F.when(F.col("hits") == F.col("same"), 0).otherwise(1)).alias("different"))
    return out.select(F.lit(loaded).alias("loaded"), F.lit(failed).alias("failed"), F.coalesce("different", F.lit(0)).alias("different"))


_add("generated_rules_agree", _generated, "SELECT 60 AS loaded, 0 AS failed, CAST(0 AS BIGINT) AS different")


# --- Functions ------------------------------------------------------------------------------------------------

_add("fn_has_prefix", lambda spark, d: _VIEWS["part"][0](table(spark, d, "part")).select("p_partkey", helpers.has_prefix(F.col("p_brand"), "Brand#2").alias("said")), f"SELECT p_partkey, coalesce(starts_with(p_brand, 'Brand#2'), false) AS said FROM {_VIEWS['part'][2]}")
_add("fn_in_set", lambda spark, d: _VIEWS["part"][0](table(spark, d, "part")).select("p_partkey", helpers.in_set(F.col("p_brand"), "Brand#11", "Brand#23").alias("said")), f"SELECT p_partkey, coalesce(p_brand IN ('Brand#11', 'Brand#23'), false) AS said FROM {_VIEWS['part'][2]}")
_add("fn_round2", lambda spark, d: table(spark, d, "events").select("event_id", helpers.round2(F.col("value")).alias("r"), helpers.round2_up(F.col("value")).alias("u")), "SELECT event_id, round(value * 100) / 100 AS r, trunc(value * 100 + 0.5) / 100 AS u FROM events")
_add("fn_mask_value", lambda spark, d: table(spark, d, "customer").select("c_custkey", helpers.mask_value(F.when(F.col("c_custkey") % 2 == 0, F.lit("EMAIL")).otherwise(F.lit("COLOUR")), F.col("c_name")).alias("masked")), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND length(c_name) > 5 THEN substr(c_name, 1, 5) || repeat('*', length(c_name) - 5) ELSE c_name END AS masked FROM customer")
_add("fn_mask_request", lambda spark, d: table(spark, d, "customer").select("c_custkey", helpers.mask_request(F.concat(F.lit('{"customerName":"n","data":[{"item":{"fieldId":"QQ","fieldValue":"'), F.col("c_name"), F.lit('"},"bind":true}]}'))).alias("body")), "SELECT c_custkey, '{\"customerName\":\"n\",\"data\":[{\"item\":{\"fieldId\":\"QQ\",\"fieldValue\":\"' || CASE WHEN length(c_name) > 5 THEN substr(c_name, 1, 5) || repeat('*', length(c_name) - 5) ELSE c_name END || '\"},\"bind\":true}]}' AS body FROM customer")
_add("fn_interval_seconds", lambda spark, d: table(spark, d, "events").select("event_id", helpers.interval_seconds(F.get(F.array(*map(F.lit, ["second", " Min ", "HOURS", "d", "year"])), (F.col("event_id") % 5).cast("int")), F.col("event_id") % 9).alias("seconds")), "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 END * (event_id % 9) AS seconds FROM events")
_add("fn_number_text", lambda spark, d: table(spark, d, "part").select("p_partkey", number_text(F.col("p_retailprice") / F.lit(8)).alias("said")), "SELECT p_partkey, regexp_replace(CAST(p_retailprice / 8 AS VARCHAR), '\\.0$', '') AS said FROM part")
_add("fn_null_helpers", lambda spark, d: table(spark, d, "nation").select("n_nationkey", helpers.zero_to_null(F.col("n_regionkey")).alias("r"), helpers.null_int32(helpers.zero_to_null(F.col("n_regionkey"))).alias("m"), helpers.or_default(helpers.zero_to_null(F.col("n_regionkey")), 9).alias("o")), "SELECT n_nationkey, nullif(n_regionkey, 0) AS r, coalesce(nullif(n_regionkey, 0), -1) AS m, coalesce(nullif(n_regionkey, 0), 9) AS o FROM nation")
_add("fn_time_text", lambda spark, d: table(spark, d, "orders").select("o_orderkey", helpers.time_text(F.col("o_orderdate")).alias("said"), (helpers.flexible_time(helpers.time_text(F.col("o_orderdate"))) == F.col("o_orderdate")).alias("back")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS said, true AS back FROM orders")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    clob = F.concat(F.lit('{"Z":{"fieldId":"Z","fieldName":"'), F.col("n_name"), F.lit('","valid":true},"B":{"fieldId":"B","fieldName":"b","valid":false},"A":{"fieldId":"A","fieldName":"a","valid":true},"C":{"fieldId":"","valid":true}}'))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(helpers.valid_question_infos(clob), lambda q: F.concat(q["fieldId"], F.lit(":"), q["fieldName"])), ",").alias("said"), F.size(helpers.valid_questions(clob)).alias("n"))


def _translations(spark: SparkSession, d: str) -> DataFrame:
    clob = F.concat(F.lit('{"EN":[{"fieldId":"a","fieldTranslation":"old"},{"fieldId":"a","fieldTranslation":"'), F.col("n_name"), F.lit('"}],"ZH":[{"fieldId":"a","fieldTranslation":"zh"}]}'))
    language = F.get(F.array(F.lit("EN"), F.lit("ZH"), F.lit("FR")), F.col("n_nationkey") % 3)
    return table(spark, d, "nation").select("n_nationkey", F.try_element_at(helpers.translations(clob, language), F.lit("a")).alias("said"))


_add("fn_questions", _questions, "SELECT n_nationkey, 'A:a,Z:' || n_name AS said, 3 AS n FROM nation")
_add("fn_translations", _translations, "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'zh' ELSE n_name END AS said FROM nation")
_add("fn_profile_missing", lambda spark, d: table(spark, d, "nation").select("n_nationkey", helpers.profile_missing(F.when(F.col("n_nationkey") % 2 == 0, F.lit("x.profile.data_not_found y"))).alias("said")), "SELECT n_nationkey, n_nationkey % 2 = 0 AS said FROM nation")


# --- Usage and streams ----------------------------------------------------------------------------------------

_KEYS = {"daily": "strftime(ts, '%Y-%m-%d')", "weekly": "strftime(ts, '%G-W%V')", "monthly": "strftime(ts, '%Y-%m')"}
for _period, _key in _KEYS.items():
    _add(f"time_usage_{_period}", lambda spark, d, p=_period: usage.usage(table(spark, d, "events").withColumn("sec", F.floor("value").cast("long")), ["user_id"], "ts", "sec", p), f"SELECT user_id, {_key} AS period_key, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS usage_sec, count(*) AS beats FROM events GROUP BY ALL")


def _drained(spark: SparkSession, d: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a stream over a table's files has written, and in which micro-batch, after all of them have been read once.

    Each micro-batch overwrites the folder of its own number, so a repeated one adds nothing.
    """
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet")
    rows = source.parquet(f"{d}/event[s].parquet")  # a stream's path is a folder or a pattern
    folder = io.shared_folder(spark, "stream")

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    out = transform(rows)
    out.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


EVENT_RULES = [Rule(1, "clicks", "event_type = 'click'"), Rule(2, "large", "value >= 50", 3), Rule(3, "neither", "NOT (event_type = 'click' OR value >= 50)")]
_add("stream_match", lambda spark, d: _drained(spark, d, lambda rows: sm.match_stream(rows, RuleSet.load(EVENT_RULES)[0], ["event_id"])).select("event_id", F.array_join("rule_ids", ",").alias("ids")), "SELECT event_id, concat_ws(',', CASE WHEN value >= 50 THEN '2' END, CASE WHEN event_type = 'click' THEN '1' END, CASE WHEN NOT (event_type = 'click' OR value >= 50) THEN '3' END) AS ids FROM events")


def _stream_usage(spark: SparkSession, d: str) -> DataFrame:
    """The stateful form over a stream of one micro-batch: each user's last state has the last day's usage."""

    def beats(rows: DataFrame) -> DataFrame:
        return usage.accumulate(rows.select(F.col("user_id").alias("customer_id"), F.lit("m").alias("merchant_code"), F.lit("2026-06-12 10:00:00").cast("timestamp").alias("beat_at"), F.floor("value").cast("long").alias("interval_sec")))

    columns = ["customer_id", "current_date_key", "current_week_key", "current_month_key", "daily_usage_sec", "monthly_usage_sec", "beat_count_daily"]
    states = _drained(spark, d, beats, "update").groupBy("customer_id", "merchant_code").agg(F.max_by(F.struct(*columns), "batch").alias("last"))
    return states.select("last.*")


_add("stream_usage", _stream_usage, "SELECT user_id AS customer_id, '2026-06-12' AS current_date_key, '2026-W24' AS current_week_key, '2026-06' AS current_month_key, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS daily_usage_sec, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS monthly_usage_sec, count(*) AS beat_count_daily FROM events GROUP BY user_id")
_TERMS = "o_custkey AS customer_id, o_orderstatus AS merchant_code, 1 AS node_id, o_orderpriority AS version_no"
_add("terms_idempotent_insert", lambda spark, d: (lambda o: usage.new_agreements(o.where("o_orderkey % 2 = 0").selectExpr("o_custkey AS customer_id", "o_orderstatus AS merchant_code", "1 AS node_id", "o_orderpriority AS version_no"), o.where("o_orderkey % 2 = 1").selectExpr("o_custkey AS customer_id", "o_orderstatus AS merchant_code", "1 AS node_id", "o_orderpriority AS version_no")))(table(spark, d, "orders")), f"SELECT DISTINCT {_TERMS} FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT {_TERMS} FROM orders WHERE o_orderkey % 2 = 1")
_add("terms_latest", lambda spark, d: usage.latest_agreements(table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS customer_id", "o_orderstatus AS merchant_code", "1 AS node_id", "o_orderpriority AS version_no")), f"SELECT max(o_orderkey) AS id, {_TERMS} FROM orders GROUP BY ALL")


# --- Facts: what calls answer, a row for each; the SQL has the answers that are to be expected -------------------

def _facts(name: str, found: Callable[[SparkSession, str], Iterable[tuple[str, object]]], want: Iterable[tuple[str, object]]) -> None:
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in want)
    _add(name, lambda spark, d: spark.createDataFrame([(a, str(b)) for a, b in found(spark, d)], "item string, said string"), f"SELECT item, said FROM (VALUES {values}) AS v(item, said)")


def _refused(call: Callable[[], object]) -> bool:
    try:
        call()
    except RuleError:
        return True
    return False


def _users_file(spark: SparkSession, d: str) -> DataFrame:
    path = io.shared_folder(spark, "users")
    rows = customers(spark, d).select((F.col("c_custkey") + 1).alias("uid"), "c_mktsegment", "c_acctbal")
    io.write_users(rows, path)
    return io.read_users(spark, path, "uid bigint, c_mktsegment string, c_acctbal double")


_add("users_file_round_trip", _users_file, f"SELECT c_custkey + 1 AS uid, c_mktsegment, c_acctbal FROM {_CUSTOMER}")


@dataclasses.dataclass
class _Person:
    uid: int
    age: int | None
    city: str | None


_PEOPLE = [_Person(1, 30, "a"), _Person(2, None, "b"), _Person(3, 17, None), {"uid": 4, "age": 65, "city": "b"}]
_add("typed_records", lambda spark, d: mt.match_long(io.users_of_records(spark, _PEOPLE), RuleSet.load([Rule(1, "adult", "age >= 18"), Rule(2, "b", "city = 'b'", 3)])[0], ["uid"]), "SELECT * FROM (VALUES (1::BIGINT, 0, 1::BIGINT, 'adult'), (2, 0, 2, 'b'), (4, 0, 2, 'b'), (4, 1, 1, 'adult')) AS v(uid, place, rule_id, rule_name)")


def _many_rules() -> list[Rule]:
    """More rules than are lowered to columns."""
    return [Rule(i, f"r{i}", f"c_nationkey >= {i} OR c_mktsegment = 'MACHINERY' AND c_acctbal > {100 * i}", i % 3) for i in range(1, 13)]


_MANY = " UNION ALL ".join(f"SELECT c_custkey, {i} AS rule_id, {-(i % 3)} AS p, c_nationkey, c_mktsegment, c_acctbal, coalesce(c_nationkey >= {i} OR c_mktsegment = 'MACHINERY' AND c_acctbal > {100 * i}, false) AS ok FROM {_CUSTOMER} c{i}" for i in range(1, 13))
_add("gate_of_many_rules", lambda spark, d: ex.gate(customers(spark, d), RuleSet.load(_many_rules())[0], ["c_custkey"]).select("c_custkey", "total_rules", "passed_count", "passed", F.array_join("passed_rule_ids", ",").alias("ids"), F.array_join(F.transform("failed", lambda f: F.concat(f["rule_id"].cast("string"), F.lit(": "), f["reasons"][0]["detail"])), " | ").alias("why")),
     f"""SELECT c_custkey, 12 AS total_rules, CAST(count(*) FILTER (ok) AS INTEGER) AS passed_count, bool_and(ok) AS passed, coalesce(string_agg(rule_id, ',' ORDER BY p, rule_id) FILTER (ok), '') AS ids,
     coalesce(string_agg(concat(rule_id, ': no OR alternative held — c_nationkey=', c_nationkey, ' does not satisfy >= ', rule_id, CASE WHEN coalesce(c_mktsegment, '') <> 'MACHINERY' THEN concat('; c_mktsegment=', coalesce(c_mktsegment, '<null>'), ' does not satisfy = ', chr(39), 'MACHINERY', chr(39)) ELSE '' END, CASE WHEN NOT coalesce(c_acctbal > 100 * rule_id, false) THEN concat('; c_acctbal=', coalesce(regexp_replace(c_acctbal::VARCHAR, '\\.0$', ''), '<null>'), ' does not satisfy > ', 100 * rule_id) ELSE '' END), ' | ' ORDER BY p, rule_id) FILTER (NOT ok), '') AS why FROM ({_MANY}) GROUP BY c_custkey""")
_add("response_of_many_rules", lambda spark, d: mt.response(customers(spark, d), RuleSet.load(_many_rules())[0], "c_custkey").select("c_custkey", "hits", F.array_join("rule_names", "|").alias("names")), f"SELECT c_custkey, CAST(count(*) FILTER (ok) AS INTEGER) AS hits, coalesce(string_agg('r' || rule_id, '|' ORDER BY p, rule_id) FILTER (ok), '') AS names FROM ({_MANY}) GROUP BY c_custkey")
_DYNAMIC_RULES = [Rule(i, f"d{i}", e) for i, e in enumerate(["k >= 50", "k < 10", "k = '7'", "k IN (1, 2, 3)", "k LIKE '%5'", "k IS NULL", "NOT (k = 3)", "gone = 1", "k BETWEEN 20 AND 30", "k != 99"])]
_add("match_dynamic_rows", lambda spark, d: (lambda rows: mt.match_wide(rows, RuleSet.load(_DYNAMIC_RULES)[0], ["event_id"], variant="fields"))(io.users_of_json(table(spark, d, "events"), "props")).select("event_id", F.array_join("rule_ids", ",").alias("ids")),
     "SELECT event_id, concat_ws(',', CASE WHEN k >= 50 THEN '0' END, CASE WHEN k < 10 THEN '1' END, CASE WHEN t = '7' THEN '2' END, CASE WHEN t IN ('1', '2', '3') THEN '3' END, CASE WHEN t LIKE '%5' THEN '4' END, CASE WHEN t IS NULL THEN '5' END, CASE WHEN k <> 3 OR k IS NULL THEN '6' END, CASE WHEN k BETWEEN 20 AND 30 THEN '8' END, CASE WHEN k <> 99 THEN '9' END) AS ids FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.k') AS t FROM events)")


def _batch_figures(spark: SparkSession, d: str) -> DataFrame:
    s = st.run_batch(customers(spark, d), rule_set())
    return spark.createDataFrame([(s.users, s.rules, s.evaluations, s.hits, s.top_rules(1)[0][0])], "users long, rules long, evaluations long, hits long, top long")


_add("run_batch", _batch_figures, f"SELECT (SELECT count(*) FROM customer) AS users, 6::BIGINT AS rules, 6 * (SELECT count(*) FROM customer) AS evaluations, sum(hits)::BIGINT AS hits, (SELECT rule_id FROM ({_HITS}) ORDER BY hits DESC, rule_id LIMIT 1) AS top FROM ({_HITS})")
#: The published figures of a batch.
_FIGURES = st.Stats(10_000, 10_000, 356_128, 4.2, 32, {1: 5, 2: 9, 7: 9})
_facts("batch_rates", lambda spark, d: [("tps", round(_FIGURES.tps)), ("qps", round(_FIGURES.qps)), ("latency", f"{_FIGURES.latency_ms:.3f}"), ("none", [st.Stats(0, 5, 0, 0.0).tps, st.Stats(0, 5, 0, 0.0).hit_rate])], [("tps", 23809524), ("qps", 2381), ("latency", "0.420"), ("none", "[0.0, 0.0]")])
_facts("batch_report", lambda spark, d: [tuple(line.split("=", 1)) for line in _FIGURES.report().splitlines()], [("Worker", 32), ("Total User", "10,000"), ("Rule", "10,000"), ("Hit", "356,128"), ("Eval", "100,000,000"), ("Elapsed", "4.2s"), ("TPS", "23,809,523"), ("QPS", "2,380"), ("Latency", "0.420ms"), ("HitRate", "0.3561%")])
_facts("rule_listing", lambda spark, d: [("many", _FIGURES.listing({2: "two"}, 2)), ("few", dataclasses.replace(_FIGURES, rules=50).listing({2: "two"}, 2)), ("none", repr(_FIGURES.listing(top=0)))],
       [("many", "Top 2 rules by hits:\n  #2 two          hits=9\n  #7              hits=9\n"), ("few", "Rule1        Hit 5\nRule2        Hit 9        two\nRule7        Hit 9\n"), ("none", "''")])


def _service(spark: SparkSession) -> RuleService:
    return RuleService(spark, Manager([Rule(1, "adult", "age >= 18 AND age >= 18", 1), Rule(2, "b", "city IN ('b')", 5), Rule(3, "off", "age > 0", enabled=False)]))


_facts("service_match", lambda spark, d: (lambda s: [("one", s.match({"age": 30, "city": "b"})), ("none", s.match({"age": 3})), ("count", s.rule_count), ("name", s.rule_name(2)), ("draft", [s.test("age > 30", {"age": 31}), s.test("age > 30", {})])])(_service(spark)),
       [("one", [2, 1]), ("none", []), ("count", 2), ("name", "b"), ("draft", [True, False])])


def _evaluated(spark: SparkSession, d: str) -> list[tuple[str, object]]:
    s, parsed = _service(spark), RuleService(spark, Manager([Rule(5, "j", '{"field": "age", "op": ">", "value": -1}')], "json"))
    table_rule = DecisionTable.of({"id_base": 70, "rows": [{"name": "cold", "when": [{"field": "t", "op": "<", "value": -5}]}]}).rules()[0]
    tables = RuleService(spark, Manager([table_rule, dataclasses.replace(table_rule, id=71, expr="")]))
    said = lambda out: [out["passed"], out["rule"], [r["detail"] for r in out["reasons"]]]
    return [
        ("text", said(s.evaluate({"age": 5}, "age > 6 OR city = 'x'"))),
        ("stored", said(s.evaluate({"age": 5}, rule_id=1))),
        ("json", said(parsed.evaluate({"age": 0}, rule_id=5))),
        ("table", said(tables.evaluate({"t": 3}, rule_id=70))),
        ("node only", said(tables.evaluate({"t": -9}, rule_id=71))),
        ("built in", s.evaluate(SAMPLE)["passed"]),
        ("without a row", s.evaluate(None, "age IS NULL")["passed"]),
        ("unknown id", _refused(lambda: s.evaluate({}, rule_id=99))),
        ("disabled id", _refused(lambda: s.evaluate({}, rule_id=3))),
    ]


_facts("service_evaluate", _evaluated, [
    ("text", [False, "age > 6 OR city = 'x'", ["no OR alternative held — age=5 does not satisfy > 6; city=<null> does not satisfy = 'x'"]]),
    ("stored", [False, "age >= 18 AND age >= 18", ["age=5 does not satisfy >= 18"] * 2]),
    ("json", [True, '{"field": "age", "op": ">", "value": -1}', []]),
    ("table", [False, "t < -5", ["t=3 does not satisfy < -5"]]),
    ("node only", [True, "t < -5", []]),
    ("built in", True), ("without a row", True), ("unknown id", True), ("disabled id", True)])
_facts("service_evaluate_all", lambda spark, d: (lambda s, out: [("gate", [out[k] for k in ("uid", "total_rules", "passed_count", "failed_count", "passed", "passed_rule_ids", "failed_rule_ids")]), ("failed", [[f["name"], f["rule"], len(f["reasons"])] for f in out["failed"]]), ("no row", _refused(lambda: s.evaluate_all(1, {}))), ("no rules", RuleService(spark).evaluate_all(1, {"a": 1})["passed"])])(_service(spark), _service(spark).evaluate_all(7, {"age": 5, "city": "b"})),
       [("gate", [7, 2, 1, 1, False, [2], [1]]), ("failed", [["adult", "age >= 18 AND age >= 18", 1]]), ("no row", True), ("no rules", False)])
_facts("flagship_rule", lambda spark, d: (lambda s: [("holds", s.test(FLAGSHIP, SAMPLE))] + [(k, s.test(FLAGSHIP, SAMPLE | {k: v})) for k, v in (("occupation", "在校学生"), ("risk_level", "高"), ("order_count", 2), ("credit_score", 999), ("marital_status", "未知"))])(_service(spark)),
       [("holds", True), ("occupation", False), ("risk_level", False), ("order_count", True), ("credit_score", False), ("marital_status", False)])
_facts("service_self_test", lambda spark, d: (lambda t: [("steps", [(n, c) for n, c, _ in t.steps]), ("added", t.added), ("removed", t.removed)])(_service(spark).self_test()), [("steps", [("before", 2), ("after_add", 3), ("after_remove", 2)]), ("added", True), ("removed", True)])
_facts("metrics_text", lambda spark, d: [(line.split(" ")[0], line.split(" ")[1]) for line in _service(spark).metrics(spark.range(1, 101).select(F.col("id").cast("double").alias("ms"))).splitlines() if not line.startswith("#")],
       [("rule_engine_rules", 2), ("rule_engine_versions", 0), ("rule_engine_max_concurrency", 200), ('rule_engine_match_latency_ms{quantile="0.5"}', "51.000"), ('rule_engine_match_latency_ms{quantile="0.9"}', "90.000"), ('rule_engine_match_latency_ms{quantile="0.99"}', "99.000"), ("rule_engine_match_latency_samples", 100)])


def _edited(spark: SparkSession, d: str) -> list[tuple[str, object]]:
    rules, loaded, failed = RuleSet.load([Rule(1, expr="a = 1"), Rule(2, expr="a >"), Rule(1, expr="a = 2", priority=3), Rule(4, expr="a = 4", enabled=False)])
    merged, *counts = rules.merged([Rule(1, expr="a = 9", enabled=False), Rule(5, expr="b = 1", priority=9)])
    manager = Manager(RULES[:2])
    held = manager.live
    manager.upsert(Rule(9, expr="a = 1", priority=99))
    return [
        ("loaded", [loaded, failed, [(p.id, p.rule.expr) for p in rules]]),
        ("merged", [counts, [p.id for p in merged]]),
        ("added", [p.id for p in rules.with_rule(Rule(8, expr="c = 1"))]),
        ("refused", [_refused(lambda: rules.with_rule(Rule(8, expr="c = 1", enabled=False))), _refused(lambda: rules.with_rule(Rule(8, expr="c ="))), _refused(lambda: manager.upsert(Rule(0, expr="a = 1")))]),
        ("removed", [len(rules.without(1)), len(rules.without(77))]),
        ("replaced", [manager.replace([Rule(3, expr="a = 1"), Rule(6, expr="a")]), [p.id for p in manager.live], [r.id for r in manager.list()]]),
        ("snapshot", [len(held), held.get(1).rule.name, held.get(9)]),
    ]


_facts("rule_set_edits", _edited, [("loaded", [2, 1, [(1, "a = 2")]]), ("merged", [[1, 0], [5, 1]]), ("added", [1, 8]), ("refused", [True, True, True]), ("removed", [0, 1]), ("replaced", [(1, 1), [3], [3, 6]]), ("snapshot", [2, "rich", None])])


def _reloaded(spark: SparkSession, d: str) -> list[tuple[str, object]]:
    path, manager, seen = io.shared_folder(spark, "reload"), Manager(), []
    source = sm.RuleFile(spark, path, manager, lambda loaded, failed: seen.append((loaded, failed)))
    missing = source.refresh()
    io.write_rules(spark, [Rule(1, expr="a = 1"), Rule(2, expr="a")], path)
    return [("missing", missing), ("written", source.refresh()), ("again", source.refresh()), ("seen", seen), ("live", len(manager.live))]


_facts("rule_file_reload", _reloaded, [("missing", False), ("written", True), ("again", False), ("seen", [(1, 1)]), ("live", 1)])


def _walked(spark: SparkSession, d: str) -> list[tuple[str, object]]:
    """Cases in which the walker reads a rule otherwise: as matching, as the walker."""
    cases = [("s = 30.0", {"s": "30"}), ("t IS NULL", {"t": [1]}), ("x IN ('')", {"y": 1}), ("x == 1", {"x": 1}), ("x != 5", {"y": 1}), ("a = 1 AND b = 2", {"a": 2})]
    out = []
    for rule, row in cases:
        df, node = io.users_of_records(spark, [row | {"_": 0}]), frontends.parse(rule)
        out.append((rule, [ex.explain(df, node, ["_"], compat=c).first().passed for c in ("vm", "ast")]))
    node, df = frontends.parse("x BETWEEN '1' AND '3'"), io.users_of_records(spark, [{"x": 2, "_": 0}])
    return [*out, ("x BETWEEN '1' AND '3'", [_refused(lambda: compile_rule(Rule(1, node=node))), ex.explain(df, node, ["_"], compat="ast").first().passed])]


_facts("walker_readings", _walked, [("s = 30.0", [True, False]), ("t IS NULL", [True, False]), ("x IN ('')", [False, True]), ("x == 1", [True, False]), ("x != 5", [False, True]), ("a = 1 AND b = 2", [False, False]), ("x BETWEEN '1' AND '3'", [True, True])])


def _registered(spark: SparkSession, d: str) -> list[tuple[str, object]]:
    frontends.register("upper", lambda text: frontends.parse(text.lower()))
    mt.register_backend("reversed", lambda df, rules, keys, variant=None, with_names=False: df.select(*keys, F.reverse(mt.matched_ids(df, rules)).alias("rule_ids")))
    row = io.users_of_records(spark, [{"a": 1, "_": 0}])
    pair = RuleSet.load([Rule(1, expr="A = 1", priority=2), Rule(2, expr="A >= 0")], "upper")[0]
    return [
        ("front-ends", {"native", "json", "cel", "expr", "qlbridge", "vitess", "upper"} <= set(frontends.names())),
        ("backends", mt.backends()),
        ("matched", [mt.match_wide(row, pair, ["_"], m).first().rule_ids for m in ("columns", "bitmaps", "reversed")]),
        ("refused", [_refused(lambda: frontends.parse("a = 1", "vitess")), _refused(lambda: frontends.parse("a = 1", "none")), _refused(lambda: mt.match_wide(row, pair, ["_"], "none"))]),
        ("bare words", [frontends.parse("a = 'x = foo' AND b = bar OR c IN (x, 'y')", "qlbridge") == frontends.parse("a = 'x = foo' AND b = 'bar' OR c IN ('x', 'y')"), _refused(lambda: frontends.parse("a IS NULL", "qlbridge")), _refused(lambda: frontends.parse("a = foo"))]),
        ("fields", fields(frontends.parse("b = 1 AND (a = 2 OR NOT (b = 3)) AND c IS NULL"))),
    ]


_facts("registries", _registered, [("front-ends", True), ("backends", ["bitmaps", "columns", "reversed"]), ("matched", [[1, 2], [1, 2], [2, 1]]), ("refused", [True, True, True]), ("bare words", [True, True, True]), ("fields", ["b", "a", "c"])])
_facts("connector_options", lambda spark, d: [("source", sorted(io.kafka_source("h:1", "t", False, 5).items())), ("sink", sorted(io.kafka_sink("h:1", "t", {"acks": "all"}).items())), ("rows", [tuple(r) for r in io.kafka_rows(spark.createDataFrame([(7, ["a"])], "uid long, ids array<string>")).collect()]), ("database", io.enabled_rules("rules"))],
       [("source", [("kafka.bootstrap.servers", "h:1"), ("maxOffsetsPerTrigger", "5"), ("startingOffsets", "earliest"), ("subscribe", "t")]), ("sink", [("kafka.acks", "all"), ("kafka.bootstrap.servers", "h:1"), ("topic", "t")]), ("rows", [("7", '{"uid":7,"ids":["a"]}')]), ("database", "(SELECT id, name, expr, priority, enabled FROM rules WHERE enabled = 1) rules")])
_facts("export_text", lambda spark, d: [("cel", export_text([Rule(1, "a", "x = 1"), Rule(2, "b", "x =")], "cel", "r.json").splitlines()[:5]), ("unknown", _refused(lambda: export_text([], "lua")))], [("cel", ["# converting 2 rules from r.json to cel", "", "# rule 1 a", "SQL : x = 1", "cel : x == 1"]), ("unknown", True)])


def _table_file(spark: SparkSession, d: str) -> list[tuple[str, object]]:
    path = io.shared_folder(spark, "table")
    spark.createDataFrame([(json.dumps(_TABLE),)], "value string").coalesce(1).write.text(path)
    return [(r.name, [r.id, r.expr, r.priority, r.enabled]) for r in load_table(spark, path).rules()]


_facts("decision_table_file", _table_file, [("r0", [7000, "c_nationkey BETWEEN 1 AND 8 AND c_acctbal >= -100", 1, True]), ("off", [7001, "c_nationkey = 1", 0, False]), ("r2", [7002, "c_mktsegment IN ('MACHINERY', 'AUTOMOBILE')", 5, True])])


def _beats(spark: SparkSession, d: str) -> list[tuple[str, object]]:
    """Heartbeat messages as beats; usage of a period that has passed reads as 0."""
    said = lambda unit, n, customer=1: json.dumps({"merchantCode": "m", "intervalUnit": unit, "timestamp": 1_781_251_200_000, "customerID": customer, "interval": n})
    rows = spark.createDataFrame([(said("MINUTE", 2),), (said("s", 5),), (said("year", 1),), (said("s", 1, None),), ("x",)], "value string")
    beats = usage.beats_of_json(rows).agg(F.count("*").alias("n"), F.sum("interval_sec").alias("s")).first()
    day = datetime.datetime(2026, 6, 12, 23, tzinfo=datetime.timezone.utc)
    state = spark.createDataFrame([(1, "m", "2026-06-12", "2026-W24", "2026-06", 30, 40, 50, 1, None, None, None, day)], usage.OUTPUT)
    read = [tuple(usage.at_reading(state, F.lit(t).cast("timestamp")).select("daily_usage_sec", "weekly_usage_sec", "monthly_usage_sec").first()) for t in ("2026-06-12 12:00:00", "2026-06-14 00:00:00", "2026-07-01 00:00:00")]
    return [("beats", [beats.n, beats.s]), ("read", read)]


_facts("heartbeats", _beats, [("beats", [2, 125]), ("read", [(30, 40, 50), (0, 40, 50), (0, 0, 0)])])


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship query: customers with the rules that hold for them, in order of priority."""
    return mt.match_long(customers(spark, sf_dir), rule_set(), ["c_custkey"])
