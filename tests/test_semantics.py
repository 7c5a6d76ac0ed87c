"""Rules against rows: fixed cases, and random rules and rows against the plain evaluator."""

import random

import pyarrow as pa
import pytest
from oracle import holds

from predica.operators import match
from predica.operators.bitmaps import Evaluator
from predica.operators.rules import Program, Rule, RuleSet, compile_rule
from predica.operators.service import FLAGSHIP, SAMPLE
from predica.plans.ir import Between, Compare, In, IsNull, Like, Logic, Not, Value
from predica.plans.lower import Lowering
from predica.sources import frontends, io

#: Fixed values: (rule, row, whether it holds).
CASES = [
    ("gender = '男'", {"gender": "男"}, True),
    ("gender = '男'", {"gender": "女"}, False),
    ("vip_level >= 3", {"vip_level": 3}, True),
    ("vip_level >= 3", {"vip_level": 2}, False),
    ("credit_score < 600", {"credit_score": 580.0}, True),
    ("total_amount > 50000 AND age > 45", {"total_amount": 60000.0, "age": 48}, True),
    ("total_amount > 50000 AND age > 45", {"total_amount": 60000.0, "age": 30}, False),
    ("a = 1 OR b = 2", {"a": 9, "b": 2}, True),
    ("a = 1 OR b = 2", {"a": 9, "b": 9}, False),
    ("name LIKE '%店'", {"name": "便利店"}, True),
    ("name LIKE '%码%'", {"name": "数码城"}, True),
    ("phone IS NULL", {"name": "x"}, True),
    ("phone IS NULL", {"phone": "139"}, False),
    ("phone IS NOT NULL", {"phone": "139"}, True),
    ("phone IS NOT NULL AND age >= 18", {"phone": "139", "age": 20}, True),
    ("x <> 5", {"x": 6}, True),
    ("x <> 5", {"x": 5}, False),
    ("name <> '高'", {"name": "低"}, True),
    ("income_level NOT IN ('<5k','5k-10k')", {"income_level": "20k-30k"}, True),
    ("income_level NOT IN ('<5k','5k-10k')", {"income_level": "<5k"}, False),
    ("occupation NOT LIKE '%学生%'", {"occupation": "工程师"}, True),
    ("occupation NOT LIKE '%学生%'", {"occupation": "在校学生"}, False),
    ("NOT (risk_level = '高')", {"risk_level": "低"}, True),
    ("NOT (risk_level = '高')", {"risk_level": "高"}, False),
    ("NOT (a = 1 OR b = 2)", {"a": 9, "b": 9}, True),
    ("NOT (a = 1 OR b = 2)", {"a": 1, "b": 9}, False),
    ("age >= 25 AND NOT (province IN ('北京','上海'))", {"age": 30, "province": "广东"}, True),
    ("age >= 25 AND NOT (province IN ('北京','上海'))", {"age": 30, "province": "北京"}, False),
    # Missing fields, mixed types, raw texts, patterns.
    ("x != 5", {"y": 1}, False),
    ("NOT (x = 5)", {"y": 1}, True),
    ("x NOT IN (5)", {"y": 1}, True),
    ("x == 1", {"x": 1}, True),
    ("x = '1'", {"x": 1.0}, True),
    ("s = 30.0", {"s": "30"}, True),
    ("s > 5", {"s": "5-10k"}, True),
    ("x IN (1.0)", {"x": 1}, False),
    ("x IN ('1')", {"x": 1}, True),
    ("s BETWEEN 1 AND 9", {"s": "5"}, False),
    ("s LIKE 'a_b'", {"s": "axb"}, False),
    ("s LIKE 'a%b'", {"s": "a%b"}, True),
    ("b = 'true'", {"b": True}, True),
    ("x LIKE '%.5'", {"x": 2.5}, True),
    ("t IS NULL", {"t": [1]}, True),
]


def both(spark, node, row):
    df = io.users_of_records(spark, [row | {"_": 0}])
    columns = df.select(Lowering(df).predicate(node).alias("p")).first().p
    kept = df.where(Lowering(df).condition(node)).count() == 1
    packed = match.match_wide(df, RuleSet([Program(Rule(1), node)]), ["_"], "bitmaps").first().rule_ids == [1]
    return columns, kept, packed


@pytest.mark.parametrize("rule, row, want", CASES)
def test_plain(rule, row, want):
    assert holds(frontends.parse(rule), row) is want


def test_cases(spark):
    for rule, row, want in CASES:
        assert both(spark, compile_rule(Rule(1, expr=rule)).node, row) == (want,) * 3, (rule, row)


def test_flagship(spark):
    rows = [SAMPLE]
    rows += [SAMPLE | change for change in ({"income_level": "<5k"}, {"occupation": "在校学生"}, {"risk_level": "高"}, {"marital_status": "未知"}, {"credit_score": 999}, {"vip_level": 1, "order_count": 2})]
    rows.append({k: v for k, v in SAMPLE.items() if k != "last_login_time"})
    df = io.users_of_records(spark, [r | {"i": i} for i, r in enumerate(rows)])
    rules = RuleSet([compile_rule(Rule(1, expr=FLAGSHIP))])
    for mode in ("columns", "bitmaps"):
        assert [r.rule_ids for r in match.match_wide(df, rules, ["i"], mode).orderBy("i").collect()] == [[1]] + [[]] * 7


FIELDS = {"n": "bigint", "i": "int", "d": "double", "s": "string", "b": "boolean"}


def random_value(rng):
    return rng.choice([Value(str(rng.randint(0, 4))), Value(f"{rng.randint(0, 4)}.5"), Value("2.0"), Value(rng.choice(["1", "2.5", "a", "ab", "", "true", "4", "中"]), True)])


def random_rule(rng, depth=3):
    if depth and rng.random() < 0.6:
        if rng.random() < 0.3:
            return Not(random_rule(rng, depth - 1))
        return Logic(rng.choice(["AND", "OR"]), tuple(random_rule(rng, depth - 1) for _ in range(rng.randint(2, 3))))
    field = rng.choice([*FIELDS, "absent"])
    kind = rng.randrange(5)
    if kind == 0:
        return Between(field, Value(str(rng.randint(0, 3))), Value(str(rng.randint(1, 4)) + rng.choice(["", ".5"])))
    if kind == 1:
        return In(field, tuple(random_value(rng) for _ in range(rng.randint(1, 3))), rng.random() < 0.5)
    if kind == 2:
        return Like(field, rng.choice(["", "%"]) + rng.choice(["a", "1", ".5", "", "_", "t"]) + rng.choice(["", "%"]), rng.random() < 0.5)
    if kind == 3:
        return IsNull(field, rng.random() < 0.5)
    return Compare(field, rng.choice(["=", "==", "!=", ">", ">=", "<", "<="]), random_value(rng))


def random_row(rng):
    maybe = lambda x: None if rng.random() < 0.25 else x
    number = rng.choice([0.0, 1.0, 2.5, 3.0, 4.5, -1.0, float("nan"), 1e21, -0.0])
    return {"n": maybe(rng.randint(-1, 5)), "i": maybe(rng.randint(0, 4)), "d": maybe(number), "s": maybe(rng.choice(["1", "2", "2.5", "a", "ab", "cab", "", "true", "中", "_"])), "b": maybe(rng.random() < 0.5)}


def test_random_rules(spark):
    rng = random.Random(5)
    rows = [random_row(rng) for _ in range(150)]
    nodes = [random_rule(rng) for _ in range(120)]
    schema = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
    df = spark.createDataFrame([(j, *r.values()) for j, r in enumerate(rows)], f"j int, {schema}")
    lowering = Lowering(df)
    for at in range(0, len(nodes), 6):
        part = nodes[at : at + 6]
        got = df.select("j", *(lowering.predicate(n).alias(f"p{k}") for k, n in enumerate(part))).orderBy("j").collect()
        for k, node in enumerate(part):
            assert [r[f"p{k}"] for r in got] == [holds(node, row) for row in rows], node
    rules = RuleSet([Program(Rule(k, priority=k % 3), n) for k, n in enumerate(nodes)])
    got = [r.rule_ids for r in match.match_wide(df, rules, ["j"], "bitmaps").orderBy("j").collect()]
    assert got == [[p.id for p in rules if holds(p.node, row)] for row in rows]
    for node in nodes[:30]:
        assert [r.j for r in df.where(lowering.condition(node)).orderBy("j").collect()] == [j for j, row in enumerate(rows) if holds(node, row)], node


def test_random_variants(spark):
    """Values of a field have different types from row to row."""
    rng = random.Random(6)
    values = [1, 2.5, "2", "ab", True, None, [1], {"x": 1}, 3]
    rows = [{k: v for k in ("n", "s") if (v := rng.choice(values)) is not None or rng.random() < 0.5} for _ in range(60)]
    import json

    df = io.users_of_json(spark.createDataFrame([(j, json.dumps(r)) for j, r in enumerate(rows)], "j int, body string"), "body")
    nodes = [random_rule(rng) for _ in range(12)]
    lowering = Lowering(df, "fields")
    got = df.select("j", *(lowering.predicate(n).alias(f"p{k}") for k, n in enumerate(nodes))).orderBy("j").collect()
    for k, node in enumerate(nodes):
        assert [r[f"p{k}"] for r in got] == [holds(node, row) for row in rows], node


def test_bitmap_of_wide_batches():
    """More rows than a block, and a number of rows that isn't a multiple of eight."""
    n = 1003
    rules = RuleSet([compile_rule(Rule(1, expr="x >= 500")), compile_rule(Rule(2, expr="NOT (x = 3)"))])
    bits = Evaluator(rules)(pa.RecordBatch.from_arrays([pa.array(range(n))], names=["x"]), ["x"])
    assert [int(b) for b in __import__("numpy").bitwise_count(bits).sum(axis=1)] == [503, 1002]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS n", "cast(id AS string) AS s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    node = frontends.parse("n >= 50 AND s LIKE '5%' AND NOT (n = 51)")
    plan = df.where(Lowering(df).condition(node)).select("n")._jdf.queryExecution().executedPlan().toString()
    for pushed in ("GreaterThanOrEqual(n,50)", "StringStartsWith(s,5)"):
        assert pushed in plan
    assert df.where(Lowering(df).condition(node)).count() == 9
