import datetime
import json

import duckdb
import pytest

import __spark_entry__ as contract
from predica import queries
from predica.functions import helpers
from predica.functions.text import number_text
from predica.operators import explain, match, stats
from predica.operators.rules import Manager, Rule, RuleSet, compile_rule, versions_frame
from predica.operators.service import SAMPLE, SELF_TEST_ID, RuleService
from predica.operators.translate import export
from predica.plans.ir import RuleError, plain_number
from predica.sources import frontends, generator, io
from predica.streaming import match as stream_match
from predica.streaming import usage
from pyspark.sql import functions as F

#: Rules and rows with known answers.
NAMED = [
    Rule(1, "广东高价值男性", "gender = '男' AND age BETWEEN 25 AND 35 AND province = '广东' AND vip_level >= 3 AND total_amount >= 10000", 10),
    Rule(2, "活跃iPhone低风险", "login_days_30d >= 20 AND active_score >= 80 AND order_count >= 10 AND risk_level = '低' AND device_type = 'iPhone'", 8),
    Rule(3, "风控", "credit_score < 600 AND total_amount > 50000 AND login_days_30d < 5 AND province IN ('广东','浙江') AND age > 45", 20),
    Rule(4, "数码高活跃", "age BETWEEN 25 AND 40 AND province IN ('广东','江苏','浙江') AND income_level IN ('20k-30k','30k+') AND favorite_category LIKE '数%' AND active_score >= 85", 12),
    Rule(5, "女性会员复购", "gender = '女' AND age >= 30 AND vip_level >= 2 AND total_amount > 5000 AND login_days_30d >= 15", 6),
    Rule(6, "已禁用", "age >= 0", 1, enabled=False),
]
USERS = [
    {"uid": 1, "gender": "男", "age": 28, "province": "广东", "vip_level": 3, "login_days_30d": 28, "order_count": 132, "total_amount": 35628.56, "active_score": 91.52, "credit_score": 765, "risk_level": "低", "device_type": "iPhone", "income_level": "20k-30k", "favorite_category": "数码"},
    {"uid": 2, "gender": "女", "age": 35, "province": "上海", "vip_level": 2, "login_days_30d": 22, "order_count": 58, "total_amount": 12689.0, "active_score": 76.3, "credit_score": 698, "risk_level": "中", "device_type": "Android", "income_level": "10k-20k"},
    {"uid": 6, "gender": "男", "age": 48, "province": "广东", "total_amount": 60000.0, "credit_score": 580, "login_days_30d": 2},
]


def test_known_answers(spark):
    rules, loaded, failed = RuleSet.load(NAMED)
    users = io.users_of_records(spark, USERS)
    assert (loaded, failed) == (5, 0)
    for mode in ("columns", "bitmaps"):
        assert {r.uid: r.rule_ids for r in match.match_wide(users, rules, ["uid"], mode).collect()} == {1: [4, 1, 2], 2: [5], 6: [3]}
    figures = stats.run_batch(users, rules)
    assert (figures.users, figures.rules, figures.evaluations, figures.hits) == (3, 5, 15, 5)
    assert figures.top_rules(2) == [(1, 1), (2, 1)]
    assert "Eval=15\n" in figures.report() and "Total User=3\n" in figures.report()
    assert figures.rule_report(rules.names).splitlines()[0] == "Rule1        Hit 1        广东高价值男性"
    one = stats.totals(users, rules).first()
    assert (one.users, one.evaluations, one.hits, round(one.hit_rate, 6)) == (3, 15, 5, 0.333333)
    empty = stats.totals(users.limit(0), rules).first()
    assert (empty.users, empty.hits, empty.hit_rate) == (0, 0, 0.0)


def test_no_rules(spark):
    users = io.users_of_records(spark, USERS)
    for mode in ("columns", "bitmaps"):
        assert [r.rule_ids for r in match.match_wide(users, RuleSet(), ["uid"], mode).collect()] == [[]] * 3
    assert stats.run_batch(users, RuleSet()).hits == 0


def test_rule_set():
    rules, loaded, failed = RuleSet.load([Rule(1, expr="a = 1"), Rule(2, expr="a >"), Rule(3, expr="a = 1", enabled=False), Rule(1, expr="a = 2", priority=3)])
    assert (loaded, failed, len(rules)) == (2, 1, 1) and rules.get(1).rule.priority == 3
    merged, *_ = rules.merged([Rule(1, expr="a = 9", enabled=False), Rule(4, expr="b = 1", priority=9)])
    assert [p.id for p in merged] == [4, 1] and merged.get(1).rule.expr == "a = 2"
    with pytest.raises(RuleError):
        rules.with_rule(Rule(5, expr="a = 1", enabled=False))
    assert len(rules.without(77)) == 1


def test_hot_changes(spark):
    row, service = {"age": 30, "city": "x"}, RuleService(spark, Manager([Rule(1, expr="age >= 18"), Rule(2, expr="age < 18")]))
    assert service.match(row) == [1]
    service.manager.upsert(Rule(3, expr="city = 'x'", priority=5))
    assert service.rule_count == 3 and service.match(row) == [3, 1]
    with pytest.raises(RuleError):
        service.manager.upsert(Rule(4, expr="age >"))
    assert service.rule_count == 3
    service.manager.remove(3)
    assert service.match(row) == [1]
    service.manager.replace([Rule(99, expr="age = 30")])
    assert service.match(row) == [99]


def test_manager(spark):
    m = Manager()
    assert [m.upsert(Rule(1, expr="a = 1")).version, m.upsert(Rule(1, expr="a = 2")).version, m.upsert(Rule(1, expr="a = 3", version=9)).version] == [1, 2, 9]
    with pytest.raises(RuleError):
        m.upsert(Rule(0, expr="a = 1"))
    assert m.publish("first").version == 1
    m.upsert(Rule(1, expr="a = 3", enabled=False))
    assert len(m.live) == 0 and len(m.list()) == 1
    m.rollback(1)
    assert len(m.live) == 1 and m.list()[0].enabled
    with pytest.raises(RuleError):
        m.rollback(7)
    assert [tuple(r) for r in versions_frame(spark, m).select("version", "note", "count").collect()] == [(1, "first", 1)]


def test_service(spark):
    s = RuleService(spark, Manager(NAMED))
    assert s.test("age > 30", {"age": 31}) and not s.test("age > 30", {})
    done = s.self_test()
    assert done.added and done.removed and [x[1] for x in done.steps] == [5, 6, 5] and SELF_TEST_ID in done.steps[1][2]
    assert s.evaluate(SAMPLE)["passed"] and s.evaluate(SAMPLE)["reasons"] == []
    out = s.evaluate({"age": 20, "province": "x"}, rule="age >= 25 AND province IN ('y')")
    assert [r["detail"] for r in out["reasons"]] == ["age=20 does not satisfy >= 25", "province=x is not in the allowed set"]
    with pytest.raises(RuleError):
        s.evaluate({}, rule_id=12345)
    with pytest.raises(RuleError):
        s.evaluate_all(1, {})
    gate = s.evaluate_all(7, USERS[0])
    assert (gate["uid"], gate["passed"], gate["total_rules"], gate["passed_rule_ids"], gate["failed_rule_ids"]) == (7, False, 5, [4, 1, 2], [3, 5])
    assert s.rule_name(4) == "数码高活跃" and s.rule_name(44) is None
    latencies = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    text = s.metrics(latencies)
    assert 'rule_engine_match_latency_ms{quantile="0.9"} 90.000' in text and "rule_engine_rules 5\n" in text
    assert {r.uid: r.rule_names for r in s.match_batch(io.users_of_records(spark, USERS)).collect()}[2] == ["女性会员复购"]


def test_explain(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 5.0)], "id int, s string, d double")
    node = compile_rule(Rule(1, expr="s LIKE 'x%' AND (d = 1 OR d BETWEEN 7 AND 9) AND d IS NOT NULL AND NOT (s IS NULL)")).node
    one, two = explain.explain(df, node, ["id"]).orderBy("id").collect()
    assert [r.detail for r in one.reasons] == ["s=a does not match pattern 'x%'", "no OR alternative held — d=<null> does not satisfy = 1; d=<null> is outside [7, 9]", "d is missing or null (IS NOT NULL required)"]
    assert [r.detail for r in two.reasons] == ["s=<null> does not match pattern 'x%'", "no OR alternative held — d=5 does not satisfy = 1; d=5 is outside [7, 9]", "the negated condition was satisfied"]


def test_walker(spark):
    """Where the two readings of a rule differ: (rule, row, as matching, as the walker)."""
    cases = [("x == 1", {"x": 1}, True, False), ("x != 5", {"y": 1}, False, True), ("x < 30", {"y": 1}, False, True), ("x IN ('')", {"y": 1}, False, True), ("x LIKE '%'", {"y": 1}, False, True), ("s = 30.0", {"s": "30"}, True, False), ("t IS NULL", {"t": [1]}, True, False), ("x BETWEEN 1 AND 3", {"x": 2}, True, True), ("x = 2", {"x": 2.0}, True, True), ("x NOT IN (2)", {"y": 1}, True, True)]
    for rule, row, vm, ast in cases:
        df, node = io.users_of_records(spark, [row | {"_": 0}]), frontends.parse(rule)
        assert [explain.explain(df, node, ["_"], compat=c).first().passed for c in ("vm", "ast")] == [vm, ast], rule
    df = io.users_of_records(spark, [{"x": 2, "_": 0}])
    assert explain.explain(df, frontends.parse("x BETWEEN '1' AND '3'"), ["_"], compat="ast").first().passed


def test_gate_agrees_with_matching(spark):
    rules, users = RuleSet.load(NAMED)[0], io.users_of_records(spark, USERS)
    gates = {r.uid: r.passed_rule_ids for r in explain.gate(users, rules, ["uid"]).collect()}
    assert gates == {r.uid: r.rule_ids for r in match.match_wide(users, rules, ["uid"]).collect()}


def test_sources(spark, tmp_path):
    path = str(tmp_path / "rules")
    io.write_rules(spark, NAMED, path)
    assert io.read_rules(spark, path) == NAMED
    (tmp_path / "r.json").write_text('[{"id": 5, "rule": "a = 1", "expr": "b = 2", "comment": "x"}]', encoding="utf-8")
    assert io.read_rules(spark, str(tmp_path / "r.json")) == [Rule(5, expr="a = 1")]
    (tmp_path / "bad.json").write_text("[", encoding="utf-8")
    with pytest.raises(RuleError):
        io.read_rules(spark, str(tmp_path / "bad.json"))
    (tmp_path / "u.json").write_text(json.dumps([{"uid": 7.9, "a": 1}, {"a": 2.5, "s": "x"}, {"uid": "z", "s": "y"}]), encoding="utf-8")
    assert [tuple(r) for r in io.read_users(spark, str(tmp_path / "u.json")).orderBy("uid").collect()] == [(2, 2.5, "x"), (3, None, "y"), (7, 1.0, None)]
    with pytest.raises(RuleError, match="record 1"):
        io.users_of_records(spark, [{"a": 1}, 5])


def test_generator(spark):
    users, made = generator.users(spark, 50), generator.rules(40)
    assert len(users.columns) == 27 and users.count() == 50
    assert users.orderBy("uid").collect() == generator.users(spark, 50).repartition(3).orderBy("uid").collect()
    assert RuleSet.load(made)[1:] == (40, 0) and made == generator.rules(40)


@pytest.mark.parametrize("x, want", [(0.0, 0.0), (5.0, 5.0), (3.14, 3.14), (1.234, 1.23), (1.235, 1.24), (2.555, 2.56), (-1.234, -1.23), (-1.235, -1.24), (1.1, 1.1), (9.99999, 10.0), (0.001, 0.0), (0.005, 0.01), (1e6, 1e6), (12345.678, 12345.68)])
def test_round2(spark, x, want):
    assert spark.range(1).select(helpers.round2(F.lit(x))).first()[0] == want


def test_interval_seconds(spark):
    cases = [("SECOND", 30, 30), ("SECONDS", 30, 30), ("sec", 45, 45), ("s", 5, 5), ("MINUTE", 2, 120), ("MINUTES", 2, 120), ("min", 3, 180), ("HOUR", 1, 3600), ("h", 2, 7200), ("DAY", 1, 86400), ("d", 2, 172800), ("minute", 1, 60), ("Hour", 1, 3600), ("  SECOND  ", 10, 10), ("SECOND", 0, 0), ("FORTNIGHT", 1, None), ("", 5, None), ("   ", 5, None)]
    df = spark.createDataFrame([(i, u, n) for i, (u, n, _) in enumerate(cases)], "i int, u string, n long")
    assert [r[0] for r in df.orderBy("i").select(helpers.interval_seconds(F.col("u"), F.col("n"))).collect()] == [c[2] for c in cases]


def test_number_text(spark):
    values = [0.0, -0.0, 1.0, 30.0, -2.5, 0.1, 1e7, 123456789.125, 1e-7, 1.5e-20, 1e19, 1e20, 1.234e25, -1.5e8, float("nan"), float("inf"), float("-inf"), 1.7976931348623157e308, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(number_text(F.col("v"))).collect()] == [None if v is None else plain_number(v) for v in values]


def test_masking(spark):
    body = '{"customerName":"n","data":[{"item":{"fieldId":"EMAIL","fieldValue":"ab@cd.ef"},"bind":true}]}'
    df = spark.createDataFrame([("EMAIL", "中文字符更多", body), ("OTHER", "abcdefgh", "not json"), ("QQ", "12345", "")], "f string, v string, b string")
    got = df.select(helpers.mask_value(F.col("f"), F.col("v")).alias("v"), helpers.mask_request(F.col("b")).alias("b")).collect()
    assert [r.v for r in got] == ["中文字符更*", "abcdefgh", "12345"]
    assert json.loads(got[0].b)["data"][0]["item"]["fieldValue"] == "ab@cd***" and [r.b for r in got[1:]] == ["not json", ""]


def test_period_keys(spark):
    days = ["2024-12-30", "2021-01-01", "2026-06-12"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(usage.period_key(F.to_timestamp("d"), "weekly"))
    assert [r[0] for r in df.collect()] == ["2025-W01", "2020-W53", "2026-W24"]


def test_accumulation(spark, tmp_path):
    """Two micro-batches: usage goes on within a period and starts anew in the next; limits keep their last known value."""
    schema = "customer_id long, merchant_code string, beat_at timestamp, interval_sec long, daily_limit_sec long"
    at = lambda *x: datetime.datetime(*x, tzinfo=datetime.timezone.utc)
    for i, rows in enumerate([[(1, "m", at(2026, 6, 12, 23), 30, 100), (1, "m", at(2026, 6, 12, 23, 30), 20, None)], [(1, "m", at(2026, 6, 13, 1), 5, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    beats = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    seen = []
    usage.accumulate(beats).writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = max(seen, key=lambda r: r.last_beat_at)
    assert (last.daily_usage_sec, last.weekly_usage_sec, last.monthly_usage_sec, last.beat_count_daily, last.daily_limit_sec, last.current_date_key) == (5, 55, 55, 1, 100, "2026-06-13")
    read = usage.at_reading(spark.createDataFrame([tuple(last)], usage.OUTPUT), F.lit("2026-06-14 00:00:00").cast("timestamp")).first()
    assert (read.daily_usage_sec, read.weekly_usage_sec, read.monthly_usage_sec) == (0, 55, 55)


def test_reload_between_batches(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('[{"id": 1, "expr": "x >= 0"}]', encoding="utf-8")
    manager = Manager()
    source = stream_match.RuleFile(spark, str(path), manager)
    source.last = 0
    spark.range(3).selectExpr("id AS x").coalesce(1).write.json(str(tmp_path / "in"))
    rows, seen = spark.readStream.schema("x long").json(str(tmp_path / "in")), []
    stream_match.match_with_reload(rows, source, ["x"], lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.x, tuple(r.rule_ids)) for r in seen) == [(0, (1,)), (1, (1,)), (2, (1,))]
    assert not source.refresh()


def test_export_keeps_going(spark):
    rows = export(spark, [Rule(1, "a", "x = 1"), Rule(2, "b", "x =")], ["cel"]).collect()
    assert rows[0].text == "x == 1" and rows[1].text is None and rows[1].error


SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toArrow(), con.sql(queries.ORACLES[name]).to_arrow_table()
    columns = sorted(got.schema.names)
    assert columns == sorted(want.schema.names)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda t: sorted(([plain(v) for v in r] for r in zip(*(t.column(c).to_pylist() for c in columns))), key=repr)
    assert rows(got) == rows(want)
