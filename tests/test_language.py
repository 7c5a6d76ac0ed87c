import pytest

from predica.operators.service import FLAGSHIP
from predica.operators.translate import convert
from predica.plans.emit import DSLS, emit
from predica.plans.ir import Between, Compare, In, IsNull, Like, Logic, Not, RuleError, Value, check, fields, optimize, plain_number
from predica.sources import frontends
from predica.sources.decision_table import DecisionTable

RANGE = "age BETWEEN 25 AND 40 AND province IN ('广东','江苏','浙江') AND favorite_category LIKE '数%' AND active_score >= 85"
#: Fixed values: (rule, dialect, text).
EMITTED = [
    (RANGE, "sql", "age BETWEEN 25 AND 40 AND province IN ('广东', '江苏', '浙江') AND favorite_category LIKE '数%' AND active_score >= 85"),
    (RANGE, "cel", "(age >= 25 && age <= 40) && province in ['广东', '江苏', '浙江'] && favorite_category.startsWith('数') && active_score >= 85"),
    (RANGE, "expr", '(age >= 25 && age <= 40) && province in ["广东", "江苏", "浙江"] && hasPrefix(favorite_category, "数") && active_score >= 85'),
    (RANGE, "aviator", "(age >= 25 && age <= 40) && (province == '广东' || province == '江苏' || province == '浙江') && string.startsWith(favorite_category, '数') && active_score >= 85"),
    ("gender = '男' AND vip_level >= 3", "cel", "gender == '男' && vip_level >= 3"),
    ("(a = 1 OR b = 2) AND c >= 3", "expr", "(a == 1 || b == 2) && c >= 3"),
    ("name LIKE '%数'", "cel", "name.endsWith('数')"),
    ("name LIKE '%数%'", "cel", "name.contains('数')"),
    ("name LIKE '数'", "cel", "name == '数'"),
    ("name LIKE '数%'", "aviator", "string.startsWith(name, '数')"),
    ("phone IS NULL", "sql", "phone IS NULL"),
    ("phone IS NOT NULL", "sql", "phone IS NOT NULL"),
    ("phone IS NULL", "cel", "!has(phone)"),
    ("phone IS NOT NULL", "cel", "has(phone)"),
    ("phone IS NULL", "expr", "phone == nil"),
    ("phone IS NOT NULL", "aviator", "phone != nil"),
    ("marital_status <> '未知'", "sql", "marital_status != '未知'"),
    ("marital_status <> '未知'", "cel", "marital_status != '未知'"),
    ("income_level NOT IN ('<5k','5k-10k')", "sql", "income_level NOT IN ('<5k', '5k-10k')"),
    ("income_level NOT IN ('<5k','5k-10k')", "cel", "!(income_level in ['<5k', '5k-10k'])"),
    ("income_level NOT IN ('<5k','5k-10k')", "expr", '!(income_level in ["<5k", "5k-10k"])'),
    ("occupation NOT LIKE '%学生%'", "sql", "occupation NOT LIKE '%学生%'"),
    ("occupation NOT LIKE '%学生%'", "cel", "!(occupation.contains('学生'))"),
    ("occupation NOT LIKE '%学生%'", "aviator", "!(string.contains(occupation, '学生'))"),
    ("NOT (risk_level = '高')", "sql", "NOT (risk_level = '高')"),
    ("NOT (risk_level = '高')", "cel", "!(risk_level == '高')"),
    ("NOT (a = 1 OR b = 2)", "sql", "NOT (a = 1 OR b = 2)"),
]


@pytest.mark.parametrize("rule, dsl, text", EMITTED)
def test_emit(rule, dsl, text):
    assert convert(rule, dsl) == text


@pytest.mark.parametrize("text", ["age >", "age BETWEEN 1", "province IN ()", "age == 1 AND", "@bad", "a = -1", "a ! b", "x NOT BETWEEN 1 AND 2", "a = true", "a LIKE 5", "(a = 1", "a = 'x", "a = 1 b = 2", "", "NOT"])
def test_parse_errors(text):
    with pytest.raises(RuleError):
        frontends.parse(text)


@pytest.mark.parametrize("text", ["a > 1.2.3", "a BETWEEN '1' AND '2'", "a BETWEEN 1 AND 1.2.3"])
def test_compile_errors(text):
    with pytest.raises(RuleError):
        check(frontends.parse(text))


def test_structure():
    assert frontends.parse("a = 1 AND b = 2 AND c = 3 OR NOT d = 4") == Logic("OR", (Logic("AND", tuple(Compare(f, "=", Value(v)) for f, v in zip("abc", "123"))), Not(Compare("d", "=", Value("4")))))
    assert frontends.parse(r'''a = "it's" and b <> 'x\'y' ''') == Logic("AND", (Compare("a", "=", Value("it's", True)), Compare("b", "!=", Value("x'y", True))))
    assert frontends.parse("名字 like '%a%' Or x is Not null") == Logic("OR", (Like("名字", "%a%"), IsNull("x", True)))
    assert frontends.parse_sql("a = -1.5", allow_signed=True) == Compare("a", "=", Value("-1.5"))


def test_round_trip():
    once = convert(FLAGSHIP, "sql")
    assert convert(once, "sql") == once
    node = frontends.parse(r"a = 'x\'\\y' OR NOT (b NOT LIKE '%\'%' AND c IN (1, '2'))")
    assert frontends.parse(emit(node)) == node
    assert all(emit(frontends.parse(FLAGSHIP), d) for d in DSLS)


def test_optimize():
    node = frontends.parse("a = 1 AND (b = 2 AND (a = 1 AND c = 3)) AND NOT (d = 4 OR (d = 4))")
    assert emit(optimize(node)) == "a = 1 AND b = 2 AND c = 3 AND NOT (d = 4)"
    assert fields(node) == ["a", "b", "c", "d"]


def test_frontends_agree():
    want = frontends.parse("age >= 30 AND city IN ('a', 'b') AND name LIKE 'x%' AND (vip = 1 OR NOT (risk = 'high'))")
    cel = optimize(frontends.parse("age >= 30 && city in ['a', \"b\"] && name.startsWith('x') && (vip == 1 || !(risk == 'high'))", "cel"))
    expr = optimize(frontends.parse('age >= 30 and city in ["a", "b"] and hasPrefix(name, "x") && (vip == 1 or not (risk == "high"))', "expr"))
    js = frontends.parse('{"and":[{"field":"age","op":">=","value":30},{"field":"city","op":"in","values":["a","b"]},{"field":"name","op":"like","value":"x%"},{"or":[{"field":"vip","op":"==","value":1.0},{"not":{"field":"risk","op":"=","value":"high"}}]}]}', "json")
    assert optimize(want) == cel == expr == js


def test_json_forms():
    assert frontends.parse('{"field":"a","op":"=","value":true}', "json") == Compare("a", "=", Value("true", True))
    assert frontends.parse('{"and":[{"field":"a","op":"isnull"}]}', "json") == IsNull("a")
    assert frontends.parse('{"field":"a","op":"notin","values":[]}', "json") == In("a", (), True)
    assert frontends.parse('{"field":"a","op":"between","values":[-1, 2.5]}', "json") == Between("a", Value("-1"), Value("2.5"))
    for bad in ("{}", "[]", "x", '{"field":"a","op":"~","value":1}', '{"field":"a","op":"between","values":[1]}', '{"field":"a","op":"like","value":1}', '{"field":"a","op":"=","value":null}'):
        with pytest.raises(RuleError):
            frontends.parse(bad, "json")


def test_code_forms():
    assert frontends.parse("a == -2", "cel") == Compare("a", "=", Value("-2"))
    assert frontends.parse("a == false", "cel") == Compare("a", "=", Value("false", True))
    assert frontends.parse('a contains "x"', "expr") == Like("a", "%x%")
    assert frontends.parse("a != nil", "expr") == IsNull("a", True)
    for dsl, bad in (("cel", "1 == a"), ("cel", "a.size(1)"), ("cel", "has(a)"), ("cel", "a"), ("expr", "a == -2"), ("expr", "len(a, 1)"), ("expr", "a + 1 == 2")):
        with pytest.raises(RuleError):
            frontends.parse(bad, dsl)


def test_registry():
    assert {"native", "json", "cel", "expr", "qlbridge", "vitess"} <= set(frontends.names())
    assert frontends.names() == sorted(frontends.names())
    frontends.register("upper", lambda text: frontends.parse(text.lower()))
    assert frontends.parse("A = 1", "upper") == Compare("a", "=", Value("1"))
    for name in ("vitess", "nothing"):
        with pytest.raises(RuleError):
            frontends.parse("a = 1", name)
    assert frontends.parse("a = bare", "qlbridge") == Compare("a", "=", Value("bare", True))
    with pytest.raises(RuleError):
        frontends.parse("a NOT IN (1)", "qlbridge")


def test_decision_table():
    table = DecisionTable.of({"name": "t", "id_base": 7000, "rows": [{"name": "a", "priority": 3, "when": [{"field": "x", "op": ">=", "value": 1}, {"field": "s", "op": "=", "value": "it's"}]}, {"name": "b", "enabled": False, "when": [{"field": "x", "op": "between", "values": [-1, 2]}]}]})
    a, b = table.rules()
    assert (a.id, a.expr, a.enabled, b.id, b.enabled) == (7000, r"x >= 1 AND s = 'it\'s'", True, 7001, False)
    for when in ([], [{"field": "x", "op": "<>", "value": 1}], [{"field": "x", "op": "not_in", "values": [1]}]):
        with pytest.raises(RuleError):
            DecisionTable.of({"rows": [{"when": when}]}).rules()


@pytest.mark.parametrize("x, text", [(30.0, "30"), (1e7, "10000000"), (123456789.125, "123456789.125"), (1e-7, "0.0000001"), (1e21, "1" + "0" * 21), (-0.0, "-0"), (float("nan"), "NaN"), (float("-inf"), "-Inf"), (0.1, "0.1")])
def test_plain_number(x, text):
    assert plain_number(x) == text
