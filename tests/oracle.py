"""Rules over Python dicts, one row at a time: the plain statement of what the Spark plans must give."""

import math

from predica.plans.ir import Between, Compare, In, IsNull, Like, Logic, Not, plain_number


def as_text(v):
    if isinstance(v, bool):
        return "true" if v else "false"
    return v if isinstance(v, str) else plain_number(float(v))


def is_number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def holds(node, row) -> bool:
    if isinstance(node, Logic):
        return (all if node.op == "AND" else any)([holds(a, row) for a in node.args])
    if isinstance(node, Not):
        return not holds(node.arg, row)
    v = row.get(node.field)
    if isinstance(v, (list, dict, tuple)):
        v = None
    if isinstance(node, IsNull):
        return (v is None) != node.negate
    if isinstance(node, Between):
        return is_number(v) and node.low.number <= v <= node.high.number
    if isinstance(node, In):
        return (v is not None and as_text(v) in {x.text for x in node.values}) != node.negate
    if isinstance(node, Like):
        test = {"prefix": str.startswith, "suffix": str.endswith, "contains": str.__contains__, "equals": str.__eq__}[node.kind]
        return (v is not None and test(as_text(v), node.core)) != node.negate
    assert isinstance(node, Compare)
    if v is None:
        return False
    if is_number(v) and not node.value.is_string:
        a, b = float(v), node.value.number
    else:
        a, b = as_text(v).encode(), node.value.as_text.encode()
    if isinstance(a, float) and math.isnan(a):
        return node.op == "!="
    return {"=": a == b, "==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[node.op]
