"""The expression language: predicates, arithmetic, assignments, ranges, and JSON predicates, compiled to Columns.

Arithmetic is on doubles with IEEE comparisons: NaN equals nothing, and a
division by zero is NaN. Operands are plain columns where they can be, so that
comparisons with constants reach the scan.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX = 1.7976931348623157e308
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z][A-Za-z0-9_]*)|(\|\||&&|==|!=|>=|<=|--|[-+*/!<>=()]))")


class ExpressionError(ValueError):
    pass


def _guard_log(f):
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))


def _whole(f):
    return lambda x: F.when(F.abs(x) < 2.0**52, f(x).cast("double")).otherwise(x)


FUNCTIONS = {
    "floor": _whole(F.floor), "ceil": _whole(F.ceil), "round": lambda x: F.round(x), "abs": F.abs, "fabs": F.abs, "sqrt": F.sqrt,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh,
    "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "log": _guard_log(F.log), "log2": _guard_log(F.log2), "log10": _guard_log(F.log10),
    "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x),
}
CONSTANTS = {"nan": math.nan, "lowest": -MAX, "highest": MAX}
TESTS = {"isnan": F.isnan, "ismax": lambda x: x == MAX, "ismin": lambda x: x == -MAX}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected text at {at}: {text[at:]!r}")
        if m[3] == "--":
            raise ExpressionError("'--' is not an operator")
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]))
        at = m.end()
    return out


class _Value:
    """A typed node: kind 'number' or 'truth', a Column, and the constant where it is one; ``plain``: a bare column."""

    def __init__(self, kind, column, constant=None, plain=False):
        self.kind, self.column, self.constant, self.plain = kind, column, constant, plain


def _const(x: float) -> _Value:
    return _Value("number", F.lit(float(x)), float(x))


def _maybe_nan(v: _Value) -> bool:
    return v.constant is None or math.isnan(v.constant)


class Parser:
    def __init__(self, text: str, dims: list[str] | None):
        self.t, self.at, self.dims = tokens(text), 0, dims
        self.by_lower = {d.lower(): d for d in dims} if dims is not None else {}

    def peek(self, *ops):
        return self.at < len(self.t) and self.t[self.at][0] == "op" and self.t[self.at][1] in ops

    def take(self, *ops):
        if self.peek(*ops):
            self.at += 1
            return self.t[self.at - 1][1]
        return None

    def need(self, op):
        if not self.take(op):
            raise ExpressionError(f"expected {op!r}")

    def either(self) -> _Value:
        return self._logic("||", lambda a, b: a | b, self.both)

    def both(self) -> _Value:
        return self._logic("&&", lambda a, b: a & b, self.negated)

    def _logic(self, op, join, below):
        left = below()
        while self.take(op):
            right = below()
            if left.kind != "truth" or right.kind != "truth":
                raise ExpressionError(f"{op} needs conditions")
            left = _Value("truth", join(left.column, right.column))
        return left

    def negated(self) -> _Value:
        if self.take("!"):
            v = self.compared()
            if v.kind != "truth":
                raise ExpressionError("! needs a condition")
            return _Value("truth", ~v.column)
        return self.compared()

    def compared(self) -> _Value:
        if self.at + 1 < len(self.t) and self.t[self.at][0] == "name" and self.t[self.at][1].lower() in TESTS and self.t[self.at + 1][1] == "(":
            f = TESTS[self.t[self.at][1].lower()]
            self.at += 2
            v = self.sum()
            self.need(")")
            return _Value("truth", f(v.column))
        left = self.sum()
        while op := self.take("==", "!=", ">=", "<=", ">", "<"):
            right = self.sum()
            if left.kind != "number" or right.kind != "number":
                raise ExpressionError(f"{op} needs numbers")
            left = self._compare(op, left, right)
        return left

    @staticmethod
    def _compare(op, a: _Value, b: _Value) -> _Value:
        x, y = a.column, b.column
        if a.constant is not None and b.constant is not None:
            p, q = a.constant, b.constant
            got = {"==": p == q, "!=": p != q, ">": p > q, ">=": p >= q, "<": p < q, "<=": p <= q}[op]
            return _Value("truth", F.lit(got), got)
        guards = [~F.isnan(v.column) for v in (a, b) if _maybe_nan(v)]
        if op == "!=":
            return _Value("truth", reduce(lambda p, q: p | q, [~g for g in guards], x != y))
        base = {"==": x == y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
        return _Value("truth", reduce(lambda p, q: p & q, guards, base))

    def sum(self) -> _Value:
        left = self.product()
        while op := self.take("+", "-"):
            left = self._arith(op, left, self.product())
        return left

    def product(self) -> _Value:
        left = self.signed()
        while op := self.take("*", "/"):
            left = self._arith(op, left, self.signed())
        return left

    @staticmethod
    def _arith(op, a: _Value, b: _Value) -> _Value:
        if a.kind != "number" or b.kind != "number":
            raise ExpressionError(f"{op} needs numbers")
        if a.constant is not None and b.constant is not None:
            p, q = a.constant, b.constant
            if op == "/" and q == 0:
                raise ExpressionError("division by zero")
            return _const(p + q if op == "+" else p - q if op == "-" else p * q if op == "*" else p / q)
        x, y = a.column, b.column
        if op == "/":
            if b.constant:
                return _Value("number", x / y)
            return _Value("number", F.when(y == 0, F.lit(math.nan)).otherwise(x / y))
        return _Value("number", x + y if op == "+" else x - y if op == "-" else x * y)

    def signed(self) -> _Value:
        if self.take("-"):
            v = self.primary()
            if v.kind != "number":
                raise ExpressionError("- needs a number")
            return _const(-v.constant) if v.constant is not None else _Value("number", -v.column)
        return self.primary()

    def primary(self) -> _Value:
        if self.at >= len(self.t):
            raise ExpressionError("expression ends early")
        kind, text = self.t[self.at]
        self.at += 1
        if kind == "number":
            return _const(float(text))
        if kind == "name":
            if self.take("("):
                low = text.lower()
                if low in CONSTANTS and self.take(")"):
                    return _const(CONSTANTS[low])
                if low not in FUNCTIONS:
                    raise ExpressionError(f"no function {text!r}")
                v = self.sum()
                self.need(")")
                if v.kind != "number":
                    raise ExpressionError(f"{text} needs a number")
                return _Value("number", FUNCTIONS[low](v.column))
            if self.dims is not None and text.lower() not in self.by_lower:
                raise ExpressionError(f"no dimension {text!r}")
            return _Value("number", F.col(self.by_lower.get(text.lower(), text)).cast("double"), plain=True)
        if text == "(":
            v = self.either()
            self.need(")")
            return v
        raise ExpressionError(f"unexpected {text!r}")

    def end(self):
        if self.at < len(self.t):
            raise ExpressionError(f"unexpected {self.t[self.at][1]!r}")


def condition(text: str, dims: list[str] | None = None) -> Column:
    """Boolean Column; an empty text is true. A constant or a number is an error."""
    if not text.strip():
        return F.lit(True)
    p = Parser(text, dims)
    v = p.either()
    p.end()
    if v.kind != "truth":
        raise ExpressionError("a condition is needed, not a number")
    if v.constant is not None:
        raise ExpressionError("the condition is constant")
    return v.column


def arithmetic(text: str, dims: list[str] | None = None) -> Column:
    p = Parser(text, dims)
    v = p.sum()
    p.end()
    if v.kind != "number":
        raise ExpressionError("a number is needed")
    return v.column


def assignment(text: str, dims: list[str] | None = None) -> tuple[str, Column, Column | None]:
    """(dimension, value, condition or None) of ``Dim = value [WHERE condition]``."""
    m = re.match(r"\s*([A-Za-z][A-Za-z0-9_]*)\s*=(?!=)(.*?)(?:\bWHERE\b(.*))?$", text, re.S)
    if not m or not m[2].strip():
        raise ExpressionError(f"not an assignment: {text!r}")
    return m[1], arithmetic(m[2], dims), condition(m[3], dims) if m[3] is not None else None


RANGE = re.compile(r"\s*([A-Za-z][A-Za-z0-9_ ]*?)\s*(!?)\s*([\[(])\s*([^:\])]*?)\s*:\s*([^:\])]*?)\s*([\])])\s*")


class Range:
    """``Name[!][lo:hi]``: a bound in round brackets is excluded, a missing one is open."""

    def __init__(self, text: str):
        m = RANGE.fullmatch(text)
        if not m:
            raise ExpressionError(f"not a range: {text!r}")
        self.name, self.negated = m[1], bool(m[2])
        self.low, self.high = float(m[4]) if m[4] else -MAX, float(m[5]) if m[5] else MAX
        self.low_in, self.high_in = m[3] == "[", m[6] == "]"

    def column(self) -> Column:
        x = F.col(self.name).cast("double")
        lo = x >= self.low if self.low_in else x > self.low
        hi = x <= self.high if self.high_in else x < self.high  # false for NaN, which Spark puts above all numbers
        return ~(lo & hi) if self.negated else lo & hi


def ranges(text: str) -> list[Range]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(text + ","):
        depth += (c in "[(") - (c in "])")
        if c == "," and depth == 0:
            out.append(Range(text[start:k]))
            start = k + 1
    return out


def range_condition(text: str, any_of: bool = False) -> Column:
    """Or within a dimension, and across dimensions; ``any_of``: or of all."""
    by: dict[str, list[Column]] = {}
    for r in ranges(text):
        by.setdefault("" if any_of else r.name, []).append(r.column())
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, cs) for cs in by.values()])


def json_condition(tree: str | dict) -> Column:
    """A predicate of $eq $gt $gte $lt $lte $ne $in $nin under dimensions, joined by $and $or $nor $not."""
    tree = json.loads(tree) if isinstance(tree, str) else tree
    return _json_node(tree)


def _json_node(tree) -> Column:
    if not isinstance(tree, dict) or not tree:
        raise ExpressionError("an object is needed")
    parts = []
    for key, val in tree.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(val, list) or not val:
                raise ExpressionError(f"{key} needs a list")
            cs = [_json_node(v) for v in val]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), cs))
            if key == "$nor":
                parts[-1] = ~parts[-1]
        elif key == "$not":
            parts.append(~_json_node(val))
        elif key.startswith("$"):
            raise ExpressionError(f"unknown operator {key!r}")
        else:
            parts += [_json_compare(F.col(key).cast("double"), op, v) for op, v in (val.items() if isinstance(val, dict) else [("$eq", val)])]
    return reduce(lambda a, b: a & b, parts)


def _json_compare(x: Column, op: str, val) -> Column:
    many = [float(v) for v in val] if op in ("$in", "$nin") else None
    one = None if many is not None else val if isinstance(val, str) else float(val)
    y = F.col(one).cast("double") if isinstance(one, str) else F.lit(one)
    real = ~F.isnan(x)
    if op == "$eq":
        return real & (x == y)
    if op == "$ne":
        return ~real | (x != y)
    if op == "$gt":
        return real & (x > y)
    if op == "$gte":
        return real & (x >= y)
    if op == "$lt":
        return x < y
    if op == "$lte":
        return x <= y
    if op == "$in":
        return x.isin(many)
    if op == "$nin":
        return ~x.isin(many)
    raise ExpressionError(f"unknown operator {op!r}")
