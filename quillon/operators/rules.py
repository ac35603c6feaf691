"""Rules: a closed predicate language compiled to Columns.

A predicate is a small tree of nodes built with the functions here. A rule says
that where its predicate holds the output must (`always`) or must not (`never`)
be one value. Predicates become boolean Columns, so Catalyst fuses all rules of
a function into one projection; the right side of && and || is guarded where
it could raise.

Semantics: equality is by value for numbers, never across types, and a missing
property (undefined) equals only another missing one; order compares numbers or
texts (by UTF-16 units); arithmetic raises on results that aren't finite.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import utf16, utf16_length

MOST_NODES, MOST_DEPTH, MOST_RULES = 100_000, 100, 10_000
LOGIC, EQUALITY, ORDER, ARITHMETIC = ("&&", "||"), ("===", "!=="), ("<", "<=", ">", ">="), ("+", "-", "*", "/", "%", "**")


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """One node of a predicate; operators of Python build trees."""

    kind: str
    value: object = None
    parts: tuple[Node, ...] = ()

    def __getattr__(self, name: str) -> Node:
        if name.startswith("_"):
            raise AttributeError(name)
        return Node("property", name, (self,))

    def __getitem__(self, index) -> Node:
        return Node("index", None, (self, node(index)))

    def _binary(self, op: str, other) -> Node:
        return Node("binary", op, (self, node(other)))

    def eq(self, other) -> Node:
        return self._binary("===", other)

    def ne(self, other) -> Node:
        return self._binary("!==", other)

    def __lt__(self, other):
        return self._binary("<", other)

    def __le__(self, other):
        return self._binary("<=", other)

    def __gt__(self, other):
        return self._binary(">", other)

    def __ge__(self, other):
        return self._binary(">=", other)

    def __and__(self, other):
        return self._binary("&&", other)

    def __or__(self, other):
        return self._binary("||", other)

    def __add__(self, other):
        return self._binary("+", other)

    def __sub__(self, other):
        return self._binary("-", other)

    def __mul__(self, other):
        return self._binary("*", other)

    def __truediv__(self, other):
        return self._binary("/", other)

    def __mod__(self, other):
        return self._binary("%", other)

    def __pow__(self, other):
        return self._binary("**", other)

    def __invert__(self):
        return Node("unary", "!", (self,))

    def __neg__(self):
        return Node("unary", "-", (self,))

    def __pos__(self):
        return Node("unary", "+", (self,))

    def tree(self) -> dict:
        """The node as JSON-able data; equal predicates have equal trees."""
        return {"kind": self.kind, "value": self.value, "parts": [p.tree() for p in self.parts]}


def node(value) -> Node:
    return value if isinstance(value, Node) else Node("literal", value)


def given(name: str) -> Node:
    """An input of the function."""
    return Node("input", name)


@dataclass(frozen=True)
class Rule:
    kind: str  # always | never
    predicate: Node
    output: object


def always(predicate: Node, output) -> Rule:
    return Rule("always", predicate, output)


def never(predicate: Node, output) -> Rule:
    return Rule("never", predicate, output)


def check(rules: list[Rule], support: list) -> None:
    """Limits, outputs inside the support, predicates that read an input, no contradictions."""
    if len(rules) > MOST_RULES:
        raise RuleError("too many rules")
    wanted: dict[str, object] = {}
    count = 0

    def walk(n: Node, depth: int) -> bool:
        nonlocal count
        count += 1
        if depth > MOST_DEPTH or count > MOST_NODES:
            raise RuleError("the predicates are too deep or too many")
        return (n.kind == "input") | any([walk(p, depth + 1) for p in n.parts])

    for i, r in enumerate(rules):
        if r.kind not in ("always", "never") or r.output not in support:
            raise RuleError(f"rule {i} names an output outside the support")
        if not walk(r.predicate, 1):
            raise RuleError(f"rule {i} does not depend on an input")
        key = json.dumps(r.predicate.tree(), sort_keys=True)
        if r.kind == "always" and wanted.setdefault(key, r.output) != r.output:
            raise RuleError(f"rule {i} contradicts an earlier rule with the same predicate")
        if r.kind == "never" and wanted.get(key, object()) == r.output:
            raise RuleError(f"rule {i} forbids what an earlier rule with the same predicate requires")


UNDEFINED = "undefined"


class Compiler:
    """Predicates over the columns of a schema -> Columns. optional: names of top-level or nested fields whose null means that they are missing."""

    def __init__(self, schema: T.StructType, optional: frozenset[str] = frozenset()):
        self.schema, self.optional = schema, optional

    def compile(self, n: Node) -> tuple[Column, object]:
        """(column, type); type is a Spark type, or UNDEFINED for what is never there."""
        return getattr(self, "_" + n.kind)(n)

    def _literal(self, n):
        v = n.value
        if v is None:
            return F.lit(None), T.NullType()
        if isinstance(v, bool):
            return F.lit(v), T.BooleanType()
        if isinstance(v, (int, float)):
            return F.lit(float(v)), T.DoubleType()
        return F.lit(v), T.StringType()

    def _input(self, n):
        if n.value not in self.schema.names:
            raise RuleError(f"a predicate reads the missing input {n.value!r}")
        return self.typed(F.col(n.value), self.schema[n.value].dataType)

    def typed(self, col, kind):
        return (col.cast("double"), T.DoubleType()) if isinstance(kind, T.NumericType) else (col, kind)

    def _property(self, n):
        col, kind = self.compile(n.parts[0])
        if isinstance(kind, T.StructType):
            return self.typed(col[n.value], kind[n.value].dataType) if n.value in kind.names else (F.lit(None), UNDEFINED)
        if n.value == "length" and isinstance(kind, T.StringType):
            return utf16_length(col).cast("double"), T.DoubleType()
        if n.value == "length" and isinstance(kind, T.ArrayType):
            return F.size(col).cast("double"), T.DoubleType()
        raise RuleError(f"no property {n.value!r} on this value")

    def _index(self, n):
        (col, kind), (at, at_kind) = self.compile(n.parts[0]), self.compile(n.parts[1])
        if isinstance(kind, T.ArrayType) and isinstance(at_kind, T.DoubleType):
            whole = (at >= 0) & (at == F.floor(at))
            return self.typed(F.when(whole, F.get(col, at.cast("int"))), kind.elementType)
        if isinstance(kind, T.StringType) and isinstance(at_kind, T.DoubleType):
            inside = (at >= 0) & (at == F.floor(at)) & (at < utf16_length(col))
            return F.when(inside, F.decode(F.substring(utf16(col), (at * 2 + 1).cast("int"), F.lit(2)), "UTF-16BE")), T.StringType()
        if isinstance(kind, T.MapType):
            return self.typed(F.try_element_at(col, at.cast("string")), kind.valueType)
        raise RuleError("this value can't be indexed")

    def _unary(self, n):
        col, kind = self.compile(n.parts[0])
        if n.value == "!":
            return ~self.want(col, kind, T.BooleanType), T.BooleanType()
        col = self.want(col, kind, T.DoubleType)
        return (col if n.value == "+" else -col), T.DoubleType()

    def want(self, col, kind, what):
        if not isinstance(kind, what):
            raise RuleError(f"an operand must be {what.__name__}")
        return col

    def _binary(self, n):
        (a, ka), (b, kb) = self.compile(n.parts[0]), self.compile(n.parts[1])
        op = n.value
        if op in LOGIC:
            a, b = self.want(a, ka, T.BooleanType), self.want(b, kb, T.BooleanType)
            if not can_raise(n.parts[1]):
                return (a & b if op == "&&" else a | b), T.BooleanType()
            return (F.when(a, b).otherwise(False) if op == "&&" else F.when(a, True).otherwise(b)), T.BooleanType()
        if op in EQUALITY:
            same = self.equal(a, ka, b, kb)
            return (same if op == "===" else ~same), T.BooleanType()
        if op in ORDER:
            if isinstance(ka, T.StringType) and isinstance(kb, T.StringType):
                a, b = utf16(a), utf16(b)
            else:
                a, b = self.want(a, ka, T.DoubleType), self.want(b, kb, T.DoubleType)
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], T.BooleanType()
        a, b = self.want(a, ka, T.DoubleType), self.want(b, kb, T.DoubleType)
        if op in ("/", "%"):
            b = F.when(b == 0, F.raise_error(F.lit("a divisor is zero")).cast("double")).otherwise(b)
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "**": lambda: F.pow(a, b)}[op]()
        bad = F.isnan(out) | (F.abs(out) == F.lit(float("inf")))
        return F.when(bad, F.raise_error(F.lit("a result isn't finite")).cast("double")).otherwise(out), T.DoubleType()

    def equal(self, a, ka, b, kb):
        if ka == UNDEFINED or kb == UNDEFINED:
            other = a if kb == UNDEFINED else b
            return other.isNull() if ka != kb else F.lit(True)
        if isinstance(ka, T.NullType) or isinstance(kb, T.NullType):
            return a.isNull() & b.isNull()
        if type(ka) is not type(kb):
            return F.lit(False)
        return a.eqNullSafe(b)


def can_raise(n: Node) -> bool:
    return (n.kind == "binary" and n.value in ARITHMETIC) or any(can_raise(p) for p in n.parts)


def column(predicate: Node, schema: T.StructType) -> Column:
    col, kind = Compiler(schema).compile(predicate)
    if not isinstance(kind, T.BooleanType):
        raise RuleError("a predicate must be boolean")
    return F.coalesce(col, F.lit(False))


def with_rules(df: DataFrame, rules: list[Rule], support: list, prefix: str = "rule_") -> DataFrame:
    """A boolean column per rule: whether its predicate holds."""
    check(rules, support)
    return df.withColumns({f"{prefix}{i}": column(r.predicate, df.schema) for i, r in enumerate(rules)})


def activity(rules: list[Rule], output: Column, prefix: str = "rule_") -> tuple[Column, Column]:
    """Indexes of the active rules, and of those that the output violates."""
    each = []
    for i, r in enumerate(rules):
        fits = output == F.lit(r.output)
        each.append(F.struct(F.lit(i).alias("i"), F.col(f"{prefix}{i}").alias("active"), (fits if r.kind == "always" else ~fits).alias("ok")))
    all_ = F.array(*each)
    active = F.filter(all_, lambda x: x["active"])
    return F.transform(active, lambda x: x["i"]), F.transform(F.filter(active, lambda x: ~x["ok"]), lambda x: x["i"])


def admissible(rules: list[Rule], support: list, prefix: str = "rule_") -> Column:
    """The values of the support that violate no active rule, in support order."""
    keep = []
    for v in support:
        broken = F.lit(False)
        for i, r in enumerate(rules):
            if (r.kind == "always") != (r.output == v):
                broken = broken | F.col(f"{prefix}{i}")
        keep.append(F.when(~broken, F.lit(v)))
    return F.array_compact(F.array(*keep))


def rule_label(allowed: Column) -> Column:
    """The only admissible value; null where the rules leave none or several."""
    return F.when(F.size(allowed) == 1, F.get(allowed, F.lit(0)))


def evaluate(n: Node, record: dict):
    """The same semantics on one record in plain Python, for tests and small tables."""
    missing = object

    def run(n: Node):
        if n.kind == "literal":
            return n.value
        if n.kind == "input":
            if n.value not in record:
                raise RuleError(f"missing input {n.value!r}")
            return record[n.value]
        args = [run(n.parts[0])]
        if n.kind == "property":
            v = args[0]
            if isinstance(v, dict):
                return v.get(n.value, missing)
            if n.value == "length" and isinstance(v, (str, list)):
                return len(v.encode("utf-16-be")) // 2 if isinstance(v, str) else len(v)
            raise RuleError("no such property")
        if n.kind == "unary":
            v = args[0]
            if n.value == "!":
                return not boolean(v)
            return number(v) if n.value == "+" else -number(v)
        if n.kind == "index":
            v, at = args[0], run(n.parts[1])
            if isinstance(v, dict):
                return v.get(at, missing)
            if not is_number(at) or at < 0 or at != int(at):
                return missing
            if isinstance(v, list):
                return v[int(at)] if at < len(v) else missing
            units = v.encode("utf-16-be")
            return units[2 * int(at) : 2 * int(at) + 2].decode("utf-16-be", "surrogatepass") if 2 * at < len(units) else missing
        if n.value in LOGIC:
            a = boolean(args[0])
            return boolean(run(n.parts[1])) if a == (n.value == "&&") else a
        a, b = args[0], run(n.parts[1])
        if n.value in EQUALITY:
            return same(a, b) == (n.value == "===")
        if n.value in ORDER:
            if isinstance(a, str) and isinstance(b, str):
                a, b = a.encode("utf-16-be", "surrogatepass"), b.encode("utf-16-be", "surrogatepass")
            else:
                a, b = number(a), number(b)
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[n.value]
        return arithmetic(n.value, number(a), number(b))

    def same(a, b):
        if a is missing or b is missing:
            return a is b
        if is_number(a) and is_number(b):
            return number(a) == number(b)
        return type(a) is type(b) and not isinstance(a, (dict, list)) and a == b

    return run(n)


def is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def number(v) -> float:
    if not is_number(v) or v != v or abs(v) == float("inf"):
        raise RuleError("not a finite number")
    return float(v)


def boolean(v) -> bool:
    if not isinstance(v, bool):
        raise RuleError("not a boolean")
    return v


def arithmetic(op: str, a: float, b: float) -> float:
    import math

    try:
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "**": lambda: a**b}[op]()
    except (ArithmeticError, ValueError) as e:
        raise RuleError("a result isn't finite") from e
    if isinstance(out, complex):
        raise RuleError("a result isn't finite")
    return number(out)
