import pytest
from pyspark.sql import functions as F

from quillon.operators import rules as R

x, y, s, o = (R.given(n) for n in ("x", "y", "s", "o"))
#: (predicate, record, what it gives); "error" where it must raise
VECTORS = [
    (x > 3, {"x": 4.0}, True), (x >= 4, {"x": 4.0}, True), (x < 4, {"x": 4.0}, False), (x <= 3, {"x": 4.0}, False),
    (x.eq(0.0), {"x": -0.0}, True), (x.ne(1), {"x": 1.0}, False), (x.eq("1"), {"x": 1.0}, False), (s.eq("a"), {"s": "a"}, True),
    (~(x > 3), {"x": 4.0}, False), ((x > 3) & (y > 3), {"x": 4.0, "y": 3.0}, False), ((x > 3) | (y > 3), {"x": 4.0, "y": 3.0}, True),
    (x + y > 6, {"x": 4.0, "y": 3.0}, True), (x - y >= 1, {"x": 4.0, "y": 3.0}, True), (x * y > 12, {"x": 4.0, "y": 3.0}, False),
    (x / y > 1, {"x": 4.0, "y": 3.0}, True), (x % y < 0, {"x": -7.0, "y": 3.0}, True), (x**y > 63, {"x": 4.0, "y": 3.0}, True),
    (x / y > 1, {"x": 4.0, "y": 0.0}, "error"), ((x > 9) & (x / y > 1), {"x": 4.0, "y": 0.0}, False), ((x > 3) | (x / y > 1), {"x": 4.0, "y": 0.0}, True),
    (s.length > 1, {"s": "\U0001f600"}, True), (s[0].eq("a"), {"s": "abc"}, True), (s[5].eq("a"), {"s": "abc"}, False),
    (R.node("￿") > s, {"s": "\U00010000"}, True), (-x < 0, {"x": 4.0}, True), (o.a.eq("v"), {"o": {"a": "v"}}, True), (o.a.length.eq(1), {"o": {"a": "v"}}, True),
]


def frame(spark, record):
    kinds = {float: "double", str: "string", dict: "struct<a:string>"}
    return spark.createDataFrame([tuple(record.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in record.items()))


@pytest.mark.parametrize("i", range(len(VECTORS)))
def test_both_evaluators(spark, i):
    predicate, record, want = VECTORS[i]
    df = frame(spark, record)
    if want == "error":
        with pytest.raises(R.RuleError):
            R.evaluate(predicate, record)
        with pytest.raises(Exception, match="zero|finite"):
            df.select(R.column(predicate, df.schema)).collect()
    else:
        assert R.evaluate(predicate, record) is want
        assert df.select(R.column(predicate, df.schema)).first()[0] is want


def test_checks():
    ok = R.always(x > 1, "a")
    R.check([ok, R.never(x > 2, "b")], ["a", "b"])
    for bad in ([R.always(R.node(True), "a")], [ok, R.always(x > 1, "b")], [ok, R.never(x > 1, "a")], [R.always(x > 1, "c")]):
        with pytest.raises(R.RuleError):
            R.check(bad, ["a", "b"])


def test_labels(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (9.0,)], "x double")
    rules = [R.always(x > 4, "a"), R.never(x > 8, "a"), R.never(x <= 4, "a"), R.never(x <= 4, "b")]
    out = R.with_rules(df, rules, ["a", "b", "c"]).withColumn("ok", R.admissible(rules, ["a", "b", "c"])).withColumn("l", R.rule_label(F.col("ok")))
    assert [(r["ok"], r["l"]) for r in out.orderBy("x").collect()] == [(["c"], "c"), (["a"], "a"), ([], None)]
    active, broken = R.activity(rules, F.lit("b"))
    got = R.with_rules(df, rules, ["a", "b", "c"]).orderBy("x").select(active.alias("a"), broken.alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [([2, 3], [3]), ([0], [0]), ([0, 1], [0])]
