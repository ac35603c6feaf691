import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators import generate, rules, workflow
from quillon.sources import connectors, json_records, tables

FIELDS = [generate.Field("n", low=0, high=9, thresholds=(5,)), generate.Field("s", choices=("a", "b"))]
N_, S_ = rules.given("n"), rules.given("s")
RULES = [rules.always(N_ > 5, "yes"), rules.always((N_ <= 5) & S_.eq("a"), "no")]
LABELLER = workflow.RuleLabeller(RULES, ["no", "yes"])


def test_labellers_and_refill(spark):
    df = workflow.decided(spark, 12, "w", FIELDS, LABELLER, known=spark.createDataFrame([(9, "a")], "n long, s string"), share=1.0)
    rows = df.collect()
    assert len(rows) == 9 or len(rows) == 12 and len({(r["n"], r["s"]) for r in rows}) == 12
    assert all(r["label"] == ("yes" if r["n"] > 5 else "no") and (r["n"], r["s"]) != (9, "a") for r in rows)
    other = workflow.BatchLabeller(lambda: lambda b: ["no"] * len(b))
    both = workflow.labelled_first(generate.sample(spark, 40, "w", FIELDS), LABELLER, other, "row_id").collect()
    assert len(both) == 40 and {r["by"] for r in both} == {"first", "second"} and all(r["by"] == "second" for r in both if r["n"] <= 5 and r["s"] == "b")


def test_adversarial_pairs(spark):
    df = generate.sample(spark, 30, "w", FIELDS)
    boundary, twins = workflow.adversarial(df, FIELDS, LABELLER, {0: lambda p: F.col(p + "n") > 5}, per_rule=4)
    got = boundary.collect()
    assert len(got) == 4 and all((r["n"] > 5) != (r["twin"]["n"] > 5) for r in got)
    assert twins.count() > 0 and twins.where("label = was").count() == 0 and twins.groupBy("row_id").count().where("count > 1").isEmpty()


def test_verify_advice_and_text(spark):
    df = spark.createDataFrame([(0.9, True, 0.02), (0.8, False, 0.5)], "c double, ok boolean, loss double")
    out = workflow.verify(df, [("c", "ok", "loss")], {"accuracy": 0.9, "ece": 1.0, "brier": 1.0}).withColumn("next", workflow.advice(F.col("failed"), F.lit(0.9)))
    r = out.first()
    assert r["failed"] == ["accuracy"] and r["next"].startswith("add examples") and r["cases"] == 2
    assert workflow.table_text(spark.createDataFrame([(1, "x")], "a int, bb string")) == "a  bb\n-  --\n1  x"


def test_connectors(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "id,v\n1,x\n,y\n")
        z.writestr("two.csv", "id,v\n2,z\n")
        z.writestr("note.txt", "-")
    got = connectors.zipped_sheets(spark, str(tmp_path / "a.zip"), "id double, v string", ["id"])
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(1.0, "x"), (2.0, "z")]
    store = tables.Store(spark, str(tmp_path / "s"))
    connectors.put_keyed(store, "k", "f", spark.createDataFrame([("a", 1), ("b", 2)], "f string, v int"))
    connectors.put_keyed(store, "k", "f", spark.createDataFrame([("b", 3)], "f string, v int"))
    assert {(r["f"], r["v"]) for r in connectors.keyed(store, "k").collect()} == {("a", 1), ("b", 3)}
    fetched = []
    fetch = lambda: fetched.append(1) or [{"model": "m", "input": "3", "output": 15}, {"model": "bad", "input": "?"}]
    assert connectors.prices(store, "p", fetch).count() == connectors.prices(store, "p", fetch).count() == 1 and len(fetched) == 1
    path = str(tmp_path / "db")
    open_ = lambda: sqlite3.connect(path)
    connectors.transactional(open_, lambda c: c.execute("create table t (x)"))
    with pytest.raises(ZeroDivisionError):
        connectors.transactional(open_, lambda c: (c.execute("insert into t values (1)"), 1 / 0))
    assert connectors.transactional(open_, lambda c: c.execute("select count(*) from t").fetchall()) == [(0,)]
    (tmp_path / "b.json").write_text(connectors.bundle_text([{"id": "f2"}, {"id": "f1", "x": "é"}]))
    assert [r["id"] for r in json_records.functions_of(spark, str(tmp_path / "b.json")).collect()] == ["f1", "f2"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.json").write_text('{"function_id": "f1", "cases": [{"inputs": {"text": "t"}}, {"inputs": {"text": "t"}}]}')
    (tmp_path / "c" / "bad.json").write_text("{")
    assert connectors.seen_inputs(spark, str(tmp_path / "c"), "f1").count() == 1
