import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources import json_records as J
from quillon.sources import tables
from quillon.streaming import events as streams


def test_strict_json():
    assert J.strict_loads('{"a": [1, "x", null]}') == {"a": [1.0, "x", None]}
    for bad in ('{"a":1,"a":2}', "NaN", "1e999", '"\\ud800"', "[" * 200 + "]" * 200, "{"):
        with pytest.raises(J.StrictJsonError):
            J.strict_loads(bad)
    assert J.arguments("[1, 2]") == [1.0, 2.0] and J.arguments("3") == [3.0]


def test_digests_tell_zeros_apart():
    assert J.typed_digest({"b": 1, "a": -0.0}) != J.typed_digest({"b": 1, "a": 0.0})
    assert J.typed_digest({"b": 1, "a": 2}) == J.typed_digest({"a": 2, "b": 1})


def test_typed_text(spark):
    schema = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([((1.0, ["x"]),)], T.StructType([T.StructField("r", schema)]))
    assert df.select(J.typed(F.col("r"), schema)).first()[0] == '{"object":{"a":{"array":[{"string":"x"}]},"b":{"number":"3ff0000000000000"}}}'
    assert J.json_schema(schema)["properties"]["b"] == {"type": "number"}


def test_sealed_tables(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    df = spark.range(5)
    tables.seal(store, "t", df)
    assert tables.unseal(store, "t").count() == 5 and tables.newest(store) == "t"
    with pytest.raises(tables.SealError):
        tables.seal(store, "t", df)
    spark.range(6).write.mode("overwrite").parquet(str(tmp_path / "t/rows"))
    with pytest.raises(tables.SealError):
        tables.unseal(store, "t")
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert tables.cached(store, {"q": 1}, make).count() == tables.cached(store, {"q": 1}, make).count() == 3 and len(calls) == 1


def test_releases(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    a, b = tables.release(store, spark.range(1), "2026-01-01"), tables.release(store, spark.range(2), "2026-01-02")
    store.remove("release=" + b + ".json")
    store.put("release=" + b + ".json", {"created": "2026-01-02"})
    assert store.get("current.json")["digest"] == b and tables.releases(store).where("error is null").count() == 2
    assert tables.rollback(store) == a
    with pytest.raises(tables.SealError):
        tables.rollback(store)
    assert tables.resolve(["ab", "ac"], "ab") == "ab"
    with pytest.raises(tables.SealError):
        tables.resolve(["ab", "ac"], "a")


def test_batches_are_whole(spark):
    asked = spark.createDataFrame([(1,), (2,)], "request int")
    with pytest.raises(tables.SealError):
        tables.collect_batch(asked, asked.where("request = 1"))
    assert tables.collect_batch(asked, asked.union(asked)).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2026-01-01 00:{i % 60:02d}:00", i % 3, float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t string, k long, v double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), df.schema)
    streams.drained(streams.once(stream, "ts", ["id"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120
    q = streams.windowed(stream, "ts", "k", "v", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in streams.windowed(df, "ts", "k", "v", "10 minutes").collect()}


def test_watched_pointer():
    state, loads = {"m": 1}, []
    w = streams.Watched(lambda: state["m"], lambda: loads.append(1) or len(loads))
    assert (w.get(), w.get()) == (1, 1)
    state["m"] = 2
    assert w.get() == 2
