"""Global order in ranges, and groups connected through shared keys, against plain versions."""

import hashlib

from pyspark.sql import functions as F

from quillon.operators import datasets, evaluate, explain, ordering
from quillon.sources.shared import checkpointed


def test_positions_and_running_sums(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 13).alias("v"), F.lit("x").alias("_n")).repartition(5)
    got = {r["k"]: (r["position"], r["total"], r["_n"]) for r in ordering.positioned(df, [F.col("k")], {"total": "v"}).collect()}
    at, want = 0, {}
    for place, (k, v) in enumerate(sorted((r["k"], r["v"]) for r in df.collect()), 1):
        at += v
        want[k] = (place, at, "x")
    assert got == want
    assert ordering.positioned(df.limit(0), [F.col("k")], {"total": "v"}).count() == 0


def test_places_in_a_long_group(spark):
    df = spark.range(500).select(F.when(F.col("id") % 5 == 0, "b").when(F.col("id") == 7, None).otherwise("a").alias("g"), ((F.col("id") * 31) % 500).alias("k"))
    rows = [(r["g"] or "", r["k"]) for r in df.collect()]
    got = {(r["g"] or "", r["k"]): r["turn"] for r in datasets.interleaved(df, "g", ["k"]).collect()}
    assert got == {(g, k): sorted(x for h, x in rows if h == g).index(k) + 1 for g, k in rows}


def test_block_digest(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.col("id").cast("string").alias("t"))
    got = {r["g"]: r["digest"] for r in evaluate.block_digest(df, "g", "k", "t", 8).collect()}
    digest = lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    for g in (0, 1):
        lines = [str(i) for i in range(g, 100, 2)]
        assert got[g] == digest([digest(lines[i : i + 8]) for i in range(0, 50, 8)])


def test_connected_groups(spark):
    rows = [(k, g) for g in range(60) for k in {g // 4 * 10, g % 7 + 1000 if g < 20 else g + 5000}]
    got = {r["g"]: r["root"] for r in datasets.merged_groups(spark.createDataFrame(rows, "k long, g long"), "k", "g", checkpointed).collect()}
    root = list(range(60))
    changed = True
    while changed:
        changed = False
        for k in {k for k, _ in rows}:
            members = [g for kk, g in rows if kk == k]
            least = min(root[g] for g in members)
            changed |= any(root[g] != least for g in members)
            for g in members:
                root[g] = least
    assert got == dict(enumerate(root))


def test_nearest_in_blocks(spark, monkeypatch):
    df = spark.range(60).select("id", (F.col("id") * F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("s"))
    asked = df.where("id % 4 = 0")
    whole = sorted(map(tuple, explain.nearest(asked, df, ["x"], [], ["s"], 4, "id").collect()))
    monkeypatch.setattr(explain, "MOST_SENT", 4)
    monkeypatch.setattr(explain, "BLOCK_ROWS", 25)
    assert sorted(map(tuple, explain.nearest(asked, df, ["x"], [], ["s"], 4, "id").collect())) == whole and len(whole) == 60
