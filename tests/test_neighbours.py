"""explain.nearest by cells against all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators import explain, neighbours


def all_pairs(queries, candidates, numbers, flags, k):
    scored = explain.in_pairs(queries, candidates, numbers, [], flags, "id")
    rank = F.row_number().over(explain.Window.partitionBy("query").orderBy("distance", "neighbour"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def same(got, want):
    return sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def table(spark, n, seed):
    rng = np.random.default_rng(seed)
    odd = [None, float("nan"), float("inf"), -float("inf"), -0.0]
    rows = []
    for i in range(n):
        y = float(rng.normal()) if rng.random() < 0.5 else float(rng.integers(0, 8)) / 8
        y = odd[int(rng.integers(0, 5))] if seed % 2 and rng.random() < 0.05 else y
        x = None if rng.random() < 0.02 else int(rng.integers(0, 40))
        rows.append((1000 - i, x, y, None if rng.random() < 0.05 else "abcde"[int(rng.integers(0, 5))], bool(rng.random() < 0.3)))
    return spark.createDataFrame(rows, "id long, x int, y double, s string, b boolean")


@pytest.mark.parametrize("seed", [0, 1])
def test_cells_find_what_all_pairs_have(spark, monkeypatch, seed):
    monkeypatch.setattr(explain, "CELL_ROWS", 40)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 8)
    df = table(spark, 400, seed)
    asked = df.where("id % 7 = 0").unionByName(spark.createDataFrame([(-1, 500, -9.0, "new", True), (-2, None, None, None, None), (-3, -500, 0.5, "a", False)], df.schema))
    for numbers, flags in ((["x", "y"], ["s", "b"]), (["y"], [])):
        got = explain.by_cells(asked, df, numbers, flags, 4, "id")
        assert got is not None
        assert same(explain.nearest(asked, df, numbers, [], flags, 4, "id"), all_pairs(asked, df, numbers, flags, 4))
    few = df.where("id > 998")
    assert same(explain.nearest(asked, few, ["x", "y"], [], ["s"], 4, "id"), all_pairs(asked, few, ["x", "y"], ["s"], 4))


def test_copies_meet_once(spark, monkeypatch):
    """Groups of 2,000 copies, asked for 4,000 times: pairs of rows are never made."""
    df = spark.range(8000).select("id", (F.col("id") % 4).cast("int").alias("x"), F.lit("s").alias("s"))
    monkeypatch.setattr(explain, "in_pairs", None)
    got = explain.nearest(df.where("id % 2 = 0"), df, ["x"], [], ["s"], 3, "id")
    assert got.count() == 12_000
    assert {tuple(r) for r in got.where("query = 7000").select("neighbour", "distance", "rank").collect()} == {(0, 0.0, 1), (4, 0.0, 2), (8, 0.0, 3)}


def test_few_pairs_are_compared():
    """20,000 vectors and 1,000 queries: a tenth of all pairs is compared at most."""
    rng = np.random.default_rng(3)
    space, n = neighbours.Space([1.0, 1.0], 1), 20_000
    pairs, real = [], space.distances
    space.distances = lambda a, b: pairs.append(len(a[0]) * len(b[0])) or real(a, b)
    x, f = rng.random((n, 2)), rng.integers(0, 25, (n, 1))
    keys = np.ma.masked_array(np.arange(n)[:, None] + np.zeros((1, 5), int), np.arange(5)[None, :] + np.zeros((n, 1)) > 0)
    d, found = neighbours.search(space, (x[:1000], f[:1000]), np.full(1000, neighbours.NONE), (x, f), keys, 5)
    assert sum(pairs) <= n * 1000 / 10
    all_d = real((x[:50], f[:50]), (x, f))
    want = [sorted(zip(row.tolist(), range(n)))[:5] for row in all_d]
    assert [list(zip(a, b)) for a, b in zip(d[:50].tolist(), found[:50].tolist())] == want


def test_rounding_is_sparks(spark):
    values = [0.0, 1.0, 0.1234567885, 0.12345678850000001, 0.0000000005, 0.00000000049999, 2 / 3, 0.3333333335, 0.0000000015, 0.9999999995]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9)).collect()]
    assert (neighbours.rounded(np.array(values)) / neighbours.UNIT).tolist() == want


def test_what_cells_do_not_hold_goes_by_pairs(spark):
    big = spark.createDataFrame([(1, 1 << 60, "a"), (2, (1 << 60) + 1, "a"), (3, 0, "b")], "id long, x long, s string")
    assert explain.by_cells(big, big, ["x"], ["s"], 2, "id") is None
    assert explain.nearest(big, big, ["x"], [], ["s"], 2, "id").count() == 6


def test_explained_calls_makes_no_pairs(spark, monkeypatch):
    """sf0.001 has 75 x 1,500 pairs; explained_calls makes them neither there nor on larger tables."""
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the test tables aren't there")
    monkeypatch.setattr(explain, "in_pairs", None)
    got = catalog.QUERIES["explained_calls"](spark, data).collect()
    assert got and all(len(r["nearest"].split(",")) == 3 for r in got)
