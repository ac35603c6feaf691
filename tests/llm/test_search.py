"""The permutation index at its defaults, vectors of several lengths, repeated ids."""

import numpy as np
import pytest

from quillon.llm import ann


def test_recall_at_the_defaults(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(10_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, lambda i: i % 50 == 0).collect()
    full, mine = x.astype(np.float64), {}
    for r in got:
        mine.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(full[r["query_id"]] @ full[r["vec_id"]]), abs=1e-12)
    hits = 0
    for q in range(0, 10_000, 50):
        s = full @ full[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(mine[q]))
    assert len(mine) == 200 and all(len(v) == 20 for v in mine.values()) and hits / 4000 >= 0.9


def test_vectors_of_several_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0]), (2, [1.0, 1.0, 5.0]), (3, [0.5, 3.0]), (4, [0.0, 4.0, 1.0, 1.0, 1.0]), (4, [0.0, 4.0, 0.0]), (5, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, lambda i: i % 2 == 0, k=3).orderBy("query_id", "rank").collect()]
    # under id 4 the smaller vector counts; an empty vector is zero and takes no part
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (2, 1, 4, 4.0), (2, 2, 3, 3.5), (2, 3, 1, 2.0), (4, 1, 3, 12.0), (4, 2, 2, 4.0), (4, 3, 0, 0.0)]
