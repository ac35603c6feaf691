"""explained_calls explains every case, not those of some ids."""

import os

import duckdb
import numpy as np
import pytest

from quillon import catalog
from quillon.queries.cases import SCORED

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't there")


def test_every_call_is_explained(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{DATA}/orders.parquet'")
    sql = f"WITH {SCORED} SELECT case_id, value, [rule_0, rule_1, rule_2, rule_3, rule_4, rule_5] AS held, age_days, prior, total, status, tier FROM scored"
    rows = con.execute(sql).fetchall()
    assert len(rows) == con.execute("SELECT count(*) FROM orders").fetchone()[0]
    ids = np.array([r[0] for r in rows])
    total = np.zeros((len(rows), len(rows)))
    for i in (3, 4, 5):
        x = np.array([r[i] for r in rows], dtype=float)
        total += np.minimum(np.abs(x[:, None] - x) / np.ptp(x), 1.0)
    for i in (6, 7):
        x = np.array([r[i] for r in rows])
        total += x[:, None] != x
    distance = np.round(total / 5, 9)
    want = {}
    for at, (case, value, held, *_) in enumerate(rows):
        # rule 0 forbids approve, the others ask for one answer each
        broken = [i for i, wanted in enumerate((None, "deny", "review", "deny", "review", "approve")) if held[i] and (value == "approve" if i == 0 else value != wanted)]
        nearest = ids[np.lexsort((ids, distance[at]))[:3]]
        want[case] = (value, ",".join(str(i) for i in range(6) if held[i]), ",".join(map(str, broken)), ",".join(map(str, nearest)))
    got = catalog.QUERIES["explained_calls"](spark, DATA).collect()
    assert len(got) == len(rows)
    assert {r["query"]: tuple(r)[1:] for r in got} == want
