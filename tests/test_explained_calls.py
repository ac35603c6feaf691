"""explained_calls against brute force over the smallest tables."""

import os

import pytest

from quillon import catalog
from quillon.queries.cases import scored

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't there")


def test_explained_calls(spark):
    rows = scored(spark, DATA).select("case_id", "age_days", "prior", "total", "status", "tier").collect()
    spread = {c: max(r[c] for r in rows) - min(r[c] for r in rows) for c in ("age_days", "prior", "total")}

    def distance(a, b):
        parts = [min(abs(a[c] - b[c]) / s, 1.0) if a[c] != b[c] else 0.0 for c, s in spread.items()] + [float(a[c] != b[c]) for c in ("status", "tier")]
        return round(sum(parts) / len(parts), 9)

    asked = [r for r in rows if r["case_id"] % 20 == 0]
    want = {a["case_id"]: ",".join(str(i) for _, i in sorted((distance(a, b), b["case_id"]) for b in rows)[:3]) for a in asked}
    got = {r["query"]: r["nearest"] for r in catalog.QUERIES["explained_calls"](spark, DATA).collect()}
    assert got == want and len(got) > len(rows) / 40
