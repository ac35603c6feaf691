"""Every query of the subpackage on the smallest tables: the contract's columns, and SQL where there is some."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, decontaminate, partenum, pii, quality, registry, urls
from tests.llm.brute import brute_components

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't there")

#: The contract's columns of each query; more may follow.
COLUMNS = {
    "op1_permutation_index": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_packing": {k: "bigint" for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")},
    "op6_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op7_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_partenum_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op10_quality": {"doc_id": "bigint", "score": "double"},
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: run(spark, DATA).cache() for name, run in registry.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, results, duck, name):
    got = results[name]
    types = dict(got.dtypes)
    assert {k: types[k] for k in COLUMNS[name]} == COLUMNS[name]
    if name in registry.ORACLES:
        columns = sorted(got.columns)
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, duck.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()))
    of = {"op2_html_extraction": "pages", "op7_url_filters": "pages"}.get(name, "documents")
    if name not in ("op1_permutation_index", "op5_packing", "op6_decontamination"):
        assert got.count() == spark.read.parquet(f"{DATA}/{of}.parquet").count()


@pytest.mark.parametrize(("name", "divisor", "left"), [("op3_language_id", 4, 2), ("op8_toxicity", 5, 0)])
def test_held_out_rows(results, name, divisor, left):
    for r in results[name].collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == left) and 0 <= r["score"] <= 1


def test_learned_queries_are_right_on_held_out_rows(spark, results):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    lang = results["op3_language_id"].join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert lang.where("lang = lang_pred").count() >= 0.95 * lang.count()
    toxic = results["op8_toxicity"].join(labels, "doc_id").where("held_out")
    assert toxic.where("predicted = toxic").count() >= 0.9 * toxic.count()
    good = results["op10_quality"].join(labels, "doc_id")
    assert good.where("keep = (quality = 1)").count() >= 0.95 * good.count()


def test_search_query_has_every_query(spark, results):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=float), np.array([r["vec_id"] for r in rows])
    hits, mine = 0, {}
    for r in results["op1_permutation_index"].orderBy("query_id", "rank").collect():
        mine.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(mine) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in mine.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s, kind="stable")[:20]].tolist()) & set(found))
    assert hits >= 0.9 * 20 * len(mine)


def test_rules_against_sql(results, duck):
    host = "lower(regexp_extract(split_part(url, '://', 2), '^[^/?#]*'))"
    fits = lambda rule: f"({host} = '{rule.split('/')[0]}' or ends_with({host}, '.{rule.split('/')[0]}')) and starts_with(regexp_extract(split_part(url, '://', 2), '^[^/?#]*([^?#]*)', 1), '/{rule.split('/', 1)[1]}')"
    cases = " ".join(f"when {fits(text)} then '{text}'" for _, text in sorted(urls.RULES, key=lambda r: -len(r[1])))
    want = dict(duck.execute(f"select page_id, case {cases} end from pages").fetchall())
    assert {r["page_id"]: r["rule"] for r in results["op7_url_filters"].collect()} == want


# columns of any name, null ids, repeated rows, empty tables


def words(rng, n):
    return " ".join(rng.choice([f"w{i}" for i in range(4000)], n))


def odd_documents(spark):
    """Rows with clashing extra columns, null and repeated ids, null texts."""
    rng = np.random.default_rng(8)
    rows = [(i if i % 4 else None, words(rng, 40), "en", f"s{i % 3}", 200) for i in range(40)]
    rows += [(1, rows[2][1], None, None, None), (2, rows[2][1], "en", "s1", 5), (2, rows[2][1], "en", "s1", 5), (None, None, None, None, None), (50, "", "en", "s1", 0)]
    names = ["score", "_score", "bad", "bad_id", "bad_own", "_gone", "_id", "_print", "_row", "spans", "removed", "base", "_text", "bad_host", "h", "rank", "key", "n", "node", "quality", "_x1"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.lit(f"own {n}") for n in names}).repartition(3)


def test_stages_keep_columns_of_any_name(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, docs.where("doc_id = 5").first()["text"]), (None, None)], "item_id long, text string")
    n = docs.count()
    for out, rows in ((quality.kept(docs, labels), n), (decontaminate.clean(docs, items), n - 1), (pii.sanitised(docs), n), (partenum.one_of_each(docs), None)):
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = out.collect()
        assert all(r["score"] == "own score" and r["spans"] == "own spans" and r["_id"] == "own _id" for r in got) and (rows is None or len(got) == rows)
    pages = spark.createDataFrame([(1, "http://a.org/x", "<a href=http://b.net/>", "own")], "page_id long, url string, html string, bad_host string")
    assert urls.judged(pages).first()["bad_host"] == "own"
    for out in (quality.kept(docs.limit(0), labels), decontaminate.clean(docs.limit(0), items), pii.sanitised(docs.limit(0)), partenum.one_of_each(docs.limit(0))):
        assert out.count() == 0 and out.columns == docs.columns


def test_repeated_rows_are_judged_alike(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, ["doc_id"]).where("doc_id = 2").select(F.round("score", 9).alias("s")).distinct()
    assert got.count() <= 2 and quality.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_large_group_of_near_copies_against_brute_force(spark):
    """Copies of one text that lie just under and just over the threshold, in several blocks of a hub."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > (0.02 if i % 2 else 0.035) else f"x{rng.integers(10**6)}" for w in base)) for i in range(260)]
    rows += [(1000 + i, words(rng, int(rng.integers(1, 30)))) for i in range(60)] + [(2000 + i, " ".join(base[i % 7 : 3 + i % 7])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = partenum.BLOCK_SETS
    partenum.BLOCK_SETS = 32
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(df).collect()}
    finally:
        partenum.BLOCK_SETS = before
    assert got == brute_components(rows)


def test_enumerated_subsets_lose_no_pair():
    """Sets at the threshold share a subset among the rarest that either posts, wherever the others rank."""
    rng = np.random.default_rng(12)
    for n in (1, 2, 4, 7, 9, 30, 100, 333):
        for extra in range(0, n // 3 + 1, max(1, n // 12)):
            x = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x, rng.integers(1, 2**63, extra, dtype=np.uint64)]))
            if 100 * len(x) < 75 * len(y):
                continue
            sizes = np.array([len(x), len(y)])
            who, step, sig, need = partenum.enumerated(np.repeat([0, 1], sizes), np.concatenate([x, y]), sizes)
            met = False
            for i, j in ((0, 0), (1, 0), (0, 1)):
                a, b = set(sig[(who == 0) & (step == i)].tolist()), set(sig[(who == 1) & (step == j)].tolist())
                if need[i, 0] and need[j, 1] and len(a & b) >= max(need[i, 0], need[j, 1], 1):
                    met = True
            assert met


def test_disclosure_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        mail = f"p{rng.integers(6)}@d{rng.integers(3)}.org"
        rows.append((i, f"{words(rng, 9)} {'zorb' if mail.startswith('p1@') else 'the'} write {mail} or call {'doma' if '@d2' in mail else 'the'} {words(rng, 9)}"))
    rows += [(200 + i, words(rng, 30) + " the") for i in range(200)] + [(500, rows[0][1]), (501, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spotted = df.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("spans", pii.base_spans(F.col("text")))
    got = {r["term"]: r["share"] for r in pii.disclosing(spotted).collect()}
    import math
    import re

    texts = [t or "" for _, t in rows]
    term = re.compile(r"[^\W\d_][\w'-]*")
    near, holds = {}, {}
    for i, t in enumerate(texts):
        for w in set(term.findall(t.lower())):
            holds.setdefault(w, set()).add(i)
        for m in re.finditer(r"[a-z0-9]+@([a-z0-9]+\.org)", t):
            around = set(term.findall(t[: m.start()].lower())[-6:]) | set(term.findall(t[m.end() :].lower())[:6])
            for e in (m.group(), m.group(1)):
                for w in around:
                    near.setdefault((e, w), set()).add(i)
                near.setdefault((e, None), set()).add(i)
    want = {}
    for (e, w), at in near.items():
        if w is None or len({texts[i] for i in at}) < pii.SUPPORT:
            continue
        ic = math.log2(len(texts) / len(near[e, None]))
        share = math.log2(len(texts) * len(at) / (len(near[e, None]) * max(len(holds[w]), len(at)))) / ic
        if share >= pii.ALPHA:
            want[w] = max(share, want.get(w, 0))
    assert got.keys() == want.keys() and want and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_sizes_beyond_the_samples(spark):
    """The share drawn of very many keys isn't rounded to nothing."""
    from quillon.llm.common import drawn

    keys = spark.range(1_000_000).withColumnRenamed("id", "k")
    assert keys.where(drawn("s", "k", 6_000, 1_000_000)).count() == pytest.approx(6_000, rel=0.1)
    # of 1e11 keys so few are drawn that a million hold none for certain, yet the threshold isn't zero
    plan = keys.where(drawn("s", "k", 6_000, 10**11))._jdf.queryExecution().analyzed().toString()
    assert "<= 553402322211" in plan.replace(",", "")
    assert keys.where(drawn("s", "k", 10, 5)).count() == 1_000_000


def test_url_walks_settle(spark):
    """A chain of hosts to a blocked one, longer than a few steps; and ranks as of the linear system."""
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(30)] + [("h30", "h3", 2), ("a", "h0", 1), ("h5", "a", 1)]
    seeds = [("h30", 0.0, 1.0), ("a", 1.0, 0.0), ("h7", 2.0, 0.5)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagated(spark.createDataFrame(edges, "src string, dst string, w long"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), settled=1e-6).collect()}
    names = sorted({x for e in edges for x in e[:2]})
    for k in (0, 1):
        m = np.zeros((len(names), len(names)))
        for s, t, w in edges:
            i, j = names.index(s), names.index(t)
            m[(i, j) if k == 0 else (j, i)] += w
        out = m.sum(1, keepdims=True)
        p = np.divide(m, out, where=out > 0, out=np.zeros_like(m))
        start = np.zeros(len(names))
        for h, *v in seeds:
            start[names.index(h)] = v[k]
        r = np.linalg.solve(np.eye(len(names)) - 0.85 * p.T, start)
        r /= r.sum()
        assert all(abs(got.get(h, (0, 0))[k] - r[i]) < 1e-6 for i, h in enumerate(names))


def test_queries_have_an_operator_each():
    assert set(COLUMNS) == set(registry.QUERIES) and ann and pii
