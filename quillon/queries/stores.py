"""Queries: sealed tables, caches, releases, manifests, journals, keyed tables, bundles - written to the shared folder and read again."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillon.operators import workflow
from quillon.queries.cases import table
from quillon.queries.registry import query
from quillon.sources import connectors, json_records, tables
from quillon.sources.shared import shared_folder


def _store(spark) -> tables.Store:
    return tables.Store(spark, shared_folder(spark))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, 'sealed is already' AS again FROM orders GROUP BY 1")
def sealed_tables(spark, sf_dir):
    store, orders = _store(spark), table(spark, sf_dir, "orders")
    tables.seal(store, "orders", orders)
    try:
        tables.seal(store, "orders", orders)
        again = "was sealed twice"
    except tables.SealError:
        again = "sealed is already"
    o = tables.unseal(store, tables.newest(store))
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("again", F.lit(again))


@query("SELECT c_nationkey AS nation, count(*) AS n, 1 AS made FROM customer GROUP BY 1")
def read_through_cache(spark, sf_dir):
    store, made = _store(spark), []

    def make():
        made.append(1)
        return table(spark, sf_dir, "customer")

    for _ in range(2):
        c = tables.cached(store, {"table": "customer", "version": 1}, make)
    return c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("made", F.lit(len(made)))


@query("SELECT * FROM (VALUES (1, 'after three releases', 3, 25), (2, 'rolled back once', 3, 5), (3, 'rolled back twice', 3, 2)) AS t(step, what, valid, rows)")
def release_history(spark, sf_dir):
    store, out = _store(spark), []
    n = table(spark, sf_dir, "nation")
    parts = [n.where("n_nationkey < 2"), n.where("n_nationkey < 5"), n]
    for i, part in enumerate(parts):
        tables.release(store, part, f"2026-01-0{i + 1}")
    for step, what in enumerate(("after three releases", "rolled back once", "rolled back twice"), 1):
        if step > 1:
            tables.rollback(store)
        digest = store.get("current.json")["digest"]
        name = tables.resolve([x for x in store.names() if not x.endswith(".json")], f"release={digest[:20]}")
        out.append((step, what, tables.releases(store).where("error is null").count(), tables.unseal(store, name).count()))
    return spark.createDataFrame(out, "step int, what string, valid int, rows int")


@query("SELECT * FROM (VALUES ('gone.txt', 'missing'), ('wrong.txt', 'differs')) AS t(path, fault)")
def manifest_check(spark, sf_dir):
    import hashlib

    store, rows = _store(spark), []
    for name, text in (("right.txt", "a"), ("wrong.txt", "b")):
        store.put(name, text)
        body = json.dumps("a" if name == "wrong.txt" else text).encode()
        rows.append((name, len(body), hashlib.sha256(body).hexdigest()))
    rows.append(("gone.txt", 1, "00"))
    return tables.verify_manifest(spark, store.root, spark.createDataFrame(rows, "path string, length long, sha256 string"))


@query("SELECT o_orderkey AS request, CAST(o_orderkey % 2 AS INTEGER) AS ordinal, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS label, o_orderkey % 3 = 0 AS paid FROM orders")
def response_journal(spark, sf_dir):
    """Requests answered before are replayed; the rest go to a labeller in batches, and all results must be there."""

    def make():
        return lambda batch: ["large" if x > 100000 else "small" for x in batch["price"]]

    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_orderkey") % 2).cast("int").alias("ordinal"), F.col("o_totalprice").alias("price"))
    journal = asked.where("request % 3 = 0").withColumn("label", F.when(F.col("price") > 100000, "large").otherwise("small")).withColumn("paid", F.lit(True))
    new = workflow.BatchLabeller(make).label(tables.unanswered(asked, journal)).withColumn("paid", F.lit(False))
    return tables.collect_batch(asked, journal.unionByName(new)).select("request", "ordinal", "label", "paid")


@query("SELECT c_nationkey AS nation, count(*) AS n, CASE WHEN c_nationkey < 5 THEN 'second' ELSE 'first' END AS written FROM customer GROUP BY 1")
def keyed_partitions(spark, sf_dir):
    store, c = _store(spark), table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation")
    connectors.put_keyed(store, "customers", "nation", c.withColumn("written", F.lit("first")))
    connectors.put_keyed(store, "customers", "nation", c.where("nation < 5").withColumn("written", F.lit("second")))
    return connectors.keyed(store, "customers").groupBy(F.col("nation").cast(c.schema["nation"].dataType).alias("nation"), "written").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def bundle_functions(spark, sf_dir):
    store = _store(spark)
    functions = [{"id": str(r["n_nationkey"]), "name": r["n_name"]} for r in table(spark, sf_dir, "nation").collect()]  # a bundle: a small file
    store.put("bundle.json", json_records.strict_loads(connectors.bundle_text(functions)))
    return json_records.functions_of(spark, f"{store.root}/bundle.json").select("id", F.get_json_object("record", "$.name").alias("name"))


@query("SELECT o_orderkey AS id, o_orderstatus AS label FROM orders WHERE o_orderkey % 5 = 0")
def split_scan(spark, sf_dir):
    store = _store(spark)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    for name, rows in (("train", o.where("id % 5 <> 0")), ("test", o.where("id % 5 = 0"))):
        rows.write.parquet(f"{store.root}/orders/{name}.parquet")
    return connectors.split(spark, store.root, "orders", "test")


@query("SELECT DISTINCT CAST(p_size AS VARCHAR) AS text FROM part")
def seen_inputs(spark, sf_dir):
    store = _store(spark)
    sizes = [r[0] for r in table(spark, sf_dir, "part").select("p_size").distinct().orderBy("p_size").collect()]  # fifty
    for i in range(0, len(sizes), 20):
        store.put(f"cases-{i}.json", {"function_id": "f", "cases": [{"inputs": {"text": str(s)}} for s in sizes[i : i + 25]]})
    store.put("other.json", {"function_id": "g", "cases": [{"inputs": {"text": "other"}}]})
    return connectors.seen_inputs(spark, store.root, "f").select("inputs.text")


@query("SELECT model, CAST(input AS DOUBLE) AS input, CAST(output AS DOUBLE) AS output, fetched FROM (VALUES ('a', 1.0, 2.0, 1), ('b', 3.0, 4.5, 1)) AS t(model, input, output, fetched)")
def price_list(spark, sf_dir):
    store, fetched = _store(spark), []

    def fetch():
        fetched.append(1)
        return [{"model": "a", "input": 1, "output": 2}, {"model": "b", "input": "3", "output": 4.5}, {"model": "c", "input": -1, "output": 1}, {"model": "d"}]

    for _ in range(2):
        got = connectors.prices(store, "prices", fetch)
    return got.withColumn("fetched", F.lit(len(fetched)))


@query("SELECT 'r_regionkey  r_name' AS line, 1 AS place UNION ALL SELECT '-----------  -----------', 2 UNION ALL SELECT rpad(CAST(r_regionkey AS VARCHAR), 13, ' ') || r_name, CAST(r_regionkey + 3 AS INTEGER) FROM region")
def report_text(spark, sf_dir):
    text = workflow.table_text(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame([(line, i) for i, line in enumerate(text.split("\n"), 1)], "line string, place int")
