"""Queries: joins, sets, windows, ranking, groups, plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.operators import datasets, explain, features
from quillon.plans import stages
from quillon.queries.cases import CASES, SCORED, ruled, scored, table
from quillon.queries.registry import query


@query("WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0), j AS (SELECT a.k AS ka, b.k AS kb FROM a FULL JOIN b ON a.k = b.k) SELECT CASE WHEN kb IS NULL THEN 'missing' WHEN ka IS NULL THEN 'unknown' ELSE 'matched' END AS kind, count(*) AS n FROM j GROUP BY 1")
def coverage_check(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return datasets.coverage(k.where("k % 3 <> 0"), k.where("k % 5 <> 0"), "k")


@query("SELECT count(*) AS leaked FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM benchmark)")
def leakage_audit(spark, sf_dir):
    train = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("digest"))
    held = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"))
    return held.join(train, "digest", "left_semi").agg(F.count("*").alias("leaked"))


@query("WITH f AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY text) SELECT doc_id, sha256(text) AS digest FROM f")
def exclude_and_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    known = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("digest"))
    return datasets.first_of_each(datasets.exclude(docs, known, "digest"), ["digest"], [F.col("doc_id")])


@query("WITH l AS (SELECT sha256(text) AS digest, quality FROM documents JOIN labels USING (doc_id)) SELECT digest, count(DISTINCT quality) AS labels, count(*) AS rows FROM l GROUP BY digest HAVING count(DISTINCT quality) > 1")
def label_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest")).join(table(spark, sf_dir, "labels"), "doc_id")
    return datasets.conflicts(d, "digest", "quality")


@query("SELECT origin, count(*) AS n FROM (SELECT 'gold' AS origin FROM labels WHERE quality = 1 UNION ALL SELECT 'synthetic' FROM documents UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY 1")
def corpus_union(spark, sf_dir):
    ids = lambda df, c: df.select(F.col(c).alias("row_id"))
    gold = ids(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    out = datasets.union_all(("gold", gold), ("synthetic", ids(table(spark, sf_dir, "documents"), "doc_id")), ("benchmark", ids(table(spark, sf_dir, "benchmark"), "item_id")))
    return out.groupBy("origin").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT p_partkey AS f FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 11 = 0), c AS (SELECT f, count(*) AS n FROM s GROUP BY f) SELECT p_partkey AS function, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS fault FROM part LEFT JOIN c ON f = p_partkey WHERE n IS NULL OR n > 1")
def exact_cover(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("function"))
    staged = f.where("function % 7 <> 0").unionAll(f.where("function % 11 = 0"))
    return stages.cover_faults(f, staged)


@query("SELECT c_nationkey AS nation, n_name AS name, count(*) AS n, CAST(count(o_orderkey) AS BIGINT) AS orders FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def star_join(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(per, "c_custkey", "left")
    return j.groupBy(F.col("c_nationkey").alias("nation"), F.col("n_name").alias("name")).agg(F.sum(F.greatest(F.coalesce("k", F.lit(0)), F.lit(1))).alias("n"), F.sum(F.coalesce("k", F.lit(0))).alias("orders"))


@query("SELECT o_orderkey AS order_id, o_custkey AS customer, CASE WHEN c_acctbal > 5000 THEN 'enterprise' ELSE 'standard' END AS tier FROM orders JOIN customer ON c_custkey = o_custkey")
def keyed_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), F.when(F.col("c_acctbal") > 5000, "enterprise").otherwise("standard").alias("tier"))


@query("WITH u AS (SELECT c_custkey AS id, c_acctbal AS balance, 0 AS v FROM customer UNION ALL SELECT o_custkey, max(o_totalprice), 1 FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS rn FROM u) SELECT id, balance FROM r WHERE rn = 1")
def upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(0).alias("v"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("balance")).withColumn("v", F.lit(1))
    return datasets.upserted(base, new, ["id"], "v").select("id", "balance")


@query(f"WITH {SCORED}, a AS (SELECT tier, avg(CAST(value = expected AS DOUBLE)) AS acc FROM scored WHERE case_id % 2 = 0 GROUP BY tier), b AS (SELECT tier, avg(CAST(value = expected AS DOUBLE)) AS acc FROM scored WHERE case_id % 2 = 1 GROUP BY tier) SELECT tier, round(b.acc - a.acc, 6) AS delta, round(max(abs(b.acc - a.acc)) OVER (), 6) AS most FROM a JOIN b USING (tier)")
def interference(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("ok", (F.col("diagnostic.value") == F.col("expected")).cast("double"))
    a, b = (s.where(f"case_id % 2 = {i}").groupBy("tier").agg(F.avg("ok").alias(f"acc{i}")) for i in (0, 1))
    gap = F.col("acc1") - F.col("acc0")
    return a.join(b, "tier").select("tier", F.round(gap, 6).alias("delta"), F.round(F.max(F.abs(gap)).over(Window.partitionBy()), 6).alias("most"))


@query("SELECT DISTINCT l_suppkey AS producer, l_partkey AS consumer, l_returnflag AS consumer_input FROM lineitem")
def plan_edges(spark, sf_dir):
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("producer"), F.col("l_partkey").alias("consumer"), F.col("l_returnflag").alias("consumer_input"))
    return stages.edges_of(reads)


@query("SELECT n_nationkey AS id FROM nation WHERE (n_nationkey, n_name) NOT IN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2)")
def incremental_rebuild(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return stages.rebuild(n, n.where("n_regionkey < 2"), ["n_nationkey", "n_name"]).select(F.col("n_nationkey").alias("id"))


@query("SELECT n_regionkey AS domain, min(n_nationkey % 2) AS route, min(n_nationkey) AS first_seen, count(*) AS functions, count(DISTINCT n_nationkey % 2) = 1 AS consistent FROM nation GROUP BY 1")
def domain_routes(spark, sf_dir):
    f = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("domain"), (F.col("n_nationkey") % 2).alias("route"), F.col("n_nationkey").alias("seen"))
    return stages.routes(f)


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS consumer, n_nationkey // 2 AS producer FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey, n_nationkey - 3 FROM nation WHERE n_nationkey >= 20), p AS (SELECT n_nationkey AS node, 0 AS level FROM nation UNION SELECT consumer, level + 1 FROM p JOIN e ON producer = node) SELECT CAST(node AS BIGINT) AS node, CAST(max(level) AS INTEGER) AS level FROM p GROUP BY node")
def plan_stages(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    e = n.where("n_nationkey > 0").select(F.col("n_nationkey").alias("consumer"), F.expr("n_nationkey div 2").alias("producer"))
    e = e.unionByName(n.where("n_nationkey >= 20").select(F.col("n_nationkey").alias("consumer"), (F.col("n_nationkey") - 3).alias("producer"))).distinct()
    nodes = [r[0] for r in n.select("n_nationkey").collect()]
    got = stages.levels(nodes, [(r["producer"], r["consumer"]) for r in e.collect()])  # a plan: a graph of a stated, small size
    return spark.createDataFrame(list(got.items()), "node long, level int")


@query("SELECT o_orderkey AS case_id, last_value(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END IGNORE NULLS) OVER w AS previous, count(*) FILTER (WHERE o_orderstatus = 'F') OVER w AS flagged FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def asof_prior_order(spark, sf_dir):
    w = features.before("o_custkey", "o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), features.as_of(F.col("o_orderkey"), F.col("o_orderstatus") != "F", w).alias("previous"), features.running_count(F.col("o_orderstatus") == "F", w).alias("flagged"))


@query("WITH i AS (SELECT l_orderkey AS invoice, CASE WHEN bool_or(l_returnflag = 'R') THEN 1 ELSE 0 END AS cancel, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1), j AS (SELECT invoice, o_custkey AS customer, o_orderdate AS date, cancel, amount FROM i JOIN orders ON o_orderkey = invoice), s AS (SELECT customer, round(sum(amount), 2) AS spend FROM j WHERE cancel = 0 GROUP BY 1), q AS (SELECT quantile_cont(spend, 0.8) AS q FROM s), w AS (SELECT *, count(*) FILTER (WHERE cancel = 1) OVER v AS prior_refunds, last_value(CASE WHEN cancel = 0 AND amount > 0 THEN date END IGNORE NULLS) OVER v AS order_date, last_value(CASE WHEN cancel = 0 AND amount > 0 THEN amount END IGNORE NULLS) OVER v AS order_total FROM j WINDOW v AS (PARTITION BY customer ORDER BY date, invoice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT substr(sha256('decision:' || invoice), 1, 24) AS key, w.customer, prior_refunds, CASE WHEN spend >= q THEN 'enterprise' ELSE 'standard' END AS tier, greatest(CAST(floor((epoch(date) - epoch(order_date)) / 86400) AS BIGINT), 0) AS age_days, round(order_total, 2) AS total, round(abs(amount), 2) AS refunded FROM w LEFT JOIN s ON s.customer = w.customer CROSS JOIN q WHERE cancel = 1 AND order_date IS NOT NULL")
def refund_features(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("cancel"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    j = per.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("invoice"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("date"), "cancel", "amount")
    spend = j.where(~F.col("cancel")).groupBy("customer").agg(F.round(F.sum("amount"), 2).alias("spend"))
    tiers = features.tier_by_quantile(spend, 0.8, "enterprise", "standard").select("customer", "tier")
    w = features.before("customer", "date", "invoice")
    paid = ~F.col("cancel") & (F.col("amount") > 0)
    seen = j.withColumns({"prior_refunds": features.running_count(F.col("cancel"), w), "order_date": features.as_of(F.col("date"), paid, w), "order_total": features.as_of(F.col("amount"), paid, w)})
    out = seen.where(F.col("cancel") & F.col("order_date").isNotNull()).join(tiers, "customer", "left")
    return out.select(
        N.pseudonym("decision", F.col("invoice")).alias("key"), "customer", "prior_refunds", F.coalesce("tier", F.lit("standard")).alias("tier"),
        F.greatest(N.whole_days(F.col("date"), F.col("order_date")), F.lit(0)).alias("age_days"), F.round("order_total", 2).alias("total"), F.round(F.abs("amount"), 2).alias("refunded"),
    )


@query("WITH s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1), q AS (SELECT quantile_cont(spend, 0.8) AS q FROM s) SELECT o_custkey AS customer, spend, CASE WHEN spend >= q THEN 'enterprise' ELSE 'standard' END AS tier FROM s CROSS JOIN q")
def spend_tier(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return features.tier_by_quantile(s, 0.8, "enterprise", "standard")


@query("WITH g AS (SELECT source || '/' || lang AS \"group\", count(*) AS n, bool_or(lang = 'de') AS gold FROM documents GROUP BY 1), t AS (SELECT greatest(1, least(sum(n) - 1, floor(sum(n) * 0.2 + 0.5))) AS target, bool_or(gold) AS any_gold FROM g), r AS (SELECT *, sha256(unhex('0000000000000007' || '00') || encode(\"group\")) AS h FROM g WHERE NOT gold), k AS (SELECT *, row_number() OVER (ORDER BY h, \"group\") AS rk, sum(n) OVER (ORDER BY h, \"group\" ROWS UNBOUNDED PRECEDING) AS upto, count(*) OVER () AS free FROM r), b AS (SELECT rk AS chosen FROM k CROSS JOIN t WHERE rk <= CASE WHEN any_gold THEN free ELSE free - 1 END ORDER BY abs(upto - target), rk LIMIT 1) SELECT g.\"group\", coalesce(rk <= chosen, false) AS evaluation FROM g LEFT JOIN k ON k.\"group\" = g.\"group\" CROSS JOIN b")
def hash_rank_split(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("group")).agg(F.count("*").alias("n"), F.bool_or(F.col("lang") == "de").alias("gold"))
    return datasets.held_out_groups(g, 0.2, seed=7)


@query("WITH r AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS digest FROM orders), k AS (SELECT *, row_number() OVER (ORDER BY digest) AS rank FROM r) SELECT o_orderkey, digest, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= (SELECT floor(count(*) * 0.01 + 0.5) FROM orders)")
def digest_ranked_keep(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"))
    return datasets.top_by_digest(r, "digest", 0.01)


@query(f"WITH {CASES}, r AS (SELECT case_id, status, tier, CAST(row_number() OVER (PARTITION BY status, tier, expected ORDER BY sha256(CAST(case_id AS VARCHAR)), case_id) AS INTEGER) AS rn, expected FROM labelled) SELECT case_id, status, tier, expected, rn FROM r WHERE rn <= 5")
def stratified_pick(spark, sf_dir):
    df = ruled(spark, sf_dir).select("case_id", "status", "tier", "expected", F.sha2(F.col("case_id").cast("string"), 256).alias("k"))
    return datasets.stratified(df, ["status", "tier", "expected"], ["k", "case_id"], 5).drop("k")


@query(f"WITH {SCORED}, r AS (SELECT o_orderpriority, case_id, round(confidence, 9) AS c, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(confidence, 9) DESC, case_id) AS rn FROM scored) SELECT o_orderpriority, case_id, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 10")
def topk_attested(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc(F.round("diagnostic.confidence", 9)), "case_id")
    return scored(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("o_orderpriority", "case_id", "rank")


@query("WITH t AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) AS l_linenumber FROM lineitem)) SELECT l_returnflag AS queue, turn, l_orderkey FROM t")
def round_robin(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    l = l.withColumn("line", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice")))
    return datasets.interleaved(l, "l_returnflag", ["l_orderkey", "line"]).select(F.col("l_returnflag").alias("queue"), "turn", "l_orderkey")


@query("WITH v AS (SELECT o_orderkey AS digest, o_custkey, o_orderdate AS created FROM orders WHERE o_orderstatus <> 'P') SELECT digest, lead(digest) OVER (PARTITION BY o_custkey ORDER BY created DESC, digest DESC) AS previous FROM v")
def previous_release(spark, sf_dir):
    v = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return v.select(F.col("o_orderkey").alias("digest"), F.lead("o_orderkey").over(w).alias("previous"))


@query("SELECT doc_id, sha256(text) AS digest, CAST(row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) - 1 AS INTEGER) AS ordinal FROM documents")
def duplicate_ordinal(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.withColumn("ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")) - 1)


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, o_orderdate FROM orders) SELECT o_custkey, count(*) FILTER (WHERE rn <= 3) AS kept, count(*) FILTER (WHERE rn > 3) AS dropped, max(o_orderkey) FILTER (WHERE rn = 1) AS newest FROM r GROUP BY 1")
def newest_first_keep(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    r = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w))
    return r.groupBy("o_custkey").agg(F.count_if(F.col("rn") <= 3).alias("kept"), F.count_if(F.col("rn") > 3).alias("dropped"), F.max(F.when(F.col("rn") == 1, F.col("o_orderkey"))).alias("newest"))


@query("WITH k AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256('3:' || p_partkey), p_partkey) AS position FROM part) SELECT p_partkey, CAST(position AS INTEGER) AS position, CAST(floor((position - 1) / 32) AS BIGINT) AS batch FROM k")
def shuffled_batches(spark, sf_dir):
    return datasets.shuffled_batches(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 3, 32)


@query(None)
def connected_groups(spark, sf_dir):
    """No SQL: all customers are connected, and a recursive join makes every pair of them; tested against brute force."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("g")).unionByName(c.select((1000 + F.expr("c_custkey div 500")).alias("k"), F.col("c_custkey").alias("g")))
    from quillon.sources.shared import checkpointed

    return datasets.merged_groups(rows, "k", "g", checkpointed)


@query("WITH s AS (SELECT max(p_size) - min(p_size) AS d_size, max(p_retailprice) - min(p_retailprice) AS d_price FROM part), j AS (SELECT a.p_partkey AS query, b.p_partkey AS neighbour, round((least(abs(a.p_size - b.p_size) / d_size, 1.0) + least(abs(a.p_retailprice - b.p_retailprice) / d_price, 1.0) + CASE WHEN a.p_brand = b.p_brand THEN 0.0 ELSE 1.0 END) / 3, 9) AS distance FROM part a CROSS JOIN part b CROSS JOIN s WHERE a.p_partkey % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM j) SELECT query, neighbour, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def nearest_examples(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return explain.nearest(p.where("p_partkey % 20 = 0"), p, ["p_size", "p_retailprice"], [], ["p_brand"], 5, "p_partkey")


@query("SELECT round(max(p_size) - min(p_size), 6) AS p_size, round(max(p_retailprice) - min(p_retailprice), 6) AS p_retailprice FROM part")
def numeric_spreads(spark, sf_dir):
    s = explain.spreads(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return s.select(F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query(f"WITH {CASES}, m AS (SELECT count(*) AS total FROM labelled WHERE rule_2), h AS (SELECT 'status' AS path, status AS value, count(*) AS misses FROM labelled WHERE rule_2 GROUP BY status UNION ALL SELECT 'tier', tier, count(*) FROM labelled WHERE rule_2 GROUP BY tier), s AS (SELECT 'status' AS path, status AS value, count(*) FILTER (WHERE expected = 'review') AS support, count(*) FILTER (WHERE expected <> 'review') AS against FROM labelled WHERE NOT rule_1 GROUP BY status UNION ALL SELECT 'tier', tier, count(*) FILTER (WHERE expected = 'review'), count(*) FILTER (WHERE expected <> 'review') FROM labelled WHERE NOT rule_1 GROUP BY tier) SELECT path, value, misses, coalesce(support, 0) AS support FROM h JOIN m ON misses = total LEFT JOIN s USING (path, value) WHERE coalesce(against, 0) = 0")
def shared_rule(spark, sf_dir):
    df = ruled(spark, sf_dir).select("status", "tier", "expected", "rule_1", "rule_2")
    return explain.shared_rules(df.where("rule_2"), df.where("not rule_1"), ["status", "tier"], "expected", "review")
