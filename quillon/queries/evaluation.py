"""Queries: system metrics, agreement, percentiles, funnels, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import datasets, evaluate, features
from quillon.queries.cases import CASES, SCORED, ruled, scored, table
from quillon.queries.registry import query


@query("WITH s AS (SELECT event_type AS role, value, user_id % 7 = 0 AS ok FROM events) SELECT role, count(*) AS cases, count(*) FILTER (WHERE ok) AS correct, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(count(*) * 1000 / sum(value), 4) AS per_second, max(value) AS peak FROM s GROUP BY role")
def system_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("user_id") % 7 == 0)
    return e.groupBy(F.col("event_type").alias("role")).agg(
        F.count("*").alias("cases"), F.count_if("ok").alias("correct"), evaluate.nearest_rank("value", 0.5).alias("p50"), evaluate.nearest_rank("value", 0.95).alias("p95"),
        F.round(F.count("*") * 1000 / F.sum("value"), 4).alias("per_second"), F.max("value").alias("peak"),
    )


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(evaluate.nearest_rank("value", 0.5).alias("p50"), evaluate.nearest_rank("value", 0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("WITH r AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) AS rn, count(*) OVER () AS n FROM customer) SELECT min(c_acctbal) AS c_acctbal FROM r WHERE rn = CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1")
def truncated_percentile(spark, sf_dir):
    return evaluate.truncated_rank(table(spark, sf_dir, "customer"), "c_acctbal", 0.9)


_DOCS = "d AS (SELECT doc_id, lang, quality, toxic, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS guess FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.withColumn("guess", F.when(F.col("n_chars") >= 400, 1).otherwise(0))


@query(f"WITH {_DOCS} SELECT lang, count(*) AS cases, count(*) FILTER (WHERE guess = quality) AS agreements, round(count(*) FILTER (WHERE guess = quality) / count(*), 4) AS rate FROM d GROUP BY ROLLUP (lang)")
def agreement_by_step(spark, sf_dir):
    return evaluate.agreement(_labelled(spark, sf_dir), "lang", "guess", "quality")


@query(f"WITH {_DOCS} SELECT quality, CAST(guess AS INTEGER) AS guess, count(*) AS n FROM d GROUP BY ALL")
def confusion_counts(spark, sf_dir):
    return evaluate.confusion(_labelled(spark, sf_dir), "quality", "guess")


@query(f"WITH {_DOCS} SELECT lang, string_agg(k || ':' || n, ',' ORDER BY k) AS confusion FROM (SELECT lang, quality || '/' || guess AS k, count(*) AS n FROM d GROUP BY ALL) GROUP BY lang")
def confusion_map(spark, sf_dir):
    per = _labelled(spark, sf_dir).groupBy("lang", F.concat_ws("/", "quality", "guess").alias("k")).agg(F.count("*").alias("n"))
    return per.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "k", "n"))), ",").alias("confusion"))


@query(f"WITH {_DOCS} SELECT round(avg(CAST(guess = quality AS DOUBLE)), 4) AS a_rules, round(avg(CAST(toxic = 0 AS DOUBLE)), 4) AS clean, round(avg(CAST(guess = quality AND toxic = 0 AS DOUBLE)), 4) AS all_three, count(*) AS n FROM d")
def three_way_agreement(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    a, c = F.col("guess") == F.col("quality"), F.col("toxic") == 0
    return d.agg(rate(a).alias("a_rules"), rate(c).alias("clean"), rate(a & c).alias("all_three"), F.count("*").alias("n"))


@query("WITH p AS (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS gold, CAST(o_orderkey % 5 + 1 AS INTEGER) AS guess FROM orders) SELECT round(avg(abs(gold - guess)), 6) AS mae, round(avg(CAST(abs(gold - guess) <= 1 AS DOUBLE)), 6) AS within_one, round(avg(CAST(gold = guess AS DOUBLE)), 6) AS exact FROM p")
def score_mae_within_one(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("gold"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("guess"))
    gap = F.abs(F.col("gold") - F.col("guess"))
    return p.agg(F.round(F.avg(gap), 6).alias("mae"), F.round(F.avg((gap <= 1).cast("double")), 6).alias("within_one"), F.round(F.avg((gap == 0).cast("double")), 6).alias("exact"))


@query(f"WITH {SCORED}, r AS (SELECT case_id, value = expected AS ok FROM scored), p AS (SELECT case_id AS anchor, case_id + 1 AS twin FROM scored WHERE case_id % 2 = 0) SELECT count(*) AS pairs, coalesce(avg(CAST(a.ok AND t.ok AS DOUBLE)), 1.0) AS consistency FROM p JOIN r a ON a.case_id = anchor JOIN r t ON t.case_id = twin")
def pair_consistency(spark, sf_dir):
    right = scored(spark, sf_dir).select(F.col("case_id").alias("row_id"), (F.col("diagnostic.value") == F.col("expected")).alias("ok"))
    pairs = right.where("row_id % 2 = 0").select(F.col("row_id").alias("anchor"), (F.col("row_id") + 1).alias("twin"))
    return evaluate.pair_consistency(pairs, right)


@query(f"WITH {SCORED} SELECT o_orderpriority AS role, round(avg(CAST(value = expected AS DOUBLE)), 6) AS accuracy, count(*) FILTER (WHERE value <> expected) AS misses, min(case_id) FILTER (WHERE value <> expected) AS first_miss FROM scored GROUP BY 1")
def misses_by_group(spark, sf_dir):
    miss = F.col("diagnostic.value") != F.col("expected")
    return scored(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("role")).agg(F.round(F.avg((~miss).cast("double")), 6).alias("accuracy"), F.count_if(miss).alias("misses"), F.min(F.when(miss, F.col("case_id"))).alias("first_miss"))


@query(f"WITH {SCORED}, m AS (SELECT o_orderpriority AS role, avg(CAST(value = expected AS DOUBLE)) AS accuracy, quantile_disc(1 - confidence, 0.5) * 20 AS p50 FROM scored GROUP BY 1), a AS (SELECT max(p50) FILTER (WHERE role = '1-URGENT') AS p50_candidate, max(accuracy) FILTER (WHERE role = '1-URGENT') AS accuracy_candidate, max(accuracy) FILTER (WHERE role = '5-LOW') AS accuracy_comparator FROM m) SELECT CASE WHEN p50_candidate < 10 AND accuracy_candidate >= accuracy_comparator THEN 'go' ELSE 'no-go' END AS status, p50_candidate < 10 AS latency_passed, accuracy_candidate >= accuracy_comparator AS accuracy_passed, 0 AS missing FROM a")
def go_no_go(spark, sf_dir):
    m = scored(spark, sf_dir).withColumn("ms", 1 - F.col("diagnostic.confidence")).groupBy(F.col("o_orderpriority").alias("role"))
    m = m.agg(F.avg((F.col("diagnostic.value") == F.col("expected")).cast("double")).alias("accuracy"), (evaluate.nearest_rank("ms", 0.5) * 20).alias("p50"))
    out = evaluate.go_no_go(m, "1-URGENT", "5-LOW", ["1-URGENT", "5-LOW"])
    return out.select("status", "latency_passed", "accuracy_passed", F.size("missing").alias("missing"))


@query(f"WITH {SCORED}, f AS (SELECT o_orderpriority AS f, avg(CAST(value = expected AS DOUBLE)) AS accuracy FROM scored GROUP BY 1) SELECT count(*) FILTER (WHERE accuracy < 0.79) AS failing, bool_and(accuracy >= 0.79 OR accuracy >= 0.77) AS all_narrow, count(*) FILTER (WHERE accuracy < 0.79) > 0 AND bool_and(accuracy >= 0.79 OR accuracy >= 0.77) AS retry FROM f")
def retry_decision(spark, sf_dir):
    per = scored(spark, sf_dir).groupBy("o_orderpriority").agg(F.avg((F.col("diagnostic.value") == F.col("expected")).cast("double")).alias("accuracy"))
    return evaluate.retry_decision(per, 0.79, 0.02)


@query(f"WITH {CASES} SELECT expected AS label, count(*) AS n FROM labelled GROUP BY 1")
def label_histogram(spark, sf_dir):
    return ruled(spark, sf_dir).groupBy(F.col("expected").alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {CASES} SELECT status, count(*) FILTER (WHERE age_days <= 30) AS d30, count(*) FILTER (WHERE age_days > 30 AND age_days <= 60) AS d60, count(*) FILTER (WHERE age_days > 60 AND age_days <= 90) AS d90, count(*) FILTER (WHERE age_days > 90) AS older FROM labelled GROUP BY status")
def age_buckets(spark, sf_dir):
    b = features.bucket(F.col("age_days"), [(30, "d30"), (60, "d60"), (90, "d90")], "older")
    return ruled(spark, sf_dir).withColumn("bucket", b).groupBy("status").agg(*[F.count_if(F.col("bucket") == k).alias(k) for k in ("d30", "d60", "d90", "older")])


@query("SELECT l_returnflag AS category, l_linestatus AS file, CAST(count(*) AS BIGINT) AS lines, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, sf_dir):
    from pyspark.sql import Window

    per = table(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("file")).agg(F.count("*").alias("lines"))
    return per.withColumn("share", F.round(F.col("lines") / F.max("lines").over(Window.partitionBy()), 6))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def share_of_total(spark, sf_dir):
    from pyspark.sql import Window

    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


_REASON = "CASE WHEN b.text IS NOT NULL THEN 'excluded' WHEN rn > 1 THEN 'duplicate' WHEN n_chars < 100 THEN 'short' ELSE 'kept' END"


@query(f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents), x AS (SELECT DISTINCT text FROM benchmark) SELECT {_REASON} AS reason, count(*) AS n FROM d LEFT JOIN x b ON b.text = d.text GROUP BY 1")
def funnel(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    known = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("key"), F.lit(True).alias("held")).distinct()
    firsts = docs.groupBy("key").agg(F.min("doc_id").alias("first"))
    df = docs.join(firsts, "key").join(known, "key", "left")
    return datasets.funnel(df, [("excluded", F.coalesce("held", F.lit(False))), ("duplicate", F.col("doc_id") != F.col("first")), ("short", F.col("n_chars") < 100)])


@query("SELECT o_orderstatus AS origin, sha256(string_agg(o_orderkey || '|' || o_orderpriority, chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def ordered_digest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("line", F.concat_ws("|", "o_orderkey", "o_orderpriority"))
    return o.groupBy(F.col("o_orderstatus").alias("origin")).agg(evaluate.ordered_digest("o_orderkey", "line").alias("digest"))


@query("WITH o AS (SELECT o_orderstatus AS origin, o_orderkey || '|' || o_orderpriority AS line, o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 1000 AS block FROM orders), b AS (SELECT origin, block, sha256(string_agg(line, chr(10) ORDER BY o_orderkey)) AS d FROM o GROUP BY ALL) SELECT origin, sha256(string_agg(d, chr(10) ORDER BY block)) AS digest FROM b GROUP BY 1")
def block_digest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("line", F.concat_ws("|", "o_orderkey", "o_orderpriority")).withColumn("origin", F.col("o_orderstatus"))
    return evaluate.block_digest(o, "origin", "o_orderkey", "line", 1000)


@query("WITH r AS (SELECT user_id, ts, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events) SELECT user_id, count(*) FILTER (WHERE spent <= 500) AS allowed, count(*) FILTER (WHERE spent > 500) AS refused FROM r GROUP BY user_id")
def spend_cap(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, sf_dir, "events").withColumn("spent", F.sum("value").over(w))
    return r.groupBy("user_id").agg(F.count_if(F.col("spent") <= 500).alias("allowed"), F.count_if(F.col("spent") > 500).alias("refused"))


@query("SELECT count(*) AS rows, count(DISTINCT text) AS inputs, count(DISTINCT text) * 2 < count(*) AS warn FROM documents")
def distinct_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.count_distinct("text").alias("inputs"))
    return d.withColumn("warn", F.col("inputs") * 2 < F.col("rows"))


@query("SELECT user_id % 10 AS run, min(CASE WHEN value < 1 THEN ts END) AS reached, min(event_id) FILTER (WHERE value < 1) AS first_event FROM events GROUP BY 1")
def time_to_target(spark, sf_dir):
    hit = F.col("value") < 1
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("run")).agg(F.min(F.when(hit, F.col("ts"))).alias("reached"), F.min(F.when(hit, F.col("event_id"))).alias("first_event"))


@query("SELECT count(DISTINCT (l_suppkey, l_partkey)) AS encoder_passes, count(DISTINCT (l_returnflag, l_partkey)) AS adapter_passes, count(*) AS head_passes FROM lineitem")
def stage_passes(spark, sf_dir):
    from quillon.plans.stages import passes

    calls = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("encoder"), F.col("l_returnflag").alias("adapter"), F.col("l_partkey").alias("input"))
    return passes(calls)
