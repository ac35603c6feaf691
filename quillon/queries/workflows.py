"""Queries: workflows, estimates, releases, typed questions, more sets and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.functions import text as X
from quillon.operators import datasets, evaluate, generate, rules, workflow
from quillon.queries.cases import CASES, SCORED, SUPPORT, policy, ruled, scored, table
from quillon.queries.registry import query
from quillon.sources.shared import checkpointed

_LOSS = "(p_a * p_a + p_d * p_d + p_r * p_r - 2 * p_y + 1) / 2"


@query(f"WITH {SCORED}, b AS (SELECT least(14, CAST(floor(confidence * 15) AS INTEGER)) AS bin, count(*) AS n, sum(CAST(value = expected AS DOUBLE)) AS hit, sum(confidence) AS conf, sum({_LOSS}) AS loss FROM scored GROUP BY 1), m AS (SELECT CAST(sum(n) AS BIGINT) AS cases, round(sum(abs(hit - conf)) / sum(n), 6) AS ece, round(sum(loss) / sum(n), 6) AS brier, round(sum(hit) / sum(n), 6) AS accuracy FROM b) SELECT cases, ece, brier, accuracy, concat_ws(',', CASE WHEN accuracy >= 0.9 THEN NULL ELSE 'accuracy' END, CASE WHEN ece <= 0.05 THEN NULL ELSE 'ece' END, CASE WHEN brier <= 0.2 THEN NULL ELSE 'brier' END) AS failed FROM m")
def verification(spark, sf_dir):
    p = F.transform("diagnostic.distribution", lambda x: x["probability"])
    df = scored(spark, sf_dir).select(F.col("diagnostic.confidence").alias("c"), (F.col("diagnostic.value") == F.col("expected")).alias("ok"), N.brier(p, F.col("target")).alias("loss"))
    out = workflow.verify(df, [("c", "ok", "loss")], {"accuracy": 0.9, "ece": 0.05, "brier": 0.2})
    return out.withColumn("failed", F.array_join("failed", ","))


@query("WITH f AS (SELECT c_mktsegment AS function, count(*) AS cases, bool_or(c_mktsegment = 'BUILDING') AS cached, CAST(sum(len(c_name)) AS BIGINT) AS ci, CAST(max(len(c_name)) AS BIGINT) AS co FROM customer GROUP BY 1), p AS (SELECT function, CASE WHEN cached THEN 0 ELSE cases END AS requests, CAST(ceil(ci / 4.0) AS BIGINT) AS ti, CAST(ceil(co / 4.0) AS BIGINT) AS t_o FROM f) SELECT function, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(requests * ti) AS BIGINT) AS tokens_in, CAST(sum(requests * t_o) AS BIGINT) AS tokens_out, round((sum(requests * ti) * 3.0::DOUBLE + sum(requests * t_o) * 15.0::DOUBLE) / 1e6, 6) AS cost, round(sum(requests) * 1.5::DOUBLE / 3600, 6) AS hours FROM p GROUP BY ROLLUP (function)")
def cost_estimate(spark, sf_dir):
    f = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("function")).agg(
        F.count("*").alias("cases"), F.bool_or(F.col("c_mktsegment") == "BUILDING").alias("cached"), F.sum(F.length("c_name")).alias("characters_in"), F.max(F.length("c_name")).alias("characters_out")
    )
    return workflow.estimate(f, 3.0, 15.0, 1.5)


@query("WITH d AS (SELECT text, count(*) AS n FROM documents GROUP BY text), k AS (SELECT sha256(d.text) AS key, n, b.text IS NOT NULL AS known FROM d LEFT JOIN (SELECT DISTINCT text FROM benchmark) b ON b.text = d.text), r AS (SELECT key, row_number() OVER (ORDER BY sha256('5:' || key), key) AS rn FROM k WHERE NOT known) SELECT key, CASE WHEN rn <= 40 THEN 'evaluation' ELSE 'training' END AS slice FROM r WHERE rn <= 120")
def sampled_slices(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"))
    known = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("key"))
    return workflow.sampled_slices(c, known, "key", 40, 80, 5)[0]


@query("WITH d AS (SELECT text, count(*) AS n FROM documents GROUP BY text), k AS (SELECT n, b.text IS NOT NULL AS known FROM d LEFT JOIN (SELECT DISTINCT text FROM benchmark) b ON b.text = d.text) SELECT CAST(sum(n) AS BIGINT) AS candidates, CAST(coalesce(sum(n) FILTER (WHERE known), 0) AS BIGINT) AS excluded, CAST(coalesce(sum(n - 1) FILTER (WHERE NOT known), 0) AS BIGINT) AS duplicates FROM k")
def sample_funnel(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"))
    known = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("key"))
    return workflow.sampled_slices(c, known, "key", 40, 80, 5)[1]


@query(f"WITH {SCORED} SELECT tier AS question, count(*) AS cases, round(avg(CAST(value = expected AS DOUBLE)), 6) AS accuracy, round(avg((power(p_a - CASE expected WHEN 'approve' THEN 0.8 ELSE 0.1 END, 2) + power(p_d - CASE expected WHEN 'deny' THEN 0.8 ELSE 0.1 END, 2) + power(p_r - CASE expected WHEN 'review' THEN 0.8 ELSE 0.1 END, 2)) / 2), 6) AS brier FROM scored GROUP BY tier")
def question_scores(spark, sf_dir):
    p = F.transform("diagnostic.distribution", lambda x: x["probability"])
    gold = F.array(*[F.when(F.col("expected") == v, 0.8).otherwise(0.1) for v in SUPPORT])
    gap = N.total(F.zip_with(p, gold, lambda a, b: F.pow(a - b, 2))) / 2
    return scored(spark, sf_dir).groupBy(F.col("tier").alias("question")).agg(F.count("*").alias("cases"), F.round(F.avg((F.col("diagnostic.value") == F.col("expected")).cast("double")), 6).alias("accuracy"), F.round(F.avg(gap), 6).alias("brier"))


@query(f"WITH {SCORED}, q AS (SELECT status, tier, sum(CAST(value = expected AS BIGINT)) AS hit, count(*) AS n FROM scored GROUP BY ALL) SELECT status AS domain, round(sum(hit) / sum(n), 6) AS micro, round(avg(hit / n), 6) AS macro, count(*) FILTER (WHERE hit / n >= 0.8) AS passed FROM q GROUP BY status")
def domain_scores(spark, sf_dir):
    ok = (F.col("diagnostic.value") == F.col("expected")).cast("long")
    q = scored(spark, sf_dir).groupBy("status", "tier").agg(F.sum(ok).alias("hit"), F.count("*").alias("n"))
    return q.groupBy(F.col("status").alias("domain")).agg(F.round(F.sum("hit") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("macro"), F.count_if(F.col("hit") / F.col("n") >= 0.8).alias("passed"))


@query(f"WITH {SCORED} SELECT round(avg(CAST(value = expected AND (p_risk > 0.5) = (expected = 'review') AS DOUBLE)), 6) AS exact, round(avg(CAST(value = expected AS DOUBLE)), 6) AS decision, round(avg(CAST((p_risk > 0.5) = (expected = 'review') AS DOUBLE)), 6) AS risk FROM scored")
def head_accuracy(spark, sf_dir):
    a, b = F.col("diagnostic.value") == F.col("expected"), F.col("risk.value") == (F.col("expected") == "review")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return scored(spark, sf_dir).agg(rate(a & b).alias("exact"), rate(a).alias("decision"), rate(b).alias("risk"))


@query("SELECT CAST(count(*) FILTER (WHERE a > 0.1) AS BIGINT) AS passed, round(min(a), 6) AS least_accuracy, round(max(e), 6) AS most_error, CAST(sum(v) AS BIGINT) AS violations FROM (SELECT event_type, avg(CAST(value > 10 AS DOUBLE)) AS a, avg(CAST(value > 90 AS DOUBLE)) AS e, count(*) FILTER (WHERE value > 99) AS v FROM events GROUP BY 1)")
def release_totals(spark, sf_dir):
    f = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") > 10).cast("double")).alias("a"), F.avg((F.col("value") > 90).cast("double")).alias("e"), F.count_if(F.col("value") > 99).alias("v"))
    return f.agg(F.count_if(F.col("a") > 0.1).alias("passed"), F.round(F.min("a"), 6).alias("least_accuracy"), F.round(F.max("e"), 6).alias("most_error"), F.sum("v").alias("violations"))


@query("WITH e AS (SELECT user_id % 12 AS epoch, round(avg(value), 6) AS accuracy FROM events GROUP BY 1) SELECT epoch, accuracy FROM e ORDER BY accuracy DESC, epoch LIMIT 1")
def best_epoch(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("accuracy"))
    return e.orderBy(F.desc("accuracy"), "epoch").limit(1)


@query("SELECT source AS partition, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY ALL")
def digest_multiset(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("partition"), F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS name, count(*) AS n, count(*) = count(DISTINCT p_name) AS unique_names, coalesce(bool_and(step), true) AS ascending FROM (SELECT *, p_partkey > lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS step FROM part) GROUP BY 1")
def uniqueness(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    p = table(spark, sf_dir, "part").withColumn("step", F.col("p_partkey") > F.lag("p_partkey").over(w))
    return p.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct("p_name")).alias("unique_names"), F.coalesce(F.bool_and("step"), F.lit(True)).alias("ascending"))


@query("WITH t AS (SELECT unnest(['/brand', '/size', '/type']) AS path, unnest([min(p_brand) = max(p_brand), min(p_size) = max(p_size), min(p_type) = max(p_type)]) AS same FROM part WHERE p_partkey IN (1, 2, 3)) SELECT string_agg(path, ',' ORDER BY path) FILTER (WHERE NOT same) AS paths, count(*) FILTER (WHERE same) AS same FROM t")
def common_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey in (1, 2, 3)")
    flags = p.agg(*[(F.min(c) == F.max(c)).alias(c) for c in ("p_brand", "p_size", "p_type")])
    one = lambda c, n: F.struct(F.lit(n).alias("path"), F.col(c).alias("same"))
    all_ = F.array(one("p_brand", "/brand"), one("p_size", "/size"), one("p_type", "/type"))
    return flags.select(F.nullif(F.array_join(F.array_sort(F.transform(F.filter(all_, lambda x: ~x["same"]), lambda x: x["path"])), ","), F.lit("")).alias("paths"), F.size(F.filter(all_, lambda x: x["same"])).cast("long").alias("same"))


@query("WITH r AS (SELECT s_suppkey AS id, s_acctbal >= 0 AS valid, s_nationkey AS created, s_name AS name FROM supplier) SELECT id, CAST(row_number() OVER (ORDER BY valid DESC, CASE WHEN valid THEN -created END NULLS LAST, CASE WHEN valid THEN -id END NULLS LAST, name) AS INTEGER) AS place FROM r")
def newest_first_order(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").withColumn("valid", F.col("s_acctbal") >= 0)
    w = Window.orderBy(F.desc("valid"), F.asc_nulls_last(F.when(F.col("valid"), -F.col("s_nationkey"))), F.asc_nulls_last(F.when(F.col("valid"), -F.col("s_suppkey"))), "s_name")
    return r.select(F.col("s_suppkey").alias("id"), F.row_number().over(w).alias("place"))


@query("SELECT substr(d, 1, 2) AS prefix, count(*) AS n, CASE WHEN count(*) = 1 THEN min(d) END AS resolved FROM (SELECT sha256(CAST(s_suppkey AS VARCHAR)) AS d FROM supplier) GROUP BY 1")
def prefix_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.sha2(F.col("s_suppkey").cast("string"), 256).alias("d"))
    return d.groupBy(X.short_id(F.col("d"), 2).alias("prefix")).agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min("d")).alias("resolved"))


@query(f"WITH {CASES} SELECT tier, count(*) AS n, round(quantile_cont(age_days, 0.5), 6) AS median_age, min(total) AS least, max(total) AS most, CAST(sum(least(prior, 3)) AS BIGINT) AS capped FROM cases GROUP BY tier")
def case_summary(spark, sf_dir):
    c = ruled(spark, sf_dir)
    return c.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.percentile("age_days", 0.5), 6).alias("median_age"), F.min("total").alias("least"), F.max("total").alias("most"), F.sum(F.least("prior", F.lit(3))).alias("capped"))


@query("WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0), a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) SELECT (SELECT count(*) FROM s WHERE k IN (SELECT k FROM a)) AS kept, (SELECT count(*) FROM s WHERE k NOT IN (SELECT k FROM a)) AS unadjudicated, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM s)) AS unsampled")
def frozen_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    s, a = c.where("k % 3 = 0"), c.where("k % 2 = 0")
    n = lambda x, y, how, name: x.join(y, "k", how).agg(F.count("*").alias(name))
    return n(s, a, "left_semi", "kept").crossJoin(n(s, a, "left_anti", "unadjudicated")).crossJoin(n(a, s, "left_anti", "unsampled"))


@query("SELECT count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS unmatched, coalesce(sum(abs(coalesce(a, 0) - coalesce(b, 0))), 0)::BIGINT AS surplus FROM (SELECT l_partkey AS k, count(*) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) x FULL JOIN (SELECT l_partkey AS k, count(*) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) y ON x.k = y.k")
def multiset_equality(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    a, b = (l.where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.count("*").alias(n)) for f, n in (("R", "a"), ("A", "b")))
    j = a.join(b, "l_partkey", "full")
    return j.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"), F.coalesce(F.sum(F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))), F.lit(0)).alias("surplus"))


@query()
def decided_sample(spark, sf_dir):
    """500 distinct inputs that the policy decides, by the rule labeller (bounded by its feature)."""
    fields = [generate.Field("age_days", low=0, high=120, thresholds=(30, 60, 90)), generate.Field("prior", low=0, high=8, thresholds=(3, 5)), generate.Field("total", low=0, high=10000, thresholds=(1000, 2000, 5000)), generate.Field("status", choices=("fraudulent", "paid")), generate.Field("tier", choices=("enterprise", "standard"))]
    return workflow.decided(spark, 500, "decided", fields, workflow.RuleLabeller(policy(), SUPPORT))


@query()
def explained_calls(spark, sf_dir):
    calls = checkpointed(scored(spark, sf_dir).select("case_id", "age_days", "prior", "total", "status", "tier", F.col("diagnostic.value").alias("value")))
    out = workflow.explained(calls, calls, policy(), SUPPORT, "value", ["age_days", "prior", "total"], ["status", "tier"], 3, "case_id")
    return out.select("query", "value", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("active", "violated", "nearest")])


@query(f"WITH {SCORED} SELECT expected, round(quantile_disc(1 - confidence, 0.5), 9) AS p50, count(*) FILTER (WHERE value <> expected) AS misses FROM scored GROUP BY expected")
def function_report(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("ms", 1 - F.col("diagnostic.confidence"))
    return s.groupBy("expected").agg(F.round(evaluate.nearest_rank("ms", 0.5), 9).alias("p50"), F.count_if(F.col("diagnostic.value") != F.col("expected")).alias("misses"))


@query("SELECT conv_id, count(*) AS turns, min(CASE WHEN role = 'user' THEN turn END) AS first_user, max(turn) - min(turn) + 1 = count(*) AS complete FROM conversations GROUP BY conv_id")
def conversation_scopes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"), (F.max("turn") - F.min("turn") + 1 == F.count("*")).alias("complete"))


@query(f"WITH {CASES}, e AS (SELECT case_id, expected, CASE WHEN rule_0 AND expected = 'approve' THEN 1 ELSE 0 END AS broken FROM labelled) SELECT count(*) AS valid, CAST(sum(broken) AS BIGINT) AS quarantined FROM e")
def quarantine(spark, sf_dir):
    _, broken = rules.activity(policy(), F.col("expected"))
    return ruled(spark, sf_dir).agg(F.count_if(F.size(broken) == 0).alias("valid"), F.count_if(F.size(broken) > 0).alias("quarantined"))
