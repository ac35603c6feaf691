"""Queries: predicates, rules, the decision operator, losses, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.operators import evaluate, rules, scoring
from quillon.queries.cases import CASES, HEAD, SCORED, SUPPORT, policy, ruled, scored, table
from quillon.queries.registry import query

RULES = range(6)
SQL_RULES = ", ".join(f"rule_{i}" for i in RULES)


@query(f"WITH {CASES} SELECT case_id, expected FROM labelled")
def rule_label(spark, sf_dir):
    return ruled(spark, sf_dir).select("case_id", "expected")


@query(f"WITH {CASES} SELECT case_id, {SQL_RULES} FROM ruled")
def rule_columns(spark, sf_dir):
    return ruled(spark, sf_dir).select("case_id", *[f"rule_{i}" for i in RULES])


_ACTIVE = " || ".join(f"CASE WHEN rule_{i} THEN '{i},' ELSE '' END" for i in RULES)
_BROKEN = "CASE WHEN rule_0 AND value = 'approve' THEN '0,' ELSE '' END || " + " || ".join(f"CASE WHEN rule_{i} AND value <> '{o}' THEN '{i},' ELSE '' END" for i, o in ((1, "deny"), (2, "review"), (3, "deny"), (4, "review"), (5, "approve")))


@query(f"WITH {SCORED} SELECT case_id, value, rtrim({_ACTIVE}, ',') AS active, rtrim({_BROKEN}, ',') AS violated FROM scored")
def rule_activity(spark, sf_dir):
    active, violated = rules.activity(policy(), F.col("diagnostic.value"))
    return scored(spark, sf_dir).select("case_id", F.col("diagnostic.value").alias("value"), F.array_join(active.cast("array<string>"), ",").alias("active"), F.array_join(violated.cast("array<string>"), ",").alias("violated"))


_N_BROKEN = f"len(replace(replace({_BROKEN}, ',', ''), ' ', ''))"


@query(f"WITH {SCORED} SELECT count(*) AS records, CAST(sum({_N_BROKEN}) AS BIGINT) AS checks, round(sum({_N_BROKEN}) / count(*), 6) AS rate FROM scored")
def corpus_violations(spark, sf_dir):
    _, violated = rules.activity(policy(), F.col("diagnostic.value"))
    n = F.size(violated)
    return scored(spark, sf_dir).agg(F.count("*").alias("records"), F.sum(n).cast("long").alias("checks"), F.round(F.sum(n) / F.count("*"), 6).alias("rate"))


_KEY = "concat_ws('|', tier, CAST(age_days AS VARCHAR), status, CAST(prior AS VARCHAR), CAST(round(total * 100) AS BIGINT))"


@query(f"WITH {SCORED} SELECT count(DISTINCT {_KEY}) AS inputs, count(DISTINCT CASE WHEN {_N_BROKEN} > 0 THEN {_KEY} END) AS violating, round(count(DISTINCT CASE WHEN {_N_BROKEN} > 0 THEN {_KEY} END) / count(DISTINCT {_KEY}), 6) AS rate FROM scored")
def heldout_violations(spark, sf_dir):
    _, violated = rules.activity(policy(), F.col("diagnostic.value"))
    key = F.concat_ws("|", "tier", "age_days", "status", "prior", F.round(F.col("total") * 100).cast("long"))
    per = scored(spark, sf_dir).groupBy(key.alias("k")).agg(F.max(F.size(violated)).alias("v"))
    return per.agg(F.count("*").alias("inputs"), F.count_if(F.col("v") > 0).alias("violating"), F.round(F.count_if(F.col("v") > 0) / F.count("*"), 6).alias("rate"))


@query(f"WITH {SCORED} SELECT CAST(v AS INTEGER) AS rule, count(*) AS n FROM (SELECT unnest(string_split(rtrim({_BROKEN}, ','), ',')) AS v FROM scored) WHERE v <> '' GROUP BY v")
def violations_by_rule(spark, sf_dir):
    _, violated = rules.activity(policy(), F.col("diagnostic.value"))
    return scored(spark, sf_dir).select(F.explode(violated).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED}, v AS (SELECT case_id, CAST(unnest(string_split(rtrim({_BROKEN}, ','), ',')) AS VARCHAR) AS v FROM scored), c AS (SELECT v, count(*) AS n, min(case_id) AS example FROM v WHERE v <> '' GROUP BY v) SELECT CAST(v AS INTEGER) AS rule, n, example FROM c ORDER BY n DESC, v LIMIT 1")
def most_broken_rule(spark, sf_dir):
    _, violated = rules.activity(policy(), F.col("diagnostic.value"))
    per = scored(spark, sf_dir).select("case_id", F.explode(violated).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("case_id").alias("example"))
    return per.orderBy(F.desc("n"), "rule").limit(1)


@query(f"WITH {CASES} SELECT case_id, expected AS admitted, 1 AS n FROM labelled")
def admissible_outputs(spark, sf_dir):
    return ruled(spark, sf_dir).select("case_id", F.array_join("admitted", ",").alias("admitted"), F.size("admitted").alias("n"))


@query(f"WITH {CASES} SELECT CASE WHEN rule_1 THEN 'too_old' WHEN rule_2 THEN 'fraud' WHEN rule_3 THEN 'late' WHEN rule_4 THEN 'risky' ELSE 'clear' END AS step, count(*) AS n FROM labelled GROUP BY 1")
def rubric_steps(spark, sf_dir):
    step = F.when(F.col("rule_1"), "too_old").when(F.col("rule_2"), "fraud").when(F.col("rule_3"), "late").when(F.col("rule_4"), "risky").otherwise("clear")
    return ruled(spark, sf_dir).groupBy(step.alias("step")).agg(F.count("*").alias("n"))


@query(f"WITH {CASES} SELECT count(*) AS cases, avg(1.0) AS decided FROM labelled")
def decided_share(spark, sf_dir):
    return ruled(spark, sf_dir).agg(F.count("*").alias("cases"), F.avg((F.size("admitted") == 1).cast("double")).alias("decided"))


@query(f"WITH {CASES}, l AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS rule, unnest([rule_0, rule_1, rule_2, rule_3, rule_4, rule_5]) AS held, age_days IN (30, 31, 60, 61, 90, 91) AS edge FROM ruled) SELECT rule, count(*) FILTER (WHERE edge AND held) AS boundary_true, count(*) FILTER (WHERE edge AND NOT held) AS boundary_false, count(*) FILTER (WHERE NOT edge AND held) AS interior_true, count(*) FILTER (WHERE NOT edge AND NOT held) AS interior_false, (count(*) FILTER (WHERE edge AND held) = 0 OR count(*) FILTER (WHERE edge AND NOT held) = 0 OR count(*) FILTER (WHERE NOT edge AND held) = 0 OR count(*) FILTER (WHERE NOT edge AND NOT held) = 0) AS shortfall FROM l GROUP BY rule")
def rule_coverage(spark, sf_dir):
    return evaluate.rule_coverage(ruled(spark, sf_dir), 6, F.col("age_days").isin(30, 31, 60, 61, 90, 91))


@query(f"WITH {SCORED} SELECT case_id, value, round(confidence, 6) AS confidence, round(uncertainty, 6) AS uncertainty, round(p_a, 6) AS p_approve, round(p_d, 6) AS p_deny, round(p_r, 6) AS p_review FROM scored")
def decision_diagnostics(spark, sf_dir):
    d = F.col("diagnostic")
    parts = [F.round(d["distribution"][i]["probability"], 6).alias(f"p_{v}") for i, v in enumerate(SUPPORT)]
    return scored(spark, sf_dir).select("case_id", d["value"].alias("value"), F.round(d["confidence"], 6).alias("confidence"), F.round(d["uncertainty"], 6).alias("uncertainty"), *parts)


@query(f"WITH {SCORED} SELECT case_id, p_risk > 0.5 AS risky, round(greatest(p_risk, 1 - p_risk), 6) AS confidence, round(least(confidence, greatest(p_risk, 1 - p_risk)), 6) AS least_confidence, round(greatest(uncertainty, -(p_risk * ln(p_risk) + (1 - p_risk) * ln(1 - p_risk)) / ln(2)), 6) AS most_uncertainty FROM scored")
def object_diagnostics(spark, sf_dir):
    low, high = scoring.object_summary("diagnostic", "risk")
    return scored(spark, sf_dir).select("case_id", F.col("risk.value").alias("risky"), F.round("risk.confidence", 6).alias("confidence"), F.round(low, 6).alias("least_confidence"), F.round(high, 6).alias("most_uncertainty"))


@query(f"WITH {SCORED} SELECT CASE WHEN confidence >= 0.7 THEN 'accepted' ELSE 'fallback' END AS outcome, CASE WHEN confidence >= 0.7 THEN value ELSE 'review' END AS value, count(*) AS n FROM scored GROUP BY ALL")
def confidence_policy(spark, sf_dir):
    got = scoring.policy(F.col("diagnostic.value"), F.col("diagnostic.confidence"), 0.7, F.lit("review"), HEAD.column())
    return scored(spark, sf_dir).select(got.alias("g")).groupBy(F.col("g.outcome").alias("outcome"), F.col("g.value").alias("value")).agg(F.count("*").alias("n"))


_BIN = "least(14, CAST(floor(confidence * 15) AS INTEGER))"


@query(f"WITH {SCORED}, b AS (SELECT {_BIN} AS bin, count(*) AS n, sum(CAST(value = expected AS DOUBLE)) AS hit, sum(confidence) AS conf, sum((p_a * p_a + p_d * p_d + p_r * p_r - 2 * p_y + 1) / 2) AS loss FROM scored GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS cases, round(sum(hit) / sum(n), 6) AS accuracy, round(sum(abs(hit - conf)) / sum(n), 6) AS ece, round(sum(loss) / sum(n), 6) AS brier FROM b")
def calibration_metrics(spark, sf_dir):
    df = scored(spark, sf_dir)
    p = F.transform("diagnostic.distribution", lambda x: x["probability"])
    return evaluate.calibration(df, F.col("diagnostic.confidence"), F.col("diagnostic.value") == F.col("expected"), N.brier(p, F.col("target")))


@query(f"WITH {SCORED} SELECT {_BIN} AS bin, count(*) AS n, round(avg(CAST(value = expected AS DOUBLE)), 6) AS accuracy, round(avg(confidence), 6) AS confidence FROM scored GROUP BY 1")
def ece_bins(spark, sf_dir):
    df = scored(spark, sf_dir)
    out = evaluate.bins(df, F.col("diagnostic.confidence"), F.col("diagnostic.value") == F.col("expected"))
    return out.select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


_ALL = "(p_a * p_a + p_d * p_d + p_r * p_r - 2 * p_y + 1)"


@query(f"WITH {SCORED} SELECT tier, round(avg({_ALL} / 2), 6) AS brier_halved, round(avg({_ALL}), 6) AS brier_full FROM scored GROUP BY tier")
def brier(spark, sf_dir):
    p = F.transform("diagnostic.distribution", lambda x: x["probability"])
    return scored(spark, sf_dir).groupBy("tier").agg(F.round(F.avg(N.brier(p, F.col("target"))), 6).alias("brier_halved"), F.round(F.avg(N.brier(p, F.col("target"), normalized=False)), 6).alias("brier_full"))


@query(f"WITH {SCORED} SELECT status, round(avg(-ln(greatest(p_y, 1e-300))), 6) AS log_loss, round(avg(1 - p_y / sqrt(p_a * p_a + p_d * p_d + p_r * p_r)), 6) AS spherical, round(avg((power(p_a - CASE WHEN target < 1 THEN 1.0 ELSE 0.0 END, 2) + power(p_a + p_d - CASE WHEN target < 2 THEN 1.0 ELSE 0.0 END, 2)) / 2), 6) AS rps FROM scored GROUP BY status")
def proper_losses(spark, sf_dir):
    p, y = F.transform("diagnostic.distribution", lambda x: x["probability"]), F.col("target")
    parts = {"log_loss": N.log_loss(p, y), "spherical": N.spherical_loss(p, y), "rps": N.ranked_probability_score(p, y)}
    return scored(spark, sf_dir).groupBy("status").agg(*[F.round(F.avg(c), 6).alias(k) for k, c in parts.items()])


def _nll(t: float) -> str:
    return f"round(avg(ln(exp((z_a - z_m) / {t}) + exp((z_d - z_m) / {t}) + exp((z_r - z_m) / {t})) - ((CASE target WHEN 0 THEN z_a WHEN 1 THEN z_d ELSE z_r END) - z_m) / {t}), 6)"


@query(f"WITH {SCORED} SELECT {_nll(0.5)} AS nll_0_5, {_nll(1.0)} AS nll_1, {_nll(2.0)} AS nll_2, {_nll(4.0)} AS nll_4 FROM scored")
def nll_grid(spark, sf_dir):
    z = F.col("logits")
    return scored(spark, sf_dir).agg(*[F.round(F.avg(N.log_loss(N.softmax(z, t), F.col("target"))), 6).alias(n) for t, n in ((0.5, "nll_0_5"), (1.0, "nll_1"), (2.0, "nll_2"), (4.0, "nll_4"))])


@query()
def fitted_temperature(spark, sf_dir):
    df = scored(spark, sf_dir)
    t = evaluate.fit_temperature(df, "logits", "target")
    return spark.createDataFrame([(round(t, 3),)], "temperature double")


@query("SELECT o_orderkey AS row_id, CAST(len(o_orderpriority) AS BIGINT) AS n, round((CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) - 1) * 0.7 + 0.3 * 2, 6) AS rank FROM orders")
def expected_value_rank(spark, sf_dir):
    place = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    p = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == place, 0.7).otherwise(0.0) + F.when(i == 2, 0.3).otherwise(0.0))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.length("o_orderpriority").cast("long").alias("n"), F.round(N.expected_rank(p), 6).alias("rank"))


@query("SELECT p_partkey AS part, round(CAST(0.5 * p_size + 0.5 * 25.5 AS DOUBLE), 6) AS expected FROM part")
def expected_value_numeric(spark, sf_dir):
    head = scoring.numbers("1", "50")
    p = F.transform(head.column(), lambda v: F.lit(0.5 / 50) + F.when(v == F.col("p_size"), 0.5).otherwise(0.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.round(scoring.expected(head, p), 6).alias("expected"))


@query("WITH t AS (SELECT user_id, event_type, value / 100 AS a FROM events), e AS (SELECT *, exp(a) + exp(1.0 - a) + exp(0.5) AS s FROM t) SELECT event_type, round(avg(exp(a) / s), 6) AS p_first, round(avg(-(exp(a) / s * ln(exp(a) / s) + exp(1.0 - a) / s * ln(exp(1.0 - a) / s) + exp(0.5) / s * ln(exp(0.5) / s)) / ln(3)), 6) AS entropy FROM e GROUP BY event_type")
def normalized_entropy(spark, sf_dir):
    a = F.col("value") / 100
    p = N.softmax(F.array(a, 1.0 - a, F.lit(0.5)))
    return table(spark, sf_dir, "events").withColumn("p", p).groupBy("event_type").agg(F.round(F.avg(F.col("p")[0]), 6).alias("p_first"), F.round(F.avg(N.normalized_entropy(F.col("p"))), 6).alias("entropy"))


@query("SELECT event_id, round(CASE WHEN value >= 0 THEN 1 / (1 + exp(-value / 50)) ELSE exp(value / 50) / (1 + exp(value / 50)) END, 6) AS p FROM events")
def sigmoid(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(N.stable_sigmoid(F.col("value") / 50), 6).alias("p"))


@query(f"WITH {SCORED}, d AS (SELECT *, CASE WHEN z_a / 1.5 + 0.2 >= z_d / 1.5 AND z_a / 1.5 + 0.2 >= z_r / 1.5 THEN 'approve' WHEN z_d >= z_r THEN 'deny' ELSE 'review' END AS other FROM scored) SELECT tier, count(*) AS cases, count(*) FILTER (WHERE value <> other) AS disagreements, round(avg(CAST(value = expected AS DOUBLE)), 6) AS before, round(avg(CAST(other = expected AS DOUBLE)), 6) AS after FROM d GROUP BY ROLLUP (tier)")
def disagreement(spark, sf_dir):
    z = F.col("logits")
    other = scoring.chosen_index(HEAD, F.array(z[0] / 1.5 + 0.2, z[1] / 1.5, z[2] / 1.5))
    df = scored(spark, sf_dir).withColumn("value", F.col("diagnostic.value")).withColumn("other", HEAD.value_at(other))
    return df.rollup("tier").agg(F.count("*").alias("cases"), F.count_if(F.col("value") != F.col("other")).alias("disagreements"), F.round(F.avg((F.col("value") == F.col("expected")).cast("double")), 6).alias("before"), F.round(F.avg((F.col("other") == F.col("expected")).cast("double")), 6).alias("after"))


@query("SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS nation, round(exp(s_nationkey / 10.0) / (exp(s_nationkey / 10.0) + 1), 6) AS p FROM supplier")
def stage_fusion(spark, sf_dir):
    def score(distinct):
        return distinct.withColumn("p", F.round(N.stable_sigmoid(F.col("s_nationkey") / 10.0), 6))

    return scoring.score_distinct(table(spark, sf_dir, "supplier"), ["s_nationkey"], score).select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("nation"), "p")


@query(f"WITH {SCORED} SELECT list_filter([CASE WHEN avg(CAST(value = expected AS DOUBLE)) >= 0.95 THEN NULL ELSE 'accuracy' END, CASE WHEN avg(confidence) >= 0.5 THEN NULL ELSE 'confidence' END, CASE WHEN count(*) >= 100 THEN NULL ELSE 'coverage' END], lambda x: x IS NOT NULL)[1] AS first_failed, CAST(len(list_filter([CASE WHEN avg(CAST(value = expected AS DOUBLE)) >= 0.95 THEN NULL ELSE 'accuracy' END, CASE WHEN avg(confidence) >= 0.5 THEN NULL ELSE 'confidence' END, CASE WHEN count(*) >= 100 THEN NULL ELSE 'coverage' END], lambda x: x IS NOT NULL)) AS INTEGER) AS failed FROM scored")
def gates(spark, sf_dir):
    m = scored(spark, sf_dir).agg(F.avg((F.col("diagnostic.value") == F.col("expected")).cast("double")).alias("a"), F.avg("diagnostic.confidence").alias("c"), F.count("*").alias("n"))
    failed = evaluate.failed_gates({"accuracy": F.col("a") >= 0.95, "confidence": F.col("c") >= 0.5, "coverage": F.col("n") >= 100})
    return m.select(F.get(failed, F.lit(0)).alias("first_failed"), F.size(failed).alias("failed"))
