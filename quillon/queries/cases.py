"""The decision cases over the orders table: features, policy, logits; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.numeric import whole_days
from quillon.operators import features, rules, scoring

SUPPORT = ["approve", "deny", "review"]
HEAD = scoring.nominal(*SUPPORT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def policy() -> list[rules.Rule]:
    """The refund policy: windows by tier, fraud and risk to review."""
    age, status, tier, prior, total = (rules.given(n) for n in ("age_days", "status", "tier", "prior", "total"))
    late = (tier.eq("standard") & (age > 30)) | (tier.eq("enterprise") & (age > 60))
    timely = (tier.eq("standard") & (age <= 30)) | (tier.eq("enterprise") & (age <= 60))
    risky = (prior >= 5) | ((prior >= 3) & (total >= 1000)) | (total >= 5000) | ((age <= 1) & (total >= 2000) & (prior >= 2))
    paid = status.eq("paid")
    return [
        rules.never(status.eq("fraudulent"), "approve"),
        rules.always(age > 90, "deny"),
        rules.always((age <= 90) & status.eq("fraudulent"), "review"),
        rules.always((age <= 90) & paid & late, "deny"),
        rules.always(paid & timely & risky, "review"),
        rules.always(paid & timely & ~risky, "approve"),
    ]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, customer, o_orderdate, tier, age_days, status, prior, total."""
    orders = table(spark, sf_dir, "orders")
    spend = orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
    tiers = features.tier_by_quantile(spend, 0.8, "enterprise", "standard").select("o_custkey", "tier")
    last = orders.agg(F.max("o_orderdate").alias("last"))
    earlier = features.before("o_custkey", "o_orderdate", "o_orderkey")
    known = orders.withColumn("prior", features.running_count(F.col("o_orderstatus") == "F", earlier))
    return known.join(tiers, "o_custkey").crossJoin(F.broadcast(last)).select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("customer"), "o_orderdate", "tier",
        (whole_days(F.col("last"), F.col("o_orderdate")) % 120).alias("age_days"),
        F.when(F.col("o_orderstatus") == "F", "fraudulent").otherwise("paid").alias("status"), "prior", (F.col("o_totalprice") / 100).alias("total"), "o_orderpriority",
    )


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with a column per rule, what they admit and the label."""
    df = rules.with_rules(cases(spark, sf_dir), policy(), SUPPORT)
    return df.withColumn("admitted", rules.admissible(policy(), SUPPORT)).withColumn("expected", rules.rule_label(F.col("admitted")))


def scored(spark: SparkSession, sf_dir: str, temperature: float = 1.5) -> DataFrame:
    """Labelled cases with a diagnostic of three linear logits, and a boolean one of a single logit."""
    w = F.when(F.col("tier") == "enterprise", 60).otherwise(30)
    age, prior, total = F.col("age_days"), F.col("prior"), F.col("total")
    fraud = F.when(F.col("status") == "fraudulent", 3.0).otherwise(0.0)
    logits = F.array(0.05 * (w - age) - 0.3 * prior, 0.06 * (age - w), 0.4 * prior + total / 2000 - 1 + fraud)
    df = ruled(spark, sf_dir).withColumn("logits", logits).withColumn("risk_logits", F.array(0.5 * prior + total / 4000 - 2))
    df = scoring.with_diagnostic(df, HEAD, "logits", temperature)
    return scoring.with_diagnostic(df, scoring.boolean(), "risk_logits", 1.0, "risk").withColumn("target", HEAD.index_of(F.col("expected")))


#: The same as common table expressions. cases -> ruled -> scored (p_a, p_d, p_r, value, confidence, target).
CASES = """
spend AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY o_custkey),
cut AS (SELECT quantile_cont(spend, 0.8) AS q FROM spend),
latest AS (SELECT max(o_orderdate) AS last FROM orders),
cases AS (
  SELECT o_orderkey AS case_id, o.o_custkey AS customer, o_orderdate, CASE WHEN spend >= q THEN 'enterprise' ELSE 'standard' END AS tier,
         CAST(floor((epoch(last) - epoch(o_orderdate)) / 86400) AS BIGINT) % 120 AS age_days,
         CASE WHEN o_orderstatus = 'F' THEN 'fraudulent' ELSE 'paid' END AS status,
         count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o.o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
         o_totalprice / 100 AS total, o_orderpriority
  FROM orders o JOIN spend s ON o.o_custkey = s.o_custkey CROSS JOIN cut CROSS JOIN latest),
facts AS (
  SELECT *, CASE WHEN tier = 'enterprise' THEN 60 ELSE 30 END AS w,
         (prior >= 5 OR (prior >= 3 AND total >= 1000) OR total >= 5000 OR (age_days <= 1 AND total >= 2000 AND prior >= 2)) AS risky FROM cases),
ruled AS (
  SELECT *, status = 'fraudulent' AS rule_0, age_days > 90 AS rule_1, age_days <= 90 AND status = 'fraudulent' AS rule_2,
         age_days <= 90 AND status = 'paid' AND age_days > w AS rule_3, status = 'paid' AND age_days <= w AND risky AS rule_4,
         status = 'paid' AND age_days <= w AND NOT risky AS rule_5 FROM facts),
labelled AS (
  SELECT *, CASE WHEN rule_1 THEN 'deny' WHEN rule_2 THEN 'review' WHEN rule_3 THEN 'deny' WHEN rule_4 THEN 'review' ELSE 'approve' END AS expected FROM ruled)
"""
SCORED = (
    CASES
    + """,
raw AS (SELECT *, 0.05 * (w - age_days) - 0.3 * prior AS z_a, 0.06 * (age_days - w) AS z_d,
        0.4 * prior + total / 2000 - 1 + CASE WHEN status = 'fraudulent' THEN 3.0 ELSE 0.0 END AS z_r, 0.5 * prior + total / 4000 - 2 AS z_risk FROM labelled),
ex AS (SELECT *, greatest(z_a, z_d, z_r) AS z_m FROM raw),
sm AS (SELECT *, exp((z_a - z_m) / 1.5) AS e_a, exp((z_d - z_m) / 1.5) AS e_d, exp((z_r - z_m) / 1.5) AS e_r FROM ex),
prob AS (SELECT *, e_a / (e_a + e_d + e_r) AS p_a, e_d / (e_a + e_d + e_r) AS p_d, e_r / (e_a + e_d + e_r) AS p_r, 1 / (1 + exp(-z_risk)) AS p_risk FROM sm),
scored AS (
  SELECT *, CASE WHEN p_a >= p_d AND p_a >= p_r THEN 'approve' WHEN p_d >= p_r THEN 'deny' ELSE 'review' END AS value, greatest(p_a, p_d, p_r) AS confidence,
         -(p_a * ln(p_a) + p_d * ln(p_d) + p_r * ln(p_r)) / ln(3) AS uncertainty,
         CASE expected WHEN 'approve' THEN p_a WHEN 'deny' THEN p_d ELSE p_r END AS p_y,
         CASE expected WHEN 'approve' THEN 0 WHEN 'deny' THEN 1 ELSE 2 END AS target FROM prob)
"""
)
