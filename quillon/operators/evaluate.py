"""Evaluation of scorers: accuracy, calibration, agreement, percentiles, gates.

Every metric is one or two hash aggregations with partial sums; nothing is
collected but the temperature's candidate losses.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.operators.ordering import positioned, positioned_within
from quillon.sources.shared import checkpointed


def bins(df: DataFrame, confidence: Column, correct: Column, by: tuple[str, ...] = (), n: int = 15) -> DataFrame:
    """by, bin, n, accuracy, confidence of every populated bin."""
    return df.groupBy(*by, N.calibration_bin(confidence, n).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(confidence).alias("confidence"), F.sum(correct.cast("long")).alias("correct")
    )


def calibration(df: DataFrame, confidence: Column, correct: Column, loss: Column, by: tuple[str, ...] = (), n: int = 15) -> DataFrame:
    """by, cases, accuracy, ece, brier. loss: the Brier score of a case."""
    per = df.groupBy(*by, N.calibration_bin(confidence, n).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(correct.cast("double")).alias("hit"), F.sum(confidence).alias("conf"), F.sum(loss).alias("loss")
    )
    return per.groupBy(*by).agg(
        F.sum("n").alias("cases"), F.round(F.sum("hit") / F.sum("n"), 6).alias("accuracy"),
        F.round(F.sum(F.abs(F.col("hit") - F.col("conf"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("loss") / F.sum("n"), 6).alias("brier"),
    )


def nearest_rank(value: str, q: float) -> Column:
    """The value at place ceil(q n) of the sorted values."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def truncated_rank(df: DataFrame, value: str, q: float) -> DataFrame:
    """The value at place int(q (n - 1)) from 0 of the sorted values: by position among sorted distinct values, without one task for all rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    upto = positioned(counts, [F.col(value)], {"upto": "n"})
    total = counts.agg(F.sum("n").alias("total"))
    place = F.floor(F.lit(q) * (F.col("total") - 1)) + 1
    return upto.crossJoin(F.broadcast(total)).where(F.col("upto") >= place).agg(F.min(value).alias(value))


def temperature_losses(df: DataFrame, logits: str, target: str, betas: list[float]) -> list[float]:
    """Mean negative log likelihood for each inverse temperature, in one pass."""
    z = N.expanded(F.col(logits))
    losses = [F.avg(N.log_loss(N.softmax(z, F.lit(1.0 / b)), F.col(target))).alias(f"b{i}") for i, b in enumerate(betas)]
    row = df.agg(*losses).first()
    return [math.inf if v is None else v for v in row]


def fit_temperature(df: DataFrame, logits: str, target: str, low: float = 0.05, high: float = 20.0, rounds: int = 5, points: int = 9) -> float:
    """One temperature by a search over its inverse that narrows in rounds; every round is one
    aggregation over all rows. Losses equal to nine digits count as ties and go to the temperature nearest one."""
    df = checkpointed(df.select(logits, target))  # scored once, read by every round
    a, b = math.log(1 / high), math.log(1 / low)
    best = 0.0
    for _ in range(rounds):
        grid = sorted({*(a + (b - a) * i / (points - 1) for i in range(points)), min(max(0.0, a), b)})
        losses = temperature_losses(df, logits, target, [math.exp(g) for g in grid])
        best = min(zip([round(x, 9) for x in losses], [abs(g) for g in grid], grid, strict=True))[2]
        width = (b - a) / (points - 1)
        a, b = best - width, best + width
    return 1 / math.exp(best)


def pair_consistency(pairs: DataFrame, right: DataFrame) -> DataFrame:
    """Share of pairs right on both members; 1 without pairs. pairs: anchor, twin; right: row_id, ok."""
    a, t = right.select(F.col("row_id").alias("anchor"), F.col("ok").alias("a_ok")), right.select(F.col("row_id").alias("twin"), F.col("ok").alias("t_ok"))
    both = pairs.join(a, "anchor").join(t, "twin")
    return both.agg(F.count("*").alias("pairs"), F.coalesce(F.avg((F.col("a_ok") & F.col("t_ok")).cast("double")), F.lit(1.0)).alias("consistency"))


def agreement(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Per group and in all (null group): cases, agreements, rate."""
    return df.rollup(by).agg(F.count("*").alias("cases"), F.count_if(F.col(a).eqNullSafe(F.col(b))).alias("agreements")).withColumn("rate", F.round(F.col("agreements") / F.col("cases"), 4))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def failed_gates(gates: dict[str, Column]) -> Column:
    """Names of the gates that don't hold, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items()]))


def go_no_go(metrics: DataFrame, candidate: str, comparator: str, required: list[str], below_ms: float = 10.0) -> DataFrame:
    """One row from a metrics row per role: status, the numbers it rests on, missing roles."""
    picks = [F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{c}_{k}") for k, r in (("candidate", candidate), ("comparator", comparator)) for c in ("p50", "accuracy")]
    row = metrics.agg(F.collect_set("role").alias("roles"), *picks)
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.col("roles"))
    fast, right = F.col("p50_candidate") < below_ms, F.col("accuracy_candidate") >= F.col("accuracy_comparator")
    status = F.when(F.size(missing) > 0, "incomplete").when(fast & right, "go").otherwise("no-go")
    return row.select(status.alias("status"), "p50_candidate", "accuracy_candidate", "accuracy_comparator", fast.alias("latency_passed"), right.alias("accuracy_passed"), F.array_sort(missing).alias("missing"))


def ordered_digest(key: str, text: str) -> Column:
    """A digest of all rows' texts in key order: of one text, so for groups that fit a buffer; others have block_digest."""
    return F.sha2(F.expr(f"listagg({text}, '\n') WITHIN GROUP (ORDER BY {key})"), 256)


def block_digest(df: DataFrame, group: str, key: str, text: str, rows: int = 10_000) -> DataFrame:
    """group, digest: the digest of the digests of blocks of so many rows in key order, so that no task holds a group."""
    placed = positioned_within(df.select(group, key, text), [group], [F.col(key)])
    blocks = placed.groupBy(group, F.floor((F.col("position") - 1) / rows).alias("block")).agg(ordered_digest(key, text).alias("digest"))
    return blocks.groupBy(group).agg(ordered_digest("block", "digest").alias("digest"))


def rule_coverage(df: DataFrame, rules: int, boundary: Column, prefix: str = "rule_") -> DataFrame:
    """Per rule: how often it holds or not, on boundary rows and inside; shortfall where one never occurs."""
    parts = [F.struct(F.lit(i).alias("rule"), F.col(f"{prefix}{i}").alias("held")) for i in range(rules)]
    each = df.select(boundary.alias("edge"), F.explode(F.array(*parts)).alias("r")).groupBy(F.col("r.rule").alias("rule"))
    cells = {"boundary_true": F.col("edge") & F.col("r.held"), "boundary_false": F.col("edge") & ~F.col("r.held"), "interior_true": ~F.col("edge") & F.col("r.held"), "interior_false": ~F.col("edge") & ~F.col("r.held")}
    out = each.agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    return out.withColumn("shortfall", reduce(lambda a, b: a | b, [F.col(n) == 0 for n in cells]))


def retry_decision(per_function: DataFrame, accuracy_floor: float, narrow: float) -> DataFrame:
    """Whether to train again with another seed: some function fails, and every failure is narrow."""
    fails = F.col("accuracy") < accuracy_floor
    return per_function.agg(F.count_if(fails).alias("failing"), F.coalesce(F.bool_and(~fails | (F.col("accuracy") >= accuracy_floor - narrow)), F.lit(True)).alias("all_narrow")).withColumn(
        "retry", (F.col("failing") > 0) & F.col("all_narrow")
    )
