"""The decision operator: logits -> distribution, value, confidence, policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import numeric as N


@dataclass(frozen=True)
class Head:
    """An output with finite support. kind: boolean | nominal | ordinal | number."""

    kind: str
    support: tuple

    def column(self) -> Column:
        return F.array(*[F.lit(v) for v in self.support])

    def index_of(self, value: Column) -> Column:
        """A value's place in the support, from 0; null outside."""
        at = F.array_position(self.column(), value)
        return F.when(at > 0, (at - 1).cast("int"))

    def value_at(self, index: Column) -> Column:
        return F.get(self.column(), index)


def boolean() -> Head:
    return Head("boolean", (False, True))


def nominal(*values: str) -> Head:
    """Unordered texts, in code-point order."""
    return Head("nominal", tuple(sorted(values)))


def ordinal(*values: str) -> Head:
    return Head("ordinal", tuple(values))


def numbers(low: str, high: str, step: str = "1") -> Head:
    return Head("number", tuple(float(v) for v in N.decimal_grid(low, high, step)))


def probabilities(logits: Column, temperature: float | Column = 1.0) -> Column:
    """In support order; a single logit is the second value's, against 0."""
    one = N.stable_sigmoid(F.get(logits, F.lit(0)) / temperature)
    return F.when(F.size(logits) == 1, F.array(1 - one, one)).otherwise(N.softmax(logits, temperature))


def expected(head: Head, p: Column) -> Column:
    if head.kind == "ordinal":
        return N.expected_rank(p)
    if head.kind == "number":
        return N.expected_number(p, head.column().cast("array<double>"))
    return F.lit(None).cast("double")


def chosen_index(head: Head, p: Column) -> Column:
    """First of the most probable; a boolean is true only above one half."""
    return F.when(F.get(p, F.lit(1)) > 0.5, 1).otherwise(0) if head.kind == "boolean" else N.argmax_first(p)


def with_diagnostic(df: DataFrame, head: Head, logits: str, temperature: float | Column = 1.0, name: str = "diagnostic") -> DataFrame:
    """A struct: value, confidence, uncertainty, distribution, expected_value. The
    distribution is computed once (a projection of its own), the rest from it."""
    p, i = F.col(f"_{name}_p"), F.col(f"_{name}_i")
    df = df.withColumn(f"_{name}_p", probabilities(F.col(logits), temperature)).withColumn(f"_{name}_i", chosen_index(head, p))
    distribution = F.zip_with(head.column(), p, lambda v, x: F.struct(v.alias("value"), x.alias("probability")))
    out = F.struct(
        head.value_at(i).alias("value"), F.get(p, i).alias("confidence"), N.normalized_entropy(p).alias("uncertainty"),
        distribution.alias("distribution"), expected(head, p).alias("expected_value"),
    )
    return df.withColumn(name, out).drop(f"_{name}_p", f"_{name}_i")


def object_summary(*diagnostics: str) -> tuple[Column, Column]:
    """Of an object's fields: the least confidence and the most uncertainty."""
    low = [F.col(f"{d}.confidence") for d in diagnostics]
    high = [F.col(f"{d}.uncertainty") for d in diagnostics]
    return (F.least(*low) if len(low) > 1 else low[0]), (F.greatest(*high) if len(high) > 1 else high[0])


def policy(value: Column, confidence: Column, required: float, fallback: Column | None = None, support: Column | None = None) -> Column:
    """A struct of outcome (accepted | fallback | rejected) and value. A fallback outside the support is rejected."""
    usable = F.lit(False) if fallback is None else (F.lit(True) if support is None else F.array_contains(support, fallback))
    outcome = F.when(confidence >= required, "accepted").when(usable, "fallback").otherwise("rejected")
    got = F.when(confidence >= required, value)
    if fallback is not None:
        got = F.when(confidence >= required, value).when(usable, fallback)
    return F.struct(outcome.alias("outcome"), got.alias("value"))


def strict_policy(value: Column, confidence: Column, required: float) -> Column:
    """The value, or an error that names the confidence and what was required."""
    message = F.format_string(f"confidence %.4f is below {required}", confidence)
    return F.when(confidence >= required, value).otherwise(F.raise_error(message).cast("string"))


def score_distinct(df: DataFrame, key: list[str], score) -> DataFrame:
    """Score each distinct input once and give the result to all rows that share it:
    score(distinct rows) -> the same rows with further columns. Worth it where the
    scorer is dear (a learned model); nulls in keys are equal to each other."""
    scored = score(df.select(*key).distinct())
    extra = [c for c in scored.columns if c not in key]
    right = scored.select(*[F.col(k).alias(f"_k_{k}") for k in key], *extra)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    return df.join(right, on, "left").drop(*[f"_k_{k}" for k in key])


def in_stages(df: DataFrame, stages: list[dict]) -> DataFrame:
    """A plan: each stage maps names to functions of the frame that give Columns; later stages may read earlier outputs."""
    for stage in stages:
        df = df.withColumns({name: make(df) for name, make in stage.items()})
    return df


def fused_stage(calls: DataFrame, functions: DataFrame, encode, adapt, head) -> tuple[DataFrame, DataFrame]:
    """One stage of many functions over shared passes. calls: call, function, input; functions: function, encoder, adapter.
    encode(rows of encoder, input) adds `encoded`, one pass for each distinct input of an encoder; adapt(rows of encoder, adapter,
    input, encoded) adds `adapted`, one for each distinct input of an adapter (a null adapter hands on what is encoded);
    head(rows of call, function, adapted) adds `output`. Returns (call, function, output) and one row of passes."""
    routed = calls.join(functions, "function")  # a function without a route has no output
    key = ["encoder", "input"]
    encoded = score_distinct(routed, key, encode)
    plain, with_adapter = encoded.where(F.col("adapter").isNull()).withColumn("adapted", F.col("encoded")), encoded.where(F.col("adapter").isNotNull())
    adapted = score_distinct(with_adapter, ["encoder", "adapter", "input", "encoded"], adapt).unionByName(plain)
    out = head(adapted.select("call", "function", "adapted")).select("call", "function", "output")
    passes = routed.agg(F.count_distinct("encoder", "input").alias("encodings"), F.count_distinct("encoder", "adapter", "input").alias("adaptations"), F.count("*").alias("heads"))
    return out, passes
