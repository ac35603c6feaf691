"""Generators: typed samples, single-field edits, boundary and counterfactual twins.

All draws are digests of (stream, row, field), so a sample is the same on every
engine, partitioning and retry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.rules import Node


@dataclass(frozen=True)
class Field:
    """How to draw one input. choices: texts to choose from; else a range of whole numbers, half of the draws near thresholds."""

    name: str
    choices: tuple[str, ...] = ()
    low: int = 0
    high: int = 0
    thresholds: tuple[int, ...] = ()


def draw(stream: str, row: Column, field: str, modulus: int, salt: str = "") -> Column:
    """A number below modulus from the first twelve hex digits of a digest."""
    material = F.concat_ws(":", F.lit(stream), row.cast("string"), F.lit(field + salt))
    return F.conv(F.substring(F.sha2(material, 256), 1, 12), 16, 10).cast("long") % modulus


def sampled(stream: str, row: Column, f: Field) -> Column:
    if f.choices:
        return F.element_at(F.array(*[F.lit(c) for c in f.choices]), (draw(stream, row, f.name, len(f.choices)) + 1).cast("int"))
    uniform = draw(stream, row, f.name, f.high - f.low + 1) + f.low
    if not f.thresholds:
        return uniform
    near = F.element_at(F.array(*[F.lit(t) for t in f.thresholds]), (draw(stream, row, f.name, len(f.thresholds), "/t") + 1).cast("int")) + draw(stream, row, f.name, 3, "/o") - 1
    inside = F.least(F.greatest(near, F.lit(f.low)), F.lit(f.high))
    return F.when(draw(stream, row, f.name, 2, "/w") == 0, inside).otherwise(uniform).cast("long")


def sample(spark: SparkSession, n: int, stream: str, fields: list[Field]) -> DataFrame:
    df = spark.range(n).withColumnRenamed("id", "row_id")
    return df.select("row_id", *[sampled(stream, F.col("row_id"), f).alias(f.name) for f in fields])


def facts(predicates: list[Node]) -> dict[str, dict[str, set]]:
    """Per input: the numbers and texts that predicates compare it with."""
    out: dict[str, dict[str, set]] = {}

    def walk(n: Node) -> None:
        if n.kind == "binary":
            for a, b in (n.parts, n.parts[::-1]):
                if a.kind == "input" and b.kind == "literal":
                    kind = "texts" if isinstance(b.value, str) else "thresholds"
                    out.setdefault(a.value, {"texts": set(), "thresholds": set()})[kind].add(b.value)
        for p in n.parts:
            walk(p)

    for p in predicates:
        walk(p)
    return out


def inferred(name: str, found: dict[str, set], examples: list[float] = ()) -> Field:
    """A field's draws from what predicates and examples say of it: texts to choose from, or a range twice as wide as the largest threshold."""
    if found["texts"]:
        return Field(name, choices=(*sorted(found["texts"]), "other"))
    numbers = sorted({*found["thresholds"], *examples})
    high = int(max(numbers) * 2) if numbers and max(numbers) > 0 else 10
    low = int(min(0, *numbers)) * 2 if numbers and min(numbers) < 0 else 0
    return Field(name, low=low, high=high, thresholds=tuple(int(t) for t in sorted(found["thresholds"])))


def edits(df: DataFrame, fields: list[Field], keep: list[str]) -> DataFrame:
    """Every edit of one field of every row: path, old, new (as text) and the twin's fields. A number
    moves to each threshold and one beside it; a text to each other choice."""
    names = [f.name for f in fields]
    each = []
    for f in fields:
        values = [F.lit(c) for c in f.choices] or [F.lit(v).cast("long") for t in f.thresholds for v in (t - 1, t, t + 1) if f.low <= v <= f.high]
        for v in values:
            twin = F.struct(*[(v if n == f.name else F.col(n)).alias(n) for n in names])
            each.append(F.when(~F.col(f.name).eqNullSafe(v), F.struct(F.lit(f.name).alias("path"), F.col(f.name).cast("string").alias("old"), v.cast("string").alias("new"), twin.alias("twin"))))
    return df.select(*keep, *[n for n in names if n not in keep], F.explode(F.array_compact(F.array(*each))).alias("edit")).select("*", "edit.*").drop("edit")


def coverage_brief(df: DataFrame, row: str, support: list[str], rules: int) -> DataFrame:
    """Round robin by row number over outputs, then over: no rule, satisfy rule i, nearly satisfy rule i."""
    k = F.col(row)
    turn = F.floor(k / len(support)) % (1 + 2 * rules)
    what = F.when(turn == 0, "none").when(turn % 2 == 1, "satisfy").otherwise("near_miss")
    return df.withColumns({"output": F.element_at(F.array(*[F.lit(s) for s in support]), (k % len(support) + 1).cast("int")), "what": what, "rule": F.when(turn > 0, F.floor((turn - 1) / 2)).cast("int")})
