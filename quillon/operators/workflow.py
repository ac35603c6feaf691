"""Workflows over the operators: labelling, refill, adversarial pairs, verification, estimates, explanation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.operators import datasets, evaluate, explain, generate, rules


class Labeller(Protocol):
    """A source of labels: a frame of inputs in, the same rows with a `label` out (null where it has none)."""

    def label(self, inputs: DataFrame) -> DataFrame: ...


class RuleLabeller:
    """Labels by the rules that decide an input."""

    def __init__(self, rules_: list[rules.Rule], support: list):
        self.rules, self.support = rules_, support

    def label(self, inputs: DataFrame) -> DataFrame:
        columns = inputs.columns
        ruled = rules.with_rules(inputs, self.rules, self.support)
        return ruled.select(*columns, rules.rule_label(rules.admissible(self.rules, self.support)).alias("label"))


class BatchLabeller:
    """Labels by a Python function over batches of rows (a local model, a service), Arrow-fed; the client is made once a task."""

    def __init__(self, make: Callable[[], Callable[[pd.DataFrame], list]]):
        self.make = make

    def label(self, inputs: DataFrame) -> DataFrame:
        from pyspark.sql import types as T

        make, schema = self.make, T.StructType([*inputs.schema.fields, T.StructField("label", T.StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = make()
            for b in batches:
                yield b.assign(label=ask(b))

        return inputs.mapInPandas(run, schema)


def labelled_first(inputs: DataFrame, first: Labeller, then: Labeller, key: str) -> DataFrame:
    """Labels of the first source, of the second only for what the first leaves open."""
    a = first.label(inputs)
    open_ = a.where(F.col("label").isNull()).drop("label")
    return a.where(F.col("label").isNotNull()).withColumn("by", F.lit("first")).unionByName(then.label(open_).withColumn("by", F.lit("second")))


def decided(spark, n: int, stream: str, fields: list[generate.Field], labeller: Labeller, known: DataFrame | None = None, rounds: int = 3, share: float = 1.5) -> DataFrame:
    """n distinct inputs that the labeller decides, none of them known: draw more than needed, filter, and draw
    again (a further stretch of the stream) until there are enough, three times at most."""
    names, need = [f.name for f in fields], int(n * share)
    for turn in range(rounds):
        got = labeller.label(generate.sample(spark, need * 2**turn, stream, fields)).where(F.col("label").isNotNull())
        got = datasets.first_of_each(got, names, [F.col("row_id")])
        if known is not None:
            got = got.join(known.select(*names).distinct(), names, "left_anti")
        if got.count() >= n or turn == rounds - 1:
            return got.orderBy("row_id").limit(n)
    raise AssertionError


def adversarial(df: DataFrame, fields: list[generate.Field], labeller: Labeller, predicates: dict[int, Callable[[str], Column]], per_rule: int = 1) -> tuple[DataFrame, DataFrame]:
    """(boundary, counterfactual): per rule some pairs of inputs one field apart on its two sides; per row the
    first edit that changes the label. predicates: rule -> a function of a column prefix that gives whether it holds."""
    names = [f.name for f in fields]
    edited = generate.edits(df, fields, ["row_id"])
    sides = []
    for i, holds in predicates.items():
        flips = edited.where(holds("") != holds("twin.")).withColumn("rule", F.lit(i))
        # a few rows of the whole, so each task passes on its own few
        sides.append(flips.orderBy(F.sha2(F.concat_ws(":", "row_id", "path", "new"), 256), "row_id", "path", "new").limit(per_rule))
    boundary = sides[0]
    for s in sides[1:]:
        boundary = boundary.unionByName(s)
    base = labeller.label(df.select("row_id", *names)).select("row_id", F.col("label").alias("was"))
    twins = labeller.label(edited.select("row_id", "path", "new", *[F.col(f"twin.{n}").alias(n) for n in names]))
    changed = twins.join(base, "row_id").where(F.col("label") != F.col("was"))
    first = datasets.first_of_each(changed, ["row_id"], [F.col("path"), F.col("new")])
    return boundary, first


def verify(df: DataFrame, heads: list[tuple[str, str, str]], thresholds: dict[str, float]) -> DataFrame:
    """One row: cases, exact accuracy, worst ECE and Brier over heads, and the gates that fail.
    heads: (confidence column, correct column, loss column)."""
    per = []
    for i, (confidence, correct, loss) in enumerate(heads):
        per.append(evaluate.calibration(df, F.col(confidence), F.col(correct), F.col(loss)).withColumn("head", F.lit(i)))
    all_heads = per[0]
    for p in per[1:]:
        all_heads = all_heads.unionByName(p)
    worst = all_heads.agg(F.max("cases").alias("cases"), F.max("ece").alias("ece"), F.max("brier").alias("brier"))
    exact = df.agg(F.round(F.avg(_all([F.col(c) for _, c, _ in heads]).cast("double")), 6).alias("accuracy"))
    row = worst.crossJoin(exact)
    gates = {"accuracy": F.col("accuracy") >= thresholds["accuracy"], "ece": F.col("ece") <= thresholds["ece"], "brier": F.col("brier") <= thresholds["brier"]}
    return row.withColumn("failed", evaluate.failed_gates(gates))


def _all(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def advice(failed: Column, distinct_ratio: Column) -> Column:
    """What to try next, from the gates that fail and how distinct the inputs are."""
    return (
        F.when(F.size(failed) == 0, "release")
        .when(distinct_ratio < 0.5, "generate more distinct inputs")
        .when(F.array_contains(failed, "accuracy"), "add examples near the rules that are broken most")
        .when(F.array_contains(failed, "ece"), "fit the temperature again")
        .otherwise("train longer")
    )


def estimate(functions: DataFrame, per_million_in: float, per_million_out: float, seconds_each: float) -> DataFrame:
    """Requests, tokens, cost and hours of what isn't cached, per function and in all (null function).
    functions: function, cases, cached (boolean), characters_in, characters_out of one request."""
    requests = F.when(F.col("cached"), 0).otherwise(F.col("cases")).cast("long")
    t_in, t_out = N.token_estimate(F.col("characters_in")), N.token_estimate(F.col("characters_out"))
    per = functions.select("function", requests.alias("requests"), (requests * t_in).alias("tokens_in"), (requests * t_out).alias("tokens_out"))
    cost = F.round(N.price(F.sum("tokens_in"), F.sum("tokens_out"), per_million_in, per_million_out), 6)
    return per.rollup("function").agg(F.sum("requests").alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), cost.alias("cost"), F.round(F.sum("requests") * seconds_each / 3600, 6).alias("hours"))


def explained(calls: DataFrame, examples: DataFrame, rules_: list[rules.Rule], support: list, output: str, numbers: list[str], flags: list[str], k: int, key: str) -> DataFrame:
    """Each call's answer, active and violated rules and nearest examples (ids, nearest first)."""
    active, broken = rules.activity(rules_, F.col(output))
    ruled = rules.with_rules(calls, rules_, support).select(F.col(key).alias("query"), output, active.alias("active"), broken.alias("violated"))
    near = explain.nearest(calls.select(key, *numbers, *flags), examples.select(key, *numbers, *flags), numbers, [], flags, k, key)
    lists = near.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("nearest"))  # k entries each
    return ruled.join(lists, "query", "left")


def sampled_slices(candidates: DataFrame, excluded: DataFrame, key: str, evaluation: int, training: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(slices, funnel): fresh distinct keys in a seeded order, the first `evaluation` of them and the next `training`; and how many fell out why."""
    known = excluded.select(key).distinct().withColumn("known", F.lit(True))
    firsts = candidates.groupBy(key).agg(F.count("*").alias("n")).join(known, key, "left")
    funnel = firsts.agg(F.sum("n").alias("candidates"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("excluded"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"))
    fresh = firsts.where(F.col("known").isNull()).withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256))
    top = fresh.orderBy("h", key).limit(evaluation + training)
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy("h", key)))
    return ranked.select(key, F.when(F.col("rn") <= evaluation, "evaluation").otherwise("training").alias("slice")), funnel


def table_text(df: DataFrame, most: int = 1000) -> str:
    """A frame as a fixed-width text table, at most so many rows: for reports."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(most).collect()]
    widths = [max(len(x) for x in col) for col in zip(df.columns, *rows, strict=True)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])
