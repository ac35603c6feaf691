"""Execution plans: dependency edges -> stages, routing, exact cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.shared import checkpointed


class PlanError(ValueError):
    pass


def edges_of(reads: DataFrame) -> DataFrame:
    """Distinct (producer, consumer, input) from where outputs are read."""
    return reads.select("producer", "consumer", "consumer_input").distinct()


def levels(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """The longest path to each node. A plan is a small graph, held on the driver; a cycle is an error."""
    inside, out = {n: 0 for n in nodes}, {n: [] for n in nodes}
    for a, b in set(edges):
        if a not in out or b not in inside:
            raise PlanError("an edge names an unknown node")
        out[a].append(b)
        inside[b] += 1
    level, ready = {n: 0 for n in nodes}, sorted(n for n in nodes if not inside[n])
    done = 0
    while ready:
        n = ready.pop(0)
        done += 1
        for m in out[n]:
            level[m] = max(level[m], level[n] + 1)
            inside[m] -= 1
            if not inside[m]:
                ready.append(m)
        ready.sort()
    if done < len(nodes):
        raise PlanError("the dependencies form a cycle: " + ", ".join(sorted(n for n in nodes if inside[n])))
    return level


def levels_by_join(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """The same for graphs that are tables: the longest path by joins round after round; more rounds than `most` mean a cycle."""
    now = checkpointed(nodes.select("node", F.lit(0).alias("level")))
    for _ in range(most):
        pushed = edges.join(now, F.col("producer") == F.col("node")).groupBy("consumer").agg((F.max("level") + 1).alias("pushed"))
        new = checkpointed(now.join(pushed, F.col("node") == F.col("consumer"), "left").select("node", F.greatest("level", F.coalesce("pushed", F.lit(0))).alias("level")))
        if new.exceptAll(now).isEmpty():
            return new
        now = new
    raise PlanError("the dependencies form a cycle")


def cover_faults(functions: DataFrame, stages: DataFrame) -> DataFrame:
    """function, fault: unknown, missing or repeated in the stages. functions: function; stages: function, stage."""
    n = stages.groupBy("function").agg(F.count("*").alias("n"))
    both = functions.withColumn("known", F.lit(True)).join(n, "function", "full")
    fault = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select("function", fault.alias("fault")).where(F.col("fault").isNotNull())


def routes(functions: DataFrame) -> DataFrame:
    """domain, route, first_seen, functions; more than one route of a domain is an error row (consistent = false)."""
    return functions.groupBy("domain").agg(F.min("route").alias("route"), F.min("seen").alias("first_seen"), F.count("*").alias("functions"), (F.count_distinct("route") == 1).alias("consistent"))


def rebuild(functions: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Functions of which no cached build has all the same keys."""
    return functions.join(cached.select(*keys).distinct(), keys, "left_anti")


def passes(calls: DataFrame) -> DataFrame:
    """How many encoder, adapter and head passes a set of calls needs when equal work is shared."""
    return calls.agg(F.count_distinct("encoder", "input").alias("encoder_passes"), F.count_distinct("adapter", "input").alias("adapter_passes"), F.count("*").alias("head_passes"))
