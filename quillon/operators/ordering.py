"""Global order without one task for all rows: ranges, sorted each by itself, and the sums of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import checkpointed

#: monotonically_increasing_id: the partition above these bits, the row's place in it below.
PLACE_BITS = 33


def positioned(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """df with `position` (from 1) in the given order, and for each (name, column) of sums the running sum of that column up to
    and with the row. The order should be total. Rows are range-partitioned and sorted once, into the checkpoint folder; what is
    collected is one row for each range."""
    sums = sums or {}
    laid = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    facts = laid.groupBy(part.alias("part")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(k) for k, c in sums.items()]).orderBy("part").collect()
    kinds = {k: laid.schema[c].dataType.simpleString() for k, c in sums.items()}
    kinds = {k: "double" if t in ("double", "float") else "long" for k, t in kinds.items()}
    rows, n, upto = [], 0, {k: 0 for k in sums}
    for r in facts:
        rows.append((r["part"], n, *[float(upto[k]) if kinds[k] == "double" else upto[k] for k in sums]))
        n += r["_n"]
        upto = {k: upto[k] + (r[k] or 0) for k in sums}
    schema = "_part long, _before long" + "".join(f", _before_{k} {kinds[k]}" for k in sums)
    out = laid.withColumn("_part", part).join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), "_part")
    out = out.withColumn("position", F.col("_before") + place + 1)
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"_before_{k}") + F.sum(c).over(within))
    return out.drop("_part", "_before", "_at", *[f"_before_{k}" for k in sums])


def positioned_within(df: DataFrame, groups: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """df with the place (from 1) of each row in its group: its place among all rows, less that of the group's first."""
    ranked = positioned(df, [F.col(g) for g in groups] + order)
    first = ranked.groupBy(*groups).agg(F.min("position").alias("_first"))
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups]
    both = ranked.alias("l").join(first.alias("r"), same)
    return both.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("l.position") - F.col("r._first") + 1).alias(name))
