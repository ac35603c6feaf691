"""Dataset algebra: unions, exclusion, deduplication, groups, splits, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordering import positioned, positioned_within
from quillon.sources.shared import checkpointed


def union_all(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Rows of every part with its origin, columns by name."""
    out = None
    for origin, df in parts:
        tagged = df.withColumn("origin", F.lit(origin))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def exclude(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_anti")


def first_of_each(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows that share a key the first. By min_by with partial aggregation, so a hot key meets no single task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def funnel(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """reason, n: for each row the first reason that holds, or kept."""
    reason = F.lit("kept")
    for name, holds in reversed(reasons):
        reason = F.when(holds, name).otherwise(reason)
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label."""
    return df.groupBy(key).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("rows")).where("labels > 1")


def merged_groups(rows: DataFrame, key: str, group: str, checkpoint=None) -> DataFrame:
    """group, root: groups that share an input key become one, named by their smallest id.
    Labels shrink by a join and a minimum until none changes; checkpoint (a frame to
    the same frame, cut from its lineage) runs each round, by default into the session's checkpoint folder."""
    cut = checkpoint or checkpointed
    member = rows.select(F.col(group).alias("g"), F.col(key).alias("k")).distinct()
    links = cut(member)
    now = cut(member.select("g").distinct().withColumn("root", F.col("g")))
    while True:
        least = links.join(now, "g").groupBy("k").agg(F.min("root").alias("m"))
        new = cut(links.join(least, "k").groupBy("g").agg(F.min("m").alias("root")))
        if new.exceptAll(now).isEmpty():
            return new.select(F.col("g").alias(group), "root")
        now = new


def held_out_groups(groups: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """group, evaluation: whole groups by the rank of their seeded digest, the prefix of ranks whose
    rows come nearest the target (ties: fewer groups); groups with gold rows always train.
    groups: group (text), n, gold."""
    key = F.sha2(F.concat(F.unhex(F.lit(f"{seed:016x}")), F.unhex(F.lit("00")), F.col("group").cast("binary")), 256)
    totals = groups.agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.max("gold").alias("any_gold"))
    free = groups.where(~F.col("gold")).withColumn("key", key)
    ranked = positioned(free.select("group", "n", "key"), [F.col("key"), F.col("group")], {"upto": "n"})
    ranked = ranked.crossJoin(F.broadcast(free.agg(F.count("*").alias("free")))).select("group", "n", F.col("position").alias("rank"), "upto", "free")
    target = F.greatest(F.lit(1), F.least(F.col("rows") - 1, F.floor(F.col("rows") * ratio + 0.5)))
    open_ = ranked.crossJoin(F.broadcast(totals)).where((F.col("groups") >= 2) & (F.col("rank") <= F.when(F.col("any_gold"), F.col("free")).otherwise(F.col("free") - 1)))
    best = open_.agg(F.min(F.struct(F.abs(F.col("upto") - target).alias("gap"), F.col("rank"))).alias("b")).select(F.col("b.rank").alias("chosen"))
    picked = ranked.crossJoin(F.broadcast(best)).where(F.col("rank") <= F.col("chosen")).select("group", F.lit(True).alias("evaluation"))
    return groups.join(picked, "group", "left").select("group", F.coalesce("evaluation", F.lit(False)).alias("evaluation"))


def top_by_digest(df: DataFrame, digest: str, ratio: float) -> DataFrame:
    """The floor(n ratio + 1/2) rows with the smallest digests."""
    total = df.agg(F.floor(F.count("*") * ratio + 0.5).alias("keep"))
    ranked = positioned(df, [F.col(digest)]).withColumn("rank", F.col("position").cast("int")).drop("position")
    return ranked.crossJoin(F.broadcast(total)).where("rank <= keep").drop("keep")


def stratified(df: DataFrame, strata: list[str], order: list[str], quota: int) -> DataFrame:
    """Up to quota rows of every stratum, by key order."""
    w = Window.partitionBy(*strata).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quota)


def stratified_with_fallback(df: DataFrame, bucket: str, tier: str, order: list[str], quota: int) -> DataFrame:
    """quota rows of each (bucket, tier); a tier that falls short is filled up from the bucket's
    remaining rows of other tiers, in key order. Two windowed passes instead of a sequential scan."""
    first = df.withColumn("rn", F.row_number().over(Window.partitionBy(bucket, tier).orderBy(*order)))
    own, spare = first.where(F.col("rn") <= quota).withColumn("filled", F.lit(False)), first.where(F.col("rn") > quota)
    tiers = df.select(tier).distinct()
    short = df.select(bucket).distinct().crossJoin(tiers).join(own.groupBy(bucket, tier).count(), [bucket, tier], "left")
    need = short.groupBy(bucket).agg(F.sum(F.lit(quota) - F.coalesce("count", F.lit(0))).alias("need"))
    fill = spare.withColumn("rn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).join(need, bucket).where("rn <= need")
    return own.unionByName(fill.drop("need").withColumn("filled", F.lit(True)))


def interleaved(df: DataFrame, queue: str, order: list[str]) -> DataFrame:
    """Round robin over queues: turn and queue order the rows. A long queue is ranked in ranges, not in one task."""
    return positioned_within(df, [queue], [F.col(c) for c in order], "turn")


def shuffled_batches(df: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """position, batch: a seeded order by digest, in batches."""
    order = [F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), F.col(key)]
    return positioned(df, order).withColumn("position", F.col("position").cast("int")).withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def coverage(cases: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """kind, n: how many keys are matched, only cases, only predictions, or repeated on a side."""
    a, b = cases.groupBy(key).agg(F.count("*").alias("n_a")), predictions.groupBy(key).agg(F.count("*").alias("n_b"))
    kind = F.when(F.col("n_b").isNull(), "missing").when(F.col("n_a").isNull(), "unknown").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "repeated").otherwise("matched")
    return a.join(b, key, "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def upserted(table: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The last writer of every key wins, the table's rows counting as oldest."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key and c != "_new"]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_new", version)).alias("_r")).select(*key, "_r.*")


def quota_held_out(boundary: DataFrame, interior: DataFrame, uniform: DataFrame, known: DataFrame, key: str, quotas: tuple[int, int, int]) -> DataFrame:
    """A sample of three generators up to their quotas, distinct and disjoint from what is known."""
    parts = union_all(("boundary", boundary), ("interior", interior), ("uniform", uniform))
    fresh = first_of_each(exclude(parts, known, key), [key], [F.when(F.col("origin") == "boundary", 0).when(F.col("origin") == "interior", 1).otherwise(2)])
    ranked = fresh.withColumn("rn", F.row_number().over(Window.partitionBy("origin").orderBy(key)))
    most = F.when(F.col("origin") == "boundary", quotas[0]).when(F.col("origin") == "interior", quotas[1]).otherwise(quotas[2])
    return ranked.where(F.col("rn") <= most).drop("rn")
