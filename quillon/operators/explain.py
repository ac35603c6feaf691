"""Explaining decisions: nearest examples by mixed distance, shared one-field rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import jaccard_distance, word_set
from quillon.operators import neighbours
from quillon.sources.shared import checkpointed

#: Queries that are sent to every task; candidates of a block where there are more.
MOST_SENT, BLOCK_ROWS = 10_000, 100_000
#: Vectors of a cell, about; cells at most (beyond, they grow); whole numbers that doubles hold exactly.
CELL_ROWS, MOST_CELLS, MOST_WHOLE = 20_000, 2_000, float(1 << 53)


def spreads(df: DataFrame, numbers: list[str]) -> DataFrame:
    """One row: max - min of every number column."""
    return df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in numbers])


def distance(numbers: list[str], texts: list[str], flags: list[str], a: str = "a", b: str = "b", spread: str = "spread") -> Column:
    """Mean over fields of: |difference| / spread capped at one, 1 - Jaccard of word sets, 0 or 1."""
    parts = []
    for c in numbers:
        gap, s = F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")), F.col(f"{spread}.{c}")
        parts.append(F.when(gap == 0, 0.0).when(s > 0, F.least(gap / s, F.lit(1.0))).otherwise(1.0))
    parts += [jaccard_distance(word_set(F.col(f"{a}.{c}")), word_set(F.col(f"{b}.{c}"))) for c in texts]
    parts += [F.when(F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), 0.0).otherwise(1.0) for c in flags]
    return sum(parts[1:], parts[0]) / len(parts)


def nearest(queries: DataFrame, candidates: DataFrame, numbers: list[str], texts: list[str], flags: list[str], k: int, key: str) -> DataFrame:
    """The k nearest candidates of each query (query, neighbour, distance, rank); ties by key. queries is a stated set, searched
    exactly against all candidates: by cells of their vectors, or, where `by_cells` can't (texts, decimals and the like), in pairs."""
    found = by_cells(queries, candidates, numbers, flags, k, key) if not texts else None
    scored = in_pairs(queries, candidates, numbers, texts, flags, key) if found is None else found
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def in_pairs(queries: DataFrame, candidates: DataFrame, numbers: list[str], texts: list[str], flags: list[str], key: str) -> DataFrame:
    """(query, neighbour, distance) of all pairs: while the queries' counted rows are few they are sent to where candidates are
    read; beyond, blocks of queries meet blocks of candidates by key. The work grows with the product of both."""
    span = spreads(candidates, numbers).select(F.struct("*").alias("spread"))
    asked, n = queries.select(F.struct("*").alias("a")), queries.count()
    offered = candidates.select(F.struct("*").alias("b"))
    if n <= MOST_SENT:
        met = offered.crossJoin(F.broadcast(asked))
    else:
        groups, blocks = -(-n // MOST_SENT), max(1, -(-candidates.count() // BLOCK_ROWS))
        asked = asked.withColumn("q", F.pmod(F.xxhash64(f"a.{key}"), F.lit(groups))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        offered = offered.withColumn("c", F.pmod(F.xxhash64(f"b.{key}"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        met = offered.join(asked, ["q", "c"])
    met = met.crossJoin(F.broadcast(span))  # one row
    return met.select(F.col(f"a.{key}").alias("query"), F.col(f"b.{key}").alias("neighbour"), F.round(distance(numbers, texts, flags), 9).alias("distance"))


def by_cells(queries: DataFrame, candidates: DataFrame, numbers: list[str], flags: list[str], k: int, key: str) -> DataFrame | None:
    """(query, neighbour, distance) of k rows of each query at least, the nearest among them; None where a column's type, a null
    key, whole numbers beyond 2^53 or an empty table ask for pairs. Equal vectors are searched for and met once: a vector has its
    k least keys. Each vector goes to the cell of a k-d tree (`neighbours`); a query meets its own cell, then those near enough."""
    kinds, whole = dict(candidates.dtypes) | {f"a.{c}": t for c, t in queries.dtypes}, {"tinyint", "smallint", "int", "bigint"}
    fits = lambda names, types: all(kinds[c] in types and kinds[f"a.{c}"] in types for c in names)
    if not (fits(numbers, whole | {"double"}) and fits(flags, whole | {"string", "boolean", "date"}) and fits([key], whole)):
        return None
    xs, fs = [f"x{i}" for i in range(len(numbers))], [f"f{i}" for i in range(len(flags))]
    vector = [*xs, *fs]
    as_vector = [F.col(c).cast("double").alias(x) for c, x in zip(numbers, xs, strict=True)] + [F.col(c).cast("string").alias(f) for c, f in zip(flags, fs, strict=True)]
    asked = queries.select(F.col(key).alias("query"), *as_vector)
    least = candidates.select(F.col(key).cast("long").alias("key"), *as_vector).withColumn("n", F.row_number().over(Window.partitionBy(*vector).orderBy("key")))
    kept = least.where(F.col("n") <= k).groupBy(*vector).agg(F.array_sort(F.collect_list("key")).alias("keys"), F.count_if(F.col("key").isNull()).alias("nulls"))
    hashes = [F.xxhash64(f).alias(f"h{i}") for i, f in enumerate(fs)]
    offered = checkpointed(kept.select(*vector, *hashes, "keys", "nulls"))
    asked_once = checkpointed(asked.select(*vector).distinct().select(F.monotonically_increasing_id().alias("q"), *vector, *hashes))
    ends = [g(x).alias(f"{n}{x}") for x in xs for n, g in (("lo", F.min), ("hi", F.max))]
    facts = offered.agg(F.count("*").alias("n"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"), *ends).first()
    other = asked_once.agg(F.lit(0), *ends).first()
    far = lambda r, c, x: kinds[c] in whole and r[f"lo{x}"] is not None and max(-r[f"lo{x}"], r[f"hi{x}"]) > MOST_WHOLE
    if not facts["n"] or facts["nulls"] or any(far(r, c, x) for r in (facts, other) for c, x in zip(numbers, xs, strict=True)):
        return None
    space = neighbours.Space([facts[f"hi{x}"] - facts[f"lo{x}"] if facts[f"lo{x}"] is not None else 0.0 for x in xs], len(flags))
    cells = min(MOST_CELLS, -(-facts["n"] // CELL_ROWS))
    tree = neighbours.splits(space, offered.select(*xs, *[f"h{i}" for i in range(len(fs))]), cells, facts["n"])
    offered = checkpointed(offered.drop("nulls").mapInArrow(neighbours.placed(tree, len(xs)), _with(offered.drop("nulls"), "cell int")))
    known = lambda x: F.when(~F.isnan(x), F.col(x))
    edges = [F.min(known(x)).alias(f"lo{x}") for x in xs] + [F.max(known(x)).alias(f"hi{x}") for x in xs]
    edges += [g(f"h{i}").alias(f"{n}h{i}") for n, g in (("lo", F.min), ("hi", F.max)) for i in range(len(fs))]
    boxes = neighbours.boxes_of(offered.groupBy("cell").agg(*edges).collect(), len(xs), len(fs))
    parts = max(2 * cells, 1)
    met = offered.repartition(parts, "cell").groupBy("cell")
    at_home = asked_once.mapInArrow(neighbours.placed(tree, len(xs)), _with(asked_once, "cell int")).withColumn("most", F.lit(None).cast("long"))
    run = neighbours.meeting(space, k)
    first = checkpointed(at_home.repartition(parts, "cell").groupBy("cell").cogroup(met).applyInArrow(run, _with(at_home, "ds array<long>, ks array<long>")))
    more = first.mapInArrow(neighbours.beyond(space, boxes, k), _with(at_home, ""))
    second = more.repartition(parts, "cell").groupBy("cell").cogroup(met).applyInArrow(run, _with(at_home, "ds array<long>, ks array<long>"))
    each = [d.select("q", F.explode(F.arrays_zip("ds", "ks")).alias("x")) for d in (first.select("q", "ds", "ks"), second.select("q", "ds", "ks"))]
    best = each[0].unionByName(each[1]).groupBy("q").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k).alias("near"))  # k entries a cell that came near enough
    near = asked_once.select("q", *[F.col(v).alias(f"_{v}") for v in vector]).join(best, "q")
    same = F.lit(True)
    for v in vector:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    return asked.join(near, same).select("query", F.explode("near").alias("x")).select("query", F.col("x.ks").cast(kinds[key]).alias("neighbour"), (F.col("x.ds") / neighbours.UNIT).alias("distance"))


def _with(df: DataFrame, more: str) -> str:
    """The columns of df, and more, as a schema."""
    return ", ".join([f"{c} {t}" for c, t in df.dtypes] + [more] * bool(more))


def shared_rules(misses: DataFrame, corpus: DataFrame, fields: list[str], label: str, required: str) -> DataFrame:
    """path, value, misses, support: one-field equalities that hold on every miss, and that no row of the
    corpus with another label contradicts. Candidates come from the misses; the corpus is aggregated per (path, value)."""
    def long(df: DataFrame) -> DataFrame:
        return df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(label, "x.*")

    total = misses.agg(F.count("*").alias("total"))
    held = long(misses).groupBy("path", "value").agg(F.count("*").alias("misses")).crossJoin(F.broadcast(total)).where("misses = total").drop("total")
    seen = long(corpus).groupBy("path", "value").agg(F.count_if(F.col(label) == required).alias("support"), F.count_if(F.col(label) != required).alias("against"))
    return held.join(seen, ["path", "value"], "left").where(F.coalesce("against", F.lit(0)) == 0).select("path", "value", "misses", F.coalesce("support", F.lit(0)).alias("support"))
