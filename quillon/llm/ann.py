"""Permutation index for maximum-inner-product search.

Every vector is represented by the order in which it sees a fixed set of
pivots. The index holds, per block of vectors, one inverted file per pivot: the
position that pivot takes in each vector's order. A query reads the files of
its own nearest pivots only, adds up |its position - the vector's position|
(the footrule distance over those pivots), keeps the closest share of each
block and reranks it by the exact inner product of the original vectors.

Files aren't cut after a vector's nearest pivots: on vectors that are spread evenly over
many dimensions (as the given ones) lists so short that a query reads an eighth of all
postings hold at most 0.7 of its 20 nearest, whatever is reranked.

Inner product is turned into a distance by one more coordinate that gives all
vectors the norm of the longest; for unit vectors it is zero throughout. Where
lengths differ, what a vector lacks counts as zero.

Scale: equal vectors are collapsed first (each task passes on the k + 1 smallest ids
only, so a vector that a third of all rows share never meets in one task) and
expanded after the search; of a group of equal vectors no other ids can be among the k
nearest, so keeping those is exact. Blocks of the index (vectors of like length) meet blocks of the
queries by key; neither side is broadcast, and a group holds at most
block_rows + query_rows vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import durable, small, table

#: Rows of one index block and of one query block.
BLOCK_ROWS, QUERY_ROWS = 4096, 4096
#: Pivots, the nearest of them whose files a query reads, share of a block that is reranked.
PIVOTS, READ_FILES, RERANK_SHARE, RERANK_LEAST = 256, 96, 0.08, 128


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of finite components that aren't all zero, the smallest of those under one id. The rest take no part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )
    twice = durable(good.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "ann-repeated")
    n = twice.count()
    if not n:
        return good
    one = good.join(small(twice, n), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return good.join(small(twice, n), "vec_id", "left_anti").unionByName(one)


def padded(rows, width: int | None = None) -> np.ndarray:
    """Vectors as a matrix, as wide as the longest (or cut or filled to a width)."""
    width = max(map(len, rows)) if width is None else width
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : min(width, len(v))] = v[:width]
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows, where what one is longer counts as zero in the other."""
    n = min(x.shape[1], y.shape[1])
    return x[:, :n] @ y[:, :n].T


def pick_pivots(distinct: DataFrame, pivots: int, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """A bounded sample: the vectors with the smallest hashes of their ids; and their last coordinate."""
    x = padded([r["v"] for r in distinct.orderBy(F.xxhash64("rep"), "rep").limit(pivots).select("v").collect()])
    return x, lifted(x, longest)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """The coordinate that gives vectors the norm of the longest."""
    return np.sqrt(np.maximum(0.0, longest**2 - (x * x).sum(1)))


def positions(distances: np.ndarray) -> np.ndarray:
    """Per row: the position (0 nearest) that each pivot takes."""
    order = np.argsort(distances, axis=1, kind="stable")
    out = np.empty_like(order, dtype=np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :].repeat(len(order), 0), 1)
    return out


def search_block(index_ids, x, query_ids, q, pivots, longest, k, read_files, share, least):
    """The k best distinct vectors of one block for each query of one block."""
    spots, last = pivots
    files = np.ascontiguousarray(positions(-(products(x, spots) + np.outer(lifted(x, longest), last))).T)  # pivot -> position in each row's order
    mine = positions(-products(q / np.linalg.norm(q, axis=1, keepdims=True), spots))
    x, q = x[:, : q.shape[1]], q[:, : x.shape[1]]
    take = min(len(x), max(k, least, int(np.ceil(len(x) * share))))
    nearest = np.argsort(mine, axis=1, kind="stable")[:, : min(read_files, mine.shape[1])]
    out_q, out_x, out_s = [], [], []
    for i in range(len(q)):
        if take < len(x):
            footrule = np.zeros(len(x), dtype=np.int32)
            near = nearest[i]
            for lo in range(0, len(near), 32):
                part = files[near[lo : lo + 32]] - np.arange(lo, lo + len(near[lo : lo + 32]), dtype=np.int16)[:, None]
                np.abs(part, out=part)
                footrule += part.sum(0, dtype=np.int16)
            kept = np.argpartition(footrule, take - 1)[:take]
        else:
            kept = np.arange(len(x))
        score = x[kept] @ q[i]
        if len(kept) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            best = score >= edge  # ties at the edge stay: ids decide later
            kept, score = kept[best], score[best]
        order = np.lexsort((index_ids[kept], -score))[:k]
        out_q.append(np.full(len(order), query_ids[i]))
        out_x.append(index_ids[kept][order])
        out_s.append(score[order])
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s)


def nearest(
    rows: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    read_files: int = READ_FILES,
    rerank_share: float = RERANK_SHARE,
    rerank_least: int = RERANK_LEAST,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by inner product for
    every row for which is_query(its id column) holds, its own id excluded.

    Null, zero and non-finite vectors take no part, as query or candidate; what a
    shorter vector lacks counts as zero; an empty table gives an empty result; ties go
    to the smaller id; rows repeated under one id count once, with the smallest of
    their vectors; further columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    good = usable(rows, id_col, vector_col)
    order = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    few = good.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    ids = few.groupBy(F.xxhash64("v").alias("hash"), "v").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    ids = durable(ids.select("v", "members", F.col("members")[0].alias("rep"), F.ceil(F.log2(F.size("v"))).cast("int").alias("kind")), "ann-vectors")
    facts = ids.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    n, longest = facts["n"], facts["longest"] or 1.0
    schema = "query_id long, rep long, score double"
    asked = good.where(is_query(F.col("vec_id")))
    if n:
        chosen = pick_pivots(ids, pivots, longest)
        # blocks of vectors whose lengths lie between the same powers of two
        kinds = {r["kind"]: -(-r["n"] // block_rows) for r in ids.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        blocks, groups = sum(kinds.values()), max(1, -(-asked.count() // query_rows))
        block, before = F.lit(0), 0
        for kind, of_kind in sorted(kinds.items()):
            block = F.when(F.col("kind") == kind, before + F.pmod(F.xxhash64("rep"), F.lit(of_kind))).otherwise(block)
            before += of_kind
        index = ids.select("rep", "v", block.cast("int").alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qb"))
        queries = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("ib"))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "rep": [], "score": []})
            found = search_block(
                left["rep"].to_numpy(), padded(left["v"].to_numpy()), right["vec_id"].to_numpy(), padded(right["v"].to_numpy()),
                chosen, longest, k + 1, read_files, rerank_share, rerank_least,
            )
            return pd.DataFrame(dict(zip(("query_id", "rep", "score"), found, strict=True)))

        found = index.groupBy("ib", "qb").cogroup(queries.groupBy("ib", "qb")).applyInPandas(meet, schema)
    else:
        found = spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query_id", "rep", "score")
    each = top.join(ids.select("rep", F.explode("members").alias("vec_id")), "rep").where(F.col("vec_id") != F.col("query_id"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_permutation_index(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
