"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document long, so the Jaccard similarity of the two
says little; what counts is the share of the item's shingles that the document
holds. Items are partitioned by the size of their shingle set. An item of q
shingles is signed by its bottom-k MinHash values with k = floor(q (1 - c)) + 1:
a document that holds the share c of the item lacks at most k - 1 of its
shingles, so it holds one of these k. A document meets the partitions of the sizes
that it can hold: these have a cut in the hash space, the largest of their items'
signatures, and a bitmap of the signatures' low bits, and the document is sketched by
its shingle hashes up to the cut whose bit is set. A hash that both sketches hold makes a
candidate, which is verified by exact containment of the shingle strings.

DataFrame functions only. Documents are never shuffled while the signatures
and the candidates are within the stated bounds (then they are broadcast);
beyond them the same joins go by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, fresh, small, table
from quillon.llm.text import SHINGLE, words

#: Least share of an item's shingles, in hundredths.
CONTAINED = 75
#: Bits of a partition's bitmap for each signature, and the least and greatest bitmap, as powers of two (1 MB; a row for each power of two of sizes).
BITMAP_BITS, BITMAP_LEAST, BITMAP_MOST = 16, 12, 23


def hashes(ws: Column) -> Column:
    """The hashes of the shingles of an array of words, one for each place."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - (SHINGLE - 1)))
    each = F.transform(places, lambda i: F.xxhash64(*[F.get(ws, i + (k - 1)) for k in range(SHINGLE)]))
    return F.when(F.size(ws) > 0, each).otherwise(F.array().cast("array<long>"))


def shingles(ws: Column) -> Column:
    """The distinct shingles as texts."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - (SHINGLE - 1)))
    each = F.transform(places, lambda i: F.concat_ws(" ", F.slice(ws, i, F.lit(SHINGLE))))
    return F.array_distinct(F.when(F.size(ws) > 0, each).otherwise(F.array().cast("array<string>")))


def signatures(items: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """(item_id, n, size_class, h): the bottom-k hashes of each item."""
    sets = items.select("item_id", F.array_distinct(hashes(words(F.col("text")))).alias("hs")).withColumn("n", F.size("hs")).where("n > 0")
    k = F.floor(F.col("n") * (100 - contained) / 100) + 1
    return sets.select("item_id", "n", F.floor(F.log2("n")).cast("int").alias("size_class"), F.explode(F.slice(F.array_sort("hs"), F.lit(1), k.cast("int"))).alias("h"))


def own_print(docs: DataFrame) -> Column:
    """What tells rows without a doc_id apart: their text's fingerprint; null where there is a doc_id."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def partitions(signed: DataFrame, n_signed: int) -> tuple[DataFrame, list[int]]:
    """(rank, cut, bitmap) for each size class: of the signatures of the items up to that class; and the classes' least sizes, in order."""
    power = min(BITMAP_MOST, max(BITMAP_LEAST, (n_signed * BITMAP_BITS).bit_length()))
    words = 1 << (power - 6)
    facts = signed.groupBy("size_class").agg(F.min("n").alias("least")).orderBy("size_class").collect()  # a row for each power of two
    if not facts:
        return signed.select(F.lit(1).alias("rank"), F.col("h").alias("cut"), F.array("h").alias("bitmap")), []
    ranks = F.array(*[F.lit(r["size_class"]) for r in facts])
    upto = signed.select("h", F.explode(F.sequence(F.array_position(ranks, F.col("size_class")).cast("int"), F.lit(len(facts)))).alias("rank"))
    low = F.col("h").bitwiseAND(F.lit((1 << power) - 1))
    each = upto.groupBy("rank", F.shiftright(low, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"), F.max("h").alias("cut"))
    spread = each.groupBy("rank").agg(F.max("cut").alias("cut"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("set"))
    # the words between those that are set are zero
    gaps = F.transform("set", lambda s, i: F.concat(F.array_repeat(F.lit(0).cast("long"), s["word"] - F.when(i > 0, F.get(F.col("set"), i - 1)["word"] + 1).otherwise(0)), F.array(s["bits"])))
    last = F.array_repeat(F.lit(0).cast("long"), F.lit(words - 1) - F.element_at("set", -1)["word"])
    return spread.select("rank", "cut", F.concat(F.flatten(gaps), last).alias("bitmap")), [r["least"] for r in facts]


def holding(docs: DataFrame, items: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """doc_id, own (see own_print), item_id, n_item, shared: rows and the items they hold, repeated for repeated ids."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    signed = durable(signatures(items, contained), "leak-signatures")
    n_signed = signed.count()
    parts, least = partitions(signed, n_signed)
    parts = durable(parts, "leak-partitions")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own_print(docs).alias("own")).withColumn("ws", words(F.col("text")))
    size = F.greatest(F.lit(1), F.size("ws") - (SHINGLE - 1))
    rank = F.lit(0)
    for i, n in enumerate(least):  # the last partition whose smallest items the document can hold
        rank = F.when(size * 100 >= n * contained, F.lit(i + 1)).otherwise(rank)
    bit = lambda h: F.getbit(F.get(F.col("bitmap"), F.shiftright(h.bitwiseAND(F.size("bitmap") * 64 - 1), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    met = slim.withColumn("rank", rank).join(F.broadcast(parts), "rank")  # a row for each power of two
    sketch = met.select("doc_id", "own", size.alias("m"), F.explode(F.filter(hashes(F.col("ws")), lambda h: (h <= F.col("cut")) & bit(h))).alias("h"))
    found = sketch.join(small(signed, n_signed), "h").where(F.col("m") * 100 >= F.col("n") * contained)
    found = durable(found.select("doc_id", "own", "item_id").distinct(), "leak-candidates")
    n_found = found.count()
    texts = items.select("item_id", shingles(words(F.col("text"))).alias("item_set"))
    # only ids are broadcast; the few documents that stay then meet their candidates by key
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("own").eqNullSafe(F.col("o"))
    ids = found.select(F.col("doc_id").alias("d"), F.col("own").alias("o")).distinct()
    chosen = slim.join(small(ids, n_found), same, "left_semi").withColumn("doc_set", shingles(F.col("ws")))
    asked = found.select(F.col("doc_id").alias("d"), F.col("own").alias("o"), F.col("item_id").alias("i"))
    held = chosen.select("doc_id", "own", "doc_set").join(asked, same).join(small(texts, n_signed, 50_000), F.col("i").eqNullSafe(F.col("item_id")))
    held = held.select("doc_id", "own", "doc_set", F.struct("item_id", "item_set").alias("item"))
    counted = held.select("doc_id", "own", F.col("item.item_id").alias("item_id"), F.size("item.item_set").cast("long").alias("n_item"), F.size(F.array_intersect("item.item_set", "doc_set")).cast("long").alias("shared"))
    return counted.where(F.col("shared") * 100 >= F.col("n_item") * contained)


def leaks(docs: DataFrame, items: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_item, shared, containment: every document and item that it holds.

    Null texts are empty, and empty texts hold nothing and are held by nothing; an
    item of fewer than five words is one shingle, its whole sequence, and is held by
    documents of just these words. Items repeated under one item_id, or documents
    under one doc_id, are reported once if any of them matches, with the most
    shared shingles; a null id stays null. Empty tables give an empty result.
    """
    best = holding(docs, items, contained).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_item", "shared"), "shared").alias("m"))
    return best.select("doc_id", "item_id", "m.n_item", "m.shared", F.round(F.col("m.shared") / F.col("m.n_item"), 6).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """The documents, all columns as they are and whatever their names, that hold no item. Rows under one doc_id are one document
    and go together; a row whose doc_id is null is a document of its own and goes only if its own text holds one. Texts of any
    length are searched whole; without documents or items the documents come back as they are."""
    id_, own_ = fresh(docs, "id", "own")
    found = durable(holding(docs, items, contained).select(F.col("doc_id").alias(id_), F.col("own").alias(own_)).distinct(), "leak-documents")
    return docs.join(small(found, found.count()), F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & own_print(docs).eqNullSafe(F.col(own_)), "left_anti")


def op6_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = """
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM documents),
     iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM dw WHERE len(ws) > 0)),
     si AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM iw WHERE len(ws) > 0)),
     n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id),
     m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN si USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, shared, round(shared / n_item, 6) AS containment FROM m JOIN n USING (item_id) WHERE shared * 100 >= n_item * 75
"""
