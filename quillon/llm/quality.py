"""Quality classification by co-training on two views of a document.

One classifier sees the text alone (shape statistics of characters, words and
lines), the other the page's metadata alone (source, language, stated length).
Each is fitted on a bounded sample of labelled rows; then, for some rounds, each
labels all documents without a label, and those of which it is surest (and which it
hasn't handed over before) are added, with its label, to what the other learns from. Both views are then calibrated on
labelled rows that neither was fitted on, and a last small model weighs the
calibrated logits, so a view that says nothing counts for nothing. All
documents are scored where they are read, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, drawn, durable, fresh, release, small, table
from quillon.llm.fit import Logistic

#: Expected labelled rows that the fit reads, rounds, rows that a view hands over in a round for each class, on average.
LABELLED_ROWS, ROUNDS, HANDED = 6_000, 3, 150
#: Least certainty of a pseudo-label, its weight, parts of the labelled rows (the last one calibrates).
SURE, PSEUDO_WEIGHT, FOLDS = 0.95, 0.3, 4
#: A document is kept from this score on.
KEEP_FROM = 0.5
#: Buckets of the hashed metadata; statistics of a text; the columns of the views.
BUCKETS, N_TEXT = 32, 18
VIEW_NAMES = ("x1", "source", "lang", "stated")
UPPER = np.zeros(256)
UPPER[65:91] = 1
LOWER = np.zeros(256)
LOWER[97:123] = 1
DIGIT = np.zeros(256)
DIGIT[48:58] = 1
SPACE = np.zeros(256)
SPACE[[9, 10, 11, 12, 13, 32]] = 1
HIGH = np.zeros(256)
HIGH[128:] = 1
END = np.zeros(256)
END[[33, 46, 63]] = 1
COMMON = np.zeros(256)
COMMON[[33, 34, 39, 44, 45, 46, 58, 59, 63]] = 1
KINDS = np.stack([UPPER, LOWER, DIGIT, SPACE, HIGH, END, COMMON])


def text_view(text: str) -> list[float]:
    """Shape statistics of a whole text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    hist = np.bincount(data, minlength=256)
    upper, lower, digit, space, high, end, common = KINDS @ hist
    n = max(1, len(data))
    symbols = n - upper - lower - digit - space - high - common
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    top = counts.most_common(1)[0][1] if counts else 0
    letters = max(1.0, upper + lower + high)
    return [
        np.log1p(n), np.log1p(k), (n - space) / k, upper / letters, digit / n, symbols / n, symbols / k, high / n, end / k, hist[33] / k, common / k,
        len(counts) / k, top / k, repeats / k, len(set(lines)) / max(1, len(lines)), k / max(1, len(lines)), float(n < 40), hist[124] / k,
    ]


def bucket(kind: str, value) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % BUCKETS


class CoTrained:
    """The fitted pair of views and what combines them."""

    def __init__(self, text: Logistic, metadata: Logistic, combine: Logistic | None, rate: float):
        self.text, self.metadata, self.combine, self.rate = text, metadata, combine, rate

    def score(self, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(x1), self.rate)
        logits = np.stack([self.text.logit(x1), self.metadata.logit(x2)], 1)
        if self.combine is None:
            return 1.0 / (1.0 + np.exp(-np.clip(logits[:, 0], -35, 35)))
        return self.combine.score(logits)


def fitted(views, y, weights_of, given, fit) -> list[Logistic]:
    """Both views' models, from the labelled rows in `fit` and the pseudo-labelled ones given to each."""
    models = []
    for v in (0, 1):
        x = np.vstack([views[v][fit], given[v][0]])
        labels = np.concatenate([y[fit], given[v][1]])
        models.append(Logistic(penalty=2.0).fit(x, labels, weights_of(int(fit.sum()), len(given[v][1]))))
    return models


def co_train(x1, x2, y, fold, pool, rounds: int = ROUNDS, handed: int = HANDED) -> CoTrained:
    """x1, x2: views of labelled rows; fold FOLDS - 1 only calibrates. pool: an object of which
    surest(models, most, had) gives, for each view, the unlabelled rows that it is surest of, by class."""
    fit = fold != FOLDS - 1
    if not len(y) or len(set(y[fit].tolist())) < 2:
        return CoTrained(None, None, None, float(y.mean()) if len(y) else 1.0)
    base = float(y[fit].mean())
    # hand over in proportion to the classes, so that the rarer one doesn't swell
    most = {1: int(2 * handed * base), 0: int(2 * handed * (1 - base))}
    given = [(np.zeros((0, x1.shape[1])), np.zeros(0)), (np.zeros((0, x2.shape[1])), np.zeros(0))]
    had: tuple[set, set] = (set(), set())
    weights = lambda n, m: np.concatenate([np.ones(n), np.full(m, PSEUDO_WEIGHT)])
    models = fitted((x1, x2), y, weights, given, fit)
    for _ in range(rounds if pool is not None else 0):
        found = pool.surest(models, most, had)
        for v in (0, 1):  # what view v is surest of goes to the other
            ids, labels, one, two = found[v]
            had[v].update(ids)
            x, was = given[1 - v]
            given[1 - v] = np.vstack([x, (two if v == 0 else one)]), np.concatenate([was, labels])
        if not any(len(f[0]) for f in found):
            break
        models = fitted((x1, x2), y, weights, given, fit)
    held = ~fit
    logits = np.stack([models[0].logit(x1), models[1].logit(x2)], 1)
    combine = Logistic(penalty=1.0).fit(logits[held], y[held]) if len(set(y[held].tolist())) == 2 else None
    return CoTrained(models[0], models[1], combine, base)


def metadata_matrix(source: np.ndarray, lang: np.ndarray, stated: np.ndarray) -> np.ndarray:
    """The metadata views: hashed source and language, the stated length, and whether there is none."""
    out = np.zeros((len(source), 2 * BUCKETS + 2))
    every = np.arange(len(source))
    out[every, source] = 1.0
    out[every, BUCKETS + lang] = 1.0
    none = np.isnan(stated)
    out[:, -2], out[:, -1] = np.log1p(np.maximum(0.0, np.where(none, 0.0, stated))), none
    return out


def buckets(kind: str, values: pa.Array) -> list[int]:
    return [bucket(kind, v) for v in values.to_pylist()]


def view_columns(docs: DataFrame) -> list[Column]:
    """What the views read: text, source, lang, stated length; null where docs has no such column."""
    pick = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)
    return [F.col("text"), pick("source", "string"), pick("lang", "string"), pick("n_chars", "double")]


def viewed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Each row's `keep` columns and its two views: the text's statistics, and the metadata in short."""
    from pyspark.sql import types as T

    names = fresh(docs, *VIEW_NAMES)
    fields = [T.StructField(names[0], T.ArrayType(T.DoubleType())), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.IntegerType()), T.StructField(names[3], T.DoubleType())]
    schema = T.StructType([*docs.select(*keep).schema.fields, *fields])
    asked = [c.alias(name) for c, name in zip(view_columns(docs), names, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                text, source, lang, stated = (b.column(len(keep) + i) for i in range(4))
                x1 = pa.array([text_view(t or "") for t in text.to_pylist()], pa.list_(pa.float64()))
                numbers = [pa.array(buckets(kind, values), pa.int32()) for kind, values in (("source", source), ("lang", lang))]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), x1, *numbers, stated], names=schema.names)
        release()

    return docs.select(*keep, *asked).mapInArrow(run, schema)


def matrices(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch whose view columns begin at a place."""
    x1 = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x1, metadata_matrix(batch.column(at + 1).to_numpy(), batch.column(at + 2).to_numpy(), batch.column(at + 3).to_numpy(zero_copy_only=False))


class Unlabelled:
    """All unlabelled documents' views (_id and the view columns), of which each round takes the surest: a histogram of
    certainty tells from where on, so that no task and not the driver sees more than it hands over, and a bucket's ties."""

    STEPS = 2000

    def __init__(self, views: DataFrame):
        self.views = views

    def surest(self, models, most, had):
        steps, names = self.STEPS, self.views.columns

        def certain(batch):
            """(view, label, certainty of each row)"""
            x = matrices(batch, 1)
            for v in (0, 1):
                p = models[v].score(x[v])
                for label in (0, 1):
                    yield v, label, p if label else 1 - p

        def counted(batches):
            sums = np.zeros((2, 2, steps + 1), dtype=np.int64)
            for b in batches:
                fresh_ = [~np.isin(b.column(0).to_numpy(), sorted(had[v])) for v in (0, 1)]
                for v, label, sure in certain(b):
                    sums[v, label] += np.bincount(((sure[fresh_[v] & (sure >= SURE)] - SURE) / (1 - SURE) * steps).astype(int), minlength=steps + 1)
            v, label, step = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(label, pa.int32()), pa.array(step, pa.int32()), pa.array(sums[v, label, step])], names=["v", "label", "step", "n"])

        sums = np.zeros((2, 2, steps + 1), dtype=np.int64)
        for r in self.views.mapInArrow(counted, "v int, label int, step int, n long").groupBy("v", "label", "step").agg(F.sum("n").alias("n")).collect():
            sums[r["v"], r["label"], r["step"]] = r["n"]
        least = np.full((2, 2), 2.0)
        for v in (0, 1):
            for label in (0, 1):
                above = np.cumsum(sums[v, label][::-1])
                if above[-1] and most[label]:
                    least[v, label] = SURE + (1 - SURE) * max(0, steps - int(np.searchsorted(above, most[label]))) / steps

        def chosen(batches):
            for b in batches:
                for v, label, sure in certain(b):
                    ids = b.column(0).to_numpy()
                    use = np.flatnonzero((sure >= max(SURE, least[v, label] - 1e-12)) & ~np.isin(ids, sorted(had[v])))
                    if len(use):
                        part = b.take(pa.array(use))
                        more = [pa.array(np.full(len(use), v), pa.int32()), pa.array(np.full(len(use), label), pa.int32()), pa.array(sure[use])]
                        yield pa.RecordBatch.from_arrays([*more, *part.columns], names=["v", "label", "sure", *names])

        picked = durable(self.views.mapInArrow(chosen, "v int, label int, sure double, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.views.schema)), "quality-handed")
        out = []
        for v in (0, 1):
            rows = [r for label in (0, 1) for r in picked.where((F.col("v") == v) & (F.col("label") == label)).orderBy(F.desc("sure"), F.xxhash64("_id"), "_id").limit(most[label]).collect()]
            x1 = np.array([r[names[1]] for r in rows]).reshape(len(rows), -1) if rows else np.zeros((0, N_TEXT))
            x2 = metadata_matrix(*(np.array([r[n] if r[n] is not None else np.nan for r in rows], dtype=t) for n, t in zip(names[2:], (int, int, float), strict=True)))
            out.append(([r["_id"] for r in rows], np.array([float(r["label"]) for r in rows]), x1, x2))
        discard(picked)
        return out


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("int").alias("_quality"))


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> CoTrained:
    views = durable(viewed(docs, ["doc_id"]), "quality-views")
    model = train_on(views, labels, labelled_rows, rounds)
    discard(views)
    return model


def train_on(views: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> CoTrained:
    """views: what viewed(docs, ["doc_id"]) gives, written. Fitted on about labelled_rows labelled rows, drawn by hash; what the
    views hand to each other comes from all documents without a label."""
    known = durable(known_labels(labels), "quality-labels")
    n = known.count()
    shorts = views.select(F.col(views.columns[0]).cast("long").alias("_id"), *views.columns[1:])
    asked = durable(known.where(drawn("labelled", "_id", labelled_rows, n)), "quality-asked")
    names = shorts.columns
    got = shorts.join(small(asked, asked.count()), "_id").withColumn("_fold", F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(FOLDS))).orderBy("_id", *names[2:]).collect()
    y, fold = np.array([r["_quality"] for r in got], dtype=float), np.array([r["_fold"] for r in got], dtype=int)
    x1 = np.array([r[names[1]] for r in got]).reshape(-1, N_TEXT)
    x2 = metadata_matrix(*(np.array([r[k] if r[k] is not None else np.nan for r in got], dtype=t) for k, t in zip(names[2:], (int, int, float), strict=True)))
    pool = durable(shorts.where("_id is not null").join(small(known.select("_id"), n), "_id", "left_anti"), "quality-pool")
    model = co_train(x1, x2, y, fold, Unlabelled(pool), rounds)
    discard(pool, known, asked)
    return model


def score(docs: DataFrame, model: CoTrained, keep: list[str], name: str = "score") -> DataFrame:
    """Each row's `keep` columns and its score (0 to 1; higher: better).

    A null text is judged as an empty one, a text of any length whole; nulls of source,
    lang and n_chars are values of their own, and columns that don't exist are null
    throughout; with labels of one class (or none) every score is their rate (or 1).
    Repeated rows are judged alike, an empty table stays empty, and no other column is read.
    """
    return scored(viewed(docs, keep), model, name)


def scored(views: DataFrame, model: CoTrained, name: str = "score") -> DataFrame:
    """What viewed() gives, with the views replaced by the score."""
    from pyspark.sql import types as T

    kept_ = views.columns[: -len(VIEW_NAMES)]
    schema = T.StructType([*views.select(*kept_).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept_)], pa.array(model.score(*matrices(b, len(kept_))), pa.float64())], names=schema.names)

    return views.mapInArrow(run, schema)


def scorer(model: CoTrained):
    """A function of view_columns that gives the score."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole in batches:
            out = []
            for lo in range(0, len(whole[0]), 512):
                text, source, lang, stated = (x.slice(lo, 512) for x in whole)
                x1 = np.array([text_view(t or "") for t in text.to_pylist()])
                x2 = metadata_matrix(np.array(buckets("source", source)), np.array(buckets("lang", lang)), stated.to_numpy(zero_copy_only=False))
                out.append(model.score(x1, x2))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
        release()

    return F.arrow_udf(run, "double")


def kept(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents, columns as they are and whatever their names, that score keep_from or more. Python gets what the views
    read, each text once, and gives back scores; the rows themselves stay in Spark."""
    return docs.where(scorer(train(docs, labels))(*view_columns(docs)) >= keep_from)


def op10_quality(spark, sf_dir):
    views = durable(viewed(table(spark, sf_dir, "documents"), ["doc_id"]), "quality-views")
    return scored(views, train_on(views, table(spark, sf_dir, "labels"))).withColumn("keep", F.col("score") >= KEEP_FROM)
