"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, report, other; the
lexicons behind them are short general lists, plus words and stems (beginnings
of words) learned from labelled rows wherever their part in toxic texts is
significant over the number of terms tried. Three transducers are composed:

  scope     reads symbols and tells which stand in the scope of a negation
            (within a few words after it);
  speech    tells which are reported speech (after a verb of saying, until the
            clause ends);
  pattern   weighs what is left: an insult or threat scores its lexical weight,
            more beside a target, less under negation or in reported speech.

The composed machine runs over a clause at a time, and a text's features are
its matched clauses: summed and largest weight, their number and share, how
many stand outside negation and reports. A logistic model fitted on labelled rows
turns them into a probability. Texts are scored where they are read; nothing
is shuffled but the counts of terms in the bounded training sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import crc32_mod, drawn, durable, small, table
from quillon.llm.fit import Logistic

#: Expected labelled rows that the fit reads, rows that a learned term must stand in.
TRAINING_ROWS, LEAST_ROWS = 20_000, 4
#: Lengths of stems that are tried.
STEMS = (3, 4, 5, 6)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: General lexicons; fixed values.
GENERAL = {
    INSULT: "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown dumb ugly filth vermin imbecile fool coward bastard jerk creep",
    THREAT: "kill hurt destroy murder beat shoot stab burn hang attack smash crush punish",
    TARGET: "you your yours u ur he him his she her they them their these those people everyone nobody women men immigrants",
    NEGATION: "not no never neither nor without none isn aren wasn don doesn didn won can't cannot nicht kein keine nie pas jamais ne no nunca tampoco sin",
    REPORT: "said says say saying told tells claimed claims wrote writes reported reports quoted quotes called according alleged stated sagte dit dijo",
}
#: Weight of a general insult or threat that was not learned.
GENERAL_WEIGHT = {INSULT: 2.0, THREAT: 1.0}
NEGATED, REPORTED, AIMED, NEGATION_SCOPE, TARGET_SCOPE = 0.3, 0.4, 1.5, 3, 4
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
N_FEATURES = 7


class Transducer:
    """Deterministic and weighted: arcs[(state, symbol)] = (next state, output, weight); weights multiply along a path."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def compose(self, other: Transducer) -> Transducer:
        """Reads what self reads, writes what other writes of self's output."""
        arcs, todo, done = {}, [(self.start, other.start)], set()
        symbols = {s for _, s in self.arcs}
        while todo:
            pair = todo.pop()
            if pair in done:
                continue
            done.add(pair)
            for symbol in symbols:
                if (pair[0], symbol) not in self.arcs:
                    continue
                a, middle, w = self.arcs[pair[0], symbol]
                if (pair[1], middle) not in other.arcs:
                    continue
                b, out, v = other.arcs[pair[1], middle]
                arcs[pair, symbol] = ((a, b), out, w * v)
                todo.append((a, b))
        return Transducer((self.start, other.start), arcs)

    def numbered(self) -> dict:
        """The same machine with states 0, 1, ... (0 the start)."""
        names: dict = {self.start: 0}
        for (state, _), (to, _, _) in self.arcs.items():
            names.setdefault(state, len(names))
            names.setdefault(to, len(names))
        return {(names[s], x): (names[t], out, w) for (s, x), (t, out, w) in self.arcs.items()}


def scope() -> Transducer:
    """Writes (symbol, negated?): what follows a negation within its scope is negated."""
    arcs = {}
    for left in range(NEGATION_SCOPE + 1):
        for x in range(6):
            arcs[left, x] = (NEGATION_SCOPE if x == NEGATION else max(0, left - 1), (x, left > 0), NEGATED if left > 0 and x in (INSULT, THREAT) else 1.0)
    return Transducer(0, arcs)


def speech() -> Transducer:
    """Reads (symbol, negated?) and writes (symbol, negated?, reported?): after a verb of saying, all of the clause is reported."""
    arcs = {}
    for inside in (False, True):
        for x in range(6):
            for negated in (False, True):
                arcs[inside, (x, negated)] = (inside or x == REPORT, (x, negated, inside), REPORTED if inside and x in (INSULT, THREAT) else 1.0)
    return Transducer(False, arcs)


def pattern() -> Transducer:
    """Reads (symbol, negated?, reported?) and writes whether a match ends here and if it is plain; more weight near a target."""
    arcs = {}
    for near in range(TARGET_SCOPE + 1):
        for x in range(6):
            for negated in (False, True):
                for reported in (False, True):
                    hit = x in (INSULT, THREAT)
                    to = TARGET_SCOPE if x == TARGET else max(0, near - 1)
                    arcs[near, (x, negated, reported)] = (to, (1 if hit else 0) + (1 if hit and not negated and not reported else 0), AIMED if hit and near > 0 else 1.0)
    return Transducer(0, arcs)


def machine() -> dict:
    return scope().compose(speech()).compose(pattern()).numbered()


class Grammar:
    """Texts -> features of their matched clauses. lexicon: word or stem* -> learned weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.arcs = machine()
        self.symbol: dict[str, tuple[int, float]] = {}
        for kind in (REPORT, NEGATION, TARGET, THREAT, INSULT):
            for w in GENERAL[kind].split():
                self.symbol[w] = (kind, GENERAL_WEIGHT.get(kind, 0.0))
        self.learned = lexicon
        self.kept: dict[str, tuple[int, float] | None] = {}

    def read(self, word: str) -> tuple[int, float] | None:
        """The symbol and lexical weight of a word; None for others."""
        got, weight = self.symbol.get(word), self.learned.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                weight = max(weight, self.learned.get(word[:n] + "*", 0.0))
        if weight > 0 and (not got or got[0] in (INSULT, THREAT)):
            return (got[0] if got else INSULT, max(weight, got[1] if got else 0.0))
        return got

    def features(self, text: str) -> list[float]:
        tokens = TOKEN.findall(text.lower())
        kept = self.kept
        new = set(tokens).difference(kept)
        if new:
            if len(kept) > 400_000:
                kept.clear()
                new = set(tokens)
            for w in new:
                kept[w] = self.read(w)
        marks = [(i, m) for i, m in enumerate(map(kept.__getitem__, tokens)) if m]
        log_n = math.log1p(len(tokens))
        if not any(m[0] in (INSULT, THREAT) for _, m in marks):
            return [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, log_n]
        total = most = 0.0
        matched = plain = hits = 0
        at, n = 0, len(tokens)
        ends = [i for i, t in enumerate(tokens) if not t[0].isalpha()] + [n]
        k = 0
        for end in ends:
            first = k
            while k < len(marks) and marks[k][0] < end:
                k += 1
            if any(m[0] in (INSULT, THREAT) for _, m in marks[first:k]):
                score, n_hits, n_plain = self.clause(tokens, at, end)
                total += score
                most = max(most, score)
                matched += 1
                plain += n_plain > 0
                hits += n_hits
            at = end + 1
        return [total, most, float(matched), float(plain), float(hits), 100.0 * hits / max(1, n), log_n]

    def clause(self, tokens: list[str], lo: int, hi: int) -> tuple[float, int, int]:
        state, score, hits, plain = 0, 0.0, 0, 0
        path = 1.0
        for w in tokens[lo:hi]:
            mark = self.kept.get(w)
            state, out, factor = self.arcs[state, mark[0] if mark else OTHER]
            if out:
                score += path * factor * mark[1]
                hits += 1
                plain += out == 2
        return score, hits, plain


def learned_terms(sample: DataFrame) -> dict[str, float]:
    """Words and stems whose share of toxic rows is significantly above the rest. sample: text, toxic (0 or 1)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = [F.transform(F.filter("ws", _longer(n)), _stem(n)) for n in STEMS]
    terms = sample.withColumn("ws", words).select("toxic", F.explode(F.array_distinct(F.concat("ws", *stems))).alias("term"))
    per = terms.groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    per = durable(per.where(F.col("n") >= LEAST_ROWS), "toxic-terms")
    rows = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("a")).first()
    n, a_all, tried = rows["n"], rows["a"] or 0, per.count()
    if not n or not a_all or a_all == n or not tried:
        return {}
    base = a_all / n
    a, m = F.col("a").cast("double"), F.col("n").cast("double")
    part = lambda k, share: F.when(k > 0, k * F.ln(k / (m * share))).otherwise(0.0)
    g2 = 2 * (part(a, base) + part(m - a, 1 - base))
    weight = F.ln((a + 0.5) / (a_all + 1)) - F.ln((m - a + 0.5) / (n - a_all + 1))
    kept = per.select("term", g2.alias("g2"), weight.alias("w")).where((F.col("w") > 1.5) & (F.col("g2") > 2 * math.log(2 * tried)))
    return {r["term"]: float(r["w"]) for r in kept.orderBy(F.desc("g2"), "term").collect()}  # of a bounded sample


def _longer(n: int):
    return lambda w: F.length(w) > n


def _stem(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def featured(docs: DataFrame, lexicon: dict[str, float], keep: list[str], to) -> DataFrame:
    """Each row's `keep` columns and to(features matrix) as further columns; to gives (schema fields, function)."""
    from pyspark.sql import types as T

    fields, make = to
    schema = T.StructType([*docs.select(*keep).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                x = np.array([grammar.features(t or "") for t in b.column(len(keep)).to_pylist()]).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *make(x)], names=[f.name for f in schema.fields])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, toxic): about so many labelled rows, by the hash of doc_id."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    chosen = durable(known.where(drawn("toxicity", "doc_id", rows, n)), "toxic-ids")
    # about `rows` ids: sent to where documents are read, so that no text is shuffled
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(small(chosen, chosen.count()), "doc_id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS):
    """(lexicon, model); the model is None where the labels name fewer than two classes."""
    from pyspark.sql import types as T

    sample = durable(training_sample(docs, labels, rows), "toxic-sample")
    lexicon = learned_terms(sample)
    field = [T.StructField("x", T.ArrayType(T.DoubleType()))]
    got = featured(sample, lexicon, ["toxic"], (field, lambda x: [pa.array(x.tolist(), pa.list_(pa.float64()))])).collect()
    x, y = np.array([r["x"] for r in got]).reshape(-1, N_FEATURES), np.array([r["toxic"] for r in got], dtype=float)
    return lexicon, Logistic().fit(shaped(x), y) if 0 < y.sum() < len(y) else None


def shaped(x: np.ndarray) -> np.ndarray:
    """Features for the model: logarithms of the open-ended ones, and whether anything matched."""
    return np.hstack([np.log1p(x[:, :5]), np.log1p(x[:, 5:6]), (x[:, 2:3] > 0).astype(float), (x[:, 3:4] > 0).astype(float)])


def score(docs: DataFrame, lexicon: dict[str, float], model: Logistic | None, keep: list[str]) -> DataFrame:
    """Each row's `keep` columns, score (0 to 1) and predicted (1 from 0.5 on).

    A null or empty text is scored as one without matches, a text of any length
    clause by clause, whole; without a model every score is 0; an empty table gives
    an empty result. Repeated rows are scored alike, and no other column is read, so
    clashing names are only those of `keep` with score and predicted.
    """
    from pyspark.sql import types as T

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make(x):
        s = model.score(shaped(x)) if model else np.zeros(len(x))
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return featured(docs, lexicon, keep, (fields, make))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc32_mod(F.col("doc_id"), 5) == 0)
    labels = table(spark, sf_dir, "labels")
    lexicon, model = train(docs.where(~F.col("held_out")), labels.where(crc32_mod(F.col("doc_id"), 5) != 0))
    return score(docs.select("doc_id", "held_out", "text"), lexicon, model, ["doc_id", "held_out"])
