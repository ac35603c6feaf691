"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum, over every way to cut it into pieces, of the
product of their probabilities; a forward pass over the word's positions adds
them all up. A text scores the sum of its words' logarithms, and the language
with the highest sum (equal prior for all) wins.

Piece probabilities are fitted by expectation maximisation (forward-backward
over each distinct word, weighted by its count in the language) from a bounded
sample of labelled rows; texts are then scored where they are read, without a
shuffle. One pass of an automaton over a batch's words finds every piece in
them; words of any length are scored whole, in scaled numbers, and remembered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import crc32_mod, durable, small, table

#: Expected rows of each language that the fit reads; rounds of the fit.
ROWS_PER_LANGUAGE, ROUNDS = 200, 3
SMOOTHING, UNKNOWN = 0.02, 1e-7
#: Words remembered; characters of words scored at once; steps between rescalings.
CACHE_WORDS, CHARACTERS, RESCALE = 300_000, 400_000, 16
#: Characters of a piece at most; a vocabulary with longer ones is refused.
LONGEST_PIECE = 1023
WORD = re.compile(r"[^\W\d_]+")
MARK = "\u2581"


def words_of(text: str) -> list[str]:
    """The words of a text: runs of letters, in lower case."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # what else counts as part of a word for the pattern (fractions, superscripts, numbers in circles) is no letter
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


class Pieces:
    """The vocabulary: piece text -> number. 0 stands for no piece; a character
    that is no piece counts as one of small, fixed probability."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kept = [found.id_to_piece(i) for i in range(found.get_piece_size()) if not (found.is_byte(i) or found.is_control(i) or found.is_unknown(i))]
        kept = [p for p in kept if p and p.strip(MARK) and "\n" not in p]
        self.number = {p: i + 2 for i, p in enumerate(dict.fromkeys(kept))}
        self.size = len(self.number) + 2  # 1: a character outside the vocabulary
        self.longest = max(map(len, self.number), default=1)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.number.items():
            self.automaton.add_word(p, i * (LONGEST_PIECE + 1) + len(p))
        if self.longest > LONGEST_PIECE:
            raise ValueError(f"a piece of more than {LONGEST_PIECE} characters")
        self.automaton.make_automaton()

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(words, self)


class Lattice:
    """All pieces in some words. The words stand in one line of characters, each followed by one
    more: so node i is where character i begins, a word's last node is that of the character after it, and a piece leads from node to node."""

    def __init__(self, words: list[str], pieces: Pieces):
        line = "\n".join([*words, ""])
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.nodes = len(line)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.ends = self.starts + self.lengths
        self.longest = pieces.longest
        found = np.fromiter(chain.from_iterable(pieces.automaton.iter(line)), dtype=np.int64).reshape(-1, 2)
        to, size, number = found[:, 0] + 1, found[:, 1] % (LONGEST_PIECE + 1), found[:, 1] // (LONGEST_PIECE + 1)
        alone = np.zeros(self.nodes + 1, dtype=bool)
        alone[to[size == 1]] = True
        alone[self.starts] = True  # no piece ends where a word starts
        strange = np.flatnonzero(~alone[: self.nodes])
        to, number = np.concatenate([to, strange]), np.concatenate([number, np.ones(len(strange), np.int64)])
        size = np.concatenate([size, np.ones(len(strange), np.int64)])
        self.word = np.searchsorted(self.starts, to, side="right") - 1
        step = to - self.starts[self.word]
        order = np.lexsort((to, step))
        self.to, self.number, self.word, step = to[order], number[order], self.word[order], step[order]
        self.origin = self.to - size[order]
        self.steps = np.searchsorted(step, np.arange(1, int(self.lengths.max(initial=0)) + 2))

    def forward(self, probability: np.ndarray, scaled: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The sum over all segmentations up to each node [nodes, languages], and logarithms to add to a word's [words, languages]."""
        alpha, logs = np.zeros((self.nodes, probability.shape[1])), np.zeros((len(self.starts), probability.shape[1]))
        alpha[self.starts] = 1.0
        for step, (lo, hi) in enumerate(zip(self.steps[:-1], self.steps[1:], strict=True), 1):
            to = self.to[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            alpha[to[first]] = np.add.reduceat(alpha[self.origin[lo:hi]] * probability[self.number[lo:hi]], first, axis=0)
            if scaled and step % RESCALE == 0:
                on = np.flatnonzero(self.lengths > step)
                at = self.starts[on] + step
                by = alpha[at]
                logs[on] += np.log(by)
                for back in range(min(step, self.longest)):
                    alpha[at - back] /= by
        return alpha, logs

    def sums(self, probability: np.ndarray) -> np.ndarray:
        """[words, languages]: the logarithm of the sum over all segmentations of each word."""
        alpha, logs = self.forward(probability, scaled=True)
        return np.log(alpha[self.ends]) + logs

    def used(self, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is expected in each word's segmentations, times the word's weight. A word so improbable that
        its probability isn't a number any more adds nothing."""
        alpha, _ = self.forward(probability)
        beta = np.zeros_like(alpha)
        beta[self.ends] = np.where(alpha[self.ends] > 0, weight / np.maximum(alpha[self.ends], 1e-300), 0.0)
        out = np.zeros((len(self.to), probability.shape[1]))
        for lo, hi in zip(self.steps[-2::-1], self.steps[:0:-1], strict=True):
            behind = probability[self.number[lo:hi]] * beta[self.to[lo:hi]]
            out[lo:hi] = alpha[self.origin[lo:hi]] * behind
            np.add.at(beta, self.origin[lo:hi], behind)
        return out


def forward(lattice: Lattice, probability: np.ndarray) -> np.ndarray:
    """[words, length + 1, languages] for words of one length: the sum over all segmentations up to each position."""
    alpha, _ = lattice.forward(probability)
    return alpha.reshape(len(lattice.starts), -1, probability.shape[1])


def in_lots(words: list[str], most: int = CHARACTERS) -> Iterator[list[int]]:
    """The words' numbers, shorter words first, in lots of about so many characters."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    lot = np.cumsum(lengths[order] + 2) // most
    for at in np.split(order, np.flatnonzero(np.diff(lot)) + 1):
        if len(at):
            yield at.tolist()


def fit(counted: list[tuple[str, str, int]], languages: list[str], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """[pieces, languages] probabilities from (language, word, count)."""
    column = {lang: i for i, lang in enumerate(languages)}
    weight: dict[str, np.ndarray] = {}
    for lang, word, n in counted:
        weight.setdefault(word, np.zeros(len(languages)))[column[lang]] += n
    words = list(weight)
    lots = [(pieces.lattice([MARK + words[i] for i in at]), np.array([weight[words[i]] for i in at])) for at in in_lots(words)]

    def summed(parts) -> np.ndarray:
        expected = np.zeros((pieces.size, len(languages)))
        for number, used in parts:
            for c in range(len(languages)):
                expected[:, c] += np.bincount(number, used[:, c], pieces.size)
        return normal(expected)

    probability = summed((x.number, w[x.word]) for x, w in lots)  # the start: how often each piece could be used
    for _ in range(rounds):
        probability = summed((x.number, x.used(probability, w)) for x, w in lots)
    return probability


def normal(expected: np.ndarray) -> np.ndarray:
    expected = expected + SMOOTHING
    expected[0] = expected[1] = 0.0
    out = expected / expected.sum(0, keepdims=True)
    out[1] = UNKNOWN
    return out


class Scorer:
    """Texts -> summed log probabilities, remembering words."""

    def __init__(self, probability: np.ndarray, pieces: Pieces):
        self.probability, self.pieces, self.languages = probability, pieces, probability.shape[1]
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.logs = np.zeros((0, self.languages))

    def learn(self, words: list[str]) -> None:
        total = np.zeros((len(words), self.languages))
        for at in in_lots(words):
            total[at] = self.pieces.lattice([MARK + words[i] for i in at]).sums(self.probability)
        self.at.update(zip(words, range(len(self.logs), len(self.logs) + len(words)), strict=True))
        self.logs = np.vstack([self.logs, total])

    def score(self, texts: list[str]) -> list[np.ndarray | None]:
        if len(self.at) > CACHE_WORDS:
            self.forget()
        lists = [words_of(t) for t in texts]
        new: set[str] = set()
        for ws in lists:
            new.update(ws)
        if fresh := sorted(new.difference(self.at)):
            self.learn(fresh)
        at, logs = self.at.__getitem__, self.logs
        return [logs[np.fromiter(map(at, ws), np.int64, len(ws))].sum(0) if ws else None for ws in lists]


def labelled(docs: DataFrame, lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[DataFrame, list[str]]:
    """A bounded sample: of each language, about so many rows, by the hash of doc_id."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull()).select(F.col(lang_col).alias("lang"), "text", "doc_id")
    sizes = durable(known.groupBy("lang").agg(F.count("*").alias("n")), "langid-sizes")
    languages = [r["lang"] for r in sizes.select("lang").orderBy("lang").collect()]
    place = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.col("doc_id")), 1).cast("double") / F.lit(float(1 << 63))
    drawn = known.join(small(sizes, len(languages)), "lang").where(place * F.col("n") <= F.lit(float(rows_per_language)))
    return drawn.select("lang", "text"), languages


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of the sample's words, as they are read when texts are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                counts: Counter = Counter()
                for lang, text in zip(*(c.to_pylist() for c in whole.slice(lo, 64).columns), strict=True):
                    counts.update((lang, w) for w in words_of(text))
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, pieces: Pieces, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """All languages that label a text, and [pieces, languages] probabilities. What reaches the driver are the distinct words of the bounded sample."""
    sample, languages = labelled(docs, rows_per_language=rows_per_language)
    counted = [(r[0], r[1], r[2]) for r in word_counts(sample).orderBy("lang", "word").collect()] if languages else []
    return languages, fit(counted, languages, pieces) if counted else np.zeros((pieces.size, len(languages)))


def identify(docs: DataFrame, languages: list[str], probability: np.ndarray, model_file: str, keep: list[str]) -> DataFrame:
    """Each row's `keep` columns, lang_pred and score (the posterior of lang_pred).

    A null text, or one without a letter, is `und` with score 0; so is every
    text where no language was learned. Texts and words of any length are scored
    whole. Ties go to the first language in order of name. Repeated rows are judged
    alike, an empty table gives an empty result, and no other column is read (so only
    lang_pred and score clash, if they are among `keep`). Every worker holds a number
    for each piece and language: 0.25 MB a language.
    """
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(probability)

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judge(batches):
        scorer = Scorer(sent.value, Pieces(model_file)) if languages and sent.value.any() else None
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                found, sure = [], []
                texts = [t or "" for t in b.column(len(keep)).to_pylist()]
                for s in scorer.score(texts) if scorer else [None] * len(texts):
                    if s is None:
                        found.append("und")
                        sure.append(0.0)
                        continue
                    best = int(np.argmax(s))
                    found.append(languages[best])
                    sure.append(float(1.0 / np.exp(np.maximum(s - s[best], -700.0)).sum()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(judge, schema)


def op3_language_id(spark, sf_dir):
    from quillon.llm.packing import public_path

    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc32_mod(F.col("doc_id"), 4) == 2)
    model = public_path("piece_bpe_32k.model")
    languages, probability = train(docs.where(~F.col("held_out")), Pieces(model))
    return identify(docs.select("doc_id", "held_out", "text"), languages, probability, model, ["doc_id", "held_out"])
