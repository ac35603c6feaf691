"""Mixture-controlled packing of documents into token windows.

Every source is a queue of its documents' tokens. A deficit round robin with a
quantum of one token serves the queues: a queue with target rate p owes its
n-th token at virtual time (n - f) / p, where its phase f (0 to 1, spread evenly) keeps
queues of equal rates from all having their turn at once, and the token owed longest
(ties: the earlier queue) goes next. Windows are runs of `window` tokens of that service
order, so each holds its target share of every source to within a few tokens, what
a window owes is carried into the next, and when a queue runs dry the others
share its place in proportion. By default the targets are the sources' own
shares, so all queues end together and nothing but the last window is short.

The service order has a closed form: up to virtual time v a queue has been
served min(total, floor(p * v + f)) tokens. A task can therefore work out the
state of the deficits at any window, without the windows before it, and the
carrying across partitions costs no shuffle of token ids: documents are
tokenized once, where they are read, into a durable table; the only things
gathered are token sums per input partition and queue.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import durable, release, table
from quillon.llm.text import SPACE

WINDOW, END_ID = 4096, 2
#: Queues that one service serves; more are served in blocks of neighbours, whose own services share what a block is served.
BLOCK_QUEUES = 256
#: Spreads the queues' phases where they are more than a few.
GOLDEN, FEW_QUEUES = 0.6180339887498949, 32
#: Rows of (partition, queue) sums up to which they are broadcast; beyond, they are joined by key.
SUMS_BROADCAST = 200_000
#: Bytes of text tokenized at once; bytes of the longest part of a word that is merged in arrays; other words remembered.
BATCH_BYTES, LONGEST_PART, SLOW_WORDS = 4 << 20, 64, 50_000
#: Letter, digit or other, by byte.
KINDS = np.full(256, 2, dtype=np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
KINDS[48:58] = 1


class WordIds:
    """Texts -> ids as little-endian unsigned 32-bit bytes, by a word-end BPE.

    Such a tokenizer splits at white space, then into letters, digits and signs,
    and merges bytes within each of these parts by rank. A batch's words are told
    apart in array operations, each distinct one is split and merged once (all
    parts of one length at a time, each round the leftmost of a part's lowest
    pairs), and the ids are gathered in the words' order. Words that need more
    than this (letters beyond Latin-1, apostrophes, very long parts) go to the
    tokenizer itself, as do texts with special tokens, and all texts where the
    file describes a tokenizer of another kind.
    """

    #: What the tokenizer's file must say, and its special tokens' first characters; fixed values.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SPECIAL = "<|"
    NONE = np.int32(2**31 - 1)

    _kept: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.slow: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab = said["model"].get("vocab", {})
        letters = [byte_letter(b) for b in range(256)]
        self.fast = (
            [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and self.PARTS in json.dumps(said.get("pre_tokenizer"), ensure_ascii=False).replace("\\\\", "\\")
            and (said["model"].get("type"), said["model"].get("end_of_word_suffix"), said["model"].get("dropout")) == ("BPE", "</w>", None)
            and all(c in vocab and c + "</w>" in vocab for c in letters)
            and all(t["content"].startswith(self.SPECIAL) for t in said.get("added_tokens", []))
        )
        if not self.fast:
            return
        self.first = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + "</w>"] for c in letters], dtype=np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        self.n = max(vocab.values()) + 1
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in merges], dtype=np.int64)
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.slots, self.ranks = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, self.NONE, dtype=np.int32)
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):  # each free slot takes the first that asks for it, the others go on to the next
            here = at[todo]
            _, one = np.unique(here, return_index=True)
            one = one[self.slots[here[one]] == -1]
            self.slots[here[one]], self.ranks[here[one]] = keys[todo[one]], todo[one]
            todo = np.delete(todo, one)
            at[todo] = (at[todo] + 1) % len(self.slots)

    @classmethod
    def of(cls, path: str) -> WordIds:
        """One for each Python worker, kept between its tasks."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE where they don't merge."""
        shape, keys = left.shape, (left.astype(np.int64) * self.n + right).ravel()
        at = self.slot(keys)
        found = self.slots[at]
        again = np.flatnonzero((found != keys) & (found != -1))
        while len(again):
            at[again] = (at[again] + 1) % len(self.slots)
            found[again] = self.slots[at[again]]
            again = again[(found[again] != keys[again]) & (found[again] != -1)]
        return np.where(found == keys, self.ranks[at], self.NONE).reshape(shape)

    def merged(self, ids: np.ndarray):
        """(rows, their ids) of parts of one length given as first ids, as they come to an end."""
        rows = np.arange(len(ids))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            at = ranks.argmin(1)
            low = ranks[np.arange(len(ids)), at]
            on = low != self.NONE
            if not on.all():
                yield rows[~on], ids[~on]
                rows, ids, ranks, at, low = rows[on], ids[on], ranks[on], at[on], low[on]
            if not len(rows):
                return
            before, every = np.arange(ids.shape[1] - 1)[None, :] < at[:, None], np.arange(len(ids))
            ids = np.where(before, ids[:, :-1], ids[:, 1:])
            ids[every, at] = self.made[low]
            ranks = np.where(before[:, :-1], ranks[:, :-1], ranks[:, 1:])
            i = np.flatnonzero(at > 0)
            ranks[i, at[i] - 1] = self.rank(ids[i, at[i] - 1], ids[i, at[i]])
            i = np.flatnonzero(at < ids.shape[1] - 1)
            ranks[i, at[i]] = self.rank(ids[i, at[i]], ids[i, at[i] + 1])
        yield rows, ids

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, data: np.ndarray, ends: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each word's end) of distinct words that stand one after another in bytes, in lower case but for the slow ones."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        # parts: runs of letters, single digits, runs of others
        kind = KINDS[data]
        begins = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == 1)
        begins[starts] = True
        at = np.flatnonzero(begins)
        lengths = np.diff(np.append(at, len(data)))
        owner = np.searchsorted(ends, at, side="right")
        slow = slow.copy()
        slow[owner[lengths > LONGEST_PART]] = True
        keep = ~slow[owner]
        at, lengths, owner = at[keep], lengths[keep], owner[keep]
        n_ids, found = np.zeros(len(at), dtype=np.int64), []
        by_length = np.argsort(lengths, kind="stable")
        edges = np.searchsorted(lengths[by_length], np.arange(1, LONGEST_PART + 2))
        for n in range(1, LONGEST_PART + 1):
            which = by_length[edges[n - 1] : edges[n]]
            if len(which):
                letters = data[at[which][:, None] + np.arange(n)]
                ids = self.first[letters]
                ids[:, -1] = self.last[letters[:, -1]]
                for rows, done in self.merged(ids):
                    n_ids[which[rows]] = done.shape[1]
                    found.append((which[rows], done))
        per_word = np.bincount(owner, n_ids, len(ends)).astype(np.int64)
        odd, text = np.flatnonzero(slow), data.tobytes()
        spelled = [text[starts[i] : ends[i]] for i in odd]
        if new := [w for w in spelled if w not in self.slow]:
            if len(self.slow) > SLOW_WORDS:
                self.slow.clear()
                new = spelled
            self.slow.update(zip(new, self.encode_whole([w.decode() for w in new]), strict=True))
        theirs = [self.slow[w] for w in spelled]
        per_word[odd] = [len(x) // 4 for x in theirs]
        stops = np.cumsum(per_word)
        out = np.zeros(int(stops[-1]) if len(stops) else 0, dtype="<u4")
        first = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)]
        inside = np.cumsum(n_ids) - n_ids
        base = (stops - per_word)[owner] + inside - np.repeat(inside[first], np.diff(np.append(np.flatnonzero(first), len(owner))))
        for which, ids in found:
            out[base[which][:, None] + np.arange(ids.shape[1])] = ids
        for i, x in zip(odd, theirs, strict=True):
            out[stops[i] - per_word[i] : stops[i]] = np.frombuffer(x, "<u4")
        return out, stops

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.fast:
            return self.encode_whole(texts)
        whole = [i for i, t in enumerate(texts) if self.SPECIAL in t]
        skip = set(whole)
        spelled = [b"" if i in skip else t.encode() for i, t in enumerate(texts)]
        data = np.frombuffer(b"\n".join(spelled) + b"\n", dtype=np.uint8)
        ends = np.cumsum([len(x) + 1 for x in spelled])
        inside = ~SPACE[data]
        begins = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        lengths = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1 - begins
        out = [b""] * len(texts)
        if len(begins):
            letters = data[inside]
            after_c3 = np.concatenate([[False], letters[:-1] == 0xC3])
            odd = ((letters >= 0x80) & (letters != 0xC3) & ~after_c3) | (letters == 0x27) | (after_c3 & ((letters == 0x97) | (letters == 0xB7)))
            stops = np.cumsum(lengths)
            slow = np.add.reduceat(odd, stops - lengths, dtype=np.int64) > 0
            upper = ((letters >= 0x41) & (letters <= 0x5A)) | (after_c3 & (letters >= 0x80) & (letters <= 0x9E))
            low = letters + (upper & ~np.repeat(slow, lengths)).astype(np.uint8) * np.uint8(32)
            offsets = np.concatenate([[0], stops]).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
            which, distinct = coded.indices.to_numpy(), coded.dictionary
            d_ends = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1)[1:].astype(np.int64)
            is_slow = np.zeros(len(distinct), dtype=bool)
            is_slow[which[slow]] = True
            ids, ids_end = self.words(np.frombuffer(distinct.buffers()[2], np.uint8, int(d_ends[-1])), d_ends, is_slow)
            n = np.diff(np.concatenate([[0], ids_end]))
            per = n[which]
            upto = np.cumsum(per)
            every = ids[np.repeat(ids_end[which] - upto, per) + np.arange(int(upto[-1]))].tobytes()
            at = np.concatenate([[0], upto])[np.searchsorted(begins, ends)]
            out = [every[4 * i : 4 * j] for i, j in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)]
        for i, x in zip(whole, self.encode_whole([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out


def byte_letter(b: int) -> str:
    """The character by which byte-level vocabularies spell a byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(b) if b in plain else chr(256 + b - sum(x < b for x in plain))


def id_kind(tokenizer_path: str) -> str:
    """The narrowest unsigned integers that hold all ids of a tokenizer, and the end id."""
    from tokenizers import Tokenizer

    return "<u2" if max(END_ID, *Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer_path: str, kind: str) -> DataFrame:
    """(doc_id, part, queue, before, n, ids): before counts the tokens of the
    same input partition and queue that stand before the document."""
    queue = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            upto = np.cumsum([len(x.as_buffer()) + 64 for x in whole.column(2)])
            lo = 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BATCH_BYTES, side="right")))
                yield whole.slice(lo, hi - lo)
                lo = hi

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), WordIds.of(tokenizer_path)
        served: dict[str, int] = {}
        end = np.array([END_ID], dtype=kind).tobytes()
        for batch in slices(batches):
            queues, before, counts, ids = batch.column(1).to_pylist(), [], [], []
            for q, got in zip(queues, words.encode(batch.column(2).to_pylist()), strict=True):
                n = len(got) // 4 + 1
                before.append(served.get(q, 0))
                counts.append(n)
                served[q] = before[-1] + n
                ids.append(np.frombuffer(got, dtype="<u4").astype(kind).tobytes() + end)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(ids), pa.int32()), batch.column(1), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "part", "queue", "before", "n", "ids"],
            )
        release()

    return slim.mapInArrow(encode, "doc_id long, part int, queue string, before long, n long, ids binary")


class Service:
    """The service order in closed form. Queues are numbered in the order given."""

    def __init__(self, totals: list[int], rates: list[float], window: int = 1):
        self.totals, self.window = np.array(totals, dtype=np.int64), window
        self.rates = np.array(rates, dtype=np.float64)
        spread = len(totals) > FEW_QUEUES  # few can't all have their turn at once; a phase of 1/2 keeps each nearest its share
        self.phase = (0.5 + np.arange(len(totals)) * GOLDEN * spread) % 1.0
        self.end = float(((self.totals + 1) / self.rates).max()) + 1.0

    def served(self, v: np.ndarray) -> np.ndarray:
        """[len(v), queues]: tokens served up to virtual time v."""
        return np.minimum(self.totals[None, :], np.floor(self.rates[None, :] * v[:, None] + self.phase[None, :]).astype(np.int64))

    def rank(self, queue: int, n: np.ndarray) -> np.ndarray:
        """An estimate, off by no more than the queues' number, of how many tokens are served before token n (from 0)."""
        v = (n + 1 - self.phase[queue]) / self.rates[queue]
        return np.concatenate([self.served(v[lo : lo + 1024]).sum(1) for lo in range(0, len(v), 1024)])

    def after(self, windows: np.ndarray) -> np.ndarray:
        """[len(windows), queues]: tokens served when so many windows are full."""
        return self.upto(windows.astype(np.int64) * self.window)

    def upto(self, tokens: np.ndarray) -> np.ndarray:
        """[len(tokens), queues]: how many of the first so many tokens each queue has."""
        if len(self.totals) == 1:
            return np.minimum(tokens, self.totals[0])[:, None]
        want = np.minimum(tokens, self.totals.sum())
        low, high = np.zeros(len(want)), np.full(len(want), self.end)
        for _ in range(80):  # down to neighbouring doubles
            mid = (low + high) / 2
            enough = self.served(mid).sum(1) >= want
            high, low = np.where(enough, mid, high), np.where(enough, low, mid)
        under, over = self.served(low), self.served(high)
        missing = (want - under.sum(1))[:, None]
        more = over - under  # owed at the same moment: earlier queues first
        given = np.clip(missing - (np.cumsum(more, axis=1) - more), 0, more)
        return under + given


class Mixture:
    """The services of any number of queues: one of blocks of neighbouring queues, and in each block one of its queues."""

    def __init__(self, totals: list[int], rates: list[float], window: int, block: int = BLOCK_QUEUES):
        n = len(totals)
        each = 1 if n <= block else -(-n // block) if n <= block * block else block
        cuts = range(0, n, each)
        self.window, self.each = window, each
        self.outer = Service([sum(totals[i : i + each]) for i in cuts], [sum(rates[i : i + each]) for i in cuts], window)
        self.inner = [Service(totals[i : i + each], rates[i : i + each]) for i in cuts]

    def span(self, queue: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window that tokens starts to ends of a queue can lie in."""
        block, place = divmod(queue, self.each)
        own = self.inner[block]
        slack, slack_out = len(own.totals) + 1 if self.each > 1 else 0, len(self.outer.totals) + 1
        lo = np.maximum(0, own.rank(place, starts) - slack) if self.each > 1 else starts
        hi = own.rank(place, ends) + slack if self.each > 1 else ends
        return np.maximum(0, self.outer.rank(block, lo) - slack_out) // self.window, (self.outer.rank(block, hi) + slack_out) // self.window

    def places(self, queues: np.ndarray, windows: np.ndarray) -> dict[int, tuple[list[int], list[int]]]:
        """Of each queue: its tokens before each of the windows, and where in the window they begin. windows: in order."""
        out: dict[int, tuple[list[int], list[int]]] = {}
        state = np.concatenate([self.outer.after(windows[lo : lo + 1024]) for lo in range(0, len(windows), 1024)])
        given = np.diff(state, axis=0)
        before = np.cumsum(given, axis=1) - given  # what earlier blocks put into each window
        for block in np.unique(queues // self.each).tolist():
            own = self.inner[block].upto(state[:, block])
            into = np.diff(own, axis=0)
            inside = np.cumsum(into, axis=1) - into
            for q in np.unique(queues[queues // self.each == block]).tolist():
                out[q] = (own[:, q % self.each].tolist(), (before[:, block] + inside[:, q % self.each]).tolist())
        return out


def cut(service: Mixture, queue_of: dict[str, int], queues, starts, counts, ids, kind: str):
    """The pieces of some documents: which window each lies in, and where."""
    out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    number = np.array([queue_of[q] for q in queues], dtype=np.int64)
    if not len(number):
        return out
    first, last = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
    for q in np.unique(number).tolist():
        at = number == q
        first[at], last[at] = service.span(q, starts[at], starts[at] + counts[at])
    wanted = np.unique(np.concatenate([np.arange(a, b + 2) for a, b in zip(first, last, strict=True)]))
    served = service.places(number, wanted)
    row = {w: i for i, w in enumerate(wanted.tolist())}
    for i, (q, begin, n, w0, w1) in enumerate(zip(number.tolist(), starts.tolist(), counts.tolist(), first.tolist(), last.tolist(), strict=True)):
        end, (upto, offsets) = begin + n, served[q]
        data = np.frombuffer(ids[i], dtype=kind).astype("<u4")
        for w in range(w0, w1 + 1):
            r = row[w]
            lo, hi = max(begin, upto[r]), min(end, upto[r + 1])
            if lo >= hi:
                continue
            out["row"].append(i)
            out["start"].append(lo - begin)
            out["length"].append(hi - lo)
            out["ids_crc32"].append(zlib.crc32(data[lo - begin : hi - begin]))
            out["doc_tokens"].append(n)
            out["sequence_id"].append(w)
            out["offset"].append(offsets[r] + lo - upto[r])
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def pack(docs: DataFrame, tokenizer_path: str, targets: dict[str, float] | None = None, window: int = WINDOW, block_queues: int = BLOCK_QUEUES) -> DataFrame:
    """One row per piece: which ids of which document lie where in which window.

    targets: source -> share of a window (any positive scale); sources without
    one get their own share of all tokens. A null text is empty, and its document
    is the end id alone; a null source is the queue ''; rows repeated under one
    doc_id are packed as often as they occur; a null doc_id stays null; a text of any
    length is one document; columns of other names are not read; an empty table gives
    no pieces. Windows are full but for the last. Sources may be any number: beyond
    block_queues they are served in blocks, and within a block in turn, so each still
    has its share of every window, to within a few tokens. Their names and totals go to every task.
    """
    spark, kind = docs.sparkSession, id_kind(tokenizer_path)
    ids = durable(tokenized(docs, tokenizer_path, kind), "packing-ids")
    sums = durable(ids.groupBy("part", "queue").agg(F.sum("n").alias("n")), "packing-sums")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    if not totals:
        return spark.createDataFrame([], SCHEMA)
    names, every = sorted(totals), sum(totals.values())
    rates = [float((targets or {}).get(q, totals[q] / every)) for q in names]
    service, queue_of = Mixture([totals[q] for q in names], rates, window, block_queues), {q: i for i, q in enumerate(names)}
    upto = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", "queue", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    if sums.count() <= SUMS_BROADCAST:
        bases = F.broadcast(bases)
    placed = ids.join(bases, ["part", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                queues = b.column(1).to_pylist()
                doc_ids = b.column(0).to_pylist()
                got = cut(service, queue_of, queues, b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_pylist(), kind)
                at = got.pop("row")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_ids[i] for i in at], pa.int64()), *(pa.array(got[k], pa.int64()) for k in got), pa.array([queues[i] for i in at], pa.string())],
                    names=["doc_id", *got, "source"],
                )

    return placed.mapInArrow(pieces, SCHEMA)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")).drop("source")
