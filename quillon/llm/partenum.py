"""Exact Jaccard similarity join of shingle sets by PartEnum signatures.

Sets are dealt to size bands, so that two similar sets lie in one band or in
neighbours; a set signs for its own band and, where a larger partner can lie
there, for the next. For sets x and y of similarity g or more the symmetric
difference is at most k = (|x| + |y|) (1 - g) / (1 + g).

The feature domain is partitioned by hash, in two levels: a band has first-level
parts, each of three second-level parts, of which every subset of two is
enumerated as a signature. k differences change at most 2 k of a set's subsets,
so similar sets share all their other ones. Of a set's signatures, in one order by
how many sets share them, it is then enough to post the 2 k + 1 rarest: two
similar sets still share one, and what very many sets share makes no candidates.

Before that, a filter with a coarser, single-level partition: k differences change
at most k parts, so a set of whose parts no more than k fewer than all are
anybody else's can't be similar to any other set. It leaves before its elements
are ever stored; documents that merely share a passage go here.

Sets that share a posted signature meet at the group's most popular member, their
hub. What meets at a hub is compared exactly, as one matrix product of the sets'
common elements, and only links that connect are emitted. A hub with more members
than a block holds is split into blocks, each compared with the hub and in
itself; only where members then still lie in different components are
the blocks of the unconnected ones compared with all others.

Equal sets count as one class throughout. Signatures travel as packed arrays, and
each range of them is solved by one sort. No link, component or fingerprint of
documents reaches the driver; what is broadcast is a Bloom filter of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, durable, fresh, release, small, table
from quillon.llm.text import MIX, mixed, shingle_sets

#: Least similarity, as a fraction.
SIMILAR = (75, 100)
#: Bytes of text handled at once, signatures packed at once, signatures in one range of the filter, and of the join, about.
BATCH_BYTES, BATCH_SIGNATURES, FILTER_RANGE, JOIN_RANGE = 2 << 20, 1 << 20, 1 << 18, 1 << 19
#: Sets, and elements, of a block that is compared at once; elements to a matrix product.
BLOCK_SETS, BLOCK_ELEMENTS, COLUMNS = 512, 1 << 18, 2048
#: Bits of the Bloom filter: so many for each wanted row, between these bounds.
BLOOM_BITS, BLOOM_LEAST, BLOOM_MOST = 16, 1 << 20, 1 << 28


# signatures


def bands(most: int, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The largest size of each band, up to one beyond `most`; a partner's band is at most the next."""
    a, c = similar
    out: list[int] = []
    while len(out) < 2 or out[-2] < most:
        low = out[-1] + 1 if out else 1
        out.append(low * c * c // (a * a))
    return np.array(out, dtype=np.int64)


class Place:
    """Where some sets sign in a step: their numbers and bands, and how many elements may differ from a partner."""

    def __init__(self, sizes: np.ndarray, step: int, similar: tuple[int, int]):
        a, c = similar
        tops = bands(int(sizes.max(initial=1)), similar)
        band = np.searchsorted(tops, sizes, side="left") + step
        largest = np.minimum(tops[band], sizes * c // a)  # the largest partner there
        asked = (sizes > 0) & (largest > tops[band - 1] if step else sizes > 0)
        self.sets, self.band = np.flatnonzero(asked), band[asked]
        self.differ = ((sizes + largest) * (c - a) // (c + a))[asked]
        self.widest = 2 * tops[band[asked]] * (c - a) // (c + a)  # the same for all of a band
        self.number = np.full(len(sizes), -1, dtype=np.int64)
        self.number[asked] = np.arange(len(self.sets))

    def contents(self, owner: np.ndarray, hashes: np.ndarray, parts: np.ndarray):
        """(set, part, content) of the non-empty parts; owner and hashes are sorted, each element once."""
        use = self.number[owner] >= 0
        mine, h = self.number[owner[use]], hashes[use]
        if not len(mine):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            at = ((h >> np.uint64(32)) * parts[mine].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (at[1:] != at[:-1])]))  # in order of h, so of parts
            return mine[first], at[first], np.add.reduceat(mixed(h + MIX), first)


def signatures(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, empty: bool = False, similar: tuple[int, int] = SIMILAR):
    """(set, step, signature) of the non-empty parts of sets given by their elements, and [2, sets] what each needs.

    Step 0 is the band of the set itself, where it meets sets of its own band and
    smaller ones; step 1 the next band, where it meets larger ones. What a set
    needs: so many of its non-empty parts must agree with a partner's; -1 where
    empty ones may do, 0 where it has no place. empty: the empty parts of the sets
    for which they may do are signed too.
    """
    need = np.zeros((2, len(sizes)), dtype=np.int64)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in (0, 1):
        place = Place(sizes, step, similar)
        parts = np.maximum(8, place.widest * 5 // 4 + 1)
        mine, at, content = place.contents(owner, hashes, parts)
        filled = np.bincount(mine, minlength=len(place.sets))
        need[step, place.sets] = np.where(filled > place.differ, filled - place.differ, -1)
        if empty:
            mine, at, content = with_empty(mine, at, content, need[step, place.sets] < 0, parts)
        with np.errstate(over="ignore"):
            got.append((place.sets[mine], np.full(len(mine), step, dtype=np.int64), mixed(content + mixed(at.astype(np.uint64) * MIX + place.band[mine].astype(np.uint64)))))
    return *(np.concatenate(x) for x in zip(*got, strict=True)), need


def with_empty(mine, at, content, wanted, parts):
    """The parts, and of wanted sets the empty ones as well, with content 0."""
    more = [(np.full(len(rest), i), rest) for i in np.flatnonzero(wanted) for rest in [np.setdiff1d(np.arange(parts[i]), at[mine == i])]]
    if not more:
        return mine, at, content
    return np.concatenate([mine, *(x for x, _ in more)]), np.concatenate([at, *(x for _, x in more)]), np.concatenate([content, np.zeros(sum(len(x) for x, _ in more), np.uint64)])


#: The second level: subsets of two of three parts.
PAIRS = ((0, 1), (0, 2), (1, 2))


def enumerated(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, similar: tuple[int, int] = SIMILAR):
    """(set, step, signature) of the enumerated subsets with an element in them, and [2, sets] what each set needs: so many
    of its subsets are a similar partner's too; -1 where subsets without elements may do, which then are signed as well."""
    need = np.zeros((2, len(sizes)), dtype=np.int64)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in (0, 1):
        place = Place(sizes, step, similar)
        firsts = np.maximum(4, place.widest * 2)
        mine, at, content = place.contents(owner, hashes, firsts * 3)
        group = at // 3
        new = np.concatenate([[True], (mine[1:] != mine[:-1]) | (group[1:] != group[:-1])])[: len(mine)]
        who, where = mine[new], group[new]
        three, full = np.zeros((len(who), 3), np.uint64), np.zeros((len(who), 3), bool)
        row = np.cumsum(new) - 1
        three[row, at % 3], full[row, at % 3] = content, True
        held = np.bincount(who, full[:, 0].astype(float) + full[:, 1] + full[:, 2] > 1, len(place.sets)) + 2 * np.bincount(who, minlength=len(place.sets))
        k = place.differ
        changed = 2 * np.minimum(k, firsts) + np.clip(k - firsts, 0, firsts)  # the first difference in a group changes two subsets, the second one more
        need[step, place.sets] = np.where(held > changed, held - changed, -1).astype(np.int64)
        bare = np.flatnonzero(need[step, place.sets] < 0)
        with np.errstate(over="ignore"):
            for n, (i, j) in enumerate(PAIRS):
                use = full[:, i] | full[:, j]
                salt = mixed(where[use].astype(np.uint64) * MIX + place.band[who[use]].astype(np.uint64) * np.uint64(4) + np.uint64(n))
                got.append((place.sets[who[use]], np.full(int(use.sum()), step, dtype=np.int64), mixed(mixed(three[use, i] + salt) + three[use, j])))
                for x in bare:
                    rest = np.setdiff1d(np.arange(firsts[x]), where[use][who[use] == x]).astype(np.uint64)
                    salt = mixed(rest * MIX + np.uint64(place.band[x]) * np.uint64(4) + np.uint64(n))
                    got.append((np.full(len(rest), place.sets[x]), np.full(len(rest), step, dtype=np.int64), mixed(mixed(salt))))
    return *(np.concatenate(x) for x in zip(*got, strict=True)), need


# sets of documents


def sets_of(texts: pa.Array):
    """Set numbers, hashes and sizes of a batch of texts."""
    data = [t.as_py().encode() if t.is_valid else b"" for t in texts]
    owner, hashes, _ = shingle_sets(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([len(d) for d in data]).astype(np.int64))
    return owner, hashes, np.bincount(owner, minlength=len(data)).astype(np.int64)


def class_keys(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; together they name its class."""
    out = []
    edges = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        for salt in (1, 2):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes + np.uint64(salt) * MIX), dtype=np.uint64)])
            out.append(mixed(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BATCH_BYTES of one column, a single long value by itself."""
    for whole in batches:
        lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in whole.column(column)], dtype=np.int64)
        at = np.cumsum(lengths + 64)
        lo = 0
        while lo < whole.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, (at[lo - 1] if lo else 0) + BATCH_BYTES, side="right")))
            yield whole.slice(lo, hi - lo)
            lo = hi
    release()


def described(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text, print): its size, its class, and what its class needs in either step."""

    def run(batches):
        for b in slices(batches, 1):
            owner, hashes, sizes = sets_of(b.column(1))
            k1, k2 = class_keys(owner, hashes, sizes)
            *_, need = signatures(owner, hashes, sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes), pa.array(k1), pa.array(k2), pa.array(need[0]), pa.array(need[1])], names=["doc_id", "print", "n", "key", "key2", "need0", "need1"])

    return docs.mapInArrow(run, "doc_id long, print long, n long, key long, key2 long, need0 long, need1 long")


# the filter


def short_bits(rows: int) -> int:
    """Bits of the short names that classes have in the filter: few classes share one (and those then stay)."""
    return 32 if rows <= 1 << 24 else 39


def runs_by_range(at: np.ndarray, run: np.ndarray, ranges: int):
    """Signatures (their range, and the number of their run) in order of range and run: the order, first places and lengths of the runs, and edges of the ranges among the runs."""
    order = np.argsort(at * np.int64(run.max(initial=0) + 1) + run, kind="stable")
    at, run = at[order], run[order]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (run[1:] != run[:-1])]))
    return order, first, np.diff(np.append(first, len(at))), at[first], run[first]


def packed(at: np.ndarray, run: np.ndarray, low: np.ndarray, of_run: list[np.ndarray], names: list[str], ranges: int) -> pa.RecordBatch:
    """A row for each range: what belongs to its runs (indexed by run number, a row of bytes each), the runs' lengths, the low bits of its signatures (a row of bytes each)."""
    order, first, lengths, at_run, runs = runs_by_range(at, run, ranges)
    low, ends = low[order], np.append(first, len(at))
    edges = np.flatnonzero(np.concatenate([[True], at_run[1:] != at_run[:-1], [True]]))
    columns = [[x[runs[i:j]].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)] for x in of_run]
    columns.append([lengths[i:j].astype(np.uint32).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)])
    columns.append([low[ends[i] : ends[j]].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)])
    return pa.RecordBatch.from_arrays([pa.array(at_run[edges[:-1]].astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=["p", *names, "runs", "low"])


def joined(column, kind) -> np.ndarray:
    """All values of a binary column as one array."""
    return np.frombuffer(b"".join(column), kind)


def as_bytes(x: np.ndarray, width: int) -> np.ndarray:
    """Unsigned integers as rows of their `width` low bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def from_bytes(column, width: int) -> np.ndarray:
    x = joined(column, np.uint8).reshape(-1, width)
    return np.hstack([x, np.zeros((len(x), 8 - width), np.uint8)]).view("<u8").ravel()


def posted(docs: DataFrame, ranges: int, bits: int) -> DataFrame:
    """The parts of all documents' sets, packed by range; copies within a batch once. A class goes by the first bits of its key."""
    shift, width = np.uint64(64 - (ranges.bit_length() - 1)), 5 if bits > 32 else 4

    def flush(held):
        name, run, sig = (np.concatenate(x) for x in zip(*held, strict=True))
        names, run = np.unique(name * np.uint64(2) + run, return_inverse=True)  # copies of other slices meet here
        low = as_bytes((sig >> (shift - np.uint64(24))) & np.uint64(0xFFFFFF), 3)
        return packed((sig >> shift).astype(np.int64), run, low, [as_bytes(names, width + 1 if bits > 32 else 5)], ["names"], ranges)

    def run(batches):
        held, n = [], 0
        for b in slices(batches, 1):
            owner, hashes, sizes = sets_of(b.column(1))
            keys, _ = class_keys(owner, hashes, sizes)
            once = np.zeros(len(sizes), dtype=bool)
            once[np.unique(keys, return_index=True)[1]] = True
            keep = once[owner]
            who, step, sig, _ = signatures(owner[keep], hashes[keep], np.where(once, sizes, 0))
            held.append((keys.view(np.uint64)[who] >> np.uint64(64 - bits), step.astype(np.uint64), sig))
            n += len(who)
            if n >= BATCH_SIGNATURES:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return docs.mapInArrow(run, "p int, names binary, runs binary, low binary")


def repeated(buckets: int, bits: int):
    """Of one range: how many signatures of each class (and step) another class has too, dealt by class."""
    width = 6 if bits > 32 else 5

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        release()  # what the range before has left
        names = np.repeat(from_bytes(frame["names"], width), joined(frame["runs"], np.uint32))
        both = np.unique((from_bytes(frame["low"], 3) << np.uint64(40)) | names)  # a class's own copies count once
        same = both[1:] >> np.uint64(40) == both[:-1] >> np.uint64(40)
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        found, n = np.unique(both[shared] & np.uint64((1 << 40) - 1), return_counts=True)
        at = (mixed(found >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(buckets + 1))
        rows = [(b, found[order[i:j]].tobytes(), n[order[i:j]].astype(np.uint32).tobytes()) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
        return pd.DataFrame(rows, columns=["bucket", "names", "n"])

    return run


def summed(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of classes: the sums, a row for each class."""
    names, n = joined(frame["names"], np.uint64), joined(frame["n"], np.uint32)
    found, at = np.unique(names >> np.uint64(1), return_inverse=True)
    step = (names & np.uint64(1)).astype(np.int64)
    sums = np.bincount(at * 2 + step, n, 2 * len(found)).astype(np.int64).reshape(-1, 2)
    return pd.DataFrame({"name": found.view(np.int64), "n0": sums[:, 0], "n1": sums[:, 1]})


def left_of(slim: DataFrame, classes: DataFrame, rows: int, elements: int) -> DataFrame:
    """The classes that the filter leaves."""
    bits, ranges = short_bits(rows), ranges_for(elements * 0.8, FILTER_RANGE)
    buckets = max(8, ranges // 32)
    counts = posted(slim, ranges, bits).groupBy("p").applyInPandas(repeated(buckets, bits), "bucket int, names binary, n binary")
    counts = counts.groupBy("bucket").applyInPandas(summed, "name long, n0 long, n1 long")
    named = classes.withColumn("name", F.shiftrightunsigned("key", 64 - bits))
    unsure = named.groupBy("name").agg(F.count("*").alias("classes")).where("classes > 1")
    asked = named.join(counts, "name", "left").join(unsure, "name", "left")
    enough = "(need0 <> 0 and coalesce(n0, 0) >= need0) or (need1 <> 0 and coalesce(n1, 0) >= need1) or classes > 1"
    return asked.where(enough).select("key", "key2", "rep", "print")


# sets that are left


def bloom_of(wanted: DataFrame, column: str, rows: int) -> np.ndarray | None:
    """Bytes whose bits are the values' hashes; None where a filter of the greatest size would be too full."""
    if rows * 2 > BLOOM_MOST:
        return None
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (rows * BLOOM_BITS).bit_length()))
    piece = BLOOM_LEAST
    slot = F.pmod(F.xxhash64(column), F.lit(bits))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(piece, np.uint8)
        x[frame["at"].to_numpy()] = 1
        return pd.DataFrame({"piece": frame["piece"].iloc[:1], "bits": [np.packbits(x, bitorder="little").tobytes()]})

    pieces = wanted.select((slot / piece).cast("int").alias("piece"), (slot % piece).cast("int").alias("at")).distinct().groupBy("piece").applyInPandas(run, "piece int, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in pieces.toLocalIterator():  # 128 KB each, BLOOM_MOST bits at most
        out[r["piece"] * piece // 8 : (r["piece"] + 1) * piece // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def sets_for(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(key, key2, rep, n, elements): the sets of the wanted classes (key, key2, rep, print). A class is looked for under its first
    doc_id, or under a text's fingerprint where all its rows have none, and only a row of the class itself is taken:
    others may stand under the same doc_id. Documents that can't be wanted are left out before the join by a Bloom
    filter of bounded size."""
    wanted = wanted.select("key", "key2", "rep", F.coalesce("rep", "print").alias("at"), F.col("rep").isNull().alias("none"))
    bloom = bloom_of(wanted, "at", rows)
    sent = None if bloom is None else docs.sparkSession.sparkContext.broadcast(bloom)
    bits = 0 if bloom is None else 8 * len(bloom)

    def run(batches):
        def wanted_rows():
            for whole in batches:
                if bits:
                    slot = whole.column(3).to_numpy()
                    whole = whole.filter(pa.array((sent.value[slot // 8] >> (slot % 8)) & 1 == 1))
                if whole.num_rows:
                    yield whole

        for b in slices(wanted_rows(), 2):
            owner, hashes, sizes = sets_of(b.column(2))
            k1, k2 = class_keys(owner, hashes, sizes)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            elements = [hashes[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
            found = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k1), pa.array(k2), pa.array(elements, pa.binary())], names=["at", "none", "key", "key2", "elements"])
            once = np.unique(np.stack([k1, k2, b.column(0).to_numpy()], 1), axis=0, return_index=True)[1]  # copies within a batch
            yield found.take(pa.array(np.sort(once)))

    marked = docs.select(F.coalesce("doc_id", "print").alias("at"), F.col("doc_id").isNull().alias("none"), "text")
    marked = marked.withColumn("slot", F.pmod(F.xxhash64("at"), F.lit(bits or 1)))
    found = marked.mapInArrow(run, "at long, none boolean, key long, key2 long, elements binary").join(small(wanted, rows), ["at", "none", "key", "key2"])
    return found.dropDuplicates(["key", "key2"]).select("key", "key2", "rep", (F.octet_length("elements") / 8).cast("long").alias("n"), "elements")


# candidates


def signed(sets: DataFrame, ranges: int) -> DataFrame:
    """The enumerated signatures of the sets (node, elements), packed by range."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def flush(held):
        node, run, need, sig = (np.concatenate(x) for x in zip(*held, strict=True))
        names, first, run = np.unique(node * 2 + run, return_index=True, return_inverse=True)
        low = ((sig >> (shift - np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return packed((sig >> shift).astype(np.int64), run, low, [names, need[first].astype(np.int32)], ["names", "need"], ranges)

    def run(batches):
        held, n = [], 0
        for b in slices(batches, 1):
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1)]
            sizes = np.array([len(x) for x in parts], dtype=np.int64)
            who, step, sig, need = enumerated(np.repeat(np.arange(len(parts)), sizes), np.concatenate(parts), sizes)
            held.append((b.column(0).to_numpy()[who], step, need[step, who], sig))
            n += len(who)
            if n >= BATCH_SIGNATURES:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return sets.select("node", "elements").mapInArrow(run, "p int, names binary, need binary, runs binary, low binary")


def dealt(bucket: np.ndarray, columns: list[np.ndarray], names: list[str], buckets: int) -> pd.DataFrame:
    """A row for each bucket, with its part of each column as bytes."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(b, *(x[order[i:j]].tobytes() for x in columns)) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
    return pd.DataFrame(rows, columns=names)


def counted(buckets: int):
    """Of one range: each signature that several sets share, with how many, dealt by set."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        runs = joined(frame["runs"], np.uint32)
        names, need, low = np.repeat(joined(frame["names"], np.int64), runs), np.repeat(joined(frame["need"], np.int32), runs), joined(frame["low"], np.uint32)
        order = np.lexsort((names, low))
        names, need, low = names[order], need[order], low[order]
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (names[1:] != names[:-1])])
        names, need, low = names[new], need[new], low[new]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.diff(np.append(first, len(low)))
        n = np.repeat(n, n)
        many = n > 1
        sig = (np.int64(frame["p"].iloc[0]) << np.int64(32)) | low[many].astype(np.int64)
        at = (mixed((names[many] >> np.int64(1)).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        return dealt(at, [names[many], need[many], sig, n[many].astype(np.uint32)], ["bucket", "names", "need", "sig", "n"], buckets)

    return run


def rarest(buckets: int):
    """Of one bucket of sets: each set's rarest signatures, dealt by signature, with how many it shares in all. Those that no
    other set has come first of all and need not travel: of r shared ones a set that needs m posts the r - m + 1 rarest."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        names, need, sig, n = joined(frame["names"], np.int64), joined(frame["need"], np.int32).astype(np.int64), joined(frame["sig"], np.int64), joined(frame["n"], np.uint32)
        order = np.lexsort((sig, n, names))
        names, sig, need = names[order], sig[order], need[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        held = np.diff(np.append(first, len(names)))
        place, held = np.arange(len(names)) - np.repeat(first, held), np.repeat(held, held)
        posts = (need < 0) | (place <= held - need)
        at = (mixed(sig[posts].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        return dealt(at, [names[posts] >> np.int64(1), held[posts].astype(np.uint32), sig[posts]], ["p", "nodes", "popular", "sig"], buckets)

    return run


def met(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of signatures: who meets at which hub, the most popular member of a signature's group (ties: the smallest); the hub meets itself."""
    release()
    nodes, popular, sig = joined(frame["nodes"], np.int64), joined(frame["popular"], np.uint32).astype(np.int64), joined(frame["sig"], np.int64)
    order = np.lexsort((nodes, -popular, sig))
    nodes, sig = nodes[order], sig[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    sizes = np.diff(np.append(first, len(sig)))
    many = np.repeat(sizes, sizes) > 1
    both = np.unique(np.stack([np.repeat(nodes[first], sizes)[many], nodes[many]], 1), axis=0)
    return pd.DataFrame({"hub": both[:, 0], "node": both[:, 1]})


# exact comparison


def similar_pairs(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Which of some sets (sorted, each element once) are similar: a matrix."""
    a, c = similar
    sizes = np.array([len(x) for x in sets], dtype=np.float64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        shared = np.array([[sizes[0], both], [both, sizes[1]]])
    else:
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first = np.concatenate([[True], every[1:] != every[:-1]])
        column, n = np.cumsum(first) - 1, np.diff(np.append(np.flatnonzero(first), len(every)))
        common = n[column] > 1
        owner, column = owner[common], (np.cumsum(n > 1) - 1)[column[common]]
        shared = np.zeros((len(sets), len(sets)), dtype=np.float64)
        width = int(column[-1]) + 1 if len(column) else 0
        for lo in range(0, width, COLUMNS):
            i, j = np.searchsorted(column, (lo, lo + COLUMNS))
            holds = np.zeros((len(sets), min(COLUMNS, width - lo)), dtype=np.float32)
            holds[owner[i:j], column[i:j] - lo] = 1.0
            shared += holds @ holds.T
    return c * shared >= a * (sizes[:, None] + sizes[None, :] - shared)


def spanning(good: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what the matrix connects, one fewer than members in each component."""
    left, one, other = np.ones(len(good), dtype=bool), [], []
    for i in range(len(good)):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo:
            at = todo.pop()
            near = np.flatnonzero(good[at] & left)
            left[near] = False
            one += [at] * len(near)
            other += near.tolist()
            todo += near.tolist()
    return one, other


def compared(blocks: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(a, b): links that connect the similar sets of each block (block long, node long, elements binary)."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        now, a, b = None, [], []

        def close():
            if len(held) > 1:
                nodes = list(held)
                one, other = spanning(similar_pairs(list(held.values()), similar))
                a.extend(nodes[i] for i in one)
                b.extend(nodes[i] for i in other)

        for batch in batches:
            for block, node, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now:
                    close()
                    held, now = {}, block
                held[node] = np.frombuffer(x.as_py(), np.uint64)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a.clear()
                b.clear()
        close()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release()

    return blocks.select("block", "node", "elements").repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        out = near.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def state(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "partenum-edges")
    before = None
    while (found := state(now)) != before:
        before, last = found, now
        wide = durable(star(now, True), "partenum-edges")
        now = durable(star(wide, False), "partenum-edges")
        discard(last, wide)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def ranges_for(signed_: float, each: int) -> int:
    """A power of two of ranges of about so many signatures each."""
    return 1 << max(3, int(signed_ / each).bit_length())


def blocks_of(n, elements):
    """How many blocks so many sets with so many elements make."""
    return F.ceil(F.greatest(n / BLOCK_SETS, elements / BLOCK_ELEMENTS)).cast("int")


def across(pairs: DataFrame, sizes: DataFrame, split: DataFrame, roots: DataFrame) -> DataFrame:
    """(block, node): of hubs in several blocks, whose members lie in different components, the blocks of those that aren't
    in the hub's component against each other and against the rest."""
    placed = pairs.join(split.select("hub"), "hub").join(sizes, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    centre = placed.where("node = hub").select("hub", F.col("root").alias("centre"))
    sides = placed.join(centre, "hub").withColumn("out", F.col("root") != F.col("centre"))
    facts = sides.groupBy("hub").agg(*[f for side in ("out", "not out") for f in (F.count_if(F.expr(side)).alias(f"n {side}"), F.sum(F.when(F.expr(side), F.col("n")).otherwise(0)).alias(f"e {side}"))]).where(F.col("n out") > 0)
    facts = facts.select("hub", blocks_of(F.col("n out"), F.col("e out")).alias("outs"), F.greatest(F.lit(1), blocks_of(F.col("n not out"), F.col("e not out"))).alias("ins"))
    own = sides.join(facts, "hub").withColumn("own", F.when(F.col("out"), F.pmod(F.xxhash64("node"), F.col("outs"))).otherwise(F.col("outs") + F.pmod(F.xxhash64("node"), F.col("ins"))).cast("int"))
    # an outer block meets every block, an inner one the outer ones
    other = F.when(F.col("out"), F.sequence(F.lit(0), F.col("outs") + F.col("ins") - 1)).otherwise(F.sequence(F.lit(0), F.col("outs") - 1))
    return own.select("node", "hub", "own", F.explode(other).alias("other")).select(F.xxhash64("hub", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "node")


def links_of(sets: DataFrame, elements: int) -> DataFrame | None:
    """(node, root) of the sets (node, n, elements) that are linked."""
    ranges = ranges_for(elements * 1.6, JOIN_RANGE)
    buckets = max(8, ranges // 4)
    shared = signed(sets, ranges).groupBy("p").applyInPandas(counted(buckets), "bucket int, names binary, need binary, sig binary, n binary")
    chosen = shared.groupBy("bucket").applyInPandas(rarest(buckets), "p int, nodes binary, popular binary, sig binary")
    pairs = durable(chosen.groupBy("p").applyInPandas(met, "hub long, node long").distinct(), "partenum-hubs")
    sizes = sets.select("node", "n")
    hubs = pairs.join(sizes, "node").groupBy("hub").agg(F.count("*").alias("members"), F.sum("n").alias("weight")).select("hub", blocks_of(F.col("members"), F.col("weight")).alias("blocks"))
    split = durable(hubs.where("blocks > 1"), "partenum-split")
    n_split = split.count()
    own = pairs.join(small(split, n_split), "hub", "left").select("node", "hub", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("at"))
    centres = split.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
    blocks = own.unionByName(centres.withColumn("at", F.col("at").cast(own.schema["at"].dataType))).select(F.xxhash64("hub", "at").alias("block"), "node")
    links = durable(compared(blocks.join(sets.select("node", "elements"), "node")), "partenum-links")
    roots = components(links)
    if n_split:
        more = durable(compared(across(pairs, sizes, split, roots).join(sets.select("node", "elements"), "node")), "partenum-links")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        discard(more)
    discard(pairs, split, links)
    return roots


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, print (the text's fingerprint), n, root (names its component, null where n is 0) and component_id for every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
    rows = durable(described(slim), "partenum-documents")
    facts = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    grouped = rows.where("n > 0").groupBy("key", "key2")
    classes = durable(grouped.agg(F.min("doc_id").alias("rep"), F.min("print").alias("print"), F.count("*").alias("rows"), F.max("need0").alias("need0"), F.max("need1").alias("need1")), "partenum-classes")
    left = durable(left_of(slim, classes, facts["rows"], facts["n"] or 0), "partenum-left")
    n_left = left.count()
    sets = durable(sets_for(slim, left, n_left).withColumn("node", F.monotonically_increasing_id()), "partenum-sets")
    roots = links_of(sets, sets.agg(F.sum("n")).first()[0] or 0)
    name = F.concat(F.hex("key"), F.lit("-"), F.hex("key2"))
    members = sets.select("node", "key", "key2", "rep", name.alias("name")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = members.groupBy("root").agg(F.min("name").alias("name"), F.min("rep").alias("component_id"), F.count("*").alias("classes")).where("classes > 1")
    several = members.join(named.select("root", F.col("name").alias("first"), "component_id"), "root").select("key", "key2", F.col("first").alias("root"), "component_id")
    copies = classes.where("rows > 1").select("key", "key2", "rep").join(several.select("key", "key2"), ["key", "key2"], "left_anti")
    copies = copies.select("key", "key2", name.alias("root"), F.col("rep").alias("component_id"))
    known = durable(several.unionByName(copies).withColumn("known", F.lit(True)), "partenum-known")
    discard(left, sets, classes)
    found = rows.join(small(known, known.count()), ["key", "key2"], "left")
    has = F.col("n") > 0
    return found.select(
        "doc_id", "print", "n", F.when(has, F.when(F.col("known"), F.col("root")).otherwise(name)).alias("root"), F.when(has & F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    A null text is empty, and an empty text (or one of white space) has size 0 and
    is linked with nothing: component_id is its own doc_id. Rows repeated under one
    doc_id are linked each by its own text; a row with a null doc_id takes part and
    keeps null, but is never a component's name: a component of such rows alone has
    none. A text of any length is one set of all its shingles. An empty table gives
    an empty result; no column but doc_id and text is read, so others may have any name.
    """
    return linked(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, columns as they are, of which one row stays of each component: one under its smallest
    doc_id (or under none, where no row has one), of these the one whose text has the smallest fingerprint, of
    equal rows any. A row goes for its own text only, whatever else stands under its doc_id. Rows without words
    have nothing to be compared by; each stays. Columns of any name are kept; an empty table stays empty."""
    columns = docs.columns
    id_, print_, row = fresh(docs, "id", "print", "row")
    found = durable(linked(docs.select("doc_id", "text")).where("root is not null"), "partenum-linked")
    named = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = durable(named.groupBy("root", "doc_id", "print").agg(F.count("*").alias("rows")), "partenum-first")
    many = first.groupBy("root").agg(F.min("print").alias("least"), F.count("*").alias("n")).where("n > 1")
    later = first.join(many, "root").where("print <> least").select("doc_id", "print")
    others = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "print").distinct()
    gone = durable(others.unionByName(later).withColumnsRenamed({"doc_id": id_, "print": print_}), "partenum-gone")
    this = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(print_))
    stays = docs.join(small(gone, gone.count()), this, "left_anti")
    twice = durable(first.where("rows > 1").select(F.col("doc_id").alias(id_), F.col("print").alias(print_)), "partenum-twice")
    discard(found)
    n_twice = twice.count()
    if not n_twice:
        return stays.select(*columns)
    once = stays.join(small(twice, n_twice), this, "left_semi").groupBy("doc_id", F.xxhash64("text").alias(print_)).agg(F.first(F.struct(*columns)).alias(row)).select(f"{row}.*")
    return stays.join(small(twice, n_twice), this, "left_anti").select(*columns).unionByName(once)


def op9_partenum_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
     links AS (SELECT x, y FROM m JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
     reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(y) FROM reach WHERE x = d.doc_id), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
