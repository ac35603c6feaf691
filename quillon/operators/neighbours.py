"""Exact nearest rows under the mean of capped number gaps and flag mismatches, without meeting every pair.

Vectors are dealt to cells, the leaves of a k-d tree over the number and flag columns; its splits come from a bounded
sample, its boxes from all vectors. A query searches the cell it falls into, which bounds how far its k-th
neighbour can be, and then only the cells whose boxes come that near. Inside a cell the same is done with small leaves.
All bounds are lower ones and all comparisons are of the rounded distance, then of the key, so the result is that of
comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Rows of a leaf inside a cell, queries compared at once, pairs compared at once.
LEAF_ROWS, TOGETHER, PAIRS = 64, 64, 1 << 18
#: Distances are whole billionths; what the bounds allow for rounding; no neighbour yet.
UNIT, SLACK, NONE = 1e9, 3, np.int64((1 << 63) - 1)


def rounded(x: np.ndarray) -> np.ndarray:
    """Values from 0 to 1 in billionths, half up by their shortest decimal spelling, as Spark's round has it."""
    y = x * UNIT
    low = np.floor(y)
    out = (low + (y - low >= 0.5)).astype(np.int64)
    near = np.abs(y - low - 0.5) < 1e-6
    if near.any():
        values, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([int(Decimal(repr(float(v))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP)) for v in values], dtype=np.int64)[at]
    return out


class Space:
    """How far vectors are from each other: the number columns' spreads (0 for none; NaN if the column holds it), then the flag columns.

    A vector is a row of numbers (NaN for null) and a row of flag codes (equal for equal flags only, in a cell)."""

    def __init__(self, spreads: list[float], flags: int):
        self.spreads, self.flags, self.n = spreads, flags, len(spreads) + flags

    def gap(self, d: int, gap: np.ndarray) -> np.ndarray:
        """|difference| / spread capped at one; 1 where a side is null, or where there is no spread."""
        s = self.spreads[d]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            part = np.fmin(gap / s, 1.0) if s > 0 or np.isnan(s) else np.ones_like(gap)
        return np.where(gap == 0, 0.0, part)

    def distances(self, a, b) -> np.ndarray:
        """[rows of a, rows of b], in billionths; the sum goes in the columns' order."""
        total = None
        for d in range(len(self.spreads)):
            with np.errstate(invalid="ignore"):
                part = self.gap(d, np.abs(a[0][:, d, None] - b[0][None, :, d]))
            total = part if total is None else total + part
        for f in range(self.flags):
            part = (a[1][:, f, None] != b[1][None, :, f]).astype(float)
            total = part if total is None else total + part
        return rounded(total / self.n)

    def bounds(self, a, boxes) -> np.ndarray:
        """[rows of a, boxes]: no vector in the box is nearer, in billionths. boxes: lows, highs of numbers, then of flags."""
        lo, hi, flag_lo, flag_hi = boxes
        total = np.zeros((len(a[0]), len(lo)))
        for d in range(len(self.spreads)):
            x = a[0][:, d, None]
            with np.errstate(invalid="ignore"):
                out = np.maximum(np.maximum(lo[None, :, d] - x, x - hi[None, :, d]), 0.0)
            part = np.where(np.isnan(x), 1.0, self.gap(d, out))  # a null is 1 from all
            infinite = np.isinf(x) | np.isinf(lo[None, :, d]) & np.isinf(hi[None, :, d]) & (lo[None, :, d] <= hi[None, :, d])
            total += np.where(infinite, 0.0, part)
        for f in range(self.flags):
            x = a[1][:, f, None]
            total += (x < flag_lo[None, :, f]) | (x > flag_hi[None, :, f])
        return np.floor(total / self.n * UNIT).astype(np.int64) - SLACK


def box(numbers: np.ndarray, flags: np.ndarray):
    """The lows and highs of some vectors; of a column without numbers inf and -inf."""
    known = ~np.isnan(numbers)
    lo, hi = np.where(known, numbers, np.inf).min(0, initial=np.inf), np.where(known, numbers, -np.inf).max(0, initial=-np.inf)
    if not len(numbers):
        return lo, hi, np.full(flags.shape[1], 1), np.full(flags.shape[1], 0)
    return lo, hi, flags.min(0), flags.max(0)


def stacked(boxes: list):
    return tuple(np.array([b[i] for b in boxes]) for i in range(4))


class Tree:
    """Splits vectors by the column that spreads most, at its median, until a leaf has `rows` or all are equal."""

    def __init__(self, space: Space, numbers: np.ndarray, flags: np.ndarray, rows: int):
        self.space, self.numbers, self.flags, self.rows = space, numbers, flags, rows
        self.nodes: list[tuple[int, float, int, int]] = []  # column (-1: leaf), most on the left, left, right
        self.leaves: list[np.ndarray] = []
        todo = [(np.arange(len(numbers)), -1, 0)]
        while todo:
            rows_, parent, side = todo.pop()
            here = len(self.nodes)
            if parent >= 0:
                node = list(self.nodes[parent])
                node[2 + side] = here
                self.nodes[parent] = tuple(node)
            cut = self.cut(rows_) if len(rows_) > rows else None
            if cut is None:
                self.nodes.append((-1, 0.0, len(self.leaves), 0))
                self.leaves.append(rows_)
                continue
            d, at, left = cut
            self.nodes.append((d, at, 0, 0))
            todo += [(rows_[~left], here, 1), (rows_[left], here, 0)]
        del self.numbers, self.flags

    def column(self, numbers, flags, d):
        x = numbers[:, d] if d < len(self.space.spreads) else flags[:, d - len(self.space.spreads)]
        return np.where(np.isnan(x), np.inf, x) if d < len(self.space.spreads) else x

    def cut(self, rows):
        numbers, flags = self.numbers[rows], self.flags[rows]
        spread = []
        for d in range(self.space.n):
            x = self.column(numbers, flags, d)
            lo, hi = x.min(), x.max()
            if lo == hi:
                width = 0.0
            elif d < len(self.space.spreads):
                finite = x[np.isfinite(x)]
                width = max(1e-9, float(self.space.gap(d, np.array([np.ptp(finite) if len(finite) else 0.0]))[0]))
            else:  # a flag of very many values would part everything and bound nothing
                width = 1.0 if len(np.unique(x)) * 8 <= len(x) else 1e-12
            spread.append(width)
        for d in np.argsort(-np.array(spread), kind="stable"):
            if spread[d] > 0:
                x = self.column(numbers, flags, d)
                order = np.sort(x)
                at = order[(len(x) - 1) // 2]
                if at == order[-1]:
                    at = order[np.searchsorted(order, at) - 1]
                return int(d), at, x <= at
        return None

    def find(self, numbers: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into."""
        out = np.zeros(len(numbers), dtype=np.int64)
        todo = [(0, np.arange(len(numbers)))]
        while todo:
            i, rows = todo.pop()
            d, at, left, right = self.nodes[i]
            if d < 0:
                out[rows] = left
            elif len(rows):
                go = self.column(numbers[rows], flags[rows], d) <= at
                todo += [(left, rows[go]), (right, rows[~go])]
        return out


def search(space: Space, asked, most: np.ndarray, offered, keys: np.ndarray, k: int):
    """The k nearest of each asked vector: [rows, k] distances in billionths (-1: none) and keys. most: no farther ones are of use.
    keys: [vectors, k], a vector's least keys in order; counts by `valid`, as a masked array."""
    valid = ~np.ma.getmaskarray(keys)
    owner = np.nonzero(valid)[0]
    values = np.ma.getdata(keys)[valid]
    order = np.argsort(values, kind="stable")
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.arange(len(values))
    places = np.full(keys.shape, NONE)
    places[valid] = place
    held, sorted_keys = owner[order], values[order]  # by place: the vector and the key
    tree = Tree(space, *offered, LEAF_ROWS)
    boxes = stacked([box(offered[0][r], offered[1][r]) for r in tree.leaves])
    sizes = np.array([len(r) for r in tree.leaves])
    found_d, found_k = np.full((len(most), k), -1, dtype=np.int64), np.zeros((len(most), k), dtype=np.int64)
    home = tree.find(*asked)
    by_home = np.argsort(home, kind="stable")
    for lo in range(0, len(by_home), TOGETHER):
        q = by_home[lo : lo + TOGETHER]
        a = (asked[0][q], asked[1][q])
        least = space.bounds(a, boxes)
        best = np.full((len(q), k), NONE)
        limit = most[q]
        turn = np.argsort(least.min(0) * len(sizes) + np.arange(len(sizes)), kind="stable")
        done, room = 0, 1
        while done < len(turn):
            part = turn[done : done + room]
            done += len(part)
            part = part[(least[:, part] <= limit[:, None]).any(0)]
            while len(part):
                n = max(1, int(np.searchsorted(np.cumsum(sizes[part]), PAIRS // len(q), side="right")))
                rows = np.concatenate([tree.leaves[i] for i in part[:n]])
                part = part[n:]
                d = space.distances(a, (offered[0][rows], offered[1][rows]))
                new = np.where(d <= limit[:, None], d << 32 | places[rows, 0][None, :], NONE)
                new = np.concatenate([best, new], axis=1)
                best = np.sort(np.partition(new, k - 1, axis=1)[:, :k], axis=1)
                limit = np.minimum(limit, best[:, -1] >> 32)
            if done < len(turn) and not (least[:, turn[done:]] <= limit[:, None]).any():
                break
            room *= 2
        # the k nearest rows belong to the k vectors of which the first rows are nearest
        some = best != NONE
        vector = held[np.where(some, best & 0xFFFFFFFF, 0)] if len(held) else np.zeros(best.shape, dtype=np.int64)
        rows = np.where(some[:, :, None] & (places[vector] != NONE), (best >> 32)[:, :, None] << 32 | places[vector], NONE) if len(held) else np.full((*best.shape, 1), NONE)
        rows = np.sort(rows.reshape(len(q), -1), axis=1)[:, :k]
        some = rows != NONE
        found_d[q] = np.where(some, rows >> 32, -1)
        found_k[q] = np.where(some, sorted_keys[np.where(some, rows & 0xFFFFFFFF, 0)], 0) if len(held) else 0
    return found_d, found_k


# cells


#: Sampled vectors for each cell, from which its splits come.
SAMPLED = 100


def vectors(table: pa.Table | pa.RecordBatch, first: int, numbers: int, flags: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and whole-number flags of a table whose columns begin at a place."""
    x = [table.column(first + i).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(first + i).to_numpy() for i in range(numbers + flags)]
    n = table.num_rows
    return np.stack(x[:numbers], 1).astype(float) if numbers else np.zeros((n, 0)), np.stack(x[numbers:], 1).astype(np.int64) if flags else np.zeros((n, 0), np.int64)


def splits(space: Space, rows, cells: int, n: int) -> Tree:
    """A tree of about so many leaves, from a sample of the rows' numbers and flags' hashes (all rows go to its leaves)."""
    if cells > 1:
        share = min(1.0, SAMPLED * cells / n)
        rows = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("cells"), *rows.columns), 1) <= F.lit(min((1 << 63) - 1, int(share * (1 << 63)))))
    else:
        rows = rows.limit(1)
    got = rows.toArrow()
    tree = Tree(space, *vectors(got, 0, len(space.spreads), space.flags), -(-got.num_rows // cells))
    tree.leaves = []
    return tree


def placed(tree: Tree, numbers: int):
    """Adds the cell to batches with columns x0.. and h0.."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [f"x{i}" for i in range(numbers)] + [f"h{i}" for i in range(tree.space.flags)]
            cell = tree.find(*vectors(b.select(names), 0, numbers, tree.space.flags))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

    return run


def boxes_of(rows, numbers: int, flags: int):
    """(cells, their boxes) from rows with the least and greatest of each column."""
    number = lambda v, none: none if v is None else v
    cells = np.array([r["cell"] for r in rows], dtype=np.int64)
    lo = np.array([[number(r[f"lox{i}"], np.inf) for i in range(numbers)] for r in rows], dtype=float).reshape(len(rows), numbers)
    hi = np.array([[number(r[f"hix{i}"], -np.inf) for i in range(numbers)] for r in rows], dtype=float).reshape(len(rows), numbers)
    flag = [np.array([[r[f"{n}h{i}"] for i in range(flags)] for r in rows], dtype=np.int64).reshape(len(rows), flags) for n in ("lo", "hi")]
    return cells, (lo, hi, *flag)


def meeting(space: Space, k: int):
    """The nearest rows that asked vectors have among a cell's: their columns, with distances and keys, nearest first."""

    def run(asked: pa.Table, offered: pa.Table) -> pa.Table:
        numbers = len(space.spreads)
        names = [f"x{i}" for i in range(numbers)]
        codes = []
        for i in range(space.flags):
            both = pa.chunked_array([*asked[f"f{i}"].chunks, *offered[f"f{i}"].chunks], pa.string()).combine_chunks()
            codes.append(both.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64))
        flags = np.stack(codes, 1) if codes else np.zeros((asked.num_rows + offered.num_rows, 0), np.int64)
        lists = offered["keys"].combine_chunks()
        lengths, values = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
        held = np.arange(k)[None, :] < lengths[:, None]
        keys = np.zeros(held.shape, dtype=np.int64)
        keys[held] = values
        most = asked["most"].to_numpy() if asked.num_rows else np.zeros(0)
        most = np.array([NONE if m is None or m != m else int(m) for m in most.tolist()], dtype=np.int64)
        d, found = search(space, (vectors(asked.select(names), 0, numbers, 0)[0], flags[: asked.num_rows]), most, (vectors(offered.select(names), 0, numbers, 0)[0], flags[asked.num_rows :]), np.ma.masked_array(keys, ~held), k)
        some = d >= 0
        edges = pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32))
        out = [*asked.columns, pa.ListArray.from_arrays(edges, pa.array(d[some])), pa.ListArray.from_arrays(edges, pa.array(found[some]))]
        return pa.Table.from_arrays(out, names=[*asked.schema.names, "ds", "ks"])

    return run


def beyond(space: Space, boxes, k: int):
    """From vectors with what their own cell has, a row for each other cell that may hold as near ones, and how near they must be."""
    cells, edges = boxes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                lists = b.column(b.schema.get_field_index("ds")).to_pylist()
                most = np.array([x[-1] if len(x) == k else NONE for x in lists], dtype=np.int64)
                names = [f"x{i}" for i in range(len(space.spreads))] + [f"h{i}" for i in range(space.flags)]
                near = space.bounds(vectors(b.select(names), 0, len(space.spreads), space.flags), edges) <= most[:, None]
                near &= cells[None, :] != b.column(b.schema.get_field_index("cell")).to_numpy()[:, None]
                row, cell = np.nonzero(near)
                if len(row):
                    out = b.select([c for c in b.schema.names if c not in ("cell", "most", "ds", "ks")]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells[cell].astype(np.int32)), pa.array(most[row])], names=[*out.schema.names, "cell", "most"])

    return run
