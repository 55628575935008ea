"""Products of a group of sparse vectors with all vectors, which a task reads from the shared folder slice by slice.

All vectors lie in one table by ranges of id. Keys that many vectors hold are hot: their part of the product is one of dense matrices, over distinct hot
parts only where they repeat. The other keys meet through postings, so a pair costs only what it shares. Neither the driver nor a shuffle holds a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, parallelism

#: A key is hot if one of so many vectors holds it.
HOT_SHARE = 50
#: Numbers in one block of products or one dense part, shared entries met at once, entries of a slice, at most.
BLOCK_CELLS, MEETINGS, SLICE_ENTRIES = 4_000_000, 2_000_000, 2_000_000
#: Rows of the first slice, and how much larger than all before it each further one is.
FIRST_ROWS, GROWTH = 4096, 3
#: Distinct hot parts are looked for up to so many hot keys.
REPEATED_KEYS = 64


class Rows(NamedTuple):
    ids: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    sizes: np.ndarray
    #: A further column of numbers.
    extra: np.ndarray | None = None

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))

    def scaled(self) -> np.ndarray:
        return self.values / np.repeat(self.sizes, np.diff(self.offsets))


class Stored(NamedTuple):
    """Vectors ``(id, keys, values, size)`` in files by ranges of id, and their hot keys."""

    table: DataFrame
    files: list[str]
    hot: np.ndarray


def store(vectors: DataFrame, *extra: str) -> Stored:
    spark = vectors.sparkSession
    table = cut(vectors.select("id", "keys", "values", "size", *extra).repartitionByRange(parallelism(spark), "id").sortWithinPartitions("id"), "vectors")
    n = table.count()
    hot = table.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT_SHARE > n)  # of the entries of a row, HOT_SHARE keys a row at most
    return Stored(table, sorted(table.inputFiles()), np.sort(np.array([r["k"] for r in hot.collect()], np.int64)))


def rows_of(batches: list[pa.RecordBatch], extra: str | None = None) -> Rows:
    whole = pa.Table.from_batches(batches).combine_chunks()
    ids, sizes = (whole.column(c).to_numpy() for c in ("id", "size"))
    more = whole.column(extra).to_numpy() if extra else None
    lists = [whole.column(c).combine_chunks() for c in ("keys", "values")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    offsets = lists[0].offsets.to_numpy().astype(np.int64)
    keys, values = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    by_id = np.argsort(ids, kind="stable")
    offsets = offsets - offsets[0]
    if not np.array_equal(by_id, np.arange(len(ids))):
        at = spread(offsets[by_id], np.diff(offsets)[by_id])
        ids, sizes, keys, values, offsets = ids[by_id], sizes[by_id], keys[at], values[at], np.r_[0, np.cumsum(np.diff(offsets)[by_id])]
        more = more[by_id] if extra else None
    return Rows(ids, offsets, keys.astype(np.int64), values.astype(np.float64), sizes.astype(np.float64), more)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, ``count`` numbers."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def read_slices(files: list[str], first_rows: int, most_rows: int, extra: str | None = None) -> Iterator[Rows]:
    """All rows by ascending id, in slices of ``first_rows`` and then ``GROWTH`` times all rows before, up to ``most_rows``."""
    from urllib.parse import unquote

    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    held, count, entries, before, goal = [], 0, 0, 0, min(first_rows, most_rows)
    for path in map(unquote, files):
        where, inner = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
        with where.open_input_file(inner) as source:
            for whole in pq.ParquetFile(source).iter_batches(batch_size=max(1, min(16_384, most_rows)), columns=["id", "keys", "values", "size", *([extra] if extra else [])]):
                while whole.num_rows:
                    part = whole.slice(0, goal - count)
                    whole = whole.slice(part.num_rows)
                    held.append(part)
                    count += part.num_rows
                    entries += len(part.column(1).flatten())
                    if count >= goal or entries >= SLICE_ENTRIES:
                        yield rows_of(held, extra)
                        before += count
                        held, count, entries, goal = [], 0, 0, min(GROWTH * before, most_rows)
    if held:
        yield rows_of(held, extra)


class Part:
    """Rows, their hot part as a dense matrix and the others' entries."""

    def __init__(self, rows: Rows, hot: np.ndarray, values: np.ndarray | None = None):
        values = rows.scaled() if values is None else values
        self.ids, self.n, row = rows.ids, len(rows.ids), rows.row()
        at = np.searchsorted(hot, rows.keys)
        is_hot = hot[np.minimum(at, len(hot) - 1)] == rows.keys if len(hot) else np.zeros(len(rows.keys), bool)
        self.dense = np.bincount(row[is_hot] * len(hot) + at[is_hot], values[is_hot], self.n * len(hot)).reshape(self.n, len(hot))
        self.row, self.key, self.value = row[~is_hot], rows.keys[~is_hot], values[~is_hot]

    def post(self) -> Part:
        """Sorts the other entries by key, to be met."""
        by_key = np.argsort(self.key, kind="stable")
        self.row, self.key, self.value = self.row[by_key], self.key[by_key], self.value[by_key]
        return self

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hot parts, and of each where its rows begin in a list of rows, and how many."""
        if not 0 < self.dense.shape[1] <= REPEATED_KEYS:
            if self.dense.shape[1]:
                return self.dense, np.arange(self.n), np.ones(self.n, np.int64), np.arange(self.n)
            return self.dense[:1], np.zeros(1, np.int64), np.array([self.n]), np.arange(self.n)
        flat = np.ascontiguousarray(self.dense).view(np.dtype((np.void, 8 * self.dense.shape[1]))).ravel()
        _, one, of, count = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        return self.dense[one], np.cumsum(count) - count, count, np.argsort(of, kind="stable")


def met(asked: Part, part: Part, most: int = MEETINGS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows of ``asked``, first and end: every meeting of two entries with one key that isn't hot, as ``row of asked * part.n + row``, and its product."""
    low, high = np.searchsorted(part.key, asked.key, "left"), np.searchsorted(part.key, asked.key, "right")
    ends = np.r_[0, np.cumsum(np.bincount(asked.row, high - low, asked.n).astype(np.int64))]
    edges = np.searchsorted(asked.row, np.arange(asked.n + 1))
    first = 0
    while first < asked.n:
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        e = slice(edges[first], edges[end])
        count = high[e] - low[e]
        at = spread(low[e], count)
        yield first, end, np.repeat(asked.row[e] * part.n, count) + part.row[at], np.repeat(asked.value[e], count) * part.value[at]
        first = end


def summed(pair: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, and their sums."""
    order = np.argsort(pair)
    pair, x = pair[order], x[order]
    begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
    return pair[begin], np.add.reduceat(x, begin) if len(begin) else x


def _rounded(s: np.ndarray) -> np.ndarray:
    return np.round(s, 12) + 0.0


class Best:
    """The ``k`` best of each row of ``asked`` so far, ties to the smaller id: flat, by row and then rank."""

    def __init__(self, asked: Part, k: int):
        self.asked, self.k = asked, k
        self.q, self.s, self.id = np.empty(0, np.int32 if asked.n > 32_000 else np.int16), np.empty(0), np.empty(0, np.int64)
        self.least = np.full(asked.n, -np.inf)

    def add(self, part: Part) -> None:
        """``part`` has larger ids than all before."""
        found = list((self._beyond if len(self.q) else self._first)(part))
        pair, s = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        by_pair = np.argsort(pair)
        pair, s = pair[by_pair], s[by_pair]
        q, ids = np.r_[self.q, (pair // part.n).astype(self.q.dtype)], np.r_[self.id, part.ids[pair % part.n]]
        s = np.r_[self.s, s]
        order = np.argsort(-s, kind="stable")  # of equal ones, ids ascend
        order = order[np.argsort(q[order], kind="stable")]
        q = q[order]
        kept = order[self._place(q) < self.k]
        self.s, self.id = s[kept], ids[kept]
        self.q = np.sort(q, kind="stable")[self._place(q) < self.k]
        full = np.flatnonzero(self._place(self.q) == self.k - 1)
        self.least[self.q[full]] = self.s[full]

    def _place(self, q: np.ndarray) -> np.ndarray:
        return np.arange(len(q)) - np.searchsorted(q, np.arange(self.asked.n, dtype=q.dtype))[q]

    def rank(self) -> np.ndarray:
        return self._place(self.q) + 1

    def _first(self, part: Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keep = min(self.k, part.n)
        step = max(1, BLOCK_CELLS // part.n)
        for first, end, pair, x in met(self.asked, part):
            pair, x = summed(pair, x)
            for a in range(first, end, step):
                b = min(a + step, end)
                s = self.asked.dense[a:b] @ part.dense.T
                own = slice(*np.searchsorted(pair, (a * part.n, b * part.n)))
                s.ravel()[pair[own] - a * part.n] += x[own]
                s = _rounded(s)
                least = np.partition(s, part.n - keep, axis=1)[:, part.n - keep, None]
                above, level = s > least, s == least
                wanted = above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= keep - above.sum(axis=1)[:, None]))
                r, c = np.nonzero(wanted)
                yield (r + a) * part.n + c, s[r, c]

    def _beyond(self, part: Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is above the k-th of its row so far: pairs that share a key that isn't hot by their full sum, all others by the hot part."""
        hot, begins, counts, members = part.repeated()
        step = max(1, BLOCK_CELLS // len(hot))
        for first, end, pair, x in met(self.asked, part):
            pair, x = summed(pair, x)
            q, row = np.divmod(pair, part.n)
            for a in range(0, len(pair), BLOCK_CELLS // max(1, hot.shape[1])):
                own = slice(a, a + BLOCK_CELLS // max(1, hot.shape[1]))
                s = _rounded(x[own] + np.einsum("ij,ij->i", self.asked.dense[q[own]], part.dense[row[own]]))
                better = s > self.least[q[own]]
                yield pair[own][better], s[better]
            sharing = np.bincount(q - first, minlength=end - first)
            for a in range(first, end, step):
                b = min(a + step, end)
                s = self.asked.dense[a:b] @ hot.T
                r, c = np.nonzero(s > self.least[a:b, None] + 5e-13)
                # of a hot part's rows, ids ascending, k are enough beside those that share other keys
                count = np.minimum(counts[c], self.k + sharing[r + a - first])
                cells = np.repeat((r + a) * part.n, count) + members[spread(begins[c], count)]
                at = np.searchsorted(pair, cells)
                alone = pair[np.minimum(at, len(pair) - 1)] != cells if len(pair) else np.ones(len(cells), bool)
                yield cells[alone], np.repeat(_rounded(s[r, c]), count)[alone]


def best_of(asked: Rows, files: list[str], hot: np.ndarray, k: int) -> Best:
    best = Best(Part(asked, hot), k)
    for rows in read_slices(files, max(FIRST_ROWS, 4 * k), max(1, 2 * BLOCK_CELLS // max(1, len(hot)))):
        best.add(Part(rows, hot).post())
    return best


def sharing_pairs(asked: Rows, files: list[str], hot: np.ndarray, extra: str | None = None) -> Iterator[tuple[Rows, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of all rows, and in each the pairs that share a key and aren't one id: places in ``asked`` and in the slice, and the dot product."""
    most = max(1, BLOCK_CELLS // max(len(asked.ids), len(hot)))
    mine, marked = Part(asked, hot), Part(asked, hot, np.ones(len(asked.keys)))
    for rows in read_slices(files, most, most, extra):
        parts = [(mine, Part(rows, hot).post())]
        if len(asked.keys) and len(rows.keys) and min(asked.values.min(), rows.values.min()) <= 0:  # else a product above 0 tells that a key is shared
            parts.append((marked, Part(rows, hot, np.ones(len(rows.keys))).post()))
        made = []
        for one, other in parts:
            s = one.dense @ other.dense.T
            for first, end, pair, x in met(one, other):
                s[first:end] += np.bincount(pair - first * other.n, x, (end - first) * other.n).reshape(end - first, other.n)
            made.append(s)
        q, row = np.nonzero((made[-1] > 0) & (asked.ids[:, None] != rows.ids))
        yield rows, q, row, made[0][q, row]


def groups(spark, n: int, size: int) -> int:
    """Tasks of at most about ``size`` of ``n`` rows, one a core at least."""
    return max(1, -(-n // size), min(spark.sparkContext.defaultParallelism, -(-n // 64)))
