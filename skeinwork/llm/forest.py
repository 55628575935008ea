"""A forest of random-projection trees over sparse vectors, searched best leaf first through one queue for all trees.

A vector's projections are sums of its values with signs hashed from their keys, so no projection matrix exists and the number
of keys doesn't matter. Tree t splits at level l along its own direction; where a node splits is fitted on a bounded
sample. Search starts at the roots; turning off the near side of a split costs the squared distance to it, and the
cheapest open branch of all trees is followed down to its leaf until enough leaves are visited.
"""

from __future__ import annotations

import numpy as np

#: A node needs so many sample vectors for a split of its own; below, the level's median serves.
NODE_SAMPLE = 16


def hashed_signs(keys: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Signs +1/-1 of shape (keys, count), the same for a key wherever it occurs."""
    words = -(-count // 64)
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(1, words + 1, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1)[:, :count]
    return bits.astype(np.float32) * 2 - 1


def project(keys: np.ndarray, values: np.ndarray, offsets: np.ndarray, count: int, seed: int, block: int = 1 << 15) -> np.ndarray:
    """Projections (vectors, count) of vectors scaled to length 1; ``offsets`` are those of the flattened entries. Empty and zero vectors give 0."""
    n = len(offsets) - 1
    out = np.zeros((n, count), np.float32)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block, "right")) - 1)
        a, z = int(offsets[row]), int(offsets[end])
        lengths = np.diff(offsets[row : end + 1])
        live = np.flatnonzero(lengths)
        if len(live):
            own = np.repeat(np.arange(end - row), lengths)
            norms = np.sqrt(np.bincount(own, values[a:z] ** 2, end - row))
            norms[norms == 0] = 1
            scaled = (values[a:z] / norms[own]).astype(np.float32)
            signed = hashed_signs(keys[a:z], count, seed)
            signed *= scaled[:, None]
            out[row + live] = np.add.reduceat(signed, offsets[row:end][live] - a, axis=0)
        row = end
    return out


class Forest:
    """Split points of ``trees`` trees of ``depth`` levels; ``sample`` holds projections (vectors, trees * depth)."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int):
        self.trees, self.depth = trees, depth
        shaped = sample.reshape(len(sample), trees, depth)
        self.level = np.median(shaped, axis=0) if len(sample) else np.zeros((trees, depth), np.float32)
        self.fitted = min(depth, max(0, int(np.log2(max(len(sample) / NODE_SAMPLE, 1)))))
        self.split = [np.repeat(self.level[:, l, None], 1 << l, axis=1) for l in range(self.fitted)]
        for t in range(trees):
            code = np.zeros(len(sample), np.int64)
            for l in range(self.fitted):
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0]) if len(code) else []
                for rows in np.split(order, starts[1:]):
                    if len(rows) >= NODE_SAMPLE:
                        self.split[l][t, code[rows[0]]] = np.median(shaped[rows, t, l])
                code = code * 2 + (shaped[:, t, l] > self.split[l][t, code])

    def _points(self, level: int, tree: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.split[level][tree, code] if level < self.fitted else self.level[tree, level]

    def leaves(self, projected: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf each vector lies in, numbered across the forest."""
        shaped = projected.reshape(len(projected), self.trees, self.depth)
        tree = np.broadcast_to(np.arange(self.trees), (len(projected), self.trees))
        code = np.zeros(tree.shape, np.int64)
        for l in range(self.depth):
            code = code * 2 + (shaped[:, :, l] > self._points(l, tree, code))
        return (tree.astype(np.int64) << self.depth) + code

    def search(self, projected: np.ndarray, visits: int) -> np.ndarray:
        """(vectors, visits): leaves by cost, all trees through one queue; -1 where fewer exist."""
        n, trees, depth = len(projected), self.trees, self.depth
        shaped = projected.reshape(n, trees, depth)
        every = np.arange(n)
        width = trees + visits * depth
        cost = np.full((n, width), np.inf, np.float32)
        cost[:, :trees] = 0
        tree, level = np.zeros((n, width), np.int16), np.zeros((n, width), np.int16)
        tree[:, :trees] = np.arange(trees)
        code = np.zeros((n, width), np.int64)
        found = np.full((n, visits), -1, np.int64)
        for v in range(visits):
            pick = np.argmin(cost, axis=1)
            price = cost[every, pick]
            cost[every, pick] = np.inf
            t, start, c = tree[every, pick].astype(np.int64), level[every, pick], code[every, pick]
            for l in range(depth):
                on = start <= l
                here = np.where(on, c, 0) if l < self.fitted else c
                margin = shaped[every, t, l] - self._points(l, t, np.minimum(here, (1 << l) - 1))
                side = (margin > 0).astype(np.int64)
                slot = trees + v * depth + l
                cost[:, slot] = np.where(on, price + margin * margin, np.inf)
                tree[:, slot], level[:, slot], code[:, slot] = t, l + 1, c * 2 + 1 - side
                c = np.where(on, c * 2 + side, c)
            found[:, v] = np.where(np.isfinite(price), (t << depth) + c, -1)
        return found
