"""All links of similar records between linked groups: no pair at or above the threshold is left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, drop_cut
from .grouped import whole_groups

#: Records of a block at most, columns a vector is folded to, rows compared at once, and pairs compared in full at once.
BLOCK, FOLD, STRIP, PAIRS = 8192, 512, 256, 20_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def signatures(records: DataFrame, threshold: float) -> DataFrame:
    """``(t, id)``: terms of each of ``records(id, keys, values)``, so that two records of a cosine at or above ``threshold`` share one.

    Terms have one order for all records, those of few records and much of their content first. A record's signature is its first terms up to where the
    rest has less than ``threshold`` of its length: of two records, the common terms outside both signatures lie in the rest of one of them, and can't reach it.
    """
    whole = F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x)
    entries = records.select("id", whole.alias("q"), F.explode(F.arrays_zip("keys", "values")).alias("e")).select("id", "q", F.col("e.keys").alias("t"), (F.col("e.values") * F.col("e.values")).alias("m"))
    share = F.ceil(F.col("m") / F.col("q") * F.lit(1 << 20)).cast("long")  # whole numbers: the same sum in any order
    place = cut(entries.groupBy("t").agg((F.pow(F.count(F.lit(1)), F.lit(2)) / F.sum(share)).alias("place")), "places")
    placed = entries.join(broadcast_if_small(place, place.count(), 24), "t")
    rest = F.sum("m").over(W.partitionBy("id").orderBy(F.desc("place"), F.desc("t")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return placed.select("t", "id", "q", rest.alias("rest")).filter(F.col("rest") >= F.lit(threshold * threshold * (1 - 1e-9)) * F.col("q")).select("t", "id")


def _blocks(postings: DataFrame) -> DataFrame:
    """``(t, i, j, part, id, g)``: for every two parts of ``postings(t, part, id, g)`` of a term that hold two groups, the records of both."""
    parts = postings.groupBy("t", "part").agg(F.min("g").alias("low"), F.max("g").alias("high"))
    x, y = parts.toDF("t", "i", "low", "high"), parts.toDF("t", "j", "low2", "high2")
    met = x.join(y, "t").filter("i <= j AND NOT (low = high2 AND high = low2 AND low = high)").select("t", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
    return postings.join(met, ["t", "part"]).select("t", "i", "j", "part", "id", "g")


def _folded(row: np.ndarray, keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Vectors with terms of equal hash added up. No value is negative, so products are never less than those of the vectors."""
    column = ((keys.astype(np.uint64) * _MIX) >> np.uint64(32)).astype(np.int64) % FOLD
    return np.bincount(row * FOLD + column, values, n * FOLD).reshape(n, FOLD).astype(np.float32)


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after the links x, y between them, and which of the links joined two."""
    label, used = label.tolist(), []

    def root(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        a, b = root(a), root(b)
        if a != b:
            label[max(a, b)] = min(a, b)
            used.append(k)
    return np.array([root(k) for k in range(len(label))]), np.array(used, int)


def _links_of_blocks(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64()), ("x", pa.int64()), ("y", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, ["t", "i", "j"]):
            for start, end in zip(bounds, bounds[1:]):
                part = rows.slice(start, end - start)
                ids, groups, side = (part.column(c).to_numpy() for c in ("id", "g", "part"))
                n, single = len(ids), part.column("i")[0].as_py() == part.column("j")[0].as_py()
                first = n if single else int((side == side[0]).sum())
                offsets = np.diff(part.column("keys").offsets.to_numpy())
                keys, values = part.column("keys").flatten().to_numpy(), part.column("values").flatten().to_numpy()
                row = np.repeat(np.arange(n), offsets)
                begin = np.concatenate([[0], np.cumsum(offsets)])
                sizes = np.bincount(row, values * values, n)
                names, keys_at = np.unique(keys, return_inverse=True)
                codes = row * len(names) + keys_at  # ascending: keys are in order in each record
                folded = _folded(row, keys, values / np.sqrt(sizes)[row], n)
                own, g = np.unique(groups, return_inverse=True)
                label = np.arange(len(own))
                out: list[tuple] = []
                for top in range(0, first, STRIP):
                    low = min(top + STRIP, first)
                    left = top if single else first
                    close = folded[top:low] @ folded[left:].T >= threshold - 1e-4
                    a, b = np.nonzero(close & (label[g[top:low], None] != label[g[left:]]))
                    a, b = a + top, b + left
                    if single:
                        a, b = a[a < b], b[a < b]
                    while len(a):
                        p, q, a, b = a[:PAIRS], b[:PAIRS], a[PAIRS:], b[PAIRS:]
                        many = offsets[p]
                        pair = np.repeat(np.arange(len(p)), many)
                        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[p][pair]
                        wanted = q[pair] * len(names) + keys_at[entry]
                        found = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
                        dots = np.bincount(pair, np.where(codes[found] == wanted, values[entry] * values[found], 0.0), len(p))
                        both = sizes[p] * sizes[q]
                        linked = np.flatnonzero((dots > 0) & (dots * dots >= threshold * threshold * both))  # exact for integer values
                        p, q, s = p[linked], q[linked], (dots / np.sqrt(both))[linked]
                        label, used = _joined(label, g[p], g[q])
                        apart = label[g[a]] != label[g[b]]
                        a, b = a[apart], b[apart]
                        out.append((ids[p[used]], ids[q[used]], s[used], groups[p[used]], groups[q[used]]))
                if sum(len(o[0]) for o in out):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def links_between(records: DataFrame, groups: DataFrame, threshold: float, *, block: int = BLOCK) -> DataFrame:
    """``(a, b, s, x, y)``: links a, b of similarity s >= ``threshold`` between groups x and y, so many that they join all groups that any link joins.

    ``records(id, keys, values)`` have unique ids, ascending keys and positive values; ``groups(id, component)`` are known linked groups, other records are groups of their own.
    Records that share a term of their signatures are compared block by block, unless in one group: first folded, which never gives less than the similarity, then in full.
    """
    known = groups.select("id", F.col("component").alias("g"))
    postings = signatures(records, threshold).join(known, "id", "left").select("t", F.coalesce("g", "id").alias("g"), "id")
    at = F.row_number().over(W.partitionBy("t").orderBy("g", "id"))  # a large group fills parts of its own
    postings = cut(postings.withColumn("part", F.floor((at - 1) / block)), "postings")
    laid = _blocks(postings).join(records.select("id", "keys", "values"), "id").repartition("t", "i", "j").sortWithinPartitions("t", "i", "j", "part")
    found = cut(laid.select("t", "i", "j", "part", "id", "g", "keys", "values").mapInArrow(_links_of_blocks(threshold), "a long, b long, s double, x long, y long"), "missed")
    drop_cut(postings)
    return found
