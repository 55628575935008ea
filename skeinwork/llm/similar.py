"""Most similar vectors for every vector, by a forest of random-projection trees and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, drop_cut, parallelism
from .forest import Forest, project

#: Vectors the split points are fitted on, at most. Every vector is indexed.
SAMPLE = 20_000
TREES, LEAF, VISITS = 16, 64, 32
#: Of searches for the nearest without a least similarity: rows of a leaf, leaves visited as a power of the number of vectors, and rows of a task.
NEAR_LEAF, VISIT_POWER, TASK_ROWS = 256, 0.43, 250_000
#: Bits of a vector's signature, and how many standard deviations above the expected disagreement of the least similarity a pair may lie.
SIGNATURE_BITS, SIGMAS = 256, 4.5
#: Rows of a leaf compared in one task; larger leaves are compared block by block.
LEAF_BLOCK = 4096
_SEED_TREES, _SEED_SIGNS = 1, 2


def to_vectors(entries: DataFrame, id_column: str, key: str, value: str, *, least: int = 1) -> DataFrame:
    """``(id, keys, values)`` of entries unique by id and key, keys ascending; ids with fewer than ``least`` entries are left out."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(key).cast("long").alias("k"), F.col(value).cast("double").alias("v"))))
    grouped = entries.groupBy(F.col(id_column).cast("long").alias("id")).agg(packed.alias("e"))
    return grouped.filter(F.size("e") >= least).select("id", F.col("e.k").alias("keys"), F.col("e.v").alias("values"))


def copy_classes(vectors: DataFrame) -> DataFrame:
    """``(id, class_id)``: vectors of equal content share the smallest id. Content is compared by two 64-bit hashes, so no task holds a class."""
    content = [F.xxhash64("keys", "values"), F.hash("keys", "values").cast("long") * F.lit(1 << 31) + F.hash("values", "keys").cast("long")]
    hashed = vectors.select("id", content[0].alias("h1"), content[1].alias("h2"))
    firsts = hashed.groupBy("h1", "h2").agg(F.min("id").alias("class_id"))
    return hashed.join(firsts, ["h1", "h2"]).select("id", "class_id")


def _flat(batch: pa.RecordBatch, keys: str = "keys", values: str = "values") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, v = batch.column(keys), batch.column(values)
    offsets = k.offsets.to_numpy() - k.offsets[0].as_py()
    return k.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False), offsets.astype(np.int64)


def _fit(vectors: DataFrame, n: int, trees: int, depth: int) -> Forest:
    share = min(1.0, SAMPLE / max(n, 1))
    picked = vectors.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = project(*_flat(batch), trees * depth, _SEED_TREES)
            yield pa.RecordBatch.from_arrays([pa.array(list(p), pa.list_(pa.float32()))], names=["p"])

    rows = picked.select("keys", "values").mapInArrow(run, "p array<float>").toArrow().column(0).combine_chunks()
    return Forest(rows.flatten().to_numpy().reshape(-1, trees * depth), trees, depth)


def _visits(forest: Forest, visits: int):
    """Rows (bucket, id, own, asks, sig): own for the leaves a vector lies in, else those it searches."""
    schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("own", pa.bool_()), ("asks", pa.bool_()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, p, own in _placed(forest, batches):
            ids, asks = batch.column("id").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            bits = np.packbits(project(*flat, SIGNATURE_BITS, _SEED_SIGNS) > 0, axis=1)
            buckets = [own.ravel()]
            rows = [np.repeat(np.arange(len(ids)), own.shape[1])]
            flags = [np.ones(own.size, bool)]
            if visits and forest.depth and asks.any():
                at = np.flatnonzero(asks)
                found = forest.search(p[at], visits)
                new = (found >= 0) & ~(found[:, :, None] == own[at][:, None, :]).any(2)
                r, c = np.nonzero(new)
                buckets.append(found[r, c])
                rows.append(at[r])
                flags.append(np.zeros(len(r), bool))
            rows = np.concatenate(rows)
            sigs = pa.array([b.tobytes() for b in bits], pa.binary()).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(ids[rows]), pa.array(np.concatenate(flags)), pa.array(asks[rows]), sigs], schema=schema)

    return run


def _placed(forest: Forest, batches: Iterator[pa.RecordBatch], rows: int = 4096):
    """``(batch, flattened entries, projections, leaves)`` of batches of at most ``rows`` vectors."""
    split = forest.trees * forest.depth
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            flat = _flat(batch)
            p = project(*flat, split, _SEED_TREES) if split else np.zeros((batch.num_rows, 0), np.float32)
            yield batch, flat, p, forest.leaves(p)


def _leaf_numbers(forest: Forest):
    """The leaves of each vector, as rows (bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, own in _placed(forest, batches):
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel())], names=["bucket"])

    return run


_LEAF_ROWS = "bucket long, own boolean, id long, keys array<long>, values array<double>"


def _leaf_rows(forest: Forest, visits: int):
    """Vectors laid out by leaf: own in each leaf a vector lies in, and once more, not own, in each leaf an asking vector visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, p, own in _placed(forest, batches, 1024):
            n = batch.num_rows
            at = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            found = forest.search(p[at], visits) if len(at) and forest.depth else np.zeros((len(at), 1), np.int64)
            r, c = np.nonzero(found >= 0)
            for rows, buckets, mine in ((np.repeat(np.arange(n), own.shape[1]), own.ravel(), True), (at[r], found[r, c], False)):
                for start in range(0, len(rows), 50_000):
                    taken = batch.take(pa.array(rows[start : start + 50_000]))
                    columns = [pa.array(buckets[start : start + 50_000]), pa.array(np.full(taken.num_rows, mine)), taken.column("id"), taken.column("keys"), taken.column("values")]
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "own", "id", "keys", "values"])

    return run


def _parts(offsets: np.ndarray, entries: int, rows: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``entries`` entries, or one row, and at most ``rows`` rows."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = min(n, start + rows, max(start + 1, int(np.searchsorted(offsets, offsets[start] + entries, "right")) - 1))
        yield start, end
        start = end


def _scaled(keys: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    lengths = np.sqrt(np.bincount(row, values * values, len(offsets) - 1))
    return values / np.where(lengths > 0, lengths, 1)[row]


def _first_k(query: np.ndarray, other: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` most similar different others of each query; ties to the smaller."""
    order = np.lexsort((other, -s, query))
    q, o = query[order], other[order]
    order = order[np.r_[True, (q[1:] != q[:-1]) | (o[1:] != o[:-1])]]  # repeats of a pair, of equal similarity, lie together
    q = query[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[place < k]


def _largest(s: np.ndarray, k: int) -> np.ndarray:
    """(rows, k): the columns of the ``k`` largest cells of each row, ties to the smaller column."""
    if s.shape[1] <= k:
        return np.tile(np.arange(s.shape[1]), (len(s), 1))
    if k > 16:
        return np.argsort(-s, axis=1, kind="stable")[:, :k]
    left, rows, out = s.copy(), np.arange(len(s)), np.empty((len(s), k), np.int64)
    for place in range(k):
        out[:, place] = left.argmax(1)
        left[rows, out[:, place]] = -np.inf
    return out


def _leaf_best(k: int, floor: float | None):
    """The ``k`` best own vectors of a leaf, by exact cosine, for each vector that visits it; of all leaves of a task together.

    Rows lie together by leaf, own ones first. A leaf's own vectors are laid out in dense parts of bounded size and the visitors pass by.
    """
    schema = pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # ids, keys, scaled values, offsets of own rows of the current leaf
        parts: list[tuple] = []
        best: list[tuple] = []
        size, current = 0, None

        def lay_out():
            for ids, keys, values, offsets in held:
                for a, z in _parts(offsets, 16_384, 512):
                    x, y = offsets[a], offsets[z]
                    names, at = np.unique(keys[x:y], return_inverse=True)
                    dense = np.zeros((len(names), z - a))
                    dense[at, np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1]))] = values[x:y]
                    parts.append((ids[a:z], names, dense))
            held.clear()

        def visit(ids, keys, values, offsets):
            for a, z in _parts(offsets, 1 << 20, 256):
                x, y = offsets[a], offsets[z]
                row = np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1]))
                for own, names, dense in parts:
                    at = np.searchsorted(names, keys[x:y])
                    at[at == len(names)] = 0
                    hit = names[at] == keys[x:y]
                    asked = np.zeros((z - a, len(names)))
                    asked[row[hit], at[hit]] = values[x:y][hit]
                    s = np.round(asked @ dense, 12)  # equal whatever the leaf
                    s[ids[a:z, None] == own[None, :]] = -np.inf
                    r, c = np.repeat(np.arange(z - a), min(k, len(own))), _largest(s, k).ravel()
                    value = s[r, c]
                    ok = np.isfinite(value) if floor is None else value >= floor - 1e-12
                    if ok.any():
                        yield ids[a:z][r[ok]], own[c[ok]], value[ok]

        def reduce():
            q, o, s = (np.concatenate(c) for c in zip(*best))
            keep = _first_k(q, o, s, k)
            best[:] = [(q[keep], o[keep], s[keep])]
            return len(keep)

        def give():
            reduce()
            out = pa.RecordBatch.from_arrays([pa.array(c) for c in best[0]], schema=schema)
            best.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, i, j = (batch.column(c).to_numpy() for c in ("bucket", "i", "j"))
            own, ids = batch.column("own").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
            keys, values, offsets = _flat(batch)
            values = _scaled(keys, values, offsets)
            edges = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(own) != 0)) + 1
            for a, z in zip(np.r_[0, edges], np.r_[edges, len(ids)]):
                leaf = (bucket[a], i[a], j[a])
                if leaf != current:
                    held.clear()
                    parts.clear()
                    current = leaf
                x, y = offsets[a], offsets[z]
                rows = (ids[a:z], keys[x:y], values[x:y], offsets[a : z + 1] - x)
                if own[a]:
                    held.append(rows)
                    continue
                lay_out()
                for found in visit(*rows):
                    best.append(found)
                    size += len(found[0])
                if size > 2_000_000:
                    size = reduce()
                    if size > 1_000_000:
                        yield give()
                        size = 0
        if best:
            yield give()

    return run


def _compare(cutoff: int):
    """Candidate pairs (a, b) of buckets whose rows lie together, in order of their bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    width = SIGNATURE_BITS // 64

    def pairs(ids: np.ndarray, own: np.ndarray, asks: np.ndarray, sigs: np.ndarray, block: np.ndarray, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.flatnonzero(own)
        for start in range(0, len(rows), 256):
            part = rows[start : start + 256]
            apart = np.zeros((len(part), len(ids)), np.uint16)
            for w in range(width):
                apart += np.bitwise_count(sigs[part, w, None] ^ sigs[None, :, w])
            near = (apart <= cutoff) & (ids[part, None] != ids[None, :]) & (asks[part, None] | asks[None, :])
            if both:  # two different blocks: pairs inside one are another task's
                near &= block[part, None] != block[None, :]
            r, c = np.nonzero(near)
            yield ids[part[r]], ids[c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def finish():
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            bucket, i, j, block, ids, own, asks, sigs = columns
            edges = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            found = []
            for a, z in zip(np.r_[0, edges], np.r_[edges, len(ids)]):
                if z - a > 1:
                    found.extend(pairs(ids[a:z], own[a:z], asks[a:z], sigs[a:z], block[a:z], i[a] != j[a]))
            if found:
                x, y = (np.concatenate(c) for c in zip(*found))
                low, high = np.minimum(x, y), np.maximum(x, y)
                order = np.lexsort((high, low))
                low, high = low[order], high[order]
                first = np.r_[True, (np.diff(low) != 0) | (np.diff(high) != 0)] if len(low) else np.empty(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(low[first]), pa.array(high[first])], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(-1, width)
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j", "block", "id", "own", "asks")) + (sigs,)
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            start = int(np.argmax(last))  # the last bucket may go on in the next batch
            if start or (held and (held[-1][0][-1], held[-1][1][-1], held[-1][2][-1]) != (now[0][0], now[1][0], now[2][0])):
                if start:
                    held.append(tuple(c[:start] for c in now))
                yield from finish()
                held.append(tuple(c[start:] for c in now))
            else:
                held.append(now)
        if held:
            yield from finish()

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact cosine of vector pairs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    for batch in batches:
        ka, va, oa = _flat(batch, "ka", "va")
        kb, vb, ob = _flat(batch, "kb", "vb")
        n = batch.num_rows
        ra, rb = np.repeat(np.arange(n), np.diff(oa)), np.repeat(np.arange(n), np.diff(ob))
        names, at = np.unique(np.concatenate([ka, kb]), return_inverse=True)
        # pair and key in one number; ascending, as keys are inside a vector
        _, p, q = np.intersect1d(ra * len(names) + at[: len(ka)], rb * len(names) + at[len(ka) :], assume_unique=True, return_indices=True)
        dots = np.bincount(ra[p], va[p] * vb[q], n)
        sizes = np.sqrt(np.bincount(ra, va * va, n) * np.bincount(rb, vb * vb, n))
        out = np.divide(dots, sizes, out=np.zeros(n), where=sizes > 0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], schema=schema)


def _prepared(vectors: DataFrame, queries: DataFrame | None) -> tuple[DataFrame, DataFrame, int, int]:
    """``(own, classes, n, asking)``: one vector of each class with whether it ``asks``, the classes, and how many there are."""
    lengths = F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x)
    good = cut(vectors.filter(F.col("id").isNotNull() & F.col("keys").isNotNull() & (lengths > 0)).select("id", "keys", "values"), "vectors")
    classes = cut(copy_classes(good), "classes")
    firsts = classes.filter(F.col("id") == F.col("class_id")).select("id")
    own = good.join(firsts, "id", "left_semi")
    if queries is None:
        own = own.withColumn("asks", F.lit(True))
    else:
        asking = classes.join(queries.select("id"), "id", "left_semi").select(F.col("class_id").alias("id")).distinct().withColumn("asks", F.lit(True))
        own = own.join(asking, "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    own = cut(own, "distinct-vectors")
    drop_cut(good)
    n, asking = own.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    return own, classes, n, asking


def _forest(own: DataFrame, n: int, trees: int, leaf: int) -> Forest:
    depth = max(0, round(np.log2(max(n / leaf, 1))))
    return _fit(own, n, trees, depth) if depth else Forest(np.zeros((0, 0), np.float32), 1, 0)


def _large_leaves(buckets: DataFrame, leaf_block: int) -> tuple[DataFrame, int]:
    """``(bucket, blocks)`` of leaves above ``leaf_block`` rows, and how many there are: at most rows / ``leaf_block``."""
    large = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf_block).select("bucket", F.ceil(F.col("n") / leaf_block).cast("int").alias("blocks"))
    large = cut(large, "large-leaves")
    return large, large.count()


def similar_pairs(
    vectors: DataFrame, *, min_similarity: float, queries: DataFrame | None = None, trees: int = TREES, leaf: int = LEAF, visits: int = VISITS, leaf_block: int = LEAF_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """``(pairs, classes)``: pairs ``(a, b, similarity)``, a < b, of different vectors of at least ``min_similarity`` found by the forest, and ``(id, class_id)``.

    ``vectors(id, keys, values)`` have unique ids, ascending unique keys and finite values; null ids, null vectors and
    vectors without a value other than 0 are left out. Vectors of equal content form a class named by its smallest id, and pairs
    name classes. Candidates are sieved by their signatures before the exact cosine, which decides.
    ``queries(id)`` limits which vectors search; all are indexed. An empty table gives no row.
    """
    own, classes, n, _ = _prepared(vectors, queries)
    forest = _forest(own, n, trees, leaf)
    shipped = own.sparkSession.sparkContext.broadcast(forest)  # of fitted depth, so bounded by the sample

    def visit(batches):
        yield from _visits(shipped.value, visits)(batches)

    rows = cut(own.mapInArrow(visit, "bucket long, id long, own boolean, asks boolean, sig binary"), "visits")
    large, large_count = _large_leaves(rows, leaf_block)
    zero = F.lit(0).cast("int")
    if large_count:
        rows = rows.join(broadcast_if_small(large, large_count, 32), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    else:
        rows = rows.withColumns({"block": zero, "i": zero, "j": zero})
    share = np.arccos(np.clip(min_similarity, -1, 1)) / np.pi
    cutoff = int(np.ceil(SIGNATURE_BITS * share + SIGMAS * np.sqrt(SIGNATURE_BITS * share * (1 - share))))
    laid = rows.select("bucket", "i", "j", "block", "id", "own", "asks", "sig").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    candidates = cut(laid.mapInArrow(_compare(cutoff), "a long, b long").distinct(), "candidates")
    left = own.select(F.col("id").alias("a"), F.col("keys").alias("ka"), F.col("values").alias("va"))
    right = own.select(F.col("id").alias("b"), F.col("keys").alias("kb"), F.col("values").alias("vb"))
    scored = candidates.join(left, "a").join(right, "b").select("a", "b", "ka", "va", "kb", "vb").mapInArrow(_score, "a long, b long, similarity double")
    return scored.filter(F.col("similarity") >= min_similarity - 1e-12), classes


def expand_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b, similarity)``, a < b, of members: pairs of similar classes and, with similarity 1, those inside a class. For results known to be few a vector."""
    x, y = classes.select(F.col("class_id").alias("a"), F.col("id").alias("x")), classes.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    between = pairs.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    shared = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("class_id")
    several = classes.join(shared, "class_id", "left_semi")
    inside = several.alias("l").join(several.alias("r"), (F.col("l.class_id") == F.col("r.class_id")) & (F.col("l.id") < F.col("r.id")))
    return between.unionByName(inside.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.lit(1.0).alias("similarity")))


def nearest(
    vectors: DataFrame, k: int, *, queries: DataFrame | None = None, min_similarity: float | None = None, exact: bool = False,
    trees: int = TREES, leaf: int = NEAR_LEAF, visits: int | None = None, leaf_block: int = LEAF_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """``(neighbours, classes)``: for each (querying) class its ``k`` most similar other classes, ``(id, neighbour, similarity, rank)``; ties to the smaller id.

    Vectors, ``queries`` and classes as in :func:`similar_pairs`. Every querying vector visits ``visits`` leaves of the forest through one queue, by default n to the
    power of VISIT_POWER for n vectors, as the neighbours of a vector without very similar ones spread over more leaves the more vectors there are. Vectors are scored
    where their leaf lies, as one product of matrices, and only the ``k`` best of a leaf leave the task. ``exact`` compares every querying vector with all vectors, block by
    block. ``min_similarity`` leaves out lower ones; without it a vector with fewer than ``k`` others visited has fewer rows. An empty table gives no row.
    """
    own, classes, n, asking = _prepared(vectors, queries)
    forest = Forest(np.zeros((0, 0), np.float32), 1, 0) if exact else _forest(own, n, trees, leaf)
    visits = max(forest.trees, round(n**VISIT_POWER)) if visits is None else visits
    shipped = own.sparkSession.sparkContext.broadcast(forest)  # of fitted depth, so bounded by the sample

    def number(batches):
        yield from _leaf_numbers(shipped.value)(batches)

    def visit(batches):
        yield from _leaf_rows(shipped.value, visits)(batches)

    large, large_count = _large_leaves(own.mapInArrow(number, "bucket long"), leaf_block)
    rows = own.mapInArrow(visit, _LEAF_ROWS)
    zero = F.lit(0).cast("int")
    if large_count:  # own vectors of a block j of the leaf meet its visitors of a block i in one task
        rows = rows.join(broadcast_if_small(large, large_count, 32), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        rows = rows.withColumns({"i": F.when(F.col("own"), F.col("other")).otherwise(F.col("block")), "j": F.when(F.col("own"), F.col("block")).otherwise(F.col("other"))})
    else:
        rows = rows.withColumns({"i": zero, "j": zero})
    parts = max(parallelism(own.sparkSession), (n * forest.trees + asking * visits) // TASK_ROWS)
    laid = rows.select("bucket", "i", "j", "own", "id", "keys", "values").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.desc("own"), "id")
    found = laid.mapInArrow(_leaf_best(k, min_similarity), "id long, neighbour long, similarity double")
    found = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k), classes


def nearest_members(neighbours: DataFrame, classes: DataFrame, k: int, asked: Column | None = None) -> DataFrame:
    """``(id, neighbour, similarity, rank)``: for each member of a class, or those ``asked``, its ``k`` nearest other members, copies included, of the result of :func:`nearest`; ties to the smaller id.

    No class gives more than its ``k`` + 1 smallest ids, so a large class makes no pairs.
    """
    first = classes.withColumn("n", F.row_number().over(W.partitionBy("class_id").orderBy("id"))).filter(F.col("n") <= k + 1)
    offered = first.select(F.col("class_id").alias("near"), F.col("id").alias("neighbour"))
    asking = classes if asked is None else classes.filter(asked)
    copies = asking.join(offered.withColumnRenamed("near", "class_id"), "class_id").filter("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("similarity"))
    near = neighbours.select(F.col("id").alias("class_id"), F.col("neighbour").alias("near"), "similarity")
    others = asking.join(near, "class_id").join(offered, "near").select("id", "neighbour", "similarity")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return copies.unionByName(others).withColumn("rank", rank).filter(F.col("rank") <= k)
