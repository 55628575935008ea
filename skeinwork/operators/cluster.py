"""k-means over sparse vectors with cosine or Euclidean similarity, seeding, and the driver loop.

Vectors are (id, keys, values); centroids are means of the unscaled vectors, cosine serving for assignment only. The centroids of an
iteration go to the tasks in dense blocks of bounded size, so assignment shuffles nothing but the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, drop_cut
from . import slices
from .topk import sample

#: Numbers of one block of centroids, centroids times distinct keys, at most.
BLOCK_CELLS = 8_000_000
#: Query documents of a task and rows of a batch that leaves it, at most.
GROUP_ROWS, ROWS_OUT = 256, 500_000
PART = "__part"


def _nearest(ids: np.ndarray, names: np.ndarray, dense: np.ndarray, euclidean: bool):
    schema = pa.schema([("id", pa.int64()), ("cluster_id", pa.int64()), ("s", pa.float64())])
    squares = (dense * dense).sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                keys, values = batch.column("keys"), batch.column("values")
                offsets = keys.offsets.to_numpy() - keys.offsets[0].as_py()
                flat_keys, flat = keys.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                at = np.minimum(np.searchsorted(names, flat_keys), len(names) - 1)
                known = np.flatnonzero(names[at] == flat_keys)
                used, local = np.unique(at[known], return_inverse=True)
                own = np.zeros((batch.num_rows, len(used)))
                own[row[known], local] = flat[known]
                dots = own @ dense[used]
                sizes = np.bincount(row, flat * flat, batch.num_rows)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = -(sizes[:, None] + squares[None, :] - 2 * dots) if euclidean else dots / np.sqrt(sizes[:, None] * squares[None, :])
                s = np.round(np.nan_to_num(s, nan=0.0), 9) + 0.0
                best = s.argmax(axis=1)  # ids ascend, so ties go to the smaller
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids[best]), pa.array(s[np.arange(len(s)), best])], schema=schema)

    return run


def assign(vectors: DataFrame, centroids: DataFrame, *, euclidean: bool = False, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``(id, cluster_id, s)``: the most similar of ``centroids(cluster_id, key, weight)`` for each vector, ties to the smaller cluster.

    s is the cosine, or minus the squared distance, which orders as 1 / distance does; both rounded to 9 places. A vector or centroid of length 0 has cosine 0.
    """
    ids = sorted(r[0] for r in centroids.select("cluster_id").distinct().collect())  # one a cluster
    width = centroids.agg(F.count_distinct("key")).first()[0]
    size = max(1, block_cells // max(width, 1))
    found = None
    for b in range(0, len(ids), size):
        block = ids[b : b + size]
        rows = centroids.filter(F.col("cluster_id").isin(block)).select("cluster_id", F.col("key").cast("long").alias("key"), F.col("weight").cast("double").alias("weight")).toArrow()
        cluster, key, weight = (rows.column(c).to_numpy() for c in ("cluster_id", "key", "weight"))
        names, at = np.unique(key, return_inverse=True)
        dense = np.zeros((len(names), len(block)))
        np.add.at(dense, (at, np.searchsorted(block, cluster)), weight)
        shipped = vectors.sparkSession.sparkContext.broadcast((np.array(block), names, dense))  # of at most block_cells cells

        def run(batches, shipped=shipped):
            yield from _nearest(*shipped.value, euclidean)(batches)

        one = vectors.select("id", "keys", "values").mapInArrow(run, "id long, cluster_id long, s double")
        found = one if found is None else found.unionByName(one)
    if len(ids) <= size:
        return found
    best = F.max_by(F.struct("cluster_id", "s"), F.struct("s", -F.col("cluster_id")))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.cluster_id", "b.s")


def centroids_of(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(cluster_id, key, weight)``: mean vectors of the clusters."""
    placed = vectors.join(assigned.select("id", "cluster_id"), "id")
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    entries = placed.select("cluster_id", F.explode(F.arrays_zip("keys", "values")).alias("e"))
    sums = entries.groupBy("cluster_id", F.col("e.keys").alias("key")).agg(F.sum("e.values").alias("w"))
    return sums.join(F.broadcast(sizes), "cluster_id").select("cluster_id", "key", (F.col("w") / F.col("n")).alias("weight"))  # one row a cluster


def seeds_from(vectors: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Centroids 0, 1, ... from the vectors of ``ids``, in their order; of a table ``(cluster_id, id)`` as given."""
    spark = vectors.sparkSession
    if not isinstance(ids, DataFrame):
        ids = spark.createDataFrame(list(enumerate(ids)), "cluster_id long, id long")
    return vectors.join(F.broadcast(ids), "id").select("cluster_id", F.explode(F.arrays_zip("keys", "values")).alias("e")).select("cluster_id", F.col("e.keys").alias("key"), F.col("e.values").alias("weight"))


def first_ids(vectors: DataFrame, count: int) -> list[int]:
    return [r[0] for r in vectors.select("id").orderBy("id").limit(count).collect()]


def random_ids(vectors: DataFrame, count: int, seed: int) -> list[int]:
    """``count`` ids without replacement, by seeded lot."""
    return [r[0] for r in sample(vectors.select("id"), "id", count, seed).collect()]


def _distances(vectors: DataFrame, seed_id: int) -> DataFrame:
    """``(id, d2)``: squared Euclidean distance to one vector, sent to the tasks as sorted arrays."""
    row = vectors.filter(F.col("id") == seed_id).first()
    names, weights = np.array(row["keys"], np.int64), np.array(row["values"], np.float64)
    shipped = vectors.sparkSession.sparkContext.broadcast((names, weights))  # one vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shipped.value
        size = float(weights @ weights)
        for batch in batches:
            keys, values = batch.column("keys"), batch.column("values")
            offsets = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            flat_keys, flat = keys.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            d2 = np.bincount(own, flat * flat, batch.num_rows) + size
            if len(names):
                at = np.minimum(np.searchsorted(names, flat_keys), len(names) - 1)
                d2 = d2 - 2 * np.bincount(own, np.where(names[at] == flat_keys, flat * weights[at], 0.0), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(d2)], names=["id", "d2"])

    if PART not in vectors.columns:
        return vectors.select("id", "keys", "values").mapInArrow(run, "id long, d2 double")

    def with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in run(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(PART)], names=["id", "d2", PART])

    return vectors.select("id", "keys", "values", PART).mapInArrow(with_part, f"id long, d2 double, {PART} int")


def _by_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` written by ranges of id, with the number of the range."""
    return cut(rows.repartitionByRange("id").withColumn(PART, F.spark_partition_id()), "ranges")


def weighted_pick(distances: DataFrame, u: float) -> DataFrame:
    """One row ``(id)``: the first id, in id order, whose running sum of ``d2`` exceeds ``u`` times the total; no row of an empty table, null where no sum does.

    Ids are parted by ranges, unless they already are; the driver sees one sum a range, and the running sum is taken in the one that holds the pick.
    """
    placed = distances if PART in distances.columns else _by_ranges(distances)
    sums = sorted(placed.groupBy(PART).agg(F.sum("d2").alias("s"), F.min("id").alias("first")).collect(), key=lambda r: r["first"])  # one row a range
    total, before = sum(r["s"] for r in sums), 0.0
    chosen = sums[-1][PART] if sums else 0
    for r in sums:
        if before + r["s"] > u * total:
            chosen = r[PART]
            break
        before += r["s"]
    running = F.sum("d2").over(W.partitionBy(F.lit(0)).orderBy("id"))
    inside = placed.filter(F.col(PART) == chosen).withColumn("c", running + F.lit(before))
    return inside.filter(F.col("c") > F.lit(u * total)).agg(F.min("id").alias("id"))


def plus_plus_ids(vectors: DataFrame, count: int, draws: Sequence[float], *, nearest: bool = False) -> list[int]:
    """k-means++ seeds: the first is the first id, each further one is drawn with the squared distance to the last seed as weight.

    ``draws`` are the uniform numbers, one a seed after the first. ``nearest`` weighs by the distance to the nearest seed instead.
    """
    vectors = _by_ranges(vectors.select("id", "keys", "values"))
    chosen = first_ids(vectors, 1)
    kept = None
    for u in draws[: count - 1]:
        d = _distances(vectors, chosen[-1])
        if nearest and kept is not None:
            d = d.withColumnRenamed("d2", "new").join(kept.drop(PART), "id").select("id", F.least("new", "d2").alias("d2"), PART)
        if nearest:
            kept = d = cut(d, "distances")
        chosen.append(weighted_pick(d, u).first()[0])
    return chosen


def refill_empty(centroids: DataFrame, vectors: DataFrame, count: int, seed: int, density: float = 0.01) -> DataFrame:
    """Adds a random sparse vector for each of the clusters 0 to ``count`` - 1 that has no centroid; seeded by hash."""
    have = {r[0] for r in centroids.select("cluster_id").distinct().collect()}  # one a cluster
    missing = [c for c in range(count) if c not in have]
    if not missing:
        return centroids
    keys = vectors.select(F.explode("keys").alias("key")).distinct()
    lots = keys.withColumn("cluster_id", F.explode(F.array(*(F.lit(c).cast("long") for c in missing)))).withColumn("h", F.pmod(F.xxhash64("key", "cluster_id", F.lit(seed)), F.lit(1_000_000)))
    new = lots.filter(F.col("h") < int(density * 1_000_000)).select("cluster_id", "key", ((F.col("h") + 1) / F.lit(density * 1_000_000)).alias("weight"))
    return centroids.unionByName(new)


def kmeans(vectors: DataFrame, seeds: DataFrame, count: int, *, euclidean: bool = False, iterations: int = 10, threshold: int = 10, seed: int = 0) -> DataFrame:
    """``(id, cluster_id, s)`` after at most ``iterations`` rounds, or when ``threshold`` assignments or fewer change in a round."""
    vectors = cut(vectors.select("id", "keys", "values"), "vectors")
    centroids, assigned = seeds, None
    for i in range(iterations):
        new = cut(assign(vectors, centroids, euclidean=euclidean), "assigned")
        if assigned is None:
            changed = None
        else:
            old = assigned.select("id", F.col("cluster_id").alias("old"))
            changed = new.join(old, "id").filter("cluster_id <> old").count()
            drop_cut(assigned)
        assigned = new
        if (changed is not None and changed <= threshold) or i + 1 == iterations:
            break
        centroids = refill_empty(cut(centroids_of(vectors, assigned), "centroids"), vectors, count, seed + i)
    return assigned


def pair_similarities(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """``(a, b, cosine, inverse_distance)`` of ``entries(doc_id, term, weight)``: documents of ``queries(doc_id)`` with every other that shares a term.

    Ids and terms are integers. The documents of ``queries`` are divided over the tasks, which pass over all documents slice by slice; no pair is shuffled.
    """
    weight = F.col("weight").cast("double")
    listed = F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct(F.col("term").cast("long").alias("k"), weight.alias("v")))))
    vectors = entries.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(listed.alias("e"), F.sum(weight * weight).alias("length"))
    stored = slices.store(vectors.select("id", F.col("e.k").alias("keys"), F.col("e.v").alias("values"), F.lit(1.0).alias("size"), "length"), "length")
    asked = stored.table.join(queries.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    files, hot = stored.files, stored.hot
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64()), ("inverse_distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        mine = slices.rows_of(held, "length")
        for rows, q, row, d in slices.sharing_pairs(mine, files, hot, "length"):
            for at in range(0, len(d), ROWS_OUT):
                own = slice(at, at + ROWS_OUT)
                na, nb, dot = mine.extra[q[own]], rows.extra[row[own]], d[own]
                both, d2 = np.sqrt(na) * np.sqrt(nb), na + nb - 2 * dot
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine, inverse = dot / both, np.where(d2 > 0, 1 / np.sqrt(d2), np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(mine.ids[q[own]]), pa.array(rows.ids[row[own]]), pa.array(cosine, mask=both == 0), pa.array(inverse)], schema=schema)

    spread = asked.repartition(slices.groups(entries.sparkSession, asked.count(), GROUP_ROWS), "id")
    return spread.mapInArrow(run, "a long, b long, cosine double, inverse_distance double")
