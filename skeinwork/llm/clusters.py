"""Clusters of similar records: a neighbour graph by neighbour descent, linked clusters, and their division into communities of high modularity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, drop_cut
from .components import components
from .grouped import whole_groups
from .links import links_between
from .similar import copy_classes
from .terms import clean_entries

#: Neighbours kept a record, terms it starts from, size of a starting group, and rounds of descent at most.
NEIGHBOURS, SEEDS, GROUP, ROUNDS = 8, 6, 24, 4
#: Descent ends when fewer than this share of all neighbours is new, and no record joined a linked group.
SETTLED = 0.02
#: Similarity under which two records aren't neighbours, and links of a linked group divided in one task.
FLOOR, TASK_LINKS = 0.15, 200_000

_FOUND = "a long, b long, s double, same boolean"


def record_vectors(vectors: DataFrame, *, common_share_of: int = 5) -> DataFrame:
    """``(id, keys, values, seeds)``: clean entries of each record without terms in more than 1 / ``common_share_of`` of the records; seeds: its terms by f * ln(N / df)."""
    entries = cut(clean_entries(vectors), "entries")
    n = entries.agg(F.count_distinct("doc_id")).first()[0]
    df = entries.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.lit(common_share_of) * F.col("df") <= n)
    kept = entries.join(broadcast_if_small(df, df.count(), 24), "term")
    weight = F.round(F.col("f") * F.log(F.lit(float(max(n, 1))) / F.col("df")), 9)
    packed = kept.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("term").cast("long").alias("k"), F.col("f").cast("double").alias("v"), weight.alias("w")))).alias("e"))
    by_weight = F.slice(F.array_sort(F.transform("e", lambda x: F.struct((-x["w"]).alias("w"), x["k"].alias("k")))), 1, SEEDS)
    return packed.select("id", F.col("e.k").alias("keys"), F.col("e.v").alias("values"), F.transform(by_weight, lambda x: x["k"]).alias("seeds"))


def _local_join(threshold_squared: float, keep: int, floor: float):
    """All similarities inside each group: every record's best ones, and who is linked to whom through links inside the group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, ["g1", "g2"]):
            all_ids = rows.column("id").to_numpy()
            keys, values = rows.column("keys"), rows.column("values")
            offsets = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            keys, values = keys.flatten().to_numpy(), values.flatten().to_numpy()
            out: list[tuple] = []
            for a, z in zip(bounds, bounds[1:]):
                n = z - a
                if n < 2:
                    continue
                ids, first, last = all_ids[a:z], offsets[a], offsets[z]
                names, at = np.unique(keys[first:last], return_inverse=True)
                dense = np.zeros((n, len(names)))
                dense[np.repeat(np.arange(n), np.diff(offsets[a : z + 1])), at] = values[first:last]
                dots = dense @ dense.T
                sizes = np.diag(dots)
                both = np.outer(sizes, sizes)
                linked = (dots > 0) & (dots * dots >= threshold_squared * both)  # exact for integer values
                similar = dots / np.sqrt(both)
                np.fill_diagonal(similar, -1)
                best = np.argpartition(-similar, keep - 1, axis=1)[:, :keep] if n > keep else np.tile(np.arange(n), (n, 1))
                r, c = np.repeat(np.arange(n), best.shape[1]), best.ravel()
                s = similar[r, c]
                ok = s >= floor
                out.append((ids[r[ok]], ids[c[ok]], s[ok], np.zeros(ok.sum(), bool)))
                if linked.sum() > n:  # links besides the diagonal: spread the smallest number along them
                    label = np.arange(n)
                    while True:
                        new = np.where(linked, label[None, :], n).min(axis=1)
                        if (new == label).all():
                            break
                        label = new
                    joined = np.flatnonzero(label != np.arange(n))
                    out.append((ids[joined], ids[label[joined]], np.zeros(len(joined)), np.ones(len(joined), bool)))
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _seed_groups(records: DataFrame, size: int) -> DataFrame:
    """``(g1, g2, id)``: records that share a seed term, parted by hash into groups of about ``size``."""
    seeds = records.select("id", F.explode("seeds").alias("g1"))
    counts = seeds.groupBy("g1").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    return seeds.join(counts, "g1").select("g1", F.pmod(F.xxhash64("id", "g1"), "parts").alias("g2"), "id")


def _neighbour_groups(near: DataFrame, keep: int) -> DataFrame:
    """``(g1, g2, id)``: around each record with a new neighbour, itself, its neighbours and as many of those it is a neighbour of."""
    centre = near.filter("fresh").select(F.col("a").alias("g1")).unionByName(near.filter("fresh").select(F.col("b").alias("g1"))).distinct()
    back = near.select(F.col("b").alias("g1"), F.col("a").alias("id"), "s")
    back = back.withColumn("k", F.row_number().over(W.partitionBy("g1").orderBy(F.desc("s"), "id"))).filter(F.col("k") <= keep).select("g1", "id")
    members = near.select(F.col("a").alias("g1"), F.col("b").alias("id")).unionByName(back).unionByName(near.select(F.col("a").alias("g1"), F.col("a").alias("id"))).unionByName(near.select(F.col("b").alias("g1"), F.col("b").alias("id"))).distinct()
    return members.join(centre, "g1", "left_semi").select("g1", F.lit(0).cast("long").alias("g2"), "id")


def neighbour_descent(records: DataFrame, threshold: float, *, keep: int = NEIGHBOURS, group: int = GROUP, rounds: int = ROUNDS, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """``(near, same)``: near(a, b, s), the ``keep`` most similar records found of each record, and same(a, b), pairs found to be linked, also through others.

    ``records(id, keys, values, seeds)`` have unique ids. The descent starts from groups of records with a common seed
    term; each round compares all records around each record whose neighbourhood changed. Every comparison at or above ``threshold``
    counts for ``same``, whether or not it stays among the nearest.
    """
    join = _local_join(threshold * threshold, keep, floor)
    vectors = records.select("id", "keys", "values")

    def compare(groups: DataFrame) -> DataFrame:
        laid = groups.join(vectors, "id").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
        return cut(laid.select("g1", "g2", "id", "keys", "values").mapInArrow(join, _FOUND), "found")

    best = W.partitionBy("a").orderBy(F.desc("s"), "b")
    found = compare(_seed_groups(records, group))
    same = found.filter("same").select("a", "b").distinct()
    fresh = found.filter("NOT same").groupBy("a", "b").agg(F.max("s").alias("s"), F.lit(True).alias("fresh"))
    near = cut(fresh.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= keep).drop("k"), "near")
    for _ in range(rounds):
        found = compare(_neighbour_groups(near, keep))
        same = same.unionByName(found.filter("same").select("a", "b").distinct())
        offered = found.filter("NOT same").select("a", "b", "s", F.lit(True).alias("fresh")).unionByName(near.withColumn("fresh", F.lit(False)))
        merged = offered.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
        before, near = near, cut(merged.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= keep).drop("k"), "near")
        counts = near.agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("fresh")).first()
        if counts["fresh"] <= SETTLED * counts["n"]:
            break
    return near.select("a", "b", "s"), cut(same.distinct(), "same")


def _with_missed(firsts: DataFrame, near: DataFrame, groups: DataFrame, missed: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """``(near, groups)`` of neighbour descent with the links ``missed(a, b, s, x, y)`` by it; groups has every record."""
    both = missed.select("a", "b", "s").unionByName(missed.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    merged = near.unionByName(both).groupBy("a", "b").agg(F.max("s").alias("s"))
    near = merged.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy(F.desc("s"), "b"))).filter(F.col("k") <= keep).drop("k")
    joined = components(missed.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("g"), F.col("component").alias("whole"))
    known = firsts.select("id").join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("g"))
    return cut(near, "near"), cut(known.join(joined, "g", "left").select("id", F.coalesce("whole", "g").alias("component")), "groups")


def _move(both: DataFrame, degree: DataFrame, total: float, rounds: int) -> tuple[DataFrame, int]:
    """``(id, d, c)`` after moves of single nodes until none gains by one, and how many moves there were.

    In the first ``rounds`` rounds half of the nodes, by hash, may move; then only the best mover from or to each community. Those moves don't touch
    each other, so every one raises modularity and the rounds end. ``both(a, b, s)`` has each link both ways, ``degree(id, d)`` all weight of a node.
    """
    label, moves = degree.select("id", "d", F.col("id").alias("c")), 0
    for r in count():
        mass = label.groupBy("c").agg(F.sum("d").alias("mass"))
        towards = both.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("s").alias("w")).withColumnRenamed("a", "id")
        offers = towards.join(mass, "c").join(label.select("id", "d", F.col("c").alias("own")), "id")
        rest = F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("d")).otherwise(0.0)
        scored = offers.select("id", "c", "own", F.round(F.col("w") - F.col("d") * rest / F.lit(total), 9).alias("gain"))
        pick = scored.groupBy("id").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("to"), F.max("gain").alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
        # alone, a node has gain 0; in the first round all are alone, and only moves to a smaller community can't swap a pair
        stay = F.coalesce("stay", F.lit(0.0))
        wants = F.coalesce(F.col("best") > stay, F.lit(False))
        moved = label.select("id", "d", "c").join(pick, "id", "left").withColumn("wants", wants)
        if r < rounds:
            may = (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0) if r else F.col("to") < F.col("c")
        else:
            moved = cut(moved.withColumn("more", F.col("best") - stay), "wishes")
            wishes = moved.filter("wants").select("id", "more", F.explode(F.array("c", "to")).alias("k"))
            first = wishes.groupBy("k").agg(F.max_by("id", F.struct("more", -F.col("id"))).alias("id"))
            moved = moved.join(first.groupBy("id").agg((F.count(F.lit(1)) == 2).alias("may")), "id", "left")
            may = F.coalesce("may", F.lit(False))
        moved = moved.withColumn("go", F.col("wants") & may)
        before, label = label, cut(moved.select("id", "d", F.when(F.col("go"), F.col("to")).otherwise(F.col("c")).alias("c"), "go", "wants"), "moves")
        drop_cut(before)
        seen = label.agg(F.count_if("go").alias("go"), F.count_if("wants").alias("wants")).first()
        moves += seen["go"]
        if not seen["wants"]:
            return label, moves


def _links(near: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, s)``, a < b: neighbours at or above ``threshold``, once."""
    return near.filter(F.col("s") >= threshold - 1e-12).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").groupBy("a", "b").agg(F.max("s").alias("s"))


def _move_apart(links: DataFrame, total: float, rounds: int) -> DataFrame:
    """``(id, community)`` of linked groups too large for one task: nodes moved by joins, then communities likewise, as nodes, until a level joins nothing."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")), "graph")
    degree = cut(both.groupBy(F.col("a").alias("id")).agg(F.sum("s").alias("d")), "degrees")
    where = degree.select("id", F.col("id").alias("community"))
    nodes = degree.count()
    while nodes:
        label, moves = _move(both, degree, total, rounds)
        left = label.select("c").distinct().count() if moves else nodes
        if left >= nodes:
            break
        nodes = left
        of = label.select(F.col("id").alias("community"), F.col("c").alias("next"))
        where = cut(where.join(of, "community").select("id", F.col("next").alias("community")), "communities")
        ends = both.join(label.select(F.col("id").alias("a"), F.col("c").alias("x")), "a").join(label.select(F.col("id").alias("b"), F.col("c").alias("y")), "b")
        before, both = both, cut(ends.filter("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("s").alias("s")), "graph")
        degree = cut(label.groupBy(F.col("c").alias("id")).agg(F.sum("d").alias("d")), "degrees")
        drop_cut(before)
    return where


def best_division(a: np.ndarray, b: np.ndarray, s: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, communities)`` of one linked group: nodes in order of their ids, each moved to the community of most gain until none gains, then communities as nodes."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    where = np.arange(len(ids))
    x, y = ends[: len(a)], ends[len(a) :]
    degree = (np.bincount(x, s, len(ids)) + np.bincount(y, s, len(ids))).tolist()
    while True:
        n = len(degree)
        around: list[dict[int, float]] = [{} for _ in range(n)]
        for p, q, w in zip(x.tolist(), y.tolist(), s.tolist()):
            if p != q:
                around[p][q] = around[p].get(q, 0.0) + w
                around[q][p] = around[q].get(p, 0.0) + w
        own, mass, moved = list(range(n)), list(degree), False
        again = True
        while again:
            again = False
            for node in range(n):
                towards: dict[int, float] = {}
                for other, w in around[node].items():
                    towards[own[other]] = towards.get(own[other], 0.0) + w
                d, here = degree[node], own[node]
                mass[here] -= d
                stay = towards.get(here, 0.0) - d * mass[here] / total
                gain, to = max(((w - d * mass[c] / total, -c) for c, w in towards.items()), default=(stay, -here))
                if gain > stay + 1e-9:
                    own[node], again, moved = -to, True, True
                mass[own[node]] += d
        if not moved:
            return ids, where
        _, dense = np.unique(np.array(own), return_inverse=True)
        where, x, y = dense[where], dense[x], dense[y]
        degree = np.bincount(dense, degree).tolist()


def _divide(total: float):
    schema = pa.schema([("id", pa.int64()), ("community", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, ["g"]):
            a, b, s = (rows.column(c).to_numpy() for c in "abs")
            for start, end in zip(bounds, bounds[1:]):
                ids, where = best_division(a[start:end], b[start:end], s[start:end], total)
                first = np.full(where.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, where, ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(first[where])], schema=schema)

    return run


def communities(near: DataFrame, threshold: float, groups: DataFrame | None = None, *, task_links: int = TASK_LINKS, rounds: int = 6) -> DataFrame:
    """``(id, community)``: nodes moved to the community of a linked neighbour that gains most modularity, until none gains, then communities likewise, as nodes, until nothing joins.

    Links are the neighbours at or above ``threshold``, weighted by similarity; ``groups(id, component)`` names their linked groups, where known. No move leaves a linked group, so a
    group of up to ``task_links`` links is divided inside one task; the nodes of larger ones move by joins, half of them by hash in each of the first ``rounds``
    rounds of a level, then those whose moves don't touch each other. Either ends where no move raises modularity over all links. A community has the name of its smallest id.
    """
    links = _links(near, threshold)
    groups = components(links) if groups is None else groups
    links = links.join(groups.select(F.col("id").alias("a"), F.col("component").alias("g")), "a").select("g", "a", "b", "s")
    links = cut(links, "links")
    total = 2 * (links.agg(F.sum("s")).first()[0] or 0.5)
    sizes = links.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.filter(F.col("n") > task_links).select("g"), "large-groups")
    large_count = large.count()  # at most links / task_links
    small = links.join(broadcast_if_small(large, large_count, 16), "g", "left_anti") if large_count else links
    laid = small.repartition("g").sortWithinPartitions("g", "a", "b").select("g", "a", "b", "s")
    found = laid.mapInArrow(_divide(total), "id long, community long")
    if large_count:
        apart = _move_apart(links.join(broadcast_if_small(large, large_count, 16), "g", "left_semi").select("a", "b", "s"), total, rounds)
        named = apart.groupBy("community").agg(F.min("id").alias("first"))
        found = found.unionByName(apart.join(named, "community").select("id", F.col("first").alias("community")))
    return found


def modularity(near: DataFrame, threshold: float, parts: DataFrame) -> float:
    """Modularity of ``parts(id, community)`` over the links of ``near``."""
    links = _links(near, threshold)
    x, y = parts.select(F.col("id").alias("a"), F.col("community").alias("x")), parts.select(F.col("id").alias("b"), F.col("community").alias("y"))
    met = cut(links.join(x, "a").join(y, "b").select("x", "y", "s"), "met")
    total = met.agg(F.sum("s")).first()[0]
    if not total:
        return 0.0
    masses = met.select(F.col("x").alias("c"), "s").unionByName(met.select(F.col("y").alias("c"), "s")).groupBy("c").agg(F.sum("s").alias("d"))
    inside = met.filter("x = y").agg(F.sum("s")).first()[0] or 0.0
    return inside / total - masses.agg(F.sum(F.pow(F.col("d") / (2 * total), 2))).first()[0]


def record_clusters(vectors: DataFrame, *, threshold: float = 0.5, task_links: int = TASK_LINKS, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, near, classes)`` of sparse records ``vectors(doc_id, term, freq)``.

    members(doc_id, cluster_id, community_id): every record with a usable entry whose term isn't too common; records linked (cosine of f at or above
    ``threshold``), also through others, share a cluster, named by its smallest doc_id; a community is the part of it found by
    modularity, named by one of its records. Copies (equal vectors) are compared once and share both. Records found without a link are clusters of their own.
    Neighbour descent finds most links; what it missed between its groups is found by comparing all records of different groups that can be linked,
    so clusters are whole. ``near`` and communities have links of the descent and those. An empty table gives empty results.
    """
    records = cut(record_vectors(vectors), "records")
    classes = cut(copy_classes(records), "classes")
    firsts = cut(records.join(classes.filter("id = class_id").select("id"), "id", "left_semi"), "firsts")
    near, same = neighbour_descent(firsts, threshold, **options)
    groups = components(same)
    missed = links_between(firsts, groups, threshold)
    if missed.take(1):
        near, groups = _with_missed(firsts, near, groups, missed, options.get("keep", NEIGHBOURS))
    parts = communities(near, threshold, groups, task_links=task_links)
    label = classes.join(groups.select(F.col("id").alias("class_id"), F.col("component").alias("k")), "class_id", "left").withColumn("k", F.coalesce("k", "class_id"))
    label = label.join(parts.select(F.col("id").alias("class_id"), "community"), "class_id", "left")
    label = cut(label.select("id", "k", F.coalesce("community", "class_id").alias("community_id")), "labels")
    named = label.groupBy("k").agg(F.min("id").alias("cluster_id"))
    return label.join(named, "k").select(F.col("id").alias("doc_id"), "cluster_id", "community_id"), near, classes


def describe(members: DataFrame, near: DataFrame, classes: DataFrame, *, threshold: float = 0.5, typical: int = 3) -> DataFrame:
    """``(cluster_id, community_id, size, typical)`` of each community of two or more records: its records and the ``typical`` ones of highest internal weighted degree (ties: smaller id).

    The degree counts every record of the linked classes, and copies as links of similarity 1; copies have the same degree. Links are those of ``near``, which has
    the nearest of each class only, so in dense communities the degree is that within the neighbour graph.
    """
    where = members.select(F.col("doc_id").alias("id"), "cluster_id", "community_id")
    links = near.filter(F.col("s") >= threshold - 1e-12)
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).groupBy("a", "b").agg(F.max("s").alias("s"))
    counts = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    inner = links.join(where.select(F.col("id").alias("a"), F.col("community_id").alias("x")), "a").join(where.select(F.col("id").alias("b"), F.col("community_id").alias("y")), "b").filter("x = y")
    towards = inner.join(counts.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum(F.col("s") * F.col("n")).alias("w"))
    degree = counts.join(towards, "class_id", "left").select("class_id", F.round(F.coalesce("w", F.lit(0.0)) + F.col("n") - 1, 9).alias("d"))
    ranked = where.join(classes, "id").join(degree, "class_id")
    top = ranked.withColumn("k", F.row_number().over(W.partitionBy("community_id").orderBy(F.desc("d"), "id"))).filter(F.col("k") <= typical)
    best = top.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("typical"))
    sizes = where.groupBy("cluster_id", "community_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= 2)
    return sizes.join(best, "community_id").select("cluster_id", "community_id", "size", "typical")
