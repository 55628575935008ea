"""Ranks, positions, samples and draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def top_k(rows: DataFrame, by: Sequence[str], k: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; ranks above k are cut before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def arg_best(rows: DataFrame, key: str, choice: str, value: str) -> DataFrame:
    """``(key, choice)`` of the largest ``value``, ties to the smaller choice."""
    return rows.groupBy(key).agg(F.max_by(choice, F.struct(F.col(value), -F.col(choice))).alias(choice))


def positions(rows: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """``rows`` numbered 0, 1, ... by ``order``, nulls first: sorted range partitions, each numbered from the rows of those before it.

    Rows that tie are numbered in any order, the same for every reader. The driver sees one count a partition.
    """
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id() % (1 << 33)), "positions")
    counts = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    offsets = rows.sparkSession.createDataFrame(before, "__part int, __before long")
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")  # one row a partition


def group_positions(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place 1, 2, ... in ``order`` inside their group, whatever the size of a group.

    Rows are parted by ranges of group and order, so a large group lies in several partitions; a row's place is the group's rows in the
    partitions before plus its place in its own. Rows that tie are placed in any order, the same for every reader.
    """
    keys = [F.col(g) for g in groups]
    parts = cut(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "places")
    slices = parts.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("__first"))
    before = W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups]
    joined = parts.alias("l").join(slices.alias("r"), [*same, F.col("l.__part") == F.col("r.__part")])
    return joined.select("l.*", (F.col("r.__before") + F.col("l.__row") - F.col("r.__first") + 1).alias(name)).drop("__part", "__row")


def lot(key: str, seed: int) -> Column:
    """A seeded lot of an integer ``key``: its place on a multiplicative generator's cycle, the same in any engine."""
    mixed = F.pmod(F.pmod(F.col(key).cast("long"), F.lit(2147483647)) * 48271 + (seed + 1) * 69621, F.lit(2147483647))
    return F.pmod(mixed * 1103515245, F.lit(2147483647))


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, by seeded :func:`lot` of the integer ``key``, ties to the smaller key."""
    return rows.orderBy(lot(key, seed), key).limit(n)


def first_appearance(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """``(key, first)``: the distinct keys with the position at which they first appear."""
    return rows.groupBy(key).agg(F.min(pos).alias("first"))


def last_write(rows: DataFrame, keys: Sequence[str], value: str, pos: str = "pos") -> DataFrame:
    """``(keys..., value)``: of repeated keys the value of the largest ``pos``, of equal ones the larger value."""
    return rows.groupBy(*keys).agg(F.max(F.struct(pos, value)).alias("r")).select(*keys, F.col(f"r.{value}").alias(value))
