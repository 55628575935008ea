"""Per-key results under key skew by exact offset chunking.

A key's rows are numbered exactly (rows of the key in earlier input partitions, plus the place inside the own one),
cut into chunks of equal size, folded chunk by chunk and merged in chunk order. No task holds more than one chunk of
a key, and no row is dropped or sampled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, parallelism

PART, LOCAL, CHUNK = "__part", "__local", "__chunk"


def number_chunks(df: DataFrame, key: Sequence[str] | str, *, order: str | None = None, chunk_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` with a column ``__chunk``, and the totals ``(key..., __total)``.

    Chunk ``i`` of a key holds its rows ``i * chunk_rows`` to ``(i + 1) * chunk_rows - 1`` in ``order`` (ties in any
    order), or in the order of the written partitions when ``order`` is None. ``chunk_rows`` defaults to an even share,
    rows / shuffle partitions. Rows with a null key form a key of their own. An empty table gives empty results.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    if order is not None:
        df = df.repartitionByRange(order)
    rows = cut(df.withColumn(PART, F.spark_partition_id()).withColumn(LOCAL, F.monotonically_increasing_id()), "keyed")
    per_part = cut(rows.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("__n")), "keyed-counts")
    totals = per_part.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    everything = per_part.agg(F.sum("__n")).first()[0] or 0
    if chunk_rows is None:
        chunk_rows = max(1, -(-everything // parallelism(spark)))
    heavy = totals.filter(F.col("__total") > chunk_rows).select(*keys)
    # At most rows / chunk_rows keys are heavy, and each has one count a partition.
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    held = per_part.alias("l").join(broadcast_if_small(heavy, everything // chunk_rows, 64).alias("r"), same).select("l.*")
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = cut(held.select(*keys, PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")), "keyed-offsets")
    small = broadcast_if_small(offsets, offsets.count(), 64)
    joined = rows.alias("l").join(small.alias("r"), [*same, F.col(f"l.{PART}") == F.col(f"r.{PART}")], "left").select("l.*", "r.__offset")
    light = joined.filter(F.col("__offset").isNull()).withColumn(CHUNK, F.lit(0).cast("long"))
    inside = W.partitionBy(*keys, PART).orderBy(*([F.col(order).asc_nulls_first()] if order else []), LOCAL)
    number = F.col("__offset") + F.row_number().over(inside) - 1
    numbered = joined.filter(F.col("__offset").isNotNull()).withColumn(CHUNK, F.floor(number / F.lit(chunk_rows)).cast("long"))
    return light.unionByName(numbered).drop(PART, LOCAL, "__offset"), totals


def chunked_fold(
    df: DataFrame,
    key: Sequence[str] | str,
    states: Mapping[str, Column],
    merges: Mapping[str, Column],
    *,
    order: str | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """One row per key: ``states`` are aggregates over one chunk, ``merges`` aggregates over the chunk states.

    A merge sees the states in columns of their names and ``__chunk``, so ordered merges use
    ``min_by(state, __chunk)`` and the like. A key has rows / chunk_rows chunks at most.
    """
    keys = [key] if isinstance(key, str) else list(key)
    chunks, _ = number_chunks(df, keys, order=order, chunk_rows=chunk_rows)
    folded = chunks.groupBy(*keys, CHUNK).agg(*(c.alias(name) for name, c in states.items()))
    return folded.groupBy(*keys).agg(*(c.alias(name) for name, c in merges.items()))


def heavy_keys(df: DataFrame, kinds: Sequence[str], *, one_in: int = 100, chunk_rows: int | None = None) -> DataFrame:
    """``(key_kind, key_id, n)``: for each column of ``kinds``, its values above 0 held by at least one in ``one_in`` of the distinct rows, in exact integers.

    A repeated row counts once; rows with a null key or odd values count in the total only. An empty table gives no row.
    """
    distinct = cut(df.distinct().select(*kinds), "distinct")
    total = distinct.count()
    found = None
    for kind in kinds:
        n = chunked_fold(distinct.select(F.col(kind).alias("key_id")), "key_id", {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, chunk_rows=chunk_rows)
        one = n.filter((F.col("key_id") > 0) & (F.col("n") * one_in >= F.lit(total))).select(F.lit(kind).alias("key_kind"), F.col("key_id").cast("long").alias("key_id"), "n")
        found = one if found is None else found.unionByName(one)
    return found


def key_profile(df: DataFrame, kind: str, *, order: str, value: str, chunk_rows: int | None = None) -> DataFrame:
    """Per value of ``kind``: rows, the first and last ``value`` in ``order`` and the number of changes of ``value`` along it.

    The changes need ordered boundary states: a chunk gives its inner changes and its first and last value, and
    the merge adds one for each pair of neighbouring chunks whose boundary values differ. Rows with a null key are
    left out; repeated rows count once; null and NaN values are values of their own. Rows that tie in ``order`` follow
    ``value`` ascending, nulls first.
    """
    rows = df.filter(F.col(kind).isNotNull()).select(F.col(kind).cast("long").alias("key_id"), F.col(order).alias("__o"), F.col(value).alias("__v")).distinct()
    chunks, _ = number_chunks(rows.withColumn("__ov", F.struct("__o", "__v")), "key_id", order="__ov", chunk_rows=chunk_rows)
    inside = W.partitionBy("key_id", CHUNK).orderBy("__ov")
    chunks = chunks.withColumn("__change", (~F.col("__v").eqNullSafe(F.lag("__v").over(inside)) & (F.row_number().over(inside) > 1)).cast("long"))
    at = F.struct("__ov")
    states = chunks.groupBy("key_id", CHUNK).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__change").alias("changes"), F.min_by(F.struct("__v"), at).alias("first"), F.max_by(F.struct("__v"), at).alias("last")
    )
    along = F.array_sort(F.collect_list(F.struct(F.col(CHUNK).alias("c"), F.col("first.__v").alias("a"), F.col("last.__v").alias("z"), "n", "changes")))
    merged = states.groupBy("key_id").agg(along.alias("s"))
    edges = F.aggregate(
        F.sequence(F.lit(1), F.size("s") - 1),
        F.lit(0).cast("long"),
        lambda acc, i: acc + F.when(F.element_at("s", i)["z"].eqNullSafe(F.element_at("s", i + 1)["a"]), 0).otherwise(1),
    )
    total = lambda name: F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    return merged.select(
        "key_id",
        total("n").alias("n"),
        F.element_at("s", 1)["a"].alias("first_value"),
        F.element_at("s", -1)["z"].alias("last_value"),
        (total("changes") + F.when(F.size("s") > 1, edges).otherwise(0)).alias("changes"),
    )
