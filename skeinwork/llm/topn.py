"""The first N items of every group by statistics-guided skipping.

Rows are written to the shared folder clustered by group: whole groups to one file, a group above ``file_rows`` rows spread
over several. Inside a file rows are sorted by group and rank order. Each file is then read by row group in descending
maximum score; a row group of one group is skipped when its maximum lies strictly below the group's current N-th item.
The per-file results, at most N a group and file, are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, drop_cut, parallelism, scratch_path

#: Rows a file aims at and rows a row group may hold.
FILE_ROWS = 2_000_000
ROW_GROUP_ROWS = 20_000
_OUT = pa.schema([("g", pa.int64()), ("s", pa.float64()), ("t", pa.int64()), ("i", pa.int64())])
_NONE = np.iinfo(np.int64).min


def _read_file(path: str, n: int, stats: dict | None = None) -> pa.RecordBatch | None:
    from urllib.parse import unquote

    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    path = unquote(path)
    where, inner = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    with where.open_input_file(inner) as source:
        file = pq.ParquetFile(source)
        meta = file.metadata
        names = [meta.schema.column(k).name for k in range(meta.num_columns)]
        at = {c: names.index(c) for c in "gsti"}
        order = []
        for k in range(meta.num_row_groups):
            rg = meta.row_group(k)
            if not rg.num_rows:
                continue
            g, s, t = (rg.column(at[c]).statistics for c in "gst")
            known = all(x is not None and x.has_min_max for x in (g, s, t))
            order.append((-s.max, -t.max, k, g.min == g.max and g.min) if known else (-np.inf, -np.inf, k, False))
        order.sort()
        full: dict[int, tuple] = {}  # N-th item so far, of groups with N items
        held: dict[int, list] = {}
        for s, t, k, only in order:
            if only is not False and only in full and (-s, -t) < full[only][:2]:
                if stats is not None:
                    stats["skipped"] = stats.get("skipped", 0) + 1
                continue
            if stats is not None:
                stats["read"] = stats.get("read", 0) + 1
            rows = file.read_row_group(k, columns=list("gsti"))
            g, s_, t_, i_ = (rows.column(c).to_numpy() for c in "gsti")
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
            for row in np.flatnonzero(place < n):
                held.setdefault(int(g[row]), []).append((-s_[row], -t_[row] if t_[row] != _NONE else np.inf, i_[row], t_[row]))
            for group in set(g[start].tolist()):
                best = sorted(held[group])[:n]
                held[group] = best
                if len(best) == n:
                    full[group] = (-best[-1][0], best[-1][3])
    if not held:
        return None
    flat = [(g, -x[0], x[3], x[2]) for g, best in held.items() for x in best]
    return pa.RecordBatch.from_arrays([pa.array([int(r[k]) if k != 1 else float(r[k]) for r in flat], f.type) for k, f in enumerate(_OUT)], schema=_OUT)


def bucketed(rows: DataFrame, sized: DataFrame, group: str, spread: str, file_rows: int) -> tuple[DataFrame, int]:
    """``rows`` with ``__bucket``: one for a group, several by ``spread`` for a group above ``file_rows`` rows of ``sized``; and how many there are."""
    sizes = sized.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    total, heavy_count = sizes.agg(F.sum("__n"), F.count_if(F.col("__n") > file_rows)).first()
    count = max(parallelism(rows.sparkSession), -(-(total or 0) // file_rows))
    place: Column = F.xxhash64(group)
    if heavy_count:
        # At most rows / file_rows groups are heavy.
        heavy = sizes.filter(F.col("__n") > file_rows).select(F.col(group).alias("__g"), F.ceil(F.col("__n") / file_rows).alias("__files"))
        rows = rows.join(broadcast_if_small(heavy, heavy_count, 32), F.col(group) == F.col("__g"), "left").drop("__g")
        place = F.xxhash64(group, F.coalesce(F.pmod(F.xxhash64(spread), F.col("__files")), F.lit(0)))
    return rows.withColumn("__bucket", F.pmod(place, F.lit(count)).cast("int")), count


def top_n(
    rows: DataFrame,
    group: str,
    item: str,
    score: str,
    n: int,
    *,
    recent: str | None = None,
    latest_by: str | None = None,
    file_rows: int = FILE_ROWS,
    row_group_rows: int = ROW_GROUP_ROWS,
) -> DataFrame:
    """``(group, item, score, recent)`` of the first ``n`` rows of each group: score descending, ``recent`` descending (null last), item ascending.

    Rows with a null group, item or score, or a NaN score, are left out. With ``latest_by``, each (group, item) first keeps its
    row of the largest ``latest_by`` (null smallest; copies of one value give the larger score, then the later ``recent``);
    without it repeated rows count as often as they come. ``recent`` is a timestamp without zone. Groups and items are integers. An empty table gives no row.
    """
    spark = rows.sparkSession
    when = F.expr(f"unix_micros(cast(`{recent}` as timestamp))") if recent else F.lit(None).cast("long")
    picked = rows.select(F.col(group).cast("long").alias("g"), F.col(item).cast("long").alias("i"), F.col(score).cast("double").alias("s"), F.coalesce(when, F.lit(_NONE)).alias("t"), *([F.col(latest_by).alias("p")] if latest_by else []))
    picked = picked.filter(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    rows = picked
    if latest_by:  # repeats of a pair meet before the shuffle
        newest = F.max(F.struct("p", "s", "t"))
        rows = picked.groupBy("g", "i").agg(newest.alias("r")).select("g", "i", "r.s", "r.t")
    placed, count = bucketed(rows, picked, "g", "i", file_rows)
    placed = placed.repartitionById(count, "__bucket")
    path = scratch_path(spark, "topn")
    ordered = placed.select("g", "s", "t", "i").sortWithinPartitions("g", F.desc("s"), F.desc("t"), "i")
    ordered.write.option("compression", "lz4").option("parquet.block.row.count.limit", row_group_rows).option("parquet.block.size", row_group_rows * 40).parquet(path)
    files = spark.read.schema(ordered.schema).parquet(path).inputFiles()
    if not files:
        best = spark.createDataFrame([], "g long, s double, t long, i long")
    else:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file in batch.column(0).to_pylist():
                    found = _read_file(file, n)
                    if found is not None:
                        yield found

        listed = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "path string, k int").repartitionById(len(files), "k")
        best = listed.select("path").mapInArrow(read, "g long, s double, t long, i long")
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("s"), F.desc("t"), "i"))
    merged = best.withColumn("__rank", rank).filter(F.col("__rank") <= n)
    time = F.when(F.col("t") != _NONE, F.timestamp_micros("t").cast("timestamp_ntz"))
    return merged.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias("score"), time.alias("recent"), F.col("__rank").alias("rank"))
