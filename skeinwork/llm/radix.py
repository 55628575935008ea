"""Aggregation of partial counts by recursive radix partitions on disk, each aggregated by DuckDB.

Partial counts are written to the shared folder with a 64-bit hash of their key. The hash's top bits cut the
table into cells; a cell above the limit is cut further by its next bits, down to single keys. A single key has at
most one partial a map task and flush, so it always fits. Every cell goes to one task, where DuckDB aggregates it out of core.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, local_path, parallelism, shared_folder

#: Bytes of partials one DuckDB instance may be given, its memory, the most hash bits of the first level, and those of a split.
CELL_BYTES = 96 << 20
DUCKDB_MB = 384
MOST_BITS, SPLIT_BITS = 20, 4

PARTIAL = "fieldname string, term string, total long, records long"
_ARROW = pa.schema([("fieldname", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("records", pa.int64())])


def _cell(hash_: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hash_, 64 - bits) if bits else F.lit(0).cast("long")


def plan_cells(table: DataFrame, limit: int, least: int = 1) -> tuple[int, list[tuple[int, list[int]]]]:
    """``(bits, splits)``: the first level's bits, and for each further level its depth and the cells it splits.

    The first level alone would do if hashes carried equal weight; only the cells above the limit come to the driver.
    """
    weight = F.sum(F.coalesce(F.length("term"), F.lit(0)) + 40)
    total = table.agg(weight).first()[0] or 0
    limit = min(limit, max(1 << 20, total // least)) if least > 1 else limit
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(total / limit, 1)) + 0.5)))
    splits: list[tuple[int, list[int]]] = []

    def above(rows: DataFrame, depth: int) -> list[int]:
        sizes = rows.groupBy(_cell(F.col("h"), depth).alias("c")).agg(weight.alias("w"), F.min("h").alias("a"), F.max("h").alias("z"))
        return sorted(r["c"] for r in sizes.filter((F.col("w") > limit) & (F.col("a") < F.col("z"))).select("c").collect())

    depth, over = bits, above(table, bits)
    while over and depth < 64:
        splits.append((depth, over))
        inner = table.filter(_cell(F.col("h"), depth).isin(over))
        depth = min(64, depth + SPLIT_BITS)
        over = above(inner, depth)
    return bits, splits


def _partition(table: DataFrame, bits: int, splits: list[tuple[int, list[int]]]) -> tuple[DataFrame, int]:
    """``table`` with ``__cell``, the number of a row's cell, and how many numbers there are: those of the first level, then those made by splits.

    The cells a level splits are a small table, at most as many as the table has limits of bytes, joined by the bits of the hash.
    """
    place, count = _cell(F.col("h"), bits), 1 << bits
    for k, (depth, cells) in enumerate(splits):
        step = min(64, depth + SPLIT_BITS) - depth
        listed = table.sparkSession.createDataFrame([(c, count + (i << step)) for i, c in enumerate(cells)], f"__c{k} long, __base{k} long")
        table = table.join(broadcast_if_small(listed, len(cells), 16), _cell(F.col("h"), depth) == F.col(f"__c{k}"), "left")
        place = F.coalesce(F.col(f"__base{k}") + _cell(F.col("h"), depth + step).bitwiseAND(F.lit((1 << step) - 1)), place)
        count += len(cells) << step
    return table.withColumn("__cell", place.cast("int")), count


def _aggregate(folder: str | None, memory_mb: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import shutil
        import uuid

        import duckdb

        db, spill = None, f"{folder}-{uuid.uuid4().hex}" if folder else None
        for batch in batches:
            if not batch.num_rows:
                continue
            if db is None:
                db = duckdb.connect()
                db.execute("SET threads = 1")
                db.execute(f"SET memory_limit = '{memory_mb}MB'")
                if spill:
                    db.execute(f"SET temp_directory = '{spill}'")
                db.execute("CREATE TABLE p (fieldname VARCHAR, term VARCHAR, total BIGINT, records BIGINT)")
            db.register("batch", pa.Table.from_batches([batch]))
            db.execute("INSERT INTO p SELECT fieldname, term, total, records FROM batch")
            db.unregister("batch")
        if db is None:
            return
        result = db.sql("SELECT fieldname, term, CAST(sum(total) AS BIGINT) AS total, CAST(sum(records) AS BIGINT) AS records FROM p GROUP BY fieldname, term")
        for out in result.to_arrow_reader(50_000):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns, _ARROW)], schema=_ARROW)
        db.close()
        if spill:
            shutil.rmtree(spill, ignore_errors=True)

    return run


def radix_counts(partials: DataFrame, *, cell_bytes: int = CELL_BYTES, memory_mb: int = DUCKDB_MB) -> DataFrame:
    """``(fieldname, term, total, records)`` summed over ``partials`` of the same columns; a null term is a key like any other."""
    spark = partials.sparkSession
    table = cut(partials.withColumn("h", F.xxhash64("fieldname", "term")), "radix")
    bits, splits = plan_cells(table, cell_bytes, parallelism(spark))
    celled, count = _partition(table, bits, splits)
    # DuckDB spills to local paths only: the shared folder where it is one, else the folder of the executor's own shuffle files
    folder = local_path(shared_folder(spark)) or spark.conf.get("spark.local.dir", None)
    placed = celled.select("fieldname", "term", "total", "records", "__cell").repartitionById(count, "__cell")
    return placed.select("fieldname", "term", "total", "records").mapInArrow(_aggregate(folder and f"{folder}/duckdb", memory_mb), PARTIAL)
