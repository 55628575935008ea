"""Session helpers: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in estimated bytes, that an operator may broadcast.
BROADCAST_BYTES = 64 << 20

_own_folder: str | None = None
_written: list[str] = []


def _clean_up() -> None:
    """At the end of the process, deletes the tables written to the shared folder, of any file system as long as the session lives."""
    spark = SparkSession.getActiveSession()
    for path in list(_written):
        local = local_path(path)
        if local is not None:
            shutil.rmtree(local, ignore_errors=True)
        elif spark is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  (the session may be gone)
                return


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one of ours only where that is unset."""
    global _own_folder
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder shared by all executors")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="skeinwork-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/skeinwork/{label}-{uuid.uuid4().hex}"
    if not _written:  # after the session's own registration, so that it runs before the session ends
        atexit.unregister(_clean_up)
        atexit.register(_clean_up)
    _written.append(path)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table: lineage ends there and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "lz4").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._skeinwork_path = path
    return table


def drop_cut(table: DataFrame | None) -> None:
    """Deletes a table made by :func:`cut` that no later plan reads."""
    path = getattr(table, "_skeinwork_path", None)
    if path is None:
        return
    _delete(table.sparkSession, path)
    _written.remove(path)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path; None for other file systems."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def broadcast_if_small(df: DataFrame, rows: int, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``limit``; else as it is, and the join shuffles."""
    return F.broadcast(df) if rows * bytes_per_row <= limit else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
