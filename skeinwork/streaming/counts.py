"""Corpus statistics over unbounded input with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens


def label_counts(stream: DataFrame, label: str) -> DataFrame:
    """``(label, n)`` so far."""
    return stream.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def term_counts(stream: DataFrame, text: str = "text") -> DataFrame:
    """``(token, ctf, df)`` so far; each row of the stream is a record."""
    # a token counts for df at its first place only: sorted, that is where the one before differs
    ordered = stream.select(F.array_sort(tokens(F.col(text))).alias("t"))
    marked = F.transform("t", lambda w, k: F.struct(w.alias("token"), F.when((k == 0) | (F.get("t", k - 1) != w), 1).otherwise(0).alias("first")))
    own = ordered.select(F.explode(marked).alias("m")).select("m.token", "m.first")
    return own.groupBy("token").agg(F.count(F.lit(1)).alias("ctf"), F.sum("first").alias("df"))


def windowed_counts(stream: DataFrame, time: str, key: str, *, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(window, key, n)`` by event time; rows later than ``late`` behind the newest are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"))


def run_available(result: DataFrame, name: str, checkpoint: str, *, mode: str = "complete") -> StreamingQuery:
    """Processes what is there into the in-memory table ``name`` and ends."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
