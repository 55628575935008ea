"""Writers of the text formats. Lines are sorted by their position; Spark writes them as ordered part files of one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, line: Column, order: list[Column | str]) -> None:
    """One ``line`` a row, in order over all part files."""
    rows.select(line.alias("value"), *(F.col(o) if isinstance(o, str) else o for o in order)).orderBy(*order).select("value").write.mode("overwrite").text(path)


def write_scores(rows: DataFrame, path: str, score: str, pos: str = "pos") -> None:
    """One score a line, in the order of the query file."""
    write_lines(rows, path, F.format_string("%.6f", score), [pos])


def write_clusters(rows: DataFrame, path: str) -> None:
    """'doc cluster' lines."""
    write_lines(rows, path, F.concat_ws(" ", "doc_id", "cluster_id"), ["doc_id"])


def write_run(rows: DataFrame, path: str) -> None:
    """Run rows ``(query_name, rank, line)``."""
    write_lines(rows, path, F.col("line"), ["query_name", "rank"])


def write_run_lists(rows: DataFrame, folder: str) -> None:
    """Run rows ``(query_name, rank, line)`` as one '<query_name>.results.txt' a query, each a folder of ordered part files."""
    named = rows.select(F.concat("query_name", F.lit(".results.txt")).alias("query"), "rank", F.col("line").alias("value"))
    named.repartition("query").sortWithinPartitions("query", "rank").select("query", "value").write.mode("overwrite").partitionBy("query").text(folder)


def write_letor(rows: DataFrame, path: str, queries: DataFrame, score: str = "score") -> None:
    """One score a line of the query file ``queries(pos, user_id, item_id)``, in its order; pairs without a score get 0."""
    placed = queries.select("pos", "user_id", "item_id").join(rows.select("user_id", "item_id", F.col(score).alias("__s")), ["user_id", "item_id"], "left")
    write_scores(placed.select("pos", F.coalesce("__s", F.lit(0.0)).alias("__s")), path, "__s")


def write_rank(rows: DataFrame, path: str) -> None:
    """'doc score' lines of ``(doc_id, r)``, descending."""
    rows.orderBy(F.desc("r"), "doc_id").select(F.concat_ws(" ", "doc_id", F.col("r").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_dictionary(rows: DataFrame, path: str) -> None:
    """'token idx' lines."""
    write_lines(rows, path, F.concat_ws(" ", "token", "idx"), ["idx"])


def write_cleaned(rows: DataFrame, path: str) -> None:
    """'stars<TAB>text' lines; tabs and line ends in texts become spaces."""
    write_lines(rows, path, F.concat_ws("\t", "stars", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\r\n]", " ")), ["pos"])


def write_coded(rows: DataFrame, path: str) -> None:
    """'stars<TAB>id id ...' lines."""
    write_lines(rows, path, F.concat_ws("\t", "stars", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")), ["pos"])


def write_classes(rows: DataFrame, path: str) -> None:
    """'hard soft' lines of ``(pos, hard, soft)``."""
    write_lines(rows, path, F.concat_ws(" ", "hard", F.format_string("%.6f", "soft")), ["pos"])


def write_report(rows: DataFrame, path: str) -> None:
    """'name: value' lines of a one-row table of figures."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("n"), F.col(c).cast("string").alias("v")) for k, c in enumerate(rows.columns)))
    write_lines(rows.select(F.explode(pairs).alias("p")).select("p.*"), path, F.concat_ws(": ", "n", F.coalesce("v", F.lit("none"))), ["k"])


def write_table(rows: DataFrame, path: str) -> DataFrame:
    """A Parquet copy for later runs; gives the table read back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
